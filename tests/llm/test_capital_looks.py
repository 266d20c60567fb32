import pytest

from tessel.llm.looks import CYRILLIC, CYRILLIC_AS, GREEK, GREEK_AS, plain_words

ALIKE = dict(zip(CYRILLIC_AS, CYRILLIC)) | dict(zip(GREEK_AS, GREEK))


@pytest.mark.parametrize("pairs", [dict(zip(CYRILLIC_AS, CYRILLIC)), dict(zip(GREEK_AS, GREEK)), ALIKE])
def test_capital_look_alikes_are_the_words_they_look_like(pairs):
    text = "THE BEST MARKER OF ACUTE HEART Failure IN Men AND Women Is BNP, Not The TROPONIN ZINC K"
    assert plain_words("".join(pairs.get(c, c) for c in text)) == plain_words(text)
    assert plain_words("".join(pairs.get(c, c) if i % 3 else c for i, c in enumerate(text))) == plain_words(text)


def test_capital_nu_is_no_v():
    assert plain_words("ΝΟTE") == ["note"]


@pytest.mark.parametrize("word", ["привет", "нет", "ват", "боль", "καρδιά", "νοτα", "nierenfunktion", "été", "straße"])
def test_words_of_other_scripts_stay_one_word_in_either_case(word):
    assert plain_words(word.capitalize()) == plain_words(word)
    if "ß" not in word:
        assert plain_words(word.upper()) == plain_words(word)


def test_units_and_lone_letters_keep_their_letter():
    assert plain_words("5 µg β-blocker") == ["5", "μg", "β", "blocker"]
    assert plain_words("​ＭＧ ﬁve") == ["mg", "five"]
