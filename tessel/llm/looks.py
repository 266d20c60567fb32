"""What characters look like: folding of widths, invisible characters and look-alike letters."""

import re
import unicodedata

# Letters of other scripts and the Latin letters they cannot be told from.
CYRILLIC = "АВЕЅІЈКМНОРСТХУаеѕіјорсхуһԁԛԝӏѵ"
CYRILLIC_AS = "ABESIJKMHOPCTXYaesijopcxyhdqwlv"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳ"
GREEK_AS = "ABEZHIKMNOPTYXovj"
# Characters that show nothing of their own.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u180f\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\u3164\ufeff\uffa0"
# One blank of any width, and hyphens of one look.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011"

TO_LATIN = {ord(a): b for a, b in zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS)}
TO_LATIN |= {ord(unicodedata.normalize("NFC", a + m)): unicodedata.normalize("NFC", b + m) for a, b in zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS) for m in "̀́̂̃̆̈̄̌̊̇" if len(unicodedata.normalize("NFC", a + m)) == 1 and len(unicodedata.normalize("NFC", b + m)) == 1}


class _Widths(dict):
    """Character to what it looks like at normal width; filled as characters come up."""

    def __missing__(self, code: int) -> str | int:
        c = chr(code)
        kind = unicodedata.decomposition(c).split(" ", 1)[0]
        out: str | int = unicodedata.normalize("NFC", c) if unicodedata.decomposition(c) else code
        if c in INVISIBLE or 0xFE00 <= code <= 0xFE0F or 0xE0000 <= code <= 0xE01EF:
            out = ""
        elif c in SPACES:
            out = " "
        elif c in HYPHENS:
            out = "-"
        elif c == "µ":
            out = "μ"
        elif kind in ("<wide>", "<narrow>", "<font>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>") or (kind == "<compat>" and unicodedata.category(c) in ("Ll", "Lu", "Nl", "Lo", "Lt") and c not in "ſŉǄǅǆǇǈǉǊǋǌǱǲǳ"):
            out = unicodedata.normalize("NFKC", c)
        self[code] = out
        return out


WIDTHS = _Widths()


class _Looks(dict):
    """Character to the Latin letter it cannot be told from."""

    def __missing__(self, code: int) -> str | int:
        self[code] = code
        return code


class _Words(dict):
    """Character to its lower-case form for comparing words."""

    def __missing__(self, code: int) -> str | int:
        self[code] = out = unicodedata.normalize("NFKC", chr(code).translate(WIDTHS).translate(LOOKS)).lower()
        return out


LOOKS, WORDS = _Looks(TO_LATIN), _Words()


def _swap(text: str, table: dict, odd: list[str]) -> str:
    """str.translate for texts in which few different characters are odd."""
    for c in odd:
        new = table[ord(c)]
        if new != c and new != ord(c):
            text = text.replace(c, new)
    return text


def _odd(text: str) -> tuple[list[str], bool]:
    """The characters beyond ASCII and whether any of them is a combining mark."""
    odd = [c for c in set(text) if c > "\x7f"]
    return odd, any(unicodedata.combining(c) for c in odd)


def plain_widths(text: str) -> str:
    """One width per character, one way to compose accents, nothing invisible; what shows is kept."""
    if not text.isascii():
        odd, marks = _odd(text)
        text = _swap(text, WIDTHS, odd)
        text = unicodedata.normalize("NFC", text) if marks else text
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def look(text: str) -> str:
    """The Latin letters a text in plain widths cannot be told from."""
    if text.isascii():
        return text
    odd, marks = _odd(text)
    text = _swap(text, LOOKS, odd)
    return unicodedata.normalize("NFC", text) if marks else text


_CODES = re.compile(r"\[[^\[\]\n]{0,40}\]|\(\s*\w?\d\w{0,3}\s*\)")
_WORD = re.compile(r"\w+")
_FOREIGN = re.compile(r"(?<!\w)[^\W\u0370-\u052f]*+[\u0370-\u052f]\w*")


def _word_look(m: re.Match) -> str:
    """A word with Greek or Cyrillic letters in the letters it looks like, before case is left out.

    A word that has Latin letters, or only letters that look Latin, is read by the look of each letter
    as written. One whose capitals all look Latin is read by them, so that it stays one word in either
    case; a lone letter is not. Any other is a word of its own script.
    """
    word, high = m[0], m[0].upper()
    letters = [c for c in word if c.isalpha()]
    if any(c < "\u0250" for c in letters) or all(ord(c) in TO_LATIN for c in letters):
        return word.translate(LOOKS)
    if len(letters) > 1 and all(ord(c) in TO_LATIN for c in high if c.isalpha()):
        return high.translate(LOOKS)
    return word


def plain_words(text: str | None) -> list[str]:
    """The words of a text without case, punctuation, line layout, bracketed codes and odd characters."""
    if not text:
        return []
    if not text.isascii():
        odd, marks = _odd(text)
        text = _swap(text, WIDTHS, odd)
        text = unicodedata.normalize("NFC", text) if marks else text
        if any("\u0370" <= c <= "\u052f" for c in _odd(text)[0]):
            text = _FOREIGN.sub(_word_look, text)
        text = text.lower()
        text = _swap(text, WORDS, _odd(text)[0])
    else:
        text = text.lower()
    if "[" in text or "(" in text:
        text = _CODES.sub(" ", text)
    return _WORD.findall(text)
