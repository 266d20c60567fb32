import math
import random

from tessel.plans import catalog


def test_nearest_to_the_mean_over_the_whole_vector(spark, tmp_path):
    rng = random.Random(4)
    data = [(i, "ab"[i % 2], [rng.uniform(-1, 1) for _ in range(12)]) for i in range(40)]
    # in the first two components vector 100 is nearest, in the others farthest
    data += [(100 + j, label, [sum(x[k] for _, y, x in data if y == label) / 20 for k in range(2)] + [9.0] * 10) for j, label in enumerate("ab")]
    spark.createDataFrame([*data, (200, "a", None)], "vec_id long, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {}
    for label in "ab":
        own = [(i, x) for i, y, x in data if y == label]
        mean = [sum(c) / len(own) for c in zip(*(x for _, x in own))]
        want[label] = min((round(math.dist(x, mean), 6), i) for i, x in own)[1]
    assert {r["label"]: r["vec_id"] for r in catalog.queries()["kg12_vector_tiebreak"](spark, str(tmp_path)).collect()} == want
