"""Names mentioned in texts, against plain containment."""

import random
from collections import Counter

from corpusloom.operators.mentions import mentioned_names


def by_hand(texts, names):
    return Counter(
        (d, u, n) for d, u, t in texts for n in {n for v, n in names if v == u and n} if u is not None and t is not None and n in t
    )


def found(spark, texts, names, **sizes):
    t = spark.createDataFrame(texts, "doc_id long, users_idx long, text string")
    n = spark.createDataFrame(names, "users_idx long, name string")
    return Counter(map(tuple, mentioned_names(t, n, **sizes).collect()))


def test_blocks_and_salts(spark):
    rng = random.Random(1)

    def word(k):
        return "".join(rng.choices("abé", k=k))

    names = [(rng.choice([1, 1, 1, 2, 3, None]), word(rng.randint(0, 5))) for _ in range(200)] + [(1, None), (1, "ab"), (1, "ab"), (9, "ab")]
    texts = [(i, rng.choice([1, 1, 2, 4, None]), word(rng.randint(0, 30))) for i in range(150)] + [(500, 1, None), (501, 1, ""), (502, 1, "ab" * 5000)]
    want = by_hand(texts, names)
    assert len(want) > 500
    assert found(spark, texts, names) == want
    assert found(spark, texts, names, block_names=7, task_chars=100) == want
    assert found(spark, [], names) == found(spark, texts, []) == Counter()


def test_names_that_begin_alike(spark):
    names = [(1, f"project {i}!") for i in range(10_000)]
    texts = [(i, 1, " ".join(f"project {j}!" for j in range(i, 10_000, 997)) + " project " * 50) for i in range(200)]
    assert found(spark, texts, names) == Counter((d, 1, f"project {j}!") for d, _, _ in texts for j in range(d, 10_000, 997))
