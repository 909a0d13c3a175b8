"""Documents with a null doc_id, or with one doc_id and several texts, are told apart by their texts."""

import random
from collections import Counter

from corvane.llm import near_dedup, suffix_dedup

rng = random.Random(17)
A, B, C, D = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(4))
ROWS = [(None, A), (None, B), (None, B), (None, None), (1, B), (2, A + " one more"), (3, C), (3, D), (4, D)]
SCHEMA = "doc_id long, text string"


def test_near_dedup_keeps_each_text(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    kept = Counter((r.doc_id, r.text) for r in near_dedup.near_dedup(df).collect())
    assert kept == Counter([(None, A), (None, B), (None, None), (3, C), (3, D)])
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_components(df).collect()), key=str)
    assert got == sorted([(None, None, True)] * 4 + [(1, None, False), (2, None, False), (3, 3, True), (3, 3, True), (4, 3, False)], key=str)


def test_suffix_dedup_cuts_no_other_text(spark):
    df = spark.createDataFrame([(None, A), (None, B + A[:200]), (None, C), (5, "x" + C), (6, D), (6, B)], SCHEMA).repartition(3)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(df).collect())
    a, b, c, d = map(len, (A, B, C, D))
    cut = [(None, a, 0), (None, b + 200, 200)], [(None, a, 200), (None, b + 200, 0)]  # nulls are in order of their hashes
    rest = [(None, c, 0), (5, c + 1, c), (6, d, 0), (6, b, b)]
    assert got in [Counter(x + rest) for x in cut]
    texts = [r.text for r in suffix_dedup.dedup_text(df).collect()]
    assert sum(A[200:] in t for t in texts) == 1 and C in texts and D in texts and sum(A[:200] in t for t in texts) == 1
