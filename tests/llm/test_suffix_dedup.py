import hashlib
import random

import pytest

from corvane.llm import suffix_dedup as sd


def brute(rows, length=100):
    docs = sorted({((d is not None), d or 0): (t or "").encode() for d, t in rows}.items())
    seen, out = set(), {}
    for (has, d), t in docs:
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                mask[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, m in zip(t, mask) if not m)
        spans = sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))
        out[d if has else None] = (len(t), sum(mask), spans, hashlib.sha256(kept).hexdigest())
    return out


def compare(spark, rows, parts=3):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, k int").repartition(parts)
    got = sd.dedup(df).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id], r


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gämma", "de", "x", "yy", "zebra"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))
    shared = [text(n) for n in (10, 18, 30, 60, 200)]
    rows = []
    for i in range(150):
        t = text(rng.choice([0, 3, 40, 200]))
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            t += s[a : a + rng.randrange(300)] + text(2)
        rows.append((i * 7 % 151, t))
    rows += [(1000, rows[3][1]), (1001, rows[3][1] * 2), (None, rows[5][1]), (1003, None), (1004, ""), (1005, "ab" * 400), (1006, "a" * 99), (1007, "a" * 100), (1008, "a" * 101)]
    compare(spark, rows)


def test_hot_passage(spark):
    rng = random.Random(3)
    passage = " ".join(str(rng.randrange(10**6)) for _ in range(40))
    rows = [(i, f"{rng.random()} {passage} {rng.random()} tail {i}") for i in range(200)]
    compare(spark, rows, 2)


def test_repeated_rows_and_empty(spark):
    t = "".join(chr(97 + i % 26) for i in range(300))
    compare(spark, [(1, t), (1, t), (2, "q" + t)])
    assert sd.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_text_keeps_other_columns(spark):
    t = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    rows = [(1, t, 5, "a"), (2, "x " + t, 6, None), (3, None, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int, spans string")
    got = {r.doc_id: tuple(r) for r in sd.dedup_text(df).collect()}
    assert got == {1: rows[0], 2: (2, "x ", 6, None), 3: rows[2]}
