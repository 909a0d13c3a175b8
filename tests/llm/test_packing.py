import random
import zlib
from collections import defaultdict

import numpy as np

from corvane.llm import packing, tokens


def rows_of(docs, **kw):
    return [r.asDict() for r in packing.pack(docs, **kw).collect()]


def check(rows, source, size=2048, end=1):
    """Every id lies in one piece; sequences are gapless and no longer than size."""
    enc = tokens.encoder(tokens.default_path())
    want = sorted(tuple([*(enc.whole(t) if t else []), end]) for _, t in source)
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[(r["doc_id"], r["doc_tokens"])].append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= size
    assert sum(r["length"] for r in rows) == sum(map(len, want))
    return seqs, want


def test_pack(spark):
    rng = random.Random(1)
    source = [(i, " ".join(rng.choice(["alpha", "beta", "x"]) for _ in range(rng.choice([1, 5, 300, 3000])))) for i in range(120)] + [(500, None), (501, ""), (None, "no id")]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in source], "doc_id long, text string, length string").repartition(3)
    rows = rows_of(docs, with_ids=True)
    seqs, want = check(rows, source)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    got = []
    for ps in by.values():
        ps.sort(key=lambda r: r["start"])
        assert [p["start"] for p in ps] == list(np.cumsum([0, *[p["length"] for p in ps]])[:-1])
        got.append(tuple(x for p in ps for x in p["ids"]))
    assert sorted(got) == want
    total = sum(map(len, want))
    assert len(seqs) <= total / 2048 * 1.1 + 2


def test_bounded_space_emits_the_fullest():
    w = packing.OpenWindows(2, 10)
    assert w.place(6, "a") is None and w.place(7, "b") is None
    assert w.place(8, "c") == [(0, "b")]
    assert w.place(4, "d") == [(0, "a"), (6, "d")]
    assert w.place(2, "e") == [(0, "c"), (8, "e")]
    assert w.rest() == []


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "same"), (1, "same")], "doc_id long, text string")
    rows = rows_of(docs)
    assert len(rows) == 2 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 2
    assert rows_of(docs.limit(0)) == []


def test_best_fit_against_a_plain_search():
    """Every piece goes to the open window with the least room that it fits, the oldest in ties; else the fullest is emitted."""
    rng = random.Random(21)
    for limit, size in ((1, 10), (3, 20), (8, 100)):
        opened, plain, emitted, want, count = packing.OpenWindows(limit, size), [], [], [], 0
        for i in range(400):
            n = rng.randrange(1, size)
            done = opened.place(n, i)
            while done and None in done:
                k = done.index(None)
                emitted.append(done[:k])
                done = done[k + 1 :]
            if done:
                emitted.append(done)
            fits = [w for w in plain if w[0] >= n]
            if fits:
                w = min(fits, key=lambda w: (w[0], w[1]))
            else:
                if len(plain) >= limit:
                    full = min(plain, key=lambda w: (w[0], w[1]))
                    plain.remove(full)
                    want.append(full[2])
                w = [size, count, []]
                count += 1
                plain.append(w)
            w[2].append((size - w[0], i))
            w[0] -= n
            if not w[0]:
                plain.remove(w)
                want.append(w[2])
        assert emitted == want and sorted(map(str, opened.rest())) == sorted(str(w[2]) for w in plain)
