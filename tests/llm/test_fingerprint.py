import hashlib
import random

import xxhash

from corvane.llm import fingerprint as fp


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def test_edits_and_likeness(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 9)))
    rows = [(i * 3, " ".join(word() for _ in range(rng.choice([1, 2, 4, 30, 300])))) for i in range(60)] + [(1000, None), (1001, ""), (None, "nothing here at all to see"), (31, "again"), (31, "again")]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_chars int").repartition(3)
    got = fp.fingerprints(df).collect()
    s = order(rows)
    want = []
    for i, (d, t) in enumerate(s):
        t, nxt = t or "", s[(i + 1) % len(s)][1] or ""
        m = len(t) // 4
        want.append((d, len(t), hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest()))
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by.values())
    long = [r for r in got if r.n_chars > 800]
    assert min(r.near_edited for r in long) > 0.4 and max(r.near_next for r in long) < 0.1
    assert all(r.fingerprint for r in got if r.n_chars)


def rolled(text, k):
    """Every run's hash from its own characters."""
    mask = (1 << 64) - 1
    char = lambda c: xxhash.xxh64_intdigest(c.encode(), seed=42)
    out = []
    for i in range(max(0, len(text) - k + 1)):
        h = 0
        for j in range(k):
            h ^= char(text[i + j]) << (k - 1 - j) & mask
        out.append(h)
    if text and not out:
        out = [xxhash.xxh64_intdigest(text.encode(), seed=42)]
    return [h - (1 << 64) if h >> 63 else h for h in out]


def winnow(text, k, w):
    grams = rolled(text, k)
    out = []
    for i in range(max(1, len(grams) - w + 1) if grams else 0):
        best = min(range(i, min(i + w, len(grams))), key=lambda p: (grams[p], -p))
        if not out or out[-1][1] != best:
            out.append((grams[best], best))
    return out


def picks(grams, w):
    """Every window's least hash, the rightmost one in ties."""
    ends = range(max(1, len(grams) - w + 1) if grams else 0)
    at = sorted({min(range(i, min(i + w, len(grams))), key=lambda p: (grams[p], -p)) for i in ends})
    return [(grams[p], p) for p in at]


def test_choices_among_few_places(spark):
    rng = random.Random(8)
    long = lambda: rng.randrange(-(1 << 63), 1 << 63)
    rows = [[long() for _ in range(n)] for n in [*range(0, 6), 15, 16, 17, 31, 32, 33, 47, 48, 49, 63, 64, 65, 200, 3000]]
    rows += [[rng.randrange(v) for _ in range(n)] for v in (1, 2, 3, 20) for n in (7, 31, 33, 150)]
    rows += [list(range(150)), list(range(150, 0, -1)), [i % 37 for i in range(300)], [-i % 37 for i in range(300)], [abs(i % 40 - 20) for i in range(300)], [(1 << 63) - 1] * 90]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, h array<long>")
    for w in (1, 2, 4, 8, fp.W):
        for r in df.select("i", fp.winnowed(fp.F.col("h"), w).alias("c")).collect():
            assert [tuple(x) for x in r.c] == picks(rows[r.i], w), (w, r.i)
    # what is looked at one by one are few of the positions, with every choice among them
    whole = spark.createDataFrame([([long() for _ in range(40_000)],)], "h array<long>")
    p, c = whole.select(fp._places(fp.F.col("h"), fp.W), fp.winnowed(fp.F.col("h"))["pos"]).first()
    assert p == sorted(set(p)) and set(c) <= set(p) and len(p) < 40_000 / 8


def share(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_equal_plain_winnowing(spark):
    rng = random.Random(11)
    some = lambda n, letters="abcdefgé 漢": "".join(rng.choice(letters) for _ in range(n))
    sizes = [0, 1, 5, 15, 16, 17, 46, 47, 48, 60, 61, 62, 63, 64, 70, 100, 190, 250, 400, 900]
    rows = [(i, some(rng.choice(sizes))) for i in range(90)] + [(200, "a" * 500), (201, "ab" * 300), (202, some(4000, "xyz")), (203, None), (None, some(80)), (None, some(300)), (77, "twin"), (78, some(700, "q"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for k, w in ((fp.K, fp.W), (4, 8), (1, 1)):
        got = sorted(fp.fingerprints(df, k, w).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256))
        s = order(rows)
        want = []
        for i, (d, t) in enumerate(s):
            t, nxt = t or "", s[(i + 1) % len(s)][1] or ""
            m = len(t) // 4
            e = t[: len(t) - m] + nxt[:m]
            a, b, c = winnow(t, k, w), winnow(e, k, w), winnow(nxt, k, w)
            string = lambda x: " ".join(f"{h % (1 << 64):x}:{p:x}" for h, p in x)
            want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), string(a), string(b), share(a, b), share(a, c)))
        want.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        for x, y in zip(got, want, strict=True):
            assert tuple(x)[:5] == y[:5], (k, w, x.doc_id)
            assert abs(x.near_edited - y[5]) < 1e-9 and abs(x.near_next - y[6]) < 1e-9


def test_a_shared_run_shares_a_hash(spark):
    rng = random.Random(4)
    unspaced = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    run = unspaced(fp.K + fp.W - 1)
    a, b = unspaced(333) + run + unspaced(90), unspaced(7) + run + unspaced(500)
    got = spark.createDataFrame([(a,), (b,)], "t string").select(fp.chosen(fp.F.col("t")).alias("c")).collect()
    assert {r["hash"] for r in got[0].c} & {r["hash"] for r in got[1].c}


def test_small_tables(spark):
    one = spark.createDataFrame([(1, "alone in the table")], "doc_id long, text string")
    assert fp.fingerprints(one).collect()[0].near_next == 1.0
    assert fp.fingerprints(one.limit(0)).count() == 0
