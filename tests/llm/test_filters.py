"""URL filter, decontamination, near-dedup, quality and toxicity on small tables, against brute force."""

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import decontaminate, near_dedup, quality, toxicity, url_filter


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.org", "http://a.org/", "https://x.Example.org/es/1", "http://example.org/en/12?q", "http://b.com/fr/", "http://b.com/de/x", "http://www.bad.net/x/", "http://bad.net#f", "http://ok.net/listed//", "http://ok.net/other", "http://notorg/"]
    pages = spark.createDataFrame([(i, u, "host") for i, u in enumerate(urls)] + [(9, urls[9], "again")], "page_id long, url string, host string")
    listed = spark.createDataFrame([("bad.net/",), ("ok.net/listed",), (None,), ("bad.net/",)], "url_key string")
    got = sorted([(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, listed).collect()], key=str)
    want = [
        (0, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.org", "", None, "allow"), (4, "a.org", "/", "org/", "allow"),
        (5, "x.example.org", "/es/1", "example.org/es/", "block"), (6, "example.org", "/en/12", "example.org/en/1", "block"), (7, "b.com", "/fr/", "com/fr/", "allow"), (8, "b.com", "/de/x", "com/de/", "block"),
        (9, "www.bad.net", "/x/", None, "block"), (9, "www.bad.net", "/x/", None, "block"), (10, "bad.net", "", None, "block"), (11, "ok.net", "/listed//", None, "block"), (12, "ok.net", "/other", None, "allow"), (13, "notorg", "/", None, "allow"),
    ]
    assert got == sorted(want, key=str)
    assert url_filter.url_filter(pages, listed.limit(0)).where("listed").count() == 0 and url_filter.url_filter(pages.limit(0), listed).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_contamination(text, items):
    w = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        v = WORD.findall((t or "").translate(LOWER))
        size = min(13, len(v))
        for i in range(len(v) - size + 1 if v else 0):
            for j in range(len(w) - size + 1):
                if w[j : j + size] == v[i : i + size]:
                    hit |= set(range(j, j + size))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["Alpha", "beta", "gÄmma", "d3", "x", "the", "of"])
    sentence = lambda n: " ".join(word() + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(i, sentence(n)) for i, n in enumerate([1, 2, 4, 7, 13, 20, 40])] + [(7, None), (None, sentence(15)), (8, "..."), (9, "the of")]
    docs = [(i, sentence(rng.choice([0, 1, 20, 200])) + " " + rng.choice(items)[1].__str__() + " " + sentence(3)) for i in range(40)] + [(100, None), (101, ""), (None, items[5][1]), (3, "same"), (3, "same")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, w int")
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n_words int")
    for block in (50_000, 10):
        got = decontaminate.contamination(df, bench, block_windows=block).collect()
        want = sorted([(d, *brute_contamination(t, items)) for d, t in docs], key=str)
        assert sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got], key=str) == want
    kept = decontaminate.decontaminate(df, bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[0]) for w in want if not w[5])
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


def brute_components(rows):
    sets = {(d if d is not None else -1): near_dedup.shingle_set(t) for d, t in rows}
    comp = {k: k for k in sets}

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {k: (len(sets[k]), root(k)) for k in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_components(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(n)] for n in (1, 2, 3, 12, 60, 150, 150)]
    rows = []
    for i in range(260):
        w = list(rng.choice(base[:-1]) if i % 3 else base[-1])
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.2:
            w = w[: max(1, int(len(w) * 0.9))]
        rows.append((i * 5 % 261 + 3, " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "  Abcd\tefgh "), (904, "abcd efgh"), (905, rows[0][1].upper()), (None, rows[1][1])]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, k int").repartition(3)
    want = brute_components(rows)
    got = {(-1 if r.doc_id is None else r.doc_id): (r.n_shingles, -1 if r.component_id is None else r.component_id) for r in near_dedup.near_components(df).collect()}
    assert got == want
    kept = near_dedup.near_dedup(df.unionAll(df.where("doc_id = 904"))).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept) == sorted(k for k, (_, c) in want.items() if k == c)


def test_index_keys_find_all_pairs_within_the_distance():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [base] + [np.concatenate([base[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)]) for k in (2, 5, 8, 10)]
    keys = near_dedup.index_keys(sets)
    assert all(set(keys[0]) & set(k) for k in keys[1:])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_components(empty).count() == 0 and near_dedup.near_dedup(empty).count() == 0
    assert quality.score_quality(empty, quality.Chain.fit([], np.array([]))).count() == 0
    assert toxicity.score_toxicity(empty, toxicity.Grammar.fit([], np.array([]))).count() == 0


def labelled(spark, label):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col(label).alias("label"))


def test_quality_held_out(spark):
    docs, labels = labelled(spark, "quality")
    model = quality.fit_quality(docs, labels.withColumnRenamed("label", "quality"), quality.fold(F.col("doc_id"), 5) != 0)
    rows = quality.score_quality(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(quality.fold(F.col("doc_id"), 5) == 0).collect()
    good, bad = [r.score for r in rows if r.label == 1], [r.score for r in rows if r.label == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([(r.score >= quality.THRESHOLD) == r.label for r in rows]) > 0.93
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "word " * 50000, "x")], "doc_id long, text string, lines string")
    assert all(0 <= r.score <= 1 for r in quality.score_quality(odd, model).collect())


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    x, n = rng.normal(size=(7, 3)), np.array([3, 1, 3])
    model = quality.Chain(rng.normal(size=3), rng.normal(size=(2, 2)))
    p = model.marginals(x, n)
    at = 0
    for size in n:
        total, ones = 0.0, np.zeros(size)
        for k in range(1 << size):
            y = [k >> i & 1 for i in range(size)]
            weight = np.exp(sum((x[at + i] @ model.w) * y[i] for i in range(size)) + sum(model.trans[y[i], y[i + 1]] for i in range(size - 1)))
            total += weight
            ones += weight * np.array(y)
        assert np.allclose(p[at : at + size], ones / total)
        at += size


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark, "toxic")
    grammar = toxicity.fit_toxicity(docs, labels.withColumnRenamed("label", "toxic"), toxicity.fold(F.col("doc_id"), 3) != 1)
    rows = toxicity.score_toxicity(docs.select("doc_id", "text"), grammar).join(labels, "doc_id").where(toxicity.fold(F.col("doc_id"), 3) == 1).collect()
    assert np.mean([(r.score >= toxicity.THRESHOLD) == r.label for r in rows]) > 0.94


def kinds(g, sentence):
    return [k for k, _ in g.clause(toxicity._TOKEN.findall(sentence.lower()))]


def test_grammar_composition():
    g = toxicity.Grammar({"idiot$": 8.0, "lowei": 8.0})
    for sentence, want in (
        ("you are an idiot", "insult_targeted"),
        ("you're an idiot", "insult_targeted"),
        ("an idiot sat there", "insult"),
        ("he is not an idiot", "insult_negated"),
        ("he is not really a very great idiot", "insult_negated"),
        ("tu n'es pas un idiot", "insult_negated"),
        ("du bist kein idiot", "insult_negated"),
        ("no eres un idiot", "insult_negated"),
        ("he isn't nice, but an idiot", "insult_targeted"),
        ("the paper said an idiot sat", "insult_reported"),
        ("he said: you are an idiot", "insult_reported"),
        ("he wrote, you are an idiot", "insult_reported"),
        ('"you idiot", he said', "insult_reported"),
        ("you are an idiot, the teacher said", "insult_reported"),
        ('"oh" she said, you idiot', "insult_reported"),
        ("they will kill you", "threat_targeted"),
        ("they said they will kill you", "threat_reported"),
        ("ich töte dich nicht", "threat_negated"),
        ("loweiung idiotic", "insult"),
    ):
        assert kinds(g, sentence) == [want], sentence
    low, mid, high = (g.scores([t.encode()])[0] for t in ("nothing here", "he said: the idiot sat", "You idiot. you idiot"))
    assert low < mid < 0.5 < high
    quoted, meant = g.scores([b'"You idiot!" he said.', b"You idiot! He left."])
    assert quoted < 0.5 < meant


def test_composition_equals_one_after_the_other():
    rng = np.random.default_rng(2)
    machines = [toxicity.negation(), toxicity.report(), toxicity.target(), toxicity.negation_behind(), toxicity.report_behind()]
    for _ in range(200):
        symbols = rng.choice([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 16], rng.integers(0, 30)).tolist()
        i, j = rng.integers(0, len(machines), 2)
        ones = [1.0] * len(symbols)
        assert toxicity.compose(machines[i], machines[j]).run(symbols, ones) == machines[j].run(*machines[i].run(symbols, ones))


def test_toxicity_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "fine", "x"), (3, "fine", "x"), (None, "you idiot " * 50000, "x"), (5, "you idiot", "x")], "doc_id long, text string, label string")
    g = toxicity.Grammar({"idiot$": 8.0})
    got = toxicity.score_toxicity(docs, g).collect()
    base = g.scores([b""])[0]
    assert [r.score for r in got[:4]] == [base] * 4 and got[4].score > 0.7 and got[5].score > 0.7
    clash = toxicity.score_toxicity(docs.withColumnRenamed("label", "score"), g)
    assert clash.columns == ["doc_id", "text", "score", "_score"] and {r.score for r in clash.collect()} == {"x"}
    for labels in ([(5, 1), (3, 1)], [(5, 0), (3, None), (None, 1)], []):  # one class, nulls, none
        table = spark.createDataFrame(labels, "doc_id long, toxic int")
        fitted = toxicity.fit_toxicity(docs, table, F.lit(True))
        assert fitted.stems == {} and all(0 <= r.score <= 1 for r in toxicity.score_toxicity(docs, fitted).collect())


def test_toxicity_beats_words_alone(spark):
    """Held-out recall, and the reports and negations that words alone would call toxic."""
    docs, labels = labelled(spark, "toxic")
    grammar = toxicity.fit_toxicity(docs, labels.withColumnRenamed("label", "toxic"), toxicity.fold(F.col("doc_id"), 3) != 1)
    rows = docs.join(labels, "doc_id").where(toxicity.fold(F.col("doc_id"), 3) == 1).collect()
    scores = grammar.scores([(r.text or "").encode() for r in rows])
    words_alone = [grammar.trigger.search((r.text or "").lower()) is not None for r in rows]
    wrong = lambda predicted: sum(bool(p) != bool(r.label) for p, r in zip(predicted, rows))
    assert wrong(s >= toxicity.THRESHOLD for s in scores) <= wrong(words_alone)
    word = next(s.rstrip("$") for s in sorted(grammar.stems) if s.endswith("$"))
    for sentence in ("You are not {}.", 'He said: "you are {}".', '"You {}", he said.'):
        assert grammar.scores([sentence.format(word).encode()])[0] < toxicity.THRESHOLD


def test_folds_follow_crc32(spark):
    got = spark.range(50).select("id", quality.fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


def test_url_filter_with_long_lists_and_odd_rows(spark):
    """Keys beyond the broadcast size, false positives of a full Bloom filter, null ids and very long URLs."""
    rng = random.Random(9)
    hosts = [f"h{i}.example" for i in range(300)]
    urls = [(i if i % 50 else None, f"http://{rng.choice(hosts)}/p{rng.randrange(40)}/") for i in range(2000)] + [(5000, "http://h1.example/" + "x" * 100_000), (5001, "http://h2.example/p1")]
    listed = [(h + "/",) for h in hosts[:30]] + [(f"{h}/p{i}",) for h in hosts[30:200] for i in range(9)]
    keys = {k for k, in listed}
    pages = spark.createDataFrame(urls, "page_id long, url string").repartition(3)
    table = spark.createDataFrame(listed, "url_key string")
    for options in ({}, {"broadcast_rows": 10}, {"max_blocks": 1, "broadcast_rows": 10}):
        got = sorted(((r.page_id, r.host, r.path, r.listed) for r in url_filter.url_filter(pages, table, **options).collect()), key=str)
        want = []
        for i, u in urls:
            host, path = u[7:].split("/", 1)
            path = "/" + path
            want.append((i, host, path, f"{host}/" in keys or host + path.rstrip("/") in keys))
        assert got == sorted(want, key=str)


def test_quality_odd_labels(spark):
    docs = spark.createDataFrame([(1, "one line"), (2, None), (None, "x")], "doc_id long, text string")
    for labels in ([(1, 1), (2, 1)], [(1, None), (None, 0)], []):
        model = quality.fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True))
        assert all(0 <= r.score <= 1 for r in quality.score_quality(docs, model).collect())


def test_line_features_against_plain_counts():
    texts = ["A line, with words words.\nAnd 12 more | lines!\n\nA line, with words words.", "", "\u00e9t\u00e9 | \u00e9t\u00e9", "X" * 50]
    x, size, n = quality.line_features([t.encode() for t in texts])
    lines = [line for t in texts for line in t.split("\n")]
    assert n.tolist() == [len(t.split("\n")) for t in texts] and size.tolist() == [max(1, len(line.encode())) for line in lines]
    share = lambda line, kinds: sum(line.count(c) for c in kinds) / max(1, len(line))
    for row, line in zip(x, lines):
        assert np.isclose(row[0], share(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        assert np.isclose(row[1], share(line, "\u00e9")) and np.isclose(row[2], share(line, "0123456789"))
        assert np.isclose(row[6], share(line, "|_/\\")) and np.isclose(row[7], share(line, ".,;:?'\"()-"))
    width = 8 + 8 * len(quality._STEPS)
    assert x[3, width + 5] == 1 and not x[:3, width + 5].any()  # the fourth line repeats the first of its text


def test_quality_is_the_length_weighted_mean_of_marginals():
    rng = np.random.default_rng(8)
    text = "short\na somewhat longer line here\nx"
    x, size, n = quality.line_features([text.encode()])
    model = quality.Chain(rng.normal(size=x.shape[1]) / 5, rng.normal(size=(2, 2)))
    p, total = np.zeros(3), 0.0
    for k in range(8):
        y = [k >> i & 1 for i in range(3)]
        weight = np.exp(sum((x[i] @ model.w) * y[i] for i in range(3)) + sum(model.trans[y[i], y[i + 1]] for i in range(2)))
        total += weight
        p += weight * np.array(y)
    assert np.isclose(model.scores([text.encode()])[0], (p / total * size).sum() / size.sum())


def test_fit_raises_the_likelihood():
    """The fitted chain explains its training labels better than the empty one, and every step's gradient points uphill."""
    texts = [b"good plain words here\nand some more of them", b"### 123 ### 456\n@@@ 99", b"calm sentences, quietly told", b"1 2 3 4 5\n6 7 8 9"] * 5
    labels = np.array([1, 0, 1, 0] * 5)
    model = quality.Chain.fit(texts, labels)
    got = model.scores(texts)
    assert got[labels == 1].min() > 0.8 and got[labels == 0].max() < 0.2
