"""The near-duplicate stage by brute force at its own rule: 5-word shingles, similarity 0.8 or more."""

import random

import corpus_pipeline
from corvane.llm import near_dedup


def survivors(rows, words=5, share=80):
    sets = {d: near_dedup.shingle_set(t, words) for d, t in rows}
    comp = {k: k for k in sets}

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= share * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return [k for k in ids if root(k) == k]


def test_stage_by_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    long = [word() for _ in range(240)]
    rows = [(0, " ".join(long[:200])), (1, " ".join(long))]  # 196 of 236 shingles of 5 words, 198 of 238 of 3 words
    base = [[word() for _ in range(n)] for n in (4, 40, 120, 200)]
    for i in range(2, 160):
        w = list(base[i % 4])
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w + [word() for _ in range(rng.choice([0, 10, 25, 40]))])))
    docs = spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == survivors(rows) and 1 not in kept
    assert kept != survivors(rows, 3, 85)
