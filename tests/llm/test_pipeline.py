"""Each pipeline stage on the smallest tables against a plain version of it, and the registered queries."""

from collections import defaultdict

import numpy as np
from test_filters import LOWER, WORD
from test_near_stage import survivors

import __spark_entry__
import corpus_pipeline
from corvane.llm import queries, quality, tokens

SF = "/root/testdata/sf0.001"


def contaminated(text, windows):
    w = WORD.findall((text or "").translate(LOWER))
    hit = set()
    for size, grams in windows.items():
        for j in range(len(w) - size + 1):
            if tuple(w[j : j + size]) in grams:
                hit |= set(range(j, j + size))
    return bool(hit) and 20 * len(hit) >= len(w)


def cut(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        t = (t or "").encode()
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                mask[i : i + length] = b"\1" * length
            seen.add(w)
        out[d] = bytes(c for c, m in zip(t, mask) if not m).decode("utf-8", "ignore")
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = list(docs.columns)
    states = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, states[-1], SF).write.parquet(str(tmp_path / name))
        states.append(spark.read.parquet(str(tmp_path / name)))
    texts = [{r.doc_id: r.text for r in s.collect()} for s in states[:-1]]
    assert all(sorted(s.columns) == sorted(columns) for s in states[1:-1])
    model = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"), quality.fold(quality.F.col("doc_id"), 5) != 0)
    ids = sorted(texts[0])
    score = model.scores([texts[0][i].encode() for i in ids])
    assert texts[1] == {i: texts[0][i] for i, s in zip(ids, score) if s >= quality.THRESHOLD} and len(texts[1]) > 150
    assert sorted(texts[2]) == survivors(texts[1].items())
    assert texts[3] == cut(texts[2].items())
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        v = WORD.findall(r.text.translate(LOWER))
        size = min(13, len(v))
        windows[size] |= {tuple(v[i : i + size]) for i in range(len(v) - size + 1)}
    assert texts[4] == {d: t for d, t in texts[3].items() if not contaminated(t, windows)}
    enc = tokens.encoder(tokens.default_path())
    pieces = defaultdict(dict)
    for r in states[-1].collect():
        pieces[r.doc_id][r.start] = r.ids
    got = {d: [x for s in sorted(p) for x in p[s]] for d, p in pieces.items()}
    assert got == {d: [*(enc.whole(t) if t else []), 1] for d, t in texts[4].items()}


def test_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names and set(queries.oracle_sql()) <= set(queries.queries())
    assert np.all([callable(f) for f in __spark_entry__.queries().values()])


def test_odd_rows_through_the_stages(spark, tmp_path):
    """Nulls, empty and repeated rows, an empty table, and columns that aren't those of documents."""
    text = " ".join(f"This is sentence number {i} of a long and quiet story." for i in range(40))
    rows = [(1, text, None, "a", None), (1, text, None, "a", None), (None, "Another plain story about something else entirely, told at length.", "en", None, 5), (3, None, "en", "b", 0), (4, "", "de", "b", 0), (5, text + " And a little more.", "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = docs.withColumns({c: corpus_pipeline.F.lit(1) for c in ("k", "spans", "near_key", "bad_id", "number", "open")})
    for table in (docs, extra, docs.limit(0)):
        state = table
        for name, stage in corpus_pipeline.STAGES[1:]:
            path = str(tmp_path / f"{name}-{len(table.columns)}-{table.count()}")
            stage(spark, state, SF).write.parquet(path)
            state = spark.read.parquet(path)
        assert state.count() == 0 if table.count() == 0 else {r.doc_id for r in state.collect()} == {1, None, 3, 4}
