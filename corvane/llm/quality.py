"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

Line features are shares of character classes, lengths and repetition; the features of
the line before and after are used too. Each labelled training document gives its label
to all its lines. A document's quality is the average of its lines' forward-backward
marginals for "good", weighted by line length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corvane.llm.common import by_bytes, fresh, trimmed

#: Labelled rows that the model is fitted on at most, chosen by a hash of doc_id.
TRAIN_ROWS = 4000
THRESHOLD = 0.3
CHUNK_BYTES = 1 << 20

_UPPER, _LOWER, _HIGH, _DIGIT, _SPACE, _SYMBOL, _SHOUT, _BAR, _STOP, _CONT, _N = range(11)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[192:], _CLASS[128:192], _CLASS[48:58] = _UPPER, _LOWER, _HIGH, _CONT, _DIGIT
_CLASS[[9, 10, 13, 32]], _CLASS[[33]], _CLASS[[124, 95, 47, 92]], _CLASS[[ord(c) for c in ".,;:?'\"()-"]] = _SPACE, _SHOUT, _BAR, _STOP
_STEPS = (0.01, 0.05, 0.15, 0.4)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, length of each line in bytes, number of lines of each text)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n_lines = np.array([t.count(b"\n") + 1 for t in texts])
    kinds = _CLASS[data]
    counts = np.stack([np.add.reduceat(kinds == k, starts, dtype=np.int32) for k in range(_N)], 1).astype(np.float64)
    counts[:, _SPACE] -= 1  # the line's own end
    size = (ends - starts).astype(np.float64)
    chars = np.maximum(size - counts[:, _CONT], 1)
    shares = counts[:, [_UPPER, _HIGH, _DIGIT, _SPACE, _SYMBOL, _SHOUT, _BAR, _STOP]] / chars[:, None]
    gaps = kinds == _SPACE
    words = np.add.reduceat(gaps[1:] & ~gaps[:-1], np.minimum(starts, max(len(data) - 2, 0)), dtype=np.int32) if len(data) > 1 else np.zeros(len(starts))
    length = chars / np.maximum(words, 1)
    heads = np.flatnonzero(~gaps & np.concatenate([[True], gaps[:-1]]))  # word starts
    stutter = np.zeros(len(data), bool)  # 1 where a word has the bytes of the word before it
    if len(heads) > 1:
        total, span = np.add.reduceat(data, heads, dtype=np.int64), np.diff(np.append(heads, len(data)))
        stutter[heads[1:]] = (total[1:] == total[:-1]) & (span[1:] == span[:-1])
    repeats = np.add.reduceat(stutter, starts, dtype=np.int32) / np.maximum(words, 1)
    seen: dict[bytes, int] = {}
    again, at = np.zeros(len(starts)), 0
    for t in texts:
        lines = t.split(b"\n")
        if len(lines) > 1:
            seen.clear()
            for i, x in enumerate(lines):
                again[at + i] = x in seen and len(x) > 0
                seen[x] = i
        at += len(lines)
    cols = [shares, *[(shares > s).astype(np.float64) for s in _STEPS]]
    own = np.column_stack([*cols, np.log1p(chars) / 8, chars < 20, chars > 1000, np.minimum(length, 30) / 10, length > 12, again, repeats, repeats > 0.1, repeats > 0.4])
    near = np.column_stack([shares, chars < 20, again, repeats, repeats > 0.1])
    first = np.concatenate([[0], np.cumsum(n_lines)[:-1]])
    before, after = np.roll(near, 1, 0), np.roll(near, -1, 0)
    before[first], after[first + n_lines - 1] = 0, 0
    edge = np.zeros((len(own), 2))
    edge[first, 0], edge[first + n_lines - 1, 1] = 1, 1
    return np.column_stack([own, before, after, edge, np.ones(len(own))]), np.maximum(size, 1), n_lines


class Chain:
    """Binary linear chain over many documents at once: node scores w.x for label 1, a 2x2 transition table."""

    def __init__(self, w: np.ndarray, trans: np.ndarray):
        self.w, self.trans = w, trans

    def marginals(self, x: np.ndarray, n_lines: np.ndarray, pairs: bool = False):
        """P(label 1) of each line; with pairs also the expected transitions, summed."""
        node = np.stack([np.ones(len(x)), np.exp(np.clip(x @ self.w, -30, 30))], 1)
        t = np.exp(self.trans)
        order = np.argsort(-n_lines, kind="stable")
        n, first = n_lines[order], (np.cumsum(n_lines) - n_lines)[order]
        alpha, beta = np.empty_like(node), np.empty_like(node)
        a = node[first]
        alpha[first] = a / a.sum(1, keepdims=True)
        live = [int(np.searchsorted(-n, -k, "left")) for k in range(int(n[0]))]  # documents with more than k lines
        for k in range(1, len(live)):
            at = first[: live[k]] + k
            a = (alpha[at - 1] @ t) * node[at]
            alpha[at] = a / a.sum(1, keepdims=True)
        beta[first + n - 1] = 0.5
        for k in range(len(live) - 2, -1, -1):
            at = first[: live[k + 1]] + k
            b = (beta[at + 1] * node[at + 1]) @ t.T
            beta[at] = b / b.sum(1, keepdims=True)
        both = alpha * beta
        p = both[:, 1] / both.sum(1)
        if not pairs:
            return p
        inner = np.setdiff1d(np.arange(len(x)), first)
        joint = alpha[inner - 1][:, :, None] * t * (node * beta)[inner][:, None, :]
        return p, (joint / joint.sum((1, 2), keepdims=True)).sum(0) if len(inner) else np.zeros((2, 2))

    @staticmethod
    def fit(texts: list[bytes], labels: np.ndarray, rounds: int = 150, l2: float = 1.0) -> "Chain":
        """Penalised likelihood by Adam; without both labels, the constant share of label 1."""
        if not texts:
            return Chain(np.zeros(line_features([b""])[0].shape[1]), np.zeros((2, 2)))
        x, _, n = line_features(texts)
        y = np.repeat(labels, n).astype(np.float64)
        weight = np.repeat(1 / n, n)  # every document counts once
        seen = np.zeros((2, 2))
        inner = np.ones(len(x), bool)
        inner[np.cumsum(n) - n] = False
        np.add.at(seen, (y[np.flatnonzero(inner) - 1].astype(int), y[inner].astype(int)), 1)
        model, docs = Chain(np.zeros(x.shape[1]), np.zeros((2, 2))), len(texts)
        theta, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
        for i in range(1, rounds + 1):
            p, pairs = model.marginals(x, n, True)
            g = np.concatenate([x.T @ ((y - p) * weight), (seen - pairs).ravel() / max(1, inner.sum()) * docs * 0.05]) - l2 * np.append(theta[:-4] * (np.arange(x.shape[1]) < x.shape[1] - 1), theta[-4:] * docs * 0.01)
            g /= docs
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
            model = Chain(theta[:-4], theta[-4:].reshape(2, 2))
        return model

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted share of good lines of each text."""
        if not texts:
            return np.zeros(0)
        x, size, n = line_features(texts)
        p = self.marginals(x, n)
        first = np.cumsum(n) - n
        return np.clip(np.add.reduceat(p * size, first) / np.add.reduceat(size, first), 0, 1)


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def training_rows(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, limit: int) -> list:
    """At most limit labelled (text, label), chosen by a hash of doc_id; allowed is a condition on doc_id."""
    picked = labels.select("doc_id", F.col(label).alias("label")).where(allowed & F.col("label").isNotNull() & F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label").orderBy(F.xxhash64("doc_id"), "doc_id", "text", "label").limit(limit).collect()  # limit rows at most


def fit_quality(docs: DataFrame, labels: DataFrame, allowed: Column, train_rows: int = TRAIN_ROWS) -> Chain:
    """A chain learned from at most train_rows rows of docs with a label `quality`; null labels and doc_ids are left out. One class of labels gives a chain that leans to it, none scores everything 0.5."""
    rows = training_rows(docs, labels, "quality", allowed, train_rows)
    return Chain.fit([r.text.encode() for r in rows], np.array([int(r.label) for r in rows]))


def with_score(docs: DataFrame, score_of, name: str = "score") -> DataFrame:
    """docs, all columns, and a double column name: score_of(list of UTF-8 texts) of its text column, whole texts, null as empty. Where docs has a column of that name, the new one has an underscore before it."""
    names, name = docs.columns, fresh(docs, name)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches):
        for b in by_bytes(batches, "text", CHUNK_BYTES):
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score_of(texts), pa.float64())], names=[*names, name])

    return docs.mapInArrow(trimmed(run), schema)


def score_quality(docs: DataFrame, model: Chain) -> DataFrame:
    """docs with score (0 to 1). Null and empty texts are one empty line; repeated rows score alike; an empty table stays empty; beside a column score of docs' own it is _score."""
    return with_score(docs, model.scores)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document of `documents`, learned from `labels` outside the held-out fold."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels, fold(F.col("doc_id"), 5) != 0)
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return score_quality(docs.select("doc_id", "text"), model).select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
