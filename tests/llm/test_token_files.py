import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import token_files as tf
from corvane.llm import tokens


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=300), st.sampled_from([1, 7, 64, 1 << 14]))
def test_words_round_trip(ids, block):
    words, first = tf.pack_words(np.array(ids, np.uint64), block)
    assert tf.unpack_words(words, first, len(ids), block).tolist() == ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t aB9.,!'é中", max_size=30))
def test_memo_equals_library(text):
    enc = tokens.encoder(tokens.default_path())
    assert enc.encode(text).tolist() == enc.whole(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \n\r\t\x00\x0b\x1c\x85\xa0\u2028\u3000 aB9.,!'#é中\U0001f600", max_size=25)), max_size=6))
def test_many_texts_equal_library(texts):
    enc = tokens.encoder(tokens.default_path())
    ids, counts = enc.encode_many(pa.array(texts, pa.string()))
    assert counts.sum() == len(ids)
    ends = counts.cumsum()
    assert [ids[e - n : e].tolist() for n, e in zip(counts, ends)] == [enc.whole(t) if t else [] for t in texts]


def test_lines_equal_library():
    enc = tokens.Encoder(tokens.default_path())
    text = "One line's end.\nAnother one!\nthird\n\nafter a gap\n indented\nlast\n"
    for t in (text, "plain.\nlines\nonly", "\nstart", "end\n", "a\n", "\n", "x" * 40_000 + "\n" + "y z" * 20_000, "a\x00b\nc d", "tab\t\nx y", "tab\t x\ny"):
        assert enc.encode_many(pa.array([t, None, t]))[0].tolist() == enc.whole(t) * 2


def test_full_memo_equals_library():
    enc = tokens.Encoder(tokens.default_path(), memo_bytes=2000)
    for text in ("one two three four two one", "x" * 100 + " yes", " a b", "", "<|endoftext|> a"):
        assert enc.encode(text).tolist() == (enc.whole(text) if text else [])


def test_token_files(spark, tmp_path):
    rows = [(3, "the cat", "x"), (1, None, "y"), (None, "null id", None), (2, "", "z"), (3, "the cat", "x"), (9, "word " * 5000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    path = str(tmp_path / "t")
    tf.write_token_files(docs, path)
    got = tf.read_token_files(spark, path).collect()
    enc = tokens.encoder(tokens.default_path())
    start, want = 0, []
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*(enc.whole(t) if t else []), 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {(r.doc_id, len(r.ids)) for r in tf.read_token_ids(spark, path).collect()} == {(d, n) for d, _, n, _ in want}


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tf.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path)
    assert tf.read_token_files(spark, path).count() == 0


def test_bad_magic():
    with pytest.raises(ValueError):
        tf.read_segment(b"\0" * 64)
