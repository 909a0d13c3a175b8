"""Token ids of whole texts by the tokenizers library, with a per-worker memo of words bounded in bytes.

A byte-level BPE splits a text into pre-tokens before it merges; between a non-space
character and a single space there is always such a split. So a text may be cut before
each space, and the ids of the pieces, encoded by the library once and remembered,
joined. So is there on both sides of a line break between characters that aren't white
space: there a text is cut too, before the break. Texts with runs of white space, where a
cut could fall inside a pre-token, are encoded whole.

Many texts are encoded together: their words are cut and numbered by Arrow, the different
ones looked up in the memo (an Arrow array too) at once, and those that it doesn't hold go
to the library many at a time, joined by the spaces (or line breaks) that separate them
again in its output. No word that the memo holds becomes a Python object.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space between two white-space characters, or between one and the end: the text is encoded whole.
_WHOLE = re.compile(r"\s (?:\s|\Z)")
#: A line break beside other white space (any that a tokenizer may know): such texts are only cut at spaces.
_SPACES = r"[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_RUN = rf"{_SPACES}\n|\n{_SPACES}"
#: What a word after a line break begins with. Texts that have it are encoded whole.
_BREAK = "\x00"
#: Bytes of words and ids that one Python worker remembers at most, with what an entry needs besides.
MEMO_BYTES, ENTRY_BYTES = 32 << 20, 32
#: Words and characters that are given to the library in one call.
JOIN_WORDS, JOIN_CHARS = 512, 1 << 15
#: Bytes of text that are encoded together.
TEXT_BYTES = 4 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids equal to those of Tokenizer.encode(text, add_special_tokens=False), as int32.

    When the memo is full, the half that was used last stays.
    """

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocab = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocab.values(), default=0) + 1, bool)  # ids whose first byte is a space
        self.spaced[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        line = self.whole("\n")
        self.line = line[0] if len(line) == 1 else -1  # the id of a line break by itself
        self.limit, self.tick = memo_bytes, 0
        self.words = pa.array([], pa.string())  # a space and the word, or see _encode
        self.ids, self.begin, self.length, self.seen = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many(pa.array([text], pa.string()))[0]

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); nulls are empty."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        texts = texts.fill_null("")
        marked = pc.match_substring(texts, _BREAK)
        lines = pc.and_not(pc.invert(pc.match_substring_regex(texts, _RUN)), marked)
        parts = pc.split_pattern(pc.if_else(lines, pc.replace_substring(texts, "\n", " " + _BREAK), texts), " ")
        first = parts.value_lengths().to_numpy().astype(np.int64).cumsum()
        first = np.concatenate([[0], first[:-1]])  # every text has a part at least: what stands before its first space
        coded = parts.flatten().dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        heads, place = np.unique(index[first], return_inverse=True)
        inner = np.ones(len(index), bool)
        inner[first] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[index[inner]] = True
        initial = pc.utf8_slice_codeunits(coded.dictionary, 0, 1).dictionary_encode()
        blank = np.array([not c or c.isspace() for c in initial.dictionary.to_pylist()])[initial.indices.to_numpy()]
        # the keys: words that stand behind a space or a line break, then a space and each head
        behind = pc.binary_join_element_wise("", coded.dictionary.take(pa.array(heads)), " ")
        keys = pa.concat_arrays([coded.dictionary.filter(pa.array(used)), behind])
        number = np.cumsum(used) - 1
        n_keys = len(keys)
        whole_index = index.copy()
        index = number[index]
        index[first] = used.sum() + place
        extra = []
        odd = np.flatnonzero(blank[whole_index[inner]]) if blank.any() else np.zeros(0, int)
        whole = set(np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist())
        if len(odd) or whole:
            owner = np.searchsorted(first, np.flatnonzero(inner)[odd], "right") - 1
            ends = np.append(first[1:], len(index))
            for k in sorted({*owner.tolist(), *whole}):
                text = texts[k].as_py()
                if k in whole or _WHOLE.search(text):
                    index[first[k] : ends[k]] = n_keys  # nothing
                    index[first[k]] = n_keys + 1 + len(extra)
                    extra.append(np.array(self.whole(text), np.int32))
        flat, begin, length = self._pieces(keys)
        flat = np.concatenate([flat, *extra])
        length = np.concatenate([length, [0], np.array([len(x) for x in extra], np.int64)])
        sizes = np.array([len(x) for x in extra], np.int64)
        begin = np.concatenate([begin, [0], len(flat) - sizes.sum() + np.cumsum(sizes) - sizes])
        n = length[index]
        end = np.cumsum(n)
        ids = flat[np.repeat(begin[index] - end + n, n) + np.arange(end[-1])]
        return ids, np.add.reduceat(n, first)

    def _pieces(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each key's begin in them, how many they are)."""
        self.tick += 1
        slot = pc.fill_null(pc.index_in(keys, value_set=self.words), -1).to_numpy().astype(np.int64)
        hit, miss = np.flatnonzero(slot >= 0), np.flatnonzero(slot < 0)
        self.seen[slot[hit]] = self.tick
        new = keys.take(pa.array(miss))
        ids, begin, length = self._encode(new.to_numpy(zero_copy_only=False).tolist())
        flat = np.concatenate([self.ids, ids])
        begins, lengths = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        begins[hit], lengths[hit] = self.begin[slot[hit]], self.length[slot[hit]]
        begins[miss], lengths[miss] = begin + len(self.ids), length
        self.words = pa.concat_arrays([self.words, new])
        self.ids, self.begin, self.length = flat, np.concatenate([self.begin, begin + len(self.ids)]), np.concatenate([self.length, length])
        self.seen = np.concatenate([self.seen, np.full(len(new), self.tick)])
        if self._size() > self.limit:
            self._trim()
        return flat, begins, lengths

    def _size(self) -> int:
        return 4 * len(self.ids) + ENTRY_BYTES * len(self.words) + int(pc.sum(pc.binary_length(self.words)).as_py() or 0)

    def _trim(self) -> None:
        """Forget the half (by bytes) that was used longest ago."""
        cost = np.cumsum((4 * self.length + ENTRY_BYTES + pc.binary_length(self.words).to_numpy())[order := np.argsort(-self.seen, kind="stable")])
        keep = np.sort(order[: np.searchsorted(cost, self.limit // 2)])
        n = self.length[keep]
        end = np.cumsum(n)
        at = np.repeat(self.begin[keep] - end + n, n) + np.arange(end[-1] if len(end) else 0)
        self.words, self.ids, self.begin, self.length, self.seen = self.words.take(pa.array(keep)), self.ids[at], end - n, n, self.seen[keep]

    def _encode(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, lengths) of keys by the library: a space and the key; of a key that begins with a space, what follows it; of one that begins with _BREAK, a line break and what follows. None for a space."""
        words, lines, single = [], [], []
        for i, k in enumerate(keys):
            if k[:1] == _BREAK and self.line >= 0 and len(k) > 1 and not k[-1].isspace():
                lines.append(i)
            elif k and k[0] != _BREAK and not k[0].isspace():
                words.append(i)
            else:
                single.append(i)
        out, length = [], np.zeros(len(keys), np.int64)
        for places, cut, lead in ((words, 0, " "), (lines, 1, "\n")):
            start = 0
            while start < len(places):
                stop, chars = start, 0
                for i in places[start : start + JOIN_WORDS]:
                    stop, chars = stop + 1, chars + len(keys[i])
                    if chars >= JOIN_CHARS:
                        break
                group = places[start:stop]
                ids, n = self._joined([keys[i][cut:] for i in group], lead)
                out.append(ids)
                length[group] = n
                start = stop
        for i in single:
            k = keys[i]
            ids = np.array(self.whole("\n" + k[1:] if k[:1] == _BREAK else k[1:] if k[:1] == " " else " " + k) if k != " " else [], np.int32)
            out.append(ids)
            length[i] = len(ids)
        order = np.array([*words, *lines, *single], np.int64)
        begin = np.zeros(len(keys), np.int64)
        begin[order] = np.cumsum(length[order]) - length[order]
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), begin, length

    def _joined(self, words: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.whole(lead + lead.join(words)), np.int32)
        cuts = np.flatnonzero(self.spaced[ids] if lead == " " else ids == self.line)
        if len(cuts) == len(words) and not cuts[0]:
            return ids, np.diff(np.append(cuts, len(ids)))
        each = [np.array(self.whole(lead + w), np.int32) for w in words]  # not a byte-level BPE: one by one
        return np.concatenate(each), np.array([len(x) for x in each])


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, memo_bytes: int = MEMO_BYTES) -> Encoder:
    """The encoder of this worker process; workers are reused from task to task, and only the last encoder is kept."""
    if (path, memo_bytes) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, memo_bytes] = Encoder(path, memo_bytes)
    return _ENCODERS[path, memo_bytes]


def forget() -> None:
    """Let this worker's encoder go: tokenizer and words."""
    _ENCODERS.clear()
