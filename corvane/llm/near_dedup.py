"""MinHash near-dedup: a multi-index Hamming join over b-bit signatures, confirmed on full shingle sets.

A signature has COMPONENTS min-hashes of B bits. It is split into CHUNKS chunks; by the
pigeonhole principle two signatures that differ in at most CHUNKS * (ERRORS + 1) - 1
components agree in some chunk up to ERRORS components. All patterns of ERRORS components
left out of a chunk are enumerated, so every such pair shares an index key.

Texts with equal shingle sets form one class; joins are between class representatives.
Members of a key are not paired with each other:

1. each representative is compared with one leader (the least of its keys' least
   members), which links most of a group;
2. in keys whose members are still in several components, each is compared with the
   reference of its key, the least id of the component that most of them are in;
3. keys that are mixed even then give the pairs across components that can be links: two
   members share at most the reference's shingles that both have (a bit set of each) and
   as many others as the one with fewer has, those of its own (in a large key: that no
   other member of any has) not counted. Heavily edited copies in a large group, each
   edited elsewhere, drop out by that without being compared.

Every pair that shares a key then is in one component, or has been compared, or cannot
be a link. Pairs are compared on the exact word shingles of their whole texts.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import by_bytes, fresh, let, lower_ascii, numbered, stored, trimmed

WORDS, SHARE = 3, 85
CHUNKS, WIDTH, ERRORS, BITS = 8, 6, 1, 16
COMPONENTS = CHUNKS * WIDTH
#: Members of a mixed key from which the shingles that only one document has are counted.
LARGE = 16
#: Members of a mixed key for each tile that its candidates are dealt out in.
TILE = 1024
#: Rows of (id) that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Bytes of hashes, and of the texts of pairs, that a worker handles at once.
HASH_BYTES, PAIR_BYTES = 4 << 20, 4 << 20
_SPACE = r"[\x20\x09-\x0D]+"
_RNG = np.random.default_rng(20240611)
_FACTORS = _RNG.integers(1, 1 << 63, COMPONENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _keys(chunks: int, width: int) -> list[tuple[int, ...]]:
    """The components of each index key."""
    return [tuple(c * width + i for i in range(width) if i not in out) for c in range(chunks) for out in combinations(range(width), ERRORS)]


def _words(text: Column) -> Column:
    return F.split(lower_ascii(F.coalesce(text, F.lit(""))), _SPACE)


def shingle_hashes(text: Column, n: int = WORDS) -> Column:
    """64-bit hashes of the n-word shingles, with repeats; of fewer words, one of the whole sequence."""

    def inner(w: Column) -> Column:
        head = F.when(F.element_at(w, 1) == "", 1).otherwise(0)
        tail = F.when((F.element_at(w, -1) == "") & (F.size(w) > 1), 1).otherwise(0)
        return F.slice(w, head + 1, F.size(w) - head - tail)

    def shingles(w: Column) -> Column:
        every = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, n)]))
        return F.when(F.size(w) < n, F.slice(every, 1, 1)).otherwise(F.slice(every, 1, F.greatest(F.size(w) - n + 1, F.lit(0))))

    return let(let(_words(text), inner), shingles)


def shingle_set(text: str | None, n: int = WORDS) -> set[str]:
    """The exact shingles, words joined by one space."""
    w = [x for x in _split(text or "") if x]
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BREAKS = str.maketrans("\t\n\v\f\r", "     ")


def _split(text: str) -> list[str]:
    return text.translate(_LOWER).translate(_BREAKS).split(" ")


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def index_keys(sets: list[np.ndarray], chunks: int = CHUNKS, width: int = WIDTH) -> np.ndarray:
    """(len(sets), len(_keys(chunks, width))) index keys of non-empty sets of uint64 hashes; at most COMPONENTS components."""
    every = _keys(chunks, width)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    parts = np.stack([_mix(np.minimum.reduceat(flat * f, starts)) & np.uint64((1 << BITS) - 1) for f in _FACTORS[: chunks * width]], 1)
    out = np.empty((len(sets), len(every)), np.uint64)
    for j, components in enumerate(every):
        key = np.full(len(sets), j + 1, np.uint64)
        for c in components:
            key = _mix(key * np.uint64(1 << BITS | 1) + parts[:, c])
        out[:, j] = key
    return out


def signatures(docs: DataFrame, words: int = WORDS, chunks: int = CHUNKS, width: int = WIDTH) -> DataFrame:
    """k, d0, d1 (digest of the shingle set), n (its size), keys, for each row."""
    n_keys = len(_keys(chunks, width))

    def run(batches):
        for b in by_bytes(batches, "h", HASH_BYTES):
            col = b.column("h")
            offsets, values = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False).view(np.uint64)
            sets = [np.unique(values[i:j]) for i, j in zip(offsets[:-1], offsets[1:])]
            n = np.array([len(s) for s in sets], np.int64)
            sums = np.array([(int(_mix(s).sum()), int(_mix(s ^ np.uint64(0x5DEECE66D)).sum())) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            full = [s for s in sets if len(s)]
            keys = index_keys(full, chunks, width).view(np.int64) if full else np.zeros((0, n_keys), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * n_keys)]), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array(n), lists], names=["k", "d0", "d1", "n", "keys"])

    return docs.select("k", shingle_hashes(F.col("text"), words).alias("h")).mapInArrow(trimmed(run), "k long, d0 long, d1 long, n long, keys array<long>")


def _compared(pairs: DataFrame, texts: DataFrame, words: int, share: int) -> DataFrame:
    """(a, b) compared on their exact shingle sets: linked, rest (shingles of a that b lacks) and shared (a bit for each shingle of b, in sorted order: whether a has it)."""

    def run(batches):
        last, held, order = None, set(), {}
        for x in by_bytes(batches, ("ta", "tb"), PAIR_BYTES):
            linked, rest, shared = [], [], []
            for a, b in zip(x.column("ta"), x.column("tb").to_pylist()):
                if b != last:
                    last, held = b, shingle_set(b, words)
                    order = {s: i for i, s in enumerate(sorted(held))}
                s = shingle_set(a.as_py(), words)
                both = s & held
                bits = np.zeros(-(-len(held) // 64) * 64, bool)
                bits[[order[g] for g in both]] = True
                linked.append(100 * len(both) >= share * (len(s) + len(held) - len(both)) and bool(both))
                rest.append(len(s) - len(both))
                shared.append(np.packbits(bits).view(np.int64))
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), pa.array(linked, pa.bool_()), pa.array(rest, pa.int64()), pa.array(shared, pa.list_(pa.int64()))], names=["a", "b", "linked", "rest", "shared"])

    joined = pairs.join(texts.select(F.col("k").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("k").alias("b"), F.col("text").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(trimmed(run), "a long, b long, linked boolean, rest long, shared array<long>")


def components(edges: DataFrame) -> DataFrame:
    """k, comp (least id reachable) for every node of edges (a, b): roots hook to smaller ones, then paths are halved.

    Every round writes its table to the shared folder; nothing is collected but counts.
    """
    edges = stored(edges.where("a <> b").distinct(), "edges")
    parent = stored(edges.select(F.col("a").alias("k")).union(edges.select("b")).distinct().withColumn("comp", F.col("k")), "parent")
    while True:
        pa_, pb = parent.select(F.col("k").alias("a"), F.col("comp").alias("ca")), parent.select(F.col("k").alias("b"), F.col("comp").alias("cb"))
        open_ = edges.join(pa_, "a").join(pb, "b").where("ca <> cb")
        hooks = stored(open_.select(F.greatest("ca", "cb").alias("root"), F.least("ca", "cb").alias("to")).groupBy("root").agg(F.min("to").alias("to")), "hooks")
        if not hooks.take(1):
            return parent
        while True:  # roots' chains, shortened until each points at a root
            nxt = hooks.select(F.col("root").alias("to"), F.col("to").alias("further"))
            if not hooks.join(nxt, "to").take(1):
                break
            hooks = stored(hooks.join(nxt, "to", "left").select("root", F.coalesce("further", "to").alias("to")), "hooks")
        parent = stored(parent.join(hooks, parent["comp"] == hooks["root"], "left").select("k", F.coalesce("to", "comp").alias("comp")), "parent")


def _picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """k, text of the documents in ids: their ids are broadcast if they are few enough, else both sides are shuffled."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "k", "left_semi")


def _mixed(placed: DataFrame) -> DataFrame:
    """key, main, total of the keys in several components: the component with most members of the key, and its members."""
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("size"))
    return sizes.groupBy("key").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("size").alias("total")).where("comps > 1").select("key", "main", "total")


def _candidates(open_: DataFrame, share: int) -> DataFrame:
    """(a, b) of the members (key, k, n, comp, main, total, rest, shared) of mixed keys, of different components, that may be linked.

    Linked texts have sizes of the same band or the next one, so members meet by (key,
    band); the members outside of a key's main component are dealt out over its tiles,
    one for each TILE members, so that no task has a whole key.
    """
    width = max(math.log(100 / share), 1e-6) * 1.001  # a little more, for the logarithms' last bits
    tiles = F.ceil(F.col("total") / TILE).cast("int")
    rows = open_.withColumns({"band": F.floor(F.log("n") / width), "tiles": tiles})
    side = lambda x: [F.col("k").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "comp", "rest", "shared")]]
    left = rows.where("comp <> main").select("key", "band", F.pmod(F.xxhash64("k"), "tiles").cast("int").alias("tile"), *side("a"))
    right = rows.withColumn("near", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    right = right.select("key", F.col("near").alias("band"), "tile", "main", *side("b"))
    most = F.aggregate(F.zip_with("a_shared", "b_shared", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x) + F.least("a_rest", "b_rest")
    new = F.expr(f"a_comp <> b_comp and (b_comp = main or a < b) and {100 + share} * least(a_n, b_n) >= {share} * (a_n + b_n)")
    same = (left["key"] == right["key"]) & (left["band"] == right["band"]) & (left["tile"] == right["tile"])
    return left.join(right, same & new & ((100 + share) * most >= share * (F.col("a_n") + F.col("b_n"))))


def near_components(docs: DataFrame, words: int = WORDS, share: int = SHARE, chunks: int = CHUNKS, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text; others are ignored).

    Texts are linked that share at least `share` percent of their shingles of `words` words.
    A pair of similarity s shares no key with a probability of (1 - s^w - w s^(w-1) (1-s))^chunks,
    w being the width, so smaller shares need more or narrower chunks.

    Texts without words (null, empty, white space) are linked with nothing. A null doc_id
    is the smallest. Rows with an equal doc_id and text are one document, repeated rows get
    equal results; rows with an equal doc_id and other texts, or null ones, are others.
    """
    rows, table = numbered(docs.select("doc_id", "text"), "k")
    out = _placed(rows, words, share, chunks, width)
    kept = (F.col("k") == F.col("comp")).alias("kept")
    if table is None:
        return out.select(F.col("k").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), kept)
    out = out.join(table, "k").join(table.select(F.col("k").alias("comp"), F.col("doc_id").alias("component_id")), "comp")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept)


def _placed(docs: DataFrame, words: int, share: int, chunks: int, width: int) -> DataFrame:
    """k, n, comp (least k of its component) for each row of docs (k, text)."""
    sig = stored(signatures(docs, words, chunks, width), "signatures")
    classes = stored(sig.where("n > 0").groupBy("d0", "d1").agg(F.min("k").alias("rep")), "classes")
    reps = sig.join(classes, (sig["k"] == classes["rep"]) & (sig["d0"] == classes["d0"]) & (sig["d1"] == classes["d1"]), "left_semi")
    entries = reps.select("k", "n", F.explode_outer("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.min("k").alias("leader"), F.max("k").alias("last")).where("leader < last").drop("last")
    index = stored(entries.join(shared, "key"), "index")
    texts = stored(_picked(docs, index.select("k").distinct()).dropDuplicates(["k"]), "texts")
    told = stored(_compared(index.where("k <> leader").groupBy(F.col("k").alias("a")).agg(F.min("leader").alias("b")), texts, words, share), "compared")
    first = told.where("linked").select("a", "b")
    one = components(first)
    mixed = _mixed(index.join(one, "k", "left").withColumn("comp", F.coalesce("comp", "k")))
    mixed = stored(mixed.select("key", F.col("main").alias("ref")), "mixed")
    to_ref = index.join(mixed, "key").where("k <> ref").select(F.col("k").alias("a"), F.col("ref").alias("b")).distinct().join(told, ["a", "b"], "left_anti")
    told = told.unionAll(stored(_compared(to_ref, texts, words, share), "compared"))
    links = told.where("linked").select("a", "b")
    placed = index.join(mixed, "key").join(components(links), "k", "left").select("key", "ref", "k", "n", F.coalesce("comp", "k").alias("comp"))
    known = told.select(F.col("a").alias("k"), F.col("b").alias("ref"), "rest", "shared")
    open_ = stored(placed.join(_mixed(placed), "key").where("k <> ref").join(known, ["k", "ref"]), "open")
    large = open_.where(f"total > {LARGE}").select("k").unionAll(open_.where(f"total > {LARGE}").select("ref")).distinct()
    tokens = texts.join(large, "k", "left_semi").select("k", F.explode_outer(F.array_distinct(shingle_hashes(F.col("text"), words))).alias("h"))
    alone = tokens.groupBy("h").agg(F.count("*").alias("c"), F.min("k").alias("k")).where("c = 1").groupBy("k").agg(F.count("*").alias("own"))
    open_ = open_.join(alone, "k", "left").withColumn("rest", F.col("rest") - F.when(F.col("total") > LARGE, F.coalesce("own", F.lit(0))).otherwise(0))
    across = _candidates(open_, share)
    second = _compared(across.select("a", "b").distinct(), texts, words, share).where("linked").select("a", "b")
    two = components(links.unionAll(second))
    out = sig.select("k", "d0", "d1", "n").join(classes, ["d0", "d1"], "left").withColumn("rep", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("k")))
    return out.join(two.select(F.col("k").alias("rep"), "comp"), "rep", "left").select("k", "n", F.coalesce("comp", "rep").alias("comp"))


def near_dedup(docs: DataFrame, words: int = WORDS, share: int = SHARE, chunks: int = CHUNKS, width: int = WIDTH) -> DataFrame:
    """The rows of docs without the near-duplicates of a document with a smaller doc_id; repeated rows leave one. The parameters are those of near_components."""
    key, gone_key = fresh(docs, "near_key"), fresh(docs, "near_gone")
    rows, _ = numbered(docs, key)
    placed = _placed(rows.select(F.col(key).alias("k"), "text"), words, share, chunks, width)
    result = stored(placed.select(F.col("k").alias(gone_key), (F.col("k") == F.col("comp")).alias("kept")), "near")
    gone = result.where("not kept").select(gone_key)
    rest = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, F.col(key) == F.col(gone_key), "left_anti")
    if result.where("kept").groupBy(gone_key).count().where("count > 1").take(1):
        rest = rest.dropDuplicates([key])
    return rest.select(*docs.columns)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates among all of `documents`."""
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SPLIT_SQL = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
OP9_SQL = f"""
with recursive w as (select doc_id, {_SPLIT_SQL} as w from documents),
s as (select doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')))) as g from w where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
e as (select a, b from l union select b, a from l),
r as (select doc_id as d, doc_id as c from documents union select e.b, r.c from r join e on r.d = e.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(r.c) as component_id, d.doc_id = min(r.c) as kept
from documents d left join n using (doc_id) join r on r.d = d.doc_id group by d.doc_id, n.n
"""
