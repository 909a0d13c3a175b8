"""Document fingerprints by winnowing over characters, in DataFrame functions only.

Every run of k code points has a rolling hash of the gear kind: the 64-bit hashes of its
characters, each shifted by the number of those behind it, xor-ed; the next one is the
last, shifted by one, with a character less and one more. That of 2m characters is that of
the first m, shifted by m, xor that of the next m, so k characters take log(k) steps for
all positions at once. Of every w consecutive hashes the least is chosen (all 64 bits
count), the rightmost one in ties, and its position kept: any run of w + k - 1 characters
that two texts share gives both the same chosen hash at the same place of the run. Texts
with fewer hashes than w are one window, texts with fewer than k characters are one k-gram.

The edited text shares its beginning with its document and its end with the next one, so
its fingerprint is put together from theirs: a chosen hash whose first window lies within
the shared part is chosen there too, and only the windows across the seam are computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import let, n_partitions, range_bounds, range_index

#: k and w are powers of two.
K, W = 16, 32


def _powers(n: int) -> list[int]:
    """1, 2, 4 ... n / 2."""
    if n < 1 or n & (n - 1):
        raise ValueError("k and w must be powers of two")
    return [1 << i for i in range(n.bit_length() - 1)]


def gram_hashes(text: Column, k: int = K) -> Column:
    """array<long>: the rolling hash of each run of k code points; of a shorter text, one of its characters; none of an empty one."""
    if k > 32:
        raise ValueError("k is at most 32: more would be shifted out")

    def doubled(m: int):
        # a null where the run would pass the end
        return lambda h: F.transform(h, lambda x, i: F.shiftleft(x, m).bitwiseXOR(F.get(h, i + m)))

    out = F.transform(F.split(text, ""), lambda c: F.xxhash64(c))
    for m in _powers(k):
        out = let(out, doubled(m))
    size = F.char_length(text)
    return F.when(size >= k, F.slice(out, 1, F.greatest(size - k + 1, F.lit(1)))).when(size > 0, F.array(F.xxhash64(text))).otherwise(F.array().cast("array<long>"))


def _places(h: Column, w: int) -> Column:
    """array<int>, ascending: every position of h that any window may choose, and only some others; h is not empty.

    A window holds a whole block of w / 2 positions: that of a position in it, the one
    before or the one behind. So a position is left out if its hash is larger than the least of each.
    """
    b = w // 2
    if b < 2:
        return F.sequence(F.lit(0), F.size(h) - 1)
    least = F.transform(F.sequence(F.lit(0), F.floor((F.size(h) - 1) / b).cast("int")), lambda j: F.array_min(F.slice(h, j * b + 1, F.lit(b))))

    def kept(m: Column):
        def block(x: Column, j: Column) -> Column:
            rows = F.sequence(j * b, F.least(j * b + b, F.size(h)) - 1)
            return let(F.greatest(F.get(m, j - 1), x, F.get(m, j + 1)), lambda most: F.filter(rows, lambda i: F.get(h, i) <= most))

        return F.flatten(F.transform(m, block))

    return let(least, kept)


def winnowed(h: Column, w: int = W) -> Column:
    """chosen() of an array<long> of hashes, which is used often: bind it with let.

    A position is chosen if a window holds it but neither the nearest smaller hash before
    it nor the nearest one behind it that is no larger: if the window behind the former
    doesn't start later than that which ends before the latter. Both are looked for among
    _places only, as a window's least hash is always there.
    """
    _powers(w)

    def among(p: Column, v: Column) -> Column:
        def entry(x: Column, j: Column) -> Column:
            taken = F.struct(x.alias("hash"), F.get(p, j).alias("pos"))
            if w == 1:
                return taken
            first = last = F
            for i in range(1, w):  # so many steps reach as far as any window with x
                first = first.when(F.get(v, j - i) < x, F.get(p, j - i) + 1)
                last = last.when(F.get(v, j + i) <= x, F.get(p, j + i) - w)
            return F.when(first.otherwise(0) <= last.otherwise(F.greatest(F.size(h) - w, F.lit(0))), taken)

        return F.filter(F.transform(v, entry), lambda e: e.isNotNull())

    some = let(_places(h, w), lambda p: let(F.transform(p, lambda a: F.get(h, a)), lambda v: among(p, v)))
    return F.when(F.size(h) > 0, some).otherwise(F.array().cast("array<struct<hash:bigint,pos:int>>"))


def chosen(text: Column, k: int = K, w: int = W) -> Column:
    """array<struct<hash long, pos int>>: the chosen hashes in order of position; empty for an empty text."""
    return let(gram_hashes(text, k), lambda h: winnowed(h, w))


def _up_to(fp: Column, start: Column, w: int) -> Column:
    """Of chosen(), what the window at start and those before it choose; start is that of a whole window."""
    inside = F.filter(fp, lambda x: (x["pos"] >= start) & (x["pos"] < start + w))
    # its own choice is the least of those it holds, the rightmost one in ties
    own = F.array_min(F.transform(inside, lambda x: F.struct(x["hash"].alias("hash"), (-x["pos"]).alias("behind"))))
    return let(-own["behind"], lambda at: F.filter(fp, lambda x: x["pos"] <= at))


def as_string(fp: Column) -> Column:
    """hash:position of each chosen hash, in hexadecimal, joined by spaces."""
    return F.lower(F.array_join(F.transform(fp, lambda x: F.concat(F.hex(x["hash"]), F.lit(":"), F.hex(x["pos"].cast("long")))), " "))


def likeness(a: Column, b: Column) -> Column:
    """Shared elements over all elements of two arrays without repeats; 1 if both are empty."""

    def share(both: Column) -> Column:
        total = F.size(a) + F.size(b) - both
        return F.when(total == 0, F.lit(1.0)).otherwise(both / total)

    return let(F.size(F.array_intersect(a, b)), share)


def with_next(docs: DataFrame, more: dict | None = None) -> DataFrame:
    """doc_id, text, next_text, and for each name of more its column and next_name: the text of the next row by ascending doc_id (nulls first, then by text), of the first after the last.

    Rows are dealt to ranges of doc_id; the first rows of a range are also sent, as
    ghosts, to the range before it (those of the first range to the last one), so one
    shuffle does and no range is larger than its share.
    """
    n = 2 * n_partitions(docs.sparkSession)  # of the rows, not the bytes: smaller ones even out
    bounds = range_bounds(docs, n)
    least = docs.agg(F.min("doc_id").alias("m"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    first = F.col("doc_id").isNull() if least["nulls"] else F.col("doc_id") == F.lit(least["m"])
    own = range_index(F.col("doc_id"), bounds)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), own.alias("own"))
    starts = F.col("doc_id").isin(bounds) if bounds else F.lit(False)
    places = F.filter(F.array(F.struct(F.col("own").alias("r"), F.lit(False).alias("ghost")), F.struct(F.when(starts, F.col("own") - 1).alias("r"), F.lit(True).alias("ghost")), F.struct(F.when(first, F.lit(len(bounds))).alias("r"), F.lit(True).alias("ghost"))), lambda x: x["r"].isNotNull() & (x["r"] >= 0))
    dealt = rows.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.r", "p.ghost")
    dealt = dealt.withColumn("late", F.col("ghost") & (F.col("r") == len(bounds)))  # the first document, after the last
    order = ["late", F.col("doc_id").asc_nulls_first(), "ghost", "text"]
    w = Window.partitionBy("r").orderBy(*order)
    # dealt and sorted before more is made, so that only the texts are moved
    out = dealt.repartition(n, "r").sortWithinPartitions("r", *order).withColumns(more or {})
    out = out.withColumns({f"next_{c}": F.lead(c).over(w) for c in ("text", *(more or {}))})
    return out.where("not ghost").select("doc_id", "text", "next_text", *[x for c in more or {} for x in (c, f"next_{c}")])


def _edited(k: int, w: int) -> Column:
    """chosen(the edited text) from the columns text, next_text, a, next_a (their chosen), kept (characters before the seam) and tail (characters after it)."""
    run = k + w - 1
    whole = F.col("kept") < run  # no window before the seam
    begin = F.when(whole, 0).otherwise(F.col("kept") - run + 1)
    seam = F.concat(F.substring("text", begin + 1, F.col("kept") - begin), F.substring("next_text", F.lit(1), F.when(whole, F.col("tail")).otherwise(F.least(F.col("tail"), F.lit(run - 1)))))
    moved = lambda x, by: F.struct(x["hash"].alias("hash"), (x["pos"] + by).alias("pos"))
    none = F.slice("a", 1, 0)
    before = F.when(whole, none).otherwise(_up_to(F.col("a"), F.col("kept") - run, w))
    across = F.transform(chosen(seam, k, w), lambda x: moved(x, begin))
    after = F.when(whole | (F.col("tail") < run), none).otherwise(F.transform(_up_to(F.col("next_a"), F.col("tail") - run, w), lambda x: moved(x, F.col("kept"))))
    joined = F.concat(before, across, after)
    return let(joined, lambda x: F.filter(x, lambda e, i: (i == 0) | (e["pos"] != F.get(x, i - 1)["pos"])))


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    docs: doc_id, text (others are ignored). Null texts are empty; an empty text has an
    empty fingerprint, two empty ones are alike (1), one is unlike any other (0). Rows
    with equal doc_id follow each other in the order of their texts; a single row is its own next.
    """
    rows = with_next(docs, {"a": chosen(F.col("text"), k, w)}).withColumn("n_chars", F.char_length("text"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumns({"kept": F.col("n_chars") - cut, "tail": F.least(cut, F.char_length("next_text"))})
    edited = F.concat(F.substring("text", F.lit(1), F.col("kept")), F.substring("next_text", F.lit(1), F.col("tail")))
    rows = rows.select("doc_id", "n_chars", F.sha2(edited.cast("binary"), 256).alias("edited_sha256"), "a", _edited(k, w).alias("b"), F.col("next_a").alias("c"))
    rows = rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", as_string(F.col("a")).alias("fingerprint"), as_string(F.col("b")).alias("edited_fingerprint"), *[F.array_distinct(F.col(x)["hash"]).alias(x) for x in "abc"])
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document of `documents` and of its edited text."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
