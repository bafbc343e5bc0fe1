"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A k-mer of eight characters is a closed syncmer if the smallest of its four inner s-mers of five characters (by hash)
stands at its beginning or its end. Whether a k-mer is chosen depends on nothing around it, so texts that share a
passage choose the same anchors in it. Where none is chosen, all k-mers of the text count; a text under eight
characters is one k-mer. The fingerprint keeps the SIZE smallest hashes of a text's different syncmers, and the likeness of
two fingerprints is the share of common hashes among the SIZE smallest of both: an estimate of the Jaccard
similarity of the syncmer sets. `anchors` has all syncmers of a text with their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

K, S, SIZE = 8, 5, 128
SMER = rf"(?s)(?=(.{{{S}}}))."
_NO_ID = -(1 << 63)


def let(x: Column, f) -> Column:
    """f of x, which is computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _kmers(text: Column, f) -> Column:
    """f of each k-mer, by place, from the hashes of its four s-mers."""
    smers = F.transform(F.regexp_extract_all(text, F.lit(SMER), F.lit(1)), lambda t: F.xxhash64(t))
    n = lambda h: F.greatest(F.size(h) - (K - S), F.lit(0))
    return let(smers, lambda h: F.transform(F.slice(h, F.lit(1), n(h)), lambda a, k: f(a, F.get(h, k + 1), F.get(h, k + 2), F.get(h, k + 3))))


def _hash(a: Column, b: Column, c: Column, d: Column) -> Column:
    """A k-mer of eight characters is told by its first and last five."""
    return F.shiftright(F.xxhash64(a, d), 32).cast("int")


def marks(text: Column) -> Column:
    """By place in the text: the hash (int) of the k-mer that begins there if it is a closed syncmer, else null."""
    return _kmers(text, lambda a, b, c, d: F.when(F.least(a, d) <= F.least(b, c), _hash(a, b, c, d)))


def anchors(text: Column) -> Column:
    """The closed syncmers of a text: array of (place, hash), for matching by position; place counts characters from 0."""
    found = F.transform(marks(text), lambda h, k: F.struct(k.alias("place"), h.alias("hash")))
    return F.filter(found, lambda x: x["hash"].isNotNull())


def smallest(hashes: Column, n: Column) -> Column:
    """The SIZE smallest different values, sorted, of n that may be null.

    Only values under a bound that some 4 * SIZE should pass are sorted; where too few do, as in texts that repeat, all are.
    """
    sketch = lambda x: F.slice(F.sort_array(F.array_distinct(x)), 1, SIZE)
    bound = F.when(n > 8 * SIZE, F.lit(float(1 << 32)) * (8 * SIZE) / n - F.lit(float(1 << 31))).otherwise(F.lit(float((1 << 31) - 1))).cast("int")
    low = let(bound, lambda most: sketch(F.filter(hashes, lambda h: h <= most)))
    return let(low, lambda x: F.when((n <= 8 * SIZE) | (F.size(x) >= SIZE), x).otherwise(sketch(F.filter(hashes, lambda h: h.isNotNull()))))


def _or_all(sketch: Column, text: Column) -> Column:
    """The sketch or, where no syncmer is chosen, all k-mers; a text under eight characters is one."""
    every = F.when(F.char_length(text) >= K, _kmers(text, _hash)).when(text != "", F.array(F.shiftright(F.xxhash64(text), 32).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(sketch) > 0, sketch).otherwise(F.slice(F.sort_array(F.array_distinct(every)), 1, SIZE))


def likeness(a: Column, b: Column) -> Column:
    """Of two sketches, from 0 to 1; two empty ones are alike."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, SIZE)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def hex_of(sketch: Column) -> Column:
    """Eight digits for each hash."""
    return F.lower(F.array_join(F.transform(sketch, lambda x: F.substring(F.hex(x.cast("long") + F.lit(1 << 33)), 2, 8)), ""))


def successors(keys: DataFrame, space: Workspace) -> DataFrame:
    """keys (id, tie, n; each once) with next_id, next_tie: the following key by descending id, ascending tie; after the last the first.

    Keys are dealt by range; each range finds its own successors, and only the first keys of the ranges, one for each,
    are looked at together.
    """
    order = [F.col("id").desc(), F.col("tie")]
    ranges = space.keep(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("part").orderBy(*order)
    inner = ranges.withColumn("_next", F.lead(F.struct("id", "tie")).over(within))
    firsts = ranges.groupBy("part").agg(F.min(F.struct(F.bitwise_not("id").alias("order"), "tie", "id")).alias("first"))
    over = Window.orderBy("part")
    everything = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(over), F.first("first").over(everything)).alias("_first"))
    joined = inner.join(firsts, "part")
    pick = lambda c: F.when(F.col("_next").isNotNull(), F.col(f"_next.{c}")).otherwise(F.col(f"_first.{c}"))
    return joined.select("id", "tie", "n", pick("id").alias("next_id"), pick("tie").alias("next_tie"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    Null texts count as empty; empty texts have an empty fingerprint, alike only to another empty one. Null ids
    come last. Rows that share an id follow each other by a hash of their texts; rows that repeat id and text are one
    document in that order and get equal results. A table of one document edits it with itself. Further
    columns are left out.
    """
    space = Workspace(docs.sparkSession, "syncmers")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("tie"), "text")  # the same columns on both sides, so texts are shuffled once
    order = successors(rows.select("id", "tie", F.char_length("text").cast("long").alias("n")).distinct(), space)
    heads = order.select(F.col("next_id").alias("id"), F.col("next_tie").alias("tie"), F.col("id").alias("to_id"), F.col("tie").alias("to_tie"), F.floor(F.col("n") / 3).cast("int").alias("take"))
    heads = heads.join(rows, ["id", "tie"]).select(F.col("to_id").alias("id"), F.col("to_tie").alias("tie"), F.substring("text", F.lit(1), F.col("take")).alias("head"), F.col("id").alias("next_id"), F.col("tie").alias("next_tie"))
    heads = heads.dropDuplicates(["id", "tie"])  # a next document that repeats gives one head
    both = rows.join(heads, ["id", "tie"]).withColumn("n", F.char_length("text").cast("long"))
    keep = (F.col("n") - F.floor(F.col("n") / 3)).cast("int")
    both = both.withColumn("left", F.substring("text", F.lit(1), keep)).withColumn("edited", F.concat("left", "head"))
    # the k-mers of an edited text are those of its two parts and those that span the seam
    seam = F.concat(F.right("left", F.lit(K - 1)), F.substring("head", 1, K - 1))
    both = both.withColumn("marks", marks(F.col("text"))).withColumn("head_marks", marks(F.col("head"))).withColumn("seam", F.filter(marks(seam), lambda h: h.isNotNull()))
    inside = F.greatest(keep - (K - 1), F.lit(0))  # k-mers that end before the cut
    after = F.greatest(F.size("marks") - inside, F.lit(0))
    both = both.withColumn("first", smallest(F.slice("marks", F.lit(1), inside), inside)).withColumn("rest", smallest(F.slice("marks", inside + 1, after), after))
    of = lambda *parts: F.slice(F.sort_array(F.array_union(F.array_union(*parts[:2]), parts[-1])), 1, SIZE)
    both = both.withColumn("own", of("first", "rest", "rest")).withColumn("joined", of("first", smallest(F.col("head_marks"), F.char_length("head")), "seam"))
    both = both.withColumn("sketch", _or_all(F.col("own"), F.col("text"))).withColumn("edited_sketch", _or_all(F.col("joined"), F.col("edited")))
    made = both.select(F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), "id", "tie", "next_id", "next_tie", F.col("n").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sketch", "edited_sketch")
    made = space.keep(made, "sketches")
    after = made.select(F.col("id").alias("next_id"), F.col("tie").alias("next_tie"), F.col("sketch").alias("next_sketch")).dropDuplicates(["next_id", "next_tie"])  # repeated rows have one sketch
    return made.join(after, ["next_id", "next_tie"]).select(
        "doc_id", "n_chars", "edited_sha256", hex_of(F.col("sketch")).alias("fingerprint"), hex_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
