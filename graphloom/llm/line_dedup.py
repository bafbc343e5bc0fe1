"""Fuzzy line dedup by MinHash, in DataFrame functions alone.

1. Equal lines are made one first. A line is taken as fixed-width characters (UTF-32), so that a piece of it is cut out in constant time.
   *All* its shingles of twelve characters, one from every character (a line under twelve characters is one
   shingle), are hashed, and eighteen minima over them are gathered by one grouping.
2. Six bands of three minima: different lines that share a band are candidates. For these alone the sets of shingles
   are made, as hashes of 32 bits, and a sketch of each, the hashes that are multiples of eight.
3. Exact verification: the Jaccard similarity of the whole sets must be 0.8 or more. Every candidate is held against one
   pivot first, the line of its buckets that meets most others. What that joins is one component. Buckets that hold more
   than one component are dealt into blocks of some BLOCK lines with their sets: first lines of one block are held together,
   then, where a bucket still holds more than one component, lines of each two of its blocks; where sketches allow a similarity of 0.8 (within
   SPREAD standard deviations) the sets decide. Pairs inside a component are never compared, and no row for a pair leaves
   a task, only one for each two components that are found alike.
4. Links become components (distributed union-find); of each component, the line that stands first, by document id
   and place, stays, and all others are removed.

Blank lines are not compared and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, fresh
from .graph import components

SIMILARITY = 0.8
BANDS, ROWS = 6, 3
#: Lines of a bucket that are held together at once, about, and parts at most that the pairs of blocks of a bucket are dealt in.
BLOCK, DEALS = 32, 16
#: A pair goes on to verification unless its sketches are that many standard deviations under the similarity.
SPREAD = 4.0
#: Characters of a shingle, and shingles that are hashed in one row.
LENGTH, STEP = 12, 8
_LAST = (1 << 63) - 1
_MASK = (1 << 31) - 1


def _multipliers(n: int) -> list[tuple[int, int]]:
    """Odd multipliers and addends under 2**31, by a fixed congruential rule."""
    x, out = 88172645463325252, []
    for _ in range(n):
        pair = []
        for _ in range(2):
            x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            pair.append(x >> 33)
        out.append((pair[0] | 1, pair[1]))
    return out


def _drawn(lines: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows of STEP shingles of the lines (line_id, line) that follow each other, as hashes, and their columns; after the last shingle it is repeated."""
    # where shingles begin, in bytes; a short line is one
    last = F.greatest(F.lit(1), F.length("wide") - (4 * LENGTH - 1))
    at = lines.select("line_id", F.encode("line", "UTF-32").alias("wide")).select("line_id", "wide", last.alias("last"))
    at = at.select("line_id", "wide", "last", F.explode(F.sequence(F.lit(1), "last", F.lit(4 * STEP))).alias("at"))
    shingle = lambda k: F.substring("wide", F.least(F.col("at") + 4 * k, "last"), F.lit(4 * LENGTH))
    names = [f"h{k}" for k in range(STEP)]
    return at.select("line_id", *(F.xxhash64(shingle(k)).alias(h) for k, h in enumerate(names))), names


def shingle_sets(lines: DataFrame) -> DataFrame:
    """line_id and the set of the line's shingles, as hashes of 32 bits, from line_id, line (each line once)."""
    drawn, names = _drawn(lines)
    some = drawn.select("line_id", F.array(*(F.shiftright(h, 32).cast("int") for h in names)).alias("some"))
    return some.groupBy("line_id").agg(F.array_distinct(F.flatten(F.collect_list("some"))).alias("set"))


def signatures(lines: DataFrame) -> DataFrame:
    """line_id and its bands (array of long) from line_id, line."""
    drawn, names = _drawn(lines)
    drawn = drawn.select("line_id", *(F.col(h).bitwiseAND(F.lit(_MASK)).alias(h) for h in names))
    # one update of a line's minima for STEP shingles
    drawn_by = lambda a, b: F.least(*(F.shiftright(F.col(h) * F.lit(a) + F.lit(b), 16).bitwiseAND(F.lit(_MASK)) for h in names))
    minima = [F.min(drawn_by(a, b)).alias(f"m{k}") for k, (a, b) in enumerate(_multipliers(BANDS * ROWS))]
    found = drawn.groupBy("line_id").agg(*minima)
    return found.select("line_id", F.array(*(F.xxhash64(F.lit(b), *(F.col(f"m{b * ROWS + r}") for r in range(ROWS))) for b in range(BANDS))).alias("bands"))


def alike(x: str, y: str, similarity: float, spread: float = 0.0) -> "F.Column":
    """Whether two sets are that alike; of sketches, whether they may be, by so many standard deviations."""
    # shared >= similarity * union - wide * sqrt(union), solved for the union, so that the sets are intersected once
    wide = spread * (similarity * (1 - similarity)) ** 0.5
    both = F.size(x) + F.size(y)
    root = (F.sqrt(F.lit(wide * wide) + 4 * (1 + similarity) * both) + wide) / (2 * (1 + similarity))
    return F.size(F.array_intersect(x, y)) >= both - root * root - 1e-9


def _fits(x, y, similarity: float) -> "F.Column":
    """Whether the sizes of two sets allow the similarity."""
    return F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9


def _links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of different lines whose sets are alike."""
    left = sets.select(F.col("line_id").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("line_id").alias("b"), F.col("set").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(_fits(F.size("x"), F.size("y"), similarity) & alike("x", "y", similarity)).select("a", "b")


def _pairs(of: DataFrame, x: str, y: str) -> DataFrame:
    return of.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _several(places: DataFrame) -> DataFrame:
    """Of the places (band, line_id, root) those in bands that hold more than one component, with the block of the band that the line lies in and their number."""
    bands = places.groupBy("band").agg(F.count(F.lit(1)).alias("lines"), F.min("root").alias("low"), F.max("root").alias("high"))
    several = bands.where("low < high").select("band", F.ceil(F.col("lines") / BLOCK).alias("blocks"))
    return places.select("band", "line_id", "root").join(several, "band").withColumn("block", F.pmod(F.xxhash64("line_id"), "blocks"))


def _met(places: DataFrame, sets: DataFrame, similarity: float, inside: bool) -> DataFrame:
    """Pairs (a, b) of components of which two lines meet in a band and are alike, within a block or between blocks. Blocks meet, and no row for a pair of lines leaves a task."""
    line = F.struct("line_id", "root", "size", "sketch", "set")
    packed = places.join(sets, "line_id").groupBy("band", "block", "blocks").agg(F.collect_list(line).alias("lines"))  # some BLOCK lines
    if inside:
        met = packed.select("lines", F.explode("lines").alias("x")).select("x", F.explode("lines").alias("y")).where("x.line_id < y.line_id")
    else:
        # a band of many blocks is dealt over several tasks
        deals = F.least(F.lit(DEALS), F.ceil(F.sqrt("blocks"))).cast("int")
        x = packed.select("band", F.col("block").alias("block_x"), F.col("lines").alias("lines_x"), F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"))
        y = packed.select("band", F.col("block").alias("block_y"), F.col("lines").alias("lines_y"), F.pmod("block", deals).cast("int").alias("deal"))
        met = x.join(y, ["band", "deal"]).where("block_x < block_y").select("lines_y", F.explode("lines_x").alias("x")).select("x", F.explode("lines_y").alias("y"))
    like = _fits(F.col("x.size"), F.col("y.size"), similarity) & alike("x.sketch", "y.sketch", similarity, SPREAD) & alike("x.set", "y.set", similarity)
    return met.where((F.col("x.root") != F.col("y.root")) & like).select(F.least("x.root", "y.root").alias("a"), F.greatest("x.root", "y.root").alias("b")).distinct()


def _renamed(of: DataFrame, column: str, found: DataFrame) -> DataFrame:
    """of, with the components in a column by their new names, where they have any."""
    new = found.select(F.col("node").alias(column), F.col("root").alias("now"))
    return of.join(new, column, "left").withColumn(column, F.coalesce("now", column)).drop("now")


def line_classes(lines: DataFrame, space: Workspace, similarity: float = SIMILARITY) -> DataFrame:
    """node, root for the lines (line_id, line) that are like a different line; other lines are classes of their own."""
    buckets = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # each line once, where its minima and its set are made
    lines = space.keep_bucketed(lines.groupBy("line_id").agg(F.first("line").alias("line")), "lines", "line_id", buckets)
    signed = space.keep(signatures(lines), "signatures")
    bands = signed.select("line_id", F.explode("bands").alias("band"))
    met = space.keep(bands.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("band"))).where("n > 1"), "met")
    weight = space.keep(met.groupBy("line_id").agg(F.sum("n").alias("weight")), "weights")
    met = space.keep(met.join(weight, "line_id").select("band", "line_id", "weight"), "buckets")
    found = shingle_sets(lines.join(weight.select("line_id"), "line_id"))
    found = found.withColumn("sketch", F.filter("set", lambda h: h.bitwiseAND(F.lit(7)) == 0)).withColumn("size", F.size("set"))
    sets = space.keep_bucketed(found, "sets", "line_id", buckets)
    # a line that meets many others is likely what they are copies of
    chief = F.max(F.struct("weight", "line_id"))
    pivots = space.keep(met.groupBy("band").agg(chief.alias("pivot")), "pivots")
    tried = met.join(pivots, "band").where(F.col("line_id") != F.col("pivot.line_id")).groupBy("line_id").agg(F.max("pivot").alias("pivot"))
    links = space.keep(_links(_pairs(tried.select("line_id", F.col("pivot.line_id").alias("other")), "line_id", "other"), sets, similarity), "links")
    joined = space.keep(components(links, space), "joined")
    places = met.join(joined.withColumnRenamed("node", "line_id"), "line_id", "left").select("band", "line_id", F.coalesce("root", "line_id").alias("root"))
    for inside in (True, False):
        places = space.keep(_several(places), "places")
        if not inside:  # bands of one block are done
            places = places.where("blocks > 1")
        found = space.keep(_met(places, sets, similarity, inside), "found")
        if found.limit(1).count():
            found = space.keep(components(found, space), "roots")
            places = _renamed(places, "root", found)
            alone = found.join(joined.select("node"), "node", "left_anti").select("node", "root")
            joined = space.keep(_renamed(joined, "root", found).select("node", "root").union(alone), "joined")
    return joined


def line_dedup(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, with the text's removed lines gone, and n_lines, n_removed (long).

    Lines are parted by the line feed. A line is kept if no like line stands before it: in a document with a smaller
    id (null ids last; of one id by a hash of the text), or earlier in its own. Rows that repeat id and text are one
    document and keep the same lines. Null texts stay null and have no lines; an empty text is one blank
    line. A line of any length is read whole. Columns of docs named n_lines or n_removed are replaced, all others stay,
    whatever their names. An empty table gives an empty result.
    """
    space = Workspace(docs.sparkSession, "line-dedup")
    own = docs.drop("n_lines", "n_removed")
    at, tie, gone_, lines_, kept_ = fresh(own, "at", "tie", "gone", "lines", "kept")
    columns = own.columns
    # the order of documents: id, then a hash of the text
    own = own.withColumn(at, F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))).withColumn(tie, F.xxhash64(F.col(text_col)))
    parted = own.where(F.col(text_col).isNotNull()).select(F.col(at).alias("at"), F.col(tie).alias("tie"), F.posexplode(F.split(F.col(text_col), "\n")).alias("place", "line")).where(F.col("line").rlike(r"\S"))
    classes = line_classes(parted.select(F.xxhash64("line").alias("line_id"), "line"), space, similarity)
    slim = parted.select("at", "tie", "place", F.xxhash64("line").alias("line_id"), F.xxhash64(F.lit("second"), "line").alias("check"))
    slim = slim.join(classes, slim["line_id"] == classes["node"], "left")
    slim = slim.select("at", "tie", "place", F.coalesce("root", "line_id").alias("group"), F.when(F.col("root").isNull(), F.col("check")).otherwise(F.lit(0)).alias("check"))
    slim = space.keep(slim, "places")
    first = slim.groupBy("group", "check").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "tie", "place")).alias("first")).where("n > 1").drop("n")
    gone = slim.join(space.keep(first, "first"), ["group", "check"]).where(F.struct("at", "tie", "place") != F.col("first"))
    gone = space.keep(gone.groupBy(F.col("at").alias(at), F.col("tie").alias(tie)).agg(F.collect_set("place").alias(gone_)), "gone")
    out = own.join(gone, [at, tie], "left").withColumn(lines_, F.split(F.col(text_col), "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), F.col(gone_))
    out = out.withColumn(kept_, F.concat_ws("\n", F.transform(kept, lambda k: F.element_at(lines_, k + 1))))
    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    return out.select(
        *(F.when(F.col(gone_).isNull(), F.col(c)).otherwise(F.col(kept_)).alias(c) if c == text_col else quoted(c) for c in columns),
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines_)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone_), F.lit(0)).cast("long").alias("n_removed"),
    )
