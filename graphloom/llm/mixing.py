"""Mixing sources to target weights by Pareto order sampling.

Each source's target number of words is its share by weight, stopped at a multiple of what the source holds (the
excess goes to the others by weight). Every document of a source is taken as often as the target goes
into the source's words; for what remains, documents are ranked by their random odds over their inclusion
odds (Pareto order sampling) and taken in that order; one that no longer fits into the words left is passed over, and the
order goes on with what is left, to its end. So a source falls short by less than its smallest document not taken.

This goes in rounds, each up to the next document that does not fit; documents longer than what is left are passed
over at once. Prefix sums never gather a source in one task: words are summed over 16,384 classes of rank first, and
only the class in which a round ends is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, fresh

#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
CLASSES = 1 << 14


def targets(totals: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size, target from source, source_size; one row for each source."""
    ranked = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * most).withColumn("level", F.col("cap").cast("double") / F.col("weight"))
    order = Window.orderBy("level", F.col("source").asc_nulls_last())
    filled = (
        ranked.withColumn("k", F.row_number().over(order))
        .withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("each", (F.col("total") - F.col("before")).cast("double") / F.col("open"))
        .withColumn("free", F.col("each") * F.col("weight") <= F.col("cap"))
    )
    level = F.min(F.struct(F.when(F.col("free"), F.col("k")).otherwise(F.lit(2**31 - 1)).alias("k"), F.col("each"))).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return filled.withColumn("first", level).select("source", "source_size", F.when(F.col("k") >= F.col("first.k"), F.col("first.each") * F.col("weight")).otherwise(F.col("cap").cast("double")).alias("target"))


def uniform(id_col: Column, seed: str) -> Column:
    """A number between 0 and 1 that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, plan). rows: doc_id, source, size, source_size, target, copies, taken for each document; plan: for each source how
    its documents are taken; `copies_of` gives the copies of any row by it.

    Null texts have size 0 and take no words; a null source is a source of its own, the last. Rows that repeat id,
    source and size are taken alike. An empty table gives empty results. Further columns are left out of rows.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "mix")
    slim = space.keep(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    totals = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    totals = (
        totals.withColumn("times", times)
        .withColumn("whole", F.floor("times"))
        .withColumn("odds", (F.col("times") - F.col("whole")) / (F.lit(1.0) - (F.col("times") - F.col("whole"))))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    totals = space.keep(totals, "targets")
    u = uniform(F.col("doc_id"), seed)
    # rows that are alike are one unit
    units = slim.groupBy("source", "doc_id", "size").agg((F.count(F.lit(1)) * F.col("size")).alias("mass"))
    ranked = (
        _with(units, totals.where("odds > 0"))
        .withColumn("q", (u / (F.lit(1.0) - u)) / F.col("odds"))
        .withColumn("class", F.floor(F.col("q") / (F.lit(1.0) + F.col("q")) * CLASSES).cast("int"))
        .select("source", "class", "mass", F.struct("q", "doc_id", "size").alias("key"))
    )
    ranked = space.keep(ranked, "ranked")
    none = F.lit(None).cast("struct<q:double,doc_id:bigint,size:bigint>")
    plan = totals.withColumn("left", F.floor(F.col("rest") + 1e-6)).withColumn("at", none).withColumn("open", F.col("odds") > 0)
    plan = space.keep(plan.withColumn("rounds", F.array().cast("array<struct<after:struct<q:double,doc_id:bigint,size:bigint>,before:struct<q:double,doc_id:bigint,size:bigint>,most:bigint>>")), "plan")
    while plan.where("open").limit(1).count():
        live = _with(ranked, plan.where("open").select("source", "left", "at")).where((F.col("at").isNull() | (F.col("key") > F.col("at"))) & (F.col("key.size") <= F.col("left")))
        by_class = live.groupBy("source", "class", "left").agg(F.sum("mass").alias("mass")).withColumn("upto", F.sum("mass").over(Window.partitionBy("source").orderBy("class")))
        cut = by_class.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min(F.struct("class", (F.col("upto") - F.col("mass")).alias("below"))).alias("cut"))
        cut = space.keep(cut.select("source", F.col("cut.class").alias("last"), "cut.below"), "cut")
        inside = _with(live, cut).where(F.col("class") == F.col("last"))
        inside = inside.withColumn("upto", F.col("below") + F.sum("mass").over(Window.partitionBy("source").orderBy("key")))
        ends = inside.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min(F.struct("key", (F.col("upto") - F.col("mass")).alias("reached"))).alias("end"))
        # a source without an end takes all that is left in its order
        plan = _with(plan, ends, "left").withColumn("rounds", F.when(F.col("open"), F.array_append("rounds", F.struct(F.col("at").alias("after"), F.col("end.key").alias("before"), F.col("left").alias("most")))).otherwise(F.col("rounds")))
        plan = plan.withColumn("at", F.col("end.key")).withColumn("left", F.col("left") - F.coalesce(F.col("end.reached"), F.lit(0)))
        plan = space.keep(plan.withColumn("open", F.col("open") & F.col("at").isNotNull() & (F.col("left") > 0)).drop("end"), "plan")
    rows = copies_of(slim, plan, F.col("doc_id"), F.col("size"), seed)
    rows = _with(rows, totals.select("source", "source_size", "target"), "left")
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    return rows, plan


def copies_of(rows: DataFrame, plan: DataFrame, doc_id: Column, size: Column, seed: str, out: str = "copies", source_col: str = "source") -> DataFrame:
    """rows and a column `out`: how often the mix takes each. Other columns of rows stay, whatever their names."""
    source, taken, key = fresh(rows, "source", "plan", "key")
    packed = plan.select(F.col("source").alias(source), F.struct("whole", "odds", "rounds").alias(taken))
    joined = rows.join(packed, rows[source_col].eqNullSafe(packed[source]), "left")
    u = uniform(doc_id, seed)
    joined = joined.withColumn(key, F.struct(((u / (F.lit(1.0) - u)) / F.when(F.col(f"{taken}.odds") > 0, F.col(f"{taken}.odds"))).alias("q"), doc_id.cast("long").alias("doc_id"), size.cast("long").alias("size")))
    k = F.col(key)
    inside = F.exists(f"{taken}.rounds", lambda r: (r["after"].isNull() | (k > r["after"])) & (r["before"].isNull() | (k < r["before"])) & (k["size"] <= r["most"]))
    extra = F.when(F.col(f"{taken}.odds") > 0, inside.cast("long")).otherwise(F.lit(0))
    return joined.withColumn(out, F.col(f"{taken}.whole").cast("long") + extra).drop(source, taken, key)


def _with(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joined on source, nulls alike; right has one row for each source. For working tables, whose columns differ but for source."""
    right = right.withColumnRenamed("source", "_source")
    shared = [c for c in right.columns if c in left.columns]
    return left.join(right.drop(*shared), left["source"].eqNullSafe(right["_source"]), how).drop("_source")


#: The same in SQL, for documents with columns doc_id, text, source.
SQL = r"""
with recursive slim as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
ranked as (
    select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as r from slim group by source),
weighed as (
    select *, [5, 2, 1][((r - 1) % 3 + 1)::int]::bigint as weight, source_size * 3 as cap from ranked),
levels as (
    select *, row_number() over w as k, coalesce(sum(cap) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as before,
        (sum(weight) over (w rows between current row and unbounded following))::bigint as open, (sum(source_size) over ())::bigint as total
    from weighed window w as (order by cap::double / weight, source nulls last)),
each_ as (select *, (total - before)::double / open as each from levels),
first_ as (select each as level, k as from_k from each_ where each * weight <= cap order by k limit 1),
target as (
    select source, source_size, case when k >= from_k then level * weight else cap::double end as target from each_, first_),
times as (select *, case when source_size > 0 then target / source_size else 0.0::double end as times from target),
plan as (select *, floor(times)::bigint as whole, (times - floor(times)) / (1.0::double - (times - floor(times))) as odds, target - floor(times) * source_size as rest from times),
units as (select source, doc_id, size, count(*)::bigint * size as mass from slim group by source, doc_id, size),
orders as (
    select u.*, p.rest, ((('0x' || substr(md5('mix-1|' || coalesce(u.doc_id::varchar, 'null')), 1, 13))::bigint)::double + 0.5::double) / 4503599627370496.0::double as x, p.odds
    from units u join plan p on u.source is not distinct from p.source where p.odds > 0),
q as (select *, (x / (1.0::double - x)) / odds as q from orders),
runs as (select *, row_number() over (partition by source order by q, doc_id, size) as n from q),
walk(source, n, room, taken) as (
    select source, 0::bigint, floor(rest + 1e-6)::bigint, false from plan where odds > 0
    union all
    select w.source, r.n, case when r.mass <= w.room then w.room - r.mass else w.room end, r.mass <= w.room
    from walk w join runs r on r.source is not distinct from w.source and r.n = w.n + 1),
extra as (select r.source, r.doc_id, r.size from walk w join runs r on r.source is not distinct from w.source and r.n = w.n where w.taken)
select s.doc_id, s.size, p.source_size, p.target,
    (s.size * (p.whole + case when e.size is not null then 1 else 0 end))::bigint as taken
from slim s join plan p on s.source is not distinct from p.source
left join extra e on s.source is not distinct from e.source and s.doc_id is not distinct from e.doc_id and s.size = e.size
"""
