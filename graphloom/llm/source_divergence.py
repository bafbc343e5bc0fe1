"""How sources of a language differ in their words: chi-square-like divergence between each two, and each source's own terms.

Words are counted in tasks (a bounded table of counts, given out when full), summed by term, and each term kept becomes one wide
row: an array of counts by source. Higher-order functions turn it into shares and into one contribution for each pair of
sources, which partial aggregation sums before anything is shuffled. A hot source is one entry of every array, never one task.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, released, ship

TERM = re.compile(rb"[a-z\x80-\xff]+")  # of UTF-8 with A-Z lowered: [^\x00-\x40\x5B-\x60\x7B-\x7F]+
TABLE_ENTRIES = 300_000  # of a task's table of counts
SCALE_STEPS = 3  # shares are in parts of 1000 ** 3


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it), in parts that add up. docs: lang, source, text without nulls."""
    ship(docs.sparkSession)

    def given(tables):
        for (lang, source), (n, docs_of) in tables.items():
            terms = list(n)
            for k in range(0, len(terms), 50_000):
                part = terms[k : k + 50_000]
                columns = [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs_of[t] for t in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    def run(batches):
        tables, entries = defaultdict(lambda: (Counter(), Counter())), 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = TERM.findall(text.encode().lower())
                n, docs_of = tables[lang, source]
                entries -= len(n)
                n.update(words)
                docs_of.update(set(words))
                entries += len(n)
                if entries > TABLE_ENTRIES:
                    yield from given(tables)
                    tables.clear()
                    entries = 0
        yield from given(tables)

    return docs.select("lang", "source", "text").mapInArrow(released(run), "lang string, source string, term binary, n long, docs long")


def _share(count: Column, total: Column) -> Column:
    """1 + floor(10**9 * (count + 1) / total) by long division in three steps: exact while total is under 9 * 10**15."""
    div = lambda a, b: F.call_function("div", a, b)
    rest, share = count + 1, F.lit(0).cast("long")
    for _ in range(SCALE_STEPS):
        share, rest = share * 1000 + div(rest * 1000, total), rest * 1000 % total
    return share + 1


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank.

    A term is kept in a language where at least `least_docs` rows of that language hold it. Part `pair`: item is each other
    source of the language, value the sum over all kept terms of floor((p-q)**2/q), p and q the two sources' smoothed shares in
    parts of 10**9; 0 where the language keeps no term. Part `term`: item is a kept term that stands in the source with a
    larger share than in the language, value the same of these two shares; the `top` highest. Ranks from 1, by value
    descending, then item. A source with no text, or no term, is a group like any other; so are nulls, which count as ''. Repeated
    rows count as often as they stand; texts of any length are counted whole; other columns are left out, whatever their names.
    An empty table gives an empty result. Arithmetic is in whole numbers; beyond 64 bits it fails instead of rounding.
    """
    space = Workspace(docs.sparkSession, "divergence")
    as_text = lambda c, n: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
    rows = docs.select(as_text(lang_col, "lang"), as_text(source_col, "source"), as_text(text_col, "text"))
    in_lang = Window.partitionBy("lang").orderBy("source")
    groups = space.keep(rows.select("lang", "source").distinct().withColumn("s", F.row_number().over(in_lang) - 1), "groups")

    # one shuffle by language and term serves both sums
    parts = term_counts(rows).repartition("lang", "term")
    by_source = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("found")).where(F.col("docs") >= least_docs)  # no longer than sources
    kept = space.keep(kept.select("lang", F.col("term").cast("string").alias("term"), "found"), "kept")

    sums = kept.select("lang", F.explode("found").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("n"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    langs = groups.join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("s", "source", F.coalesce("n", F.lit(0).cast("long")).alias("n")))).alias("g"))
    langs = langs.join(terms, "lang", "left").select("lang", F.coalesce("v", F.lit(0).cast("long")).alias("v"), F.col("g.source").alias("sources"), F.col("g.n").alias("ns"))
    langs = langs.withColumn("totals", F.transform("ns", lambda n: n + F.col("v"))).withColumn("total", F.aggregate("ns", F.col("v"), lambda a, n: a + n))
    langs = langs.withColumn("none", F.when(F.col("v") > 0, F.transform("totals", lambda t: _share(F.lit(0).cast("long"), t))))
    langs = space.keep(langs.select("lang", "v", "sources", "totals", "none", "total"), "langs")  # one row a language; Spark broadcasts it where its size allows

    # the wide rows: counts, and shares, by the source's place in its language; a source without the term has the share of none
    wide = kept.join(langs, "lang").withColumn("by_name", F.map_from_entries("found"))
    wide = wide.withColumn("counts", F.transform("sources", lambda s: F.coalesce(F.try_element_at("by_name", s), F.lit(0).cast("long"))))
    shares = F.transform("counts", lambda n, i: F.when(n == 0, F.get("none", i)).otherwise(_share(n, F.get("totals", i))))
    wide = wide.select("lang", "term", "counts", shares.alias("p"), _share(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n), F.col("total")).alias("q"))
    wide = space.keep(wide, "wide")

    # two sources of which one has the term give one contribution each way; where neither has it, these are the same for every term
    each = wide.select("lang", "counts", "p", F.posexplode("counts").alias("i", "n")).where("n > 0")
    others = F.filter(F.sequence(F.lit(0), F.size("counts") - 1), lambda j: (j != F.col("i")) & ((F.get("counts", j) == 0) | (j > F.col("i"))))
    x, y = F.get("p", F.col("i")), lambda j: F.get("p", j)
    each = each.select("lang", "i", F.explode(F.transform(others, lambda j: F.struct(j.alias("j"), _gap(x, y(j)).alias("there"), _gap(y(j), x).alias("back")))).alias("e"))
    sums = space.keep(each.groupBy("lang", "i", F.col("e.j").alias("j")).agg(F.sum("e.there").alias("there"), F.sum("e.back").alias("back"), F.count(F.lit(1)).alias("n")), "sums")
    sums = sums.select("lang", "i", "j", F.col("there").alias("f"), "n").union(sums.select("lang", "j", "i", "back", "n")).groupBy("lang", "i", "j").agg(F.sum("f").alias("f"), F.sum("n").alias("n"))
    pairs = langs.select("lang", "v", "sources", "none", F.posexplode("sources").alias("i", "source")).select("lang", "v", "none", "i", "source", F.posexplode("sources").alias("j", "item")).where("i <> j")
    rest = (F.col("v") - F.coalesce("n", F.lit(0))) * F.when(F.col("v") > 0, _gap(F.get("none", F.col("i")), F.get("none", F.col("j")))).otherwise(0)
    pairs = pairs.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("f", F.lit(0)) + rest).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    more = F.filter(F.transform("counts", lambda n, i: F.struct(i.alias("s"), n.alias("n"), F.get("p", i).alias("p"))), lambda e: (e["n"] > 0) & (e["p"] > F.col("q")))
    own = wide.select("lang", "term", "q", F.explode(more).alias("e")).select("lang", "term", "q", "e.s", "e.p")
    own = own.select("lang", "s", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "s").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
    own = own.join(groups, ["lang", "s"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(own)


#: The query's rows in SQL.
SQL = r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
w as (select lang, source, id, unnest(words) as term from d),
kept as (select lang, term from w group by lang, term having count(distinct id) >= 3),
v as (select lang, count(*)::hugeint as v from kept group by lang),
g as (select distinct lang, source from d),
c as (select w.lang, w.source, w.term, count(*)::hugeint as n from w join kept k on w.lang = k.lang and w.term = k.term group by 1, 2, 3),
t as (select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as n from g left join c on g.lang = c.lang and g.source = c.source group by 1, 2),
tl as (select lang, sum(n)::hugeint as n from t group by lang),
p as (
    select g.lang, g.source, k.term, coalesce(c.n, 0) as n, (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (t.n + v.v))::hugeint as p
    from g join kept k on g.lang = k.lang join v on v.lang = g.lang join t on t.lang = g.lang and t.source = g.source
    left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as (
    select c.lang, c.term, (1 + (1000000000::hugeint * (sum(c.n)::hugeint + 1)) // (any_value(tl.n) + any_value(v.v)))::hugeint as q
    from c join v on v.lang = c.lang join tl on tl.lang = c.lang group by 1, 2),
pair as (
    select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::bigint as value
    from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pair.value, 0)::bigint as value
    from g a join g b on a.lang = b.lang and a.source <> b.source
    left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source),
terms as (
    select p.lang, p.source, 'term' as part, p.term as item, (((p.p - q.q) * (p.p - q.q)) // q.q)::bigint as value
    from p join q on p.lang = q.lang and p.term = q.term where p.n > 0 and p.p > q.q)
select lang, source, part, item, value, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
from (select * from pairs union all select * from terms)
qualify part = 'pair' or rank <= 200
"""
