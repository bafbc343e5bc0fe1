"""Null and repeated ids, clashing columns, recall and nearness to targets of the operators of graphloom.llm."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from graphloom.llm import anisotropic_ann, language_id, line_dedup, mixing, ngram_join, syncmers, toxicity
from graphloom.llm.common import Workspace


def test_lines_recall_over_all_shingles(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"\S")).select(F.xxhash64("line").alias("line_id"), "line")
    root = {r.node: r.root for r in line_dedup.line_classes(lines, Workspace(spark, "t")).collect()}
    sets = {r.line_id: {r.line[k : k + 12] for k in range(max(1, len(r.line) - 11))} for r in lines.distinct().collect()}
    held, shared = defaultdict(list), Counter()
    for k, x in sets.items():
        for s in x:
            held[s].append(k)
    for ks in held.values():
        shared.update((a, b) for a in ks for b in ks if a < b)
    pairs = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9]
    assert len(pairs) > 5 and sum(root.get(a, a) == root.get(b, b) for a, b in pairs) >= 0.9 * len(pairs)
    # nothing is joined but by pairs that are alike
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in root.items())


def test_lines_with_clashing_columns(spark):
    rows = [(1, "one line that stands here\nanother line of words", "a", 1, 2), (2, "one line that stands here", "b", 3, 4), (None, "another line of words", "c", 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone string, _at long, _tie int")
    got = line_dedup.line_dedup(df).orderBy(F.col("doc_id").asc_nulls_last()).collect()
    assert [r.text for r in got] == [rows[0][1], "", ""] and [r["_gone"] for r in got] == ["a", "b", "c"] and [r["_at"] for r in got] == [1, 3, 5]


def test_hot_group_of_like_lines(spark):
    r = random.Random(3)
    base = [f"{r.choice('abcdefgh')}{r.randint(0, 999)}" for _ in range(120)]
    rows = []
    for k in range(150):
        words = list(base)
        words[r.randrange(120)] = f"z{r.randint(0, 9999)}"  # any two are alike by some 0.9
        rows.append((k, " ".join(words)))
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [x.doc_id for x in got.where("text <> ''").collect()] == [0]


def test_mix_comes_near_its_target(spark):
    r = random.Random(1)
    rows = [(k, " ".join(["w"] * (20_000 if k == 7 else r.randint(1, 60))), f"s{k % 3}") for k in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))[0]
    by = defaultdict(list)
    for x in got.collect():
        by[x.source].append(x)
    for found in by.values():
        target, taken = found[0].target, sum(x.taken for x in found)
        # no document that would still fit is left out
        assert taken <= target and all(x.size > target - taken for x in found if x.copies == target // x.source_size)
    assert sum(abs(f[0].target - sum(x.taken for x in f)) < 60 for f in by.values()) == 2


def test_copies_keep_clashing_columns(spark):
    rows = [(k, "w " * (k % 9 + 1), f"s{k % 4}") for k in range(400)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    _, plan = mixing.mix(plain)
    size = (F.col("doc_id") % 9 + 1).cast("long")
    want = {r.doc_id: r.copies for r in mixing.copies_of(plain, plan, F.col("doc_id"), size, "mix-1").collect()}
    clashing = plain.select("*", F.lit(0.9).alias("odds"), F.lit(1).alias("cut"), F.lit(9).alias("whole"), F.lit("c").alias("copies"), F.lit(1).alias("rounds"))
    got = mixing.copies_of(clashing, plan, F.col("doc_id"), size, "mix-1", "_n").collect()
    assert {r.doc_id: r["_n"] for r in got} == want and {(r.odds, r.whole, r.copies) for r in got} == {(0.9, 9, "c")}


def test_join_of_null_and_repeated_ids(spark):
    words = lambda k: " ".join(f"{c}{k}" for c in "abcdefghijklmnopqrst")
    texts = [words(k) + end for k in range(60) for end in ("", " end")]
    null = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    got = ngram_join.join(null).collect()
    assert len(got) == 120 and all(r.doc_id is None and r.class_id is None and r.n_links == 1 for r in got) and len({r.class_key for r in got}) == 60
    assert ngram_join.one_of_each(null).count() == 60
    same = spark.createDataFrame([(7, t, "x", "y") for t in texts], "doc_id long, text string, _id string, _k string")
    kept = ngram_join.one_of_each(same)
    assert kept.count() == 60 and kept.columns == same.columns and {r["_id"] for r in kept.collect()} == {"x"}


def test_training_samples_are_bounded(spark):
    rows = [(None, f"{lang} word{k} the and of", lang) for k in range(300) for lang in ("x", "y")] + [(1, "x again and again", "x")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, per_lang=5)
    assert sorted(model.langs) == ["x", "y"]
    many = spark.createDataFrame([(k, f"l{k % 70} " * 5, f"l{k % 70}") for k in range(700)], "doc_id long, text string, lang string")
    assert len(language_id.train(many, in_all=140).langs) == 70
    docs = spark.createDataFrame([(k % 100, f"you idiot number {k}" if k % 100 < 50 else f"a fine day {k}") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 50)) for k in range(100)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, per_class=40)
    bad, good = model.scores(["what an idiot you are", "a fine day"])
    assert bad > 0.3 > good


def test_anchors_hold_their_places(spark):
    text = "the same passage stands in both texts, with other words around it in each"
    row = spark.createDataFrame([("some words first. " + text, text)], "a string, b string").select(syncmers.anchors(F.col("a")).alias("a"), syncmers.anchors(F.col("b")).alias("b")).first()
    at = defaultdict(set)
    for x in row.a:
        at[x.hash].add(x.place)
    assert len(row.b) > 10 and all(x.place + 18 in at[x.hash] for x in row.b)


def test_shortlists_do_not_hold_the_table():
    assert anisotropic_ann.shortlist_size(51_282, 20) == 453 and anisotropic_ann.shortlist_size(500, 20) == 100
