"""Edges derived from node texts: explicit references, mentioned ids, word overlap, and their report."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import REFERENCES, WORD4
from ..session import kept, ship
from .traverse import endpoints_exist, strongest_of_each
from .vectors import nearest


def id_references(texts: DataFrame, ids: DataFrame, pattern: str = r"\b([DPF]-[a-f0-9]{8})\b", weight: float = 0.8) -> DataFrame:
    """src, dst, rel_type, weight for each node id that another node's text (id, text) mentions; ids of failures as well as of decisions and patterns."""
    found = texts.select(F.col("id").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("dst")).where("src <> dst")
    return found.join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", F.lit("REFERENCES").alias("rel_type"), F.lit(weight).alias("weight"))


def fragments(texts: DataFrame, low: int = 3, high: int = 9, words: int = 10) -> DataFrame:
    """fragment, id: the first 3 to 9 of the first ten words of each text; a fragment belongs to the smallest id that has it."""
    w = F.slice(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), 1, words)
    sizes = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda n: n <= F.size(w))
    return texts.select("id", F.explode(F.transform(sizes, lambda n: F.array_join(F.slice(w, F.lit(1), n), " "))).alias("fragment")).groupBy("fragment").agg(F.min("id").alias("id"))


def explicit_references(texts: DataFrame, rules=REFERENCES) -> DataFrame:
    """Edges from phrases such as "depends on <beginning of another text>": verb, then up to 51 word characters, blanks and hyphens that equal a fragment. Case does not count in the verb, nor for how the run begins."""
    known = fragments(texts).select("fragment", F.col("id").alias("dst"))
    parts = []
    for verb, kind, weight in rules:
        # every beginning of the captured run may be the fragment, so long as it ends with a word
        caught = F.regexp_extract_all("text", F.lit(rf"(?i){verb}\s+([A-Za-z][\p{{L}}\p{{N}}_\s\-]{{2,50}})"), F.lit(1))
        parts.append(texts.select(F.col("id").alias("src"), F.explode(caught).alias("run"), F.lit(kind).alias("rel_type"), F.lit(weight).alias("weight")))
    runs = parts[0]
    for p in parts[1:]:
        runs = runs.union(p)
    runs = runs.withColumn("fragment", F.trim(F.regexp_replace("run", r"\s+", " ")))
    return runs.join(known, "fragment").where("src <> dst").select("src", "dst", "rel_type", "weight").distinct()


#: Words of a block of sets, about; columns of the most frequent words, and those that the others share; sets compared at a time.
SPLIT, OWN, SHARED, STEP = 1 << 21, 3072, 1024, 1024


def word_overlap(left: DataFrame, right: DataFrame, above: float = 0.3, cap: float = 0.8, rel_type: str = "IMPLEMENTS", split: int = SPLIT) -> DataFrame:
    """Edges left -> right whose sets of words of four letters and more have a Jaccard similarity above the bound; weight is the similarity, capped.

    Exact. Sets are packed in blocks of about `split` words and every block of the left meets every one of the right, so no row for a word that two
    sets share, or for a pair below the bound, leaves a task. Words are numbered from frequent to rare; a set is a row of counts, with a column
    for each frequent word and columns that rare words share, so the product of two rows is no less than what the sets have in common. Pairs whose
    product reaches bound / (1 + bound) * (n + m), which the bound needs of sets of n and m words, are then counted word by word.
    Sets are in order of their size, and parts of blocks whose sizes rule the bound out are passed over.
    """
    spark = left.sparkSession
    ship(spark)
    kind = left.schema["id"].dataType.simpleString()
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD4), F.lit(0)))
    side = lambda df, s: df.select(F.lit(s).alias("side"), F.col("id"), words.alias("words")).where("id is not null and size(words) > 0")
    sets = side(left, 0).unionByName(side(right, 1)).select("side", "id", F.explode("words").alias("word"))
    known = sets.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word").select("word", "n", F.monotonically_increasing_id().alias("t"))
    known = kept(known, "words")
    part = F.shiftright("t", 33)
    parts = known.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).orderBy("part").collect()  # a row for each partition of the sort
    if not parts:
        return left.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(rel_type).alias("rel_type"), F.lit(0.0).alias("weight")).limit(0)
    before = np.cumsum([0, *(r.words for r in parts)]).tolist()
    offset = F.create_map(*(F.lit(x) for r, at in zip(parts, before) for x in (r.part, at)))
    number = known.select("word", (offset[part] + F.col("t").bitwiseAND((1 << 33) - 1)).cast("int").alias("t"))  # dense, from frequent to rare
    blocks = max(1, -(-sum(r.n for r in parts) // (2 * split)))
    vocabulary = before[-1]

    def pack(group: pa.Table) -> pa.Table:
        """Sets in order of their sizes: ids, sizes, and their words in order."""
        id_, t = group.column("id").combine_chunks(), group.column("t").to_numpy()
        coded = id_.dictionary_encode()
        who = coded.indices.to_numpy()
        n = np.bincount(who)
        rank = np.argsort(n, kind="stable")
        place = np.empty(len(n), np.int64)
        place[rank] = np.arange(len(n))
        order = np.lexsort((t, place[who]))
        return pa.table({"block": group.column("block")[:1], "ids": pa.array([coded.dictionary.take(pa.array(rank)).to_pylist()], pa.list_(id_.type)), "n": [n[rank].astype(np.int32).tobytes()], "t": [t[order].astype(np.int32).tobytes()]})

    coded = sets.join(number, "word").select("side", "id", "t", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    packed = [coded.where(F.col("side") == s).select("block", "id", "t").groupBy("block").applyInArrow(pack, f"block int, ids array<{kind}>, n binary, t binary") for s in (0, 1)]
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    x = kept(packed[0], "sets").withColumn("other", every)
    y = kept(packed[1], "sets").select(F.col("block").alias("other"), F.col("ids").alias("ids2"), F.col("n").alias("n2"), F.col("t").alias("t2")).withColumn("block", every)

    def rows(n: np.ndarray, t: np.ndarray, starts: np.ndarray, low: int, high: int) -> np.ndarray:
        words = t[starts[low] : starts[high]]
        column = np.where(words < OWN, words, OWN + words % SHARED)
        size = vocabulary if vocabulary <= OWN else OWN + SHARED
        flat = np.bincount(np.repeat(np.arange(high - low) * size, n[low:high]) + column, minlength=(high - low) * size)
        return flat.astype(np.float32).reshape(high - low, size)

    def each(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                n, t, n2, t2 = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int32) for c in ("n", "t", "n2", "t2"))
                ids, ids2 = batch.column("ids")[row].values, batch.column("ids2")[row].values
                starts, starts2 = (np.concatenate([[0], np.cumsum(c, dtype=np.int64)]) for c in (n, n2))
                mark = np.zeros(vocabulary, bool)
                for low in range(0, len(n), STEP):
                    high, a = min(low + STEP, len(n)), None
                    for low2 in range(0, len(n2), STEP):
                        high2 = min(low2 + STEP, len(n2))
                        if n[high - 1] <= above * n2[low2] or n2[high2 - 1] <= above * n[low]:
                            continue
                        a = rows(n, t, starts, low, high) if a is None else a
                        need = above / (1 + above) * (n[low:high, None] + n2[None, low2:high2]) - 1e-6
                        i, j = np.nonzero(a @ rows(n2, t2, starts2, low2, high2).T >= need)
                        i, j = i + low, j + low2
                        ends = np.flatnonzero(np.diff(i, append=-1)) + 1
                        shared = np.zeros(len(i), np.int64)
                        for first, last in zip([0, *ends[:-1]], ends):
                            own = t[starts[i[first]] : starts[i[first] + 1]]
                            mark[own] = True
                            for at in range(first, last, 128):
                                to = j[at : min(at + 128, last)]
                                c = n2[to].astype(np.int64)
                                words = t2[np.arange(c.sum()) + np.repeat(starts2[to] - (np.cumsum(c) - c), c)]
                                shared[at : at + len(to)] = np.add.reduceat(mark[words].astype(np.int64), np.cumsum(c) - c)
                            mark[own] = False
                        score = shared / (n[i].astype(np.int64) + n2[j] - shared)
                        ok = np.flatnonzero(score > above)
                        if len(ok):
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i[ok])), ids2.take(pa.array(j[ok])), pa.array(score[ok])], ["src", "dst", "j"])

    met = x.join(y, ["block", "other"]).select("ids", "n", "t", "ids2", "n2", "t2")
    found = met.mapInArrow(each, f"src {kind}, dst {kind}, j double").where("src <> dst")
    return found.select("src", "dst", F.lit(rel_type).alias("rel_type"), F.least("j", F.lit(cap)).alias("weight"))


def similarity_edges(vectors: DataFrame, threshold: float = 0.7, k: int = 49, factor: float = 0.6, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """Directed SEMANTICALLY_SIMILAR edges to each row's nearest others over the threshold; weight is the cosine times the factor. Ids may be numbers or strings (which are numbered in their order first)."""
    if vectors.schema[id_col].dataType.simpleString() == "string":
        numbered = kept(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).orderBy("id").withColumn("n", F.monotonically_increasing_id()), "numbered")
        found = nearest(numbered, k, "n", "v", threshold)
        name = lambda end: numbered.select(F.col("n").alias(end), F.col("id").alias(f"id_{end}"))
        found = found.join(name("src"), "src").join(name("dst"), "dst").select(F.col("id_src").alias("src"), F.col("id_dst").alias("dst"), "score")
    else:
        found = nearest(vectors, k, id_col, vector_col, threshold)
    return found.select("src", "dst", F.lit("SEMANTICALLY_SIMILAR").alias("rel_type"), (F.col("score") * factor).alias("weight"))


def reclassified(edges: DataFrame, classify=None) -> DataFrame:
    """edges with the similar ones passed to a hook (a function of frames for mapInPandas, same columns); without one, as they are."""
    if classify is None:
        return edges
    similar = edges.where("rel_type = 'SEMANTICALLY_SIMILAR'")
    return similar.mapInPandas(classify, edges.schema).union(edges.where("rel_type <> 'SEMANTICALLY_SIMILAR'"))


def new_edges(layers: dict[str, DataFrame], nodes: DataFrame) -> DataFrame:
    """All layers' edges, one for each (src, dst, type), with both ends among the nodes."""
    union = None
    for k, df in enumerate(layers.values()):
        df = df.withColumn("_layer", F.lit(k))
        union = df if union is None else union.unionByName(df)
    return endpoints_exist(strongest_of_each(union, F.col("_layer")).drop("_layer"), nodes)


def report(layers: dict[str, DataFrame], nodes: DataFrame) -> DataFrame:
    """layer, edges (before repeats go), connected (nodes at an edge of any layer), connectivity in percent."""
    union = None
    for name, df in layers.items():
        df = df.select(F.lit(name).alias("layer"), "src", "dst")
        union = df if union is None else union.union(df)
    ends = union.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(nodes.select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("connected"))
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    return union.groupBy("layer").agg(F.count(F.lit(1)).alias("edges")).crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(n)).select("layer", "edges", "connected", F.round(100.0 * F.col("connected") / F.col("n"), 2).alias("connectivity"))


def related_by_keyword(new: DataFrame, known: DataFrame, keywords, most_words: int = 3, most: int = 5) -> DataFrame:
    """new_id, known_id: known nodes (id, text) that hold one of the first keywords of a new text; the first five ids of each."""
    words = new.select(F.col("id").alias("new_id"), F.posexplode(F.slice(keywords(F.col("text")), 1, most_words)).alias("place", "word"))
    split = known.select(F.col("id").alias("known_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("word"))
    found = words.join(split, "word").where("new_id <> known_id").groupBy("new_id", "known_id").agg(F.min("place").alias("place"))
    rank = F.row_number().over(Window.partitionBy("new_id").orderBy("place", "known_id"))
    return found.withColumn("k", rank).where(F.col("k") <= most).select("new_id", "known_id")
