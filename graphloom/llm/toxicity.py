"""Toxicity: misspelled terms of a lexicon found by Levenshtein automata, weighed by their surroundings.

The lexicon is a trie. The Levenshtein automata of all its terms run through the trie at once: a state is the set
of (trie node, edits) that the letters so far can reach, made deterministic while texts are read and kept. Most words
leave the automaton after a few letters. Each hit is weighed by a window of words around it: inside quotation
marks or beside words of reporting it counts as quotation, else as abuse. A logistic model on these counts gives
the score.

Lexicon and weights are learned from a bounded sample of labelled rows (at most PER_CLASS of each label, those with
the smallest hash of their id); what the executors send back is counts of those words of that sample that tell
labels apart or resemble one that does, and a few numbers for each sampled row. Scoring is a map over partitions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, released, ship

PER_CLASS = 5_000
WINDOW = 6
CACHE, STATES = 120_000, 30_000
#: Known terms, for tables without labels alone.
SEED_TERMS = ("idiot", "moron", "loser", "scum", "trash", "stupid", "pathetic", "worthless", "disgusting", "clown")
#: Words beside which a term is reported, not used: a parameter of `train`, as labels do not tell.
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes term word phrase reported alleged shouted".split())
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}@$]+(?:['’][\p{L}]+)?")
#: Signs that stand for letters.
_SIGNS = str.maketrans("013457@$", "oleastas")
_SIGN = regex.compile(r"[013457@$]")
_OPEN = {"“": "”", "«": "»", "„": "“", '"': '"'}


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def edits_for(term: str) -> int:
    """Misspellings allowed: none under five letters, two from nine."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """match(word): (edits, term) of the nearest term within its allowed edits, or None."""

    def __init__(self, terms):
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.allowed = [0]  # most edits of any term below
        for term in sorted(set(terms)):
            at = 0
            self.allowed[0] = max(self.allowed[0], edits_for(term))
            for c in term:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.term.append(None)
                    self.allowed.append(0)
                at = self.child[at][c]
                self.allowed[at] = max(self.allowed[at], edits_for(term))
            self.term[at] = term
        self.reset()

    def reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[int, str] | None] = []
        self.start = self.state({0: 0})

    def state(self, reach: dict[int, int]) -> int:
        """reach: node -> fewest edits; closed here over skipped letters of terms."""
        todo = list(reach.items())
        while todo:
            node, e = todo.pop()
            if e > reach[node]:
                continue
            for below in self.child[node].values():
                if e + 1 <= self.allowed[below] and e + 1 < reach.get(below, 99):
                    reach[below] = e + 1
                    todo.append((below, e + 1))
        key = frozenset(reach.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] is not None and e <= edits_for(self.term[n])]
            self.ends.append(min(ends) if ends else None)
        return self.ids[key]

    def step(self, state: int, c: str) -> int:
        reach: dict[int, int] = {}
        for node, e in self.states[state]:
            if e + 1 <= self.allowed[node]:
                reach[node] = min(reach.get(node, 99), e + 1)  # a letter too many
            for letter, below in self.child[node].items():
                cost = e + (letter != c)
                if cost <= self.allowed[below]:
                    reach[below] = min(reach.get(below, 99), cost)
        to = self.state(reach) if reach else -1
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> tuple[int, str] | None:
        at = self.start
        for c in word:
            to = self.moves[at].get(c)
            if to is None:
                to = self.step(at, c)
            if to < 0:
                return None
            at = to
        return self.ends[at]


class Model:
    """terms, stems: term or beginning of words -> weight; clean: sorted hashes of words that are no misspelling; coef: weights of the features and a constant."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], clean: np.ndarray, coef: np.ndarray | None = None, reporting: frozenset[str] = REPORTING):
        self.terms, self.stems, self.clean, self.coef, self.reporting = terms, stems, clean, coef, frozenset(reporting)

    def __getstate__(self):
        return {"terms": self.terms, "stems": self.stems, "clean": self.clean, "coef": self.coef, "reporting": self.reporting}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def ready(self) -> None:
        if not hasattr(self, "automaton"):
            self.automaton = Automaton(self.terms)
            self.stem_sizes = sorted({len(s) for s in self.stems})
            self.cache: dict[str, tuple[int, float]] = {}

    def rest(self) -> None:
        """Forgets what was made while texts were read; a worker may live on with other models."""
        for name in ("automaton", "cache"):
            self.__dict__.pop(name, None)

    def kind(self, word: str) -> tuple[int, float]:
        """0: no hit; 1: a term; 2: begins with a learned beginning; 3: a misspelled term; and its weight."""
        hit = self.automaton.match(word)
        if hit and hit[0] == 0:
            return 1, self.terms[hit[1]]
        stem = max((self.stems.get(word[:n], 0.0) for n in self.stem_sizes if len(word) > n), default=0.0)
        if stem:
            return 2, stem
        plain = word.translate(_SIGNS) if _SIGN.search(word) and not word.isdigit() else word
        if plain != word:
            hit = self.automaton.match(plain)
        return (3, self.terms[hit[1]]) if hit and not self.known(word) else (0, 0.0)

    def known(self, word: str) -> bool:
        h = np.uint64(xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)).view(np.int64)  # as Spark's xxhash64
        k = np.searchsorted(self.clean, h)
        return bool(k < len(self.clean) and self.clean[k] == h)

    def features(self, text: str) -> list[float]:
        """Of direct hits: weights of terms, of beginnings, of misspellings, the largest weight, hits in 100 words; of quoted hits the weights."""
        self.ready()
        words = words_of(text)
        cache = self.cache
        hits = []
        for k, w in enumerate(words):
            got = cache.get(w)
            if got is None:
                if len(cache) > CACHE:
                    cache.clear()
                if len(self.automaton.states) > STATES:
                    self.automaton.reset()
                got = cache[w] = self.kind(w)
            if got[0]:
                hits.append((k, got))
        if not hits:
            return [0.0] * FEATURES
        direct, quoted, most, n = [0.0, 0.0, 0.0], 0.0, 0.0, 0
        inside = quoted_places(text)
        for k, (kind, weight) in hits:
            near = words[max(0, k - WINDOW) : k + WINDOW + 1]
            if k in inside or any(w in self.reporting for w in near):
                quoted += weight
            else:
                direct[kind - 1] += weight
                most = max(most, weight * (0.5 if kind == 3 else 1.0))
                n += 1
        return [*map(math.log1p, direct), math.log1p(quoted), most, math.log1p(100 * n / len(words)), float(most >= 3)]

    def scores(self, texts) -> np.ndarray:
        """texts: strings or Arrow scalars, or None; one at a time."""
        x = np.array([self.features((t.as_py() if isinstance(t, pa.Scalar) else t) or "") for t in texts]).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip(x @ self.coef[:-1] + self.coef[-1], -30, 30)))


FEATURES = 7
#: Of tables without labels.
DEFAULT_COEF = np.array([1.5, 1.0, 0.8, 0.2, 0.5, 0.5, 1.0, -3.0])


def quoted_places(text: str) -> set[int]:
    """Numbers of the words inside quotation marks that close on the same line."""
    if not any(c in text for c in _OPEN):
        return set()
    spans = []
    begin = 0
    for line in text.split("\n"):
        open_at = close = None
        for k, c in enumerate(line):
            if close is None and c in _OPEN:
                open_at, close = k, _OPEN[c]
            elif c == close:
                spans.append((begin + open_at, begin + k))
                close = None
        begin += len(line) + 1
    out, s = set(), 0
    for k, m in enumerate(_WORD.finditer(text)):
        while s < len(spans) and spans[s][1] < m.start():
            s += 1
        if s < len(spans) and spans[s][0] < m.start():
            out.add(k)
    return out


def _keys(batches):
    """toxic, fold, key: each different word of a text, and its beginnings of 4 to 6 letters after a blank."""
    for batch in batches:
        toxic, fold, key = [], [], []
        for y, f, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            words = set(words_of(text or ""))
            found = words | {" " + w[:n] for w in words for n in (4, 5, 6) if len(w) > n}
            toxic += [y] * len(found)
            fold += [f] * len(found)
            key += found
            if len(key) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(fold, pa.int32()), pa.array(key, pa.string())], ["toxic", "fold", "key"])
                toxic, fold, key = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(fold, pa.int32()), pa.array(key, pa.string())], ["toxic", "fold", "key"])


def lexicon(rows: list[tuple[str, float, float]], pos: float, neg: float) -> tuple[dict[str, float], dict[str, float]]:
    """Terms and beginnings with their weights from (key, toxic texts, other texts): a low estimate of the log odds ratio, kept where it is clear."""
    terms, stems = {}, {}
    for key, t, n in rows:
        low = math.log((t + 0.5) / (pos + 1)) - math.log((n + 0.5) / (neg + 1)) - 1.64 * math.sqrt(1 / (t + 0.5) + 1 / (n + 0.5))
        if t >= 3 and low >= 1:
            (stems if key.startswith(" ") else terms)[key.strip()] = low
    stems = {s: w for s, w in stems.items() if not any(stems.get(s[:k], 0) >= w for k in range(4, len(s)))}
    return terms, stems


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, reporting: frozenset[str] = REPORTING) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic, of which held-out rows are already gone.

    Rows with a null id or label count for nothing; of labels that differ for one id the larger holds; of documents
    that repeat an id the one with the smallest hash of its text counts; null texts have no words. Without rows of both labels
    the model has the known terms and default weights.
    """
    spark = docs.sparkSession
    ship(spark)
    space = Workspace(spark, "toxicity")
    labels = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # hashes under a share that holds four times the rows wanted, so few are ranked together
    share = F.when(F.col("toxic") == 1, min(1.0, (4.0 * per_class + 40) / total.get(1, 1))).otherwise(min(1.0, (4.0 * per_class + 40) / total.get(0, 1)))
    few = labels.where((F.xxhash64("doc_id").cast("double") + F.lit(float(1 << 63))) / F.lit(float(1 << 64)) <= share)
    first = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = few.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_class).drop("k")  # at most 2 * per_class rows
    fold = (F.crc32(F.concat(F.lit("fold|"), F.col("doc_id").cast("string")).cast("binary")) % 2).cast("int")
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    sample = sample.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")).select("toxic", fold.alias("fold"), "one.text")
    sample = space.keep(sample, "sample")  # as many rows as ids were picked
    n = {(r.toxic, r.fold): r.n for r in sample.groupBy("toxic", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = ([n.get((y, f), 0) for f in (0, 1)] for y in (1, 0))
    if not sum(pos) or not sum(neg):
        return Model({t: 5.0 for t in SEED_TERMS}, {}, np.zeros(0, np.int64), DEFAULT_COEF, reporting)
    counts = [F.coalesce(F.sum(F.when((F.col("toxic") == y) & (F.col("fold") == f), 1)), F.lit(0)).alias(f"{name}{f}") for name, y in (("t", 1), ("n", 0)) for f in (0, 1)]
    found = space.keep(sample.mapInArrow(released(_keys), "toxic int, fold int, key string").groupBy("key").agg(*counts), "keys")
    apart = (F.col("t0") + F.col("t1")) / sum(pos) >= 2 * (F.col("n0") + F.col("n1")) / sum(neg)
    rows = sorted(found.where((F.col("t0") + F.col("t1") >= 3) & apart).collect(), key=lambda r: r.key)  # of the sample's words alone
    made = [lexicon([(r.key, t(r), n(r)) for r in rows], of_pos, of_neg) for t, n, of_pos, of_neg in (
        (lambda r: r.t0 + r.t1, lambda r: r.n0 + r.n1, sum(pos), sum(neg)), (lambda r: r.t1, lambda r: r.n1, pos[1], neg[1]), (lambda r: r.t0, lambda r: r.n0, pos[0], neg[0]))]
    others = found.where((F.col("n0") + F.col("n1") >= 1) & ~F.col("key").startswith(" "))
    known = others.select(F.xxhash64("key").alias("h"), "n0", "n1").toArrow()  # of the sample's words alone
    h, n0, n1 = (known.column(k).to_numpy() for k in range(3))
    # the weights of the features are learned on rows whose half of the sample made neither the lexicon nor the known words
    clean = [np.sort(h[keep]) for keep in (n0 + n1 > 0, n1 > 0, n0 > 0)]
    model, *of_halves = (Model(found_terms, stems, words, reporting=reporting) for (found_terms, stems), words in zip(made, clean))
    halves = spark.sparkContext.broadcast(of_halves)

    def features(batches):
        for batch in batches:
            x = [halves.value[f].features(t.as_py() or "") for f, t in zip(batch.column(1).to_pylist(), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])
        for model in halves.value:
            model.rest()

    rows = sample.mapInArrow(released(features), "toxic int, x array<double>").collect()  # at most 2 * per_class short rows
    rows.sort(key=lambda r: (r.toxic, r.x))
    x = np.array([r.x for r in rows]).reshape(-1, FEATURES)
    y = np.array([r.toxic for r in rows], float)
    weight = np.where(y == 1, total[1] / sum(pos), total[0] / sum(neg))  # classes weigh as among all labels
    model.coef = logistic(x, y, weight / weight.mean())
    return model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton's method; the last weight is the constant's and free of the penalty."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted for each row.

    Null and empty texts score as texts without any hit. Repeated rows score alike; a text of any length is read
    whole; further columns are left out; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = shared.value.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])
        shared.value.rest()

    return rows.mapInArrow(released(run), f"doc_id {kind}, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_column_kept(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            s = shared.value.scores(batch.column(at))
            yield batch.filter(pa.array(s < threshold))
        shared.value.rest()

    return docs.mapInArrow(released(run), docs.schema)
