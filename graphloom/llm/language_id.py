"""Language identification: averaged hashed subword embeddings under a linear softmax.

Training runs on the driver, in numpy, on a sample of bounded size: at most TRAIN_PER_LANG documents of each
language, those with the smallest hash of id and text. Features are made on the executors from whole texts. As the
model is linear, embedding and softmax fold into one table of scores for each bucket, and predicting is a map
over partitions: look up each character n-gram's row and average.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

BUCKETS = 1 << 13
SIZE = 16
#: Training rows of a language, and of all together, at most; every language is learned.
TRAIN_PER_LANG, TRAIN_ROWS = 800, 51_200
CHUNK_CHARS = 1_000_000

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(x).isalpha() for x in range(0x110000)), bool, 0x110000))
    return _letters[0]


def buckets_of(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For n of 1, 2, 3: the bucket of the n-gram that begins at each character of the joined texts; where texts begin; whether each has a letter.

    Case is folded; all but letters count as blank; each text ends with two blanks, so no n-gram spans two texts.
    """
    joined = "".join(t.lower() + "  " for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[code]
    code = np.where(is_letter, code, 32).astype(np.uint64)
    sizes = np.fromiter((len(t.lower()) + 2 for t in texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    has = np.logical_or.reduceat(is_letter, starts) if len(texts) else np.zeros(0, bool)
    out, h = [], np.zeros(code.size, np.uint64)
    for n in range(3):
        shifted = np.concatenate([code[n:], np.full(n, 32, np.uint64)])
        h = h * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(n + 1)
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((mixed >> np.uint64(51)).astype(np.int32))  # 13 bits
    return out, starts, has


class Model:
    """table: score of each bucket for each language; bias; temperature; the score below which a prediction is rejected."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, reject: float = 0.0):
        self.langs, self.table, self.bias, self.temperature, self.reject = langs, table, bias, temperature, reject

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores, begin = [], [], 0
        while begin < len(texts):
            end, chars = begin, 0
            while end < len(texts) and (end == begin or chars < CHUNK_CHARS):
                chars += len(texts[end] or "")
                end += 1
            part = [t or "" for t in texts[begin:end]]
            grams, starts, has = buckets_of(part)
            n = 3 * np.diff(np.append(starts, grams[0].size)).astype(np.float64)
            logits = np.stack([sum(np.add.reduceat(column[g], starts) for g in grams) / n for column in self.table.T], 1) + self.bias if self.langs else np.zeros((len(part), 1))
            p = softmax(logits / self.temperature)
            best = p.argmax(1)
            names += [self.langs[b] if ok and self.langs else "und" for b, ok in zip(best, has)]
            scores.append(np.where(has & bool(self.langs), p[np.arange(len(part)), best], 0.0))
            begin = end
        return names, np.concatenate(scores) if scores else np.zeros(0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 1.0, seed: int = 5, least_steps: int = 1000) -> Model:
    """rows: language, buckets, their shares of the text. One row in five is kept for calibration. Few rows are gone through more often, until there are `least_steps` steps."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, train = order[: len(rows) // 5], order[len(rows) // 5 :]
    y = np.array([langs.index(r[0]) for r in rows])
    E = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
    W, b = np.zeros((SIZE, len(langs)), np.float32), np.zeros(len(langs), np.float32)

    def dense(which):
        x = np.zeros((len(which), BUCKETS), np.float32)
        for k, i in enumerate(which):
            x[k, rows[i][1]] = rows[i][2]
        return x

    share = np.bincount(y, minlength=len(langs))
    weight = (share.mean() / np.maximum(share, 1)).astype(np.float32)  # languages count alike
    each = max(1, -(-len(train) // 32))
    epochs = max(epochs, -(-least_steps // each))
    steps = epochs * each
    step = 0
    for _ in range(epochs):
        for at in range(0, len(train), 32):
            which = rng.permutation(len(train))[:32] if len(train) < 32 else train[at : at + 32]
            which = train[which] if len(train) < 32 else which
            x = dense(which)
            v = x @ E
            g = softmax(v @ W + b)
            g[np.arange(len(which)), y[which]] -= 1
            g *= weight[y[which], None] / len(which)
            lr = rate * (1 - step / steps)
            dE = x.T @ (g @ W.T)
            W -= lr * (v.T @ g)
            b -= lr * 0.1 * g.sum(0)
            E -= lr * np.float32(20 / max(1.0, 20 * float(np.linalg.norm(dE)))) * dE  # shares are small numbers, so the embedding learns faster; steps are clipped
            step += 1
        train = rng.permutation(train)
    table, bias = (E @ W).astype(np.float32), b.astype(np.float64)
    temperature, reject = 1.0, 0.0
    if len(held):
        logits = np.concatenate([dense(held[k : k + 256]) @ table for k in range(0, len(held), 256)]) + bias
        loss = {t: -np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
        temperature = float(min(loss, key=loss.get))
        p = softmax(logits / temperature)
        right = p.max(1)[p.argmax(1) == y[held]]
        reject = float(np.quantile(right, 0.01)) if right.size else 0.0
    return Model(langs, table, bias, temperature, reject)


def _features(batches):
    """lang, buckets, shares of whole texts."""
    for batch in batches:
        lang, where, share = [], [], []
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            grams, _, has = buckets_of([text or ""])
            if not has[0]:
                continue
            n = sum(np.bincount(g, minlength=BUCKETS) for g in grams)
            at = np.flatnonzero(n)
            lang.append(name)
            where.append(at.astype(np.int32))
            share.append((n[at] / n.sum()).astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(where, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], ["lang", "buckets", "shares"])


def held_out(doc_id: Column, of: int, which: int) -> Column:
    """crc32 of the id as text, modulo `of`, is `which`; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == which, F.lit(False))


def train(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, in_all: int = TRAIN_ROWS) -> Model:
    """docs: doc_id, text, lang, of which held-out rows are already gone.

    Of each language those rows count that have the smallest hashes of id and text: at most `per_lang`, and fewer where
    there are more than in_all / per_lang languages, but one at least. Rows with a null text or lang are left out, rows
    that repeat id, text and lang count once, ids may be null or repeat. Without rows the model knows no language.
    """
    ship(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # one row a language
    if not sizes:
        return fit([])
    most = max(1, min(per_lang, in_all // len(sizes)))
    # hashes under a share that holds four times the rows wanted, so few are ranked together
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, (4.0 * most + 40) / n)))), F.col("lang"))
    few = known.where(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) <= share).groupBy("lang", "h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    sample = few.withColumn("rank", rank).where(F.col("rank") <= most)
    rows = sample.select("lang", "text").mapInArrow(_features, "lang string, buckets array<int>, shares array<float>")
    got = sorted(((r.lang, r.buckets, r.shares) for r in rows.toLocalIterator()), key=lambda r: (r[0], r[1][:50], len(r[1])))
    return fit([(a, np.array(b, np.int32), np.array(c, np.float32)) for a, b, c in got])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row.

    lang_pred is `und` with score 0 if the text is null, has no letter or nothing was learned. score is the
    calibrated probability of the predicted language; rejected rows score lower than 99 in 100 right predictions did
    in calibration. Repeated rows get the same result; further columns are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # fixed size

    def run(batches):
        for batch in batches:
            names, scores = shared.value.predict(batch.column(1).to_pylist())
            low = (scores < shared.value.reject) | np.array([n == "und" for n in names], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(low, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
