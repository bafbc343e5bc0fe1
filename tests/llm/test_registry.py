"""The registered queries of the operators on the smallest tables: columns of the contracts and results against brute force; the pipeline's stages."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import bpe, mixing, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def encoder():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()), special_tokens={})


def run(spark, name, *columns):
    df = registry.queries()[name](spark, SF)
    assert df.columns[: len(columns)] == list(columns)
    return df.collect()


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def test_bpe(spark, documents, encoder):
    got = run(spark, "op1_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert len(got) == len(documents)
    for r in got:
        ids = encoder.encode_ordinary(documents[r.doc_id].text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(documents[r.doc_id].text))


def test_nearest(spark):
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = np.array(sorted(vectors))
    whole = np.stack([vectors[i] for i in ids])
    got = {}
    for r in run(spark, "op3_ann", "query_id", "rank", "vec_id", "score"):
        got.setdefault(r.query_id, []).append(r)
    assert sorted(got) == [i for i in ids if i % 20 == 0]
    met = 0
    for q, rows in got.items():
        rows.sort(key=lambda r: r["rank"])
        score = whole @ vectors[q]
        order = [int(i) for _, i in sorted((-s, i) for s, i in zip(score, ids) if i != q)][:20]
        met += len(set(order) & {r.vec_id for r in rows})
        assert [r["rank"] for r in rows] == list(range(1, 21)) and all(abs(r.score - float(vectors[q] @ vectors[r.vec_id])) < 1e-9 for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
    assert met >= 0.9 * 20 * len(got)


def test_suffixes(spark, documents):
    texts = {i: (d.text or "").encode() for i, d in documents.items()}
    windows = Counter(t[k : k + 400] for t in texts.values() for k in range(len(t) - 399))
    for r in run(spark, "op5_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"):
        t = texts[r.doc_id]
        gone = bytearray(len(t) + 1)
        for k in range(len(t) - 399):
            if windows[t[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(t)))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone) if not g)))


def test_fingerprints(spark, documents):
    ids = sorted(documents, reverse=True)
    by_text = {}
    for r in run(spark, "op6_syncmers", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"):
        text, after = documents[r.doc_id].text, documents[ids[(ids.index(r.doc_id) + 1) % len(ids)]].text
        k = len(text) // 3
        assert r.n_chars == len(text) and r.edited_sha256 == sha(text[: len(text) - k] + after[:k]) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint


def test_labels_and_languages(spark, documents):
    for name, columns, mod, rest in (("op8_toxicity", ("doc_id", "held_out", "score", "predicted"), 4, 2), ("op10_language_id", ("doc_id", "held_out", "lang_pred", "score"), 5, 0)):
        got = run(spark, name, *columns)
        assert sorted(r.doc_id for r in got) == sorted(documents)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and 0 <= r.score <= 1 for r in got)
        if name == "op8_toxicity":
            assert all(r.predicted == int(r.score >= 0.3) for r in got)
        else:
            held = [r.lang_pred == documents[r.doc_id].lang for r in got if r.held_out]
            assert sum(held) >= 0.9 * len(held)


def test_token_counts(spark, documents):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in run(spark, "op9_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit"):
        n = len(lib.encode(documents[r.doc_id].text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(documents[r.doc_id].text.encode()), n, n > 1024)


def test_pipeline(spark, documents, encoder):
    """Each stage on what the one before kept: rejected go, groups keep their smallest id, copies are those of the mix, tokens are the library's."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = corpus_pipeline.Workspace(spark, "test").keep
    clean = kept(stages["toxicity"](spark, docs, SF), "a")
    rejected = {r.doc_id for r in run(spark, "op8_toxicity") if r.predicted}
    assert {r.doc_id for r in clean.collect()} == set(documents) - rejected and clean.columns == docs.columns
    lined = kept(stages["line dedup"](spark, clean, SF), "b")
    assert all(set(r.text.split("\n")) <= set(documents[r.doc_id].text.split("\n")) for r in lined.collect()) and lined.columns == docs.columns
    single = kept(stages["n-gram Jaccard join"](spark, lined, SF), "c")
    shingles = {}
    for r in lined.collect():
        w = r.text.split()
        shingles[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if len(w) > 4 else {tuple(w)}
    left = {r.doc_id for r in single.collect()}
    for a in sorted(left):
        for b in left:
            if a < b and min(len(shingles[a]), len(shingles[b])) >= 10:
                assert len(shingles[a] & shingles[b]) < 0.95 * len(shingles[a] | shingles[b])
    mixed = kept(stages["mixing sources to target weights"](spark, single, SF), "d")
    rows, _ = mixing.mix(single, seed=corpus_pipeline.SEED)
    want = {r.doc_id: r.copies for r in rows.collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == want and max(want.values()) <= 3
    text = {r.doc_id: r.text for r in mixed.collect()}
    out = stages["byte-level BPE encoding and decoding"](spark, mixed, SF).collect()
    assert len(out) == sum(want.values()) and all(list(r.ids) == encoder.encode_ordinary(text[r.doc_id]) and r.decoded_sha256 == sha(text[r.doc_id]) and r.n_tokens == len(r.ids) for r in out)


def test_whole_pipeline_runs(spark):
    df = corpus_pipeline.run(spark, SF)
    assert df.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and df.agg(F.count(F.lit(1))).first()[0] > 50
