"""Operators of graphloom.llm against brute force, on small tables with nulls, repeats, ties and clashing columns."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import anisotropic_ann, bpe, bpe_codec, language_id, line_dedup, mixing, ngram_join, suffix_dedup, syncmers, token_counts, toxicity
from graphloom.llm.common import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, tie string, block int, shard int, q double, size long, copies string, n_lines string, key string, root string, band long, line_id long"
RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(f"{r.choice(WORDS)}{r.randint(0, 400)}" for _ in range(n))


def texts() -> list[tuple]:
    base = prose(1, 120)
    edited = base.split()
    edited[60] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(edited)), (4, prose(2, 80)), (5, None), (6, ""), (7, "   "), (8, "one"), (9, "a b c d"), (10, "a b c d"),
        (11, prose(3, 60) + "\n" + prose(4, 60) + "\nshared line of some words here to see"), (12, "shared line of some words here to see\n\n" + prose(5, 50)), (12, prose(6, 20)),
        (None, prose(7, 30)), (None, base), (13, "x" * 3000), (14, "ÄÖ ß é 中文 😀 " * 40), (15, "<|endoftext|> and 12 345\r\n\t y's"), (4, prose(2, 80)), (16, prose(8, 3000)),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "fr", None)[k % 3], ("s1", "s2", None, "s3")[k % 4], len(t or ""), 7, "c", 1, 2, 0.5, 9, "c", "n", "k", "r", 3, 4) for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(rows):
    return sorted(rows, key=str)


def test_encode_and_decode(docs, empty):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(open(RANKS, "rb").read()), special_tokens={})
    got = bpe_codec.decode(bpe_codec.encode(docs, RANKS, P.PATTERN), RANKS).collect()
    assert bag((r.doc_id, list(r.ids), bytes(r.decoded)) for r in got) == bag((i, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts())
    assert bpe_codec.decode(bpe_codec.encode(empty, RANKS, P.PATTERN), RANKS).count() == 0


def test_merging_like_the_libraries():
    r = random.Random(5)
    found = ["".join(r.choice("aab  \n\té中😀'sré1²_-\x1c\x85") for _ in range(r.randint(0, 50))) for _ in range(600)] + ["a" * 3000, "ab" * 2000]
    ranks = bpe.ranks_of(open(RANKS, "rb").read())
    enc, merger = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.merger_of_ranks(ranks)
    pattern = bpe.regex.compile(P.PATTERN)
    for t in found:
        assert merger.encode([w.encode() for w in pattern.findall(t)])[0].tolist() == enc.encode_ordinary(t)
    lib = Tokenizer.from_file(JSON)
    want = [len(e.ids) for e in lib.encode_batch(found, add_special_tokens=False)]
    assert token_counts.counts_of(found, bpe.JsonVocabulary(open(JSON, "rb").read(), P.PATTERN), {}).tolist() == want


def test_token_counts(docs, empty):
    lib = Tokenizer.from_file(JSON)
    want = bag((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in texts())
    got = token_counts.token_counts(docs, JSON, P.PATTERN)
    assert bag((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert got.where("over_limit <> (n_tokens > 1024)").count() == 0 and token_counts.token_counts(empty, JSON, P.PATTERN).count() == 0


def test_line_dedup(docs, empty):
    rows = line_dedup.line_dedup(docs).collect()
    pattern = re.compile(r"(?s)(?:(?<![^ \t\n\x0b\f\r])|(?<=[^ \t\n\x0b\f\r]{16}))(?=([^ \t\n\x0b\f\r].{0,11}))")
    shingles = lambda x: {m.group(1) for m in pattern.finditer(x)}
    by = {(r.doc_id, r.n_chars): r for r in rows}
    assert len(rows) == len(texts()) and set(rows[0].asDict()) == set(docs.columns) | {"n_removed"}
    assert by[(5, 0)].text is None and by[(6, 0)].text == "" and by[(7, 3)].text == "   "
    copies = [r for r in rows if r.text == texts()[0][1]]
    assert [r.doc_id for r in copies] == [1]
    assert by[(12, len(texts()[11][1]))].text.startswith("\n") and by[(12, len(texts()[11][1]))].n_removed == 1
    kept = [set(shingles(x)) for r in {(r.doc_id, r.text): r for r in rows}.values() for x in (r.text or "").split("\n") if x.strip()]
    for a in range(len(kept)):
        for b in range(a):
            assert len(kept[a] & kept[b]) < 0.8 * len(kept[a] | kept[b])
    assert line_dedup.line_dedup(empty).count() == 0


@pytest.mark.parametrize("block", (2, 7, 100))
def test_line_classes_in_blocks(spark, monkeypatch, block):
    """Lines of one bucket that one pivot leaves apart are all held together, in a block and between blocks."""
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    monkeypatch.setattr(line_dedup, "DEALS", 3)
    r = random.Random(5)
    base = "".join(r.choice("abcdefghij klmno") for _ in range(240))
    lines = []
    for n in range(90):
        chars = list(base)
        for _ in range(n % 6):
            chars[r.randrange(len(chars))] = r.choice("PQRSTUVW")
        lines.append("".join(chars))
    lines = list(enumerate(dict.fromkeys(lines)))
    df = spark.createDataFrame(lines, "line_id long, line string")
    bands = {x.line_id: set(x.bands) for x in line_dedup.signatures(df).collect()}
    sets = {n: {line[k : k + 12] for k in range(len(line) - 11)} for n, line in lines}
    root = {n: n for n, _ in lines}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in sets:
        for b in sets:
            if a < b and bands[a] & bands[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    alone = {n for n in root if top(n) == n and sum(top(m) == n for m in root) == 1}
    got = {x.node: x.root for x in line_dedup.line_classes(df, Workspace(spark, "t")).collect()}
    assert got == {n: top(n) for n in root if n not in alone}
    assert len(set(got.values())) + len(alone) > 1


def test_line_dedup_by_every_character(spark):
    every = lambda x: {x[k : k + 12] for k in range(max(1, len(x) - 11))}
    long = prose(40, 16)
    lines = ["2024-01-01T01:00:05", "2024-01-01T02:30:05", "transaction-0001", "transaction-0002", "https://example.org/a/1", "https://example.org/b/1", "中文" * 9 + "一二三", "中文" * 9 + "四五六", "short", "shorts", "😀" * 11 + "a", "😀" * 11 + "b"]
    lines += [long, long[:50] + "#" + long[51:], long + "x", prose(41, 16)]
    got = [r.text for r in line_dedup.line_dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).orderBy("doc_id").collect()]
    want = []
    for x in lines:
        like = [y for y in lines[: len(want)] if len(every(x) & every(y)) >= 0.8 * len(every(x) | every(y))]
        want.append("" if like else x)
    assert got == want and want.count("") == 2


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(700, 7)), np.repeat(rng.normal(size=(1, 7)), 40, 0)]).astype(np.float32)
    rows = [(int(k), v.tolist(), 1) for k, v in enumerate(x)] + [(2000, None, 1), (2020, [0.0] * 7, 1), (2040, [1.0] * 6 + [None], 1), (2060, [float("nan")] * 7, 1), (2080, [1.0], 1), (None, [1.0] * 7, 1), (20, x[20].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in anisotropic_ann.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    d = x.astype(float)
    assert set(got) == set(range(0, len(x), 20))
    for q, found in got.items():
        s = (d * d[q]).sum(1)
        want = [k for k in np.lexsort((np.arange(len(s)), -s)) if k != q][:20]
        found = sorted(found)
        assert [f[2] for f in found] == pytest.approx([s[f[1]] for f in found], abs=1e-12)
        hit, total = hit + len(set(want) & {f[1] for f in found}), total + 20
    assert hit / total >= 0.95
    assert anisotropic_ann.search(df.limit(0)).count() == 0
    assert anisotropic_ann.search(df.where("vec_id in (0, 1, 2)")).count() == 2


def test_mix(docs, empty):
    rows, _ = mixing.mix(docs)
    got = rows.collect()
    assert len(got) == len(texts()) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert bag((r.doc_id, r.size) for r in got) == bag((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in texts())
    targets = {r.source: (r.source_size, r.target) for r in got}
    assert sum(t for _, t in targets.values()) == pytest.approx(sum(s for s, _ in targets.values())) and all(t <= 3 * s for s, t in targets.values())
    assert bag(map(tuple, mixing.mix(docs.repartition(7))[0].collect())) == bag(map(tuple, got))
    assert mixing.mix(empty)[0].count() == 0


def test_mix_matches_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view documents as select * from read_parquet('{sf}/documents.parquet')")
    rows = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))[0]
    assert sorted(map(tuple, rows.select("doc_id", "size", "source_size", "target", "taken").collect())) == sorted(duckdb.sql(mixing.SQL).fetchall())


def brute_spans(data: list[bytes], span=400):
    from collections import Counter

    seen = Counter(b[k : k + span] for b in data for k in range(len(b) - span + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            if seen[b[k : k + span]] > 1:
                gone[k : k + span] = True
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffixes(spark, docs, empty, hot):
    shared = prose(20, 90)
    more = [(100 + k, prose(30 + k, 40) + " " + shared[: 420 + 30 * k] + " " + prose(60 + k, 40)) for k in range(12)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = suffix_dedup.suffix_dedup(df, hot).collect()
    rows = texts() + more
    want = [(i, *w) for (i, _), w in zip(rows, brute_spans([(t or "").encode() for _, t in rows]))]
    assert bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == bag(want)
    assert suffix_dedup.suffix_dedup(empty, hot).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(2)
    rows = [bytes(rng.integers(97, 99, 24).astype(np.uint8)) for _ in range(400)]
    rows += rows[:50]
    group = rng.integers(0, 3, len(rows))
    order, common = suffix_dedup.multikey_order(suffix_dedup._words(rows, 24), group)
    assert [(group[k], rows[k]) for k in order] == sorted((group[k], rows[k]) for k in range(len(rows)))
    for a, b, n in zip(order, order[1:], common[1:]):
        want = next((k for k in range(24) if rows[a][k] != rows[b][k]), 24) if group[a] == group[b] else 0
        assert n == want


def test_fingerprints(docs, empty):
    rows = syncmers.fingerprints(docs).collect()
    assert len(rows) == len(texts())
    one = {}
    for r in rows:
        one.setdefault(r.doc_id, r)
    known = {i: t or "" for i, t in texts() if i not in (None, 12, 4)}
    for i in (16, 15, 14, 11, 9, 8, 7, 6):
        follow = {16: 15, 15: 14, 14: 13, 9: 8, 8: 7, 7: 6, 6: 5, 11: 10}[i]
        t, n = known[i], len(known[i]) // 3
        edited = t[: len(t) - n] + known[follow][:n]
        assert one[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and one[i].n_chars == len(t)
    assert one[1].fingerprint == one[2].fingerprint and one[2].near_next == 1.0 and one[9].fingerprint == one[10].fingerprint
    assert one[5].fingerprint == "" and one[6].near_next == 1.0 and one[8].near_next == 0.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows) and 0.3 < one[16].near_edited < 0.7
    assert syncmers.fingerprints(empty).count() == 0


def test_short_texts_have_fingerprints(spark):
    r = random.Random(9)
    rows = [(k, " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(k % 6 + 1))) for k in range(120)] + [(120, "x"), (121, " "), (122, "")]
    text = dict(rows)
    got = {x.doc_id: x for x in syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for k in got if not got[k].fingerprint] == [122]
    assert all(got[k].near_next < 0.2 for k in range(1, 120)) and got[122].near_next == 0.0
    long = [k for k in range(1, 120) if len(text[k]) >= 24]
    assert len(long) > 40 and sum(got[k].near_edited > 0 for k in long) > 0.9 * len(long) and all(got[k].near_edited < 1 for k in long)


def sets():
    out = []
    for i, t in texts():
        w = (t or "").split()
        out.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    return out


def test_ngram_join(docs, empty, monkeypatch):
    want = []
    for k, (i, a) in enumerate(sets()):
        links = [j for m, (j, b) in enumerate(sets()) if m != k and a and len(a & b) >= 0.8 * len(a | b)]
        ids = [x for x in [i, *links] if x is not None]
        want.append((i, min(ids) if ids else None, len(links)))
    for block in (192, 2):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        assert bag((r.doc_id, r.class_id, r.n_links) for r in ngram_join.join(docs).collect()) == bag(want)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.where(F.col("text") == texts()[0][1]).collect()] == [1]
    assert kept.where("doc_id = 3").count() == (0 if (3, 1, 3) in want else 1)
    assert ngram_join.join(empty).count() == 0 and ngram_join.one_of_each(empty).count() == 0


def test_depth():
    assert ngram_join.depth_for(0.998, 0.8, 16, 6) == 5 and ngram_join.depth_for(0.5, 0.8, 16, 6) == 6


def test_automaton():
    a = toxicity.Automaton(["moron", "scum", "disgusting"])
    assert a.match("moron") == (0, "moron") and a.match("mornn") == (1, "moron") and a.match("mooron") == (1, "moron") and a.match("mron") == (1, "moron")
    assert a.match("scun") is None and a.match("disgsting") == (1, "disgusting") and a.match("dsgustng") == (2, "disgusting") and a.match("melon") is None

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, last = [i], row
            for j, d in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        return row[-1]

    r = random.Random(3)
    for _ in range(3000):
        w = list("disgusting")
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randint(0, 1)] = r.choice(["", "x", "g"])
        d = distance("".join(w), "disgusting")
        assert a.match("".join(w)) == ((d, "disgusting") if d <= 2 else None)


def test_quotation_weighs_less():
    m = toxicity.Model({"moron": 5.0}, {}, [], toxicity.DEFAULT_COEF)
    direct, quoted, none = m.scores(["you are a moron and that is all of it", 'the paper wrote that "he is a moron" and left it there', "nothing at all"])
    assert direct > 0.3 > none and quoted < direct


def test_toxicity(spark, docs, empty):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = language_id.held_out(F.col("doc_id"), 4, 2)
    all_docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(all_docs, labels.where(~held).select("doc_id", "toxic"))
    rows = toxicity.score(all_docs, model).join(labels.where(held), "doc_id").collect()
    right = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert right / sum(r.toxic for r in rows) > 0.9 and right / sum(r.predicted for r in rows) > 0.9
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(texts()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_column_kept(docs, model).columns == docs.columns
    assert toxicity.score(empty, toxicity.train(empty, labels.limit(0).select("doc_id", "toxic"))).count() == 0


def test_languages(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    held = language_id.held_out(F.col("doc_id"), 5, 0)
    all_docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(all_docs.where(~held).select("doc_id", "text", "lang"))
    rows = language_id.identify(all_docs, model).join(all_docs.where(held).select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    got = language_id.identify(docs, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(texts()) and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (5, 6, 7))
    none = language_id.train(empty.select("doc_id", "text", "lang"))
    assert language_id.identify(empty, none).count() == 0 and {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def test_nearest_in_tight_groups(spark):
    """Rows that codes do not tell apart are ranked exactly, however many they are."""
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(10, 64))[rng.integers(0, 10, 12000)] + 0.01 * rng.normal(size=(12000, 64))).astype(np.float32)
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    d, got = x.astype(float), {}
    for r in anisotropic_ann.search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, len(x), 20):
        s = (d * d[q]).sum(1)
        hit += len(set([k for k in np.lexsort((np.arange(len(s)), -s)) if k != q][:20]) & got[q])
    assert hit >= 0.99 * 20 * len(got)


def test_lines_are_seen_at_every_place(spark):
    """Lines that are alike are found whatever characters they hold and wherever they differ."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(20):
        body = "".join(rng.choice(list("bcdefghjklmnoprstuvwxz "), 240)).strip()
        rows += [(2 * k, f"B{body}"), (2 * k + 1, f"C{body}")]
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[k] for k in range(0, 40, 2)) == 0 and sum(got[k] for k in range(1, 40, 2)) >= 19


def test_tokens_do_not_depend_on_blocks(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(k, f"some words {k % 7} of a text, and more words\n" * (k % 5)) for k in range(60)], "doc_id long, text string")
    made = lambda **how: {r.doc_id: list(r.ids) for r in bpe_codec.encode(docs, path, P.PATTERN, **how).collect()}
    assert len(made()) == 60 and made(block_chars=100) == made()
