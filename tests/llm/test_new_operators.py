"""Fill-in-the-middle, divergence of sources and licence scans: against brute force in plain Python, and against their SQL."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.llm import fill_middle as fim
from graphloom.llm import license_scan as lic
from graphloom.llm import registry
from graphloom.llm import source_divergence as div

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n long, form string, a long, words string, docs long, p double, s int, word string, term string"


def texts() -> list:
    r = random.Random(11)
    pieces = ["Alpha", "beta9", "é", "über", "中文", "😀", " ", "\n", "<", ">", "<P>", "<S", "M>", "x", "  ", "\x00", "_", "MIT License", "GNU general\npublic LICENSE, version 3", "cc-by", "CC BY CC BY-NC"]
    made = ["".join(r.choice(pieces) for _ in range(r.randint(0, 40))) for _ in range(60)]
    return [None, "", " ", "a", "abc", "é", "A1b2", "<M>", "a<S>b", "word " * 30_000, *made, made[7], made[7]]


@pytest.fixture(scope="module")
def rows():
    known = [(k if k % 9 else None, t, ("en", "fr", None, "")[k % 4], ("s1", None, "s2", "", "s3")[k % 5]) for k, t in enumerate(texts())]
    return [*known, (5, "again", "de", "alone"), (5, "again", "de", "other")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "w", 3, 0.5, 4, "w", "t") for r in rows], SCHEMA).repartition(3)


def bag(found):
    return sorted(found, key=str)


def test_cuts_and_forms(docs, rows, spark):
    def brute(doc_id, text):
        text = text or ""
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        n = len(units)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        if not text or any(s in text for s in fim.SENTINELS) or h3 % 100 >= 90:
            return doc_id, n, "plain", None, None, text
        pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "spm" if h4 % 100 < 20 else "psm"
        return doc_id, n, form, len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"

    made = fim.fill_middle(docs)
    got = made.withColumn("text", fim.restore(F.col("output"), F.col("form"))).collect()
    assert bag((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == bag(brute(i, t) for i, t, *_ in rows)
    assert bag((r.doc_id, r.text) for r in got) == bag((i, t or "") for i, t, *_ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_middle(docs.limit(0)).count() == 0


def test_cuts_at_every_rank():
    events = fim.Events()
    for text in ("", "a", " ", "ab  cd!", "é<P>x", "  ab", "ab", "<<S>a<"):
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        for k in range(len(units) + 1):
            at = len("".join(units[:k]))
            assert events.cut(text, k, k) == (len(units), at, at, any(s in text for s in fim.SENTINELS))


def test_other_sentinels(docs):
    own = ("[pre]", "[suf]", "[mid]")
    got = fim.fill_middle(docs, sentinels=own, plain_percent=0, spm_percent=50)
    back = got.withColumn("text", fim.restore(F.col("output"), F.col("form"), own))
    assert bag((r.doc_id, r.text) for r in back.collect()) == bag((r.doc_id, r.text or "") for r in docs.collect())
    assert got.where("form = 'spm'").count() and got.where("form = 'psm'").count()
    for bad in (("<P>", "<P>", "<M>"), ("", "b", "c"), ("ab", "ba", "c"), ("é", "b", "c"), ("<P>", "x<P>y", "c")):
        with pytest.raises(ValueError):
            fim.Events(bad)


def brute_divergence(rows, least=3, top=200):
    groups, counts, held = set(), {}, {}
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = [w for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))]
        counts.setdefault((lang, source), Counter()).update(words)
        held.setdefault(lang, Counter()).update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        terms = [t for t, n in held[lang].items() if n >= least]
        sources = sorted((s for g, s in groups if g == lang), key=str.encode)
        whole = sum((counts[lang, s] for s in sources), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in terms) + len(terms)) for t in terms}
        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for a in sources:
            pair = [(sum((p[a][t] - p[b][t]) ** 2 // p[b][t] for t in terms), b) for b in sources if b != a]
            own = [((p[a][t] - q[t]) ** 2 // q[t], t) for t in terms if counts[lang, a][t] and p[a][t] > q[t]]
            for part, found in (("pair", pair), ("term", own)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, a, part, item, v, k + 1) for k, (v, item) in enumerate(found) if part == "pair" or k < top]
    return out


def test_divergence(docs, rows, monkeypatch):
    monkeypatch.setattr(div, "TABLE_ENTRIES", 20)  # tables of counts are given out many times
    for least, top in ((3, 200), (1, 4)):
        got = div.divergence(docs, least, top).collect()
        assert bag((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == bag(brute_divergence(rows, least, top))
    assert div.divergence(docs.limit(0)).count() == 0


def test_long_division(spark):
    r = random.Random(3)
    cases = [(c, t) for t in (1, 7, 10**9, 9 * 10**15) for c in (0, t - 1)] + [(r.randint(0, t - 1), t) for t in (r.randint(1, 9 * 10**15) for _ in range(200))]
    got = spark.createDataFrame(cases, "c long, t long").select("c", "t", div._share(F.col("c"), F.col("t")).alias("p")).collect()
    assert all(x.p == 1 + 10**9 * (x.c + 1) // x.t for x in got)


def brute_licenses(rows):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    held = Counter()
    for _, text, *_ in rows:
        held.update(set(split(text)))
    weigh = lambda w: 1 + math.floor(1000 * math.log((len(rows) + 1) / (held[w] + 1)))
    templates = [(x, [(w.decode(), m) for w, m in x.words()]) for x in lic.BASE + lic.OWN]
    for doc_id, text, *_ in rows:
        words, places, labels, base_labels, score = split(text), [], set(), set(), 0.0
        for x, parts in templates:
            total = sum(weigh(w) for w, _ in parts)
            for begin in range(1 - len(parts), len(words)):
                stands = [0 <= begin + k < len(words) and words[begin + k] == w for k, (w, _) in enumerate(parts)]
                if all(s for s, (_, must) in zip(stands, parts) if must):
                    part = sum(weigh(w) for s, (w, _) in zip(stands, parts) if s)
                    score = max(score, part / total)
                    if part >= x.share * total:
                        labels.add(x.label)
                        if x.base:
                            places.append(begin)
                            base_labels.add(x.label)
        yield doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score


NOTICES = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to\n * deal in the Software without restriction",
    "# Permission is hereby granted, free of charge, to nobody at all who might want some copies of other things which they like to deal in the software without restriction",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by some other body",
    "Redistribution and use in source and binary forms, with or without modification, are permitted", "the MIT License. MIT license; mit  LICENSE", "cc by", "by license apache", "apache\tlicense",
    "Licensed under the Apache License, Version 2.0.", "gnu gnu general public license public license", "MİT license, mit licénse, MIT_LICENSE mitlicense",
]


def test_licenses(docs, rows, spark):
    more = [*rows, *((100 + k, t, "en", "s") for k, t in enumerate(NOTICES))]
    table = spark.createDataFrame([(*r, 1, "x", 2, "w", 3, 0.5, 4, "w", "t") for r in more], SCHEMA).repartition(3)
    got = lic.license_scan(table).collect()
    assert bag((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in got) == bag((*x[:-1], round(x[-1], 9)) for x in brute_licenses(more))
    by_id = {r.doc_id: r for r in got if r.doc_id and r.doc_id >= 100}
    assert by_id[100].labels == "mit-text" and by_id[101].labels == "" and 0 < by_id[101].score < 0.75
    assert "gpl-notice" in by_id[102].labels and by_id[104].n_base == 3 and (by_id[104].first_word, by_id[104].last_word) == (1, 5)
    assert {(s.label, s.word) for s in by_id[107].spans} == {("apache", 0)}
    assert lic.license_scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lic.Template("x", "no brackets").words()


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_divergence", "op13_licenses"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    df, found = registry.queries()[name](spark, SF), con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    assert bag(tuple(norm(r[c]) for c in columns) for r in df.collect()) == bag(tuple(map(norm, r)) for r in found.fetchall())
