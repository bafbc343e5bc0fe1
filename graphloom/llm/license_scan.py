"""Licence phrases and notices in texts, by a positional index of the licences' words.

The index is made of templates alone: each word's postings are (template, position). How rare a word is comes from all
documents. A file is looked up by the rarest word that each template demands: where it stands, the postings of the template's
other words are met at the same relative position, what share of the template's weight stands there is summed, and the
mandatory phrases are verified. Two maps over the texts; between them a sum with one row for each licence word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, ship

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of UTF-8 with A-Z lowered: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+


@dataclass(frozen=True)
class Template:
    """Words of a licence. Phrases in brackets are mandatory; of the weight of all words at least `share` must stand at their places."""

    label: str
    text: str
    share: float = 1.0
    base: bool = False

    def words(self) -> list[tuple[bytes, bool]]:
        """Each word, and whether it is mandatory."""
        out, inside = [], False
        for piece in re.findall(r"[\[\]]|[^\[\]]+", self.text):
            if piece in "[]":
                inside = piece == "["
            else:
                out += [(w, inside) for w in WORD.findall(piece.encode().lower())]
        if not any(m for _, m in out):
            raise ValueError(f"a template needs a mandatory phrase: {self.text!r}")
        return out


BASE = (
    Template("gpl", "[gnu general public license]", base=True),
    Template("apache", "[apache license]", base=True),
    Template("cc-by", "[cc by]", base=True),
    Template("mit", "[mit license]", base=True),
)

#: Names, headers and opening sentences of public licences.
OWN = (
    Template("agpl", "[gnu affero general public license]"),
    Template("lgpl", "[gnu lesser general public license]"),
    Template("gpl-2.0", "[gnu general public license version 2]"),
    Template("gpl-3.0", "[gnu general public license version 3]"),
    Template("gpl-notice", "this program is free software you can [redistribute it and or modify it] under the terms of the [gnu general public license] as published by the free software foundation", 0.75),
    Template("apache-2.0", "licensed under the [apache license version 2 0] the license you may not use this file except in compliance with the license", 0.3),
    Template("mit-notice", "released under the [mit license]", 0.75),
    Template("mit-text", "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files the software to [deal in the software without restriction]", 0.75),
    Template("isc-text", "permission to [use copy modify and or distribute this software] for any purpose with or without fee is hereby granted", 0.75),
    Template("bsd", "[bsd license]"),
    Template("bsd-text", "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met", 0.75),
    Template("zlib-text", "this software is provided as is without any express or implied warranty in no event will the [authors be held liable] for any damages arising from the use of this software", 0.75),
    Template("unlicense", "this is [free and unencumbered software] released into the public domain", 0.75),
    Template("mpl", "[mozilla public license]"),
    Template("epl", "[eclipse public license]"),
    Template("boost", "[boost software license]"),
    Template("cc0", "[cc0 1 0 universal]"),
    Template("cc-by-nc", "[cc by nc]"),
    Template("cc-by-nd", "[cc by nd]"),
    Template("cc-by-sa", "[cc by sa]"),
    Template("spdx", "[spdx license identifier]"),
)


class Index:
    """Postings of the templates, and for each the anchor: its rarest mandatory word."""

    def __init__(self, templates: Sequence[Template], docs_of: dict[bytes, int], rows: int):
        self.templates, self.postings, self.anchors, self.parts = templates, {}, {}, []
        for t, template in enumerate(templates):
            words = template.words()
            weights = [weight(docs_of.get(w, 0), rows) for w, _ in words]
            place = min((k for k, (_, must) in enumerate(words) if must), key=lambda k: (-weights[k], k))
            self.anchors.setdefault(words[place][0], []).append((t, place))
            self.parts.append((len(words), weights, sum(weights), sum(must for _, must in words)))
            for k, (w, must) in enumerate(words):
                self.postings.setdefault(w, {}).setdefault(t, {})[k] = must

    def found(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, place in the file, weight that stands there) wherever a template's mandatory phrases stand. Repeats count."""
        out = []
        if self.anchors.keys().isdisjoint(words):
            return out
        for at, word in enumerate(words):
            for t, place in self.anchors.get(word, ()):
                begin, (size, weights, _, must) = at - place, self.parts[t]
                met = [k for k in range(max(0, -begin), min(size, len(words) - begin)) if k in self.postings.get(words[begin + k], {}).get(t, ())]
                if sum(self.postings[words[begin + k]][t][k] for k in met) == must:
                    out.append((t, begin, sum(weights[k] for k in met)))
        return out


def weight(docs: int, rows: int) -> int:
    """A whole number that grows with a word's rarity, so that sums do not hang on their order."""
    return 1 + math.floor(1000 * math.log((rows + 1) / (docs + 1)))


def word_docs(docs: DataFrame, vocabulary: frozenset[bytes]) -> DataFrame:
    """word, docs: in how many rows each word of the vocabulary stands, and in how many of all under the empty word. docs: one column of texts without nulls."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            counts[b""] += batch.num_rows
            for text in batch.column(0).to_pylist():
                counts.update(vocabulary.intersection(WORD.findall(text.encode().lower())))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "docs"])

    return docs.mapInArrow(released(run), "word binary, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))


def license_scan(docs: DataFrame, templates: Sequence[Template] = BASE + OWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for each row.

    n_base counts the places of base templates, first_word and last_word are the smallest and largest of them (words from 0,
    null without one). Labels are distinct, in order, joined by commas, '' without any. score is the largest share of a
    template's weight that stands where its mandatory phrases do, 0 without one. spans: label and place of each label found. Null texts count
    as empty. Repeated rows are each scanned; texts of any length are scanned whole; other columns are left out, whatever
    their names. An empty table gives an empty result. Weights come from all rows.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    vocabulary = frozenset(w for t in templates for w, _ in t.words())
    docs_of = {bytes(r["word"]): r["docs"] for r in word_docs(docs.select(text), vocabulary).collect()}  # no more rows than words of the templates
    index = Index(templates, docs_of, docs_of.get(b"", 0))

    def run(batches):
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))]
        for batch in batches:
            rows = [_row(WORD.findall(t.encode().lower()), index) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,word:long>>"
    return rows.mapInArrow(run, out)


def _row(words: list[bytes], index: Index) -> tuple:
    base, labels, base_labels, spans, best = [], set(), set(), [], 0.0
    for t, begin, stands in index.found(words):
        template, total = index.templates[t], index.parts[t][2]
        best = max(best, stands / total)
        if stands >= template.share * total:
            labels.add(template.label)
            spans.append({"label": template.label, "word": begin})
            if template.base:
                base.append(begin)
                base_labels.add(template.label)
    return len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), best, spans


def sql(templates: Sequence[Template] = BASE + OWN) -> str:
    """The query's rows in SQL: every word of a template met at its relative position, without an index."""
    rows = ", ".join(f"({t}, {k}, '{w.decode()}', {int(must)})" for t, x in enumerate(templates) for k, (w, must) in enumerate(x.words()))
    heads = ", ".join(f"({t}, '{x.label}', {x.share}::double, {int(x.base)})" for t, x in enumerate(templates))
    return rf"""
with d as (select row_number() over () as id, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
w as (select id, unnest(words) as word, generate_subscripts(words, 1) - 1 as at from d),
x(t, k, word, must) as (values {rows}),
h(t, label, share, base) as (values {heads}),
df as (select word, count(distinct id) as docs from w where word in (select word from x) group by word),
weighed as (
    select x.*, (1 + floor(1000 * ln(((select count(*) from d) + 1)::double / (coalesce(df.docs, 0) + 1)::double)))::bigint as weight
    from x left join df on x.word = df.word),
whole as (select t, sum(weight)::bigint as total, sum(must)::bigint as must from weighed group by t),
met as (select w.id, z.t, w.at - z.k as begin_at, sum(z.weight)::bigint as stands, sum(z.must)::bigint as must from w join weighed z on w.word = z.word group by 1, 2, 3),
place as (
    select m.id, h.label, h.base, m.begin_at, m.stands::double / whole.total::double as part, m.stands::double >= h.share * whole.total::double as enough
    from met m join whole on m.t = whole.t and m.must = whole.must join h on m.t = h.t),
found as (
    select id, count(*) filter (enough and base = 1) as n_base, min(begin_at) filter (enough and base = 1) as first_word, max(begin_at) filter (enough and base = 1) as last_word,
        array_to_string(list_sort(list_distinct(list(label) filter (enough and base = 1))), ',') as base_labels, array_to_string(list_sort(list_distinct(list(label) filter (enough))), ',') as labels, max(part) as score
    from place group by id)
select d.doc_id, len(d.words)::bigint as n_words, coalesce(f.n_base, 0)::bigint as n_base, f.first_word::bigint as first_word, f.last_word::bigint as last_word,
    coalesce(f.base_labels, '') as base_labels, coalesce(f.labels, '') as labels, coalesce(f.score, 0.0)::double as score
from d left join found f on d.id = f.id
"""
