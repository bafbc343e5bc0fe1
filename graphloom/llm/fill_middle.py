"""Fill-in-the-middle: a text is cut at two units and its middle moved to the end, behind sentinels.

Units are runs of ASCII letters and single other characters. A map over partitions: a task holds one batch of texts and the
events of one text, so neither hot sources nor copies are special, and a lost task is simply run again. Output and its
inverse are built by column functions.
"""

from __future__ import annotations

import string
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix, middle
CHANGE, SENTINEL = 0, 1


class Events:
    """One automaton over texts folded to few ASCII characters.

    Its patterns are each pair of characters of unlike class (letter, other), and the sentinels. Between two changes of class
    every character is of one class, so units there are counted by arithmetic: one for letters, as many as characters
    otherwise.
    """

    def __init__(self, sentinels: tuple[str, str, str] = SENTINELS):
        _checked(sentinels)
        own = set("".join(sentinels))
        letter = next(c for c in string.ascii_letters if c not in own)
        other = next(chr(c) for c in range(32, 127) if chr(c) not in own and not chr(c).isalpha())
        kept = [c if c in own else letter if c.isalpha() else other for c in map(chr, range(128))]
        self.letters = {c for c in kept if c.isalpha()}
        others = set(kept) - self.letters
        self._fold = bytes.maketrans(bytes(range(128)), "".join(kept).encode())
        self._automaton = ahocorasick.Automaton()
        for a, b in ((a, b) for one, two in ((self.letters, others), (others, self.letters)) for a in one for b in two):
            self._automaton.add_word(a + b, CHANGE)
        for s in sentinels:
            self._automaton.add_word(s, SENTINEL)
        self._automaton.make_automaton()

    def runs(self, text: str) -> tuple[np.ndarray, np.ndarray, bool, bool]:
        """Where each run of one class begins (and the length of the text), units up to each beginning, whether the first is of letters, whether a sentinel stands in text."""
        folded = text.encode("ascii", "replace").translate(self._fold).decode("ascii")  # one character for each code point
        found = np.fromiter(chain.from_iterable(self._automaton.iter(folded)), np.int64).reshape(-1, 2)
        change = found[:, 1] == CHANGE
        begins = np.concatenate(([0], found[change, 0], [len(folded)]))
        letters = folded[:1] in self.letters
        units = np.diff(begins)
        units[(0 if letters else 1) :: 2] = 1
        return begins, np.concatenate(([0], np.cumsum(units))), letters, not change.all()

    def cut(self, text: str, h1: int, h2: int) -> tuple[int, int, int, bool]:
        """Number of units n, characters before the smaller and before the larger of h1 and h2 mod n + 1 units, whether a sentinel stands in text."""
        if not text:
            return 0, 0, 0, False
        begins, before, letters, marked = self.runs(text)
        n = int(before[-1])
        ranks = np.array(sorted((h1 % (n + 1), h2 % (n + 1))))
        run = np.searchsorted(before, ranks, "right") - 1  # the run that the unit behind the cut lies in; at n, the end
        places = begins[run] + (ranks - before[run])
        return n, int(places[0]), int(places[1]), marked


def _checked(sentinels: tuple[str, str, str]) -> None:
    """Sentinels must be ASCII, and no end of one may be the beginning of another, so that where texts meet them none arises."""
    if len(set(sentinels)) != 3 or not all(s and s.isascii() for s in sentinels):
        raise ValueError("sentinels must be three different strings of ASCII characters")
    for a in sentinels:
        for b in sentinels:
            if any(b.startswith(a[k:]) for k in range(1, len(a))) or (a is not b and a in b):
                raise ValueError(f"sentinels overlap: {a!r} and {b!r}")


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that `output` of that form was made of, to the character."""
    p, s, m = sentinels
    between = lambda after, before: F.substring_index(F.substring_index(output, before, 1), after, -1)
    middle = F.substring_index(output, m, -1)
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)


def fill_middle(
    docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output for each row.

    Cuts, form and order hang on the id alone: h1 to h4 are the first four groups of eight digits of the hexadecimal sha256
    of `seed:id`. Null texts count as empty, null ids as an id without digits. Empty texts, and texts that hold a sentinel,
    stay plain. Repeated rows and ids are each cut alike; texts of any length are cut whole; other columns are left out, whatever
    their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest.alias("digest"))
    rows = rows.select("doc_id", "text", *(F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)))

    def run(batches):
        events = Events(sentinels)
        for batch in batches:
            cuts = [events.cut(*row) for row in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            columns = [pa.array(list(c), kind) for c, kind in zip(zip(*cuts, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)] if cuts else []
            if cuts:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), batch.column(5), *columns], ["doc_id", "text", "h3", "h4", "n", "a", "b", "marked"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(run, f"doc_id {kind}, text string, h3 long, h4 long, n long, a long, b long, marked boolean")
    plain = (F.col("n") == 0) | F.col("marked") | (F.col("h3") % 100 >= 100 - plain_percent)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm"))
    p, s, m = map(F.lit, sentinels)
    prefix, middle, suffix = F.substr("text", F.lit(1), F.col("a").cast("int")), F.substr("text", (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")), F.substr("text", (F.col("b") + 1).cast("int"))
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text"))
    cut = lambda c: F.when(F.col("form") != "plain", c)
    return rows.select("doc_id", "n", "form", cut(F.col("a")).alias("prefix_chars"), cut(F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


#: The query's rows in SQL.
SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (
    select doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as units, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
        ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
c as (select *, len(units)::bigint as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b from u),
p as (
    select doc_id, t, n, coalesce(array_to_string(units[1:a], ''), '') as pre, coalesce(array_to_string(units[a + 1:b], ''), '') as mid, coalesce(array_to_string(units[b + 1:n], ''), '') as suf,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from c)
select doc_id, n, form, case when form <> 'plain' then length(pre)::bigint end as prefix_chars, case when form <> 'plain' then length(mid)::bigint end as middle_chars,
    sha256(case form when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid when 'spm' then '<S>' || suf || '<P>' || pre || '<M>' || mid else t end) as output_sha256,
    sha256(t) as restored_sha256
from p
"""
