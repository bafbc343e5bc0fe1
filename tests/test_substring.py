"""The trigram index against a full scan, and what it reads."""

import glob
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from graphloom.operators import substring


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    words = ["alpha", "Beta", "gämma", "中文字", "😀😀", "de", " ", "x", "\n", "aaaa"]
    made = ["".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(700)]
    return [(k if k % 50 else None, t) for k, t in enumerate([None, "", "ab", "alp", "needle in a haystack", "z" * 70_000 + "end", *made, *made[:20]])]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("index"))
    substring.build(spark.createDataFrame(rows, "id long, text string").repartition(3), at, block_rows=64)
    return at


@pytest.mark.parametrize("pattern", ["alp", "alpha", "ha\nx", "Beta", "beta", "gäm", "中文字中", "😀😀de", "aaaa", "needle in", "zzzz", "zend", "no such", "a", "", "xx", "e g"])
def test_equals_a_scan(spark, rows, folder, pattern):
    got = sorted(((r.id, r.text) for r in substring.contains(spark, folder, pattern).collect()), key=str)
    assert got == sorted(((i, t) for i, t in rows if t is not None and pattern in t), key=str)


def test_empty_table(spark, tmp_path):
    substring.build(spark.createDataFrame([], "id string, text string"), str(tmp_path / "none"))
    assert substring.contains(spark, str(tmp_path / "none"), "abc").count() == 0


def test_tasks_give_out_often(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(substring, "PENDING", 1)
    found = [(0, k, substring.grams(t or "")) for k, (_, t) in enumerate(rows[:80])]
    held = {}
    for part in (found[:30], found[30:]):
        for batch in substring._given(part):
            for g, n, nos in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                assert len(substring.unpacked(nos)) == n
                held.setdefault(g, []).extend(substring.unpacked(nos).tolist())
    want = {}
    for _, no, g in found:
        for x in g.tolist():
            want.setdefault(x, []).append(no)
    assert held == want


def test_packing():
    r = np.random.default_rng(1)
    for n in (0, 1, 500):
        nos = np.unique(r.integers(0, 1 << 30, n))
        data, _ = substring.packed(np.diff(nos, prepend=0))
        assert substring.unpacked(data.tobytes()).tolist() == nos.tolist()


def met(folder, column, wanted):
    """Bytes of the row groups whose span of the column meets one of the values, and of all."""
    some = whole = 0
    for name in glob.glob(f"{folder}/*.parquet"):
        file = pq.ParquetFile(name)
        for k in range(file.num_row_groups):
            group = file.metadata.row_group(k)
            at = next(c for c in range(group.num_columns) if group.column(c).path_in_schema == column)
            stats = group.column(at).statistics
            size = sum(group.column(c).total_compressed_size for c in range(group.num_columns))
            whole += size
            some += size * any(stats.min <= w <= stats.max for w in wanted)
    return some, whole


def test_reads_fewer_bytes(spark, tmp_path, monkeypatch):
    """Sorted row groups: what the filters of a search leave to read of both tables, against the texts alone."""
    monkeypatch.setattr(substring, "ROWS_GROUP", 64 << 10)
    monkeypatch.setattr(substring, "POSTINGS_GROUP", 16 << 10)
    r = random.Random(2)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(400)]
    texts = [(k, " ".join(r.choice(words) for _ in range(60)) + (" RARE passage" if k == 7000 else "")) for k in range(20_000)]
    at = str(tmp_path / "i")
    substring.build(spark.createDataFrame(texts, "id long, text string").repartition(4), at, block_rows=1000)
    found = substring.contains(spark, at, "RARE passage")
    assert [x.id for x in found.collect()] == [7000]
    plan = found._jdf.queryExecution().toString()
    assert "In(gram" in plan and ("In(block" in plan or "EqualTo(block" in plan)
    wanted = substring.grams("RARE passage").tolist()
    postings, _ = met(f"{at}/postings", "gram", wanted)
    block = spark.read.parquet(f"{at}/rows").where("id = 7000").first().block
    rows, texts_whole = met(f"{at}/rows", "block", [block])
    assert postings + rows < texts_whole / 2
