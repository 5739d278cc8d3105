"""CSV records over several lines against Python's csv, with splits of a few hundred bytes."""

import csv
import io
import random

import pytest
from pyspark.errors import PySparkException

from barflow.sources import records

SPLITS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")


@pytest.fixture(params=[200, 1 << 20])
def splits(spark, request):
    before = {k: spark.conf.get(k, None) for k in SPLITS}
    for k, v in zip(SPLITS, (request.param, 0, 1), strict=True):
        spark.conf.set(k, str(v))
    yield request.param
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def made(seed, rows=80, width=3, end="\n"):
    r = random.Random(seed)
    cell = lambda: "".join(r.choice(['a', 'é', ',', '"', "\n", "\r\n", " ", "line", "x" * 40, '""']) for _ in range(r.randrange(6)))
    table = [["id", "note", "last"]] + [[str(k)] + [cell() for _ in range(width - 1)] for k in range(rows)]
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(table)
    return table, out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_pythons_csv(spark, tmp_path, splits, end):
    want = {}
    for k in range(4):
        table, text = made(k, end=end)
        (tmp_path / f"f{k}.csv").write_bytes((("﻿" if k == 1 else "") + (text if k != 2 else text[: -len(end)])).encode())
        want[k] = [tuple(r) for r in csv.reader(io.StringIO(text, newline=""))][1:]
    got = records.csv_rows(spark, str(tmp_path), ["id", "note", "last"])
    if splits == 200:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    for k, rows in want.items():
        own = sorted((r for r in got.collect() if r.path.endswith(f"f{k}.csv")), key=lambda r: r.seq)
        assert [(r.id, r.note, r.last) for r in own] == rows


def test_forms(spark, tmp_path, splits):
    text = 'a,b\n\n,\n1,"x\n\ny"\n2\n"say ""so""",3,beyond\n"' + "long\n" * 300 + '",4\n5,""\n'
    (tmp_path / "x.csv").write_text(text)
    got = [(r.a, r.b) for r in records.csv_rows(spark, str(tmp_path), ["a", "b"]).orderBy("seq").collect()]
    assert got == [("1", "x\n\ny"), ("2", ""), ('say "so"', "3"), ("long\n" * 300, "4"), ("5", "")]
    assert [r.b for r in records.csv_rows(spark, str(tmp_path), ["b"]).orderBy("seq").collect()] == [b for _, b in got]
    with pytest.raises(PySparkException, match="missing columns c in"):
        records.csv_rows(spark, str(tmp_path), ["a", "c"]).collect()
    with pytest.raises(PySparkException, match="record too large: .*x.csv:9"):
        records.records(spark, str(tmp_path), most_bytes=1000).collect()


def test_nothing_there(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert records.csv_rows(spark, str(tmp_path), ["a"]).count() == 0
    (tmp_path / "h.csv").write_text("a,b\n")
    assert records.csv_rows(spark, str(tmp_path), ["a"]).count() == 0
