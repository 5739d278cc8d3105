"""Command lines, stored responses and small services."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from barflow.__main__ import main
from barflow.functions import times
from barflow.plans import service
from barflow.sources import files, raw

HEAD = "TradingDay,InstrumentID,UpdateTime,UpdateMillisec,LastPrice,Volume,Turnover,OpenInterest"


@pytest.fixture(scope="module")
def sources(tmp_path_factory):
    folder = tmp_path_factory.mktemp("ticks")
    for name, first in (("IF2603", (9, 30)), ("rb2605", (21, 0))):
        lines, volume, turnover = [], 0, 0.0
        for k in range(240):
            h, m = divmod(first[0] * 60 + first[1] + k % 60 if k < 120 else 13 * 60 + 30 + k % 60, 60)
            price = 100 + 0.2 * round(10 * math.sin(k / 7))
            volume, turnover = volume + 5, turnover + 5 * price * 300
            lines.append((h < 18, h * 60 + m, f"20260109,{name},{h:02d}:{m:02d}:{k % 2 * 30:02d},0,{price:.1f},{volume},{turnover},1"))
        (folder / f"{name}_20260109.csv").write_text("\n".join([HEAD, *(x[2] for x in lines)]) + "\n")
    (folder / "other.json").write_text(json.dumps({"schema_version": 1, "session_groups": {"i": {"morning": [["09:30", "11:30"]], "afternoon": [["13:00", "15:00"]]}}, "contracts": {"IF": {"exchange": "C", "session_group": "i", "tick_size": 0.2, "multiplier": 300}}}))
    return folder


def test_convert(spark, sources, tmp_path, capsys):
    out = tmp_path / "out"
    assert main(["convert", f"{sources}/*.csv", str(out)]) == 0
    result = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert result["files"] == 2 and result["rows"] == 480 and result["bars"] == files.read_bars(spark, f"{out}/bars").count()
    assert {p.name for p in (out / "bars").glob("*.csv")} == {"IF2603_1m_20260109.csv", "rb2605_1m_20260109.csv"}
    with pytest.raises(FileExistsError):
        main(["convert", f"{sources}/*.csv", str(out)])
    assert main(["convert", f"{sources}/*.csv", str(out), "--roots", "RB", "--overwrite"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["files"] == 1


def test_profile(spark, sources, tmp_path, capsys):
    out = tmp_path / "out"
    assert main(["profile", f"{sources}/*.csv", str(out), "--contracts", f"{sources}/other.json", "--roots", "IF"]) == 0
    result = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert result == json.loads((out / "result.json").read_text()) and result["kinds"] == result["levels"] == 0  # too little was traded to be profiled
    with pytest.raises(SystemExit):
        main(["profile", "a", "b"])


def test_responses(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    bar = lambda m, c=1: {"d": f"2026-07-24 09:0{m}:00", "o": c, "h": c, "l": c, "c": c, "v": 1, "p": 2}
    good = put("a.js", f"var x=({json.dumps([bar(3), bar(1), ['2026-07-24 09:02:00', 1, 1, 1, 1, 1, 2]])});")
    assert [(r.seq, r.datetime[-5:], r.hold) for r in files.response_bars(spark, good).orderBy("seq").collect()] == [(0, "01:00", "2"), (1, "02:00", "2"), (2, "03:00", "2")]
    for name, text, said in (("b.js", "x=([]);", "no bars"), ("c.js", "x=[1];", "no response"), ("d.js", f"x=({json.dumps([bar(1), bar(1, 2)])});", "a time twice")):
        with pytest.raises(Exception, match=said):
            files.response_bars(spark, put(name, text)).collect()
    with pytest.raises(ValueError, match="too large"):
        files.response_bars(spark, good, max_bytes=10)


def test_raw_archive_with_a_time_twice(spark, tmp_path):
    path = str(tmp_path / "raw")
    row = ("x", "1m", 2026, dt.datetime(2026, 7, 24, 9, 1), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)
    spark.createDataFrame([row, row], raw.RAW).write.partitionBy(*raw.RAW_PARTS).parquet(path)
    new = spark.createDataFrame([(*row, 0)], raw.RAW + ", seq INT").drop("year")
    with pytest.raises(ValueError, match="a time twice"):
        raw.upsert_raw(new, path)
    assert raw.read_raw(spark, path).count() == 2


def test_small_services(spark):
    assert service.health()["ok"] and service.config()["steps"][-1] == "all" and "A" in service.config()["grades"]
    df = spark.createDataFrame([("2026-07-24 09:30:00",), ("2026-07-24 09:30:00.5",), ("2026-07-24 09:30:00.123456",), ("2026-07-24T09:30:00",), (None,)], "t string")
    assert [r[0] and r[0].microsecond for r in df.select(times.event_time(F.col("t"))).collect()] == [0, 500000, 123456, None, None]
