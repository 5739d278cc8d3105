"""Report files and counters of a run, and bar files by source."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from barflow.plans import pipeline
from barflow.plans.config import Limits, ProfileConfig
from barflow.sources import files, runs

from .test_plans import S, day  # noqa: F401


def rows(path):
    [part] = path.glob("part-*.csv")
    with open(part, newline="") as f:
        return list(csv.DictReader(f))


def test_run_writes_reports_and_counts(spark, tmp_path, day):  # noqa: F811
    cfg = ProfileConfig(limits=Limits(volume=10, nonzero_updates=5, coverage=0.5))
    stages = runs.Stages(str(tmp_path / "kept"))
    run = pipeline.run(*day, S, cfg, stages)
    assert stages.counts["normalized"] == 600 and stages.counts["selected"] == 2
    plan = run.events._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1  # a report reads what was kept
    out = tmp_path / "out"
    result = runs.write_run(run, pipeline.normalization_stats(run.normalized), str(out), cfg)
    tables = {n: rows(out / n) for n in ("selected_contracts", "profiles", "levels", "events", "summary", "normalization_report")}
    assert result["selected_contracts"] == sum(r["selected"] == "true" for r in tables["selected_contracts"]) == 1
    assert (result["profiles_rows"], result["levels"], result["events"]) == tuple(len(tables[n]) for n in ("profiles", "levels", "events")) and result["levels"] > 0
    assert all(result[o] == sum(r["outcome"] == o for r in tables["events"]) for o in ("bounce", "break", "timeout"))
    assert sum(int(r["levels"]) for r in tables["summary"]) == result["levels"] and result["normalized_rows"] == 600
    assert json.loads((out / "result.json").read_text()) == result and json.loads((out / "run_config.json").read_text())["limits"]["volume"] == 10
    with pytest.raises(FileExistsError):
        runs.write_run(run, pipeline.normalization_stats(run.normalized), str(out), cfg)


def test_source_files(spark, tmp_path, day):  # noqa: F811
    t, path = day[0], str(tmp_path / "bars")
    other = t.withColumns({"symbol": F.lit("IC 26"), "seq": F.col("seq") + 1})
    one, _ = pipeline.convert(t.unionByName(other), S)
    assert runs.write_source_files(one, path) == {"files": 2, "bars": 300}
    assert sorted(p.name for p in (tmp_path / "bars").glob("*.csv")) == ["IC 26_1m_20260109.csv", "IF2603_1m_20260109.csv"]
    lines = (tmp_path / "bars" / "IF2603_1m_20260109.csv").read_text().splitlines()
    assert lines[0].startswith("# symbol=IF2603 period=1m tz=Asia/Shanghai") and lines[1].startswith("bar_time,trading_day") and len(lines) == 152
    assert lines[2:] == sorted(lines[2:])
    back = files.read_bars(spark, path)
    assert back.count() == 300 and back.agg(F.sum("volume")).first()[0] == one.agg(F.sum("volume")).first()[0]
    with pytest.raises(FileExistsError):
        runs.write_source_files(one, path)
    assert runs.write_source_files(one.limit(0), path, overwrite=True) == {"files": 0, "bars": 0}
