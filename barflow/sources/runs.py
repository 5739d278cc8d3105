"""What a run leaves: report files, counters that are taken while the files are written, and a bar file for each source."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import asdict, is_dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schema import BAR_COLUMNS
from .raw import bar_lines
from .store import path_of, write_report

#: Turns a frame of a run into one that is computed once: by its name, for those that several reports read.
Stage = Callable[[DataFrame, str], DataFrame]


def scratch(spark: SparkSession) -> str:
    """A new folder's name in what spark.checkpoint.dir names; a session of one process may do without and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{named or tempfile.gettempdir()}/files-{uuid.uuid4().hex}"


def as_they_are(df: DataFrame, name: str) -> DataFrame:
    return df


class Stages:
    """Writes frames of a run in a folder, for a run's own use, and reads them again; `counts` has what was counted as they were written."""

    def __init__(self, folder: str):
        self.folder, self.counts = folder.rstrip("/"), {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.counts[name] = observed(df, {"rows": F.count("*")}, lambda rows: rows.write.parquet(f"{self.folder}/{name}"))["rows"]
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.folder}/{name}")


def observed(df: DataFrame, counters: dict[str, Column], write: Callable[[DataFrame], None]) -> dict:
    """Counters over the rows that write writes, taken by that job itself."""
    seen = Observation(f"counters-{uuid.uuid4().hex}")
    write(df.observe(seen, *(c.alias(n) for n, c in counters.items())))
    return dict(seen.get)


def ready(spark: SparkSession, path: str, overwrite: bool) -> None:
    """Makes way for a run's files: a folder that has some raises, unless they may be overwritten."""
    fs, where = path_of(spark, path)
    if fs.exists(where) and len(fs.listStatus(where)):
        if not overwrite:
            raise FileExistsError(f"there are files in {path}")
        fs.delete(where, True)
    fs.mkdirs(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = path_of(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def _flat(df: DataFrame) -> DataFrame:
    """Lists as text, joined by +."""
    return df.select(*(F.array_join(F.col(f.name).cast("array<string>"), "+").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema))


#: The reports of a run, and what is counted as each is written.
def _reports(run, normalization: DataFrame) -> dict[str, tuple[DataFrame, dict[str, Column]]]:
    came = {o: F.count_if(F.col("outcome") == o) for o in ("bounce", "break", "timeout")}
    return {
        "selected_contracts": (run.selected, {"selected_contracts": F.count_if("selected")}),
        "profiles": (run.profiles, {"profiles_rows": F.count("*")}),
        "levels": (run.levels, {"levels": F.count("*")}),
        "events": (run.events, {"events": F.count("*"), **came}),
        "summary": (run.summary, {"kinds": F.count("*")}),
        "normalization_report": (normalization, {"normalized_rows": F.coalesce(F.sum("rows"), F.lit(0))}),
    }


def write_run(run, normalization: DataFrame, path: str, config: object, *, overwrite: bool = False) -> dict:
    """Writes a run's six reports (a CSV each), its configuration and its result into path, and returns the result: the counters of all reports and the path.
    Each counter is taken by the job that writes its report. run: selected, profiles, levels, events and summary as the profile pipeline makes them (for
    frames that several reports read, let it keep them with Stages); normalization: a row a contract and day."""
    spark = normalization.sparkSession
    ready(spark, path, overwrite)
    result: dict = {}
    for name, (df, counters) in _reports(run, normalization).items():
        result |= observed(_flat(df), counters, lambda rows, name=name: write_report(rows, f"{path}/{name}"))
    result["output_dir"] = path
    plain = asdict(config) if is_dataclass(config) else config
    for name, value in (("run_config", plain), ("result", result)):
        write_text(spark, f"{path}/{name}.json", json.dumps(value, ensure_ascii=False, indent=2) + "\n")
    return result


def write_source_files(bars: DataFrame, path: str, *, symbol: str = "symbol", day: str = "source_day", period: str = "1m", zone: str = "Asia/Shanghai", tool: str = "barflow", price: str = "%.2f", overwrite: bool = False) -> dict:
    """One bar file a source, named symbol_period_day.csv: a metadata line, the header, and bars in order of time. Returns the counters files and bars, taken by the
    job that writes. Each source is dealt to one task, which writes its lines as they come sorted; then the driver gives each file its name, one rename
    a source. Files appear under their names when complete."""
    spark = bars.sparkSession
    ready(spark, path, overwrite)
    own = bars.select(F.col(symbol).cast("string").alias("s"), F.col(day).cast("string").alias("d"), F.unix_micros(F.col("bar_time").cast("timestamp")).alias("o"), bar_lines(price).alias("value"))
    head = F.concat(F.lit("# symbol="), F.col("s"), F.lit(f" period={period} tz={zone} generated_by={tool}\n{','.join(BAR_COLUMNS)}"))
    heads = own.select("s", "d").distinct().select("s", "d", F.lit(None).cast("long").alias("o"), head.alias("value"))
    lines = own.unionByName(heads).repartition("s", "d").sortWithinPartitions("s", "d", F.col("o").asc_nulls_first())
    staged = f"{path.rstrip('/')}/.staged-{uuid.uuid4().hex}"
    counters = {"files": F.count_if(F.col("o").isNull()), "bars": F.count_if(F.col("o").isNotNull())}
    result = observed(lines, counters, lambda rows: rows.select("s", "d", "value").write.partitionBy("s", "d").text(staged))
    fs, where = path_of(spark, staged)
    files = fs.listFiles(where, True) if fs.exists(where) else None
    while files is not None and files.hasNext():
        file = files.next().getPath()
        if file.getName().startswith("part-"):
            d, s = (spark.sparkContext._jvm.java.net.URLDecoder.decode(p.getName().split("=", 1)[1], "UTF-8") for p in (file.getParent(), file.getParent().getParent()))
            if not fs.rename(file, path_of(spark, f"{path.rstrip('/')}/{s}_{period}_{d}.csv")[1]):
                raise OSError(f"could not name the file of {s} {d}")
    fs.delete(where, True)
    return result
