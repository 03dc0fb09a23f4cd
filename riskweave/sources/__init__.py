"""Readers and writers: JSON lines with explicit schemas, JSON documents, policy and temperature files, reports."""

from __future__ import annotations

import json
import platform

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import TASKS

LABELLED = f"text string, category string, family string, language string, labels struct<{', '.join(f'{t}: int' for t in TASKS)}>, action string, severity string, source string"
TEACHER = "text string, teacher map<string, double>"
METADATA = "agent boolean, shell boolean, filesystem boolean, network boolean, database boolean, external_api boolean, credential_access boolean, human_approval boolean"


BAD = "_bad_line"


def read_rows(spark: SparkSession, path: str, schema: str = LABELLED, bad: str = "fail") -> DataFrame:
    """Rows of JSON lines.  A line that isn't an object of the schema is an error when it is read; with bad="keep" it is a row
    of nulls with the line as BAD, which is null elsewhere; with bad="drop" it is left out.
    """
    if bad == "fail":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if bad not in ("keep", "drop"):
        raise ValueError(bad)
    kept = spark.read.schema(f"{schema}, {BAD} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)
    return kept if bad == "keep" else kept.where(F.col(BAD).isNull()).drop(BAD)


def read_split(spark: SparkSession, path: str, *splits: str, schema: str = LABELLED, bad: str = "fail") -> DataFrame:
    """Rows of the named splits, all without a name, with `split`; other splits' folders (write_splits) are not read."""
    rows = read_rows(spark, path, f"{schema}, split string", bad)
    return rows.where(F.col("split").isin(*splits)) if splits else rows


def write_dataset(df: DataFrame, path: str, name: str) -> None:
    """A named dataset: Parquet with one folder for each value of the split column."""
    df.write.partitionBy("split").mode("overwrite").parquet(f"{path}/{name}")


def read_dataset(spark: SparkSession, path: str, name: str, *splits: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a named dataset with `split`: of the named splits, all without a name, whose folders alone are listed and read.

    With `columns` only these are read.  A split that the dataset has not is an error, not an empty table.
    """
    rows = spark.read.parquet(f"{path}/{name}")
    if splits:
        known = {r["split"] for r in rows.select("split").distinct().collect()}  # from the folders' names
        if missing := sorted(set(splits) - known):
            raise ValueError(f"{name} has no split {', '.join(missing)}")
        rows = rows.where(F.col("split").isin(*splits))
    return rows.select(*columns, "split") if columns else rows


def concatenated(**tables: DataFrame) -> DataFrame:
    """The rows of all tables, matched by name, with `origin`, the table's name; a column that one lacks is null in its rows."""
    parts = [df.withColumn("origin", F.lit(name)) for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def load_temperatures(path: str) -> dict[str, float]:
    """Temperatures by task from a JSON object; other names are ignored, and 1 holds for tasks without one."""
    stored = load_json(path)
    return {t: float(stored.get(t, 1.0)) for t in TASKS}


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for work that is heavy by row; a table that has them isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder of JSON lines for each value of the split column."""
    df.write.partitionBy("split").mode("overwrite").json(path)


def write_teacher(df: DataFrame, path: str) -> None:
    """JSON lines of text and its teacher targets, from a table with a text and a column for each task; null targets are left out."""
    df.select("text", F.struct(*[F.col(t).cast("double").alias(t) for t in TASKS]).alias("teacher")).write.mode("overwrite").json(path)


def save_json(path: str, value: object) -> None:
    with open(path, "w", encoding="utf-8") as file:
        json.dump(value, file, indent=2, ensure_ascii=False)


def load_json(path: str) -> object:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def report(metrics: DataFrame, title: str, digits: int = 3) -> str:
    """A small metric table as Markdown; metrics hold one row for each task or report."""
    rows = [r.asDict() for r in metrics.collect()]
    names = metrics.columns
    shown = lambda x: f"{x:.{digits}f}" if isinstance(x, float) else f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else str(x)
    return "\n".join([f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(shown(r[n]) for n in names) + " |" for r in rows)]) + "\n"


def percent(share: float, digits: int = 1) -> str:
    return f"{share * 100:.{digits}f}%"


def mib(size: int) -> str:
    return f"{size / 1048576:.1f} MiB"


def environment(spark: SparkSession) -> str:
    """Versions and the settings that decide how plans run, as Markdown."""
    settings = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.session.timeZone")
    rows = [("python", platform.python_version()), ("spark", spark.version), ("master", spark.sparkContext.master), ("cores", str(spark.sparkContext.defaultParallelism)), *((s, spark.conf.get(s)) for s in settings)]
    return "\n".join(["# Environment", "", "| item | value |", "|---|---|", *(f"| {name} | {value} |" for name, value in rows)]) + "\n"
