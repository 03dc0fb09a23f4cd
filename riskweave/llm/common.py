"""Tables and shared storage used by the corpus operators."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_scope: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


class Scratch:
    """Tables that one piece of work has written."""

    def __init__(self):
        self.paths: list[str] = []
        self.kept: set[str] = set()

    def keep(self, *tables: DataFrame) -> None:
        """These results of materialise() stay, as what is returned reads them."""
        self.kept.update(t._scratch_path for t in tables)


@contextmanager
def scratch() -> Iterator[Scratch]:
    """What is materialised within is deleted at the end, but for what is kept, which an outer scratch takes over."""
    own, outer = Scratch(), _scope.get()
    token = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(token)
    spark = SparkSession.getActiveSession()
    for path in own.paths:
        if path in own.kept:
            if outer is not None:
                outer.paths.append(path)
        elif path in _written:
            _delete(spark, path)
            _written.remove(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; one of our own only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
    return base.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{os.getpid()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    if (scope := _scope.get()) is not None:
        scope.paths.append(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._scratch_path = path
    return written


def forget_at_exit(path: str) -> str:
    """path, which purge() deletes."""
    _written.append(path)
    return path


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote for df, once nothing reads it any more."""
    for file in df.inputFiles()[:1]:
        path = file.rsplit("/", 1)[0]
        for known in [p for p in _written if path.endswith(p.split(":", 1)[-1].lstrip("/"))]:
            _delete(df.sparkSession, known)
            _written.remove(known)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def purge() -> None:
    """Delete what this process wrote to the shared folder."""
    spark = SparkSession.getActiveSession() if _written else None
    if spark is not None and spark.sparkContext._jsc is not None:
        while _written:
            _delete(spark, _written.pop())


def grouped(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of a stream sorted by keys, also when they reach over batches."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        key = frame[keys]
        starts = np.flatnonzero((key != key.shift()).any(axis=1).to_numpy())
        for a, b in zip(starts, starts[1:], strict=False):
            yield frame.iloc[a:b]
        rest = frame.iloc[starts[-1] :]
    if rest is not None and len(rest):
        yield rest
