"""Keyed state of the stream as Parquet runs: hashed into key buckets, merged in generations.

Every batch writes what it changes as one run (overwritten when the batch is retried). Before a batch starts,
the newest ``fan`` runs of one generation are merged into one run of the next, so that n batches leave
about ``fan`` * log(n) runs and a row is rewritten once a generation. A run counts from the moment its
``_SUCCESS`` file stands: until then readers see the runs it is made of, so a crash while merging loses
nothing. A batch reads only the buckets of its own keys. Runs that were merged are deleted one batch
later, never those of the running batch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import sorted_join

RUN = re.compile(r"^run=r(\d+)-(\d+)-(\d+)$")


@dataclass(frozen=True)
class Run:
    generation: int
    first: int  # batches first to last are in it
    last: int

    @property
    def name(self) -> str:
        return f"run=r{self.generation}-{self.first}-{self.last}"


@dataclass
class KeyedState:
    """Rows of ``schema`` plus batch_id, the batch that wrote them.

    ``merge`` leaves of several versions of a key the one that counts (it must not matter whether
    versions are merged at once or step by step); ``keep`` names the rows that a merge with nothing older
    below it still needs.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    key: list[str]  # the columns whose hash is the bucket
    merge: Callable[[DataFrame], DataFrame] = lambda rows: rows
    keep: Column | None = None
    buckets: int = 16
    fan: int = 8

    def _files(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _child(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _stored(self) -> list[Run]:
        folder, files = self._files()
        if not files.exists(folder):
            return []
        found = (RUN.match(s.getPath().getName()) for s in files.listStatus(folder))
        return [Run(*map(int, m.groups())) for m in found if m]

    def runs(self, before: int) -> list[Run]:
        """The complete runs of batches before ``before``, less those that a larger one holds, oldest first."""
        _, files = self._files()
        picked: list[Run] = []
        for run in sorted((r for r in self._stored() if r.last < before), key=lambda r: (r.first, -r.last, -r.generation)):
            if (not picked or run.last > picked[-1].last) and files.exists(self._child(run.name, "_SUCCESS")):
                picked.append(run)
        return picked

    def bucket(self) -> Column:
        """The bucket of a row by its key columns."""
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _load(self, runs: list[Run], buckets: list[int] | None) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("batch_id", T.LongType())])
        _, files = self._files()
        inside = "bucket=*" if buckets is None else f"bucket={{{','.join(map(str, buckets))}}}"
        paths = [s.getPath().toString() for r in runs for s in files.globStatus(self._child(r.name, inside)) or ()] if buckets != [] else []
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*paths).select(*schema.fieldNames())

    def _save(self, rows: DataFrame, run: Run) -> None:
        _, files = self._files()
        if not files.exists(self._child("_schema", "_SUCCESS")):
            self.spark.createDataFrame([(self.schema.json(),)], "value string").write.mode("overwrite").text(f"{self.path}/_schema")
        out = rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
        out.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{run.name}")

    def read(self, before: int, keys: DataFrame | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The merged rows that batches before ``before`` left; with ``keys`` (the key columns), only theirs.

        ``buckets`` are the keys' buckets where the caller knows them (``buckets_of``).
        """
        runs = self.runs(before)
        if keys is not None:
            keys = keys.select(*self.key).distinct()
            if runs and buckets is None:
                buckets = buckets_of(keys, [self])[0]
        rows = self._load(runs, buckets)
        if keys is not None:
            rows = rows.join(sorted_join(keys), self.key, "left_semi").select(*rows.columns)
        return self.merge(rows) if len(runs) > 1 else rows

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """What a batch adds or changes."""
        self._save(rows.withColumn("batch_id", F.lit(batch_id).cast("long")), Run(0, batch_id, batch_id))

    def compact(self, before: int, keep: Column | None = None) -> None:
        """Merge full generations of batches before ``before``; delete what an earlier call has merged."""
        runs = self.runs(before)
        _, files = self._files()
        for run in self._stored():
            if run.last < before and run not in runs:
                files.delete(self._child(run.name), True)
        keeps = [k for k in (self.keep, keep) if k is not None]
        while len(runs) >= self.fan and len({r.generation for r in runs[-self.fan :]}) == 1:
            old = runs[-self.fan :]
            rows = self.merge(self._load(old, None))
            if len(old) == len(runs):
                for k in keeps:
                    rows = rows.where(k)
            new = Run(old[0].generation + 1, old[0].first, old[-1].last)
            self._save(rows, new)
            runs = [*runs[: -self.fan], new]


def buckets_of(keys: DataFrame, states: list[KeyedState]) -> list[list[int]]:
    """For each state the buckets that rows of ``keys`` fall into, by one aggregate (at most all buckets each)."""
    row = keys.agg(*[F.collect_set(s.bucket()).alias(f"b{k}") for k, s in enumerate(states)]).first()
    return [sorted(b) for b in row]


def stored_schema(spark: SparkSession, path: str) -> T.StructType:
    """The schema that the state under ``path`` was first written with."""
    return T.StructType.fromJson(json.loads(spark.read.text(f"{path}/_schema").first()[0]))


def newest(key: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Of the versions of a key the one written last."""

    def merge(rows: DataFrame) -> DataFrame:
        # a window, unlike an aggregate of whole rows, shuffles only the columns that are read behind it
        last = Window.partitionBy(*key).orderBy(F.desc("batch_id"))
        return rows.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")

    return merge


def least(key: list[str], by: str) -> Callable[[DataFrame], DataFrame]:
    """Of the versions of a key the one with the smallest ``by``."""

    def merge(rows: DataFrame) -> DataFrame:
        first = rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), by).alias("_r"))
        return first.select("_r.*")

    return merge
