"""Snapshot store (S11): whole generations, a history and the latest snapshot per url.

::

    path/generations/gen=000000000012/   one file: the runs that make up the store
    path/runs/history-…                  snapshots as they were taken
    path/runs/latest-…                   latest snapshot per url, bucketed and sorted by url

``append`` adds one run of each kind and then commits a generation, whose single file
is renamed into place; so a reader sees the store before or after a batch, never
between, and what an ended writer left behind belongs to no generation.  There is one
writer at a time (a generation that exists already is an error).

Runs of a kind are merged once a run has at most twice the rows of the one after it, so
n batches leave about log n runs and every row is rewritten about log n times.  The
latest runs are bucketed by url: ``join_latest`` deals the new rows by url and reads the
stored side in place, without an exchange, and what it reads is the pages known, not
their history.

Rows need ``url``, ``snapshot_ts`` and ``page_id``; other columns are kept as they are.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64   # of the latest runs; a store keeps the number it was made with
RUNS = "kind string, folder string, n_rows long, buckets int, place int, by string"


class Run(NamedTuple):
    kind: str      # history or latest
    folder: str
    n_rows: int
    buckets: int
    place: int     # order of age
    by: str        # batch that committed the generation


class Generation(NamedTuple):
    number: int
    by: str | None
    runs: list[Run]


EMPTY = Generation(0, None, [])


def newest(rows: DataFrame, key: str = "url") -> DataFrame:
    """The newest row per key (``max_by``: combined before the shuffle)."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("snapshot_ts", "page_id")).alias("_s")).select(
        *[key if c == key else F.col(f"_s.{c}").alias(c) for c in rows.columns])


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # --- generations -------------------------------------------------------
    def _names(self, folder: str) -> list[str]:
        """Names in a folder of the store; none if it is missing."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _remove(self, name: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def numbers(self) -> list[int]:
        """Committed generations, oldest first: their file has its final name."""
        found = sorted(int(n[4:]) for n in self._names("generations") if n.startswith("gen="))
        return [n for n in found if any(f.startswith("part-") for f in self._names(f"generations/gen={n:012d}"))]

    def generation(self, number: int | None = None) -> Generation:
        """The newest generation (or a given one); ``EMPTY`` for a store without any.  A
        generation that cannot be read is an error, not an empty store."""
        if number is None:
            numbers = self.numbers()
            if not numbers:
                return EMPTY
            number = numbers[-1]
        rows = self.spark.read.schema(RUNS).parquet(f"{self.path}/generations/gen={number:012d}").collect()   # about log n
        runs = sorted((Run(*r) for r in rows), key=lambda r: (r.kind, r.place))
        return Generation(number, runs[0].by, [r for r in runs if r.folder])

    def before(self, batch: str) -> Generation:
        """The generation that ``batch`` builds on: the newest one of another batch.  Only the
        batch that came last can be repeated."""
        numbers = self.numbers()
        for n in reversed(numbers):
            g = self.generation(n)
            if g.by != batch:
                return g
        return EMPTY

    # --- reading -----------------------------------------------------------
    def _read(self, run: Run) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/runs/{run.folder}")

    def _in_buckets(self, run: Run) -> DataFrame:
        """A latest run as the bucketed table it is.  Only for joins: in a union of such tables Spark
        4.1 takes equal buckets for one partitioning and leaves equal urls apart."""
        folder, name = f"{self.path}/runs/{run.folder}", run.folder.replace("-", "_")
        if not self.spark.catalog.tableExists(name):   # another session wrote it: its buckets must be declared
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(folder).schema)
            self.spark.sql(f"CREATE TABLE `{name}` ({columns}) USING parquet CLUSTERED BY (url) SORTED BY (url) "
                           f"INTO {run.buckets} BUCKETS LOCATION '{folder}'")
        return self.spark.table(name)

    def _union(self, kind: str, g: Generation | None) -> DataFrame | None:
        out = None
        for r in (self.generation() if g is None else g).runs:
            if r.kind == kind:
                out = self._read(r) if out is None else out.unionByName(self._read(r))
        return out

    def history(self, g: Generation | None = None) -> DataFrame | None:
        """All snapshots of a generation (default: the newest); None for an empty store."""
        return self._union("history", g)

    def latest(self, g: Generation | None = None) -> DataFrame | None:
        """M04 on the store: the newest snapshot per url."""
        rows = self._union("latest", g)
        return None if rows is None else newest(rows)

    def join_latest(self, rows: DataFrame, g: Generation | None = None, out: str = "_old") -> DataFrame:
        """``rows`` with the stored latest snapshot of their url as a struct (null: none).  The runs
        are joined one by one, each in its buckets; of several the newest snapshot counts."""
        g = self.generation() if g is None else g
        runs = [r for r in g.runs if r.kind == "latest"]
        if not runs:
            return rows.withColumn(out, F.when(F.lit(False), F.struct(*[c for c in rows.columns if c != "url"])))
        rows = rows.repartition(runs[0].buckets, "url")
        names = []
        for k, run in enumerate(runs):
            kept = self._in_buckets(run)
            first = ["snapshot_ts", "page_id"]
            rest = [c for c in kept.columns if c not in ("url", *first)]
            rows = rows.join(kept.select("url", F.struct(*first, *rest).alias(f"_run{k}")), "url", "left")
            names.append(f"_run{k}")
        best = F.col(names[0])
        for n in names[1:]:   # (time, page) decide
            key = lambda c: F.struct(c["snapshot_ts"], c["page_id"])
            best = F.when(best.isNull() | (F.col(n).isNotNull() & (key(F.col(n)) > key(best))), F.col(n)).otherwise(best)
        return rows.withColumn(out, best).drop(*names)

    # --- writing -----------------------------------------------------------
    def _write(self, kind: str, rows: DataFrame) -> str:
        folder = f"{kind}-{uuid.uuid4().hex}"
        if kind == "history":
            rows.write.parquet(f"{self.path}/runs/{folder}")
        else:
            (rows.repartition(self.buckets, "url").write.bucketBy(self.buckets, "url").sortBy("url")
             .option("path", f"{self.path}/runs/{folder}").format("parquet").saveAsTable(folder.replace("-", "_")))
        return folder

    def _merged(self, kind: str, runs: list[Run], by: str) -> list[Run]:
        """Runs of a kind, oldest first, with the last ones merged while they are alike in size."""
        n = 1
        while n < len(runs) and runs[-n - 1].n_rows <= 2 * sum(r.n_rows for r in runs[-n:]):
            n += 1
        if n == 1:
            return runs
        rows = self._read(runs[-n])
        for r in runs[len(runs) - n + 1:]:
            rows = rows.unionByName(self._read(r))
        folder = self._write(kind, newest(rows) if kind == "latest" else rows)
        size = self.spark.read.parquet(f"{self.path}/runs/{folder}").count()
        return [*runs[:-n], Run(kind, folder, size, self.buckets, runs[-n].place, by)]

    def append(self, snapshots: DataFrame, batch: str | None = None) -> Generation:
        """Adds the snapshots of a batch and commits a generation.  A batch that is repeated builds on
        the generation before it, so its rows are in the store once."""
        batch = uuid.uuid4().hex if batch is None else str(batch)
        base, numbers = self.before(batch), self.numbers()
        known = [r.buckets for r in base.runs if r.kind == "latest"]
        if known:
            self.buckets = known[0]
        runs, place = [], max([r.place for r in base.runs], default=0) + 1
        for kind, rows in (("history", snapshots), ("latest", newest(snapshots))):
            folder = self._write(kind, rows)
            size = self.spark.read.schema(snapshots.schema).parquet(f"{self.path}/runs/{folder}").count()
            old = [r for r in base.runs if r.kind == kind]
            runs += self._merged(kind, [*old, Run(kind, folder, size, self.buckets, place, batch)] if size else old, batch)
        rows = [r._replace(by=batch) for r in runs] or [Run("none", "", 0, self.buckets, 0, batch)]
        number = (numbers[-1] if numbers else 0) + 1
        self.spark.createDataFrame(rows, RUNS).coalesce(1).write.mode("errorifexists").parquet(
            f"{self.path}/generations/gen={number:012d}")
        return self.generation(number)

    def expire(self) -> None:
        """Removes generations that neither readers of now nor a repeated batch need (the newest, and the
        newest of another batch stay) and runs that no kept generation names.  Readers that
        started on an older generation lose its files, so call it when none can be left."""
        numbers = self.numbers()
        if not numbers:
            return
        last = self.generation(numbers[-1])
        before = self.before(last.by)
        keep = {last.number, before.number}
        named = {r.folder for g in (last, before) for r in g.runs}
        for n in numbers:
            if n not in keep:
                self._remove(f"generations/gen={n:012d}")
        for folder in self._names("runs"):
            if folder not in named:
                self.spark.sql(f"DROP TABLE IF EXISTS `{folder.replace('-', '_')}`")
                self._remove(f"runs/{folder}")
