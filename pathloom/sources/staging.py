"""Intermediates that several steps share, owned by a context that removes them.

Two kinds. ``shared`` marks a frame that is used more than once: nothing runs while a plan is built, the first action that
needs the frame keeps its rows on the executors' disks, and what a lost executor held is computed again from the
inputs. Equal plans share one copy. ``written`` writes a table in the folder that ``spark.checkpoint.dir`` names and goes
on from it; a manifest in that folder says what is complete, so a later job with the same root and the same plans
takes up the finished tables instead of writing them again.

    with Staging(spark) as staging:
        reports.band_vs_median(db, limits, staging).write.parquet(out)
    # nothing is left
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.joins import measured_bytes
from pathloom.session import shared_dir

_MANIFEST = "manifest"
_FIELDS = "name string, plan string, folder string, buckets int"


def fingerprint(df: DataFrame) -> str:
    """A digest of what a frame computes and from what: its optimised plan without the ids that differ from session to
    session, the files it reads and their size."""
    plan = df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    text = [re.sub(r"#\d+L?|plan_id=\d+", "#", plan), *sorted(df.inputFiles()), str(measured_bytes(df))]
    return hashlib.sha256("\n".join(text).encode()).hexdigest()


class Staging:
    """Owns shared frames and written tables below one root folder until ``close``."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.resumable = root is not None
        self.root = (root or f"{shared_dir(spark)}/staging_{uuid.uuid4().hex[:12]}").rstrip("/")
        self._shared: list[DataFrame] = []
        self._tables: list[str] = []
        self._done: dict[tuple[str, str], DataFrame] = {}

    _OF: dict[str, Staging] = {}

    @classmethod
    def of(cls, spark: SparkSession) -> Staging:
        """The staging that a session uses where none is named; ``close`` it when its results are no longer read."""
        app = spark.sparkContext.applicationId
        if app not in cls._OF:
            cls._OF[app] = cls(spark)
        return cls._OF[app]

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def shared(self, df: DataFrame) -> DataFrame:
        """``df``, computed once however often it is used. Builds no job."""
        for known in self._shared:
            if known.sameSemantics(df):
                return known
        self._shared.append(df.persist(StorageLevel.DISK_ONLY))
        return self._shared[-1]

    def written(self, df: DataFrame, name: str, bucket_by: str | None = None, sort_by: Sequence[str] = (),
                buckets: int | None = None, dealt: bool = False) -> DataFrame:
        """``df`` as a table of the root folder, written now unless a complete one with the same plan is there.

        With ``bucket_by`` the table is hash-bucketed, so later group-bys and joins on that column need no shuffle;
        ``sort_by`` inside the buckets gives the Parquet pages narrow ranges to skip by. ``dealt``: the rows already
        lie in ``buckets`` hash partitions of that column and need no exchange.
        """
        plan = fingerprint(df)
        if (name, plan) in self._done:
            return self._done[name, plan]
        n = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions")) if bucket_by else 0
        folder = self._finished(name, plan, n)
        if folder is None:
            folder = f"{name}_{uuid.uuid4().hex[:12]}"
            out = self._table(df, folder, bucket_by, sort_by, n, dealt)
            self._record(name, plan, folder, n)
        else:
            out = self._reread(df, folder, bucket_by, sort_by, n)
        self._done[name, plan] = out
        return out

    def _table(self, df, folder: str, bucket_by: str | None, sort_by: Sequence[str], n: int, dealt: bool) -> DataFrame:
        path = f"{self.root}/{folder}"
        if bucket_by is None:
            df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)
        spread = df if dealt else df.repartition(n, bucket_by)
        spread.write.option("path", path).bucketBy(n, bucket_by).sortBy(*(sort_by or (bucket_by,))).saveAsTable(folder)
        self._tables.append(folder)
        return self.spark.table(folder)

    def _reread(self, df, folder: str, bucket_by: str | None, sort_by: Sequence[str], n: int) -> DataFrame:
        path = f"{self.root}/{folder}"
        if bucket_by is None:
            return self.spark.read.schema(df.schema).parquet(path)
        if not self.spark.catalog.tableExists(folder):  # another session wrote it
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
            order = ", ".join(f"`{c}`" for c in sort_by or (bucket_by,))
            self.spark.sql(f"CREATE TABLE {folder} ({columns}) USING parquet CLUSTERED BY (`{bucket_by}`) "
                           f"SORTED BY ({order}) INTO {n} BUCKETS LOCATION '{path}'")
            self._tables.append(folder)
        return self.spark.table(folder)

    def _finished(self, name: str, plan: str, n: int) -> str | None:
        if not self.resumable or not self._exists(_MANIFEST):
            return None
        known = self.spark.read.schema(_FIELDS).json(f"{self.root}/{_MANIFEST}")
        row = known.where((F.col("name") == name) & (F.col("plan") == plan) & (F.col("buckets") == n)).first()
        return row and row["folder"]

    def _record(self, name: str, plan: str, folder: str, n: int) -> None:
        """A table enters the manifest only when it is complete."""
        if self.resumable:
            row = self.spark.range(1).select(*[F.lit(v).alias(c) for c, v in zip(
                ("name", "plan", "folder", "buckets"), (name, plan, folder, n))])
            row.write.mode("append").json(f"{self.root}/{_MANIFEST}")

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        files, path = self._path(name)
        return files.exists(path)

    def release(self) -> None:
        """Drop the rows of shared frames; written tables stay."""
        for df in self._shared:
            df.unpersist()
        self._shared = []

    def close(self, keep_files: bool = False) -> None:
        """Drop shared rows, forget the tables and remove their files, unless a later job is to take them up."""
        self.release()
        for table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables, self._done = [], {}
        if not keep_files:
            files, path = self._path()
            files.delete(path, True)

