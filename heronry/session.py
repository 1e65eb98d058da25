"""Session settings and tables in the shared scratch folder.

Iterative operators cut their lineage by writing a table to the folder named in
``spark.checkpoint.dir``: it is shared, so a lost executor costs only its running tasks.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OPEN: list = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set (tests, one machine)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="heronry-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so they need no copy of the repository."""
    sc = spark.sparkContext
    if getattr(sc, "_heronry_shipped", False):
        return
    package = Path(__file__).resolve().parent
    fd, at = tempfile.mkstemp(prefix="heronry-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(at)
    sc._heronry_shipped = True


class Scratch:
    """Tables of one operator run under the shared folder.

    What a query returns may still read them, so they live until ``close`` (or the end of a ``with`` block), ``sweep`` or the
    end of the application, whichever comes first; tables that nothing reads any more are dropped on the way."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.label = label
        self.root = f"{shared_dir(spark)}/heronry/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._tables: list[str] = []
        _OPEN.append(self)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return it read back, free of its lineage."""
        where = self.path(name)
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._scratch_path = where
        return out

    def save_bucketed(self, df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
        """Write df hash-bucketed and sorted by keys: joins on the keys then need no exchange."""
        where = self.path(name)
        table = f"heronry_{name}_{uuid.uuid4().hex}"
        (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
         .option("path", where).format("parquet").saveAsTable(table))
        self._tables.append(table)
        out = self.spark.table(table)
        out._scratch_path = where
        return out

    def files(self, where: str):
        """(file system, path) of a place in the shared folder."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def drop(self, *tables: DataFrame | str) -> None:
        """Delete tables of save(), or folders, that nothing reads any more."""
        for t in tables:
            where = t if isinstance(t, str) else getattr(t, "_scratch_path", None)
            if where:
                fs, p = self.files(where)
                fs.delete(p, True)

    def close(self) -> None:
        """Delete all that this run wrote, and its entries in the catalogue."""
        for t in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self._tables.clear()
        self.drop(self.root)
        if self in _OPEN:
            _OPEN.remove(self)


def sweep(spark: SparkSession) -> None:
    """Delete the tables of all runs of this application whose results have been read."""
    for s in [s for s in _OPEN if s.spark is spark or s.spark.sparkContext is spark.sparkContext]:
        s.close()


@atexit.register
def _at_end() -> None:
    for s in list(_OPEN):
        try:
            s.close()
        except Exception:  # noqa: BLE001  the session may be gone already
            _OPEN.clear()
            return


class BucketTable:
    """Rows by key in a fixed number of bucket folders. An update reads and rewrites the buckets of its keys and no others;
    the driver keeps the folders of each bucket, a table of ``buckets`` entries. A bucket that was appended to often is
    written anew as one folder."""

    MOST_FOLDERS = 16

    def __init__(self, scratch: Scratch, name: str, keys: list[str], schema: str, buckets: int | None = None):
        self.scratch, self.name, self.keys, self.schema = scratch, name, keys, schema
        self.buckets = buckets or max(1, int(scratch.spark.conf.get("spark.sql.shuffle.partitions")))
        self.folders: dict[int, list[str]] = {}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, *deltas: DataFrame) -> list[int]:
        """The buckets that rows with the key columns fall into, at most ``buckets`` numbers."""
        return sorted({r[0] for d in deltas for r in d.select(self.bucket()).distinct().collect()})

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of some buckets, of all if none are named."""
        folders = [f for b in (sorted(self.folders) if buckets is None else buckets) for f in self.folders.get(b, [])]
        return self.scratch.spark.read.schema(self.schema).parquet(*folders) if folders else self.scratch.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame) -> dict[int, str]:
        where = self.scratch.path(self.name)
        names = self.scratch.spark.createDataFrame([], self.schema).columns
        rows.select(*names).withColumn("_bucket", self.bucket()).repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(where)
        fs, p = self.scratch.files(where)
        found = [str(x.getPath().getName()) for x in fs.listStatus(p)]
        return {int(n.split("=")[1]): f"{where}/{n}" for n in found if n.startswith("_bucket=")}

    def append(self, rows: DataFrame) -> None:
        for b, folder in self._write(rows).items():
            self.folders.setdefault(b, []).append(folder)
        many = [b for b, f in self.folders.items() if len(f) > self.MOST_FOLDERS]
        if many:
            self.replace(self.read(many), many)

    def replace(self, rows: DataFrame, buckets: list[int]) -> None:
        """Put rows in the place of all that ``buckets`` held; the rows may be read from them."""
        fresh, old = self._write(rows), [f for b in buckets for f in self.folders.pop(b, [])]
        self.folders |= {b: [f] for b, f in fresh.items()}
        self.scratch.drop(*old)
