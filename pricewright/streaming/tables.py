"""A keyed Parquet table that is rewritten bucket by bucket.

Rows lie in hash buckets of their key. A commit writes new files for the
buckets it touches into a folder of its own version and then one small pointer
table that names the version of every bucket; readers follow the newest
finished pointer. So a commit costs what its buckets hold, never the whole
table, a broken one leaves the table as it was, and one that is repeated after
a restart is recognised by its stream and batch number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "bucket int, version long, stream string, batch long"


class BucketTable:
    """``buckets`` should make one bucket about as large as one task can write; the pointer has as many rows."""

    def __init__(self, spark: SparkSession, path: str, key: Callable[[], Column], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _folder(self, kind: str, version: int) -> str:
        return f"{self.path}/{kind}/v={version:010d}"

    def versions(self) -> list[int]:
        """Numbers of the finished pointers."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.path}/pointer")
        fs = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(folder):
            return []
        done = [s.getPath() for s in fs.listStatus(folder) if fs.exists(hadoop.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def pointer(self) -> tuple[int, dict[int, int], tuple[str, int]]:
        """(version, version of each bucket, (stream, batch) that made it)."""
        versions = self.versions()
        if not versions:
            return 0, {}, ("", -1)
        rows = self.spark.read.schema(POINTER).parquet(self._folder("pointer", versions[-1])).collect()  # a row a bucket
        made = next((r for r in rows if r.bucket < 0), None)
        return (versions[-1], {r.bucket: r.version for r in rows if r.bucket >= 0},
                (made.stream, made.batch) if made else ("", -1))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key()), F.lit(self.buckets)).cast("int")

    def read(self, only: set[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets; None where nothing was written there."""
        _, at, _ = self.pointer()
        paths = [f"{self._folder('data', v)}/bucket={b}" for b, v in sorted(at.items()) if only is None or b in only]
        return self.spark.read.parquet(*paths) if paths else None

    def side(self, name: str) -> DataFrame | None:
        """A small table that was committed together with the newest version."""
        version, _, _ = self.pointer()
        return self.spark.read.parquet(self._folder(name, version)) if version else None

    def commit(self, rows: DataFrame, merge: Callable[[DataFrame], DataFrame], stream: str, batch: int,
               sides: dict[str, DataFrame] | None = None) -> set[int]:
        """Merge rows into their buckets; the buckets that were rewritten. ``rows`` is read twice and
        should be stored. ``sides`` replace the tables of those names under the same version."""
        version, at, made = self.pointer()
        if made[0] == stream and made[1] >= batch:
            return set()
        new = version + 1
        touched = {r.bucket for r in rows.select(self.bucket().alias("bucket")).distinct().collect()}
        if touched:
            old = self.read(touched)
            merged = merge(old.unionByName(rows, allowMissingColumns=True) if old is not None else rows)
            (merged.withColumn("bucket", self.bucket()).repartition("bucket")
             .write.mode("overwrite").partitionBy("bucket").parquet(self._folder("data", new)))
        for name, side in (sides or {}).items():
            side.write.mode("overwrite").parquet(self._folder(name, new))
        self._point(new, {**at, **dict.fromkeys(touched, new)}, stream, batch)
        return touched

    def _point(self, version: int, at: dict[int, int], stream: str, batch: int) -> None:
        rows = [(b, v, None, None) for b, v in at.items()] + [(-1, version, stream, batch)]
        (self.spark.createDataFrame(rows, POINTER).coalesce(1)
         .write.mode("overwrite").parquet(self._folder("pointer", version)))
