"""Tables in buckets by key, with versions: a merge rewrites the buckets it touches, and readers see one version.

    path/data-<id>/bucket=<b>/...   files of one write, never changed
    path/versions/<n>.json          which files are version n, by bucket

A version is a file with a new number, which only one writer can make; who comes
second is told, and has changed nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import etl


class Conflict(RuntimeError):
    """Another writer has made the next version."""


class Versioned:
    """A table under ``path`` with unique, non-null ``keys``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> "Versioned":
        """Version 0 from ``df``, one row a key."""
        t = cls(df.sparkSession, path)
        base = {"keys": list(keys), "buckets": buckets, "schema": df.schema.json(), "files": {}}
        t._commit(0, base | {"files": t._write(df.withColumn("bucket", t._bucket(keys, buckets)))})
        return t

    # --- files

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._at(self.path).getFileSystem(self.conf)

    @staticmethod
    def _bucket(keys: Sequence[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        """The files of each bucket of ``rows``, which have a column ``bucket``."""
        data = f"{self.path}/data-{uuid.uuid4().hex}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(data)
        fs, out = self._fs(), {}
        for d in fs.listStatus(self._at(data)):
            name = d.getPath().getName()
            if name.startswith("bucket="):
                out[name.removeprefix("bucket=")] = [str(f.getPath()) for f in fs.listStatus(d.getPath()) if f.getPath().getName().endswith(".parquet")]
        return out

    def _commit(self, n: int, manifest: dict) -> None:
        """The manifest as version ``n``: whole under another name first, then renamed, which fails if the version is there."""
        fs, name = self._fs(), f"{self.path}/versions/{n:08d}.json"
        part = self._at(f"{self.path}/versions/_{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(part, self._at(name), self.spark.sparkContext._gateway.new_array(options, 0))
        except Exception as e:
            if "AlreadyExists" in str(e):
                fs.delete(part, False)
                raise Conflict(name) from e
            raise

    # --- versions

    def latest(self) -> int:
        return max(int(s.getPath().getName()[:8]) for s in self._fs().listStatus(self._at(f"{self.path}/versions")) if not s.getPath().getName().startswith(("_", ".")))

    def manifest(self, version: int | None = None) -> dict:
        n = self.latest() if version is None else version
        stream = self._fs().open(self._at(f"{self.path}/versions/{n:08d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"version": n}
        finally:
            stream.close()

    def _files(self, m: Mapping, buckets: Sequence[str] | None = None) -> DataFrame:
        files = [f for b, fs in m["files"].items() if buckets is None or b in buckets for f in fs]
        schema = StructType.fromJson(json.loads(m["schema"]))
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The latest version, or the one asked for; what is merged later is not in it."""
        return self._files(self.manifest(version))

    def merge(self, changes: DataFrame, order: str, combine: Callable[[str, Column, Column], Column] | None = None) -> dict[str, int]:
        """The latest of ``changes`` by ``order`` for each key, set or added, as the next version.

        ``combine`` makes a column of a key that was there from its old and its
        new value (else the new one). Tells the buckets and files rewritten.
        Only buckets that have a change are read.
        """
        m = self.manifest()
        keys, schema = m["keys"], StructType.fromJson(json.loads(m["schema"]))
        latest = etl.keep_first(changes, keys, [F.desc(order)]).withColumn("bucket", self._bucket(keys, m["buckets"]))
        kept = f"{self.path}/changes-{uuid.uuid4().hex}"
        latest.select(*schema.names, "bucket").write.parquet(kept)
        latest = self.spark.read.parquet(kept)
        touched = [str(r["bucket"]) for r in latest.select("bucket").distinct().collect()]  # as many as there are buckets, at most
        old = self._files(m, touched)
        if combine is None:
            rows = etl.upsert(old.withColumn("bucket", self._bucket(keys, m["buckets"])), latest.withColumn("v_", F.lit(0)), keys, "v_")
        else:
            rest = [c for c in schema.names if c not in keys]
            both = old.select(*keys, F.lit(1).alias("o_"), *(F.col(c).alias(f"o_{c}") for c in rest)).join(latest.select(*keys, F.lit(1).alias("n_"), *(F.col(c).alias(f"n_{c}") for c in rest)), keys, "full_outer")
            pick = lambda c: F.when(F.col("n_").isNull(), F.col(f"o_{c}")).when(F.col("o_").isNull(), F.col(f"n_{c}")).otherwise(combine(c, F.col(f"o_{c}"), F.col(f"n_{c}")))
            rows = both.select(*keys, *(pick(c).alias(c) for c in rest)).select(*schema.names).withColumn("bucket", self._bucket(keys, m["buckets"]))
        new = self._write(rows) if touched else {}
        self._commit(m["version"] + 1, {k: m[k] for k in ("keys", "buckets", "schema")} | {"files": m["files"] | new})
        self._fs().delete(self._at(kept), True)
        return {"buckets": len(touched), "files": sum(map(len, new.values())), "of": m["buckets"]}
