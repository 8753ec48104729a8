"""Helpers shared by the operators: durable cuts of lineage and sizes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


OFTEN, MOST_HOT = 1000, 10_000  # rows from which a key is hot, at least, and how many hot keys there can be


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or set on the context. Without one there is no folder that all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and re.match(r"local(\[|$)", spark.sparkContext.master):  # one process, as in tests
        named = "file://" + os.path.join(tempfile.gettempdir(), f"corvid-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(named)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The table replaces the lineage: a lost executor costs a re-read, not a
    recomputation, and non-deterministic columns (row numbers, range
    partitions) keep the values they were written with.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def uncut(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`cut`."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if parent.startswith(shared_dir(spark)) or parent.replace("file://", "file:").startswith(
            shared_dir(spark).replace("file://", "file:")
        ):
            p = jvm.org.apache.hadoop.fs.Path(parent)
            p.getFileSystem(conf).delete(p, True)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """``rows`` inner-joined with ``table``, which has each key once, and in ``n`` how many rows have it.

    Keys that very many rows have are few (at most MOST_HOT, as each has more than
    a MOST_HOT-th of the rows), and are joined where the rows are; none of them
    is all in one task.
    """
    found = table.agg(F.sum(n), F.max(n)).first()
    often = max(OFTEN, (found[0] or 0) // MOST_HOT)
    if (found[1] or 0) <= often:
        return rows.join(table.drop(n), keys)
    hot = table.where(F.col(n) > often).drop(n)
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    rest = marked.where("`__hot` is null").select(*rows.columns).join(table.where(F.col(n) <= often).drop(n), keys)
    return marked.where("`__hot`").drop("__hot").unionByName(rest)


def free(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches, rows: int = 512):
    """Arrow batches in smaller ones, so that few texts are held as Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


MOST_BROADCAST_IDS = 1_000_000  # ids that are sent to all executors, at most


def without_ids(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose key is not in ``ids`` (one column, null for null). Texts stay where they are if a count shows the ids few."""
    name = free(docs, "gone_")
    gone = cut(ids.toDF(name).distinct(), "gone")
    few = gone.count() <= MOST_BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs[key].eqNullSafe(gone[name]), "left_anti")
