"""Sources and sinks."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def aliased(df: DataFrame, names: Mapping[str, Sequence[str]], most: int | None = None) -> DataFrame:
    """Columns under one name from whichever of several names a source has: the first that is not empty."""
    have = set(df.columns)
    cols = []
    for out, options in names.items():
        found = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in options if c in have]
        cols.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(out))
    df = df.select(*cols)
    return df if most is None else df.limit(most)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; bytes that are no UTF-8 become the replacement character."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def in_memory(spark: SparkSession, rows: Sequence[Mapping], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(f.name) for f in T._parse_datatype_string(schema).fields) for r in rows], schema)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows by schema, and in ``_bad`` what is no such row."""
    return spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def lookup(ids: DataFrame, docs: DataFrame, key: str, place: str = "place") -> DataFrame:
    """Rows of the ids asked for, each with its place in the request."""
    return ids.select(key, place).join(docs, key, "inner")


def without(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def sample(df: DataFrame, n: int, key: str) -> DataFrame:
    """The first ``n`` rows by a hash of the key: the same rows each time."""
    return df.orderBy(F.xxhash64(key), key).limit(n)


# The sites that a web search is kept to.
SITES = ["thuvienphapluat.vn", "luatvietnam.vn", "phapluat.suckhoedoisong.vn", "baophapluat.vn", "phapluat.tuoitre.vn"]
WEB = "query string, title string, url string, snippet string"


def web_search(spark: SparkSession, queries: Sequence[str] = (), search: Callable[[str], Sequence[Mapping]] | None = None, sites: Sequence[str] = tuple(SITES), cache: dict | None = None, ttl: float = 3600.0, now: Callable[[], float] = time.time) -> DataFrame:
    """(query, title, url, snippet) of what ``search`` finds for each query on the sites, or a part of them.

    ``search`` gets the query with the sites it is kept to, and gives rows with
    title, url and snippet; without one (no network) there are no rows.
    ``cache`` keeps what was found for ``ttl`` seconds.
    """
    rows: list[dict] = []
    held = {} if cache is None else cache
    for q in queries if search else ():
        key = (q, tuple(sites))
        if key not in held or now() - held[key][0] >= ttl:
            held[key] = (now(), list(search(f"({q}) ({' OR '.join('site:' + s for s in sites)})")))
        hosts = lambda url: (urlsplit(url).hostname or "").removeprefix("www.")
        rows += [{"query": q, "title": r["title"], "url": r["url"], "snippet": r["snippet"]} for r in held[key][1] if any(hosts(r["url"]) == s or hosts(r["url"]).endswith("." + s) for s in sites)]
    return spark.createDataFrame(rows, WEB)


def cached(spark: SparkSession, source: str, cache: str) -> DataFrame:
    """A Parquet table read by way of a copy: files that the cache has in full are not copied again; a broken copy is made anew."""
    fs, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    src, dst = fs.Path(source), fs.Path(cache)
    a, b = src.getFileSystem(conf), dst.getFileSystem(conf)
    b.mkdirs(dst)
    files = [src] if a.getFileStatus(src).isFile() else [s.getPath() for s in a.listStatus(src) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    for f in files:
        copy = fs.Path(dst, f.getName())
        if not (b.exists(copy) and b.getFileStatus(copy).getLen() == a.getFileStatus(f).getLen()):
            part = fs.Path(dst, "_" + f.getName())  # whole before it has its name
            fs.FileUtil.copy(a, f, b, part, False, True, conf)
            b.delete(copy, False)
            b.rename(part, copy)
    return spark.read.parquet(cache)


# --- sinks


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table's files; one that is not there stays so."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, folder: str, name: str = "cut") -> DataFrame:
    """Write ``df`` under a folder that all executors share, and read it back: what is used more than once is worked out once."""
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(source: DataFrame, folder: str, name: str, made_of: str, make: Callable[[str], None]) -> str:
    """The path of what ``make`` wrote from ``source``: made once for the files that ``source`` reads, and found by all later calls.

    The name holds a digest of these files with their sizes and times, and of
    ``made_of``, so that a changed table gets a new one. It is whole before it
    has its name; of two that are made at once, one stays.
    """
    spark = source.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files = source.inputFiles()
    named, folders = {f.rpartition("/")[2] for f in files}, {f.rpartition("/")[0] for f in files}
    told = sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for d in folders for s in at(d).getFileSystem(conf).listStatus(at(d)) if s.getPath().getName() in named)
    path = f"{folder.rstrip('/')}/{name}-{hashlib.sha256(chr(10).join([*told, made_of]).encode()).hexdigest()[:32]}"
    store = at(path).getFileSystem(conf)
    if not store.exists(at(path)):
        part = f"{folder.rstrip('/')}/_{name}-{uuid.uuid4().hex}"
        make(part)
        if store.exists(at(path)) or not store.rename(at(part), at(path)):
            drop(spark, part)
    return path


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def bucketed(df: DataFrame, table: str, n: int, *keys: str) -> None:
    """A table whose joins and aggregations by the keys need no shuffle."""
    df.write.mode("overwrite").bucketBy(n, *keys).sortBy(*keys).saveAsTable(table)


def events(df: DataFrame, order: Sequence[Column | str]) -> Iterator[dict]:
    """Rows one by one, in order, a partition at a time."""
    for row in df.orderBy(*order).toLocalIterator():
        yield row.asDict(recursive=True)


class Checkpoint:
    """Which ids a run has processed or failed, as a table of appended files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self) -> DataFrame:
        schema = "id string, state string, at timestamp"
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def mark(self, ids: DataFrame, key: str, state: str = "processed") -> None:
        ids.select(F.col(key).cast("string").alias("id"), F.lit(state).alias("state"), F.current_timestamp().alias("at")).write.mode("append").parquet(self.path)

    def state(self) -> DataFrame:
        """(id, state): the latest of each id."""
        w = Window.partitionBy("id").orderBy(F.desc("at"), "state")
        return self.load().withColumn("r_", F.row_number().over(w)).where("r_ = 1").select("id", "state")

    def todo(self, rows: DataFrame, key: str) -> DataFrame:
        done = self.load().where("state = 'processed'").select(F.col("id").alias("done_")).distinct()
        return rows.join(done, F.col(key).cast("string") == F.col("done_"), "left_anti")
