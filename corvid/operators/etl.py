"""Preparing, merging and checking tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# --- predicates


def compile_filter(spec: Mapping[str, Any]) -> Column:
    """A predicate from {column: value, list of values, or {gt, gte, lt, lte: bound}}; all must hold."""
    ops = {"gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}

    def one(name: str, value: Any) -> Column:
        c = F.col(name)
        if isinstance(value, Mapping):
            unknown = set(value) - set(ops)
            if unknown:
                raise ValueError(f"unknown bounds for {name}: {sorted(unknown)}")
            return reduce(and_, (ops[k](c, F.lit(v)) for k, v in value.items()), F.lit(True))
        if isinstance(value, (list, tuple, set)):
            return c.isin(*value)
        return c == F.lit(value)

    return reduce(and_, (one(k, v) for k, v in spec.items()), F.lit(True))


def any_in(array: Column, values: Sequence[Any]) -> Column:
    """Whether an array column has one of the values."""
    return F.arrays_overlap(array, F.array(*map(F.lit, values)))


def optional(value: Any, predicate) -> Column:
    """The predicate of the value, or true where no value is given."""
    return F.lit(True) if value is None else predicate(value)


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def long_enough(c: Column, least: int = 50) -> Column:
    """Texts of at least so many characters without the white space around them."""
    return F.length(F.trim(c)) >= least


def length_bucket(n: Column, bounds: Sequence[tuple[int, str]], last: str) -> Column:
    """The name of the first bound above ``n``."""
    out = None
    for bound, name in bounds:
        out = F.when(n < bound, name) if out is None else out.when(n < bound, name)
    return F.lit(last) if out is None else out.otherwise(last)


def validated(rows: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reasons``); a rule that gives null is broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))
    marked = rows.withColumn("reasons", broken)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


# --- keeping rows


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row for each key: the first in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``target`` with the latest change of each key; rows without one stay as they are.

    Tables are files: the merge is a rewrite, of which an anti-join moves keys only for what stays.
    """
    latest = keep_first(changes, keys, [F.desc(order)])
    return target.join(latest.select(*keys), list(keys), "left_anti").unionByName(latest.select(*target.columns))


def insert_new(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows to append: distinct by key, and not in the target."""
    return rows.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")


def delete_ids(target: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return target.join(ids.select(key), key, "left_anti")


def merge_json(c: Column, **values: Column) -> Column:
    """A JSON object with keys set; what is no object counts as an empty one."""
    old = F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    new = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string"))))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, v: ~k.isin(*values)), new))


def parse_json(c: Column, schema: str) -> Column:
    """A JSON text by schema; null where it is no JSON."""
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})


def resume(rows: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Rows that no earlier run has processed."""
    return rows.join(processed.select(key).distinct(), key, "left_anti")


def prepare(meta: DataFrame, content: DataFrame, key: str, text: str, order: Sequence[Column | str], least: int = 50) -> DataFrame:
    """Content with its metadata: one row of each key, texts that are long enough."""
    return keep_first(content, [key], order).where(long_enough(F.col(text), least)).join(meta, key, "inner")


def valid_edges(edges: DataFrame, nodes: DataFrame, key: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges of which both ends are nodes."""
    n = nodes.select(F.col(key).alias("n_")).distinct()
    return edges.join(n, F.col(src) == F.col("n_"), "left_semi").join(n, F.col(dst) == F.col("n_"), "left_semi")


def orphan_edges(edges: DataFrame, nodes: DataFrame, key: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges of which an end is no node: two anti-joins, so that neither becomes a nested loop."""
    n = nodes.select(F.col(key).alias("n_")).distinct()
    no_src = edges.join(n, F.col(src) == F.col("n_"), "left_anti")
    no_dst = edges.join(n, F.col(src) == F.col("n_"), "left_semi").join(n, F.col(dst) == F.col("n_"), "left_anti")
    return no_src.unionByName(no_dst)


# --- statistics


def counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return counted(rows, *keys).where("n > 1")


def count_of_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """How many keys have how many rows."""
    return counted(rows, *keys).groupBy(F.col("n").alias("size")).agg(F.count("*").alias("keys"))


ACCURACY = 10_000  # of the sketch: a place is off by n / ACCURACY at most


def index_percentile(rows: DataFrame, value: str, shares: Mapping[str, float], by: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """Percentiles by place, sorted[int(n * p)], with count, mean, least and most of each group.

    A sketch of each group, which tasks make in parts, gives for each place a
    range of values that holds it for sure. Rows below a range are only counted;
    rows inside, some four in ``accuracy``, are ranked. No task has all values
    of a group. Nulls take no part; a group without values is not there.
    """
    x = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    ends = [max(0.0, p - 2 / accuracy) for p in shares.values()] + [min(1.0, p + 2 / accuracy) for p in shares.values()]
    basic = [F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most")]
    whole = x.groupBy(*by).agg(*basic, *([F.percentile_approx("v", ends, accuracy).alias("ends")] if shares else []))
    if not shares:
        return whole
    lows = whole.select(*by, F.col("n").alias("n_"), "ends")
    # a group's ranges go to its rows: one row where there are no groups, else a join that splits hot groups
    met = x.join(lows, list(by)) if by else x.crossJoin(F.broadcast(lows))
    k = len(shares)
    lo, hi = (lambda j: F.get("ends", F.lit(j))), (lambda j: F.get("ends", F.lit(k + j)))
    below = met.groupBy(*by).agg(F.array(*(F.count_if(F.col("v") < lo(j)) for j in range(k))).alias("below"))
    place = F.array(*(F.least(F.floor(F.col("n_") * p), F.col("n_") - 1) for p in shares.values()))
    inside = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: (F.col("v") >= F.get("ends", j)) & (F.col("v") <= F.get("ends", j + k)))
    some = met.select(*by, "v", F.explode(inside).alias("j"), place.alias("place")).groupBy(*by, "j", "v", "place").agg(F.count("*").alias("c"))
    some = some.join(below, list(by)) if by else some.crossJoin(F.broadcast(below))
    upto = F.sum("c").over(Window.partitionBy(*by, "j").orderBy("v")) + F.get("below", F.col("j"))
    found = some.withColumn("upto", upto).where(F.col("upto") > F.get("place", F.col("j")))
    picks = found.groupBy(*by).agg(*(F.min(F.when(F.col("j") == j, F.col("v"))).alias(name) for j, name in enumerate(shares)))
    return whole.drop("ends").join(picks, list(by)) if by else whole.drop("ends").crossJoin(F.broadcast(picks))


def coverage(part: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """How many distinct keys of ``whole`` are in ``part``, and the percentage."""
    w = whole.select(key).distinct()
    both = w.join(part.select(F.col(key).alias("k_")).distinct(), F.col(key) == F.col("k_"), "left")
    return both.agg(F.count("*").alias("total"), F.count("k_").alias("matched")).withColumn("pct", F.round(100.0 * F.col("matched") / F.col("total"), 4))


def compare_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of two stores: (key, side) with side both, left or right."""
    x, y = a.select(key).distinct().withColumn("l_", F.lit(1)), b.select(key).distinct().withColumn("r_", F.lit(1))
    side = F.when(F.col("r_").isNull(), "left").when(F.col("l_").isNull(), "right").otherwise("both")
    return x.join(y, key, "full_outer").select(key, side.alias("side"))


def graded(checks: Sequence[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Issues of a table of checks (name, one-row frame with ``value``, condition, severity); those that hold."""
    rows = [df.select(F.lit(n).alias("name"), F.col("value").cast("double").alias("value"), F.when(F.expr(cond), sev).otherwise("ok").alias("severity")) for n, df, cond, sev in checks]
    return reduce(DataFrame.unionByName, rows)
