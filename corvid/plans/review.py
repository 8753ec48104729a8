"""Reviewing clauses against retrieved passages, by rules; and how findings are put together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

# Outcomes, their risk and the confidence they have by default.
RISK = {"entailed": "none", "contradicted": "high", "partially_supported": "medium", "no_reference": "low"}
CONFIDENCE = {"entailed": 95.0, "contradicted": 85.0, "partially_supported": 75.0, "no_reference": 45.0}
RISK_LEVELS = ["high", "medium", "low", "none"]
SPAN = 10_000  # queries whose references are numbered together

# Words that make a clause or passage negative, wherever they occur in it.
NEGATIVE = ["không", "cấm", "nghiêm cấm", "không được", "không thể", "không bao giờ", "chưa", "chẳng", "đừng"]


def negative(c: Column, words: Sequence[str] = tuple(NEGATIVE)) -> Column:
    low = F.lower(c)
    return F.array_contains(F.array(*(low.contains(w) for w in words)), True)


def lookup(c: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)


def key_phrases(c: Column, least: int = 10) -> Column:
    """Parts between ``; . \\n`` of more than ``least`` characters."""
    return F.filter(F.transform(F.split(c, r"[;.\n]"), lambda p: F.trim(p)), lambda p: F.length(p) > least)


def ascii_numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"[0-9]+"), F.lit(0)))


def rule_level(clause: Column, passage: Column, negated=negative, numbers=X.quantities, least: int = 20) -> Column:
    """(level, confidence) by the first rule that holds, else null.

    A phrase of the clause in the passage: entailed, .9. Negation on one side
    only and overlap above .6: contradicted, .8. Numbers on both sides, none in
    common, and overlap above .5: contradicted, .7. Empty sides decide nothing.
    """
    overlap = X.jaccard(clause, passage)
    low = F.lower(passage)
    phrase = F.exists(key_phrases(F.lower(clause)), lambda p: (F.length(p) > least) & low.contains(p))
    a, b = numbers(F.lower(clause)), numbers(F.lower(passage))
    apart = (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)
    res = lambda level, conf: F.struct(F.lit(level).alias("level"), F.lit(conf).alias("confidence"))
    return (
        F.when((F.trim(F.coalesce(clause, F.lit(""))) == "") | (F.trim(F.coalesce(passage, F.lit(""))) == ""), F.lit(None))
        .when(phrase, res("entailed", 0.9))
        .when((negated(clause) != negated(passage)) & (overlap > 0.6), res("contradicted", 0.8))
        .when(apart & (overlap > 0.5), res("contradicted", 0.7))
    )


def verified(pairs: DataFrame, model=None, negated=negative, numbers=X.quantities) -> DataFrame:
    """pairs (query_id, clause, passage) with level, confidence and decided_by.

    Pairs that no rule decides go to ``model``, a function of such a frame; it
    sees no other rows. Without a model they have no reference, confidence 0.
    """
    ruled = pairs.withColumn("v_", rule_level(F.col("clause"), F.col("passage"), negated, numbers))
    done = ruled.where("v_ is not null").select(*pairs.columns, "v_.level", "v_.confidence", F.lit("rule").alias("decided_by"))
    rest = ruled.where("v_ is null").select(*pairs.columns)
    if model is None:
        rest = rest.withColumns({"level": F.lit("no_reference"), "confidence": F.lit(0.0), "decided_by": F.lit("default")})
    else:
        rest = model(rest).withColumn("decided_by", F.lit("model"))
    return done.unionByName(rest)


def findings(levels: DataFrame) -> DataFrame:
    """Levels with their risk, which a level always decides, and a confidence where none is given."""
    return levels.withColumn("risk", F.coalesce(lookup(F.col("level"), RISK), F.lit("low"))).withColumn("confidence", F.coalesce("confidence", lookup(F.col("level"), CONFIDENCE)))


def risk_summary(found: DataFrame) -> DataFrame:
    """(risk, n) with all four risks, zeros included."""
    dim = found.sparkSession.createDataFrame([(r,) for r in RISK_LEVELS], "risk string")
    n = found.groupBy(F.col("risk").alias("r_")).agg(F.count("*").alias("c_"))
    return dim.join(n, F.col("risk") == F.col("r_"), "left").select("risk", F.coalesce("c_", F.lit(0)).cast("long").alias("n"))


def review_events(found: DataFrame) -> DataFrame:
    """(review_id, seq, event, payload) of findings (review_id, clause, risk): what a service sends, in order.

    For each clause ``progress`` and its ``finding``, then the ``summary`` of risks, then ``done``.
    """
    w = Window.partitionBy("review_id")
    x = found.select("review_id", "clause", "risk", F.row_number().over(w.orderBy("clause")).alias("i"), F.count("*").over(w).alias("n"))
    event = lambda seq, name, payload: F.struct(seq.cast("long").alias("seq"), F.lit(name).alias("event"), payload.alias("payload"))
    each = x.select("review_id", F.inline(F.array(event(2 * F.col("i") - 2, "progress", F.concat_ws("/", "i", "n")), event(2 * F.col("i") - 1, "finding", F.concat_ws(":", F.col("clause").cast("string"), "risk")))))
    counts = F.concat_ws(" ", *(F.concat_ws(":", F.lit(r), F.count_if(F.col("risk") == r)) for r in RISK_LEVELS))
    ends = found.groupBy("review_id").agg(F.count("*").alias("n"), counts.alias("counts"))
    last = ends.select("review_id", F.inline(F.array(event(2 * F.col("n"), "summary", F.col("counts")), event(2 * F.col("n") + 1, "done", F.col("n").cast("string")))))
    return each.unionByName(last)


def by_severity(found: DataFrame, top: int = 10) -> DataFrame:
    order = F.when(F.col("risk") == "high", 0).when(F.col("risk") == "medium", 1).when(F.col("risk") == "low", 2).otherwise(3)
    return found.withColumn("severity", order).orderBy("severity", "query_id", *(["doc_id"] if "doc_id" in found.columns else [])).limit(top)


def unique_references(cited: DataFrame) -> DataFrame:
    """cited (query_id, place, ref_id): each reference once, where it is first seen, numbered in that order.

    Queries are dealt into ranges of SPAN numbers; a range is numbered from the
    sum of the counts before it. Only these counts, one a range, are ordered in one task.
    """
    first = cited.groupBy("ref_id").agg(F.min(F.struct("query_id", "place")).alias("f")).select("ref_id", F.col("f.query_id").alias("query_id"), F.col("f.place").alias("place"))
    by = ["query_id", "place", "ref_id"]
    sums = first.groupBy(F.expr(f"query_id div {SPAN}").alias("bucket")).agg(F.count("*").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("bucket", "base")
    within = Window.partitionBy("bucket").orderBy(*by)
    x = first.withColumn("bucket", F.expr(f"query_id div {SPAN}")).withColumn("i", F.row_number().over(within))
    return x.join(sums, "bucket").select("ref_id", "query_id", "place", (F.col("base") + F.col("i")).cast("int").alias("n"))


def grouped_context(hits: DataFrame, laws: int = 5, each: int = 3) -> DataFrame:
    """hits (query_id, law_id, doc_id, score): the first laws of a query, the first hits of each, as one line of ids."""
    q = Window.partitionBy("query_id")
    best = F.max("score").over(Window.partitionBy("query_id", "law_id"))
    x = hits.withColumn("best_", best)
    x = x.withColumn("law_rank", F.dense_rank().over(q.orderBy(F.desc("best_"), "law_id")))
    x = x.withColumn("hit_rank", F.row_number().over(Window.partitionBy("query_id", "law_id").orderBy(F.desc("score"), "doc_id")))
    x = x.where((F.col("law_rank") <= laws) & (F.col("hit_rank") <= each))
    line = F.array_sort(F.collect_list(F.struct("law_rank", "hit_rank", F.concat_ws(":", F.col("law_id").cast("string"), F.col("doc_id").cast("string")).alias("t"))))
    return x.groupBy("query_id").agg(F.concat_ws(" ", F.transform(line, lambda s: s["t"])).alias("context"))


def citation_map(hits: DataFrame) -> DataFrame:
    """(query_id, citations): a map from 1-based numbers to (doc_id, score)."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("key"), F.struct("doc_id", "score").alias("value"))))
    return hits.groupBy("query_id").agg(F.map_from_entries(entries).alias("citations"))


def cited_with_related(hits: DataFrame, related: DataFrame, each: int = 2) -> DataFrame:
    """(query_id, n, doc_id, via): the hits (query_id, doc_id, rank) as citations, each followed by its first related documents.

    related (query_id, doc_id, related, n); ``via`` is the hit that a related one
    comes with, null for hits. What was cited before is not cited again, and
    counts among the ``each`` first.
    """
    h = hits.select("query_id", "doc_id", "rank")
    own = h.select("query_id", "doc_id", "rank", F.lit(0).alias("n"), F.lit(None).cast("long").alias("via"))
    more = related.where(F.col("n") <= each).join(h, ["query_id", "doc_id"]).select("query_id", F.col("related").alias("doc_id"), "rank", "n", F.col("doc_id").cast("long").alias("via"))
    first = own.unionByName(more).groupBy("query_id", "doc_id").agg(F.min(F.struct("rank", "n", "via")).alias("f"))
    w = Window.partitionBy("query_id").orderBy("f.rank", "f.n", "doc_id")
    return first.select("query_id", F.row_number().over(w).alias("n"), "doc_id", "f.via")


def parse_reply(c: Column) -> DataFrame | Column:
    """Fields of a model's reply: level, confidence within 0 to 100, rationale."""
    level = F.lower(F.regexp_extract(c, r"(?i)(?:verification|level)\s*[:=]\s*\"?([A-Za-z_]+)", 1))
    conf = F.try_to_number(F.nullif(F.regexp_extract(c, r"(?i)confidence\s*[:=]\s*\"?(\d{1,5}(?:\.\d{1,4})?)", 1), F.lit("")), F.lit("99999.9999")).cast("double")
    return F.struct(F.when(level.isin(*RISK), level).otherwise("no_reference").alias("level"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), conf)).alias("confidence"), F.trim(F.regexp_extract(c, r"(?is)rationale\s*[:=]\s*(.*?)(?:\n|$)", 1)).alias("rationale"))


# --- evaluation


def recall(expected: DataFrame, retrieved: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query_id, must, matched, recall, status): the share of expected keys retrieved; 1 where none is expected."""
    e, r = expected.select("query_id", key).distinct(), retrieved.select("query_id", key, F.lit(1).alias("hit_")).distinct()
    got = e.join(r, ["query_id", key], "left").groupBy("query_id").agg(F.count(key).alias("must"), F.count("hit_").alias("matched"))
    share = F.when(F.col("must") == 0, 1.0).otherwise(F.col("matched") / F.col("must"))
    return got.withColumn("recall", F.round(share, 6)).withColumn("status", F.when(F.col("recall") >= 0.67, "pass").when(F.col("recall") >= 0.33, "partial").otherwise("fail"))


def rank_trace(lists: Sequence[tuple[str, DataFrame]], ids: DataFrame) -> DataFrame:
    """ids (query_id, doc_id) with their rank in each list, null where absent."""
    out = ids
    for name, hits in lists:
        out = out.join(hits.select("query_id", "doc_id", F.col("rank").alias(name)), ["query_id", "doc_id"], "left")
    return out


def related_for_hits(hits: DataFrame, edges: DataFrame, top: int = 3) -> DataFrame:
    """Up to ``top`` related documents of each hit, both directions. hits (query_id, doc_id), edges (src, dst, rel)."""
    ids = hits.select("query_id", "doc_id").distinct()
    out = ids.join(edges.select(F.col("src").alias("doc_id"), F.col("dst").alias("related"), "rel"), "doc_id").withColumn("direction", F.lit("outgoing"))
    back = ids.join(edges.select(F.col("dst").alias("doc_id"), F.col("src").alias("related"), "rel"), "doc_id").withColumn("direction", F.lit("incoming"))
    every = out.unionByName(back).distinct()
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("direction"), "related", "rel")
    return every.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top)
