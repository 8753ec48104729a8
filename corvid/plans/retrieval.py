"""Retrieval over many queries at once: postings, BM25, dense search, fusion, normalisation.

Hits are long rows (query_id, doc_id, score, rank). Texts stay out of the
ranking plans and are joined to the rows that survive. Every order ends in
doc_id, so that results do not depend on how rows are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

K1, B = 1.2, 0.75
RRF_K = 60
CENTER, TYPICAL = 0.012, 0.035  # fixed values of the centered normaliser


# --- lexical


def postings(docs: DataFrame, tokens: Column, id_col: str = "doc_id", within: Sequence[str] = ()) -> DataFrame:
    """(doc_id, term, tf, len): term frequencies, with the length of the document beside them. An index to keep.

    ``within`` names the columns that tell parts of a document apart; each part then has its own rows.
    """
    # the outer form adds no filter by the tokens, which would work them out twice
    t = docs.select(F.col(id_col).alias("doc_id"), *within, tokens.alias("t")).select("doc_id", *within, F.size("t").alias("len"), F.explode_outer("t").alias("term"))
    return t.where("term is not null").groupBy("doc_id", *within, "term", "len").agg(F.count("*").alias("tf")).select("doc_id", *within, "term", "tf", "len")


def query_terms(queries: DataFrame, tokens: Column, id_col: str = "query_id") -> DataFrame:
    """(query_id, term): distinct terms."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(tokens)).alias("term"))


MOST_BROADCAST = 1_000_000  # terms of queries that are sent to all executors, at most


def sent(df: DataFrame) -> DataFrame:
    """To all executors, if a count shows it small."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


# --- ranks


def ranked(hits: DataFrame, top: int | None = None, by: Sequence[str] = ("query_id",), score: str = "score") -> DataFrame:
    """``hits`` with a 1-based rank in each list, and only the first ``top``."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), "doc_id")
    out = hits.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= top) if top is not None else out


def sandwich(hits: DataFrame, score: str = "score") -> DataFrame:
    """(..., place): best first and last. Even places of the order first, then odd ones from the back; lists of up to two stay."""
    w = Window.partitionBy("query_id")
    i = F.row_number().over(w.orderBy(F.desc(score), "doc_id")) - 1
    n = F.count("*").over(w)
    x = hits.withColumns({"i_": i, "n_": n})
    # even i ascending fill the front; odd i descending fill the back
    place = F.when(F.col("n_") <= 2, F.col("i_")).when(F.col("i_") % 2 == 0, F.floor(F.col("i_") / 2)).otherwise(F.col("n_") - 1 - F.floor(F.col("i_") / 2))
    return x.withColumn("place", place.cast("int")).drop("i_", "n_")


def rrf(lists: Sequence[DataFrame], weights: Sequence[float] | None = None, k: int | Column = RRF_K, top: int | None = None, digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: the sum of w / (k + rank) over the lists that have the document."""
    weights = list(weights) if weights is not None else [1.0] * len(lists)
    if len(weights) != len(lists):
        raise ValueError(f"{len(lists)} lists, {len(weights)} weights")
    kc = F.lit(k) if isinstance(k, int) else k
    parts = [x.select("query_id", "doc_id", (F.lit(float(w)) / (kc + F.col("rank"))).alias("s")) for x, w in zip(lists, weights, strict=True)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return ranked(every.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), digits).alias("score")), top)


def adaptive(words: Column, strategy: Column, has_citation: Column) -> Column:
    """(k, w_lexical, w_dense) by the kind of query."""
    s = lambda k, a, b: F.struct(F.lit(k).alias("k"), F.lit(a).alias("w_lexical"), F.lit(b).alias("w_dense"))
    return (
        F.when((words < 15) & has_citation, s(30, 0.6, 1.0))
        .when((words > 50) | (strategy == "semantic"), s(80, 1.2, 0.8))
        .when(strategy == "negation", s(40, 1.0, 0.6))
        .otherwise(s(60, 1.2, 1.0))
    )


def pool_size(candidates: Column, top_k: Column, most: int = 500) -> Column:
    """Candidates to fetch for a list: what was asked for, or 20 a result up to ``most``."""
    return F.greatest(candidates, F.least(20 * top_k, F.lit(most)))


# --- dense


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null where one has no length."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


@pandas_udf(DoubleType())
def max_sim(q: pd.Series, d: pd.Series) -> pd.Series:
    """Late interaction: for each row of one matrix its best cosine in the other, summed."""
    import numpy as np

    def one(a, b) -> float:
        a, b = np.stack(a).astype(float), np.stack(b).astype(float)
        a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
        b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
        return float((a @ b.T).max(1).sum())

    return pd.Series([one(a, b) if a is not None and b is not None and len(a) and len(b) else 0.0 for a, b in zip(q, d, strict=True)])


LEAST_ROWS, MOST_ROWS, BLOCKS, TILE = 256, 8192, 16, 256  # rows of a block of late interaction; blocks, while they are no larger; rows multiplied at once


def late_interaction(rows: DataFrame, block: int | None = None) -> DataFrame:
    """(a, b, score) of each two matrices a < b: for each row of a its best cosine in b, summed. rows (matrix, row, v), one length of v.

    Rows are dealt into blocks, and each two blocks meet in a task, which keeps
    the best of each row and matrix: no matrix is whole in one task. There are
    BLOCKS blocks at most, so that what moves grows with the rows, until a block
    has MOST_ROWS; beyond that it grows with their square, as the products do.
    """
    total = rows.count()
    n = max(1, math.ceil(total / (block or min(MOST_ROWS, max(LEAST_ROWS, math.ceil(total / BLOCKS))))))
    x = rows.where("v is not null").select("matrix", "row", "v").withColumn("block", F.pmod(F.xxhash64("matrix", "row"), F.lit(n)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left, right = x.withColumnRenamed("block", "i").withColumn("j", every), x.withColumnRenamed("block", "j").withColumn("i", every)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out = []
        if len(a) and len(b):
            p, q = (np.array(m["v"].tolist(), float) for m in (a, b))
            p, q = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (p, q))
            of = {m: (b["matrix"] == m).to_numpy() for m in b["matrix"].unique()}
            for at in range(0, len(p), TILE):
                part = a.iloc[at : at + TILE]
                scores = p[at : at + TILE] @ q.T
                for m, mine in of.items():
                    some = (part["matrix"] < m).to_numpy()
                    out.append(pd.DataFrame({"a": part["matrix"][some], "row": part["row"][some], "b": m, "best": scores[some][:, mine].max(1)}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "row": [], "b": [], "best": []})

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("matrix", "row")}
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, f"a {kinds['matrix']}, row {kinds['row']}, b {kinds['matrix']}, best double")
    return found.groupBy("a", "b", "row").agg(F.max("best").alias("best")).groupBy("a", "b").agg(F.sum("best").alias("score"))


# --- normalisation


@pandas_udf(DoubleType())
def erf(x: pd.Series) -> pd.Series:
    return x.map(math.erf)


def normalized(hits: DataFrame, method: str = "min-max", low: float = 0.0, high: float = 100.0, score: str = "score", out: str = "norm", eps: float = 1e-10) -> DataFrame:
    """Scores of each query's list on one scale.

    min-max; z-score (population deviation); percentile of a Gaussian (also
    named rank); centered, the affine map for fused ranks, clamped.
    A list without spread gets the middle of the scale (z-score: 0).
    """
    w = Window.partitionBy("query_id")
    s = F.col(score).cast("double")
    lo, hi = F.min(s).over(w), F.max(s).over(w)
    mean, dev = F.avg(s).over(w), F.stddev_pop(s).over(w)
    x = hits.withColumns({"lo_": lo, "hi_": hi, "mean_": mean, "dev_": dev})
    z = (s - F.col("mean_")) / F.nullif(F.col("dev_"), F.lit(0.0))
    span = F.col("hi_") - F.col("lo_")
    if method == "min-max":
        value = F.when(span < eps, (low + high) / 2).otherwise(low + (s - F.col("lo_")) / span * (high - low))
    elif method == "z-score":
        value = F.when(F.col("dev_") < eps, 0.0).otherwise(z)
    elif method in ("percentile", "rank"):
        value = F.when(F.col("dev_") < eps, 50.0).otherwise(50.0 * (1.0 + erf(z / math.sqrt(2.0))))
    elif method == "centered":
        reach = F.greatest(F.lit(TYPICAL - CENTER), span)
        value = F.greatest(F.lit(0.0), F.least(F.lit(high), 0.1 * high + (s - CENTER) * high / reach))
    else:
        raise ValueError(f"no method {method!r}")
    return x.withColumn(out, value).drop("lo_", "hi_", "mean_", "dev_")


# --- aggregation and reranking


def pool_chunks(hits: DataFrame, parent: Column) -> DataFrame:
    """Chunks to their documents, by the best score; other hits pass through."""
    return ranked(hits.withColumn("doc_id", parent).groupBy("query_id", "doc_id").agg(F.max("score").alias("score")))


def aggregate_laws(hits: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Articles and root documents of a law to the ones that stand for it.

    hits: (query_id, doc_id, law_id, is_article, article_no, score). In a law
    with articles only, the best article gets their summed score; with both,
    it does so if the sum beats the root (times the threshold) or some article
    reaches the floor of the list, else the root stays, with the articles that
    reach the median. Returns the hits that stay with agg_score, n_articles and
    the first five article numbers, by agg_score or score.
    """
    q = Window.partitionBy("query_id")
    law = F.coalesce("law_id", F.col("doc_id").cast("string"))
    g = Window.partitionBy("query_id", "law_")
    art = F.col("is_article")
    number = F.when(art, F.col("article_no"))
    # places in the list by rank and count, and five numbers of a law at most: no row carries a list
    x = hits.withColumn("law_", law).withColumns({"i_": F.row_number().over(q.orderBy(F.desc("score"))), "n_": F.count("*").over(q), "first_": F.dense_rank().over(g.orderBy(number.asc_nulls_last()))})
    at = lambda place: F.max(F.when(F.col("i_") == place, F.col("score"))).over(q)
    x = x.withColumns(
        {
            "floor_": at(F.greatest(F.lit(1), F.floor(F.col("n_") / 3))),
            "median_": at(F.floor(F.col("n_") / 2) + 1),
            "sum_": F.sum(F.when(art, F.col("score"))).over(g),
            "n_articles": F.count(F.when(art, 1)).over(g),
            "best_": F.max(F.when(art, F.struct("score", (-F.col("doc_id")).alias("n")))).over(g),
            "root_": F.max(F.when(~art, F.struct(F.lit(1).alias("one"), "doc_id", "score"))).over(g),
            "numbers_": F.array_sort(F.collect_set(F.when(F.col("first_") <= 5, number)).over(g)),
        }
    )
    top_art = art & (F.col("doc_id") == -F.col("best_.n"))
    is_root = ~art & (F.col("doc_id") == F.col("root_.doc_id"))
    none, only = F.col("n_articles") == 0, F.col("root_").isNull()
    wins = only | (F.col("sum_") > F.col("root_.score") * threshold) | (F.col("best_.score") >= F.col("floor_"))
    keep = F.when(none, is_root).when(wins, top_art).otherwise(is_root | (art & (F.col("score") >= F.col("median_"))))
    agg = F.when(~none & wins & top_art, F.col("sum_"))
    out = x.where(keep).select("query_id", "doc_id", "law_id", "is_article", "score", agg.alias("agg_score"), "n_articles", F.concat_ws(",", F.slice(F.col("numbers_"), 1, 5).cast("array<string>")).alias("article_numbers"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("agg_score", "score")), "doc_id")
    return out.withColumn("rank", F.row_number().over(w))


def position_decay(hits: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Scores mixed with their places, and the better half (at least one) of each list."""
    w = Window.partitionBy("query_id")
    x = hits.withColumns({"pos_": F.row_number().over(w.orderBy(F.desc("score"), "doc_id")) - 1, "n_": F.count("*").over(w)})
    factor = F.when(F.col("n_") <= 1, 1.0).otherwise(1 - F.col("pos_") / (F.col("n_") - 1))
    x = x.withColumn("decayed", F.round(alpha * F.col("score") + (1 - alpha) * factor, 9))
    x = x.withColumn("rank", F.row_number().over(w.orderBy(F.desc("decayed"), "doc_id")))
    return x.where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n_") / 2))).drop("pos_", "n_")


def rerank(pairs: DataFrame, model: Callable[[list[str], list[str]], Sequence[float]] | None = None, top: int | None = None, batch: int = 64) -> DataFrame:
    """(query_id, doc_id, score, rank) of pairs (query_id, doc_id, score, query, passage) in two stages.

    First the better half by :func:`position_decay`. Then ``model`` scores what
    is left, from batches of queries and passages; null texts count as empty.
    Without a model, the first stage decides alone.
    """
    half = position_decay(pairs)
    if model is None:
        return ranked(half.select("query_id", "doc_id", F.col("decayed").alias("score")), top)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                made = model([t or "" for t in part["query"]], [t or "" for t in part["passage"]])
                yield pd.DataFrame({"query_id": part["query_id"], "doc_id": part["doc_id"], "score": [float(x) for x in made]})

    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("query_id", "doc_id")}
    scored = half.select("query_id", "doc_id", "query", "passage").mapInPandas(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")
    return ranked(scored, top)


def boost_related(hits: DataFrame, related: DataFrame, factor: float = 1.2) -> DataFrame:
    """Scores of documents that are related (query_id, doc_id), multiplied; ``original`` has the old score."""
    r = related.select("query_id", "doc_id", F.lit(True).alias("rel_")).distinct()
    x = hits.withColumnRenamed("score", "original").join(r, ["query_id", "doc_id"], "left")
    x = x.withColumn("score", F.col("original") * F.when(F.col("rel_"), factor).otherwise(1.0)).drop("rel_", "rank")
    return ranked(x)


def vectors(docs: DataFrame, model: Callable[[list[str]], Sequence[Sequence[float]]], batch: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, vector): what ``model`` makes of each text, in batches of ``batch`` texts, as the rows stream by.

    Null counts as empty. No more than one batch of vectors is held at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                made = model([t or "" for t in part[text_col]])
                yield pd.DataFrame({id_col: part[id_col], "vector": [[float(x) for x in v] for v in made]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, vector array<double>")
