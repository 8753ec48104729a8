"""The operators over the synthetic tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import bytebpe, chat, exactdedup, fim, html, langid, packing, pii, secretscan, simhash, topk, trie, wordbpe

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pii_key(spark: SparkSession) -> str:
    """The key that the session names, which production must; without one, that of the synthetic tables, which hold nobody's data."""
    return spark.conf.get("spark.corvid.pii.key", "synthetic tables only")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_format(table(spark, sf_dir, "conversations"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.count(table(spark, sf_dir, "documents"), WORD_BPE, limit=2048)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, pii_key(spark))[0].select("doc_id", "text")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), WORD_BPE)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = langid.train(docs.where(F.coalesce(fold, F.lit(0)) != 2))
    found = langid.predict(spark, docs, model)
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_simhash": op2_simhash,
    "op3_chat_format": op3_chat_format,
    "op4_top_k": op4_top_k,
    "op5_token_counts": op5_token_counts,
    "op6_pii": op6_pii,
    "op7_html_text": op7_html_text,
    "op8_packing": op8_packing,
    "op9_language": op9_language,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_secret_scan": op11_secret_scan,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": pipeline,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL: dict[str, str] = {
    "op3_chat_format": """
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations),
        p AS (SELECT conv_id, place, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY place) AS chat FROM t),
        c AS (SELECT p.* FROM p JOIN (SELECT conv_id, max(place) AS n FROM p GROUP BY 1) m ON p.conv_id IS NOT DISTINCT FROM m.conv_id AND p.place = m.n),
        inner_p AS (SELECT DISTINCT p.chat FROM p JOIN c ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.place < c.place)
        SELECT min(conv_id) AS conv_id, min(place) AS n_turns, count(*) AS n_copies, chat
        FROM c WHERE chat NOT IN (SELECT chat FROM inner_p) GROUP BY chat""",
    "op4_top_k": """
        WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op10_exact_dedup": f"""
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op12_fill_in_middle": r"""
        WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
                          sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        d AS (SELECT *, len(u) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS d FROM u),
        c AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 50 THEN 'plain'
                          WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
        p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p""",
    "op13_prefix_trie": f"""
        WITH RECURSIVE crc AS (SELECT i AS k, i AS v, 0 AS step FROM range(256) t(i)
                     UNION ALL SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM crc WHERE step < 8),
        crcs AS (SELECT list(v ORDER BY k) AS c FROM crc WHERE step = 8),
        own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''),
                                     substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS t
                FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
        h AS (SELECT conv_id, t, xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
                     lambda a, b: xor(a >> 8, c[xor(a & 255, b) + 1])), 4294967295) % 6 AS h FROM own, crcs),
        r AS (SELECT h.conv_id, list_concat(coalesce(g.t, [])[1:h.h], h.t[h.h + 1:]) AS t FROM h LEFT JOIN own g ON g.conv_id = h.conv_id - h.conv_id % 100),
        p AS (SELECT conv_id, d AS depth, t[1:d] AS p, len(t) AS n FROM r, unnest(range(len(t) + 1)) x(d)),
        nodes AS (SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(length(p[depth].text), 0) AS saved,
                         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
                  FROM p GROUP BY p, depth),
        up AS (SELECT p, depth, saved, p[1:a] AS top, a FROM nodes, unnest(range(depth + 1)) x(a)),
        kids AS (SELECT top, count(*) AS n FROM up WHERE a = depth - 1 GROUP BY 1),
        sums AS (SELECT up.top, CAST(sum(up.saved) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves FROM up LEFT JOIN kids ON kids.top = up.p GROUP BY 1)
        SELECT o.conv_id, o.depth, q.conv_id AS parent_conv_id, o.n_convs, coalesce(kids.n, 0) AS n_children, s.n_leaves, s.saved_tokens, o.ends_sha256
        FROM nodes o JOIN sums s ON s.top = o.p LEFT JOIN kids ON kids.top = o.p LEFT JOIN nodes q ON o.depth > 0 AND q.p = o.p[1:o.depth - 1]""",
}
