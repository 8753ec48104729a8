"""Structure of texts: articles, clauses, overlapping chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from . import text as X

SLICE = 64  # texts whose parts are held as Python objects, and leave a worker, at once
WORDS_PER_CHUNK = int(400 / 1.3)  # 400 tokens at 1.3 a word
OVERLAP = 0.5
LEAST_TOKENS = 100
SENTENCE = re.compile(r"(?<=[.;\n])\s+")
# Headings of articles, subsections and lettered clauses, and references in sentences.
ARTICLE = re.compile(r"^\s*(?:Điều|Article)\s+(\d+)\s*(?:[.:-]\s*(.*)|\s*$)", re.M | re.I)
SUBSECTION = re.compile(r"^\s*(\d+)\.\s+(.*)", re.M)
POINT = re.compile(r"^\s*([a-zđ])\)\s+(.*)", re.M)
KINDS = r"(Luật|Nghị\s+định|Thông\s+tư|Quyết\s+định)"
AMENDMENT = rf"sửa\s+đổi.*?{KINDS}.*?(\d{{4}}|\d+/[\w-]+|số\s+\d+)"
CITATION = rf"Điều\s+(\d+).*?{KINDS}.*?(\d{{4}})"


def rows_of(**fields: DataType) -> ArrayType:
    return ArrayType(StructType([StructField(n, kind) for n, kind in fields.items()]))


CHUNKS = rows_of(chunk_index=IntegerType(), start_char=IntegerType(), end_char=IntegerType(), content=StringType())
ARTICLES = rows_of(
    number=StringType(), title=StringType(), content=StringType(),
    subsections=rows_of(number=StringType(), text=StringType(), content=StringType(), clauses=rows_of(letter=StringType(), text=StringType())),
    clauses=rows_of(letter=StringType(), text=StringType()),
)


def chunk(text: str, words: int = WORDS_PER_CHUNK, overlap: float = OVERLAP, least_tokens: float = LEAST_TOKENS) -> list[dict]:
    """Runs of sentences of at most ``words`` words, each starting with the last sentences of the one before.

    Sentences of more words than a chunk are chunks of their own. Texts of
    fewer than ``least_tokens`` tokens (1.3 a word) give none. Offsets count in
    the sentences joined by single spaces.
    """
    if len(text.split()) * 1.3 < least_tokens:
        return []
    keep = int(words * overlap)
    sentences = [s.strip() for s in SENTENCE.split(text) if s.strip()]
    out: list[dict] = []
    held: list[str] = []
    size = at = 0  # words held, offset of the first sentence held

    def emit() -> None:
        body = " ".join(held)
        out.append({"chunk_index": len(out), "start_char": at, "end_char": at + len(body), "content": body})

    for s in sentences:
        n = len(s.split())
        if held and size + n > words:
            emit()
            carry: list[str] = []
            total = 0
            for prev in reversed(held):
                if total + len(prev.split()) > keep:
                    break
                carry.insert(0, prev)
                total += len(prev.split())
            at += sum(len(x) + 1 for x in held[: len(held) - len(carry)])
            held, size = carry, total
        held.append(s)
        size += n
    if held:
        emit()
    return out


def in_slices(texts: pa.Array, f: Callable[[str], list[dict]], kind: pa.DataType) -> pa.Array:
    """What ``f`` makes of each text, null as empty; the parts of a few texts at a time become Arrow memory."""
    made = [pa.array([f(t or "") for t in texts.slice(at, SLICE).to_pylist()], kind) for at in range(0, len(texts), SLICE)]
    return pa.concat_arrays(made) if made else pa.array([], kind)


def arrow_rows(**fields: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct(list(fields.items())))


CHUNKS_ARROW = arrow_rows(chunk_index=pa.int32(), start_char=pa.int32(), end_char=pa.int32(), content=pa.string())
LETTERED_ARROW = arrow_rows(letter=pa.string(), text=pa.string())
ARTICLES_ARROW = arrow_rows(
    number=pa.string(), title=pa.string(), content=pa.string(), subsections=arrow_rows(number=pa.string(), text=pa.string(), content=pa.string(), clauses=LETTERED_ARROW), clauses=LETTERED_ARROW
)


@arrow_udf(CHUNKS)
def chunks(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for a in texts:
        yield from (in_slices(some, chunk, CHUNKS_ARROW) for some in X.few(a, SLICE))


def articles_of(text: str) -> list[dict]:
    """Articles with their subsections and lettered clauses. Content goes from one heading to the next; clauses
    belong to the article itself only where it has no subsections."""

    def cut(pattern: re.Pattern, body: str) -> list[tuple[re.Match, str]]:
        found = list(pattern.finditer(body))
        return [(m, body[m.end() : n.start() if n else len(body)].strip()) for m, n in zip(found, [*found[1:], None][: len(found)], strict=True)]

    def lettered(body: str) -> list[dict]:
        return [{"letter": p[1], "text": p[2].strip()} for p in POINT.finditer(body)]

    out = []
    for m, body in cut(ARTICLE, text):
        subs = [{"number": s[1], "text": s[2].strip(), "content": inner, "clauses": lettered(inner)} for s, inner in cut(SUBSECTION, body)]
        out.append({"number": m[1], "title": (m[2] or "").strip(), "content": body, "subsections": subs, "clauses": [] if subs else lettered(body)})
    return out


@arrow_udf(ARTICLES)
def articles(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for a in texts:
        yield from (in_slices(some, articles_of, ARTICLES_ARROW) for some in X.few(a, SLICE))


def exploded_articles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, article_no, title, content, subsections, clauses), one row an article."""
    a = docs.select(F.col(id_col).alias("doc_id"), F.explode(articles(F.col(text_col))).alias("a"))
    return a.select("doc_id", F.col("a.number").alias("article_no"), "a.title", "a.content", "a.subsections", "a.clauses")


def clauses(contracts: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20) -> DataFrame:
    """(doc_id, clause_index, clause): contracts split before article headings, else at blank lines, else whole."""
    heading = r"(?imuU)(?=^\s*(?:điều|article|section|clause)\s+\d+)"
    t = F.col(text_col)
    by_heading = F.split(t, heading)
    by_line = F.split(t, r"\n\s*\n")
    parts = F.when(F.size(by_heading) > 1, by_heading).when(F.size(by_line) > 1, by_line).otherwise(F.array(t))
    kept = F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: F.length(p) >= least)
    return contracts.select(F.col(id_col).alias("doc_id"), F.posexplode(kept).alias("clause_index", "clause"))


def metadata(c: Column) -> Column:
    """What a document says of itself: its kind in the first 500 characters, its number, dates in words, and who issued it."""
    number = X.document_number(c)
    return F.struct(
        X.doc_type(F.substring(c, 1, 500)).alias("doc_type"),
        number.alias("document_number"),
        X.law_id(number).alias("law_id"),
        X.date_in_words(c, 1).alias("publish_date"),
        X.date_in_words(c, 2).alias("effective_date"),
        X.issuer(c).alias("issuing_body"),
    )


def amendment_refs(c: Column) -> Column:
    """What a text amends, as kind and number or year."""
    return X.rewritten(c, "{1} {2}", AMENDMENT)


def citation_refs(c: Column) -> Column:
    """Articles of other documents that a text cites, as article, kind and year."""
    return X.rewritten(c, "Điều {1} {2} {3}", CITATION)


def documents(docs: DataFrame, overrides: Mapping[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, content, one column for each field of :func:`metadata`, articles, amendment_refs, citation_refs): whole documents, parsed.

    A value of ``overrides`` (by field) goes before what the text says; a null one does not.
    """
    m = docs.withColumn("m_", metadata(F.col(text_col)))
    known = overrides or {}
    fields = [F.coalesce(known[f].cast(kind), F.col(f"m_.{f}")).alias(f) if f in known else F.col(f"m_.{f}") for f, kind in ((x.name, x.dataType) for x in m.schema["m_"].dataType)]
    return m.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("content"), *fields, articles(F.col(text_col)).alias("articles"), amendment_refs(F.col(text_col)).alias("amendment_refs"), citation_refs(F.col(text_col)).alias("citation_refs"))


def reference_numbers(c: Column) -> Column:
    """(rel, needle) of each document that a text amends, cites or refers to, by number."""
    number = r"\d+/\d{4}/[\p{Lu}\d]+(?:-[\p{Lu}\d]+)*"
    kinds = {"AMENDED_BY": r"(?iu)(?:sửa đổi|bổ sung|thay thế)[^.;\n]{0,80}?", "CITES": r"(?iu)căn cứ[^.;\n]{0,80}?", "REFERENCES": r"(?iu)(?:theo|quy định tại)[^.;\n]{0,80}?"}

    def told(rel: str, lead: str) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit(f"{lead}({number})"), F.lit(1)), lambda n: F.struct(F.lit(rel).alias("rel"), n.alias("needle")))

    return F.array_distinct(F.concat(*(told(rel, lead) for rel, lead in kinds.items())))


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(src, rel, needle): documents that a text amends, cites or refers to, by number."""
    return docs.select(F.col(id_col).alias("src"), F.explode(reference_numbers(F.col(text_col))).alias("r")).select("src", "r.rel", "r.needle")


def plan(queries: DataFrame, id_col: str = "query_id", text_col: str = "text", short_forms: Mapping[str, str] | None = None, synonyms: Mapping[str, list[str]] | None = None, forms: Mapping[str, list[str]] | None = None) -> DataFrame:
    """(query_id, original, normalized, expanded, variants, has_negation, negation_scope, citations, strategy). Tables of words that are not given are those of the lexicons."""
    q = queries.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("original"))
    q = q.withColumn("normalized", X.normalize_query(X.nfc("original")))
    q = q.withColumn("expanded", X.expand_query(F.col("normalized"), short_forms))
    q = q.withColumns({"variants": X.variants(F.col("expanded"), synonyms, forms), "has_negation": X.has_negation(F.col("expanded")), "negation_scope": X.negation_scope(F.col("expanded")), "citations": X.citations(F.col("expanded"))})
    strategy = F.when(F.size("citations") > 0, "citation").when(F.col("has_negation"), "negation").otherwise("semantic")
    return q.withColumn("strategy", strategy)
