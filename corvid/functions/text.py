"""Text functions as column expressions: normalisation, lexicons, tokens, extraction.

Patterns are Java regular expressions. ``(?iu)`` folds case beyond ASCII and
``(?U)`` makes ``\\w`` and ``\\b`` Unicode-aware. Only Unicode normal forms
have no built-in expression, and go through Arrow.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import StringType

from .lexicons import ABBREVIATIONS, CONCEPTS, QUERY_ABBREVIATIONS, SYNONYMS, VERBS

# Phrases of negation in queries, in the order they are looked for.
NEGATIONS: list[str] = [
    "không được phép", "không được", "nghiêm cấm", "cấm", "không cho phép", "không có quyền", "không thể", "không được quyền",
    "không nên", "không được phép để", "không bao gồm", "không áp dụng", "không có hiệu lực", "vô hiệu",
]

# Kinds of documents, and the words that a text names each by.
KIND_WORDS: dict[str, list[str]] = {
    "luat": ["luật", "bộ luật"],
    "nghi_dinh": ["nghị định", "nđ-cp"],
    "thong_tu": ["thông tư", "tt", "tt-btc", "tt-btp"],
    "quyet_dinh": ["quyết định", "qđ"],
    "nghi_quyet": ["nghị quyết", "nq"],
}

# The kind that each name of a document type in data sets counts as. All others are "other".
DOC_TYPES: dict[str, str] = {
    "luật": "luat", "bộ luật": "luat", "hiến pháp": "luat", "sắc luật": "luat",
    "nghị định": "nghi_dinh", "nghị định thư": "nghi_dinh",
    "thông tư": "thong_tu", "thông tư liên tịch": "thong_tu", "thông tư liên bộ": "thong_tu",
    "quyết định": "quyet_dinh", "sắc lệnh": "quyet_dinh", "lệnh": "quyet_dinh", "pháp lệnh": "quyet_dinh", "chỉ thị": "quyet_dinh",
    "nghị quyết": "nghi_quyet", "nghị quyết liên tịch": "nghi_quyet",
}

# Patterns of the bodies that issue documents, the first that occurs counts.
ISSUERS: list[str] = [
    r"Quốc\s+hội", r"Chính\s+phủ", r"Thủ\s+tướng", r"Bộ\s+(?:Tư\s+pháp|Tài\s+chính|Công\s+thương|Lao\s+động)", r"Ngân\s+hàng\s+Nhà\s+nước", r"UBND\s+(?:tỉnh|thành\s+phố)",
]

# Common words that carry marks. Those named twice count twice.
MARKED_WORDS: list[str] = [
    "ngày", "tháng", "năm", "điều", "khoản", "điểm", "luật", "nghị", "định", "thông", "tư", "quyết", "định", "bộ", "pháp", "hình", "sự", "dân",
    "chính", "phủ", "quốc", "hội", "thành", "phố", "tỉnh", "huyện", "công", "ty", "trách", "nhiệm", "hữu", "hạn", "cổ", "phần",
    "hợp", "đồng", "lao", "động", "thương", "mại", "dịch", "vụ", "bảo", "hiểm", "xã", "hội", "y", "tế", "giáo", "dục",
]


def few(texts: pa.Array, n: int = 64) -> Iterator[pa.Array]:
    """A batch in parts of ``n`` texts. What a function makes of a part leaves the worker before the next."""
    return (texts.slice(at, n) for at in range(0, len(texts), n))


@arrow_udf(StringType())
def nfc(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Unicode normal form C. Null stays null."""
    for a in texts:
        for some in few(a):
            yield pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in some.to_pylist()], pa.string())


def or_default(c: Column, default: str) -> Column:
    """``c``, or the default where it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def normalize_space(c: Column) -> Column:
    """Tabs to spaces, runs of spaces to one, CRLF to LF, three or more LF to two, then each line trimmed."""
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(c, r"(?m)^ +| +$", ""), r"^\s+|\s+$", "")


def normalize_query(c: Column) -> Column:
    """White space to single spaces, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def expand(c: Column, words: Mapping[str, str] | None = None, longest_first: bool = True) -> Column:
    """Whole-word replacement of short forms; what one writes, the next may expand. Those of one length, or all, in the order of the table.

    One pass finds which forms a text has; only these, and those that their replacements may lead to, are then replaced one by one.
    """
    words = ABBREVIATIONS if words is None else words
    order = [w for w in (sorted(words, key=len, reverse=True) if longest_first else words) if w]
    if not order:
        return c
    quoted = lambda w: "".join("\\" + ch if not ch.isalnum() else ch for ch in w)
    # zero-width, so that forms inside one another are all met; of those that begin at one place, the longest
    longest = "|".join(quoted(w) for w in sorted(order, key=len, reverse=True))
    first = "".join(sorted({quoted(w[0]) for w in order}))
    met = F.regexp_extract_all(c, F.lit(rf"(?iuU)(?=[{first}])(?<!\w)(?=({longest})(?!\w))"), F.lit(1))
    names = F.array(*(F.lit(x) for x in sorted({w.lower() for w in order})))
    leads = _led_to(words, order)
    forms = F.array(*(F.struct(F.lit(rf"(?iuU)(?={quoted(w[0])})(?<!\w){quoted(w)}(?!\w)").alias("pattern"), F.lit(words[w].replace("$", r"\$")).alias("value"), F.array(*map(F.lit, sorted(leads[w]))).alias("by")) for w in order))

    def run(x: Column) -> Column:
        return F.aggregate(F.filter(forms, lambda w: x["odd"] | F.arrays_overlap(w["by"], x["met"])), x["c"], lambda text, w: F.regexp_replace(text, w["pattern"], w["value"]))

    # what a row has once is bound before the forms are gone through
    known = F.array(F.struct(c.alias("c"), F.array_distinct(F.transform(met, lambda m: F.lower(m))).alias("met")))
    odd = lambda x: F.size(F.array_except(x["met"], names)) > 0  # noqa: E731 - met by a letter that only folding equates: all are looked for
    known = F.transform(known, lambda x: F.struct(x["c"].alias("c"), x["met"].alias("met"), odd(x).alias("odd")))
    return F.get(F.transform(known, run), F.lit(0))


def _led_to(words: Mapping[str, str], order: Sequence[str]) -> dict[str, set[str]]:
    """For each short form, the forms (in lower case) of which one must be in a text for it to be there, before or after the others are replaced.

    Those that begin with it, itself included, and those whose replacements have one of its words, or end in a sign; and so on.
    """
    fold = lambda w: w.upper().lower()
    parts = {w: [x for x in re.split(r"[^\w\u0080-\U0010ffff]+", fold(w)) if x] for w in order}
    plain = lambda w: bool(w) and all(ch.isalpha() or ch.isdecimal() for ch in (w[0], w[-1]))
    written = {w: words[w].replace("\\", "") for w in order}
    out = {w: {x.lower() for x in order if fold(x).startswith(fold(w))} for w in order}
    grown = True
    while grown:
        grown = False
        for w in order:
            for by in order:
                if not out[by] <= out[w] and (not plain(written[by]) or not parts[w] or any(x in fold(written[by]) for x in parts[w])):
                    out[w] |= out[by]
                    grown = True
    return out


def expand_query(c: Column, words: Mapping[str, str] | None = None) -> Column:
    """Short forms of queries, in the order of their own table."""
    return expand(c, QUERY_ABBREVIATIONS if words is None else words, longest_first=False)


def normalize_legal(c: Column, words: Mapping[str, str] | None = None) -> Column:
    """Normal form C, then white space, then short forms, as texts are stored."""
    return expand(normalize_space(nfc(c)), words)


def unmarked(word: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFD", word) if unicodedata.category(ch) != "Mn")


def lacks_marks(c: Column, share: float = 0.5, words: Sequence[str] = tuple(MARKED_WORDS)) -> Column:
    """Whether more than ``share`` of the listed words that the first 2000 characters hold without marks are nowhere there with them.

    A word listed twice counts twice.
    """
    head = F.substring(F.lower(F.substring(c, 1, 2000)), 1, 2000)  # lower case is never shorter
    plain = F.array(*map(F.lit, sorted({unmarked(w) for w in words})))
    listed = F.array(*(F.struct(F.lit(unmarked(w)).alias("plain"), F.lit(w).alias("marked")) for w in words))

    # one pass finds the listed words that are whole words of the head; what a row has once is bound before the list is gone through
    seen = F.transform(F.array(head), lambda h: F.struct(h.alias("head"), F.array_intersect(F.split(h, r"(?U)\W+"), plain).alias("seen")))
    found = F.transform(seen, lambda x: F.struct(x["head"].alias("head"), F.when(F.size(x["seen"]) > 0, F.filter(listed, lambda w: F.array_contains(x["seen"], w["plain"]))).alias("found")))
    lacks = F.transform(found, lambda x: F.size(F.filter(x["found"], lambda w: ~F.contains(x["head"], w["marked"]))) > share * F.size(x["found"]))
    return F.coalesce(F.get(lacks, F.lit(0)), F.lit(False))


def iso_dates(c: Column) -> Column:
    """Dates in words, d/m/y or y/m/d (also with dashes) to y-m-d, without padding."""
    c = F.regexp_replace(c, r"(?iu)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})", "$3-$2-$1")
    c = F.regexp_replace(c, r"(?<!\d)(\d{1,2})[/-](\d{1,2})[/-](\d{4})(?!\d)", "$3-$2-$1")
    return F.regexp_replace(c, r"(?<!\d)(\d{4})[/-](\d{1,2})[/-](\d{1,2})(?!\d)", "$1-$2-$3")


def date_in_words(c: Column, n: int = 1) -> Column:
    """The n-th date written in words (day, month, year), or null; null too if there is no such day."""
    pattern = r"(?iuU)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
    found = F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.lit(n))
    part = lambda i: F.lpad(F.regexp_extract(found, pattern, i), 2 if i < 3 else 4, "0")
    return F.try_to_date(F.concat_ws("-", part(3), part(2), part(1)))


def first_date(c: Column, n: int = 1) -> Column:
    """The n-th date of the text, or null."""
    found = F.regexp_extract_all(iso_dates(c), F.lit(r"(?<!\d)(\d{4}-\d{1,2}-\d{1,2})(?!\d)"), F.lit(1))
    part = F.split(F.try_element_at(found, F.lit(n)), "-")
    text = F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0"))
    return F.when(F.size(found) >= n, F.try_to_date(text))


def date_prefix(c: Column) -> Column:
    """The day of a date, a time or a text that begins with y-m-d; null where it begins with none, or where there is no such day."""
    return F.try_to_date(F.regexp_extract(F.trim(c.cast("string")), r"^(\d{4}-\d{2}-\d{2})", 1))


def date_or(c: Column, fallback: Column) -> Column:
    """A text that is a whole ISO date (y-m-d, or a time after it) as a day, else the fallback."""
    whole = c.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$")
    return F.coalesce(F.when(whole, date_prefix(c)), fallback)


def strip_tags(c: Column) -> Column:
    """Markup to text by patterns alone: scripts, styles and comments go, tags become line breaks, common references are decoded."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", "")
    c = F.regexp_replace(c, r"<[^>]+>", "\n")
    for name, ch in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(ch))
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]*\n\s*", "\n"), r"^\s+|\s+$", "")


class _Texts(HTMLParser):
    """The runs of text of a page, without scripts and styles; all references decoded."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.runs: list[str] = []
        self.hidden = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style") and not self.hidden:
            self.hidden = tag

    def handle_endtag(self, tag):
        if tag == self.hidden:
            self.hidden = ""

    def handle_data(self, data):
        if not self.hidden:
            self.runs.append(data)


def page_text(markup: str | None) -> str:
    """A page's text: each run of text trimmed and on lines of its own, no blank ones. Null and empty give the empty text."""
    parser = _Texts()
    parser.feed(markup or "")
    parser.close()
    lines = (line.strip() for run in parser.runs for line in run.splitlines())
    return "\n".join(line for line in lines if line)


@pandas_udf(StringType())
def parsed_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Markup to text by a parser, in batches."""
    for s in pages:
        yield s.map(page_text)


def tokens(c: Column) -> Column:
    """Lower-case ASCII words; no empty ones."""
    return F.array_remove(F.split(F.lower(c), "[^a-z0-9]+"), "")


MARKED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđäëïöüßçñ"
PLAIN = "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyydaeiouscn"


def fold(c: Column) -> Column:
    """Lower case without marks; đ becomes d."""
    return F.translate(F.lower(c), MARKED, PLAIN)


def analyze(c: Column) -> Column:
    """Words of letters and digits of any script, folded."""
    return F.array_remove(F.split(fold(c), r"[^\p{L}\p{N}]+"), "")


def word_count(c: Column) -> Column:
    """Words between white space; 0 for null and blank."""
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", 0).otherwise(F.size(F.split(F.trim(c), r"\s+")))


def token_estimate(c: Column) -> Column:
    return word_count(c) * F.lit(1.3)


def cut_at_word(c: Column, most: int = 350) -> Column:
    """At most so many characters, cut at the last blank before."""
    return F.when(F.length(c) <= most, c).otherwise(F.regexp_extract(c, rf"(?s)^(.{{0,{most}}})(?=\s)", 1))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common words, between white space and in lower case, of two texts; 0 if one has none."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")) for t in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def phrase(words: str) -> str:
    """A pattern of whole words with any white space between them."""
    return rf"(?<!\w){words.replace(' ', r'\s+')}(?!\w)"


def has_negation(c: Column, words: Sequence[str] = tuple(NEGATIONS)) -> Column:
    return c.rlike("(?iuU)" + "|".join(map(phrase, words)))


def negation_scope(c: Column, words: Sequence[str] = tuple(NEGATIONS)) -> Column:
    """What follows the first listed phrase that occurs, up to punctuation; 100 characters where that comes at once. Null without one."""
    rest = F.coalesce(*(F.when(c.rlike(f"(?iuU){phrase(w)}"), F.regexp_extract(c, rf"(?iusU){phrase(w)}\s*(.*)$", 1)) for w in words))
    return F.trim(F.coalesce(F.nullif(F.regexp_extract(rest, r"^[^,.;!?]+", 0), F.lit("")), F.substring(rest, 1, 100)))


# Patterns of numbers with what they count, in the order of the result.
QUANTITIES: list[str] = [
    r"\d+\s*(?:năm|tháng|ngày|giờ|phút)", r"\d+[\d\s]*(?:triệu|tỷ|nghìn|ngàn|đồng|VNĐ|\$|%)", r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", r"\d{2}/\d{2}/\d{4}", r"\d+\.\d+", r"\d+%",
]


def quantities(c: Column) -> Column:
    """Times, money and shares, dates, decimals, percentages: all matches, pattern by pattern."""
    return F.concat(*(F.regexp_extract_all(c, F.lit(f"(?iuU){p}"), F.lit(0)) for p in QUANTITIES))


# How citations are written out, and the patterns they are found by, in the order of the result.
CITATIONS: list[tuple[str, str]] = [
    ("Điều {1}", r"Điều\s+(\d+[a-zA-Z]?(?:\.\d+)?)"),
    ("Luật {1} năm {2}", r"Luật\s+(.+?)\s+năm\s+(\d{4})"),
    ("Nghị định {1}", r"Nghị\s+định\s+(\d+/\d{4}/NĐ-CP)"),
    ("Thông tư {1}", r"Thông\s+tư\s+(\d+/\d{4}/TT-\w+)"),
    ("Khoản {1}", r"Khoản\s+(\d+[a-zA-Z]?(?:\.\d+)?)"),
    ("Điểm {1}", r"Điểm\s+([a-zA-Z]\d?)"),
    ("Chương {1}", r"Chương\s+(\d+|[IVX]+)"),
]


def rewritten(c: Column, form: str, pattern: str) -> Column:
    """All matches of a pattern, each written as ``form`` with its groups."""
    pattern = f"(?iuU){pattern}"
    bits = re.split(r"\{(\d)\}", form)  # text, group, text, ...

    def one(m: Column) -> Column:
        return F.concat(*(F.lit(x) if i % 2 == 0 else F.trim(F.regexp_extract(m, pattern, int(x))) for i, x in enumerate(bits)))

    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), one)


def citations(c: Column) -> Column:
    """Citations in one form, kind by kind, in the order of the text within a kind, each once."""
    return F.array_distinct(F.concat(*(rewritten(c, form, p) for form, p in CITATIONS)))


def variants(c: Column, synonyms: Mapping[str, Sequence[str]] | None = None, forms: Mapping[str, Sequence[str]] | None = None, most: int = 10) -> Column:
    """The text itself, then, sorted, what replacing whole words by their synonyms and parts by other forms gives; ``most`` at most."""
    whole = SYNONYMS if synonyms is None else synonyms
    parts = [*VERBS.items(), *CONCEPTS.items()] if forms is None else forms.items()
    made = [F.when(c.rlike(f"(?iuU){phrase(w)}"), F.regexp_replace(c, rf"(?iuU)(?<!\w){w}(?!\w)", v.replace("$", r"\$"))) for w, vs in whole.items() for v in vs]
    made += [F.when(c.contains(w), F.replace(c, F.lit(w), F.lit(v))) for w, vs in parts for v in vs]
    if not made:
        return F.array(c)
    others = F.array_sort(F.array_except(F.array_compact(F.array(*made)), F.array(c)))
    return F.slice(F.concat(F.array(c), others), 1, most)


def doc_type(c: Column, default: str = "other", kinds: Mapping[str, Sequence[str]] | None = None) -> Column:
    """The kind that is named first in the text."""
    kinds = KIND_WORDS if kinds is None else kinds
    at = [F.regexp_instr(c, F.lit("(?iuU)(?:" + "|".join(map(phrase, words)) + ")")) for words in kinds.values()]
    first = F.array_min(F.filter(F.array(*at), lambda x: x > 0))
    return F.coalesce(*(F.when(x == first, F.lit(kind)) for x, kind in zip(at, kinds, strict=True)), F.lit(default))


def map_type(c: Column, table: Mapping[str, str] | None = None, default: str = "other") -> Column:
    """A name looked up in a table of kinds, in any case."""
    table = DOC_TYPES if table is None else table
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(F.trim(c))), F.lit(default))


def document_number(c: Column) -> Column:
    """The number of a document, as in 59/2020/QH14: after the word for number, else the first of its head.

    Parts go up to the first that is a word: one with a small letter with a mark, or neither capital nor with a digit or dash.
    """
    named = F.nullif(F.regexp_extract(c, r"(?iuU)số\s*[:\s]\s*(\d+/[\w-]+(?:/[\w-]+)*)", 1), F.lit(""))
    head = F.nullif(F.regexp_extract(F.substring(c, 1, 300), r"(?U)(\d+/\d*/?[\w-]*)", 1), F.lit(""))
    parts = F.split(F.coalesce(named, head), "/")
    word = F.transform(parts, lambda p: p.rlike("[à-ỹđ&&[^A-Za-z]&&\\p{Ll}]") | ~(p.rlike(r"[\d-]") | (p.rlike(r"\p{L}") & (F.upper(p) == p))))
    stop = F.array_position(word, F.lit(True)).cast("int")
    return F.array_join(F.when(stop > 0, F.slice(parts, F.lit(1), stop - 1)).otherwise(parts), "/")


def law_id(number: Column) -> Column:
    """A document number that has more than its first part."""
    return F.when(number.rlike(r"^\d+/"), number)


def issuer(c: Column) -> Column:
    """The text's name of the first body of the list that it names."""
    return F.coalesce(*(F.nullif(F.regexp_extract(c, f"(?iuU){p}", 0), F.lit("")) for p in ISSUERS))


def root_id(c: Column) -> Column:
    """The document of an article, subsection or chunk id."""
    return F.regexp_replace(c, r"_(?:chunk|article|subsection)_.*$", "")


def host(c: Column) -> Column:
    """Host of a URL in lower case, without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), r"^www\.", "")


def normalize_citation(c: Column, words: Mapping[str, str] | None = None) -> Column:
    """A citation in normal form, with the words of document kinds capitalised, and an article at its start."""
    c = normalize_legal(c, words)
    for kind in ("luật", "nghị định", "thông tư", "quyết định"):
        c = F.regexp_replace(c, f"(?iuU){phrase(kind)}", kind.title())
    return F.trim(F.regexp_replace(c, r"(?iuU)^điều(?!\w)", "Điều"))


def ground(text: Column, known: Column) -> Column:
    """``[n]`` marks without an entry in ``known`` (array of int) removed, and spaces squeezed."""
    marks = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)))
    bad = F.filter(marks, lambda m: ~F.array_contains(known, F.expr("0") + m.cast("int")))
    out = F.aggregate(bad, text, lambda acc, m: F.replace(acc, F.concat(F.lit("["), m, F.lit("]")), F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(out, " {2,}", " "), r" +([.,;])", "$1"))
