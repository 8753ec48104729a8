"""Personal data, replaced by keyed surrogates. DataFrame functions only.

Emails, phone numbers, IP addresses of both versions, payment cards (with a
valid check digit), IBANs, US social security numbers, access tokens and titled
names are found by one pattern; where a text has titled names, their words are
found without a title too. Each distinct entity of the corpus gets one
surrogate, from a keyed hash: of the same type, script and format, names with
the gender of the title. A surrogate that another entity has, or that is an
entity of the corpus itself, is drawn again, and from the third draw on grows
by a character each time, so that distinct entities stay distinct however many
there are, and all mentions of one entity, in whatever format, get the same
surrogate.

Not looked for: names without any title in their text, postal addresses, dates.
Initials, particles and titles of names stay, and so does the top-level domain.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

# Formats of personal data, and titles that go before names.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}][\p{L}\p{N}.-]*\.\p{L}{2,}"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,6}(?!\d)|(?<!\w)(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w-])"
IP = r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\w)"
IPV6 = r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"
CARD = r"(?<![\w.-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?![\w-])"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
SECRET_LEAD = r"(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY) ?[=:] ?[\"']?"
SECRET = rf"(?<!\w){SECRET_LEAD}[A-Za-z0-9_+/=.~-]{{16,}}"
TOKEN_LEAD = r"(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|eyJ)"  # heads of well-known kinds of access tokens
TOKEN = rf"(?<![\w-]){TOKEN_LEAD}[A-Za-z0-9_.-]{{16,}}"
MALE = r"Mr\.?|Sir|Herr|Monsieur|Señor|Sr\.|г-н|Господин"
FEMALE = r"Mrs\.?|Ms\.?|Miss|Lady|Frau|Madame|Mme|Señora|Sra\.|г-жа|Госпожа"
EITHER = r"Dr\.?|Doctor|Prof\.?|Professor"
TITLE = rf"(?:{MALE}|{FEMALE}|{EITHER})"
PARTICLE = r"(?:de|da|di|du|del|della|la|le|van|von|der|den|ter|zu|bin|ibn|al|el)"
NAME_WORD = rf"(?!{TITLE} )(?:\p{{Lu}}\.|(?:\p{{L}}['’])?\p{{Lu}}[\p{{L}}\p{{M}}'’-]+|\p{{Lo}}[\p{{L}}\p{{M}}]*)"
NAME = rf"(?<!\w){TITLE} (?:{TITLE} )?{NAME_WORD}(?: (?:{PARTICLE} ){{0,3}}{NAME_WORD}){{0,15}}"
ANY = "|".join((EMAIL, PHONE, IP, IPV6, SSN, CARD, IBAN, SECRET, TOKEN, NAME))
# cheap, and true of every text that ANY is found in: phones begin with + and a digit or end in four digits, IBANs begin with two letters and two digits
HINT = r"@|\+\d|[A-Z]{2}\d{2}|\d{4}|\d\.\d|\d-\d|:[0-9A-Fa-f]{0,4}:|[=:] ?[\"']?[A-Za-z0-9_+/=.~-]{16}|" + rf"{TOKEN_LEAD}|{TITLE} "
EDGE = r"[\p{L}\p{M}\p{N}_]"  # what a word of a name does not stand next to

SYLLABLES = {
    "Latin": "ba be bi bo da de di do fa fe ga ge ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi vo".split(),
    "Cyrillic": "ба бе би бо да де ди до га ка ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то ва ве ви во".split(),
    "Greek": "βα βε βι βο δα δε δι δο γα κα κι κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε σι σο τα τε τι το φα φε φι φο".split(),
    "Han": list("安白长春大德东方广国海和华家建江金康乐林明宁平清山石思天文西新星雪雅阳英永元云"),
    "Kana": "あき いく うみ えい おか かわ きた くに こう さと しま すず たか つき とも なか にし はる ひろ ふじ まつ みな もり やま ゆき".split(),
    "Hangul": list("가강경고광구국규기나남다대도동라란려로리마명무미민배병보빈상서선성소수"),
    "Arabic": "با بي دا دي را ري سا سي فا في كا كي لا لي ما مي نا ني ها هي".split(),
    "Hebrew": "בא בי דא די גא גי לא לי מא מי נא ני רא רי שא שי תא תי".split(),
    "Devanagari": "का कि गा जा ता दा ना नि पा बा मा मि या रा रि ला वा सा सि हा".split(),
}
ENDINGS = {
    ("Latin", "given_m"): ["n", "r", "s", "rk"], ("Latin", "given_f"): ["na", "lia", "ra", "sa"], ("Latin", "surname"): ["son", "ler", "mont", "dt"],
    ("Cyrillic", "given_m"): ["н", "р", "с", "рк"], ("Cyrillic", "given_f"): ["на", "лия", "ра", "са"], ("Cyrillic", "surname"): ["нко", "рук", "вич", "дзе"],
    ("Greek", "given_m"): ["νος", "ρης", "σος", "κος"], ("Greek", "given_f"): ["να", "λια", "ρα", "σα"], ("Greek", "surname"): ["νου", "κη", "ρα", "δου"],
    ("Han", "given_m"): ["伟", "强", "军", "刚"], ("Han", "given_f"): ["芳", "娜", "丽", "静"], ("Kana", "given_m"): ["お", "た", "ろう", "すけ"], ("Kana", "given_f"): ["こ", "み", "え", "か"],
    ("Hangul", "given_m"): ["호", "준", "철", "석"], ("Hangul", "given_f"): ["희", "숙", "자", "은"], ("Arabic", "given_m"): ["د", "ر", "م", "ن"], ("Arabic", "given_f"): ["اء", "ة", "ى", "ية"],
    ("Hebrew", "given_m"): ["ן", "ר", "ם", "ל"], ("Hebrew", "given_f"): ["ה", "ית", "נה", "לה"], ("Devanagari", "given_m"): ["ज", "त", "न", "श"], ("Devanagari", "given_f"): ["नी", "ती", "ला", "या"],
}
NAMES = ("given_m", "given_f", "given_x", "surname")
SCRIPTS = {"Cyrillic": r"\p{IsCyrillic}", "Greek": r"\p{IsGreek}", "Han": r"\p{IsHan}", "Kana": r"[\p{IsHiragana}\p{IsKatakana}]", "Hangul": r"\p{IsHangul}", "Arabic": r"\p{IsArabic}", "Hebrew": r"\p{IsHebrew}", "Devanagari": r"\p{IsDevanagari}"}
HOT_MENTIONS, HOT_ENTITIES = 50_000, 10_000  # mentions from which an entity is broadcast with its surrogate, and how many such there can be
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def luhn_sum(d: Column) -> Column:
    """Sum of the Luhn rule over a string of digits, the last one counted plainly."""
    n = F.length(d)
    each = F.transform(F.split(d, ""), lambda x, i: F.when(F.pmod(n - 1 - i, F.lit(2)) == 0, x.cast("int")).otherwise(F.expr("0") + F.pmod(x.cast("int") * 2, F.lit(10)) + F.floor(x.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x.cast("int"))


def part(kind: Column | str, text: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), text.alias("text"))


def given_kind(m: Column) -> Column:
    return F.when(m.rlike(rf"^(?:{FEMALE}) "), "given_f").when(m.rlike(rf"^(?:{MALE}) "), "given_m").otherwise("given_x")


def name_parts(m: Column) -> Column:
    """A titled name as (kind, text): the title, then spaces and words in turn; the last word is the surname."""
    title = F.regexp_extract(m, rf"^{TITLE} (?:{TITLE} )?", 0)
    words = F.split(F.substring(m, F.length(title) + 1, F.lit(1 << 30)), " ")
    kept = lambda w: w.rlike(rf"^(?:{PARTICLE}|\p{{Lu}}\.)$")
    each = F.transform(words, lambda w, i: F.array(part("", F.when(i > 0, " ").otherwise("")), part(F.when(kept(w), "").when(i == F.size(words) - 1, "surname").otherwise(given_kind(m)), w)))
    return F.concat(F.array(part("", title)), F.flatten(each))


def named(m: Column) -> Column:
    return m.rlike(rf"^{TITLE} ") & ~m.contains("@")


def parts(m: Column, known: Column | None = None) -> Column:
    """A match as (kind, text) pieces; kind '' stays as it is. ``known``: (kind, text) of the words of names, for a match that is one of them."""
    whole = lambda kind: F.array(part(kind, m))
    lead = F.regexp_extract(m, rf"^{SECRET_LEAD}", 0)
    head = F.regexp_extract(m, rf"^{TOKEN_LEAD}", 0)
    behind = lambda start: F.array(part("", start), part("secret", F.substring(m, F.length(start) + 1, F.length(m))))
    bare = F.lit(None).cast("string") if known is None else F.get(F.filter(known, lambda k: F.lower(k["text"]) == F.lower(m)), F.lit(0))["kind"]
    return (
        F.when(m.contains("@"), whole("email"))
        .when(m.rlike(rf"^(?:{SECRET_LEAD})"), behind(lead))
        .when(named(m), name_parts(m))
        .when(bare.isNotNull(), F.array(part(bare, m)))
        .when(m.rlike(rf"^{TOKEN_LEAD}"), behind(head))
        .when(m.rlike(rf"^(?:{IP})$"), whole("ip"))
        .when(m.rlike(r"^[0-9A-Fa-f]{1,4}:"), whole("ipv6"))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), whole("ssn"))
        .when(m.rlike(rf"^(?:{CARD})$"), F.when(F.pmod(luhn_sum(digits(m)), F.lit(10)) == 0, whole("card")).otherwise(whole("")))
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), whole("iban"))
        .otherwise(whole("phone"))
    )


def canonical(kind: Column, text: Column) -> Column:
    """What mentions of one entity have in common."""
    return (
        F.when(kind.isin("phone", "card", "ssn"), digits(text))
        .when(kind == "iban", F.regexp_replace(text, " ", ""))
        .when(kind.isin("secret", "ip"), text)
        .otherwise(F.lower(text))
    )


def script_of(c: Column) -> Column:
    out = F.lit("Latin")
    for name, letters in SCRIPTS.items():
        out = F.when(c.rlike(f"^{letters}"), name).otherwise(out)
    return out


def growth(attempt: int) -> int:
    """Characters (of names: syllables) that a surrogate is longer by; never short of free ones for long."""
    return max(0, attempt - 2)


def stream(kind: Column, c: Column, attempt: int, key: str) -> Column:
    """Numbers of 16 bits from a keyed hash of the entity, more than its surrogate has characters (16 at least)."""

    def block(seed: Column, b: Column) -> Column:
        h = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, seed, F.lit(str(attempt)), b.cast("string")), 256)
        return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))

    # a long secret is hashed once, not again for each 16 of its characters
    seeds = F.array(F.when(F.length(c) > 144, F.sha2(c, 256)).otherwise(c))
    blocks = F.sequence(F.lit(0), F.floor((F.length(c) + growth(attempt) + 4) / 16).cast("int"))
    return F.flatten(F.flatten(F.transform(seeds, lambda seed: F.transform(blocks, lambda b: block(seed, b)))))


def at(alphabet: str, v: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(v, F.lit(len(alphabet))) + 1, F.lit(1))


def alike(text: Column, v: Column, skip: int = 0) -> Column:
    """Each digit and letter of ``text`` from the stream, by class; the first ``skip`` characters stay."""

    def one(x: Column, i: Column) -> Column:
        n = F.get(v, i)
        new = F.when(x.between("0", "9"), at(DIGITS, n)).when(x.between("a", "z"), at(LOWER, n)).when(x.between("A", "Z"), at(UPPER, n)).when(x.rlike(r"\p{L}"), at(LOWER, n)).when(x.rlike(r"\p{Nd}"), at(DIGITS, n)).otherwise(x)
        return F.when(i < skip, x).otherwise(new)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def alike_hex(text: Column, v: Column) -> Column:
    """As many hexadecimal digits as ``text`` has."""
    return F.array_join(F.transform(F.split(text, ""), lambda x, i: at(HEX, F.get(v, i))), "")


def surrogate(kind: Column, c: Column, attempt: int, key: str, v: Column) -> Column:
    """The surrogate, in canonical form."""
    longer = growth(attempt)
    pick = lambda table, i: F.get(F.array(*map(F.lit, table)), F.pmod(F.get(v, F.lit(i)), F.lit(len(table))))
    name, script = F.lit(None).cast("string"), script_of(c)
    for s, syllables in SYLLABLES.items():
        count = {"Han": 1, "Hangul": 1, "Kana": 1}.get(s, 3)
        for k in NAMES:
            both = [*ENDINGS[s, "given_m"], *ENDINGS[s, "given_f"]]
            ends = ENDINGS.get((s, k)) or (both if k == "given_x" else ENDINGS.get((s, "surname"), syllables))
            name = F.when((script == s) & (kind == k), F.concat(*(pick(syllables, i) for i in range(count + longer)), pick(ends, count + longer))).otherwise(name)
    more = lambda alphabet: F.concat(*(at(alphabet, F.get(v, F.length(c) + i)) for i in range(longer))) if longer else F.lit("")
    tail = F.regexp_extract(c, r"\.[^.@]+$", 0)  # the top-level domain of an email
    head = alike(F.substring(c, F.lit(1), F.length(c) - F.length(tail)), v)
    mail = F.concat(F.substring_index(head, "@", 1), more(LOWER), F.lit("@"), F.substring_index(head, "@", -1), tail)
    body = F.concat(F.substring(alike(c, v, skip=1), F.lit(1), F.length(c) - 1), more(DIGITS))
    check = F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    octet = lambda i, base, n: (F.lit(base) + F.pmod(F.get(v, F.lit(i)), F.lit(n))).cast("string")
    hextets = [F.lower(F.hex(F.get(v, F.lit(i)))) for i in range(6)]
    return (
        F.when(kind == "email", mail)
        .when(kind == "card", F.concat(body, check.cast("string")))
        .when((kind == "ip") & F.lit(longer < 8), F.concat_ws(".", octet(0, 1, 223), octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254)))
        .when(kind.isin("ip", "ipv6"), F.concat_ws(":", F.lit("2001"), F.lit("db8"), *hextets))  # once no address of the shorter kind is left
        .when(kind == "phone", F.concat(alike(c, v, skip=1), more(DIGITS)))
        .when(kind == "iban", F.concat(alike(c, v, skip=2), more(DIGITS)))
        .when((kind == "secret") & c.rlike("^[0-9a-f]+$"), F.concat(alike_hex(c, v), more(HEX)))
        .when(kind == "secret", F.concat(alike(c, v), more(HEX)))
        .when(kind == "ssn", F.concat(alike(c, v), more(DIGITS)))
        .otherwise(name)
    )


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, sur): a surrogate for each distinct entity, none shared and none an entity itself."""
    done, left = None, entities
    own = entities.select("kind", F.col("canon").alias("sur"))
    for attempt in count():
        drawn = left.withColumn("v", stream(F.col("kind"), F.col("canon"), attempt, key)).select("kind", "canon", surrogate(F.col("kind"), F.col("canon"), attempt, key, F.col("v")).alias("sur"))
        first = drawn.withColumn("r", F.row_number().over(Window.partitionBy("kind", "sur").orderBy("canon")))
        free = first.where("r = 1").drop("r").join(own, ["kind", "sur"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "sur"), ["kind", "sur"], "left_anti")
        free = cut(free.select("kind", "canon", "sur"), "surrogates")
        done = free if done is None else done.unionByName(free)
        left = cut(left.join(free, ["kind", "canon"], "left_anti"), "unassigned")
        if left.isEmpty():
            return done


def written(kind: Column, text: Column, sur: Column) -> Column:
    """The surrogate in the format of the mention."""
    gaps = F.split(text, r"[0-9]")
    numbered = F.array_join(F.zip_with(gaps, F.split(sur, ""), lambda g, d: F.concat(F.coalesce(g, F.lit("")), F.coalesce(d, F.lit("")))), "")
    words = F.split(text, " ")
    spaced = F.array_join(F.transform(words, lambda x, i: F.substring(sur, F.length(F.array_join(F.slice(words, F.lit(1), i), "")) + 1, F.when(i < F.size(words) - 1, F.length(x)).otherwise(1 << 30))), " ")
    return (
        F.when(kind.isin("phone", "card", "ssn"), numbered)
        .when(kind == "iban", spaced)
        .when(kind.isin(*NAMES), F.when((F.upper(text) == text) & (F.lower(text) != text), F.upper(sur)).otherwise(F.initcap(sur)))
        .when(kind.isin("email", "ipv6") & (F.upper(text) == text), F.upper(sur))
        .otherwise(sur)
    )


def replace(docs: DataFrame, key: str, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``docs`` with surrogates in ``text_col``, and the entities (kind, canon, sur).

    ``key`` is a secret: who has it can tell which surrogate an entity gets. All
    columns and rows stay; null and empty texts stay as they are. Numbers that
    fail their check digit are no cards and stay. Texts are searched once and
    written with what was found; of these, only texts with a match move.
    """
    if not key:
        raise ValueError("surrogates need a key")
    text = F.col(f"`{text_col}`")
    every = lambda pattern: F.regexp_extract_all(text, pattern, F.lit(0))
    found = F.when(F.coalesce(text.rlike(HINT), F.lit(False)), every(F.lit(f"(?:{ANY})")))
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.coalesce(found, F.array().cast("array<string>")).alias("found"))
    rows = cut(rows, "pii-found")
    hits = rows.where(F.size("found") > 0)
    # texts with titled names are searched again for the words of these names without a title
    names = F.flatten(F.transform(F.filter("found", named), lambda m: F.filter(name_parts(m), lambda p: (p["kind"] != "") & (F.length(p["text"]) > 1))))
    spelt = F.array_distinct(F.flatten(F.transform(F.col("known")["text"], lambda w: F.array(w, F.upper(w), F.initcap(w)))))
    words = F.array_join(F.transform(spelt, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), "|")
    pattern = F.when(F.size("known") > 0, F.concat(F.lit(f"(?:{ANY}|(?<!{EDGE})(?:"), words, F.lit(f")(?!{EDGE}))"))).otherwise(F.lit(f"(?:{ANY})"))
    text = F.col("row")[text_col]
    hits = hits.withColumn("known", F.array_distinct(names)).withColumn("pattern", pattern)
    hits = hits.withColumn("found", F.when(F.size("known") > 0, every(F.col("pattern"))).otherwise(F.col("found")))
    hits = hits.select(F.monotonically_increasing_id().alias("uid"), "row", F.split(text, F.col("pattern"), -1).alias("gaps"), F.transform("found", lambda m: parts(m, F.col("known"))).alias("found"))
    hits = cut(hits, "pii-hits")
    mention = hits.select("uid", F.posexplode("found").alias("i", "p")).select("uid", "i", F.posexplode("p").alias("j", "x")).select("uid", "i", "j", "x.kind", "x.text")
    mention = mention.withColumn("canon", canonical(F.col("kind"), F.col("text")))
    counted = cut(mention.where("kind <> ''").groupBy("kind", "canon").agg(F.count("*").alias("n")), "entities")
    table = assign(counted.select("kind", "canon"), key)
    told = with_surrogates(mention, table, counted).select("uid", "i", "j", F.coalesce(written(F.col("kind"), F.col("text"), F.col("sur")), "text").alias("t"))
    texts = told.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("i", "j", "t"))).alias("told"))
    joined = hits.join(texts, "uid")
    new = F.concat(
        F.array_join(F.transform("told", lambda x: F.concat(F.when(x["j"] == 0, F.get(F.col("gaps"), x["i"])).otherwise(F.lit("")), x["t"])), ""),
        F.element_at("gaps", -1),
    )
    changed = joined.select(F.col("row").withField(f"`{text_col}`", new).alias("row"))
    same = rows.where(F.size("found") == 0).select("row")
    return same.unionByName(changed).select("row.*"), table


def with_surrogates(mention: DataFrame, table: DataFrame, counted: DataFrame) -> DataFrame:
    """Mentions with their surrogates. Entities that very many mentions have are few, and joined where the mentions are."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    often = max(HOT_MENTIONS, total // HOT_ENTITIES)  # so at most HOT_ENTITIES entities have as many
    keys = ["kind", "canon"]
    hot = cut(counted.where(F.col("n") > often).select(*keys).join(table, keys), "hot-entities")
    if hot.isEmpty():
        return mention.join(table, keys, "left")
    marked = mention.join(F.broadcast(hot), keys, "left")
    rest = marked.where("sur is null").drop("sur").join(table.join(F.broadcast(hot.drop("sur")), keys, "left_anti"), keys, "left")
    return marked.where("sur is not null").unionByName(rest)
