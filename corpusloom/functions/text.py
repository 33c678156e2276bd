"""Column functions on text: numbers and titles, keys, dates, releases, names, ids, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the semantics of releases, names and categories are defined by.
RELEASE_ANY_MIN, RELEASE_ANY_MAX = 0, 9999
MAX_SLUG = 100
CATEGORIES = ("installation", "administration", "authentication", "infrastructure", "upgrade", "performance", "applications", "functional", "troubleshooting")
CATEGORY_RULES = (
    ("troubleshooting", r"troubleshoot"),
    ("installation", r"install|deploy|fix ?pack|\bfp\d{4}|haproxy|load ?balancer|adfs|\bga\b|ssl between"),
    ("upgrade", r"upgrade|migrat"),
    ("performance", r"performance (checklist|optimi|trace)|tuning|large assembl|crash|hang|memory dump|database locks?|timeout|security mask|r&d recommended|fiddler|columbo"),
    ("authentication", r"saml|\bsso\b|single sign|ldap|kerberos|authenticat|notification"),
    ("infrastructure", r"load balancing|security (checkpoint|privacy)|cloud security|\bf5\b"),
    ("administration", r"\bindex|catsettings|monitoring|maintenance|trace dictionary|admin|widget|backup|email|launcher"),
    ("functional", r"\brole\b|\bfp\b|functional|presentation|deep dive|manager|costing|pricing|best ?practice|\b(ccm|cfg|chg|chp|csv|dey|dpm)\b|engineering|requirements|xpdm|design|catia|material"),
)
DEFAULT_CATEGORY = "administration"
STOP_WORDS = ("a", "an", "and", "for", "in", "of", "on", "or", "the", "to", "with")
SECTION_NUMBER = r"^(\d{1,2}(?:\.\d{1,2}){0,4})\.?\s+(?=\S)"
RELEASE = r"(?i)^(?:V6)?R(\d{4})x$"
RELEASE_TOKEN = r"(?i)(?<![0-9])(?<![0-9]\.)(?:v6)?r?(?:20)?(1[3-9]|2\d|3[0-5])x(?=fp|ga|hf|[^a-z0-9]|$)"
NAMED_RELEASE = r"(?i)\b(?:V6)?R(20\d\d)x\b"
VERSION_AT_END = r"(?i)[\s_\-(.]+(?:v|rev\.?\s*)(\d+(?:[._]\d+)*)\)?(?:[\s_\-]+(?:internal|external|final|draft|en))*\s*$"
PRODUCT_GENERATION = r"(?i)(?:enovia|catia|simulia|delmia|solidworks|3dexperience)[\s_\-]*$"
URL = r"https?://[^\s<>()\[\]{}|`'\"]+"


def strip(text: Column) -> Column:
    """Without white space (any, not only blanks) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def let(value: Column, then) -> Column:
    """then(value) with value evaluated once, however often it is used in there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.size(words(text))


def section_number(text: Column) -> Column:
    """'3.1. The file' -> '3.1'; null without a number."""
    found = F.regexp_extract(strip(text), SECTION_NUMBER, 1)
    return F.when(found != "", found)


def without_number(text: Column) -> Column:
    return strip(F.regexp_replace(strip(text), SECTION_NUMBER, ""))


def title_key(text: Column) -> Column:
    """The title's lower-case letters and digits, without number and without words of digits only."""
    found = F.split(F.regexp_replace(F.lower(without_number(text)), "[^a-z0-9]+", " "), " ")
    return F.array_join(F.filter(found, lambda w: (w != "") & ~w.rlike("^[0-9]+$")), " ")


def content_words(key: Column) -> Column:
    return F.array_except(F.filter(F.split(key, " "), lambda w: w != ""), F.array(*map(F.lit, STOP_WORDS)))


def line_key(text: Column) -> Column:
    """A line's key among repeated lines: lower case, single blanks, digits as #."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(text)), r"\s+", " "), r"\d+", "#")


def question_key(text: Column) -> Column:
    """A question as the cache compares it."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"[?!. ]+$", ""))


def match_key(text: Column) -> Column:
    """Lower case, without Markdown marks, single blanks: for finding a string in an answer."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[`*_]", ""), r"\s+", " "))


def holds(answer: Column, needle: Column) -> Column:
    return F.contains(match_key(answer), match_key(needle))


def letters_digits(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def release_year(text: Column) -> Column:
    """'V6R2013x' -> 2013; null where it is no release."""
    return F.regexp_extract(strip(text), RELEASE, 1).try_cast("int")


def release_label(low: Column, high: Column) -> Column:
    r = lambda y: F.concat(F.lit("R"), y.cast("string"), F.lit("x"))
    return (
        F.when((low == RELEASE_ANY_MIN) & (high == RELEASE_ANY_MAX), "any")
        .when(high == RELEASE_ANY_MAX, F.concat(r(low), F.lit("+")))
        .when(low == RELEASE_ANY_MIN, F.concat(F.lit("up to "), r(high)))
        .when(low == high, r(low))
        .otherwise(F.concat(r(low), F.lit("-"), r(high)))
    )


def releases_named(text: Column) -> Column:
    """Years of the releases a file name or cover names, in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(RELEASE_TOKEN), 1), lambda y: y.cast("int") + 2000))


def releases_asked(text: Column) -> Column:
    """Years of the releases a question names in full (R2025x), in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NAMED_RELEASE), 1), lambda y: y.cast("int")))


def iso_date(text: Column) -> Column:
    """A date written Y-M-D, M/D/Y or D.M.Y as YYYY-MM-DD; '' stays ''; anything else is null."""
    t = strip(text)
    read = (
        F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.expr("1") * 0 + 1)
        .when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), 2)
        .when(t.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), 3)
    )
    part = F.split(t, r"[-/.]")
    at = lambda i: F.get(part, F.lit(i))
    whole = lambda y, m, d: F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    text_date = F.when(read == 1, whole(at(0), at(1), at(2))).when(read == 2, whole(at(2), at(0), at(1))).when(read == 3, whole(at(2), at(1), at(0)))
    return F.when(t == "", "").otherwise(F.when(F.try_to_date(text_date, "yyyy-MM-dd").isNotNull(), text_date))


def name_version(stem: Column) -> Column:
    """The version a file name ends with ('Guide_V2' -> '2.0'), null without one or after a product's generation."""
    found = F.regexp_extract(stem, VERSION_AT_END, 1)
    before = F.regexp_replace(stem, VERSION_AT_END, "_")
    numbers = F.transform(F.split(F.replace(found, F.lit("_"), F.lit(".")), r"\."), lambda p: p.try_cast("int").cast("string"))
    made = F.when(F.size(numbers) == 1, F.concat(F.array_join(numbers, "."), F.lit(".0"))).otherwise(F.array_join(numbers, "."))
    return F.when((found != "") & ~before.rlike(PRODUCT_GENERATION), made)


def name_base(stem: Column) -> Column:
    """A file name without the version it ends with."""
    return F.when(name_version(stem).isNotNull(), F.regexp_replace(stem, VERSION_AT_END, "")).otherwise(stem)


def slug(text: Column) -> Column:
    """Lower case with '-' between words; a long one is cut and ends in a short hash of the whole."""
    made = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(made, 1, MAX_SLUG - 7), "-+$", "")
    return F.when(F.length(made) <= MAX_SLUG, made).otherwise(F.concat_ws("-", cut, F.substring(F.sha1(F.lower(text)), 1, 6)))


def guess_category(path: Column) -> Column:
    """The first rule whose pattern the words of a path match."""
    line = F.regexp_replace(F.lower(path), r"[_\-/\\]+", " ")
    made = F.lit(DEFAULT_CATEGORY)
    for category, pattern in reversed(CATEGORY_RULES):
        made = F.when(line.rlike(pattern), category).otherwise(made)
    return made


def version_key(version: Column) -> Column:
    """'1.10' -> [1, 10]; arrays compare as version numbers do."""
    return F.transform(F.split(version, r"\."), lambda p: p.try_cast("int"))


def point_id(chunk_id: Column, namespace: str) -> Column:
    """UUID of version 5 in a namespace, from built-in functions."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(chunk_id, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def page_text(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("p. "), first.cast("string"))).otherwise(F.concat(F.lit("pp. "), first.cast("string"), F.lit("-"), last.cast("string")))


def json_body(text: Column) -> Column:
    """The JSON inside a fenced block, or the text itself."""
    inside = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(inside != "", inside).otherwise(strip(text))
