"""Column expressions that clean raw registry text. All of them keep null as null unless they say otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used; expressions inside of lambdas share nothing by themselves."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def call(function: str, value: Column, body: str, *more: Column) -> Column:
    """A higher-order function with a lambda in SQL text. Rules of many parts are put together as text, which is parsed at once, not as thousands of calls of the driver."""
    return F.call_function(function, value, *more, F.expr(body))


def let_sql(value: Column, body: str) -> Column:
    """:func:`let` with a lambda in SQL text, such as ``t -> upper(t)``."""
    return F.get(call("transform", F.array(value), body), F.lit(0))


def first_present(*columns: str | Column) -> Column:
    """The first of several columns that is neither null nor the empty string."""
    return F.coalesce(*(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns))


# The characters of Unicode's white space, which are those of the pattern ``(?U)\s``.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(c: Column) -> Column:
    """Without Unicode white space at both ends. Only the ends are looked at; a pattern would be tried at every character."""
    return F.btrim(c, F.lit(WHITE))


def clean_text(c: Column) -> Column:
    """Without Unicode white space at both ends; empty becomes null."""
    return F.nullif(trimmed(c), F.lit(""))


def normalize_date(c: Column) -> Column:
    """``YYYY-M-D`` or ``YYYY/M/D`` as a date; anything else, and days that don't exist, become null."""
    pattern = r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})$"
    c = clean_text(c)
    parts = [F.regexp_extract(c, pattern, k) for k in (1, 2, 3)]
    iso = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    return F.when(c.rlike(pattern), F.try_to_date(iso, "yyyy-MM-dd"))


def normalize_time(c: Column) -> Column:
    """``H:MM`` as ``HH:MM``, else null; hours and minutes aren't checked."""
    c = clean_text(c)
    return F.when(c.rlike(r"^[0-9]{1,2}:[0-9]{2}$"), F.lpad(c, 5, "0"))


def normalize_zip(c: Column) -> Column:
    """Seven digits as ``NNN-NNNN``, else the cleaned text."""
    c = clean_text(c)
    digits = F.regexp_replace(F.translate(c, "０１２３４５６７８９", "0123456789"), r"[^0-9]", "")
    return F.when(F.length(digits) == 7, F.concat_ws("-", F.substring(digits, 1, 3), F.substring(digits, 4, 4))).otherwise(c)


def split_area(c: Column) -> tuple[Column, Column]:
    """``code;name`` cut at the first semicolon; empty parts become null."""
    code = F.nullif(F.substring_index(c, ";", 1), F.lit(""))
    name = F.when(F.instr(c, ";") > 0, F.nullif(F.substring(c, F.instr(c, ";") + 1, F.length(c)), F.lit("")))
    return code, name


def clean_codes(codes: Column) -> Column:
    """Codes of an array, each cut at ASCII or full-width commas and trimmed; blanks are dropped, null is empty."""
    parts = F.flatten(F.transform(F.coalesce(codes, F.array().cast("array<string>")), lambda x: F.split(F.coalesce(x, F.lit("")), "[,，]")))
    return F.filter(F.transform(parts, trimmed), lambda x: x != "")


def code_labels(codes: Column, labels: dict[str, str]) -> Column:
    """Labels of cleaned codes; an unknown code is called after itself."""
    table = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return F.transform(codes, lambda x: F.coalesce(F.try_element_at(table, x), F.concat(F.lit("分類"), x)))


def short_hash(prefix: str, payload: Column, n: int = 12) -> Column:
    """``PREFIX_`` and the first digits of the payload's MD5."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.md5(payload.cast("binary")), 1, n))


def months_text(c: Column) -> Column:
    """An age in months as ``X歳Yか月``; zero is ``0歳``; below zero the years are, and months count up from them."""
    y, m = F.floor(c / 12), F.pmod(c, F.lit(12))
    parts = F.concat(F.when(y != 0, F.concat(y.cast("string"), F.lit("歳"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("か月"))).otherwise(""))
    return F.when(parts == "", F.lit("0歳")).otherwise(parts)


def age_label(lo: Column, hi: Column) -> Column:
    """``A〜B``, ``A以上`` or ``B以下``; null if both bounds are missing."""
    a, b = months_text(lo), months_text(hi)
    return F.when(lo.isNotNull() & hi.isNotNull(), F.concat(a, F.lit("〜"), b)).when(lo.isNotNull(), F.concat(a, F.lit("以上"))).when(hi.isNotNull(), F.concat(b, F.lit("以下")))


def profile_age(c: Column) -> Column:
    """An age in months as years, and months if there are some; the years are always said."""
    years = F.concat(F.floor(c / 12).cast("string"), F.lit("歳"))
    return F.when(c % 12 > 0, F.concat(years, (c % 12).cast("string"), F.lit("か月"))).when(c.isNotNull(), years)


def shown_age(source: Column, lo: Column, hi: Column) -> Column:
    """The age range as it is shown; inferred ranges say so, and nothing is made up where nothing is known."""
    one = lambda c: F.when(c < 12, F.concat((c % 12).cast("string"), F.lit("か月"))).otherwise(profile_age(c))
    span = F.concat(F.coalesce(one(lo), F.lit("")), F.lit("〜"), F.coalesce(one(hi), F.lit("")))
    known = (lo.isNotNull() | hi.isNotNull()) & (F.coalesce(source, F.lit("")) != "unknown")
    return F.when(known, F.concat(F.lit("対象 "), span, F.when(source == "inferred", "（推定）").otherwise(""))).otherwise("対象年齢の記載なし")


def full_months(birth: Column, today: Column) -> Column:
    """Whole months from birth to a given day; a month counts when its day of the month is reached; never below zero."""
    months = (F.year(today) - F.year(birth)) * 12 + F.month(today) - F.month(birth)
    return F.greatest(months - F.when(F.day(today) < F.day(birth), 1).otherwise(0), F.lit(0))


# --- links inside of text: ``title;https://...`` -----------------------------------------------------------------

# Where a link's address ends, the extensions of files, and what no text with a link lacks.
_STOP = r"\s|（）();,、・。<>"
_EXT = r"(?i:\.(?:html?|pdf|jpe?g|png|gif|xlsx?|docx?|pptx?|csv|zip))"
_ASCII = rf"[\x00-\x7F&&[^{_STOP}]]"
_WIDE = rf"[\p{{L}}\p{{N}}&&[^\x00-\x7F\u3041-\u309F{_STOP}]]"
LINK_CUE = ";http"
LINK = (
    rf"(?U)(?=[^\n;|。]{{0,80}}?;https?://[^{_STOP}])[\s&&[^\n]]*+([^\n;|。]*?)[\s&&[^\n]]*;"
    rf"(https?://(?:(?:(?!{_EXT})(?:{_ASCII}|{_WIDE}))*+{_ASCII}*{_EXT}(?=(?:(?!{_EXT}){_ASCII})*{_WIDE})|(?:{_ASCII}|{_WIDE})*))"
    rf"([^{_STOP}]*)"
)


# Marks around the address of a link, and a link between them.
_MARKS = "\u0001\u0002"
MARKED = "\u0001([^\u0002]*)\u0002([^\u0002]*)\u0002()"


def split_links(c: Column) -> Column:
    """struct(links: array of (title, uri), plain): the links of ``title;uri`` in a text, and the text without addresses.

    The pattern of links costs most, so it is tried once and marks what it finds; a text that has the marks itself is read by that pattern throughout.
    """
    def linked(t: Column, pattern: str) -> Column:
        titles, uris = F.regexp_extract_all(t, F.lit(pattern), 1), F.regexp_extract_all(t, F.lit(pattern), 2)
        pairs = F.transform(F.arrays_zip(titles.alias("t"), uris.alias("u")), lambda x: F.struct(
            F.when(~x["t"].rlike(r"^https?://\S*$"), clean_text(x["t"])).alias("title"), x["u"].alias("uri")))
        return F.struct(pairs.alias("links"), clean_text(F.regexp_replace(t, pattern, "$1$3")).alias("plain"))

    marked = lambda t: F.regexp_replace(t, LINK, "\u0001$1\u0002$2\u0002$3")
    found = lambda t: F.when(F.translate(t, _MARKS, "") == t, let(marked(t), lambda m: linked(m, MARKED))).otherwise(linked(t, LINK))
    bare = lambda t: F.struct(F.array().cast("array<struct<title:string,uri:string>>").alias("links"), clean_text(t).alias("plain"))
    return let(c, lambda t: F.when(t.contains(LINK_CUE), found(t)).otherwise(bare(t)))


def dedupe_links(links: Column) -> Column:
    """One link per uri, the first one, in order."""
    first = lambda v: F.filter(v["links"], lambda x, i: F.array_position(v["uris"], x["uri"]) == i + 1)
    return let(links, lambda v: let(F.struct(v.alias("links"), v["uri"].alias("uris")), first))


def normalize_links(links: Column) -> Column:
    """Links that have a uri, with cleaned titles."""
    kept = F.filter(F.coalesce(links, F.array().cast("array<struct<title:string,uri:string>>")), lambda x: F.coalesce(x["uri"], F.lit("")) != "")
    return F.transform(kept, lambda x: F.struct(clean_text(x["title"]).alias("title"), x["uri"].alias("uri")))
