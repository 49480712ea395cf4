"""Text, identity and JSON functions (STR, JS, FLT, NM operators) as Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python sees it; Java's classes lack four of these.
_WS = r"(?U)[\s\x1c-\x1f]"


def collapse(c: Column) -> Column:
    """STR4."""
    return F.regexp_replace(F.regexp_replace(c, _WS + "+", " "), "^ | $", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_WS}+|{_WS}+$".replace("|(?U)", "|"), "")


def canonical_path(c: Column) -> Column:
    """STR1."""
    p = strip(F.translate(c, "\\", "/"))
    p = F.regexp_replace(p, r"^(?:\./+)+", "")
    p = F.regexp_replace(F.regexp_replace(p, r"(?<=.)/{2,}|(?<=^)/{3,}", "/"), r"(?<=/|^)\.(?:/|$)", "")
    p = F.regexp_replace(p, r"(?<=.)/+$", "")
    return F.when(p == "", ".").otherwise(p)


def content_hash(c: Column) -> Column:
    """STR2: SHA-256 of the text with LF line ends."""
    return F.sha2(F.regexp_replace(c, r"\r\n?", "\n"), 256)


def uuid5(namespace: str, name: Column) -> Column:
    """STR3: version 5 identifier of a name in UTF-8."""
    raw = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(raw, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws("-", F.substring(raw, 1, 8), F.substring(raw, 9, 4), F.concat(F.lit("5"), F.substring(raw, 14, 3)), F.concat(variant, F.substring(raw, 18, 3)), F.substring(raw, 21, 12))


def title(c: Column) -> Column:
    """STR5."""
    return F.coalesce(F.nullif(F.left(collapse(c), F.lit(80)), F.lit("")), F.lit("New conversation"))


def base_name(c: Column) -> Column:
    """STR6."""
    return F.nullif(F.element_at(F.split(F.regexp_replace(strip(F.translate(c, "\\", "/")), "/+$", ""), "/"), -1), F.lit(""))


def heading_label(path: Column, section: Column) -> Column:
    """STR7."""
    parts = F.filter(F.transform(path, strip), lambda x: x != "")
    return F.coalesce(F.nullif(F.array_join(parts, " > "), F.lit("")), F.nullif(strip(section), F.lit("")))


def capped(c: Column, most: int = 2000) -> Column:
    """STR8."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def reason_code(c: Column) -> Column:
    """STR9."""
    return F.left(F.regexp_replace(strip(F.lower(c)), _WS + "+", "_"), F.lit(80))


def provider_name(hidden: Column, model: Column) -> Column:
    """STR10."""
    return F.coalesce(hidden, F.when(F.contains(model, F.lit("/")), F.substring_index(model, "/", 1)))


def slug(c: Column) -> Column:
    """STR11."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def detail_label(c: Column) -> Column:
    """STR12: a space before capitals, the first letter in upper case."""
    spaced = F.trim(F.regexp_replace(c, "([A-Z])", " $1"))
    return F.concat(F.upper(F.left(spaced, F.lit(1))), F.substring(spaced, 2, 1 << 30))


def detail_value(c: Column) -> Column:
    """STR12."""
    return F.when(c.isNull(), "Unavailable").when(c.cast("string") == "true", "Yes").when(c.cast("string") == "false", "No").otherwise(c.cast("string"))


def without_front_matter(c: Column) -> Column:
    """STR13."""
    return F.regexp_replace(c, r"^---\n[\s\S]*?\n---\s*\n?", "")


def _literal(term: str) -> str:
    return "(?i)" + re.sub(r"([^\w\s])", r"\\\1", term)


def highlighted(c: Column, term: str) -> Column:
    """STR15."""
    return c if not term else F.regexp_replace(c, f"({_literal(term)})", "<mark>$1</mark>")


def matches(c: Column, term: str) -> Column:
    """AG22: occurrences that don't overlap, in any case."""
    return F.lit(0).cast("long") if not term.strip() else F.size(F.regexp_extract_all(c, F.lit(_literal(term.strip())), F.lit(0))).cast("long")


def title_matches(c: Column, term: str) -> Column:
    """FLT11."""
    return F.contains(F.lower(F.coalesce(c, F.lit("Untitled conversation"))), F.lower(F.trim(F.lit(term))))


def windows(c: Column, size: int, overlap: int) -> Column:
    """STR17: fixed windows with overlap, stripped, blank ones dropped, none after one that reaches the end."""
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(c) - size) / step)).cast("int")
    return F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.substring(c, i * step + 1, F.lit(size)))), lambda w: w != "")


def sections(c: Column) -> Column:
    """STR16: parts that begin at headings; what stands before the first is a part too."""
    return F.filter(F.transform(F.split(c, r"(?m)(?=^#{1,6} .+)"), strip), lambda s: s != "")


def bearer_token(c: Column) -> Column:
    """STR19."""
    return F.nullif(F.regexp_extract(c, r"(?i)^\s*bearer\s+(\S+)\s*$", 1), F.lit(""))


def client_key(forwarded: Column, host: Column) -> Column:
    """STR20."""
    return F.coalesce(F.nullif(F.trim(F.substring_index(forwarded, ",", 1)), F.lit("")), F.nullif(host, F.lit("")), F.lit("unknown"))


def non_blank(c: Column) -> Column:
    """STR21."""
    return F.nullif(strip(c), F.lit(""))


def uuid_or_error(c: Column) -> Column:
    """STR22."""
    ok = c.rlike("^(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return F.when(c.isNotNull(), F.when(ok, F.lower(c)).otherwise(F.raise_error(F.concat(F.lit("not an identifier: "), c)).cast("string")))


def url_decoded(c: Column) -> Column:
    """STR18: percent escapes; a plus sign stays, and so does a percent sign that begins no escape."""
    return F.url_decode(F.replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))


def english_path(c: Column) -> Column:
    """FLT1."""
    return F.contains(F.translate(F.coalesce(c, F.lit("")), "\\", "/"), F.lit("/en/"))


def website(c: Column) -> Column:
    """FLT15."""
    return F.coalesce(F.try_parse_url(c, F.lit("PROTOCOL")).isin("http", "https"), F.lit(False))


def path_part(c: Column, word: str) -> Column:
    """SRC4: the first part of a path that holds a word, in any case."""
    return F.get(F.filter(F.split(c, "/"), lambda p: F.contains(F.lower(p), F.lit(word))), 0)


def either_key(m: Column, snake: str, camel: str) -> Column:
    """JS8: the second name counts where the first has no value; an empty value is one."""
    return F.coalesce(F.try_element_at(m, F.lit(snake)), F.try_element_at(m, F.lit(camel)))


def allowed_metadata(m: Column, keys: list[str]) -> Column:
    """FLT10."""
    return F.map_filter(m, lambda k, _: k.isin(*keys))


def overlap_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """NM4: common part of [a, b) and [c, d) over the shorter; null where a range is empty."""
    shorter = F.least(b - a, d - c)
    return F.when(shorter > 0, F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c)) / shorter)
