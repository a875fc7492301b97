"""Column expressions that fix null, rounding and text semantics in one place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that state nothing.
UNSTATED = r"(?i)^(?:n/?a|nil|none|tbc|tba|-{1,3}|\.|unknown|null)$"


def rounded2(x: Column) -> Column:
    """Two decimals by floor(x * 100 + 0.5) / 100, the same for both signs and in every engine."""
    return F.floor(x * 100 + 0.5) / 100


def blank_to_null(x: Column) -> Column:
    """Null for text that is empty after trimming."""
    return F.nullif(F.trim(x), F.lit(""))


def squashed(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def match_key(x: Column) -> Column:
    """Text as it is compared: white space squashed, lower case."""
    return F.lower(squashed(x))


def stated(x: Column, most: int = 500) -> Column:
    """Squashed text of at most ``most`` characters; null where the cell states nothing."""
    held = squashed(x)
    return F.when((held != "") & ~held.rlike(UNSTATED), F.substring(held, 1, most))


def live(valid_from: Column, valid_until: Column, as_of: Column, revoked_at: Column | None = None) -> Column:
    """Whether a grant holds at as_of: begun, not over (null: open), and not revoked."""
    held = (valid_from <= as_of) & (valid_until.isNull() | (valid_until > as_of))
    return held if revoked_at is None else held & revoked_at.isNull()


def backoff_claim(attempts: Column) -> Column:
    """Seconds until a leased job may be claimed again: 30 doubled up to seven times, an hour at most."""
    return F.least(F.lit(30) * F.pow(F.lit(2), F.least(attempts, F.lit(7))), F.lit(3600)).cast("long")


def backoff_delivery(attempts: Column) -> Column:
    """Seconds until a failed delivery is tried again: a power of two, an hour at most."""
    return F.least(F.lit(3600), F.pow(F.lit(2), F.least(attempts, F.lit(12)))).cast("long")


def search_pattern(term: str, underscore_is_wildcard: bool = False) -> str:
    """A search term as a LIKE pattern: characters with a meaning of their own become spaces."""
    special = "%,()" if underscore_is_wildcard else "%_,()"
    return "%" + "".join(" " if c in special else c for c in term).strip() + "%"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def trimmed_key(x: Column) -> Column:
    """Text as a key of names: blanks at the ends off, lower case."""
    return F.lower(F.trim(x))


def sliding_expiry(now: Column, idle: int, absolute: Column) -> Column:
    """When a session that is used now ends: after ``idle`` seconds without use, at its absolute end at the latest."""
    return F.least(now + F.expr(f"INTERVAL {int(idle)} SECONDS"), absolute)


def business_key(*parts: Column) -> Column:
    """A key in the form of a UUID that the parts alone decide, so that writing again gives the same one; null reads as empty."""
    text = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return F.regexp_replace(text, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")


def row_fingerprint(*parts: Column) -> Column:
    """The hash by which a row is known again; null reads as empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def json_type(payload: Column, path: str) -> Column:
    """object, array, string, number, boolean or null at a path; null where there is nothing, or no JSON."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload), path, "variant"))
    return (
        F.when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .when(kind.isNotNull(), "number")
    )
