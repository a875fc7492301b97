"""What a reader sees: names, lists, sizes, countdowns, and the lines by which a record is known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.exprs import blank_to_null, let

# Particles of names that stay lower-case after the first word.
PARTICLES = ("de", "del", "di", "da", "dos", "das", "von", "van", "der", "den", "la", "le", "les", "al")
DAY = 86400


def _capital(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))


def _cased(word: Column, first: Column) -> Column:
    """One word without regard to hyphens; null where the word has to be taken apart at them."""
    low = F.lower(word)
    prefix = F.regexp_extract(low, "^(mc|mac).", 1)
    return (
        F.when(~first & low.isin(*PARTICLES), low)
        .when(prefix != "", F.concat(_capital(prefix), _capital(F.substring(low, F.length(prefix) + 1, F.length(low)))))
        .when(low.startswith("o'") & (F.length(low) > 2), F.concat(F.lit("O'"), _capital(F.substring(low, F.lit(3), F.length(low)))))
        .when(~F.contains(word, F.lit("-")), _capital(word))
    )


def smart_case(name: Column) -> Column:
    """A name in the case it is usually written in: McDonald, O'Brien, Smith-Jones, Ludwig van Beethoven. Null reads as empty."""
    words = F.split(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)^\s+|\s+$", ""), r"(?U)\s+")
    parts = lambda w, first: F.array_join(F.transform(F.split(w, "-"), lambda p, i: _cased(p, first & (i == 0))), "-")
    return F.array_join(F.transform(words, lambda w, i: F.coalesce(_cased(w, i == 0), parts(w, i == 0))), " ")


def full_name(first: Column, last: Column) -> Column:
    """Both names, cased, without a gap where one is missing."""
    return F.concat_ws(" ", *(F.nullif(smart_case(x), F.lit("")) for x in (first, last)))


def english_list(parts: Column) -> Column:
    """a; a and b; a, b and c. Empty for no parts."""
    most = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ", ")
    return F.when(F.size(parts) > 1, F.concat(most, F.lit(" and "), F.element_at(parts, -1))).otherwise(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")))


def file_size(n: Column) -> Column:
    """B below a kilobyte, whole KB below a megabyte, else MB with one decimal; a dash for none."""
    tenths = F.floor(n * 10 / 1048576 + 0.5)
    mega = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" MB"))
    return (
        F.when(n.isNull() | (n <= 0), "—")
        .when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1048576, F.concat(F.floor(n / 1024 + 0.5).cast("string"), F.lit(" KB")))
        .otherwise(mega)
    )


def whole_square_metres(x: Column) -> Column:
    """A size in whole square metres; null where there is none or it rounds away."""
    whole = F.floor(x + 0.5)
    return F.when((x > 0) & (whole > 0), whole)


def _days(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " day").otherwise(" days"))


def countdown(at: Column, as_of: Column) -> Column:
    """Today, In n days, or n days ago; a day that has begun counts."""
    days = F.ceil((F.unix_micros(at) - F.unix_micros(as_of)) / (DAY * 1_000_000))
    return F.when(days == 0, "Today").when(days > 0, F.concat(F.lit("In "), _days(days))).when(days < 0, F.concat(_days(-days), F.lit(" ago")))


def dwell(started: Column, as_of: Column) -> Column:
    """How many whole days ago a stage began; Today for none, null for a start that is unknown or still to come."""
    days = F.floor((F.unix_micros(as_of) - F.unix_micros(started)) / (DAY * 1_000_000))
    return F.when(days == 0, "Today").when(days > 0, _days(days))


def lots_named(text: Column) -> Column:
    """The lot numbers that a text names, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\blot\s*#?\s*([0-9]{1,5})\b"), 1)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), "")


def names_label(page: Column, label: Column, least: int = 2, most: int = 8) -> Column:
    """Whether a page holds each of the first ``most`` tokens of a label that has ``least`` tokens or more."""
    return let(F.slice(tokens(label), 1, most), lambda t: (F.size(t) >= least) & (F.size(F.array_except(t, tokens(page))) == 0))


def without_designation(address: Column, word: str, number: Column) -> Column:
    """An address without the Lot or Unit it begins with, where that is the given one and something is left."""
    line, value = F.trim(F.coalesce(address, F.lit(""))), F.trim(F.coalesce(number.cast("string"), F.lit("")))
    pattern = F.concat(F.lit(rf"(?i)^{word}\s*\.?\s*"), F.regexp_replace(value, r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit(r"\b[\s,\-]*"))
    rest = F.trim(F.regexp_replace(line, pattern, F.lit("")))
    return F.when((line == "") | (value == "") | (rest == ""), line).otherwise(rest)


def record_label(unit: Column, lot: Column, address: Column, suburb: Column, fallbacks: Sequence[Column] = ()) -> Column:
    """Unit or lot, address and suburb of a record in one line of 200 characters at most; else the first fallback that is stated."""
    unit, lot, suburb = (F.nullif(x.cast("string"), F.lit("")) for x in (unit, lot, suburb))
    named = F.when(unit.isNotNull(), F.concat(F.lit("Unit "), unit)).when(lot.isNotNull(), F.concat(F.lit("Lot "), lot))
    street = F.when(unit.isNotNull(), without_designation(address, "Unit", unit)).when(lot.isNotNull(), without_designation(address, "Lot", lot)).otherwise(address)
    line = F.concat_ws(", ", named, F.nullif(street, F.lit("")), suburb)
    other = [F.nullif(x.cast("string"), F.lit("")) for x in fallbacks]
    return F.substring(F.coalesce(F.nullif(line, F.lit("")), *other, F.lit("Unnamed property")), 1, 200)


def address_line(given: Column, unit: Column, lot: Column, place: Column) -> Column:
    """A line for a record that was given none: its unit, else its lot, and its place; null where there is a line or no place."""
    prefixed = lambda x, word: let(blank_to_null(x.cast("string")), lambda v: F.when(v.rlike(rf"(?i)^{word}\b"), v).otherwise(F.concat(F.lit(f"{word} "), v)))
    number = F.coalesce(prefixed(unit, "Unit"), prefixed(lot, "Lot"))
    return F.when(blank_to_null(given).isNull() & blank_to_null(place).isNotNull(), F.concat_ws(" ", number, blank_to_null(place)))



def _names_street(line: Column, parts: Sequence[Column]) -> Column:
    """Whether a line's first segment says more than its locality does."""
    head = F.split(line, ",")[0]
    for part in parts:
        pattern = F.concat(F.lit(r"(?i)\b"), F.regexp_replace(part, r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit(r"\b"))
        head = F.coalesce(F.regexp_replace(head, pattern, F.lit(" ")), head)
    return F.coalesce(F.regexp_replace(head, r"(?iU)\b(?:australia|nsw|vic|qld|wa|sa|tas|act|nt|\d{4})\b|[^\p{L}\p{N}]+", "") != "", F.lit(False))


def composed_address(a: Column, given: Column, formatted: Column) -> Column:
    """struct(street, line, precision) of a record with parts unit, number, name, type, suburb, state and postcode.

    The street is made of the parts; a unit counts only before a number. Without a street name it is the record's own
    line, else a geocoder's, where that names more than the locality. precision is address where the parts or the own line
    give a street number, else street, locality or none: what a geocoder says is no evidence of a number.
    """
    own, other = blank_to_null(given), blank_to_null(formatted)
    number = F.when(a["unit"].isNotNull() & a["number"].isNotNull(), F.concat(a["unit"], F.lit("/"), a["number"])).otherwise(a["number"])
    made = F.when(a["name"].isNotNull(), F.concat_ws(" ", number, a["name"], a["type"]))
    locality = F.nullif(F.concat_ws(" ", a["suburb"], a["state"], a["postcode"]), F.lit(""))
    places = [a["suburb"], a["state"], a["postcode"]]
    mine = made.isNull() & _names_street(own, places)
    street = F.when(made.isNotNull(), made).when(mine, own).when(_names_street(other, places), other)
    numbered = (made.isNotNull() & a["number"].isNotNull()) | (mine & own.rlike(r"(?i)^\d+[a-z]?(?:\s*[-/]\s*\d+[a-z]?)?\s+\S"))
    return let(
        F.struct(street.alias("street"), locality.alias("locality"), numbered.alias("numbered"), a["suburb"].alias("suburb")),
        lambda x: F.struct(
            x["street"].alias("street"),
            F.nullif(F.concat_ws(", ", x["street"], x["locality"]), F.lit("")).alias("line"),
            F.when(x["numbered"], "address").when(x["street"].isNotNull(), "street").when(x["suburb"].isNotNull(), "locality").otherwise("none").alias("precision"),
        ),
    )
