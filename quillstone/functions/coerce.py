"""Cells to values: each gives null rather than a guess."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.exprs import let, stated

# Ordered patterns, the first that matches names the value.
AVAILABILITY = [
    (r"under\s*offer|on\s*hold|holding|held", "on_hold"),
    (r"reserved|deposit\s*(taken|paid)|eoi", "reserved"),
    (r"exchanged|contracted|under\s*contract|conditional", "contracted"),
    (r"settled|completed", "settled"),
    (r"sold|unavailable|not\s*available", "sold"),
    (r"withdrawn|removed|off\s*market|cancelled", "withdrawn"),
    (r"available|active|for\s*sale|released|open|current|in\s*stock|yes", "available"),
]
# Ordered patterns of property types.
PROPERTY_TYPES = [
    (r"house\s*(&|and|\+)\s*land|h\s*&\s*l|hl\s*package|package", "house_and_land"),
    (r"townhouse|town\s*home|villa", "townhouse"),
    (r"apartment|unit\b|flat|residence", "apartment"),
    (r"duplex|dual\s*occ", "duplex"),
    (r"terrace", "terrace"),
    (r"land\s*only|vacant\s*land|^land$|allotment", "land"),
    (r"house|home|detached", "house"),
]
# States and their spellings.
STATES = {
    "nsw": "NSW", "newsouthwales": "NSW", "vic": "VIC", "victoria": "VIC", "qld": "QLD", "queensland": "QLD", "sa": "SA", "southaustralia": "SA",
    "wa": "WA", "westernaustralia": "WA", "tas": "TAS", "tasmania": "TAS", "nt": "NT", "northernterritory": "NT", "act": "ACT", "australiancapitalterritory": "ACT",
}
# Street types and their spellings.
STREETS = {
    "boulevards?|bvd": "Boulevard", "crescents?|cres": "Crescent", "circuits?|cct": "Circuit", "esplanades?|esp": "Esplanade", "highways?|hwy": "Highway",
    "parades?|pde": "Parade", "terraces?|tce": "Terrace", "avenues?|ave": "Avenue", "streets?|st": "Street", "courts?|ct": "Court", "drives?|dr": "Drive",
    "places?|pl": "Place", "roads?|rd": "Road", "close|cl": "Close", "lanes?|ln": "Lane", "groves?|gr": "Grove", "rises?": "Rise", "ways?": "Way", "mews": "Mews",
    "walks?": "Walk", "circles?": "Circle", "promenades?": "Promenade", "approach": "Approach", "ridge": "Ridge", "gardens?|gdns?": "Gardens", "green": "Green",
    "grange": "Grange", "chase": "Chase", "views?": "View", "vista": "Vista", "loop": "Loop", "link": "Link", "glade": "Glade", "bend": "Bend", "retreat": "Retreat",
    "heights|hts": "Heights", "crest": "Crest", "outlook": "Outlook", "entrance": "Entrance", "square|sq": "Square", "wynd": "Wynd", "pocket": "Pocket",
    "passage": "Passage", "run": "Run", "banks?": "Bank",
}
STATE_CODES = "NSW|VIC|QLD|WA|SA|TAS|ACT|NT"


def first_number(x: Column) -> Column:
    """The first number in a text, thousands separators aside."""
    found = F.regexp_extract(F.replace(x, F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0)
    return F.when(found != "", found.try_cast("double"))


def number(cell: Column) -> Column:
    """The leading figure of a cell."""
    return first_number(stated(cell, 60))


def price(cell: Column) -> Column:
    """struct(price, display): display is what the cell says wherever it says more than a bare figure."""
    text = stated(cell, 120)
    value = first_number(F.substring(text, 1, 60))
    bare = text.rlike(r"^\$?\s*\d[\d,]*(\.\d+)?$")
    return F.struct(value.alias("price"), F.when(value.isNull() | ~bare, text).alias("display"))


def first_match(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The name of the first pattern found in the text, whatever its case; null where none is."""
    return reduce(lambda c, p: c.when(text.rlike(f"(?i){p[0]}"), p[1]), patterns[1:], F.when(text.rlike(f"(?i){patterns[0][0]}"), patterns[0][1]))


def availability(cell: Column) -> Column:
    """unknown, never available, for what can't be read."""
    return F.coalesce(first_match(stated(cell, 80), AVAILABILITY), F.lit("unknown"))


def property_type(cell: Column) -> Column:
    """other for a stated type outside the vocabulary."""
    text = stated(cell, 80)
    return F.when(text.isNotNull(), F.coalesce(first_match(text, PROPERTY_TYPES), F.lit("other")))


def state(cell: Column) -> Column:
    """The code of a state, by its name or code."""
    key = F.regexp_replace(F.lower(stated(cell, 60)), "[^a-z]", "")
    return F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])[key]


def postcode(cell: Column) -> Column:
    """Four digits that stand alone."""
    return F.nullif(F.regexp_extract(stated(cell, 20), r"\b(\d{4})\b", 1), F.lit(""))


def count(value: Column) -> Column:
    """A count of rooms or cars, to a tenth; null outside 0 to 20."""
    return F.when((value >= 0) & (value <= 20), F.floor(value * 10 + 0.5) / 10)


def area(value: Column) -> Column:
    """An area to a hundredth; null if negative or over a million."""
    return F.when((value >= 0) & (value <= 1_000_000), F.floor(value * 100 + 0.5) / 100)


def bed_bath_car(cell: Column) -> Column:
    """struct(bedrooms, bathrooms, car_spaces) of a combined cell, null if it has none of the known shapes.

    Labelled counts ("3 Bed 2 Bath 1 Car + 2 Bed") are summed by label. "label = a + b + c" segments are summed by place,
    and a place that one of them leaves out is null. Else three parts between slashes, empty ones aside.
    """
    pattern = r"(?i)(\d+(?:\.\d+)?)\s*(bed(?:room)?s?|bath(?:room)?s?|cars?|carports?)\b"
    names = ("bedrooms", "bathrooms", "car_spaces")

    def labelled(text: Column) -> Column:
        numbers, labels = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
        return let(F.arrays_zip(numbers.alias("number"), labels.alias("label")), lambda found: F.when(F.size(found) > 0, named(found)).otherwise(divided(text)))

    def named(found: Column) -> Column:
        def total(label: str) -> Column:
            values = F.transform(F.filter(found, lambda x: F.lower(x["label"]).startswith(label)), lambda x: x["number"].cast("double"))
            return F.when(F.size(values) > 0, count(F.aggregate(values, F.lit(0.0), lambda a, v: a + v)))

        return F.struct(*(total(label).alias(n) for label, n in zip(("bed", "bath", "car"), names)))

    def divided(text: Column) -> Column:
        segments = F.filter(F.transform(F.split(text, r"\r?\n|(?=\b[A-Za-z][^=+]{0,40}=)"), lambda s: F.trim(s)), lambda s: s != "")
        return F.when(F.contains(text, F.lit("=")), let(segments, lambda s: F.when(F.size(s) > 0, placed(s)).otherwise(slashed(text)))).otherwise(slashed(text))

    def placed(segments: Column) -> Column:
        parts = F.transform(segments, lambda s: F.transform(F.split(F.regexp_replace(s, "^[^=]*=", ""), r"\+"), lambda p: let(number(p), count)))
        whole = lambda parts: F.forall(parts, lambda p: F.size(p).between(2, 3) & F.forall(p, lambda n: n.isNotNull()))
        total = lambda parts, k: F.when(F.forall(parts, lambda p: F.size(p) > k), let(F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.get(p, F.lit(k))), count))
        summed = lambda parts: F.struct(*(total(parts, k).alias(n) for k, n in enumerate(names)))
        return F.when(F.forall(segments, lambda s: F.contains(s, F.lit("="))), let(parts, lambda p: F.when(whole(p), summed(p))))

    def slashed(text: Column) -> Column:
        plain = F.transform(F.filter(F.split(text, "/"), lambda p: F.trim(p) != ""), lambda p: let(number(p), count))
        three = lambda p: F.struct(*(F.get(p, F.lit(k)).alias(n) for k, n in enumerate(names)))
        return let(plain, lambda p: F.when((F.size(p) == 3) & F.forall(p, lambda n: n.isNotNull()), three(p)))

    # Each reading is made once, and only where those before it have found nothing.
    return let(F.trim(cell), labelled)


def _tidy(x: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), r"^[,\-–]+|[,\-–]+$", "")), F.lit(""))


def address(line: Column) -> Column:
    """struct of lot, unit, number, name, type, suburb, state, postcode, estate and design of a free-text address.

    What follows the address in brackets is taken off first: square brackets, or the words after any bracket, name the
    design. A lot is never a street number; a bare leading number is a lot unless the line has given one. The last street
    type in the first segment ends the street; the last segment is the suburb, those between are the estate.
    """
    note = r"\s*([\[(])([^\])]*)[\])]\s*([^,\[(]*)$"
    anchor = rf"(?i)\b(?:{STATE_CODES})\b|\b\d{{4}}\b"
    empty = lambda x: F.nullif(x, F.lit(""))
    plain = lambda x: F.coalesce(_tidy(x), F.lit(""))

    def noted(held: Column) -> Column:
        bracket, head = F.regexp_extract(held, note, 1), F.regexp_replace(held, note, "")
        named = F.coalesce(_tidy(F.regexp_extract(held, note, 3)), F.when(bracket == "[", _tidy(F.regexp_extract(held, note, 2))))
        strip = (bracket != "") & head.rlike(anchor)
        return let(F.struct(F.when(strip, named).alias("design"), F.when(strip, head).otherwise(held).alias("rest")), numbered)

    def numbered(a: Column) -> Column:
        lead = lambda word: rf"(?i)^{word}\s*\.?\s*([0-9]+[a-z]?)\s*[-–:,]?\s*"
        unit = lambda rest: F.struct(empty(F.regexp_extract(rest, lead("unit"), 1)).alias("unit"), plain(F.regexp_replace(rest, lead("unit"), "")).alias("rest"))
        lot = empty(F.regexp_extract(a["rest"], lead("lot"), 1))
        return let(
            F.struct(a["design"].alias("design"), lot.alias("lot"), let(plain(F.regexp_replace(a["rest"], lead("lot"), "")), unit).alias("u")),
            lambda b: let(b["u"]["rest"], lambda rest: placed(b, rest)),
        )

    def placed(b: Column, rest: Column) -> Column:
        ends = rf"(?=\s*(?:,|$|\b(?:{STATE_CODES})\b))"
        postal = empty(F.regexp_extract(rest, rf"(?i)\b(\d{{4}})\b{ends}", 1))
        without = plain(F.regexp_replace(rest, rf"(?is)^(.*?)\b\d{{4}}\b{ends}(.*)$", "$1 $2"))

        def stated_in(text: Column) -> Column:
            code = F.upper(empty(F.regexp_extract(text, rf"(?i)\b({STATE_CODES})\b", 1)))
            return F.struct(code.alias("state"), plain(F.regexp_replace(text, rf"(?i)^(.*?)\b(?:{STATE_CODES})\b", "$1 ")).alias("rest"))

        parts = lambda c: F.filter(F.transform(F.split(c["rest"], ","), _tidy), lambda s: s.isNotNull())
        return let(let(without, stated_in), lambda c: let(parts(c), lambda p: let(F.coalesce(F.get(p, F.lit(0)), F.lit("")), lambda first: street(b, postal, c, p, first))))

    def street(b: Column, postal: Column, c: Column, parts: Column, first: Column) -> Column:
        pattern = rf"(?i)^(.*)\b({'|'.join(STREETS)})\b(.*)$"
        split = F.struct(_tidy(F.regexp_extract(first, pattern, 1)).alias("before"), F.lower(F.regexp_extract(first, pattern, 2)).alias("kind"), _tidy(F.regexp_extract(first, pattern, 3)).alias("after"))
        return let(split, lambda s: fields(b, postal, c, parts, first, s))

    def fields(b: Column, postal: Column, c: Column, parts: Column, first: Column, s: Column) -> Column:
        n, before, typed = F.size(parts), s["before"], s["kind"] != ""
        names = list(STREETS.items())
        canonical = reduce(lambda x, p: x.when(s["kind"].rlike(f"^(?:{p[0]})$"), p[1]), names[1:], F.when(s["kind"].rlike(f"^(?:{names[0][0]})$"), names[0][1]))
        over, lead = r"(?i)^(\d+[a-z]?)\s*/\s*(\d+[a-z]?)\s+(.*)$", r"(?i)^(\d+[a-z]?)\s+(.*)$"
        is_over, is_lead = before.rlike(over), before.rlike(lead)
        return F.struct(
            F.coalesce(b["lot"], F.when(typed & ~is_over & is_lead, F.regexp_extract(before, lead, 1))).alias("lot"),
            F.coalesce(b["u"]["unit"], F.when(typed & is_over, F.regexp_extract(before, over, 1))).alias("unit"),
            F.when(typed, F.when(is_over, F.regexp_extract(before, over, 2)).when(is_lead & b["lot"].isNotNull(), F.regexp_extract(before, lead, 1))).alias("number"),
            F.when(typed, F.when(is_over, _tidy(F.regexp_extract(before, over, 3))).when(is_lead, _tidy(F.regexp_extract(before, lead, 2))).otherwise(before)).alias("name"),
            F.when(typed, canonical).alias("type"),
            F.coalesce(F.when(n > 1, F.get(parts, n - 1)), F.when(typed, s["after"]).otherwise(empty(first))).alias("suburb"),
            c["state"].alias("state"),
            postal.alias("postcode"),
            F.coalesce(F.when(n > 2, F.array_join(F.slice(parts, F.lit(2), n - 2), ", ")), F.when(~typed & (n > 1), first)).alias("estate"),
            b["design"].alias("design"),
        )

    return let(plain(line), noted)
