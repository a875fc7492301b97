"""Keys, coercions, addresses and names over cells that are built from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import coerce, exprs
from quillstone.functions import labels as L
from quillstone.registry import Tables, query
from quillstone.sources.tables import spread


def _pick(k: str, cells: list[str]) -> str:
    """The SQL of one of several cells, by the number k."""
    return f"CASE {k} % {len(cells)} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cells)) + " END"


_LOOSE = _pick("c_custkey", ["'  ' || c_name || '  '", "upper(c_name) || chr(9) || 'x '", "c_name || '  ' || c_mktsegment", "'   '"])


@query(
    f"SELECT c_custkey, lower(trim(cell)) AS trimmed, trim(regexp_replace(lower(cell), '\\s+', ' ', 'g')) AS squashed FROM (SELECT c_custkey, {_LOOSE} AS cell FROM customer) c"
)
def match_keys(t: Tables) -> DataFrame:
    cell = F.expr(_LOOSE)
    return t.customer.select("c_custkey", exprs.trimmed_key(cell).alias("trimmed"), exprs.match_key(cell).alias("squashed"))


_STATE = ["'New South Wales'", "' vic '", "'Q.L.D'", "'South-Australia'", "'WA'", "'tasmania'", "'n/a'", "'Narnia'", "'A C T'", "'Northern  Territory'"]
_STATE_IS = ["'NSW'", "'VIC'", "'QLD'", "'SA'", "'WA'", "'TAS'", "NULL", "NULL", "'ACT'", "'NT'"]
_CODE = ["'VIC ' || (3000 + c_custkey % 900)", "'' || (3000 + c_custkey % 900)", "'12' || (3000 + c_custkey % 900)", "'none'", "'P.O. ' || (3000 + c_custkey % 900) || ' x'"]
_KIND = ["'House & Land'", "'TOWNHOUSE'", "'Unit ' || c_custkey", "'dual occ'", "'Terrace row'", "'Vacant land'", "'detached'", "'boat'", "'tbc'", "'HL Package'"]
_KIND_IS = ["'house_and_land'", "'townhouse'", "'apartment'", "'duplex'", "'terrace'", "'land'", "'house'", "'other'", "NULL", "'house_and_land'"]


@query(
    f"SELECT c_custkey, {_pick('c_custkey', _STATE_IS)} AS state, CASE WHEN c_custkey % 5 IN (2, 3) THEN NULL ELSE '' || (3000 + c_custkey % 900) END AS postcode, {_pick('c_custkey', _KIND_IS)} AS kind FROM customer"
)
def coerce_places(t: Tables) -> DataFrame:
    cell = lambda cells: F.expr(_pick("c_custkey", cells))
    return t.customer.select("c_custkey", coerce.state(cell(_STATE)).alias("state"), coerce.postcode(cell(_CODE)).alias("postcode"), coerce.property_type(cell(_KIND)).alias("kind"))


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN rooms BETWEEN 0 AND 20 THEN floor(rooms * 10 + 0.5) / 10 END AS rooms, CASE WHEN metres BETWEEN 0 AND 1000000 THEN floor(metres * 100 + 0.5) / 100 END AS metres "
    "FROM (SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity - 5) / 2 AS rooms, (l_extendedprice - 2000) * 20 AS metres FROM lineitem) l"
)
def coerce_measures(t: Tables) -> DataFrame:
    rooms, metres = (F.col("l_quantity") - 5) / 2, (F.col("l_extendedprice") - 2000) * 20
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", coerce.count(rooms).alias("rooms"), coerce.area(metres).alias("metres"))


_A, _B, _C = "(p_size % 5 + 1)", "(p_size % 3 + 1)", "(p_size % 2)"
_ROOMS = [
    f"{_A} || ' / ' || {_B} || ' / ' || {_C}",
    f"{_A} || ' Bed ' || {_B} || ' Bath ' || {_C} || ' Car'",
    f"{_A} || ' bedrooms + 1 Bed, ' || {_B} || ' baths'",
    f"'Nest 1 = ' || {_A} || ' + ' || {_B} || ' + ' || {_C}",
    f"'Left = ' || {_A} || ' + ' || {_B} || chr(10) || 'Right = 1 + 1 + 1'",
    f"{_A} || ' / ' || {_B}",
    "'by request'",
]
_BEDS = [_A, _A, f"{_A} + 1", _A, f"{_A} + 1", "NULL", "NULL"]
_BATHS = [_B, _B, _B, _B, f"{_B} + 1", "NULL", "NULL"]
_CARS = [_C, _C, "NULL", _C, "NULL", "NULL", "NULL"]


@query("SELECT p_partkey, " + ", ".join(f"CAST({_pick('p_partkey', x)} AS DOUBLE) AS {n}" for x, n in ((_BEDS, "beds"), (_BATHS, "baths"), (_CARS, "cars"))) + " FROM part")
def coerce_rooms(t: Tables) -> DataFrame:
    r = spread(t.part.select("p_partkey", "p_size")).select("p_partkey", coerce.bed_bath_car(F.expr(_pick("p_partkey", _ROOMS))).alias("r"))
    return r.select("p_partkey", F.col("r.bedrooms").alias("beds"), F.col("r.bathrooms").alias("baths"), F.col("r.car_spaces").alias("cars"))


_N, _M = "(c_custkey % 300 + 1)", "(c_custkey % 70 + 1)"
_ADDRESSES = [
    f"'Lot ' || {_N} || ' - ' || {_M} || ' Satinwood Cres, Donnybrook VIC 3064'",
    f"'Lot ' || {_N} || ' Basalt St, Beveridge, VIC 3753 (178 m2)'",
    f"'Lot ' || {_N} || ' - Coridale Estate, Lara 3212 VIC [178 m2] Aura 19'",
    f"'Lot 2 - ' || {_N} || '/' || {_M} || ' Rose Street, Yamanto QLD 4305'",
    f"{_N} || ' Slide Place, Lara'",
    "'Armstrong Creek VIC'",
    f"'Unit ' || {_N} || ', ' || {_M} || ' Avenue Road, nsw'",
]
_PARTS = {
    "lot": [f"'' || {_N}"] * 3 + ["'2'", f"'' || {_N}", "NULL", f"'' || {_M}"],
    "unit": ["NULL"] * 3 + [f"'' || {_N}", "NULL", "NULL", f"'' || {_N}"],
    "number": [f"'' || {_M}", "NULL", "NULL", f"'' || {_M}", "NULL", "NULL", "NULL"],
    "name": ["'Satinwood'", "'Basalt'", "NULL", "'Rose'", "'Slide'", "NULL", "'Avenue'"],
    "type": ["'Crescent'", "'Street'", "NULL", "'Street'", "'Place'", "NULL", "'Road'"],
    "suburb": ["'Donnybrook'", "'Beveridge'", "'Lara'", "'Yamanto'", "'Lara'", "'Armstrong Creek'", "NULL"],
    "state": ["'VIC'", "'VIC'", "'VIC'", "'QLD'", "NULL", "'VIC'", "'NSW'"],
    "postcode": ["'3064'", "'3753'", "'3212'", "'4305'", "NULL", "NULL", "NULL"],
    "estate": ["NULL", "NULL", "'Coridale Estate'", "NULL", "NULL", "NULL", "NULL"],
    "design": ["NULL", "NULL", "'Aura 19'", "NULL", "NULL", "NULL", "NULL"],
}
_PRECISION = ["'address'", "'street'", "'street'", "'address'", "'street'", "'locality'", "'street'"]
_COMPOSED = [
    f"{_M} || ' Satinwood Crescent, Donnybrook VIC 3064'",
    "'Basalt Street, Beveridge VIC 3753'",
    f"'Lot ' || {_N} || ' - Coridale Estate, Lara 3212 VIC [178 m2] Aura 19, Lara VIC 3212'",
    f"{_N} || '/' || {_M} || ' Rose Street, Yamanto QLD 4305'",
    "'Slide Place, Lara'",
    "'Armstrong Creek VIC'",
    "'Avenue Road, NSW'",
]


@query("SELECT c_custkey, " + ", ".join(f"{_pick('c_custkey', x)} AS {n}" for n, x in _PARTS.items()) + f", {_pick('c_custkey', _COMPOSED)} AS line, {_pick('c_custkey', _PRECISION)} AS \"precision\" FROM customer")
def parse_addresses(t: Tables) -> DataFrame:
    cells = spread(t.customer.select("c_custkey")).select("c_custkey", F.expr(_pick("c_custkey", _ADDRESSES)).alias("cell"))
    a = cells.select("c_custkey", "cell", coerce.address(F.col("cell")).alias("a"))
    composed = a.select("c_custkey", "a", L.composed_address(F.col("a"), F.col("cell"), F.lit("Australia")).alias("c"))
    return composed.select("c_custkey", *[F.col(f"a.{n}").alias(n) for n in _PARTS], "c.line", "c.precision")


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'Unit ' || c_custkey || ' ' || c_mktsegment WHEN c_custkey % 4 = 2 THEN 'lot ' || c_custkey || ' ' || c_mktsegment ELSE c_mktsegment END AS line FROM customer"
)
def address_lines(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    given, unit, lot = F.when(k % 4 == 0, F.col("c_name")).otherwise(" "), F.when(k % 4 == 1, k), F.when(k % 4 == 2, F.concat(F.lit("lot "), k.cast("string"))).when(k % 4 == 1, "9")
    return t.customer.select("c_custkey", L.address_line(given, unit, lot, F.col("c_mktsegment")).alias("line"))


@query(
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey % 1000 || ',' || p_size WHEN 1 THEN p_size || '' ELSE '' END AS lots, p_partkey % 3 = 0 AS named, p_partkey % 3 = 0 AND p_partkey % 2 = 0 AS short "
    "FROM part"
)
def names_in_text(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit("See LOT #"), (k % 1000).cast("string"), F.lit(" or lot "), size, F.lit(": "), F.upper("p_name"), F.lit("!"))).when(k % 3 == 1, F.concat(F.lit("Allotment 4, lot"), size, F.lit("."))).otherwise("no slot 12, lot 1234567")
    label = F.concat(F.lit("lot "), F.col("p_name"))
    short = F.when(k % 2 == 0, label).otherwise("lot")
    return t.part.select("p_partkey", F.array_join(L.lots_named(text), ",").alias("lots"), L.names_label(text, label).alias("named"), L.names_label(text, short).alias("short"))


_NAME = ["'ludwig VAN beethoven'", "'sean o''brien'", "'MACDONALD mcdonald'", "'anne-marie  smith-jones'", "'  de la CRUZ '", "CASE c_mktsegment WHEN 'MACHINERY' THEN 'TOOLS' ELSE c_mktsegment END", "NULL"]
_NAME_IS = ["'Ludwig van Beethoven'", "'Sean O''Brien'", "'MacDonald McDonald'", "'Anne-Marie Smith-Jones'", "'De la Cruz'", "CASE c_mktsegment WHEN 'MACHINERY' THEN 'Tools' ELSE upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END", "''"]


@query(f"SELECT c_custkey, {_pick('c_custkey', _NAME_IS)} AS name, trim({_pick('c_custkey', _NAME_IS)} || CASE WHEN c_custkey % 2 = 0 THEN ' Lee' ELSE '' END) AS whole FROM customer")
def smart_names(t: Tables) -> DataFrame:
    name = F.expr(_pick("c_custkey", _NAME).replace("o''b", "o\\'b"))
    return t.customer.select("c_custkey", L.smart_case(name).alias("name"), L.full_name(name, F.when(F.col("c_custkey") % 2 == 0, "LEE")).alias("whole"))


@query(
    "SELECT p_partkey, sha256(lower(p_name) || '|' || p_brand || '|' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_size || '' END) AS fingerprint, "
    "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) AS uid FROM (SELECT *, md5('part|' || p_partkey) AS h FROM part) p"
)
def row_keys(t: Tables) -> DataFrame:
    size = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size").cast("string"))
    cell = F.concat(F.lit(" "), F.upper("p_name"), F.lit("  "))
    return t.part.select("p_partkey", exprs.row_fingerprint(exprs.match_key(cell), F.col("p_brand"), size).alias("fingerprint"), exprs.business_key(F.lit("part"), F.col("p_partkey")).alias("uid"))


_TYPED = "'{\"a\":' || CASE event_id % 7 WHEN 0 THEN props WHEN 1 THEN '[1,2]' WHEN 2 THEN '\"x\"' WHEN 3 THEN '1.5' WHEN 4 THEN '7' WHEN 5 THEN 'true' ELSE 'null' END || '}'"


@query(f"SELECT event_id, {_pick('event_id', [repr(x) for x in ('object', 'array', 'string', 'number', 'number', 'boolean', 'null')])} AS kind, CASE WHEN event_id % 7 = 0 THEN 'number' END AS inner_kind FROM events")
def json_types(t: Tables) -> DataFrame:
    payload = F.expr(_TYPED)
    return t.events.select("event_id", exprs.json_type(payload, "$.a").alias("kind"), exprs.json_type(payload, "$.a.k").alias("inner_kind"))


@query("SELECT event_id, least(ts + INTERVAL 30 MINUTE, date_trunc('day', ts) + INTERVAL 20 HOUR) AS expires_at, ts + INTERVAL 30 MINUTE >= date_trunc('day', ts) + INTERVAL 20 HOUR AS final FROM events")
def idle_expiry(t: Tables) -> DataFrame:
    ends = F.date_trunc("day", "ts").cast(dict(t.events.dtypes)["ts"]) + F.expr("INTERVAL 20 HOURS")
    expires = exprs.sliding_expiry(F.col("ts"), 1800, ends)
    return t.events.select("event_id", expires.alias("expires_at"), (expires >= ends).alias("final"))
