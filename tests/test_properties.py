"""Expressions over generated cells, against plain Python."""

import json
import random
import re
from urllib.parse import urljoin

from pyspark.sql import functions as F

from quillstone.functions import coerce, exprs, headers
from quillstone.sources import readers, sinks

UNSTATED = re.compile(r"(?i)^(?:n/?a|nil|none|tbc|tba|-{1,3}|\.|unknown|null)$")


def column(spark, values, kind="string"):
    return spark.createDataFrame(list(enumerate(values)), f"n int, x {kind}")


def test_prices(spark):
    dice = random.Random(3)
    part = ["$", " ", "1", "2,000", "750,", ".", "5", "-", "From ", "POA", "n/a", "NIL", "+ GST", "\t", "", "tbc", "12.75", "each", "0"]
    cells = ["".join(dice.choice(part) for _ in range(dice.randint(0, 5))) for _ in range(600)] + [None, "x" * 200]

    def expected(cell):
        text = re.sub(r"\s+", " ", cell or "").strip()
        if cell is None or not text or UNSTATED.match(text):
            return None, None
        text = text[:120]
        found = re.search(r"-?\d+(?:\.\d+)?", text[:60].replace(",", ""))
        value = float(found[0]) if found else None
        return value, (text if value is None or not re.search(r"^\$?\s*\d[\d,]*(\.\d+)?$", text) else None)

    got = {r.n: (r.p.price, r.p.display) for r in column(spark, cells).select("n", coerce.price(F.col("x")).alias("p")).collect()}
    assert got == {n: expected(c) for n, c in enumerate(cells)}


def value(dice, depth=0):
    kind = dice.randint(0, 7 if depth < 4 else 5)
    if kind == 6:
        return [value(dice, depth + 1) for _ in range(dice.randint(0, 3))]
    if kind == 7:
        return {dice.choice(["a", "b", "c.d", "é", 'q"t', "x y"]): value(dice, depth + 1) for _ in range(dice.randint(0, 3))}
    return [None, True, 7, -1.5, "", '{"a": 1}'][kind]


def test_json_types(spark):
    dice = random.Random(4)
    payloads = [{"k": value(dice)} for _ in range(300)]
    texts = [json.dumps(p, ensure_ascii=dice.random() < 0.5) for p in payloads] + ["{", "[]", None]
    kind = lambda x: "null" if x is None else "boolean" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "string" if isinstance(x, str) else "array" if isinstance(x, list) else "object"
    got = [r.t for r in column(spark, texts).select("n", exprs.json_type(F.col("x"), "$.k").alias("t")).orderBy("n").collect()]
    assert got == [*(kind(p["k"]) for p in payloads), None, None, None]


def test_walks_of_any_payload(spark):
    """Paths of all keys, in the order of the document."""
    from quillstone.functions import privacy

    dice = random.Random(5)
    payloads = [value(dice) for _ in range(200)]

    def paths(x, at=""):
        for name, held in x.items() if isinstance(x, dict) else ((f"[{i}]", v) for i, v in enumerate(x)) if isinstance(x, list) else ():
            own = at + name if isinstance(x, list) else f"{at}.{name}" if at else name
            yield own
            yield from paths(held, own)

    df = column(spark, [json.dumps(p, ensure_ascii=dice.random() < 0.5) for p in payloads])
    got = {n: [] for n in range(200)}
    for r in privacy.walk(df, "n", "x").where(F.size("place") > 0).orderBy("owner", "place").collect():
        got[r.owner].append(r.path)
    assert got == {n: list(paths(p)) for n, p in enumerate(payloads)}


def test_addresses_resolve_as_urls(spark):
    dice = random.Random(6)
    pages = ["http://x.org", "http://x.org/", "https://x.org/a/b/c?q=1", "http://x.org/a/b/"]
    rows = []
    for _ in range(400):
        parts = [dice.choice(["a", "b.png", "..", ".", "c-d"]) for _ in range(dice.randint(1, 5))]
        rows.append((dice.choice(["", "/"]) + "/".join(parts) + dice.choice(["", "?w=1", "?p=../x"]), dice.choice(pages)))
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, a string, p string")
    got = [r.v for r in df.select("n", readers.resolved(F.col("a"), F.col("p")).alias("v")).orderBy("n").collect()]
    assert got == [urljoin(p if p.count("/") > 2 else p + "/", a) for a, p in rows]


def test_headers_of_generated_grids(spark):
    dice = random.Random(7)
    known = ["Lot", "Price", "LAND $", "Status", "Package Price - V002", "Estate", "Beds"]
    grids = [[[dice.choice([*known, "", "other", "9", None]) for _ in range(dice.randint(0, 5))] for _ in range(dice.randint(0, 18))] for _ in range(150)]
    fields = headers.aliases()

    def field(cell):
        key = headers.key_of(cell)
        return fields.get(key) or (fields.get(re.sub(r"v[0-9]{1,4}$", "", key)) if re.search(r"v[0-9]{1,4}$", key) else None)

    def expected(rows):
        scores = [len({field(c) for c in r} - {None}) for r in rows[:15]]
        return (max(scores), scores.index(max(scores))) if scores and max(scores) >= 2 else None

    got = [r.h and (r.h.score, r.h.row) for r in column(spark, grids, "array<array<string>>").select("n", readers.header_of(F.col("x")).alias("h")).orderBy("n").collect()]
    assert got == [expected(g) for g in grids]


def test_delimited_round_trip(spark):
    dice = random.Random(8)
    cell = lambda: "".join(dice.choice(['"', ",", "\n", "\r\n", "a", " ", "é", ";"]) for _ in range(dice.randint(0, 5)))
    grids = [[["x", *(cell() for _ in range(3))] for _ in range(dice.randint(1, 6))] for _ in range(150)]
    df = column(spark, grids, "array<array<string>>").select("n", sinks.csv_matrix(F.col("x")).alias("t"))
    assert [r.c for r in df.select("n", readers.cells(F.col("t"), F.lit(",")).alias("c")).orderBy("n").collect()] == grids
