"""Literal inputs and outputs of headings, coercions, readers and privacy."""

import pytest
from pyspark.sql import functions as F

from quillstone.functions import coerce, headers, privacy
from quillstone.sources import readers


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("v")).first().v


@pytest.mark.parametrize(
    "heading,field",
    [("Land Size (m2)", "land_size_sqm"), ("LAND $", None), ("Package Price - V002", "price"), ("Build Price - V002", None), ("Build (sqm)", "building_size_sqm"), ("House", "house_design"), ("HOUSE $", None), ("house_design", "house_design"), ("Configuration", "bed_bath_car")],
)
def test_headings(spark, heading, field):
    assert headers.with_field(spark.createDataFrame([(heading,)], "h string"), "h").first().field == field


def test_heading_keys():
    assert headers.key_of("Land Size (m2)") == "landsizem2"
    assert headers.key_of("LAND $") == "landdollars"
    land, build = ({k for k, f in headers.aliases().items() if f == n} for n in ("land_size_sqm", "building_size_sqm"))
    assert len(land) > 20 and len(build) > 40


@pytest.mark.parametrize("cell,value", [("$749,000", 749000.0), ("3.5", 3.5), ("3+1", 3.0), ("POA", None), (None, None), ("n/a", None)])
def test_number(spark, cell, value):
    assert one(spark, coerce.number, cell) == value


@pytest.mark.parametrize("cell,value", [("$749,000", (749000.0, None)), ("From $749,000", (749000.0, "From $749,000")), ("POA", (None, "POA")), ("", (None, None))])
def test_price(spark, cell, value):
    assert tuple(one(spark, coerce.price, cell)) == value


def test_vocabularies(spark):
    availability = {"Available": "available", "Under Offer": "on_hold", "EOI": "reserved", "Not Available": "sold", "Completed": "settled", "Unconditional": "contracted", "TBC": "unknown", "Foo": "unknown"}
    assert {c: one(spark, coerce.availability, c) for c in availability} == availability
    kinds = {"House & Land": "house_and_land", "Townhouse": "townhouse", "Unit": "apartment", "Units": "other", "Land": "land", "Castle": "other", "n/a": None, "Townhouse Package": "house_and_land"}
    assert {c: one(spark, coerce.property_type, c) for c in kinds} == kinds
    assert [one(spark, coerce.state, c) for c in ("Victoria", "nsw", "Otago")] == ["VIC", "NSW", None]
    assert [one(spark, coerce.postcode, c) for c in ("VIC 3029", "302")] == ["3029", None]


@pytest.mark.parametrize(
    "cell,counts",
    [("4 / 2 / 2", (4, 2, 2)), ("3 / 2/ / 2", (3, 2, 2)), ("3 / 2", None), ("3 / / 2", None), ("Nest 1 = 3 + 2 + 1\nNest 2 = 1 + 1", (4, 3, None)), ("4 Bed 2 Bath 2 Car", (4, 2, 2)), ("3 Bed 2 Bath 1 Car + 2 Bed 1 Bath 1 Car", (5, 3, 2)), ("", None)],
)
def test_bed_bath_car(spark, cell, counts):
    found = one(spark, coerce.bed_bath_car, cell)
    assert (found and tuple(found)) == counts


@pytest.mark.parametrize(
    "line,fields",
    [
        ("Lot 209 - 44 Satinwood Crescent, Donnybrook VIC 3064", dict(lot="209", number="44", name="Satinwood", type="Crescent", suburb="Donnybrook", state="VIC", postcode="3064")),
        ("Lot 60913 Basalt St, Beveridge, VIC 3753 (178 m2)", dict(lot="60913", name="Basalt", type="Street", suburb="Beveridge", state="VIC", postcode="3753")),
        ("Lot 1482 - Coridale Estate, Lara 3212 VIC [178 m2] Aura 19", dict(lot="1482", suburb="Lara", state="VIC", postcode="3212", estate="Coridale Estate", design="Aura 19")),
        ("Lot 2 - 13/15 Rose Street, Yamanto QLD 4305", dict(lot="2", unit="13", number="15", name="Rose", type="Street", suburb="Yamanto", state="QLD", postcode="4305")),
        ("105 Slide Place, Lara", dict(lot="105", name="Slide", type="Place", suburb="Lara")),
        ("Armstrong Creek VIC", dict(suburb="Armstrong Creek", state="VIC")),
        (None, {}),
    ],
)
def test_address(spark, line, fields):
    assert {k: v for k, v in one(spark, coerce.address, line).asDict().items() if v is not None} == fields


def paths(spark, find, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, x string")
    return {r.n: r.paths for r in find(df, "n", "x").collect()}


def test_privacy_paths(spark):
    found = paths(
        spark,
        privacy.forbidden_paths,
        '{"rows": [{"client_id": "c1"}], "item": {"pricing": {"margin": {"cost": 1}}}}',
        '{"z": {"c\\u006fst": 1}, "a": [[1, {"tfn": null}]]}',
        '{"a": "{\\"cost\\": 1}", "b": "[1"}',
        '{"a": 1, "a": {"cost": 1}}',
        "not json \"cost\": 1",
        None,
        "[" * 30 + '{"cost": 1}' + "]" * 30,
        "{}",
    )
    assert found == {0: ["rows[0].client_id", "item.pricing.margin"], 1: ["z.cost", "a[0][1].tfn"], 2: [], 3: ["a.cost"], 4: [], 5: [], 6: ["[0]" * 30 + ".cost"], 7: []}
    spellings = paths(spark, privacy.forbidden_paths, *(f'{{"{k}": 1}}' for k in ("clientEmail", "internalNote", "selectedByUserId", "Pcost")))
    assert spellings == {0: ["clientEmail"], 1: ["internalNote"], 2: ["selectedByUserId"], 3: []}


def test_walk_stays_in_the_jvm(spark, capsys):
    df = spark.createDataFrame([(1, '{"a": {"cost": 1}}')], "n int, x string")
    privacy.forbidden_paths(df, "n", "x").explain()
    plan = capsys.readouterr().out
    assert "UnionLoop" in plan and "Python" not in plan and "Arrow" not in plan


def test_walk_keeps_what_is_found_or_opened(spark):
    """Rows of a step that no later one needs are dropped in it: of 40 texts and two containers the containers and one hit stay."""
    many = "{" + ", ".join(f'"k{i}": "[{i}"' for i in range(40)) + ', "o": {"cost": "{"}, "l": []}'
    df = spark.createDataFrame([(1, many), (2, None), (3, "not json")], "n int, x string")
    held = privacy._walked(df, "n", "x", privacy.FORBIDDEN, True, True).collect()
    assert sorted((r.owner, r.path, r.hit) for r in held) == [(1, "", False), (1, "l", False), (1, "o", False), (1, "o.cost", True), (2, "", False), (3, "", False)]
    assert privacy.walk(df, "n", "x").count() == 46


CSV = "\ufeffStock list,,\n\nLot,Address,Price\n1,\"12 High St, Lara\",\"$749,000\"\n2,\"The \"\"Oaks\"\"\nRear\",POA\n,,\n"


def test_delimited(spark):
    files = spark.createDataFrame([(1, CSV), (2, "a;b\n1;2\n"), (3, "Lot\tSuburb\n7\tLara\n")], "file int, body string").withColumn("mark", readers.sniffed(F.col("body")))
    grids = files.select("file", readers.cells(F.col("body"), F.col("mark")).alias("rows"))
    first = {(r.row, r.heading): r.cell for r in readers.keyed_rows(grids, "file", "rows").collect() if r.file == 1}
    assert first == {(2, "Lot"): "1", (2, "Address"): "12 High St, Lara", (2, "Price"): "$749,000", (3, "Lot"): "2", (3, "Address"): 'The "Oaks"\nRear', (3, "Price"): "POA"}
    assert {r.file: r.mark for r in files.collect()} == {1: ",", 2: ";", 3: "\t"}
    assert {r.file: r.header_row for r in readers.header_rows(grids, "file", "rows").collect()} == {1: 1, 3: 0}


def test_grids_and_maps(spark):
    one_body = lambda body: spark.createDataFrame([(1, body)], "file int, body string")
    grid = '{"sheets":[{"properties":{"title":" Lots "},"data":[{"startRow":1,"startColumn":2,"rowData":[{"values":[{"formattedValue":"Lot"},{"formattedValue":"Plan","hyperlink":"https://example.org/p"}]},{"values":[{},{"formattedValue":"7"}]}]}]}]}'
    cells = {(r.row, r.col): (r.value, r.link) for r in readers.grid_cells(one_body(grid), "file", "body").collect()}
    assert cells == {(1, 2): ("Lot", None), (1, 3): ("Plan", "https://example.org/p"), (2, 3): ("7", None)}
    record = '{"schema":{"a":{"name":"Lot"},"b":{"name":"Price"}},"view":["r2","r1","gone"],"blocks":{"r1":{"alive":true,"properties":{"a":"1","b":"$5","z":"?"}},"r2":{"alive":true,"properties":{"a":"2"}},"r3":{"alive":true,"properties":{"a":"3"}},"gone":{"alive":false,"properties":{"a":"4"}}}}'
    rows = {(r.row_id, r.column): r.value for r in readers.record_table(one_body(record), "file", "body").collect()}
    assert rows == {("r1", "Lot"): "1", ("r1", "Price"): "$5", ("r2", "Lot"): "2"}


def test_keys_at_any_depth(spark):
    texts = ['{"a":[{"b":{"cost":1}}]}', '{"a":"\\"cost\\": 1"}', '{"a":"cost"}', '{"cost" : null}', None, '{"costs":1,"xcost":2}', 'not json "cost": 1', '{"c\\u006fst":1}']
    df = spark.createDataFrame(list(enumerate(texts)), "n int, x string")
    assert {r.n: r.v for r in privacy.has_keys(df, "n", "x", v=["cost", "k"]).collect()} == {0: True, 1: False, 2: False, 3: True, 4: None, 5: False, 6: False, 7: True}


@pytest.mark.parametrize(
    "address,at,found",
    [("a.png", "https://x.org", "https://x.org/a.png"), ("a.png", "https://x.org/d/e?q=/f", "https://x.org/d/a.png"), ("/a.png", "https://x.org/d/e", "https://x.org/a.png"), ("//y.org/a", "http://x.org/", "http://y.org/a"), ("HTTP://Y.org/a", "http://x.org/", "http://y.org/a")]
    + [("../a.png", "http://x.org/p/q/", "http://x.org/p/a.png"), ("../../../a", "http://x.org/p/q/r", "http://x.org/a"), ("./b/../c/.", "http://x.org/p", "http://x.org/c/"), ("..", "http://x.org/p/q/r", "http://x.org/p/"), ("a?x=1&amp;y=../z", "http://x.org/", "http://x.org/a?x=1&y=../z")]
    + [("a b.png", "http://x.org/", "http://x.org/a%20b.png"), ("http://x.org", "http://x.org/", "http://x.org/"), ("?w=2", "http://x.org/p?v=1", "http://x.org/p?w=2"), ("a" * 1500, "http://x.org/", None), ("/%2E%2e/a", "http://x.org/p/", "http://x.org/a")]
    + [("data:image/png,1", "http://x.org/", None), ("#a", "http://x.org/", None), (" ", "http://x.org/", None), ("a", "no address", None)],
)
def test_resolved(spark, address, at, found):
    assert spark.createDataFrame([(address, at)], "a string, p string").select(readers.resolved(F.col("a"), F.col("p")).alias("v")).first().v == found


def test_lines_of_pages(spark):
    page = "<body><h1>Lots  &amp;\nplans</h1><ul><li>One<b> two</b></li><li> </li></ul>tail<br/>end<nav>x</nav><script>p<p></script></body>"
    assert one(spark, readers.html_lines, page) == "Lots & plans\nOne two\ntail\nend"
    assert one(spark, lambda x: readers.html_lines(x, 6), page) == "Lots &"


def test_sheet_caps(monkeypatch):
    page = "<table>" + "<tr><td>a</td><td>b</td></tr>" * 5 + "</table>"
    monkeypatch.setattr(readers, "SHEET_ROWS", 3)
    assert len(readers.sheet_cells(page)) == 6
    monkeypatch.setattr(readers, "SHEET_CELLS", 5)
    assert readers.sheet_cells(page) == []


def test_html(spark):
    page = "<html><head><title> A  b </title><script>x<p></script></head><body><nav>menu</nav><p>One &amp; two&nbsp;<b>three</b></p><!-- no --></body></html>"
    assert one(spark, readers.html_title, page) == "A b"
    assert one(spark, readers.html_text, page) == "A b One & two three"


def test_published_sheet(spark):
    page = (
        '<table><thead><tr><th class="row-header"></th><th class="column-headers-background">A</th></tr></thead><tbody>'
        '<tr><th class="row-headers-background">1</th><td colspan="2">Lot &amp; plan</td><td rowspan="2">Tall</td><td></td></tr>'
        '<tr><th class="row-headers-background">2</th><td><a href="https://example.org/url?q=https://example.org/p.pdf&amp;x=1">p</a></td><td>b</td><td>after</td></tr>'
        '<tr><td>c<br>d</td><td><a href="javascript:x">no</a></td><td>own</td></tr></tbody></table><table><tr><td>other</td></tr></table>'
    )
    found = [tuple(r) for r in readers.published_sheet(spark.createDataFrame([(1, page), (2, None), (3, "no table")], "k int, h string"), "k", "h").collect()]
    assert found == [(1, 1, 0, "Lot & plan", None), (1, 1, 2, "Tall", None), (1, 2, 0, "p", "https://example.org/p.pdf"), (1, 2, 1, "b", None), (1, 2, 3, "after", None), (1, 3, 0, "c d", None), (1, 3, 1, "no", None), (1, 3, 2, "own", None)]


def test_sheet_links():
    """Redirects in plain characters, others, and an address that can't be parsed, which once failed the whole job."""
    cases = {
        "https://x.org/url?q=https%3A%2F%2Fy.org%2F+a%FF&amp;z=1": "https://y.org/ a\ufffd",
        "/url?q=http://y.org/%C3%A9#f": "http://y.org/é",
        "https://x.org/url?b=1&q=https://z.org/é": "https://z.org/é",
        "https://x.org/url?q=&q=https://z.org": "https://z.org",
        "HTTPS://x.org/URL?q=http://q/": "HTTPS://x.org/URL?q=http://q/",
        "https://x.org/url?q=javascript:x": None,
        "http://[x/url?q=http://q/": "http://[x/url?q=http://q/",
        "http://[x/": "http://[x/",
    }
    for address, link in cases.items():
        assert readers.sheet_cells(f'<table><tr><td rowspan="2" colspan="3" rowspan="9"><a href="{address}">a</a></td><td>b</td></tr><tr><td>c</td></tr><tr><td>d</td></tr></table>\n') == [(0, 0, "a", link), (0, 3, "b", None), (1, 3, "c", None), (2, 0, "d", None)], address


def test_reader_returns_arrow(spark):
    """Rows of files and cells of sheets are built by column: with nulls and empty files among them, and over several batches."""
    texts = ["a,b\n\n , \n1,\"2\n3\"\n", None, "", "\ufeffx\n"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").repartition(1)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        found = {r.n: r.c for r in df.select("n", readers.cells(F.col("t"), F.lit(",")).alias("c")).collect()}
        plan = df.select(readers.cells(F.col("t"), F.lit(",")))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert found == {n: [[["a", "b"], ["1", "2\n3"]], None, [], [["x"]]][n % 4] for n in range(len(texts))}
    assert "ArrowEvalPython" in plan and ", 250" in plan


def test_header_is_looked_for_once(spark):
    """Of the known headings' map there is one copy of each use, not one for a filter too."""
    grids = spark.createDataFrame([(1, [["Lot", "Price v3"], ["1", "2"]]), (2, [["x"]]), (3, None)], "n int, x array<array<string>>")
    plan = readers.header_rows(grids, "n", "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan.replace("filter(", "")
    assert [tuple(r) for r in readers.header_rows(grids, "n", "x").collect()] == [(1, 0, 2)]
    assert [tuple(r) for r in readers.keyed_rows(grids, "n", "x").orderBy("heading").collect()] == [(1, 1, "Lot", "1"), (1, 1, "Price v3", "2")]


def test_title_fallbacks(spark):
    meta = """<META content='Og &amp; <b>x</b>' name=a property="og:title">"""
    cases = [("<title> a\n<b>b</b> </title><h1>c</h1>", "a b"), (f"<title> </title>{meta}<h1>c</h1>", "Og & x"), ("<h1 class=q>Lot <i>5</i></h1><h1>d</h1>", "Lot 5"), (f"<title>{'t' * 300}</title>", "t" * 200), ("<p>x</p>", None), (None, None)]
    for page, title in cases:
        assert one(spark, readers.html_title, page) == title, page


def test_images_of_rows(spark):
    page = '<img src="/top.png"><table><tr><th>A</th></tr><tr></tr><tr><td><img src="a.png"><IMG src=\'a.png\'><img data-src="../b.png"></td></tr><tr><td><img src="data:x"></td></tr></table><table><tr><td><img src="/lay.png"></td></tr></table>'
    df = spark.createDataFrame([(1, page, "http://x.org/p/q")], "k int, h string, u string")
    assert [tuple(r) for r in readers.html_row_images(df, "k", "h", "u").orderBy("place").collect()] == [(1, 0, 1, 0, "http://x.org/p/a.png"), (1, 0, 1, 1, "http://x.org/b.png")]
    many = spark.createDataFrame([(1, "".join(f'<img src="{i}.png">' for i in range(30)), "http://x.org/")], "k int, h string, u string")
    assert [r.place for r in readers.html_images(many, "k", "h", "u").collect()] == list(range(20))


def test_header_is_chosen_in_place(spark, capsys):
    files = spark.createDataFrame([(1, CSV)], "file int, body string").withColumn("mark", readers.sniffed(F.col("body")))
    readers.keyed_rows(files.select("file", readers.cells(F.col("body"), F.col("mark")).alias("rows")), "file", "rows").explain()
    plan = capsys.readouterr().out
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("size", [25, 1000])
def test_delimited_files_over_ranges(spark, tmp_path, size):
    """Ranges of a few bytes give what a serial parse of the file gives, wherever they cut quotes, breaks and letters."""
    import csv
    import random

    from quillstone.sources.delimited import read_delimited

    dice = random.Random(size)
    cell = lambda: dice.choice(["a", "", " ", "é€😀", 'say "hi"', "x,y", "line\nbreak", '"', '""', "\n\n", "r\r\nn", "long " * 20, "1\n2\n3\n4\n5\n6\n7"])
    wanted = {}
    for name, end in (("a.csv", "\n"), ("b.csv", "\r\n"), ("c.csv", "\n")):
        rows = [[cell() for _ in range(3)] for _ in range(60)]
        with open(tmp_path / name, "w", newline="", encoding="utf-8-sig" if name == "b.csv" else "utf-8") as f:
            csv.writer(f, lineterminator=end).writerows(rows)
        wanted[name] = [r for r in rows if any(c.strip() for c in r)]
    (tmp_path / "d.csv").write_text('open,"never closed\nto the end')
    wanted["d.csv"] = [["open", "never closed\nto the end\n"]]
    held = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = read_delimited(spark, str(tmp_path)).orderBy("file", "begin", "place", "nth").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held[0])
        spark.conf.set("spark.sql.files.openCostInBytes", held[1])
    by_file = {}
    for r in found:
        by_file.setdefault(r.file.rsplit("/", 1)[1], []).append(r.cells)
    assert by_file == wanted and len({r.begin for r in found}) > (10 if size < 100 else 3)
