"""Readers, coercions and matching over pages, documents, parts and literal grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import coerce, files, headers, privacy
from quillstone.operators import matching as M
from quillstone.operators.tablefunctions import register_functions
from quillstone.registry import Tables, query
from quillstone.session import scratch
from quillstone.sources import readers as S
from quillstone.sources.delimited import read_delimited
from quillstone.sources.sinks import csv_line
from quillstone.sources.tables import spread

_HEADINGS = ["Land Size (m2)", "LAND $", "Package Price - V002", "Build Price - V002", "Lot #", "BED // BATH // CAR", "  Estate  Name ", "House m²", "Yield %", "Status", "", "Suburb/Town", "Price V12"]
_CELLS = ["$749,000", "3.5", "3+1", "POA", "From $749,000", "n/a", "TBC", " 1,234.50 ", "-7", "$ 12", "none", "12 to 14", ""]
_STATES = ["Available", "Under Offer", "EOI", "Not Available", "Completed", "Unconditional", "TBC", "Foo", "Deposit taken", "SOLD", "off market", "in stock"]


_PRICED = "CASE p_partkey % 7 WHEN 0 THEN '$' || p_partkey || ',500' WHEN 1 THEN 'From $' || p_partkey || ' + GST' WHEN 2 THEN '-' || p_partkey || '.25' WHEN 3 THEN 'n/a' WHEN 4 THEN p_name || ' ' || p_size WHEN 5 THEN CAST(p_size AS STRING) ELSE '$ 1,0' || p_partkey || '.5 each' END"


def _values(items: list[str]) -> str:
    return ", ".join("('" + x.replace("'", "''") + "')" for x in items)


def _literal(t: Tables, items: list[str], name: str) -> DataFrame:
    return t.spark.sql("SELECT * FROM VALUES " + _values(items) + f" AS v({name})")


_KEY = "regexp_replace(replace(replace(lower({x}), '$', ' dollars '), '%', ' percent '), '[^a-z0-9]+', '', 'g')"


@query(f"SELECT heading, {_KEY.format(x='heading')} AS key FROM (VALUES {_values(_HEADINGS)}) v(heading) UNION ALL SELECT p_name, {_KEY.format(x='p_name')} FROM part")
def normalise_header(t: Tables) -> DataFrame:
    both = _literal(t, _HEADINGS, "heading").union(t.part.select("p_name"))
    return both.select("heading", headers.header_key(F.col("heading")).alias("key"))


@query(
    "SELECT doc_id, TRY_CAST(nullif(regexp_extract(replace(text, ',', ''), '-?[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE) AS first_number FROM documents"
)
def coerce_number(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", coerce.first_number(F.col("text")).alias("first_number"))


@query(
    f"SELECT cell, TRY_CAST(nullif(regexp_extract(replace(stated, ',', ''), '-?[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE) AS price, CASE WHEN stated IS NOT NULL AND NOT regexp_matches(stated, '^\\$?\\s*[0-9][0-9,]*(\\.[0-9]+)?$') THEN stated END AS display "
    f"FROM (SELECT cell, CASE WHEN trim(cell) <> '' AND NOT regexp_matches(lower(trim(cell)), '^(n/?a|nil|none|tbc|tba|-{{1,3}}|\\.|unknown|null)$') THEN trim(cell) END AS stated FROM (SELECT * FROM (VALUES {_values(_CELLS)}) v(cell) UNION ALL SELECT {_PRICED} FROM part)) x"
)
def coerce_price(t: Tables) -> DataFrame:
    cells = _literal(t, _CELLS, "cell").union(t.part.select(F.expr(_PRICED)))
    priced = cells.withColumn("p", coerce.price(F.col("cell")))
    return priced.select("cell", "p.price", "p.display")


def _case(patterns: list[tuple[str, str]], x: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '(?i){p}') THEN '{v}'" for p, v in patterns) + f" ELSE '{default}' END"


@query(f"SELECT cell, CASE WHEN lower(cell) = 'tbc' THEN 'unknown' ELSE {_case(coerce.AVAILABILITY, 'cell', 'unknown')} END AS availability FROM (VALUES {_values(_STATES)}) v(cell) UNION ALL SELECT p_name, {_case(coerce.AVAILABILITY, 'p_name', 'unknown')} FROM part")
def coerce_enum(t: Tables) -> DataFrame:
    both = _literal(t, _STATES, "cell").union(t.part.select("p_name"))
    return both.select("cell", coerce.availability(F.col("cell")).alias("availability"))


def _decoded_sql(x: str) -> str:
    for entity, char in S.ENTITIES.items():
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


# A quarter of the pages keep their title; the others have it renamed, and two of them name it in a meta element.
_UNTITLED = "replace(html, 'title>', 'name>')"
_TITLED = (
    f"CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN '<meta property=\"og:title\" content=\"Site &amp; ' || page_id || '\">' || {_UNTITLED} "
    f"WHEN 2 THEN '<META content=\"P ' || repeat('x', 300) || '\" property=\"og:title\">' || {_UNTITLED} ELSE {_UNTITLED} END"
)
_SQUASHED = f"trim(regexp_replace({_decoded_sql("regexp_replace(regexp_extract(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1), '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g'))"


@query(
    f"SELECT page_id, substr(CASE page_id % 4 WHEN 0 THEN {_SQUASHED.replace('{tag}', 'title')} WHEN 1 THEN 'Site & ' || page_id WHEN 2 THEN 'P ' || repeat('x', 300) ELSE {_SQUASHED.replace('{tag}', 'h1')} END, 1, 200) AS title FROM pages"
)
def html_title(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.expr(_TITLED).alias("html")).select("page_id", S.html_title(F.col("html")).alias("title"))


def _text_sql() -> str:
    out = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in S.CHROME:
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', ' ', 'g')"
    for entity, char in S.ENTITIES.items():
        out = f"replace({out}, '{entity}', '{char.replace("'", "''")}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_text_sql()} AS body FROM pages")
def html_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", S.html_text(F.col("html")).alias("body"))


@query("SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) x GROUP BY page_id, href")
def html_links(t: Tables) -> DataFrame:
    return S.html_links(t.pages, "page_id", "html").groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(
    "SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host, regexp_replace(regexp_replace(url, '#.*$', ''), '^([a-zA-Z]+://)[^/@]*@', '\\1') AS clean, "
    "regexp_matches(url, '^https?://') AS accepted, regexp_replace(regexp_extract(url, '^[a-zA-Z]+://(?:[^/@]*@)?(?:www[.])?([^/:?#]+)', 1), '^$', 'source') AS display FROM pages"
)
def url_normalise(t: Tables) -> DataFrame:
    u = F.col("url")
    return t.pages.select(
        "page_id",
        F.lower(F.regexp_extract(u, "^([a-zA-Z]+)://", 1)).alias("scheme"),
        F.lower(F.regexp_extract(u, "^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1)).alias("host"),
        F.regexp_replace(F.regexp_replace(u, "#.*$", ""), "^([a-zA-Z]+://)[^/@]*@", "$1").alias("clean"),
        u.rlike("^https?://").alias("accepted"),
        F.coalesce(F.nullif(F.regexp_extract(u, "^[a-zA-Z]+://(?:[^/@]*@)?(?:www[.])?([^/:?#]+)", 1), F.lit("")), F.lit("source")).alias("display"),
    )


# Names, first bytes (in hexadecimal; null: those of the page) and declared types of files, and what they are.
_SOURCES = [
    ("list.csv", "", "", "delimited"),
    ("plan.PDF?v=2", "255044462D312E37", "text/html", "pdf"),
    ("plan.pdf", "4D5A9000", "application/pdf", "unsupported"),
    ("photo.xlsx", "89504E470D0A", "", "image"),
    ("stock.xlsx", "504B030414", "application/octet-stream", "spreadsheet"),
    ("bundle.zip", "504B030414", "", "unsupported"),
    ("letter.doc", "D0CF11E0A1B1", "", "word"),
    ("scan.tif", "49492A0008", "image/tiff", "unsupported"),
    ("feed", "7B226122", "application/json; charset=utf-8", "structured"),
    ("run.csv", "2321202F62696E", "text/csv", "unsupported"),
    ("pic.bin", "524946460000000057454250", "", "image"),
    ("page.htm#top", None, " TEXT/HTML ", "markup"),
    ("noext", "", "", "unsupported"),
]


@query(
    f"SELECT page_id, url || '/' || CASE page_id % {len(_SOURCES)} " + " ".join(f"WHEN {k} THEN '{x[0]}'" for k, x in enumerate(_SOURCES)) + f" END AS name, CASE page_id % {len(_SOURCES)} " + " ".join(f"WHEN {k} THEN '{x[3]}'" for k, x in enumerate(_SOURCES)) + " END AS kind FROM pages"
)
def classify_source(t: Tables) -> DataFrame:
    of = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in _SOURCES)), (F.col("page_id") % len(_SOURCES) + 1).cast("int"))
    head = F.coalesce(F.unhex(of(1)), F.encode(F.substring("html", 1, 16), "utf-8"))
    named = t.pages.select("page_id", F.concat("url", F.lit("/"), of(0)).alias("name"), head.alias("head"), of(2).alias("declared"))
    # The fragment of an address that has one takes in what follows it, so the name alone is classified.
    return named.select("page_id", "name", files.classify(F.substring_index("name", "/", -1), F.col("head"), F.col("declared")).alias("kind"))


def _lines_sql() -> str:
    out = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in S.CHROME:
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '\\s+', ' ', 'g'), '(?i)<br\\b[^>]*>|</?({'|'.join(S.BLOCKS)})\\b[^>]*>', chr(10), 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', ' ', 'g')"
    for entity, char in S.ENTITIES.items():
        out = f"replace({out}, '{entity}', '{char.replace("'", "''")}')"
    lines = f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"
    return f"substr(array_to_string({lines}, chr(10)), 1, {S.TEXT_CAP})"


@query(f"SELECT page_id, md5(body) AS body_md5, length(body) AS n_body, len(body) - len(replace(body, chr(10), '')) AS n_breaks FROM (SELECT page_id, {_lines_sql()} AS body FROM pages) p")
def html_lines(t: Tables) -> DataFrame:
    body = t.pages.select("page_id", S.html_lines(F.col("html")).alias("body"))
    size = F.length("body").cast("long")
    return body.select("page_id", F.md5("body").alias("body_md5"), size.alias("n_body"), (size - F.length(F.replace("body", F.lit("\n"), F.lit("")))).cast("long").alias("n_breaks"))


# The links of a page's menu as its images, in a folder beside the page's own, with an entity in the address.
_PICTURED = "replace(replace(replace(html, '<nav>', '<div>'), '</nav>', '</div>'), '<a href=\"/', '<img alt=\"x\" SRC=\"../i&amp;j/./')"
_LINKS = (
    "SELECT page_id, href, min(place) AS first FROM (SELECT page_id, unnest(links) AS href, unnest(range(len(links))) AS place FROM "
    "(SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href=\"/([^\"]*)\"', 1) AS links FROM pages) p) x GROUP BY page_id, href"
)
# The address of the folder above a page's own.
_ABOVE = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^(https?://[^/]+)((?:/[^/]+)*?)(?:/[^/]+)?/[^/]*$', '\\1\\2')"


@query(f"SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY first) - 1)::INT AS place, {_ABOVE} || '/i&j/' || href AS image FROM ({_LINKS}) l JOIN pages USING (page_id) QUALIFY place < 20")
def html_images(t: Tables) -> DataFrame:
    return S.html_images(t.pages.select("page_id", "url", F.expr(_PICTURED).alias("html")), "page_id", "html", "url")


# The paragraphs of a page as the rows of a table, each with two images.
_TABLED = (
    "replace(replace(replace(replace(html, '<article>', '<article><table>'), '</article>', '</table></article>'), '<p>', "
    "'<tr><td><img src=\"/p.png\"><img src=\"//cdn.example.org/q/../r.png\">'), '</p>', '</td></tr>')"
)
_PARAGRAPHS = "SELECT page_id, url, unnest(ps) AS p, unnest(range(len(ps)))::INT AS row, len(ps) AS n FROM (SELECT page_id, url, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS ps FROM pages) x"


_PLAIN = _decoded_sql("regexp_replace(p, '<[^>]*>', ' ', 'g')")


@query(f"SELECT page_id, row, 0 AS col, trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g')) AS value FROM ({_PARAGRAPHS}) x WHERE n > 1")
def html_tables(t: Tables) -> DataFrame:
    return S.html_tables(t.pages.select("page_id", F.expr(_TABLED).alias("html")), "page_id", "html").select("page_id", "row", "col", "value")


@query(
    f"SELECT page_id, row, i::INT AS place, CASE i WHEN 0 THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/p.png' ELSE regexp_extract(url, '^(https?:)', 1) || '//cdn.example.org/r.png' END AS image FROM ({_PARAGRAPHS}) x, range(2) r(i) WHERE n > 1"
)
def html_row_images(t: Tables) -> DataFrame:
    return S.html_row_images(t.pages.select("page_id", "url", F.expr(_TABLED).alias("html")), "page_id", "html", "url").select("page_id", "row", "place", "image")


# A file for each order: a title that most have, a header, and a row for each line, under one of four delimiters.
_MARKS = [",", "\t", ";", "|"]
_ROWS = (
    "SELECT l_orderkey AS file, l_linenumber AS no, l_partkey AS part, floor(l_extendedprice)::BIGINT AS price, l_returnflag AS flag, "
    "(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, floor(l_extendedprice), l_returnflag))::INT AS rn FROM lineitem"
)


def _lines(t: Tables) -> DataFrame:
    """file and lines: the few lines of each order, in order."""
    line = F.struct(F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("part"), F.floor("l_extendedprice").cast("long").alias("price"), F.col("l_returnflag").alias("flag"))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("file")).agg(F.sort_array(F.collect_list(line)).alias("lines"))


@query(
    f"SELECT file, rn + 1 AS row, 0 AS col, no::VARCHAR AS value, CASE WHEN part % 2 = 0 THEN 'https://example.org/p' || part || '?a=1&b=2' END AS link FROM ({_ROWS}) x UNION ALL SELECT file, rn + 1, 2, '$' || price, NULL FROM ({_ROWS}) x "
    "UNION ALL SELECT DISTINCT l_orderkey, 1, 0, 'Order & co', NULL FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, 1, 3, 'side', NULL FROM lineitem"
)
def published_sheets(t: Tables) -> DataFrame:
    gutter = lambda n: F.concat(F.lit('<th class="row-headers-background">'), n.cast("string"), F.lit("</th>"))
    link = lambda x: F.concat(F.lit('<a href="https://www.example.com/url?q=https://example.org/p'), x["part"].cast("string"), F.lit('%3Fa%3D1%26b%3D2&amp;sa=D">'), x["no"].cast("string"), F.lit("</a>"))
    first = lambda x: F.when(x["part"] % 2 == 0, link(x)).otherwise(x["no"].cast("string"))
    row = lambda x, i: F.concat(F.lit("<tr>"), gutter(i + 3), F.lit('<td colspan="2">'), first(x), F.lit("</td><td> $"), x["price"].cast("string"), F.lit("</td></tr>"))
    # The side cell reaches down over the rows of all lines.
    head = F.concat(F.lit('<table><tr><th class="column-headers-background">A</th></tr><tr>'), gutter(F.lit(2)), F.lit('<td colspan="3">Order &amp; co</td><td rowspan="'), (F.size("lines") + 1).cast("string"), F.lit('">side</td></tr>'))
    page = F.concat(head, F.array_join(F.transform("lines", row), ""), F.lit("</table><table><tr><td>no</td></tr></table>"))
    return S.published_sheet(_lines(t).select("file", page.alias("html")), "file", "html")


def _files(t: Tables) -> DataFrame:
    mark = F.element_at(F.array(*map(F.lit, _MARKS)), (F.col("file") % 4 + 1).cast("int"))
    address = lambda x: F.concat(F.lit('"Lot '), x["part"].cast("string"), F.lit(', 5 ""High"" St"'))
    row = lambda x: F.concat(x["no"].cast("string"), mark, address(x), mark, F.lit("$"), x["price"].cast("string"))
    title = F.when(F.col("file") % 5 > 0, F.concat(F.lit("\ufeffStock list"), mark, mark, F.lit("\r\n\r\n"))).otherwise("")
    body = F.concat(title, F.lit("Lot"), mark, F.lit("Address"), mark, F.lit("Price\n"), F.array_join(F.transform("lines", row), "\n"), F.lit("\n"), mark, mark)
    return _lines(t).select("file", body.alias("body")).withColumn("mark", S.sniffed(F.col("body")))


def _grids(t: Tables) -> DataFrame:
    return _files(t).select("file", S.cells(F.col("body"), F.col("mark")).alias("rows"))


@query("SELECT DISTINCT l_orderkey AS file, CASE l_orderkey % 4 WHEN 0 THEN ',' WHEN 1 THEN chr(9) WHEN 2 THEN ';' ELSE '|' END AS mark FROM lineitem")
def sniff_delimiter(t: Tables) -> DataFrame:
    return _files(t).select("file", "mark")


@query(
    f"SELECT file, CAST(CASE WHEN file % 5 > 0 THEN rn + 1 ELSE rn END AS BIGINT) AS row, heading, CASE heading WHEN 'Lot' THEN no::VARCHAR WHEN 'Address' THEN 'Lot ' || part || ', 5 \"High\" St' ELSE '$' || price END AS cell "
    f"FROM ({_ROWS}) x, (VALUES ('Lot'), ('Address'), ('Price')) h(heading)"
)
def ingest_delimited(t: Tables) -> DataFrame:
    return S.keyed_rows(_grids(t), "file", "rows")


@query(
    f"SELECT file, CAST(CASE WHEN file % 5 > 0 THEN rn + 1 ELSE rn END AS BIGINT) AS row, no::VARCHAR AS lot_number, '$' || price AS price, NULL::VARCHAR AS suburb FROM ({_ROWS}) x"
)
def delimited_sql(t: Tables) -> DataFrame:
    """The files by a table function of SQL, whose columns are those that the call names."""
    register_functions(t.spark)
    return t.spark.sql("SELECT * FROM delimited_rows(TABLE(SELECT file, body, mark FROM {files}), 'lot_number, price, suburb')", files=_files(t))


@query("SELECT o_orderkey::VARCHAR AS key, md5('say \"' || o_orderpriority || '\",' || chr(10) || o_orderkey || chr(10) || ' end') AS said_md5, '' AS none, o_orderstatus AS status FROM orders")
def ingest_split_files(t: Tables) -> DataFrame:
    """All orders as delimited files with quotes and line breaks in their cells, read back by byte ranges."""
    said = F.concat(F.lit('say "'), "o_orderpriority", F.lit('",\n'), F.col("o_orderkey").cast("string"), F.lit("\n end"))
    path = scratch(t.spark, "delimited")
    lines = t.orders.select("o_orderkey", said.alias("said"), F.lit(None).cast("string").alias("none"), "o_orderstatus")
    lines.select(csv_line(lines).alias("value")).write.text(path)
    cell = lambda k: F.col("cells")[k]
    return read_delimited(t.spark, path).select(cell(0).alias("key"), F.md5(cell(1)).alias("said_md5"), cell(2).alias("none"), cell(3).alias("status"))


@query("SELECT DISTINCT l_orderkey AS file, CASE WHEN l_orderkey % 5 > 0 THEN 1 ELSE 0 END::BIGINT AS header_row, 3::BIGINT AS score FROM lineitem")
def header_row(t: Tables) -> DataFrame:
    return S.header_rows(_grids(t), "file", "rows")


@query(
    f"SELECT file, 'Order ' || file AS sheet, rn AS row, 2 AS col, no::VARCHAR AS value, NULL AS link FROM ({_ROWS}) x UNION ALL "
    f"SELECT file, 'Order ' || file, rn, 4, part::VARCHAR, CASE WHEN part % 2 = 0 THEN 'https://example.org/p' || part END FROM ({_ROWS}) x"
)
def json_grid(t: Tables) -> DataFrame:
    cell = lambda value, link: F.struct(value.alias("formattedValue"), link.alias("hyperlink"))
    none = F.lit(None).cast("string")
    link = lambda x: F.concat(F.when(x["part"] % 2 == 0, "https").otherwise("ftp"), F.lit("://example.org/p"), x["part"].cast("string"))
    rows = F.transform("lines", lambda x: F.struct(F.array(cell(x["no"].cast("string"), none), cell(none, none), cell(x["part"].cast("string"), link(x))).alias("values")))
    data = F.struct(F.lit(1).alias("startRow"), F.lit(2).alias("startColumn"), rows.alias("rowData"))
    title = F.struct(F.concat(F.lit(" Order "), F.col("file").cast("string"), F.lit(" ")).alias("title"))
    body = F.to_json(F.struct(F.array(F.struct(title.alias("properties"), F.array(data).alias("data"))).alias("sheets")))
    return S.grid_cells(_lines(t).select("file", body.alias("body")), "file", "body")


@query(
    f"SELECT file, 'r' || rn AS row_id, col AS \"column\", CASE col WHEN 'Lot' THEN no::VARCHAR ELSE '$' || price END AS value FROM ({_ROWS}) x, (VALUES ('Lot'), ('Price')) c(col) WHERE flag <> 'R' AND rn % 3 > 0"
)
def recordmap_table(t: Tables) -> DataFrame:
    name = lambda i: F.concat(F.lit("r"), (i + 1).cast("string"))
    block = lambda x, i: F.struct(
        name(i).alias("key"),
        F.struct((x["flag"] != "R").alias("alive"), F.create_map(F.lit("a"), x["no"].cast("string"), F.lit("b"), F.concat(F.lit("$"), x["price"].cast("string")), F.lit("z"), F.lit("?")).alias("properties")).alias("value"),
    )
    schema = F.create_map(F.lit("a"), F.struct(F.lit("Lot").alias("name")), F.lit("b"), F.struct(F.lit("Price").alias("name")))
    view = F.filter(F.transform("lines", lambda x, i: F.when((i + 1) % 3 > 0, name(i)).otherwise("gone")), lambda r: r.isNotNull())
    body = F.to_json(F.struct(schema.alias("schema"), view.alias("view"), F.map_from_entries(F.transform("lines", block)).alias("blocks")))
    return S.record_table(_lines(t).select("file", body.alias("body")), "file", "body")


# A payload for each event, with the event's own properties among lists and objects, quotes inside a text, and a key with an escape.
_DEEP = (
    "'{\"id\":' || event_id || ',\"deal\":{\"' || CASE WHEN event_id % 5 = 0 THEN 'clientEmail' ELSE 'contact' END || '\":\"x\",\"terms\":[{\"' || CASE event_id % 4 WHEN 0 THEN 'margin' WHEN 1 THEN 'Markup' WHEN 2 THEN 'grossMarginPct' ELSE 'kept' END "
    "|| '\":2},' || props || '],\"note\":{\"internal_notes\":{\"margin\":1}}},\"said\":\"it \\\"cost\\\": 1\",\"' || CASE WHEN event_id % 7 = 0 THEN 'm\\u0061rgin' ELSE 'pl\\u0061in' END || '\":{\"tfn\":1},\"' || CASE WHEN event_id % 3 = 0 THEN 'staff_id' ELSE 'office' END || '\":1}'"
)
_KEYS_OF = f"SELECT event_id, j.id, j.key, j.fullkey, lower(regexp_replace(j.key, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake FROM (SELECT event_id, {_DEEP} AS payload FROM events) e, json_tree(e.payload) j WHERE j.key IS NOT NULL"
_LISTED = "SELECT e.event_id, coalesce(paths, '') AS paths FROM events e LEFT JOIN (SELECT event_id, string_agg(replace(fullkey, '$.', ''), ',' ORDER BY id) AS paths FROM {found} GROUP BY event_id) p ON p.event_id = e.event_id"


def _payloads(t: Tables) -> DataFrame:
    return spread(t.events.select("event_id", "props")).select("event_id", F.expr(_DEEP.replace("\\", "\\\\")).alias("payload"))


@query(
    f"SELECT e.event_id, bool_or(key IN ('k', 'cost')) AS has_key, bool_or(key IN ('client_id', 'cost', 'clientEmail', 'margin')) AS forbidden FROM events e JOIN ({_KEYS_OF}) k ON k.event_id = e.event_id GROUP BY e.event_id"
)
def json_forbidden_keys(t: Tables) -> DataFrame:
    return privacy.has_keys(_payloads(t), "event_id", "payload", has_key=["k", "cost"], forbidden=["client_id", "cost", "clientEmail", "margin"])


_EXACT = ", ".join(f"'{x}'" for x in sorted(privacy.EXACT))
_PARTS = " OR ".join(f"contains(snake, '{x}')" for x in privacy.FRAGMENTS)
_FORBIDDEN = f"SELECT * FROM ({_KEYS_OF}) k WHERE snake IN ({_EXACT}) OR {_PARTS}"


@query(_LISTED.format(found=f"({_FORBIDDEN}) f WHERE NOT EXISTS (SELECT 1 FROM ({_FORBIDDEN}) a WHERE a.event_id = f.event_id AND starts_with(f.fullkey, a.fullkey || '.'))"))
def privacy_paths(t: Tables) -> DataFrame:
    return privacy.forbidden_paths(_payloads(t), "event_id", "payload").withColumn("paths", F.array_join("paths", ","))


@query(_LISTED.format(found=f"({_KEYS_OF}) k WHERE regexp_matches(key, '(?i)internal_note|margin')"))
def restricted_paths(t: Tables) -> DataFrame:
    return privacy.restricted_paths(_payloads(t), "event_id", "payload", "(?i)internal_note|margin").withColumn("paths", F.array_join("paths", ","))


_EXISTING = "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 1 THEN p_partkey * 3 END AS anchor, 'R' || CAST(p_partkey % 700 AS VARCHAR) AS reference, p_brand AS brand, p_type AS type, p_size AS size FROM part WHERE p_partkey % 3 <> 0"
_INCOMING = "SELECT p_partkey AS line, CASE WHEN p_partkey % 4 = 1 THEN p_partkey * 3 END AS anchor, CASE WHEN p_partkey % 5 = 0 THEN 'R' || CAST(p_partkey AS VARCHAR) END AS reference, CASE WHEN p_partkey % 8 = 1 THEN 'Other' ELSE p_brand END AS brand, p_type AS type, p_size AS size FROM part WHERE p_partkey % 2 = 1"
_DIFFERS = "(coalesce(i.brand, '') <> '' AND coalesce({e}.brand, '') <> '' AND i.brand <> {e}.brand) OR (coalesce(i.type, '') <> '' AND coalesce({e}.type, '') <> '' AND i.type <> {e}.type)"


def _parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    t.part.createOrReplaceTempView("part")
    fit = lambda q: t.spark.sql(q.replace("AS VARCHAR", "AS STRING"))
    return fit(_INCOMING), fit(_EXISTING)


@query(
    f"SELECT line, coalesce(a, r, c) AS match, CASE WHEN a IS NOT NULL THEN 1 WHEN r IS NOT NULL THEN 2 WHEN c IS NOT NULL THEN 3 END AS rule FROM (SELECT i.line, "
    f"min(CASE WHEN NOT ({_DIFFERS.format(e='x')}) THEN x.id END) AS a, min(y.id) AS r, min(z.id) AS c FROM ({_INCOMING}) i LEFT JOIN ({_EXISTING}) x ON x.anchor = i.anchor LEFT JOIN ({_EXISTING}) y ON y.reference = i.reference "
    f"LEFT JOIN ({_EXISTING}) z ON z.brand = i.brand AND z.type = i.type AND z.size = i.size GROUP BY i.line) m"
)
def match_priority_keys(t: Tables) -> DataFrame:
    incoming, existing = _parts(t)
    return M.by_priority(incoming, existing, "line", [["anchor"], ["reference"], ["brand", "type", "size"]], ["brand", "type"])


@query(f"SELECT i.line, x.id, {_DIFFERS.format(e='x')} AS differs FROM ({_INCOMING}) i JOIN ({_EXISTING}) x ON x.anchor = i.anchor")
def identity_guard(t: Tables) -> DataFrame:
    incoming, existing = _parts(t)
    return incoming.alias("i").join(existing.alias("x"), F.col("i.anchor") == F.col("x.anchor")).select("i.line", "x.id", M.differs("i", "x", ["brand", "type"]).alias("differs"))


@query(
    "SELECT l_orderkey, l_linenumber, unit FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 25) w LEFT JOIN (SELECT o_orderkey, (o_orderkey % 7) + 1 AS number, o_custkey AS unit FROM orders WHERE o_orderkey % 2 = 0) u "
    "ON w.l_orderkey = u.o_orderkey AND w.l_linenumber = u.number"
)
def link_inventory(t: Tables) -> DataFrame:
    wanted = t.lineitem.where("l_quantity > 25").select("l_orderkey", "l_linenumber").distinct()
    units = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"), ((F.col("o_orderkey") % 7) + 1).cast("int").alias("l_linenumber"), F.col("o_custkey").alias("unit"))
    return wanted.join(units, ["l_orderkey", "l_linenumber"], "left")


_CELLS_OF = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(
    "SELECT l.o_orderkey AS left_id, min(r.o_orderkey) AS right_id, CAST(5 AS BIGINT) AS agreed FROM orders l JOIN orders r ON l.o_custkey = r.o_custkey AND l.o_orderstatus = r.o_orderstatus AND l.o_totalprice = r.o_totalprice AND l.o_orderdate = r.o_orderdate AND l.o_orderpriority = r.o_orderpriority "
    "WHERE r.o_orderkey % 3 <> 0 GROUP BY l.o_orderkey HAVING count(*) = 1"
)
def align_rows_best_unique(t: Tables) -> DataFrame:
    left = t.orders.withColumnRenamed("o_orderkey", "left_id")
    # A third of the right rows don't state the price, so they agree with too few cells.
    right = t.orders.withColumnRenamed("o_orderkey", "right_id").withColumn("o_totalprice", F.when(F.col("right_id") % 3 != 0, F.col("o_totalprice")))
    return M.best_unique(left, right, "left_id", "right_id", _CELLS_OF)


_WORDS = "[A-Za-z0-9]+"


@query(
    f"WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS w FROM documents), b AS (SELECT item_id, list_distinct(regexp_extract_all(text, '{_WORDS}')) AS w FROM benchmark), "
    "s AS (SELECT doc_id, item_id, count(*) / max(n) AS score FROM (SELECT doc_id, unnest(w) AS word FROM d) x JOIN (SELECT item_id, len(w) AS n, unnest(w) AS word FROM b) y USING (word) GROUP BY doc_id, item_id HAVING count(*) >= 0.75 * max(n)), "
    "r AS (SELECT *, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS nxt, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rn FROM s) "
    "SELECT d.doc_id, CASE WHEN score >= 0.95 AND (nxt IS NULL OR score - nxt >= 0.2) THEN item_id END AS item_id, score, CASE WHEN coalesce(score, 0) < 0.95 THEN 'no_match' WHEN nxt IS NOT NULL AND score - nxt < 0.2 THEN 'ambiguous' ELSE 'ok' END AS verdict "
    "FROM d LEFT JOIN r ON r.doc_id = d.doc_id AND rn = 1"
)
def match_with_margin(t: Tables) -> DataFrame:
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(_WORDS), F.lit(0)))
    documents, items = t.documents.select("doc_id", words("text").alias("words")), t.benchmark.select("item_id", words("text").alias("words"))
    # What scores lower than the floor by the margin can't stand in the way of the best.
    best = M.decisive(M.containments(documents, items, "doc_id", "item_id", "words", 0.75), "doc_id", "item_id")
    return t.documents.select("doc_id").join(best, "doc_id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("no_match")))


_NAMED = "CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN p_name || ' ' || p_partkey ELSE '' END"


@query(
    f"WITH l AS (SELECT p_partkey AS place, p_name || ' ' || p_partkey AS name FROM part UNION ALL SELECT p_partkey, upper(p_name) FROM part), r AS (SELECT p_partkey AS place, {_NAMED} AS name FROM part) "
    "SELECT l.place AS left_at, CASE WHEN a.n = 1 AND b.n = 1 THEN b.place END AS right_at FROM l LEFT JOIN (SELECT name, count(*) AS n FROM l GROUP BY name) a ON a.name = l.name LEFT JOIN (SELECT name, count(*) AS n, min(place) AS place FROM r WHERE name <> '' GROUP BY name) b ON b.name = l.name"
)
def header_column_map(t: Tables) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    numbered = F.concat(name, F.lit(" "), k.cast("string"))
    left = t.part.select(k.alias("at"), numbered.alias("name")).union(t.part.select(k, F.upper(name)))
    return M.column_map(left, t.part.select(k.alias("at"), F.when(k % 3 == 0, F.upper(name)).when(k % 3 == 1, numbered).otherwise("").alias("name")))
