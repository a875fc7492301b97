"""Delimited text, HTML pages, cell grids and record maps as rows."""

from __future__ import annotations

import csv
import html as entities
import io
import re
from itertools import islice
from urllib.parse import parse_qs, unquote_to_bytes, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.exprs import let
from quillstone.functions.headers import field_of
from quillstone.session import ship

# Elements that are never content, and entities.
CHROME = "script style noscript template svg canvas iframe nav header footer aside form button select video audio".split()
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&amp;": "&"}
BLOCKS = "p div section article main ul ol li table tr h1 h2 h3 h4 h5 h6 blockquote pre dl dt dd".split()
# What a reader takes of a page, and of a published sheet.
TEXT_CAP = 120_000
TITLE_CAP, ADDRESS_CAP, IMAGES = 200, 1500, 20
SHEET_ROWS, SHEET_CELLS = 20_000, 400_000
DELIMITERS = [",", "\t", ";", "|"]


def sniffed(text: Column) -> Column:
    """The delimiter that occurs most often in the first ten lines; ties to the earlier of DELIMITERS, comma if none does."""
    sample = F.array_join(F.slice(F.split(text, r"\r?\n"), 1, 10), "\n")
    counts = F.array(*(F.struct((F.length(sample) - F.length(F.replace(sample, F.lit(d), F.lit("")))).alias("n"), F.lit(-k).alias("k"), F.lit(d).alias("d")) for k, d in enumerate(DELIMITERS)))
    return F.array_max(counts)["d"]


def cells(text: Column, delimiter: Column) -> Column:
    """array<array<string>>: rows of quoted delimited text with quotes doubled and line breaks inside them; blank rows go."""

    @F.arrow_udf("array<array<string>>")
    def parse(texts: pa.Array, marks: pa.Array) -> pa.Array:
        flat: list[str] = []
        rows, files = [0], []
        for body, mark in zip(texts.to_pylist(), marks.to_pylist()):
            files.append(None if body is None else len(rows) - 1)
            if body is not None:
                for row in csv.reader(io.StringIO(body.removeprefix("\ufeff"), newline=""), delimiter=mark):
                    if "".join(row).strip():
                        flat += row
                        rows.append(len(flat))
        return pa.ListArray.from_arrays(pa.array([*files, len(rows) - 1], pa.int32()), pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(flat, pa.string())))

    # So marked, it isn't evaluated anew for a filter on what it gives.
    return parse.asNondeterministic()(text, delimiter)


def header_of(rows: Column, scan: int = 15, least: int = 2) -> Column:
    """struct<score,row>: of the first ``scan`` rows that with the most different known headings, the earliest of equals;
    null where it has fewer than ``least``."""
    known = lambda cells: F.size(F.array_distinct(F.filter(F.transform(cells, field_of), lambda f: f.isNotNull())))
    best = F.array_max(F.transform(F.slice(rows, 1, scan), lambda cells, i: F.struct(known(cells).cast("long").alias("score"), (-i).alias("back"))))
    return let(best, lambda b: F.when(b["score"] >= least, F.struct(b["score"].alias("score"), (-b["back"]).cast("long").alias("row"))))


def _header_once(rows: Column, scan: int = 15, least: int = 2) -> Column:
    """A row with header_of, none without a header; a filter on header_of would have it made twice."""
    return F.explode(F.filter(F.array(header_of(rows, scan, least)), lambda h: h.isNotNull()))


def header_rows(grids: DataFrame, key: str, rows: str, scan: int = 15, least: int = 2) -> DataFrame:
    """key, header_row and score of each grid that has a header."""
    found = grids.select(key, _header_once(F.col(rows), scan, least).alias("_h"))
    return found.select(key, F.col("_h.row").alias("header_row"), F.col("_h.score").alias("score"))


def keyed_rows(grids: DataFrame, key: str, rows: str) -> DataFrame:
    """key, row, heading and cell below each grid's header; a blank heading is column_N, blank rows go."""
    held = grids.select(key, F.col(rows).alias("_rows"), _header_once(F.col(rows)).alias("_h")).select(key, "_rows", F.col("_h.row").alias("header_row"))
    names = F.transform(F.get(F.col("_rows"), F.col("header_row").cast("int")), lambda c, i: F.coalesce(F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")), F.concat(F.lit("column_"), (i + 1).cast("string"))))
    body = held.select(key, names.alias("names"), "header_row", F.posexplode("_rows").alias("row", "cells")).where((F.col("row") > F.col("header_row")) & F.exists("cells", lambda c: F.trim(c) != ""))
    return body.select(key, F.col("row").cast("long").alias("row"), F.posexplode("names").alias("at", "heading"), "cells").select(key, "row", "heading", F.get("cells", F.col("at")).alias("cell"))


def html_title(html: Column) -> Column:
    """The page's title, else its og:title, else its first h1, without tags, squashed; TITLE_CAP characters of it, null for none."""
    once = lambda pattern: F.regexp_extract(html, pattern, 1)
    stated = lambda x: F.nullif(F.trim(F.regexp_replace(_decoded(F.regexp_replace(x, "<[^>]*>", " ")), r"\s+", " ")), F.lit(""))
    name, content = r"""property\s*=\s*["']og:title["']""", r"""content\s*=\s*["']([^"']+)["']"""
    named = F.coalesce(F.nullif(once(rf"(?is)<meta\b[^>]*{name}[^>]*{content}"), F.lit("")), once(rf"(?is)<meta\b[^>]*{content}[^>]*{name}"))
    return F.substring(F.coalesce(stated(once(r"(?is)<title\b[^>]*>(.*?)</title>")), stated(named), stated(once(r"(?is)<h1\b[^>]*>(.*?)</h1>"))), 1, TITLE_CAP)


def html_text(html: Column) -> Column:
    """Readable text: comments, chrome and tags off, entities decoded, white space squashed."""
    return F.trim(F.regexp_replace(_decoded(F.regexp_replace(without_chrome(html), r"<[^>]*>", " ")), r"\s+", " "))


def without_chrome(html: Column) -> Column:
    """A page without its comments and the elements that are never content."""
    return F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), rf"(?is)<({'|'.join(CHROME)})\b[^>]*>.*?</\1>", " ")


def _decoded(text: Column) -> Column:
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_lines(html: Column, most: int = TEXT_CAP) -> Column:
    """Readable text whose lines are those of the page's blocks, each squashed, blank ones gone; ``most`` characters of it."""
    broken = F.regexp_replace(F.regexp_replace(without_chrome(html), r"\s+", " "), rf"(?i)<br\b[^>]*>|</?(?:{'|'.join(BLOCKS)})\b[^>]*>", "\n")
    lines = F.transform(F.split(_decoded(F.regexp_replace(broken, "<[^>]*>", " ")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.substring(F.array_join(F.filter(lines, lambda x: x != ""), "\n"), 1, most)


def _without_dots(path: Column) -> Column:
    """A path from the root in which single and double dots have taken effect."""
    parts = F.split(path, "/")
    dot, up = (lambda s: s.rlike(r"(?i)^(?:\.|%2e)$")), (lambda s: s.rlike(r"(?i)^(?:\.|%2e){2}$"))
    step = lambda held, s: F.when(up(s), F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(1)))).when(dot(s), held).otherwise(F.array_append(held, s))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    last = F.element_at(parts, -1)
    return let(kept, lambda k: F.concat(F.array_join(k, "/"), F.when(dot(last) | up(last) | (F.size(k) == 1), "/").otherwise("")))


def resolved(address: Column, page: Column) -> Column:
    """An address as it stands in a page, as an absolute one of the web; null for data, scripts, mail and places in the page.

    Entities are decoded, scheme and host are in lower case, dots in the path take effect and a space is %20; what is
    longer than ADDRESS_CAP is none. Letters beyond ASCII stay as they are.
    """
    origin, scheme = F.regexp_extract(page, "(?i)^(https?://[^/?#]+)", 1), F.regexp_extract(page, "(?i)^(https?):", 1)
    folder = F.regexp_extract(F.regexp_replace(page, "[?#].*$", ""), "(?i)^(https?://[^/]+(?:/.*/|/|$))", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))

    def absolute(at: Column) -> Column:
        return (
            F.when((at == "") | at.startswith("#") | (origin == ""), None)
            .when(at.rlike("(?i)^https?://"), at)
            .when(at.rlike("(?i)^[a-z][a-z0-9+.-]*:"), None)
            .when(at.startswith("//"), F.concat(scheme, F.lit(":"), at))
            .when(at.startswith("/"), F.concat(origin, at))
            .when(at.startswith("?"), F.concat(F.regexp_replace(page, "[?#].*$", ""), at))
            .otherwise(F.concat(folder, at))
        )

    def normal(x: Column) -> Column:
        part = lambda k: F.regexp_extract(x, r"(?is)^(https?://[^/?#]+)([^?#]*)(.*)$", k)
        path = let(F.coalesce(F.nullif(part(2), F.lit("")), F.lit("/")), _without_dots)
        return F.replace(F.concat(F.lower(part(1)), path, part(3)), F.lit(" "), F.lit("%20"))

    found = let(let(F.trim(_decoded(address)), absolute), normal)
    return F.when(F.length(found) <= ADDRESS_CAP, found)


def _images(fragment: Column, page: Column, most: int) -> Column:
    """The first different images of a fragment, as absolute addresses."""
    tags = F.regexp_extract_all(fragment, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))
    source = lambda x: F.nullif(F.regexp_extract(x, r"""(?is)\bsrc\s*=\s*["']([^"']+)["']""", 1), F.lit(""))
    return F.slice(F.array_distinct(F.filter(F.transform(tags, lambda x: resolved(source(x), page)), lambda x: x.isNotNull())), 1, most)


def html_images(pages: DataFrame, key: str, html: str, url: str, most: int = IMAGES) -> DataFrame:
    """key, place and image of the first ``most`` different images of each page, as absolute addresses; chrome has none."""
    return pages.select(key, F.posexplode(_images(without_chrome(F.col(html)), F.col(url), most)).alias("place", "image"))


def html_row_images(pages: DataFrame, key: str, html: str, url: str, most: int = IMAGES) -> DataFrame:
    """key, table, row, place and image: what stands in a row of a table, whose numbers are those of ``html_tables``, belongs to it."""
    taken = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = lambda table: F.filter(taken(table, r"(?is)<tr\b.*?</tr>"), lambda r: r.rlike(r"(?is)<(t[hd])\b[^>]*>.*?</\1>"))
    tables = F.filter(F.transform(taken(without_chrome(F.col(html)), r"(?is)<table\b.*?</table>"), rows), lambda t: F.size(t) > 1)
    each = pages.select(key, url, F.posexplode(tables).alias("table", "_rows")).select(key, url, "table", F.posexplode("_rows").alias("row", "_row"))
    return each.select(key, "table", "row", F.posexplode(_images(F.col("_row"), F.col(url), most)).alias("place", "image"))


def html_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table, row, col and value of the cells of a page's tables, in order from 0.

    Comments and chrome count for nothing, rows without cells aren't rows, and a table of fewer than two rows is layout.
    A table ends at the first end tag, so the cells of a table within a table belong to the outer one.
    """
    clean = without_chrome(F.col(html))
    taken = lambda text, pattern, group=0: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    cells = lambda row: F.transform(taken(row, r"(?is)<(t[hd])\b[^>]*>(.*?)</\1>", 2), html_text)
    rows = lambda table: F.filter(F.transform(taken(table, r"(?is)<tr\b.*?</tr>"), cells), lambda r: F.size(r) > 0)
    tables = F.filter(F.transform(taken(clean, r"(?is)<table\b.*?</table>"), rows), lambda t: F.size(t) > 1)
    each = pages.select(key, F.posexplode(tables).alias("table", "_rows")).select(key, "table", F.posexplode("_rows").alias("row", "_cells"))
    return each.select(key, "table", "row", F.posexplode("_cells").alias("col", "value"))


_ROW, _CELL, _TAG = re.compile(r"(?s)<tr[^>]*>(.*?)</tr>"), re.compile(r"(?s)<(td|th)\b([^>]*)>(.*?)</\1>"), re.compile("<[^>]*>")
_GUTTER, _SPAN = re.compile("row-header|column-header|freezebar|grid-sticky", re.I), re.compile(r'\b(col|row)span="(\d{1,4})"', re.I)
_HREF, _WEB = re.compile(r'<a\b[^>]*\bhref="([^"]+)"', re.I), re.compile("https?://", re.I)
# What a redirect has, and one that starts with the address in plain characters, which needs no parsing.
_URL, _REDIRECT = re.compile(r"/\s*u\s*r\s*l"), re.compile(r"""(?:(?i:https?)://[A-Za-z0-9.-]+)?/url\?q=([!"$%'-~]+)(?:[&#]|$)""")


def _spans(attributes: str) -> tuple[int, int]:
    """Columns and rows that a cell covers."""
    columns, rows = 1, 1
    for axis, n in reversed(_SPAN.findall(attributes)):
        if axis.lower() == "col":
            columns = min(max(int(n), 1), 1000)
        else:
            rows = min(max(int(n), 1), 1000)
    return columns, rows


def _link(body: str) -> str | None:
    """The web address of a cell's first link, taken out of a redirect that names it; what can't be parsed is no redirect."""
    found = _HREF.search(body)
    at = entities.unescape(found[1]) if found else ""
    if plain := _REDIRECT.match(at):
        at = unquote_to_bytes(plain[1].replace("+", " ")).decode("utf-8", "replace")
    elif _URL.search(at):
        try:
            to = urlsplit(at)
            at = parse_qs(to.query).get("q", [at])[0] if to.path == "/url" else at
        except ValueError:
            pass
    return at if _WEB.match(at) else None


def sheet_cells(page: str | None) -> list[tuple[int, int, str | None, str | None]]:
    """row, col, value and link of the first table of a published sheet; the gutters of row and column names are no cells.

    A cell that covers several columns has its value in the first of them, and one that covers several rows keeps its
    columns in the rows below, so that columns are those of the sheet. Cells without value and link go. Rows beyond
    SHEET_ROWS are not read; a sheet of more than SHEET_CELLS cells is refused as a whole, and has none.
    """
    page = page or ""
    start, end = page.find("<table"), page.find("</table>", page.find("<table"))
    table = "" if start < 0 else page[start:] if end < 0 else page[start:end]
    below: dict[int, int] = {}
    out, taken = [], 0
    for r, row in enumerate(m[1] for m in islice(_ROW.finditer(table), SHEET_ROWS)):
        col, held = 0, dict(below)
        below = {c: n - 1 for c, n in held.items() if n > 1}
        for tag, attributes, body in _CELL.findall(row):
            if tag == "th" and attributes and _GUTTER.search(attributes):
                continue
            while col in held:
                col += 1
            columns, rows = _spans(attributes) if attributes else (1, 1)
            taken += columns
            if taken > SHEET_CELLS:
                return []
            tagged = "<" in body
            value, link = " ".join(entities.unescape(_TAG.sub(" ", body) if tagged else body).split()) or None, _link(body) if tagged else None
            if value or link:
                out.append((r, col, value, link))
            if rows > 1:
                below |= {c: rows - 1 for c in range(col, col + columns)}
            col += columns
    return out


def published_sheet(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, row, col, value and link of every page's sheet. Spans carry from row to row, so Python reads each page."""
    ship(pages.sparkSession)

    @F.arrow_udf("array<struct<row:int,col:int,value:string,link:string>>")
    def read(texts: pa.Array) -> pa.Array:
        flat: list[tuple[int, int, str | None, str | None]] = []
        ends = [0]
        for text in texts.to_pylist():
            flat += sheet_cells(text)
            ends.append(len(flat))
        columns = zip(*flat) if flat else [()] * 4
        made = [pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.string()))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(made, ["row", "col", "value", "link"]))

    return pages.select(key, F.explode(read(html)).alias("_c")).select(key, "_c.*")


def html_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, place and href of every link of a page."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit('href="([^"]*)"'), F.lit(1))).alias("place", "href"))


def grid_cells(grids: DataFrame, key: str, json: str) -> DataFrame:
    """key, sheet, row, col, value and link of a JSON cell grid; ranges lie at their own offsets, empty cells go."""
    cell = "struct<formattedValue:string,hyperlink:string>"
    shape = f"struct<sheets:array<struct<properties:struct<title:string>,data:array<struct<startRow:int,startColumn:int,rowData:array<struct<values:array<{cell}>>>>>>>>"
    sheets = grids.select(key, F.explode(F.from_json(json, shape)["sheets"]).alias("s")).select(key, F.trim("s.properties.title").alias("sheet"), F.explode("s.data").alias("d"))
    rows = sheets.select(key, "sheet", F.coalesce("d.startRow", F.lit(0)).alias("r0"), F.coalesce("d.startColumn", F.lit(0)).alias("c0"), F.posexplode("d.rowData").alias("r", "row"))
    each = rows.select(key, "sheet", (F.col("r0") + F.col("r")).alias("row"), "c0", F.posexplode("row.values").alias("c", "cell"))
    link = F.when(F.col("cell.hyperlink").rlike("(?i)^https?://"), F.col("cell.hyperlink"))
    return each.select(key, "sheet", "row", (F.col("c0") + F.col("c")).alias("col"), F.col("cell.formattedValue").alias("value"), link.alias("link")).where("value IS NOT NULL OR link IS NOT NULL")


def record_table(maps: DataFrame, key: str, json: str) -> DataFrame:
    """key, row_id, column and value of a record map: blocks by id, whose properties are named by the collection's schema.

    Only live blocks that the view lists are rows; properties that the schema doesn't name go.
    """
    shape = "struct<schema:map<string,struct<name:string>>,view:array<string>,blocks:map<string,struct<alive:boolean,properties:map<string,string>>>>"
    held = maps.select(key, F.from_json(json, shape).alias("m"))
    rows = held.select(key, "m", F.explode("m.view").alias("row_id")).select(key, "row_id", F.col("m.schema").alias("schema"), F.col("m.blocks")[F.col("row_id")].alias("block")).where(F.coalesce("block.alive", F.lit(False)))
    each = rows.select(key, "row_id", "schema", F.explode("block.properties").alias("id", "value"))
    return each.select(key, "row_id", F.col("schema")[F.col("id")]["name"].alias("column"), "value").where("column IS NOT NULL")


def first_by_hash(sources: DataFrame, owner: str, content: str, order: str) -> DataFrame:
    """sources without those whose content the same owner has given before."""
    w = Window.partitionBy(owner, F.sha2(content, 256)).orderBy(order)
    return sources.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")
