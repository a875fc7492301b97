"""What kind of file a source is: by its first bytes, by what its server declares, and by its name, in this order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.exprs import let

# The extensions of each kind, and the kinds that a declared type stands for.
EXTENSIONS = {
    "delimited": "csv tsv txt",
    "spreadsheet": "xlsx xlsm xls",
    "word": "docx doc",
    "pdf": "pdf",
    "image": "jpg jpeg png webp gif",
    "opendocument": "ods odt",
    "presentation": "pptx",
    "richtext": "rtf",
    "markup": "html htm",
    "structured": "json xml",
}
DECLARED = {
    "text/html": "markup",
    "application/xhtml+xml": "markup",
    "text/csv": "delimited",
    "application/csv": "delimited",
    "text/tab-separated-values": "delimited",
    "application/json": "structured",
    "text/json": "structured",
    "application/xml": "structured",
    "text/xml": "structured",
    "application/rtf": "richtext",
    "text/rtf": "richtext",
}
# The bytes, in hexadecimal, that files of a kind begin with.
SIGNATURES = {
    "25504446": "pdf",
    "89504E47": "image",
    "FFD8FF": "image",
    "47494638": "image",
    "49492A00": "tiff",
    "4D4D002A": "tiff",
    "4D5A": "program",
    "7F454C46": "program",
    "2321": "program",
    "504B0304": "archive",
    "D0CF11E0": "office",
    "7B5C727466": "richtext",
}


def extension(name: Column) -> Column:
    """The extension of a name or of the path of an address, lower-case; empty for none."""
    return F.lower(F.regexp_extract(F.regexp_replace(name, "[?#].*$", ""), r"[^/]\.([A-Za-z0-9]{1,8})$", 1))


def _mapped(value: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[value]


def signature(head: Column) -> Column:
    """What the first bytes tell: a kind, or tiff, program, archive or office; null for text and the unknown."""
    digits = F.hex(head)
    webp = F.when(digits.startswith("52494646") & (F.substring(digits, 17, 8) == "57454250"), "image")
    return F.coalesce(*(F.when(digits.startswith(k), kind) for k, kind in SIGNATURES.items()), webp)


def classify(name: Column, head: Column, declared: Column) -> Column:
    """The kind of a file, or unsupported: programs and TIFF are refused whatever their names say.

    Archives and old office files are told apart by their extension alone; text is what the server declares, else what
    its extension says; bytes that tell nothing leave it to the extension.
    """
    by_name = {e: kind for kind, names in EXTENSIONS.items() for e in names.split()}
    claimed = F.lower(F.trim(F.element_at(F.split(F.coalesce(declared, F.lit("")), ";"), 1)))

    def judged(found: Column, named: Column) -> Column:
        inside = lambda *kinds: F.when(named.isin(*kinds), named).otherwise("unsupported")
        return (
            F.when(found.isin("program", "tiff"), "unsupported")
            .when(found == "archive", inside("opendocument", "presentation", "spreadsheet", "word"))
            .when(found == "office", inside("spreadsheet", "word"))
            .when(found.isNotNull(), found)
            .otherwise(F.coalesce(_mapped(claimed, DECLARED), named, F.lit("unsupported")))
        )

    return let(signature(head), lambda found: let(_mapped(extension(name), by_name), lambda named: judged(found, named)))
