"""Personal data: exact patterns, and terms that reveal the protected values by corpus co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.exprs import let
from quillstone.llm.common import Frames
from quillstone.llm.spans import find

KINDS = ("email", "ip", "card", "phone")
# The atomic form of each pattern: a start inside a run that failed can't match, and what is taken is never given back,
# so long runs cost linear time and no stack. A run of digits too short for a card isn't matched at all, as it would fail.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = "term"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of the corpus-wide rate that are added to those with a term, so that few documents are weak evidence.
SMOOTHING = 1.0
#: The share of a value's information content from which a term is held to reveal it.
DISCLOSURE = 0.8


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def one(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), one), F.lit(0), lambda a, d: a + d) % 10 == 0


def _small(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return F.when(F.length(plain) <= 3, plain.cast("int") <= 255).otherwise(False)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _small)
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.lower(value) if kind in ("email", "ip") else _digits(value))


def protected(docs: DataFrame) -> DataFrame:
    """doc_id, twin (a hash of the text), text (null where nothing is found) and found: the valid matches of all kinds by start.

    Null texts read as empty and have none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.select("doc_id", F.xxhash64(text).alias("twin"), text.alias("text"))

    def of(kind: str) -> Column:
        guard = F.contains(F.col("text"), F.lit(NEEDS[kind])) if NEEDS[kind] else None
        valid = F.filter(find(F.col("text"), PATTERNS[kind], guard), lambda s: _valid(kind, s["value"]))
        number, name = F.lit(KINDS.index(kind)).alias("number"), F.lit(kind).alias("kind")
        return F.transform(valid, lambda s: F.struct(s["start"].alias("start"), number, name, s["end"].alias("end"), _entity(kind, s["value"]).alias("entity"))).alias(kind)

    found = held.select("doc_id", "twin", "text", *map(of, KINDS)).select("doc_id", "twin", "text", F.sort_array(F.concat(*KINDS)).alias("found"))
    return found.select("doc_id", "twin", F.when(F.size("found") > 0, F.col("text")).alias("text"), "found")


def _terms(found: DataFrame) -> DataFrame:
    """One row for each word of each text with a protected value: doc_id, twin, term, start, end. Repeated rows count once."""
    texts = found.where(F.size("found") > 0).select("doc_id", "twin", "text").dropDuplicates(["doc_id", "twin"])
    words = F.transform(find(F.col("text"), WORD), lambda s: F.struct(F.lower(s["value"]).alias("term"), s["start"].alias("start"), s["end"].alias("end")))
    return texts.select("doc_id", "twin", F.explode(words).alias("w")).select("doc_id", "twin", "w.*").where(F.length("term") >= 3)


def _holders(found: DataFrame) -> DataFrame:
    """doc_id, twin, set and holders: each document beside the sets of entities it holds, and how many documents hold a set.

    Entities that the same documents hold are revealed by the same terms, so each set of documents is judged once however
    many entities it has.
    """
    each = found.select("doc_id", "twin", F.explode("found.entity").alias("entity")).distinct()
    key = F.xxhash64("doc_id", "twin"), F.xxhash64(F.lit("set"), "doc_id", "twin")
    name = F.concat_ws(":", F.count("*").cast("string"), *(F.bit_xor(k).cast("string") for k in key))
    named = each.groupBy("entity").agg(name.alias("set"), F.count("*").alias("holders"))
    return each.join(named, "entity").select("doc_id", "twin", "set", "holders").distinct()


def _frequencies(docs: DataFrame, found: DataFrame, terms: DataFrame, frames: Frames) -> DataFrame:
    """term and df: in how many documents each of the terms occurs; repeated rows are one document.

    Rows that are there m times count an m-th each, in whole numbers: their words are counted by m and divided by it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.select("doc_id", F.xxhash64(text).alias("twin"), text.alias("text"))
    copies = frames.cut(found.groupBy("doc_id", "twin").agg(F.count("*").alias("m")).where("m > 1"), "pii-copies")
    if copies.limit(1).count():
        named = copies.withColumnsRenamed({"doc_id": "_doc", "twin": "_twin"})
        held = held.join(named, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("twin") == F.col("_twin")), "left")
    else:
        held = held.withColumn("m", F.lit(1))
    each = F.array_distinct(F.transform(F.array_distinct(F.split("text", BREAK)), lambda w: F.lower(w)))
    words = held.select(F.coalesce("m", F.lit(1)).alias("m"), F.explode(each).alias("term"))
    by_m = words.groupBy("term", "m").agg(F.count("*").alias("n"))
    return by_m.groupBy("term").agg(F.sum(F.expr("n div m")).alias("df")).join(terms, "term", "left_semi")


def disclosures(docs: DataFrame, found: DataFrame, terms: DataFrame, frames: Frames, least: float = DISCLOSURE) -> DataFrame:
    """doc_id, twin and term: the terms of each document that reveal at least ``least`` of the content of an entity in it.

    With N documents, n of them with the entity, df with the term and both of them with the two, anywhere in the text, the
    term gives PMI = log2(p * N / n) of the entity's IC = log2(N / n) bits. Here p, the chance of the entity given the term,
    is (both + SMOOTHING * n / N) / (df + SMOOTHING), so values of one or two documents are judged too. An entity in
    every document has nothing to reveal.
    """
    rows = F.lit(float(found.select("doc_id", "twin").distinct().count()))
    rate = F.col("holders") / rows
    pmi = lambda both: F.log2((both + SMOOTHING * rate) / (F.greatest(F.col("df"), both) + SMOOTHING) / rate)
    reveals = lambda both: (rate < 1) & (pmi(both) >= F.lit(least) * -F.log2(rate))
    held = frames.cut(_holders(found), "pii-holders")
    seen = terms.select("doc_id", "twin", "term").distinct()
    df = frames.cut(_frequencies(docs, found, frames.cut(seen.select("term").distinct(), "pii-terms"), frames), "pii-frequencies")
    # A term too common even if every holder had it is left out before it meets the entities of its documents.
    rare = seen.join(df, "term").withColumnsRenamed({"doc_id": "_doc", "twin": "_twin"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("twin") == F.col("_twin"))
    met = held.join(rare, same & reveals(F.least("holders", "df"))).select("doc_id", "twin", "set", "holders", "term", "df")
    met = frames.cut(met, "pii-pairs")
    both = met.groupBy("set", "holders", "term", "df").agg(F.count("*").alias("both"))
    revealing = both.where(reveals(F.col("both"))).select("set", "term")
    return met.join(revealing, ["set", "term"], "left_semi").select("doc_id", "twin", "term").distinct()


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, twin, base and all: the base spans, and those with the spans of revealing terms, each by start.

    A span is start, number (of its kind), kind and end, in code points. Terms are looked for in the whole text of every
    document that holds the value they reveal, and never overlap a base span. Empty tables give no rows; repeated rows
    come out alike.
    """
    frames = Frames()
    found = frames.cut(protected(docs), "pii-found")
    terms = frames.cut(_terms(found), "pii-words")
    revealing = frames.cut(disclosures(docs, found, terms, frames), "pii-disclosures").withColumnsRenamed({"doc_id": "_doc", "twin": "_twin", "term": "_term"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("twin") == F.col("_twin"))
    spans = terms.join(revealing, same & (F.col("term") == F.col("_term")), "left_semi").groupBy("doc_id", "twin").agg(
        F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("number"), F.lit(TERM).alias("kind"), "end")).alias("terms")
    )
    spans = spans.withColumnsRenamed({"doc_id": "_doc", "twin": "_twin"})
    joined = found.drop("text").join(spans, same, "left")
    base = F.transform("found", lambda s: F.struct(*(s[c].alias(c) for c in ("start", "number", "kind", "end"))))
    kept = joined.select("doc_id", "twin", base.alias("base"), F.coalesce("terms", F.filter(base, lambda s: F.lit(False))).alias("terms"))
    apart = F.filter("terms", lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    return frames.result(kept.select("doc_id", "twin", "base", F.sort_array(F.concat("base", apart)).alias("all")), "pii-spans")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with every protected value replaced by its kind, and every revealing term generalised to [TERM].

    Of overlapping spans the first one, and of those the longest, is replaced. Null texts stay null.
    """
    spans = detect(docs).select("doc_id", "twin", "all").dropDuplicates(["doc_id", "twin"])
    held = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("body"))
    joined = held.join(spans, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("body") == F.col("twin")), "left")
    ordered = F.sort_array(F.transform("all", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        kept = F.concat(a["out"], F.substring(F.col("body"), a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= a["at"], F.struct(kept.alias("out"), (-s["back"]).alias("at"))).otherwise(a)

    text = F.aggregate(ordered, begin, step, lambda a: F.concat(a["out"], F.substring(F.col("body"), a["at"] + 1, F.length("body"))))
    clean = F.when(F.size("all") > 0, text).otherwise(F.col("row.text"))
    return joined.select(*[clean.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def counts(kind: str) -> Column:
    """How many base spans are of a kind."""
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of each kind, the hash of the base spans, and all spans, for every row."""
    return detect(docs).select("doc_id", *map(counts, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))
