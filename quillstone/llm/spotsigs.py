"""Document fingerprints by SpotSigs: chains of content words after common-word anchors, compared by pruned Jaccard."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.exprs import let
from quillstone.llm.common import cut

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Content words in a chain, and how many words after the anchor they are looked for in.
CHAIN, REACH = 2, 8
SIMILAR = 0.8

# The anchors, common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be but by can for from had has have he her his i if in into is it its no not of on or our she so than that the their then there "
    "these they this to was we were which who will with would you your "
    "au aux avec ce ces dans des du elle en est et il la le les leur ne nous on ou par pas pour que qui sa se ses son sur un une vous "
    "als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer es für haben hat ich ihr im ist mit nach nicht noch oder "
    "sich sie sind so um und von vor war werden wie wir zu zum zur über "
    "al como con cuando de del desde el ella en entre era es esta este ha hay las lo los más me mi muy no nos o para pero por se ser si sin sobre su sus "
    "también todo un una y ya"
).split()


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BREAK), "")


def signatures(text: Column) -> Column:
    """The sorted distinct signatures (int) of a text.

    A signature hashes an anchor with the CHAIN content words that follow it, or with the next two words where it has no
    such chain. Stretches farther than REACH words behind an anchor, such as tables, have the hashes of their word triples.
    Each depends on near words only, so an edit leaves the signatures elsewhere as they are. A text too short for any of
    these has the hash of all its words, or of its triples, and one without words none.
    """
    stop = lambda w: w.isin(ANCHORS)
    triple = lambda words, i: F.hash(F.slice(words, i + 1, 3))

    def chains(words: Column, places: Column) -> Column:
        chain = lambda i: F.slice(F.filter(F.slice(words, i + 2, REACH), lambda w: ~stop(w)), 1, CHAIN)
        bare = lambda i: F.when(i + 3 <= F.size(words), triple(words, i))
        hashes = F.transform(places, lambda i: let(chain(i), lambda c: F.when(F.size(c) == CHAIN, F.hash(words[i], *[c[k] for k in range(CHAIN)])).otherwise(bare(i))))
        return F.filter(hashes, lambda h: h.isNotNull())

    def stretches(words: Column, places: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(places, lambda i: i + REACH + 1))
        ends = F.concat(places, F.array(F.size(words)))
        wide = F.filter(F.arrays_zip(begins.alias("begin"), ends.alias("end")), lambda g: g["end"] - g["begin"] >= 3)
        return F.flatten(F.transform(wide, lambda g: F.transform(F.sequence(g["begin"], g["end"] - 3), lambda i: triple(words, i))))

    def plain(words: Column) -> Column:
        triples = lambda: F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: triple(words, i))
        return F.when(F.size(words) >= 3, triples()).when(F.size(words) > 0, F.array(F.hash(words))).otherwise(F.array().cast("array<int>"))

    def signed(words: Column) -> Column:
        places = F.filter(F.transform(words, lambda w, i: F.when(stop(w), i)), lambda i: i.isNotNull())
        near = let(places, lambda p: F.concat(chains(words, p), stretches(words, p)))
        return let(near, lambda x: F.sort_array(F.array_distinct(F.when(F.size(x) > 0, x).otherwise(plain(words)))))

    return let(_words(text), signed)


def fingerprint(sigs: Column) -> Column:
    """The signatures as one string of eight hexadecimal digits each."""
    return F.lower(F.array_join(F.transform(sigs, lambda s: F.lpad(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without a look at them where their lengths alone keep it under ``least``."""
    both = F.size(F.array_intersect(a, b))
    bound = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b), F.lit(1))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((bound < least) | (bound == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.hash(text).alias("twin"), text.alias("text"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def successors(keyed: DataFrame) -> DataFrame:
    """doc_id, twin, n_chars, next_doc, next_twin: the next distinct key in ascending order, after the last the first.

    Keys are dealt out by ranges; a window looks ahead within each range, and one row for each range joins their ends.
    """
    keys = keyed.select("doc_id", "twin", F.length("text").alias("n_chars")).distinct()
    ranged = cut(keys.repartitionByRange("doc_id", "twin").withColumn("range", F.spark_partition_id()), "spots-ranges")
    key = F.struct("doc_id", "twin")
    heads = ranged.groupBy("range").agg(F.min(key).alias("head"))
    # One row for each range, not for each document, goes to this window.
    ends = heads.select("range", F.coalesce(F.lead("head").over(Window.orderBy("range")), F.first("head").over(Window.orderBy("range"))).alias("after"))
    ahead = F.lead(key).over(Window.partitionBy("range").orderBy("doc_id", "twin"))
    linked = ranged.withColumn("ahead", ahead).join(F.broadcast(ends), "range").withColumn("next", F.coalesce("ahead", "after"))
    return linked.select("doc_id", "twin", "n_chars", F.col("next.doc_id").alias("next_doc"), F.col("next.twin").alias("next_twin"))


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, text, sigs, edited, edited_sigs, next_doc and next_sigs: each text, and with its last quarter from the next document.

    Of n code points the last floor(n / 4) are replaced by the first as many (or all) of the next document by doc_id,
    for the last one of the first. Null texts read as empty; a null doc_id comes first; rows that share a doc_id are
    ordered by a hash of the text, and repeated rows come out alike.

    Each text is signed once and dealt out once, by a hash of its id beside one of itself; what goes on to the document
    before it is its head and its signatures.
    """
    keyed = _keyed(docs)
    links = successors(keyed).select(
        F.xxhash64("next_doc", "next_twin").alias("own"), F.col("next_twin").alias("twin"), F.xxhash64("doc_id", "twin").alias("before"), F.col("twin").alias("twin_before"), (F.floor(F.col("n_chars") / 4)).cast("int").alias("n_head")
    )
    dealt = keyed.select(F.xxhash64("doc_id", "twin").alias("own"), "twin", "doc_id", "text", signatures(F.col("text")).alias("sigs")).repartition("own", "twin")
    head = F.substring(F.col("text"), F.lit(1), F.col("n_head"))
    # Repeated rows of the next document bring the same head; one of them is enough.
    heads = dealt.join(links, ["own", "twin"]).select("before", "twin_before", head.alias("head"), F.col("doc_id").alias("next_doc"), F.col("sigs").alias("next_sigs")).dropDuplicates(["before", "twin_before"])
    joined = dealt.join(heads.withColumnsRenamed({"before": "own", "twin_before": "twin"}), ["own", "twin"])
    n = F.length("text")
    changed = F.concat(F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 4)).cast("int")), F.col("head"))
    return joined.select("doc_id", "text", changed.alias("edited"), "sigs", "next_doc", "next_sigs").select("*", signatures(F.col("edited")).alias("edited_sigs"))


def report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row's text and edited text, and their likeness: to each other, and to the next document's, next_doc."""
    e = edited(docs)
    return e.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        "next_doc",
    )


def similar(docs: DataFrame, least: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs): doc_id and class of every row, and a, b, score of the classes of Jaccard ``least`` or more.

    A class holds the rows of equal signature sets. Sets are partitioned by length so that similar ones lie in the same
    or the next partition; within it they meet under one of their rarest signatures, as many as a similar set can't
    miss all of, and the lengths prune a pair before the sets are compared.
    """
    signed = cut(_keyed(docs).select("doc_id", signatures(F.col("text")).alias("sigs")), "spots-signed")
    named = signed.select("doc_id", "sigs", F.sha2(F.array_join(F.transform("sigs", lambda s: s.cast("string")), ","), 256).alias("class"))
    classes = named.select("doc_id", "class")
    sets = cut(named.dropDuplicates(["class"]).select("class", "sigs", F.size("sigs").alias("n")).where("n > 0"), "spots-classes")
    frequency = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("held"))
    ranked = sets.select("class", "n", F.explode("sigs").alias("sig")).join(frequency, "sig").groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("held", "sig"))).alias("ranked"))
    prefix = F.slice("ranked", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-log(least)) if least < 1 else F.col("n").cast("double"))
    keyed = cut(ranked.select("class", "n", part.alias("part"), F.transform("ranked", lambda r: r["sig"]).alias("sigs"), F.explode(prefix).alias("p")).select("class", "n", "part", "sigs", "p.sig"), "spots-prefixes")
    x = keyed.select("class", "n", "sigs", "sig", F.explode(F.array(F.col("part"), F.col("part") + 1, F.col("part") - 1)).alias("part")).alias("x")
    y = keyed.alias("y")
    met = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.class") < F.col("y.class"))
    lengths = (F.least("x.n", "y.n") >= F.lit(least) * F.greatest("x.n", "y.n") - 1e-9)
    found = x.join(y, met & lengths & (jaccard(F.col("x.sigs"), F.col("y.sigs"), least) >= least - 1e-12))
    pairs = found.select(F.col("x.class").alias("a"), F.col("y.class").alias("b"), jaccard(F.col("x.sigs"), F.col("y.sigs")).alias("score")).distinct()
    return classes, pairs
