"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import cut

SEED = 20240229
#: As many sources at most have their rates sent to every task; more are joined by a shuffle of ids and sources.
BROADCAST_SOURCES = 50_000
#: A rate above this is drawn as a sum of equal parts, so that exp(-rate) keeps its precision.
PART = 256.0
#: Tasks over which the rows of one key are dealt.
SPREAD = 64


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that is fixed by the seed and the keys: 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson(rate: Column, seed: int, *keys: Column) -> Column:
    """The smallest k whose Poisson distribution function exceeds a hash-seeded uniform number."""

    def drawn(mean: Column, u: Column) -> Column:
        most = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
        begin = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("below"), F.lit(0).alias("k"))

        def step(a: Column, i: Column) -> Column:
            p = a["p"] * mean / i
            return F.when(u >= a["below"], F.struct(p.alias("p"), (a["below"] + p).alias("below"), i.alias("k"))).otherwise(a)

        return F.aggregate(F.sequence(F.lit(1), most), begin, step, lambda a: a["k"])

    parts = F.greatest(F.ceil(rate / PART), F.lit(1)).cast("int")
    several = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda s, j: s + drawn(rate / parts, uniform(seed, *keys, j)))
    return F.when(rate <= 0, F.lit(0)).when(rate <= PART, drawn(rate, uniform(seed, *keys))).otherwise(several)


def rates(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0) -> DataFrame:
    """source and rate: the mean number of copies with which each source's characters come to its share of the weights.

    The whole mixture has ``epochs`` times the characters of docs. Without weights all sources weigh the same; sources
    without a weight, or with a null or negative one, get none. A null source is a source of its own, and a source
    without characters has rate 0.
    """
    mass = docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("mass"))
    if weights is None:
        held = mass.withColumn("weight", F.lit(1.0))
    else:
        given = weights.groupBy(F.col("source").alias("_source")).agg(F.sum(F.greatest(F.col("weight").cast("double"), F.lit(0.0))).alias("weight"))
        held = mass.join(given, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "mass", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    held = cut(held.withColumn("weight", F.when(F.col("mass") > 0, F.col("weight")).otherwise(0.0)), "mixing-masses")
    whole = held.agg(F.sum("mass").alias("mass"), F.sum("weight").alias("weight")).first()
    if not whole.weight:
        return held.select("source", F.lit(0.0).alias("rate"))
    rate = F.lit(epochs) * F.col("weight") / F.lit(whole.weight) * F.lit(whole.mass) / F.col("mass")
    return held.select("source", F.when(F.col("weight") > 0, rate).otherwise(0.0).alias("rate"))


def _copies(docs: DataFrame, weights: DataFrame | None, epochs: float, seed: int) -> DataFrame:
    """row (a struct of the columns of docs), copy and mix_key: a row for each copy, dealt out and sorted by mix_key."""
    found = rates(docs, weights, epochs)
    if found.count() <= BROADCAST_SOURCES:
        found = F.broadcast(found)
    rated = docs.select(F.struct("*").alias("row")).join(found, F.col("row.source").eqNullSafe(F.col("source")))
    # A row without an id is known by its text.
    own = rated.select("row", "rate", F.coalesce(F.col("row.doc_id").cast("string"), F.md5(F.coalesce("row.text", F.lit("")))).alias("own"), F.spark_partition_id().alias("part"))
    copies = own.select("row", "own", "part", poisson(F.col("rate"), seed, F.col("own")).alias("copies")).where("copies > 0")
    spread = copies.select("row", "own", "part", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    keyed = spread.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), "own", F.col("copy").cast("string"))))
    # Repeated rows share a key; those that other tasks read go elsewhere, so that no task gets them all.
    return keyed.repartition("mix_key", F.col("part") % SPREAD).sortWithinPartitions("mix_key").select("row", "copy", "mix_key")


def mix(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """The columns of docs with copy (from 1) and mix_key, a row for each copy, in the random order of mix_key.

    A row's number of copies is fixed by seed and doc_id alone, or without an id by its text, so a lost task draws it
    again; repeated rows draw alike, and lie in as many as SPREAD tasks for each copy. Columns of docs named copy or mix_key give way. An empty table, or one
    without characters, gives no rows.
    """
    return _copies(docs, weights, epochs, seed).select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("copy", "mix_key")], "copy", "mix_key")


def remix(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """mix with the columns of docs and no others."""
    return _copies(docs, weights, epochs, seed).select("row.*")
