"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import gam, licenses, merkle, mixing, packing, phrases, pii, repeats, rules, secrets, simhash, spotsigs, tokens
from quillstone.llm.oracles import ORACLES
from quillstone.sources.tables import table

__all__ = ["ORACLES", "QUERIES"]


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without passages of 20 words or more that start earlier in the corpus too."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the verdict of a decision list learned from the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.learn(docs, table(spark, sf_dir, "labels")))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts, spans and the hash of the redacted text."""
    found = secrets.findings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_candidates", "n_secrets", "secrets", F.sha2("redacted", 256).alias("redacted_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases of every document, and the templates that its text blocks meet."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return spotsigs.report(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, with the terms that reveal it."""
    return pii.report(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed so that every source has the same share of characters."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of each language of all documents."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's token ids, read back from the files they were written to."""
    return tokens.report(table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and check of every document under the corpus's root; half the documents are tampered with."""
    return merkle.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeats": op1_repeats,
    "op2_rules": op2_rules,
    "op3_secret_scans": op3_secret_scans,
    "op4_packing": op4_packing,
    "op5_licenses": op5_licenses,
    "op6_fingerprints": op6_fingerprints,
    "op7_simhash": op7_simhash,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "op11_phrases": op11_phrases,
    "op12_tokens": op12_tokens,
    "op13_manifest": op13_manifest,
}
