"""Nulls in every column, empty tables, repeated rows, ties, long texts, and extra columns with clashing names."""

import hashlib
import math

import brute
import corpus_pipeline as pipeline
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from quillstone.llm import components, gam, licenses, mixing, packing, pii, repeats, rules, secrets, simhash, spotsigs
from quillstone.llm.common import cut

#: Names that the operators use inside.
CLASHES = (
    "n_words kept whole gone twin starts wide more anchor place first found n words lines rule base_failed bad prune print least root component_id "
    "fingerprint sigs edited next_sigs next_doc own before n_head range ahead row rate copy mix_key copies label score value before after spans base terms entity term all held "
    "start high low shard same size length offset sequence_id blocks met containment _pieces _matches _found _row _text _doc _twin"
).split()
LABELS = "doc_id long, quality int"


def everything(spark, docs, labels):
    """Every operator applied to docs: name -> (result, a row for each row of docs)."""
    model, listed = gam.learn(docs, labels), rules.learn(docs, labels)
    return {
        "repeats": (repeats.remove_repeats(docs), True),
        "rules": (rules.judge(docs, listed), True),
        "secrets": (secrets.findings(docs), True),
        "packing": (packing.pack(docs), False),
        "licenses": (licenses.scan(docs), True),
        "fingerprints": (spotsigs.report(docs), True),
        "simhash": (simhash.near_duplicates(docs), True),
        "pii": (pii.report(docs), True),
        "sanitised": (pii.sanitise(docs), True),
        "quality": (gam.score(docs, model), True),
        "mixing": (mixing.mix(docs), False),
    }


@pytest.fixture(scope="module")
def awkward(spark):
    """Null ids, texts and sources, repeated rows, one id with two texts, a very long text, and columns named as inside."""
    text = " ".join(f"word{i % 50} mail{i}@x.org" for i in range(60))
    rows = [(1, text, "a"), (1, text, "a"), (2, text, None), (None, text, "a"), (None, None, None), (3, None, "b"), (4, "", "b"), (5, "word " * 150_000, "c"), (6, "first text of six", "c"), (6, "second text of six", "c"), (7, "x" * 400_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES})


def test_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None), (6, 0), (99, 1)], LABELS)
    total = awkward.count()
    for name, (df, same) in everything(spark, awkward, labels).items():
        rows = [str(r) for r in df.collect()]
        assert len(rows) == total if same else rows, name
        twins = [r for r in rows if "doc_id=1," in r]
        assert not same or len(twins) == 2 and len(set(twins)) == 1, name


def test_components_of_awkward_rows(spark, awkward):
    found = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(awkward).collect()]
    assert {c for d, c in found if d in (1, 2)} == {1} and (3, 3) in found and (4, 3) in found and (None, 1) in found and (None, 3) in found


def test_empty_tables(spark, awkward):
    none, labels = awkward.where("false"), spark.createDataFrame([], LABELS)
    for name, (df, _) in everything(spark, none, labels).items():
        assert df.count() == 0, name
    for name, (df, _) in everything(spark, awkward.select("doc_id", "text", "source").where("doc_id = 4"), labels).items():
        assert df.count() <= 1, name


@pytest.mark.parametrize("step", range(len(pipeline.STAGES)))
def test_stages(spark, awkward, step):
    """Every stage on awkward rows and on none: all but the last keep the columns, names and types of what they are given."""
    name, stage = pipeline.STAGES[step]
    for docs in (awkward, awkward.where("false")):
        out = stage(spark, docs, DATA)
        if step < len(pipeline.STAGES) - 1:
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema], name
            clash = out.select("twin").distinct().collect()
            assert clash in ([], [("clash twin",)])
        out.count()


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = pipeline.quality(spark, docs, DATA)
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    clean = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in clean) >= 0.95 * len(clean) and len(kept) < docs.count()
    one = pipeline.near_duplicates(spark, docs, DATA)
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in one.select("doc_id").collect()) == sorted(set(groups.values()))
    tokens = pipeline.run(spark, DATA).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert tokens.agg(F.max("n")).first()[0] <= 2048


def test_pipeline_by_brute_force(spark):
    """Every stage recomputed from what the one before kept: who stays, what each text becomes, how many copies there are."""
    from pyspark.ml.linalg import Vectors

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = gam.learn(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    good = {d: r.text for d, r in rows.items() if brute.gam_score(brute.gam_features(r.text), model) >= 0.5}
    groups = brute.grouped({d: brute.fingerprint(t) for d, t in good.items()})
    one = {d: t for d, t in good.items() if groups[d] == d}
    assert len(one) < len(good) < len(rows)

    forest = secrets.train(secrets.labelled_findings(spark))
    clean = {}
    for d, text in one.items():
        out, last = "", 0
        for a, z, value, before, after in brute.candidates(text or "", secrets.CANDIDATE, secrets.ASSIGNED):
            x = Vectors.dense(brute.secret_features(value, before, after, rows[d].source or "", secrets.KEYWORDS, secrets.DICTIONARY))
            if value.startswith("-----BEGIN") or sum(t.predict(x) for t in forest.trees) >= len(forest.trees) / 2:
                out, last = out + (text or "")[last:a] + secrets.REPLACEMENT, z
        clean[d] = out + (text or "")[last:]

    kept = docs
    for (_, stage), wanted in zip(pipeline.STAGES[:3], (good, one, clean)):
        kept = cut(stage(spark, kept, DATA), "test-stage")
        assert {r.doc_id: r.text or "" for r in kept.collect()} == {d: t or "" for d, t in wanted.items()}

    mass = {}
    for d, t in clean.items():
        mass[rows[d].source] = mass.get(rows[d].source, 0) + len(t)
    copies = {}
    for d in clean:
        rate = sum(mass.values()) / sum(m > 0 for m in mass.values()) / mass[rows[d].source]
        u = int(hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        below = p
        while u >= below:
            k += 1
            p *= rate / k
            below += p
        copies[d] = k
    tokens = {r.doc_id: (r.n, r.d) for r in pipeline.run(spark, DATA).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()}
    assert {d: n // t for d, (n, t) in tokens.items()} == {d: k for d, k in copies.items() if k} and all(n % t == 0 for n, t in tokens.values())


def test_components(spark):
    """A long chain, a star, a dense group, loops, nulls and repeated edges."""
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(a, b) for a in range(20) for b in range(20)] + [(None, 3), (700, 700), (900, 800), (800, 900)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 560)} | {i: 0 for i in range(20)} | {800: 800, 900: 800}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_terms_of_repeated_rows(spark):
    """Rows that are there many times are one document: the same terms, and they aren't none."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    spans = lambda df: {tuple(r) for r in pii.report(df).select("doc_id", "spans").collect()}
    once = spans(docs)
    assert any("term:" in s for _, s in once)
    assert spans(docs.join(spark.range(3).select(F.col("id").alias("again")))) == once
    assert spans(docs.unionByName(docs.where("doc_id % 3 = 0"))) == once
