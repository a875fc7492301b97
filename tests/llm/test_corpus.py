"""Phrase collocations, token stores and Merkle manifests against brute force, and on awkward rows."""

import glob
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import merkle, phrases, tokens
from quillstone.llm.common import cut, new_path

ROWS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null ids, texts, languages and sources, empty and long texts, repeated rows, one id with two texts.
ODD = [
    (1, "One two. one TWO\none two", "en", "a", 5), (1, "One two. one TWO\none two", "en", "a", 5), (1, "other text of one", "en", "a", 5), (None, "one two", None, None, None), (None, None, None, None, None),
    (2, None, "en", "b", 1), (3, "", "en", "b", 0), (4, "one\ttwo  one two;one,two", "und", "", 9), (5, "a\nb\n" * 3, "de", "ä", 7), (6, "\n", "de", "Z", 1), (7, "x <|endoftext|> y <|ENDOFTEXT|>z", "fr", "a", 2),
    (8, "it's he'll 'tis 12345 3.14 ½ É é ȫ ΑΣ.Β ΟΔΟΣ İstanbul ß ſ   a b 漢字 \U0001f600‍\U0001f600", "fr", "a", 2), (9, "word " * 40_000, "fr", "b", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    """The rows beside columns that are named as those inside."""
    names = "shard places code own f id word last heads tails rank part start_in_part ids n_tokens start base leaf forged group pos n node path block level _place _at _part _base first k at".split()
    return spark.createDataFrame(ODD, ROWS).withColumns({c: F.lit(f"clash {c}") for c in names})


def collocations(rows, least, top=2000):
    """lang, rank, phrase, a, l, r, n, score of (lang, text) rows, by counting everything."""
    counts = defaultdict(Counter)
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            for m in range(1, 5):
                counts["und" if lang is None else lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in counts.items():
        held = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = lambda p: ((p[i : i + m]) for m in range(2, len(p)) for i in range(len(p) - m + 1))
        gone = {s for p, a in held.items() for s in inside(p) if 100 * a >= 80 * c[s]}
        ranked = []
        for p, a in held.items():
            if p not in gone:
                score, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), left, right))
        n = sum(a for p, a in c.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least,top", [(3, 2000), (30, 2000), (3, 7)])
def test_phrases(spark, least, top):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = sorted(map(tuple, phrases.collocations(docs, least, top=top).collect()))
    assert found == collocations([(r.lang, r.text) for r in docs.select("lang", "text").collect()], least, top) and found


def test_phrases_of_odd_rows(spark, odd):
    found = sorted(map(tuple, phrases.collocations(odd, 2).collect()))
    assert found == collocations([(r[2], r[1]) for r in ODD], 2)
    assert phrases.collocations(odd.where("false")).count() == 0 and phrases.collocations(odd.where("text = ''")).count() == 0


def test_scores_beyond_64_bits(spark):
    """Products and hundredfold counts stay exact where they pass 64 bits."""
    big = 3 * 10**17 + 7
    level = spark.createDataFrame([(1, "en", "x y", big, [big + 11], [big + 2]), (2, "en", "y z", 10**17, [10**17], [10**17 + 1])], "id long, lang string, phrase string, f long, heads array<long>, tails array<long>")
    found = {r.id: (r.score, r.l, r.r) for r in phrases._scored(level, 2).collect()}
    assert found == {1: (2_000_000 * big // (2 * big + 13), big + 11, big + 2), 2: (2_000_000 * 10**17 // (2 * 10**17 + 1), 10**17, 10**17 + 1)}
    longer = spark.createDataFrame([(1, 2, 8 * 10**16)], "left long, right long, f long")
    kept = phrases._apart(spark.createDataFrame([(1, 10**17), (2, 10**17 + 1)], "id long, a long"), longer).collect()
    assert [r.a for r in kept] == [10**17 + 1]


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def expected_tokens(rows):
    """start, n_tokens and checksum of (doc_id, text) rows in ascending order, by the tokenizer alone."""
    tool, start, out = tokenizer(), 0, []
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_tokens(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, tokens.report(docs.repartition(7)).collect())) == expected_tokens(rows)


def test_tokens_of_odd_rows(spark, odd):
    found = sorted((tuple(r) for r in tokens.report(odd.repartition(3)).collect()), key=lambda r: r[1])
    assert [r[1] for r in found] == list(np.cumsum([0, *(r[2] for r in found[:-1])])) and [r[0] for r in found] == sorted((r[0] for r in ODD), key=lambda d: (d is not None, d or 0))
    assert Counter((d, n, c) for d, _, n, c in found) == Counter((d, n, c) for d, _, n, c in expected_tokens(ODD_PAIRS))
    assert tokens.report(odd.where("false")).count() == 0


ODD_PAIRS = [(r[0], r[1]) for r in ODD]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aéÉzZ'sdlm019 \n\t.,!<|>́̈Σσςİıſßﬁ½²漢‍\U0001f600"), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=6))
def test_pieces_encode_as_whole_texts(texts):
    """What is cut at spaces, digits and signs has the ids that the tokenizer gives the whole text."""
    tool, own = tokenizer(), tokens.Encoder()
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    ids, at = own.encode(np.frombuffer(data, np.uint8), offsets)
    assert [ids[a:z].tolist() for a, z in zip(at, at[1:])] == [[*tool.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_token_files(spark, capsys, monkeypatch):
    """Encodings, row groups and page indexes are as named, readers touch what they need, and a worker may forget."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    path = new_path(spark, "test-tokens")
    tokens.write(docs, path)
    first = sorted(glob.glob(f"{path.removeprefix('file://')}/ids/*.parquet"))[0]
    group = pq.ParquetFile(first).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings and all(c.has_offset_index and c.has_column_index for c in columns.values())
    assert all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("doc_id", "start_in_part", "n_tokens"))
    whole = {r.doc_id: r for r in tokens.read(spark, path).collect()}
    stream = np.concatenate([whole[d].ids for d in sorted(whole)])
    some = tokens.read(spark, path, 20, 40)
    assert {r.doc_id: (r.start, r.ids) for r in some.collect()} == {d: (whole[d].start, whole[d].ids) for d in range(20, 41)}
    some.explain()
    tokens.metadata(spark, path).explain()
    plans = capsys.readouterr().out
    assert "GreaterThanOrEqual(doc_id,20)" in plans and "ReadSchema: struct<part:int,start_in_part:bigint,doc_id:bigint,n_tokens:bigint>" in plans
    for start, length in ((0, 5), (1000, 3000), (len(stream) - 7, 100), (len(stream), 5)):
        parts = sorted(tokens.stretch(spark, path, start, length).collect(), key=lambda r: r.start)
        assert [x for r in parts for x in r.ids] == stream[start : start + length].tolist() and (not parts or parts[0].start == start)
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    own, text = tokens.Encoder(), "some words that a worker forgets again 12 and learns anew, " * 3
    for _ in range(4):
        data = np.frombuffer((text + "more").encode(), np.uint8)
        assert own.encode(data, np.array([0, len(text), len(data)]))[0].tolist() == [*tokenizer().encode(text, add_special_tokens=False).ids, 2, *tokenizer().encode("more", add_special_tokens=False).ids, 2]


def test_shards_lie_apart(spark):
    # Rows of many megabytes: neither a writer nor a reader holds the shards of a task together.
    held = cut(spark.range(0, 30, 1, 1), "test-shards", apart=True)
    (file,) = glob.glob(held.cut_path.removeprefix("file:") + "/*.parquet")
    assert pq.ParquetFile(file).metadata.num_row_groups == 30 == held.distinct().count()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def way(levels, at):
    for nodes in levels[:-1]:
        first = at // 3 * 3
        yield at - first, [nodes[i] for i in range(first, min(first + 3, len(nodes))) if i != at]
        at //= 3


def manifest(rows):
    """All columns of every row's proof, by whole trees in memory."""
    by_source = defaultdict(list)
    for row in rows:
        by_source[row[3]].append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: levels_of([leaf(r) for r in by_source[s]]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order])
    out = []
    for g, s in enumerate(order):
        for i, row in enumerate(by_source[s]):
            path = [*way(trees[s], i), *way(top, g)]
            bad = row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            value = leaf((row[0], row[1].replace("\n", ""), *row[2:])) if bad else leaf(row)
            for own, others in path:
                value = sha("".join([*others[:own], value, *others[own:]]))
            out.append((row[0], leaf(row), trees[s][-1][0], top[-1][0], sha("".join("".join(o) for _, o in path)), value, value == top[-1][0]))
    return out


@pytest.mark.parametrize("height", [1, 2, merkle.HEIGHT])
def test_manifest(spark, height):
    """One round, two and many give the trees that fit into memory."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [tuple(r) for r in docs.collect()]
    found = [tuple(r) for r in merkle.report(docs.repartition(5), height).collect()]
    assert Counter(found) == Counter(manifest(rows)) and {r[-1] for r in found} == {True, False}


def test_manifest_of_odd_rows(spark, odd):
    columns = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    assert Counter(tuple(r) for r in merkle.report(odd.repartition(3)).select(columns).collect()) == Counter(manifest(ODD))
    one = odd.where("doc_id = 6")
    assert [tuple(r) for r in merkle.report(one).collect()] == manifest([r for r in ODD if r[0] == 6]) and merkle.report(one).first().proof_sha256 == sha("")
    assert merkle.report(odd.where("false")).count() == 0


def test_proofs_of_some_leaves(spark):
    """Proofs are taken for the rows that ask, and fold to the subroot; a leaf in another's place doesn't."""
    nodes = [sha(str(i)) for i in range(50)]
    leaves = spark.createDataFrame([(0, i, 50, x) for i, x in enumerate(nodes)], "group long, pos long, n long, node string")
    tree = merkle.grow(leaves, new_path(spark, "test-merkle"), 2)
    above = spark.createDataFrame([(0, "", "")], "group long, path string, subroot string")
    asked = merkle.prove(leaves.where("pos % 7 = 3").drop("node"), tree, above)
    root = levels_of(nodes)[-1][0]
    found = {r.pos: r.path for r in asked.collect()}
    assert set(found) == set(range(3, 50, 7)) and merkle.tops(tree, spark).first().root == root
    for at, path in found.items():
        assert merkle.fold(nodes[at], path, (at, 50)) == root != merkle.fold(nodes[at - 1], path, (at, 50))
