"""The registered queries against SQL, and the pipeline's stages against brute force and on odd tables."""

from __future__ import annotations

import collections
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import jaccard_pairs, repeated, words

import corpus_pipeline
from kabunoki.llm import bpe, catalog, exact_dedup, langid, packing, pii
from kabunoki.llm.shared import fresh_path

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return c


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got
    if name in catalog.SQL:
        cur = duck.execute(catalog.SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns and got == sorted((tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()), key=repr)


def odd(spark, extra: bool):
    """Nulls in every column, empty and very long texts, repeated rows, ties; and columns with names used inside."""
    prose = "the quick brown fox jumps over the lazy dog and runs through the quiet green forest near the old stone bridge"
    texts = [None, "", " \n\n", "...", "one", prose, prose, prose + "\n" + prose, prose.replace("fox", "cat"), "mail me at ann@mail.com " + prose, "word " * 220_000, "x" * 1_100_000, prose + "\n😀😀", "tel 1234567890123"]
    rows = [(i, t, "en" if i % 3 else None, None if i == 6 else "s", i) for i, t in enumerate(texts)]
    rows += [(None, prose, None, None, None), (None, prose, None, None, None), rows[5], rows[5], (5, "another text of the same id", "en", "s", None)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    if extra:
        df = df.withColumns({c: F.lit(c) for c in ("digest", "part", "kind", "cell", "line", "root", "node", "removed", "TEXTS", "id", "a b.c")})
    return df


def test_exact_dedup_on_an_odd_table(spark):
    docs = odd(spark, True)
    out = exact_dedup.DigestIndex(spark, fresh_path(spark, "index"), 2).ingest(docs)
    assert out.columns == docs.columns and sorted((r.doc_id for r in out.collect()), key=repr) == sorted([0, *range(2, 6), *range(7, 14), 5], key=repr)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_odd_tables(spark, name):
    docs = odd(spark, True)
    out = STAGES[name](spark, docs, "")
    rows = out.collect()
    if name != "packing":
        assert out.columns == docs.columns
        assert all(r.n_chars is None or r.text is None or r.n_chars == len(r.text) for r in rows if name in ("line dedup", "PII"))
    else:
        held = collections.Counter()
        for r in rows:
            held[r.sequence_id] += r.n_tokens
        assert max(held.values()) <= packing.CAPACITY and {r.doc_id for r in rows} >= {4, 10, 11, None}
    none = STAGES[name](spark, docs.limit(0), "")
    assert none.count() == 0 and none.columns == out.columns
    ids = collections.Counter(r.doc_id for r in rows)
    if name == "PII":
        assert len(rows) == docs.count() and {r.doc_id: r.text for r in rows}[13] == "tel [NUMBER]"
    if name == "line dedup":
        text = {r.doc_id: r.text for r in rows if r.doc_id not in (None, 5)}
        assert text[0] is None and text[1] == "" and text[3] == "..." and text[12] == "😀😀" and 6 not in text and 7 not in text and ids[None] == 2 and ids[5] == 4
    if name == "n-gram Jaccard join":
        assert ids[5] == 4 and ids[6] == 0 and ids[None] == 2 and ids[0] == ids[1] == ids[3] == 1
    if name == "language ID":
        assert not ids.keys() & {0, 1, 2, 3} and ids[10] == ids[11] == 1


@needs_data
def test_stages_equal_brute_force(spark):
    """Each stage on what its predecessor left of the smallest tables."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    # Languages: every text on its own.
    model = langid.train(docs)
    kept = {r.doc_id for r in docs.collect() if not langid.judge(pa.array([r.text]), *model)["rejected"][0]}
    out = corpus_pipeline.languages(spark, docs, DATA)
    assert {r.doc_id for r in out.collect()} == kept
    # Lines: all pairs of lines.
    before = out.collect()
    gone = repeated(before)
    left = {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if (r.doc_id, i) not in gone) if any((r.doc_id, i) in gone for i in range(len(r.text.split("\n")))) else r.text for r in before}
    out = spark.createDataFrame(corpus_pipeline.lines(spark, out, DATA).collect(), DOCUMENTS)
    rows = out.collect()
    same = [r.text == left[r.doc_id] for r in rows]
    assert sum(same) >= 0.98 * len(same) and all(r.n_chars == len(r.text) for r in rows)
    assert {r.doc_id for r in rows} >= {k for k, t in left.items() if words(t)}
    # Near copies: all pairs of documents, joined into groups.
    parent = {r.doc_id: r.doc_id for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in jaccard_pairs(rows):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    out = corpus_pipeline.near_copies(spark, out, DATA)
    rows = out.collect()
    assert {r.doc_id for r in rows} == {k for k in parent if root(k) == k}
    # Personal data: every text on its own.
    out = corpus_pipeline.private(spark, out, DATA)
    assert {r.doc_id: r.text for r in out.collect()} == {r.doc_id: pii.redact(r.text)[0] for r in rows}
    # Packing: every token is in one sequence, and the sequences are about as few as they can be.
    machine = bpe.load()
    size = {r.doc_id: int(machine.encode(pa.array([r.text]))[1][0]) for r in out.collect()}
    held, tokens, at = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for r in corpus_pipeline.pack(spark, out, DATA).collect():
        held[r.sequence_id] += r.n_tokens
        tokens[r.doc_id] += r.n_tokens
        at[r.doc_id].append((r.first_token, r.n_tokens))
    assert tokens == {k: n for k, n in size.items() if n} and max(held.values()) <= packing.CAPACITY
    assert all(sum(n for _, n in sorted(x)[:k]) == first for x in at.values() for k, (first, _) in enumerate(sorted(x)))
    assert len(held) <= 1.05 * sum(size.values()) / packing.CAPACITY + 2


@needs_data
def test_run_gives_the_stages_in_a_row(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    key = lambda r: (r.doc_id, r.piece, r.first_token, r.n_tokens)
    assert sorted(map(key, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(key, docs.collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "PII", "packing"]


def test_stages_on_more_variants_than_are_listed_as_pairs(spark):
    base = [f"word{i}" for i in range(40)]
    texts = [" ".join(f"x{k}" if i == k % 40 else w for i, w in enumerate(base)) for k in range(300)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCUMENTS)
    for name in ("line dedup", "n-gram Jaccard join"):
        assert [r.doc_id for r in STAGES[name](spark, docs, DATA).collect()] == [0]
