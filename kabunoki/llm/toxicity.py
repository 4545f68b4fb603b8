"""Toxicity by multiple-instance learning.

A document is a bag of sentences; its label says only whether some sentence is toxic. A sentence's score is a logistic
function of its words (hashed), a document's is the noisy-or of its sentences' scores, and the weights are fitted to
document labels by the gradient of that likelihood with an L1 proximal step. Sentence scores then locate what offends.

The model is fitted on at most ``max_labelled`` labelled documents, those with the least hash of their id, and on words
that at least ``LEAST_DOCUMENTS`` of these have: a rarer word has no weight. Scoring covers every sentence of every
document. The weights are a table of 2**BITS numbers, whatever the corpus.

Cases: a null or empty text has no sentences and is never toxic; labels that are null or contradict each other for an id
are left out; with no toxic or no clean labels nothing is flagged; a repeated row is flagged each time it occurs; of
sentences that tie for the worst of a toxic document all are listed; a very long text is one bag of all its sentences; an
empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import columnar as C
from .shared import documents, in_arrow

BITS = 18
MAX_LABELLED = 12_000
THRESHOLD = 0.5
LEAST_DOCUMENTS = 3
SCHEMA = "doc_id long, doc_score double, sentence_no int, sentence string, sentence_score double"
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True
_SPLIT = re.compile(r"[.!?\n]")


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, sentence) of each distinct word of a sentence; (text, number in its text) of each sentence that has words."""
    raw, off = C.buffers(C.lower(texts))
    start, end, text = C.words(raw, off)
    bucket = (C.span_hashes(raw, start, end) >> C.U64(64 - BITS)).astype(np.int32)
    ends = np.flatnonzero(_END[raw])
    before = np.searchsorted(ends, start)
    number = before - np.searchsorted(ends, off[:-1])[text]
    new = np.ones(len(start), bool)
    new[1:] = (before[1:] != before[:-1]) | (text[1:] != text[:-1])
    # A word counts once in a sentence, however often it stands there.
    once = np.unique((np.cumsum(new) - 1) << BITS | bucket)
    return (once & ((1 << BITS) - 1)).astype(np.int32), once >> BITS, text[new], number[new]


def fit(texts: pa.Array, toxic: np.ndarray, steps: int = 150, rate: float = 0.2, l1: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights by bucket and the intercept."""
    weights = np.zeros(1 << BITS, np.float32)
    if not len(toxic) or toxic.min() == toxic.max():
        return weights, -30.0
    parts, sentences = [], 0
    for at, some in C.chunks(texts):
        b, s, d, _ = bags(some)
        parts.append((b, s + sentences, d + at))
        sentences += len(d)
    bucket, sent, doc = (np.concatenate(x) for x in zip(*parts))
    seen = np.unique(bucket.astype(np.int64) << 32 | doc[sent])
    often = np.bincount(seen >> 32, minlength=1 << BITS) >= LEAST_DOCUMENTS
    keep = often[bucket]
    bucket, sent = bucket[keep], sent[keep]
    used, f = np.unique(bucket, return_inverse=True)
    y = toxic.astype(float)
    w, b, n = np.zeros(len(used)), -6.0, len(y)
    m1, m2, b1, b2 = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(sent, w[f], sentences) + b
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        none = np.exp(-np.bincount(doc, np.logaddexp(0, z), n))
        some = np.maximum(1 - none, 1e-12)
        slope = p * ((1 - y) - y * none / some)[doc]
        g, gb = np.bincount(f, slope[sent], len(used)) / n, slope.sum() / n
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        scale = rate / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-5)
        w = w - scale * m1 / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(np.abs(w) - scale * l1, 0)
        b -= rate * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.99**t)) + 1e-5)
    weights[used] = w
    return weights, float(b)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .where(F.col("toxic") == F.col("most"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    # At most max_labelled rows of two numbers are broadcast.
    rows = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")), "doc_id")
        .select("text", "toxic").toArrow()
    )
    return fit(rows["text"].combine_chunks() if len(rows) else pa.array([], pa.string()), rows["toxic"].to_numpy().astype(int))


def score_batch(ids: pa.Array, texts: pa.Array, weights: np.ndarray, intercept: float, threshold: float) -> Iterator[pa.RecordBatch]:
    for at, some in C.chunks(texts):
        bucket, sent, doc, number = bags(some)
        if not len(doc):
            continue
        z = np.bincount(sent, weights[bucket], len(doc)) + intercept
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        whole = 1 - np.exp(-np.bincount(doc, np.logaddexp(0, z), len(some)))
        best = np.zeros(len(some))
        np.maximum.at(best, doc, p)
        hit = (whole[doc] >= threshold) & ((p >= threshold) | (p == best[doc]))
        d = doc[hit]
        if not len(d):
            continue
        split = {int(k): _SPLIT.split(some[int(k)].as_py()) for k in np.unique(d)}
        yield pa.record_batch(
            {
                "doc_id": ids.take(pa.array(d + at)), "doc_score": whole[d], "sentence_no": number[hit].astype(np.int32),
                "sentence": [split[int(k)][int(n)].strip() for k, n in zip(d, number[hit])], "sentence_score": p[hit],
            }
        )


def locate(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The offending sentences of toxic documents, with both scores: those whose own score reaches the threshold, and
    the worst of each toxic document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = shared.value
        for b in batches:
            yield from score_batch(b.column(0), b.column(1), weights, intercept, threshold)

    return in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return locate(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
