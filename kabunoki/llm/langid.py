"""Language identification of mixed documents.

A language's model is a table of log probabilities of hashed byte trigrams within lower-cased words (with word ends);
words with digits in them, such as numbers and keys, belong to no language and aren't counted. A
word's likelihood is the product over its trigrams; an extra component, uniform over trigrams, stands for no known
language. Expectation-maximisation over a document's words estimates its proportions of the components,
until none changes by more than TOLERANCE. The set of its languages is then chosen by penalised likelihood: of the sets of
the k most present components, each refitted in the same way, the one with the greatest log likelihood less
PENALTY * k * log(1 + words); k goes up to all of them.

Models are fitted on at most ``per_language`` labelled documents of each language, those with the least hash of their
id; inference reads every word of every document. The tables are of fixed size per language.

Cases: a document without words (null, empty, punctuation alone) is rejected, with no languages; so is one that is more
than half of no known language. A null label isn't trained on; without any labels everything is rejected. Repeated rows
are each judged; of equal shares the language that comes first in the alphabet leads; a very long text is judged by all of
its words, whose likelihoods are computed in slices; an empty table gives an empty result; extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import columnar as C
from .shared import documents, in_arrow

BITS = 16
PER_LANGUAGE = 1500
PENALTY = 3.0
TOLERANCE = 1e-3
SLICE = 1 << 20  # bytes of words
SCHEMA = "doc_id long, languages array<string>, shares array<double>, language string, unknown_share double, rejected boolean"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the lower-cased texts; start, end and text of each word without digits)."""
    raw, off = C.buffers(C.lower(texts))
    start, end, text = C.words(raw, off)
    digits = np.zeros(len(raw) + 1, np.int32)
    np.cumsum((raw >= 48) & (raw <= 57), out=digits[1:])
    plain = digits[end] == digits[start]
    return raw, start[plain], end[plain], text[plain]


def trigrams(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each byte's trigram, where each word begins among them)."""
    at = C.ragged(start, end - start)
    x = raw[at].astype(np.uint32)
    first = np.cumsum(end - start) - (end - start)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first] = 0
    after[np.append(first[1:], len(x))[: len(first)] - 1] = 0
    h = (before * np.uint32(0x9E3779B1)) ^ (x * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int32), first


def fit(texts: dict[str, pa.Array]) -> tuple[list[str], np.ndarray]:
    """Names and a table (bucket, component) of log probabilities; the last component is uniform."""
    names = sorted(texts)
    table = np.full((1 << BITS, len(names) + 1), -np.log(1 << BITS), dtype=np.float32)
    for k, name in enumerate(names):
        count = np.zeros(1 << BITS)
        for _, some in C.chunks(texts[name]):
            raw, start, end, _ = words_of(some)
            count += np.bincount(trigrams(raw, start, end)[0], minlength=1 << BITS)
        smooth = 0.05
        table[:, k] = np.log((count + smooth) / (count.sum() + smooth * (1 << BITS)))
    return names, table


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    # Of n documents about per_language have a hash below this share of all; with six deviations more, at least as many.
    count = {r["lang"]: r["n"] for r in base.groupBy("lang").agg(F.count_distinct("doc_id").alias("n")).collect()}
    share = {lang: min(1.0, (per_language + 6 * per_language**0.5 + 30) / n) for lang, n in count.items()}
    if not share:
        return fit({})
    below = F.create_map(*[F.lit(x) for lang, s in share.items() for x in (lang, min(2**63 - 1, int(s * 2**63)))])
    place = F.xxhash64("doc_id").bitwiseAND(F.lit(2**63 - 1))
    rows = base.withColumn("place", place).where(F.col("place") <= below[F.col("lang")]).select("place", "doc_id", "text", "lang").toArrow().sort_by([("place", "ascending"), ("doc_id", "ascending")])
    lang = np.array(rows["lang"].to_pylist(), dtype=object)
    text = rows["text"].combine_chunks() if len(rows) else pa.array([], pa.string())
    return fit({name: text.take(pa.array(np.flatnonzero(lang == name)[:per_language])) for name in sorted(count)})


def _em(p: np.ndarray, pi: np.ndarray, words: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Proportions at which expectation-maximisation stands still, and the log likelihood (up to each word's own constant)
    under them; ``words`` of each document follow each other in ``p``."""
    pi, live = pi.copy(), np.arange(len(words))
    q, n = p, words
    while len(live):
        first, doc = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        r = q * pi[live][doc]
        r /= r.sum(axis=1, keepdims=True)
        new = np.add.reduceat(r, first, axis=0) / n[:, None]
        moves = np.abs(new - pi[live]).max(axis=1) > tolerance
        pi[live] = new
        if not moves.all():
            live, q, n = live[moves], q[moves[doc]], n[moves]
    doc = np.repeat(np.arange(len(words)), words)
    total = np.log(np.maximum((p * pi[doc]).sum(axis=1), 1e-30))
    return pi, np.add.reduceat(total, np.cumsum(words) - words)


def infer(texts: pa.Array, table: np.ndarray, penalty: float = PENALTY, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(shares of each component by text, all 0 without words; how many words)."""
    n, k = len(texts), table.shape[1]
    shares, words = np.zeros((n, k)), np.zeros(n, np.int64)
    raw, start, end, text = words_of(texts)
    if not len(text):
        return shares, words
    p = np.empty((len(start), k), np.float32)
    total = np.cumsum(end - start)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SLICE, "right")))
        bucket, first = trigrams(raw, start[lo:hi], end[lo:hi])
        log = np.add.reduceat(table[bucket], first, axis=0)
        p[lo:hi] = np.exp(np.maximum(log - log.max(axis=1, keepdims=True), -60))
        lo = hi
    words = np.bincount(text, minlength=n)
    have = np.flatnonzero(words)
    count = words[have]
    pi, _ = _em(p, np.full((len(have), k), 1 / k, np.float32), count, tolerance)
    rank = np.argsort(np.argsort(-pi, axis=1, kind="stable"), axis=1)
    best, chosen = np.full(len(have), -np.inf), pi
    for size in range(1, k + 1):
        some = np.where(rank < size, np.maximum(pi, 1e-6), 0)
        some, ll = _em(p, (some / some.sum(axis=1, keepdims=True)).astype(np.float32), count, tolerance)
        score = ll - penalty * size * np.log1p(count)
        better = score > best
        best = np.where(better, score, best)
        chosen = np.where(better[:, None], some, chosen)
    shares[have] = chosen
    return shares, words


def judge(texts: pa.Array, names: list[str], table: np.ndarray) -> dict[str, list | np.ndarray]:
    shares = np.concatenate([infer(some, table)[0] for _, some in C.chunks(texts)]) if len(texts) else np.zeros((0, table.shape[1]))
    unknown = np.where(shares.sum(axis=1) > 0, shares[:, -1], 1.0)
    order = np.argsort(-shares[:, :-1], axis=1, kind="stable")
    languages, parts = [], []
    for row, o in zip(shares, order):
        own = [int(j) for j in o if row[j] > 0]
        languages.append([names[j] for j in own])
        parts.append([float(row[j]) for j in own])
    rejected = (unknown > 0.5) | (shares[:, :-1].sum(axis=1) <= 0)
    return {"languages": languages, "shares": parts, "language": [x[0] if x else None for x in languages], "unknown_share": unknown, "rejected": rejected}


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's languages by share, and whether it is rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for b in batches:
            out = judge(b.column(1), names, table)
            yield pa.record_batch(
                [b.column(0), pa.array(out["languages"], pa.list_(pa.string())), pa.array(out["shares"], pa.list_(pa.float64())), pa.array(out["language"], pa.string()), pa.array(out["unknown_share"], pa.float64()), pa.array(out["rejected"], pa.bool_())],
                names=["doc_id", "languages", "shares", "language", "unknown_share", "rejected"],
            )

    return in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, SCHEMA)


def keep(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for b in batches:
            yield b.filter(pa.array(~judge(b.column(b.schema.get_field_index(text_col)), names, table)["rejected"], pa.bool_()))

    return in_arrow(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, train(docs))
