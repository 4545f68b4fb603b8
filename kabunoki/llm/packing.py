"""Packing documents into training sequences as a cutting-stock problem, solved by column generation.

A document's length is the number of tokens that an automaton of ``bpe`` writes for it; without one it is only estimated,
by bytes. A sequence holds ``capacity`` tokens. A document longer than that is cut: its full pieces are sequences of their own and
only the rest is packed. Rests are counted by length class (a histogram of bounded size, whatever the corpus); the
driver solves the linear program over that histogram: minimise the number of sequences, one variable per pattern (how
many rests of each class share a sequence). Columns are priced by an unbounded knapsack over the dual prices until none
improves. The fractional solution is rounded down, what remains is packed first-fit decreasing by class, and patterns
are dealt to documents by their rank in their class.

Cases: a null or empty text has 0 tokens and gets no row; a null id is carried as it is; repeated rows are packed once
each, in sequences of their own; of rows of one class the order is by id, then length (equal rows are interchangeable); a
very long text is cut into as many full pieces as it has; sequences are numbered from 0, first those that are packed, then
the full ones; an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import bpe
from . import columnar as C
from .shared import documents, in_arrow, text_bytes, width, written

CAPACITY = 2048
CLASSES = 256
BYTES_PER_TOKEN = 4

SCHEMA = "doc_id long, piece long, first_token long, n_tokens long, sequence_kind string, sequence_id long"


def price(duals: np.ndarray, sizes: np.ndarray, capacity: int, demand: np.ndarray) -> tuple[float, np.ndarray]:
    """The pattern of the greatest total dual price (unbounded knapsack by dynamic programming over the capacity;
    sizes ascend)."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    use = np.flatnonzero((duals > 1e-12) & (demand > 0))
    s, d = sizes[use], duals[use]
    fits = np.searchsorted(s, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fits[c]:
            v = best[c - s[:n]] + d[:n]
            k = v.argmax()
            if v[k] > best[c] + 1e-12:
                best[c], took[c] = v[k], use[k]
    pattern = np.zeros(len(sizes), dtype=np.int64)
    c = capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[capacity]), pattern


def fractional(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 5000, gap: float = 1e-5, smooth: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, how often each is used): the optimum of the linear relaxation, by revised simplex.

    Columns are added until the solution is within half a sequence, or the share ``gap``, of the optimum, as Farley's bound
    proves; if it isn't after ``rounds``, that is an error. The start is first-fit decreasing: each of its patterns uses up
    a class that no later one has, so they are a basis. Prices are smoothed towards those of the best bound so far.
    """
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    left = demand.astype(float).copy()
    while (left > 1e-9).any():
        p, room = np.zeros(m), capacity
        for c in np.flatnonzero(left > 1e-9)[::-1]:
            p[c] = room // sizes[c]
            room -= p[c] * sizes[c]
        used = np.flatnonzero(p)
        often = left[used] / p[used]
        out = used[often.argmin()]
        basis[:, out] = p
        left[used] -= often.min() * p[used]
        left[out] = 0
    inverse = np.linalg.inv(basis)
    x = np.maximum(inverse @ demand, 0)
    centre = sizes / capacity  # no pattern is worth more than 1 at these prices
    bound = float(centre @ demand)
    for k in range(rounds):
        duals = inverse.sum(axis=0)
        for prices in (smooth * centre + (1 - smooth) * np.maximum(duals, 0), duals):
            value, pattern = price(prices, sizes, capacity, demand)
            # No solution uses fewer sequences than the demand is worth at prices at which no pattern is worth more than 1.
            if prices @ demand > bound * max(value, 1e-12):
                bound, centre = float(prices @ demand / value), np.maximum(prices, 0) / value
            if duals @ pattern > 1 + 1e-9:
                break
        if value <= 1 + 1e-9 and prices is duals or x.sum() - bound < max(0.5, gap * x.sum()):
            break
        move = inverse @ pattern
        up = move > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, move, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * move
        x[out] = ratio[out]
        x = np.maximum(x, 0)
        basis[:, out] = pattern
        if k % 50 == 49:
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ demand, 0)
        else:
            row = inverse[out] / move[out]
            inverse = inverse - np.outer(move, row)
            inverse[out] = row
    else:
        raise ArithmeticError(f"no solution within the gap after {rounds} columns")
    return np.rint(basis).astype(np.int64), x


def plan(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, uses) that together serve exactly the demand: the linear optimum rounded down, the rest packed
    first-fit decreasing."""
    out: list[tuple[np.ndarray, int]] = []
    left = demand.astype(np.int64).copy()
    if not len(sizes):
        return out
    patterns, x = fractional(sizes, demand.astype(float), capacity)
    for k in np.argsort(-x):
        p = patterns[:, k]
        used = p > 0
        n = int(min(np.floor(x[k] + 1e-9), (left[used] // p[used]).min() if used.any() else 0))
        if n > 0:
            out.append((p.copy(), n))
            left -= n * p
    order = np.argsort(-sizes)
    while left.any():
        p, room = np.zeros(len(sizes), dtype=np.int64), capacity
        for c in order:
            n = min(int(left[c]), room // int(sizes[c]))
            p[c] = n
            room -= n * int(sizes[c])
        n = int((left[p > 0] // p[p > 0]).min())
        out.append((p, max(n, 1)))
        left -= max(n, 1) * p
    return out


def pieces(docs: DataFrame, bytes_per_token: float, automaton: bpe.Automaton | None, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, n): a document's token count; without an automaton ceil(UTF-8 bytes / bytes_per_token)."""
    if automaton is None:
        n = F.ceil(text_bytes(text_col) / F.lit(float(bytes_per_token))).cast("long")
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n")).where(F.col("n") > 0)
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for b in batches:
            for at, some in C.chunks(b.column(1), 2 << 20):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(some)), pa.array(machine.count(some))], names=["doc_id", "n"])

    return in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n long").where(F.col("n") > 0)


def pack(
    docs: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, bytes_per_token: float = BYTES_PER_TOKEN, id_col: str = "doc_id", text_col: str = "text", automaton: bpe.Automaton | None = None
) -> DataFrame:
    """One row per piece of a document: where it starts, how long it is, and the sequence that holds it."""
    spark = docs.sparkSession
    step = -(-capacity // classes)
    if capacity % step:
        raise ValueError("classes must divide capacity")
    base = written(pieces(docs, bytes_per_token, automaton, id_col, text_col), "packing-lengths")
    rest = F.pmod("n", F.lit(capacity))
    salts = max(1, width(spark))
    salt = F.pmod(F.xxhash64("doc_id", "n"), F.lit(salts)).cast("int").alias("salt")
    tail = base.where(rest > 0).select(
        "doc_id", F.floor(F.col("n") / capacity).cast("long").alias("piece"), rest.alias("len"), F.ceil(rest / F.lit(step)).cast("int").alias("class"), salt
    )
    counts = tail.groupBy("class", "salt").count()
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("count").alias("n")).collect()}
    kinds = np.array(sorted(histogram), dtype=np.int64)
    rows, sequence = [], 0
    taken = dict.fromkeys(kinds.tolist(), 0)
    # In units of a class's width, of which a sequence holds capacity // step.
    for pattern, uses in plan(kinds, np.array([histogram[k] for k in kinds.tolist()]), capacity // step):
        for c in np.flatnonzero(pattern):
            k, per = int(kinds[c]), int(pattern[c])
            rows.append((k, taken[k], taken[k] + per * uses, per, sequence))
            taken[k] += per * uses
        sequence += uses
    # Per class, where each pattern's share of the ranks begins: at most a few hundred rows for any corpus.
    deal = spark.createDataFrame(rows, "class int, lo long, hi long, per int, base long").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "per", "base"))).alias("deal"))
    before = counts.select("class", "salt", (F.sum("count").over(W.partitionBy("class").orderBy("salt")) - F.col("count")).alias("before"))
    ranked = (
        tail.withColumn("rn", F.row_number().over(W.partitionBy("class", "salt").orderBy(F.col("doc_id").asc_nulls_last(), "len")) - 1)
        .join(before, ["class", "salt"])
        .withColumn("rank", F.col("rn") + F.col("before"))
    )
    share = F.element_at(F.filter("deal", lambda d: (d["lo"] <= F.col("rank")) & (F.col("rank") < d["hi"])), 1)
    packed = ranked.join(F.broadcast(deal), "class").withColumn("s", share).select(
        "doc_id", "piece", (F.col("piece") * capacity).alias("first_token"), F.col("len").alias("n_tokens"), F.lit("packed").alias("sequence_kind"),
        (F.col("s.base") + F.floor((F.col("rank") - F.col("s.lo")) / F.col("s.per"))).cast("long").alias("sequence_id"),
    )
    return _full(base, capacity, salt, sequence).unionByName(packed)


def _full(base: DataFrame, capacity: int, salt: F.Column, first: int) -> DataFrame:
    """The pieces that are sequences of their own, numbered from ``first`` by salt and, within it, by rank."""
    whole = base.select("doc_id", "n", F.floor(F.col("n") / capacity).cast("long").alias("k"), salt).where("k > 0")
    # One row per salt: their running sum has as many rows as there are shuffle partitions.
    before = whole.groupBy("salt").agg(F.sum("k").alias("all")).select("salt", (F.sum("all").over(W.orderBy("salt")) - F.col("all")).alias("before"))
    rank = W.partitionBy("salt").orderBy(F.col("doc_id").asc_nulls_last(), "n").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = whole.withColumn("base", F.sum("k").over(rank) - F.col("k")).join(before, "salt")
    return placed.select("doc_id", (F.col("base") + F.col("before") + first).alias("base"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * capacity).alias("first_token"), F.lit(capacity).cast("long").alias("n_tokens"), F.lit("full").alias("sequence_kind"), (F.col("base") + F.col("piece")).alias("sequence_id")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), automaton=bpe.load())
