"""What joins of near copies share: pair verification in cells, and connected groups."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import columnar as C
from .shared import forget, give_back, if_small, in_arrow, ship, width, written

HOT = 128  # so many that share a key are compared as a bundle, not by a list of pairs
CHUNK = 2048  # members of a bundle that are compared at once with as many others


def buckets(spark: SparkSession) -> int:
    """Ids fall into so many buckets, and pairs into the cells of two buckets, about as many as shuffle partitions."""
    return max(1, int(math.sqrt(2 * width(spark))))


def by_cell(a: np.ndarray, b: np.ndarray, count: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Pairs of ids as (cell, packed pairs of places, ids), one per cell: a pair of a large group costs a byte or so."""
    ha, hb = ((C.mix64(x.view(np.uint64)) % np.uint64(count)).astype(np.int64) for x in (a, b))
    cell = np.minimum(ha, hb) * count + np.maximum(ha, hb)
    order = np.argsort(cell, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], cell[order][1:] != cell[order][:-1], [True]])) if len(order) else np.zeros(0, np.int64)
    for lo, hi in zip(cut[:-1], cut[1:]):
        o = order[lo:hi]
        ids, back = np.unique(np.concatenate([a[o], b[o]]), return_inverse=True)
        x, y = back[: len(o)], back[len(o) :]
        pairs = np.unique(np.minimum(x, y).astype(np.uint64) << np.uint64(32) | np.maximum(x, y).astype(np.uint64))
        yield int(cell[o[0]]), C.pack(pairs), ids.tobytes()


def pairs_of(rows: Iterable[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, place of the one, place of the other) of the distinct pairs of one cell."""
    packed, names, base = [], [], 0
    for pairs, ids in rows:
        e = C.unpack(pairs)
        packed.append(((e >> np.uint64(32)).astype(np.int64) + base, (e & np.uint64(0xFFFFFFFF)).astype(np.int64) + base))
        names.append(np.frombuffer(ids, np.int64))
        base += len(names[-1])
    ids, back = np.unique(np.concatenate(names), return_inverse=True)
    x, y = (back[np.concatenate(z)] for z in zip(*packed))
    e = np.unique(np.minimum(x, y).astype(np.uint64) << np.uint64(32) | np.maximum(x, y).astype(np.uint64))
    return ids, (e >> np.uint64(32)).astype(np.int64), (e & np.uint64(0xFFFFFFFF)).astype(np.int64)


def united(rows: Iterable[tuple[int, bytes, bytes]]) -> Iterator[tuple[int, bytes, bytes]]:
    """The rows of by_cell from many tasks as one per cell."""
    cells: dict[int, list[tuple[bytes, bytes]]] = {}
    for cell, pairs, ids in rows:
        cells.setdefault(cell, []).append((pairs, ids))
    for cell, some in cells.items():
        ids, x, y = pairs_of(some)
        yield cell, C.pack(x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64)), ids.tobytes()


def leader_of(names: np.ndarray) -> int:
    """The leader of those that share a key: 31 bits, not 0, of the least hash of a name. Large sets that overlap widely
    mostly have the same leader, and are one bundle then; who follows a leader shares a key with it."""
    return int(C.mix64(names.view(np.uint64)).min() >> np.uint64(33)) | 1


def bundled(rows: Iterable[tuple[int, bytes]]) -> Iterator[tuple[int, bytes, bytes]]:
    """Members (leader, ids) as cells of two chunks each, all pairs of which are candidates: the leader and the chunks
    make the cell's name, and in place of pairs stands how many ids are of the first chunk; 0 for a chunk with itself."""
    members: dict[int, list[np.ndarray]] = {}
    for leader, ids in rows:
        members.setdefault(leader, []).append(np.frombuffer(ids, np.int64))
    for leader, some in members.items():
        ids = np.unique(np.concatenate(some))
        chunks = [ids[lo : lo + CHUNK] for lo in range(0, len(ids), CHUNK)]
        for i, x in enumerate(chunks):
            yield leader << 32 | i << 16 | i, np.array([0], np.int64).tobytes(), x.tobytes()
            for j in range(i + 1, len(chunks)):
                yield leader << 32 | i << 16 | j, np.array([len(x)], np.int64).tobytes(), x.tobytes() + chunks[j].tobytes()


def bundles(rows: DataFrame) -> DataFrame:
    """Cells of the bundles of (leader, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = ((k.as_py(), i.as_py()) for b in batches for k, i in zip(b.column(0), b.column(1)))
        for cell, split, ids in bundled(some):
            yield pa.record_batch({"cell": pa.array([cell], pa.int64()), "pairs": pa.array([split], pa.binary()), "ids": pa.array([ids], pa.binary())})

    return in_arrow(rows.repartition(width(rows.sparkSession), "leader"), run, "cell long, pairs binary, ids binary")


def merged(found: list[np.ndarray], held: int) -> tuple[list[np.ndarray], int]:
    """``found`` without repetitions, and the size beyond which that is worth doing again."""
    found = [np.unique(np.concatenate(found))]
    return found, max(held, 2 * len(found[0]))


def verify(cells: DataFrame, payload: DataFrame, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray, pa.Table, int], pa.Table], schema: str) -> DataFrame:
    """Run ``kernel`` on the candidate pairs of each cell (cell, pairs, ids) and the payload rows (id, ...) they name,
    which come in the order of ids. The last argument is 0, or the leader of a bundle: then all pairs of places (x, y),
    x < y, of the two arrays are candidates. In "cells" the payload has all cells of its row.

    A payload row is sent to the cells where it has a partner, never once per pair, so a group of copies, however
    large, costs some copies of each row.
    """
    ship(cells.sparkSession)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell, ids in zip(b.column(0), b.column(1)):
                x = np.frombuffer(ids.as_py(), np.int64)
                yield pa.record_batch({"id": x, "cell": np.full(len(x), cell.as_py(), np.int64)})

    wanted = written(cells.select("cell", "ids").mapInArrow(named, "id long, cell long").groupBy("id").agg(F.collect_set("cell").alias("cells")), "cells-wanted")
    # If broadcast, rows without a partner aren't shuffled.
    sent = payload.join(if_small(wanted, F.size("cells")), "id").select(F.explode("cells").alias("cell"), *payload.columns, "cells")

    nothing = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return nothing
        leader = key[0].as_py() >> 32
        if leader:
            ids, split = np.frombuffer(left["ids"][0].as_py(), np.int64), int(np.frombuffer(left["pairs"][0].as_py(), np.int64)[0])
            x, y = np.arange(split or len(ids)), np.arange(split, len(ids))
        else:
            ids, x, y = pairs_of([(p.as_py(), i.as_py()) for p, i in zip(left["pairs"], left["ids"])])
        right = right.take(pa.array(np.argsort(right["id"].to_numpy(), kind="stable")))
        out = kernel(ids, x, y, right, leader)
        give_back()
        return out

    return cells.groupBy("cell").cogroup(sent.groupBy("cell")).applyInArrow(run, schema)


def forest(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) that connect the same nodes of range(n) as the pairs do, without the roots themselves."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, m)
        np.minimum.at(label, y, m)
        np.minimum.at(label, before[x], m)
        np.minimum.at(label, before[y], m)
        label = label[label]
        if (label == before).all():
            break
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge list (a, b) of integers; root is the least node that it is connected to.

    Alternating large-star and small-star contractions (Kiveris et al., 2014): a number of rounds that grows with the
    logarithm of the longest chain, each two groupings by node; every round is a written table. The least neighbour is
    an aggregate joined back, so no task holds the edges of a node with many.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(lowest, "a")
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
            .select("x.a", "x.b").where("a <> b").distinct()
        )
        before, e = e, written(small, "edges")
        forget(before)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (now["n"], now["h"]):
            break
        mark = (now["n"], now["h"])
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
