"""All pairs of documents whose sets of word n-grams have a Jaccard similarity of at least a threshold, by a grouped
prefix join with global frequency order.

The n-grams are put in order of the number of documents that have them, the rarest first; in that order two sets of the
wanted similarity share an n-gram among the first |S| - ceil(t |S|) + 1 of each. Most documents drop out here: n-grams
that no other document has come first, and when they fill a set's prefix, it has no partner. Documents with equal sets
become one set. Sets with identical prefixes and size form a group; pairs of groups that share a prefix n-gram pass the
length and positional filters, are expanded into pairs of sets, verified by counting common n-grams, and expanded into
documents.

Counting needs every n-gram of the corpus to meet its equals once. They travel in blocks, to ranges of hash, as sorted
differences with the place of their document in its block: about six bytes each, however many ranges there are. Only
n-grams of two documents or more travel back, to their block's home; signatures of whole sets travel once, and tell
there which documents are copies. A block is named by its partition and number, so a task that is repeated must see its
rows in the same order: inputs that come out of a shuffle are written first.

N-grams are 48-bit hashes: of two documents with a and b n-grams, one that only seems common has a chance of about
a * b / 2**48 (less than 10**-8 for 1,600 n-grams each; 10**-6 for 20,000, which changes the similarity by 1 in 20,000).
Copies are told by 128-bit signatures. Else counts and candidates are exact over the whole corpus; there are no limits on
partners. (Counts over 65,535 are equal in the order, which stays a total one.)

An n-gram that more than HOT sets have in their prefix is not expanded into pairs: these sets go as a bundle, in chunks, to
cells where all pairs of two chunks are counted at once; n-grams of nearly the same sets make one bundle. A pair counts in
the first of its bundles, or else in its cell. The query gives a row for each document, with its class (the least id of
its connected group) and the number of its links; ``join`` lists the pairs, of which a group of c copies has c (c - 1) / 2.

Cases: documents without words (null, empty) and rows without id are in no pair; one of 1 to n-1 words has one gram, all
of its words; rows that share an id are never a pair, each of their texts is compared, and a pair of ids may so occur
more than once; a very long text is one set of all its n-grams; a run of Chinese, Japanese or Thai letters is one word;
an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import columnar as C
from .graph import HOT, buckets, bundled, by_cell, components, forest, leader_of, merged, united, verify
from .shared import documents, if_small, in_arrow, inner, release, stable, width, written

N = 3
THRESHOLD = 0.5
BLOCK = 1_500_000
KEY = 48
_LOW = np.uint64(2**KEY - 1)
_SENT = "part int, kind int, a binary, b binary, c binary"
_SETS = "kind int, set_id long, doc_id long, gid long, size int, lone int, prefix int, elements binary, docs binary"
_COPY = np.uint64(0x5851F42D4C957F2D)


def _rows(parts: list[tuple]) -> pa.RecordBatch:
    p, k, a, b, c = zip(*parts)
    return pa.record_batch({"part": pa.array(p, pa.int32()), "kind": pa.array(k, pa.int32()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "c": pa.array(c, pa.binary())})


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def unplanes(b: bytes, kind: type = np.uint64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel() if b else np.zeros(0, kind)


def ranges(key: np.ndarray, parts: int) -> np.ndarray:
    """Which of equal ranges of 48-bit keys each falls into."""
    return ((key >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def bounds(parts: int) -> np.ndarray:
    """The least key of each range after the first."""
    return np.array([-(-(p << 32) // parts) << 16 for p in range(1, parts)], np.uint64)


def gram_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of the texts: where they begin, and sorted (text, 48-bit key) of their distinct n-grams."""
    for at, some in C.chunks(texts):
        for lo in range(0, len(some), 60_000):
            part = some.slice(lo, 60_000)
            h, t = C.word_hashes(part)
            g, t = C.ngrams(h, t, n, len(part))
            e = np.unique(t.astype(np.uint64) << np.uint64(KEY) | g >> np.uint64(64 - KEY))
            yield at + lo, (e >> np.uint64(KEY)).astype(np.int64), e & _LOW


class _Block:
    """N-grams of some documents on their way to their ranges. A document is named by its block and place."""

    def __init__(self, parts: int, partition: int):
        self.parts, self.name = parts, (partition << 25) - 1
        self.clear()

    def clear(self) -> None:
        self.entries, self.signs, self.sizes, self.ids, self.count, self.docs = [], [], [], [], 0, 0
        self.name += 1

    def add(self, ids: np.ndarray, text: np.ndarray, key: np.ndarray) -> None:
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        which = text[first]
        size = np.diff(np.append(first, len(text)))
        self.signs.append(np.stack([C.mix64(np.add.reduceat(C.mix64(key ^ salt), first) + size.astype(np.uint64)) for salt in (np.uint64(0), _COPY)], 1))
        self.sizes.append(size.astype(np.int32))
        self.ids.append(ids[which])
        local = np.repeat(np.arange(self.docs, self.docs + len(which), dtype=np.uint64), size)
        self.entries.append(key << np.uint64(16) | local)
        self.docs += len(which)
        self.count += len(key)

    def rows(self) -> pa.RecordBatch | None:
        """kind 0: n-grams with the places of their documents, to their range; 1: ids and names by signature, to the
        signature's home; 2: sizes and ids, to the block's home."""
        if not self.docs:
            return None
        sign, size, ids = (np.concatenate(x) for x in (self.signs, self.sizes, self.ids))
        e = np.concatenate(self.entries)
        order = np.lexsort((sign[:, 1], sign[:, 0]))
        new = np.concatenate([[True], (sign[order][1:] != sign[order][:-1]).any(axis=1)])
        of = np.empty(self.docs, np.int64)
        of[order] = order[new][np.cumsum(new) - 1]
        if not new.all():  # copies within the block are sent once
            local = (e & np.uint64(0xFFFF)).astype(np.int64)
            e = e[of[local] == local]
        e.sort()
        cut = np.concatenate([[0], np.searchsorted(e, bounds(self.parts) << np.uint64(16)), [len(e)]])
        name = np.array([self.name], np.int64).tobytes()
        docs = np.array([self.docs], np.int64).tobytes()
        out = [(p, 0, C.pack(e[cut[p] : cut[p + 1]]), name, docs) for p in np.flatnonzero(np.diff(cut)).tolist()]
        home = (sign[:, 0] % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        cut = np.searchsorted(home[order], np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(cut)).tolist():
            o = order[cut[p] : cut[p + 1]]
            out.append((p, 1, planes(ids[o]), sign[o].tobytes(), planes(self.name << 16 | of[o])))
        out.append((_home(self.name, self.parts), 2, planes(size), name, planes(ids)))
        self.clear()
        return _rows(out)


def _home(block: int, parts: int) -> int:
    return int(C.mix64(np.array([block], np.uint64))[0] % np.uint64(parts))


def _spread(batches: Iterator[pa.RecordBatch], n: int, parts: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    block = _Block(parts, task.partitionId() if task else 0)
    for b in batches:
        ids = b.column(0).to_numpy()
        for at, text, key in gram_sets(b.column(1), n):
            if not len(text):
                continue
            if block.docs + int(text[-1]) + 1 > 65_535:
                yield block.rows()
            block.add(ids[at:], text, key)
            if block.count >= BLOCK:
                yield block.rows()
    if (last := block.rows()) is not None:
        yield last


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    for b in batches:
        for k, x, y, z in zip(b.column("kind"), b.column("a"), b.column("b"), b.column("c")):
            yield k.as_py(), x.as_py(), y.as_py(), z.as_py()


def _distinct(key: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (key, ref), sorted."""
    if not len(key):
        return key, ref
    low = int(key.min())
    bits = max(1, int(ref.max()).bit_length())
    if int(key.max() - np.uint64(low)).bit_length() + bits <= 64:
        e = (key - np.uint64(low)) << np.uint64(bits) | ref.astype(np.uint64)
        e.sort()
        e = e[np.concatenate([[True], e[1:] != e[:-1]])]
        return (e >> np.uint64(bits)) + np.uint64(low), (e & np.uint64((1 << bits) - 1)).astype(np.int64)
    order = np.lexsort((ref, key))
    key, ref = key[order], ref[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (ref[1:] != ref[:-1])])
    return key[new], ref[new]


def _count(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Of one range: n-grams of two documents or more, with their counts, to the homes of their blocks (kind 0). Of the
    signatures that belong here: groups of copies (1), and to the homes of their blocks which documents stand for a group
    and which are left out (3). Sizes and ids (2) go on as they are."""
    keys, refs, blocks, base = [], [], [], [0]
    members: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for kind, a, b, c in _fields(batches):
        if kind == 1:
            members.append((unplanes(a, np.int64), np.frombuffer(b, np.uint64).reshape(-1, 2), unplanes(c, np.int64)))
        elif kind == 2:
            yield _rows([(_home(int(np.frombuffer(b, np.int64)[0]), parts), 2, a, b, c)])
        else:
            e = C.unpack(a)
            keys.append(e >> np.uint64(16))
            refs.append((e & np.uint64(0xFFFF)).astype(np.int64) + base[-1])
            blocks.append(int(np.frombuffer(b, np.int64)[0]))
            base.append(base[-1] + int(np.frombuffer(c, np.int64)[0]))
    if members:
        yield from _copies(*(np.concatenate(x) for x in zip(*members)), parts)
    if not keys:
        return
    key, ref = _distinct(np.concatenate(keys), np.concatenate(refs))
    del keys, refs
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(start, len(key)))
    count = np.repeat(count, count)
    keep = count > 1
    key, ref, count = key[keep], ref[keep], np.minimum(count[keep], 65_535).astype(np.uint16)
    at = np.array(base)
    block = (np.searchsorted(at, ref, "right") - 1).astype(np.int32)
    order = np.argsort(block, kind="stable")
    cut = np.searchsorted(block[order], np.arange(len(blocks) + 1))
    out = []
    for k, name in enumerate(blocks):
        o = order[cut[k] : cut[k + 1]]
        if len(o):
            local = (ref[o] - at[k]).astype(np.uint16)
            out.append((_home(name, parts), 0, C.pack(key[o]), np.array([name], np.int64).tobytes(), planes(count[o]) + planes(local)))
    if out:
        yield _rows(out)


def _copies(ids: np.ndarray, sign: np.ndarray, name: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((ids, sign[:, 1], sign[:, 0]))
    ids, sign, name = ids[order], sign[order], name[order]
    new = np.concatenate([[True], (sign[1:] != sign[:-1]).any(axis=1)])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(ids)))
    several = np.flatnonzero(n > 1)
    notes: dict[int, tuple[list, list]] = {}
    groups = []
    for g in several.tolist():
        w = slice(first[g], first[g] + n[g])
        docs, names = np.unique(ids[w]), np.unique(name[w])
        if len(docs) > 1:
            groups.append((0, 1, docs.tobytes(), names[:1].tobytes(), b""))
        for k, x in enumerate(names.tolist()):
            note = notes.setdefault(x >> 16, ([], []))
            note[0].append((x & 0xFFFF) | (k > 0) << 16)
            note[1].append(docs if k == 0 else docs[:0])
    out = [(int(np.frombuffer(b, np.int64)[0] % parts), kind, a, b, c) for _, kind, a, b, c in groups]
    for block, (local, docs) in notes.items():
        sizes = np.array([len(d) for d in docs], np.int32)
        out.append((_home(block, parts), 3, planes(np.array(local, np.int32)) + planes(sizes), np.array([block], np.int64).tobytes(), planes(np.concatenate(docs))))
    for lo in range(0, len(out), 10_000):
        yield _rows(out[lo : lo + 10_000])


def _sets(kind: int, n: int, **columns) -> pa.RecordBatch:
    kinds = {"set_id": pa.int64(), "doc_id": pa.int64(), "gid": pa.int64(), "size": pa.int32(), "lone": pa.int32(), "prefix": pa.int32(), "elements": pa.binary(), "docs": pa.binary()}
    return pa.record_batch({"kind": np.full(n, kind, np.int32)} | {k: pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in kinds.items()})


def _assemble(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """kind 0: of the blocks that belong here the sets that can have a partner, with their shared n-grams in order; 1:
    groups of copies."""
    blocks: dict[bytes, tuple[list, list, list]] = {}
    for kind, a, b, c in _fields(batches):
        if kind == 1:
            docs = np.frombuffer(a, np.int64)
            yield _sets(1, 1, set_id=np.frombuffer(b, np.int64), doc_id=docs[:1], docs=[a])
        else:
            blocks.setdefault(b, ([], [], []))[(0, None, 1, 2)[kind]].append((a, c))
    while blocks:
        name, (grams, table, notes) = blocks.popitem()
        size, ids = unplanes(table[0][0], np.int32).astype(np.int64), unplanes(table[0][1], np.int64).copy()
        out, docs = np.zeros(len(size), bool), {}
        for a, c in notes:
            local, n = unplanes(a[: len(a) // 2], np.int32), unplanes(a[len(a) // 2 :], np.int32)
            members, end = unplanes(c, np.int64), np.cumsum(n)
            out[local[local > 0xFFFF] & 0xFFFF] = True
            for k in np.flatnonzero(n).tolist():
                docs[int(local[k])] = members[end[k] - n[k] : end[k]]
                ids[local[k]] = members[end[k] - n[k]]
        if not grams:
            continue
        e = np.concatenate([C.unpack(a) for a, _ in grams])
        count, local = (np.concatenate(x) for x in zip(*(((unplanes(c[: len(c) // 2], np.uint16)), unplanes(c[len(c) // 2 :], np.uint16)) for _, c in grams)))
        e |= count.astype(np.uint64) << np.uint64(KEY)
        shared = np.bincount(local, minlength=len(size))
        need = np.ceil(threshold * size - 1e-9).astype(np.int64)
        live = (shared > 0) & (shared >= need) & ~out
        some = live[local]
        e, local = e[some], local[some]
        order = np.argsort(e)
        order = order[np.argsort(local[order], kind="stable")]
        e = e[order]
        which = np.flatnonzero(live)
        if not len(which):
            continue
        n = shared[which]
        at = np.cumsum(n) - n
        lone = size[which] - n
        prefix = np.clip(size[which] - need[which] + 1 - lone, 0, n)
        # Identical prefixes and sizes make a group; a prefix with an n-gram of its own is like no other.
        h = np.zeros(len(which), np.uint64)
        have = np.flatnonzero(prefix > 0)
        inside = C.ragged(at[have], prefix[have])
        h[have] = np.add.reduceat(C.mix64(e[inside]), np.cumsum(prefix[have]) - prefix[have]) if len(have) else 0
        number = int(np.frombuffer(name, np.int64)[0]) << 16 | which
        group = np.where(lone == 0, C.mix64(h + size[which].astype(np.uint64)), C.mix64(number.astype(np.uint64) ^ _COPY))
        for lo in range(0, len(which), 2000):
            w = slice(lo, lo + 2000)
            yield _sets(
                0, len(which[w]), set_id=number[w], doc_id=ids[which[w]], gid=group[w].view(np.int64), size=size[which[w]].astype(np.int32), lone=lone[w].astype(np.int32), prefix=prefix[w].astype(np.int32),
                elements=[_elements(e[i : i + k]) for i, k in zip(at[w], n[w])], docs=[docs[k].tobytes() if k in docs else None for k in which[w].tolist()],
            )


def _elements(e: np.ndarray) -> bytes:
    """The keys of six bytes, then the counts of two."""
    raw = e.view(np.uint8).reshape(-1, 8)
    return raw[:, :6].tobytes() + raw[:, 6:].tobytes()


def _keys(b: bytes) -> np.ndarray:
    raw = np.zeros((len(b) // 6, 8), np.uint8)
    raw[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return raw.view(np.uint64).ravel()


def _prefix(b: bytes, n: int) -> np.ndarray:
    total = len(b) // 8
    return _keys(b[: 6 * n]) | np.frombuffer(b, np.uint16, n, 6 * total).astype(np.uint64) << np.uint64(KEY)


def _post(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Prefix n-grams of groups, each with its place, to their partitions."""
    for b in batches:
        for lo in range(0, b.num_rows, 4000):
            some = b.slice(lo, 4000)
            group, sets, size, lone, prefix = (some.column(c).to_numpy() for c in ("gid", "set_id", "size", "lone", "prefix"))
            if not prefix.sum():
                continue
            e = np.concatenate([_prefix(x.as_py(), int(k)) for x, k in zip(some.column("elements"), prefix)])
            owner = np.repeat(np.arange(len(group)), prefix)
            place = C.ragged(lone.astype(np.int64), prefix.astype(np.int64))
            home = (C.mix64(e) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            cut = np.searchsorted(home[order], np.arange(parts + 1))
            out = []
            for p in range(parts):
                o = order[cut[p] : cut[p + 1]]
                if len(o):
                    u, back = np.unique(owner[o], return_inverse=True)
                    out.append((p, 0, planes(e[o]), planes(np.stack([back, place[o]], 1).astype(np.int32).ravel()), planes(np.stack([group[u], sets[u], size[u]], 1).ravel())))
            yield _rows(out)


def _pairs_of_runs(start: np.ndarray, stop: np.ndarray, most: int = 3_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j < stop[i], for all i, in pieces."""
    n = np.maximum(stop - start - 1, 0)
    total = np.cumsum(n)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield np.repeat(start[at:to], n[at:to]), C.ragged(start[at:to] + 1, n[at:to])
        at = to


def _partnered(size: np.ndarray, place: np.ndarray, threshold: float) -> np.ndarray:
    """Of groups that share an n-gram, by ascending size: which pass the length and positional filters with any of them,
    itself included."""
    least = threshold / (1 + threshold)
    left = size - place
    value = left - least * size
    best, step = [value], 1  # of as many groups from each on as twice the last
    while 2 * step <= len(size):
        best.append(np.maximum(best[-1][:-step], best[-1][step:]))
        step *= 2
    lo = np.searchsorted(size, threshold * size - 1e-6)
    hi = np.searchsorted(size, np.minimum(size / threshold, left / least - size) + 1e-6, "right")
    ok = hi > lo
    depth = np.log2(np.maximum(hi - lo, 1)).astype(np.int64)
    for k in np.unique(depth[ok]).tolist():
        w = np.flatnonzero(ok & (depth == k))
        ok[w] = np.maximum(best[k][lo[w]], best[k][hi[w] - 2**k]) >= least * size[w] - 1e-6
    return ok


def _meet(batches: Iterator[pa.RecordBatch], threshold: float, parts: int, count: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Pairs of groups that share a prefix n-gram here and pass the length and positional filters, expanded into pairs
    of sets, to their cells; and the pairs of sets within the groups whose first n-gram is here. Where these are more than
    ``hot`` sets, they go as a bundle to their leader."""
    es, owners, places, names, base = [], [], [], [], 0
    for _, a, b, c in _fields(batches):
        es.append(unplanes(a))
        two = unplanes(b, np.int32).reshape(-1, 2)
        owners.append(two[:, 0].astype(np.int64) + base)
        places.append(two[:, 1].astype(np.int64))
        names.append(unplanes(c, np.int64).reshape(-1, 3))
        base += len(names[-1])
    if not es:
        return
    info = np.concatenate(names)
    _, first, back = np.unique(info[:, 0], return_index=True, return_inverse=True)
    size = info[first, 2]
    e, o, place = np.concatenate(es), back[np.concatenate(owners)], np.concatenate(places)
    order = np.lexsort((o, size[o], e))
    e, o, place = e[order], o[order], place[order]
    new = np.concatenate([[True], (e[1:] != e[:-1]) | (o[1:] != o[:-1])])
    e, o, place = e[new], o[new], place[new]
    # Sets by group; one that was posted in several rows counts once.
    member = np.unique(np.stack([back, info[:, 1]], 1), axis=0)
    start = np.searchsorted(member[:, 0], np.arange(len(first) + 1))
    n = np.diff(start)
    at_home = np.unique(o[place == 0])
    many: dict[int, list[np.ndarray]] = {}

    def bundle(groups: np.ndarray) -> None:
        sets = member[C.ragged(start[groups], n[groups]), 1]
        many.setdefault(leader_of(sets), []).append(sets)

    for g in at_home[n[at_home] > hot].tolist():
        bundle(np.array([g]))
    at_home = at_home[n[at_home] <= hot]
    run = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
    length = np.diff(np.append(run, len(e)))
    cold = np.ones(len(e), bool)
    for k in np.flatnonzero(np.add.reduceat(n[o], run) > hot).tolist():
        w = np.arange(run[k], run[k] + length[k])
        useful = _partnered(size[o[w]], place[w], threshold)
        cold[w[~useful]] = False
        w = w[useful]
        if n[o[w]].sum() > hot:
            cold[w] = False
            bundle(o[w])
    for leader, some in many.items():
        yield _rows([(leader % parts, leader, b"", np.unique(np.concatenate(some)).tobytes(), b"bundle")])
    e, o, place = e[cold], o[cold], place[cold]
    run = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]])) if len(e) else np.zeros(0, np.int64)
    length = np.diff(np.append(run, len(e)))
    s = size[o]
    found, held = [np.zeros(0, np.uint64)], 4_000_000
    stop = np.repeat(run + length, length)
    for i, j in _pairs_of_runs(np.arange(len(e)), stop):
        x, y = s[i], s[j]
        least = np.ceil(threshold / (1 + threshold) * (x + y) - 1e-9)
        ok = (x >= threshold * y - 1e-9) & (1 + np.minimum(x - place[i] - 1, y - place[j] - 1) >= least)
        a, b = o[i[ok]], o[j[ok]]
        found.append(np.unique(np.minimum(a, b).astype(np.uint64) << np.uint64(32) | np.maximum(a, b).astype(np.uint64)))
        if sum(map(len, found)) > held:
            found, held = merged(found, held)
    pairs = np.unique(np.concatenate(found))
    ga, gb = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ga, gb = np.concatenate([ga, at_home]), np.concatenate([gb, at_home])
    for lo in range(0, len(ga), 1_000_000):
        x, y = ga[lo : lo + 1_000_000], gb[lo : lo + 1_000_000]
        left = C.ragged(start[x], n[x])
        times = np.repeat(n[y], n[x])
        a, b = np.repeat(member[left, 1], times), member[C.ragged(np.repeat(start[y], n[x]), times), 1]
        some = a != b
        out = [(cell % parts, cell, p, i, b"") for cell, p, i in by_cell(a[some], b[some], count)]
        if out:
            yield _rows(out)


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    many = []

    def listed() -> Iterator[tuple[int, bytes, bytes]]:
        for k, a, b, c in _fields(batches):
            if c:
                many.append((k, b))
            else:
                yield k, a, b

    for some in (united(listed()), bundled(many)):
        for cell, pairs, ids in some:
            yield pa.record_batch({"cell": pa.array([cell], pa.int64()), "pairs": pa.array([pairs], pa.binary()), "ids": pa.array([ids], pa.binary())})


def _both(row: np.ndarray, name: np.ndarray, rows: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which pair, name) of the names, of 32 bits, that both rows of a pair have."""
    key = np.unique(row.astype(np.int64) << 32 | name)
    count = np.bincount(key >> 32, minlength=rows)
    first = np.cumsum(count) - count
    some = np.flatnonzero((count[a] > 0) & (count[b] > 0))
    for lo in range(0, len(some), 500_000):
        p = some[lo : lo + 500_000]
        k = count[a[p]]
        own = key[C.ragged(first[a[p]], k)] & 0xFFFFFFFF
        want = np.repeat(b[p], k) << 32 | own
        hit = key[np.minimum(np.searchsorted(key, want), len(key) - 1)] == want
        yield np.repeat(p, k)[hit], own[hit]


def _overlaps(gram: np.ndarray, at: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many n-grams each set of ``a`` has in common with each of ``b``: products of matrices for those that many sets
    have, pair by pair for the others."""
    out = np.zeros((len(a), len(b)), np.float32)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    run = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    length = np.diff(np.append(run, len(gram)))
    few = np.flatnonzero((length > 1) & (length < 32))
    who = owner[C.ragged(run[few], length[few])]
    for i, j in _pairs_of_runs(np.arange(len(who)), np.repeat(np.cumsum(length[few]), length[few])):
        x, y = who[i], who[j] - b[0]  # owners ascend
        ok = (x < len(a)) & (y >= 0)
        out += np.bincount(x[ok] * len(b) + y[ok], minlength=out.size).reshape(out.shape).astype(np.float32)
    often = np.flatnonzero(length >= 32)
    for lo in range(0, len(often), 1024):
        w = often[lo : lo + 1024]
        m = np.zeros((len(n), len(w)), np.float32)
        m[owner[C.ragged(run[w], length[w])], np.repeat(np.arange(len(w)), length[w])] = 1
        out += m[a] @ m[b].T
    return out


def _common(threshold: float, mode: str):
    """Of similar sets, by ``mode``: "pairs" of documents, with the similarity; "connect": a forest of the sets' documents;
    "links": that (kind 0), how many documents of others each set is similar to (1: set, number), and what that counts
    too much for documents of several sets (2)."""

    def kernel(ids: np.ndarray, a: np.ndarray, b: np.ndarray, sets: pa.Table, leader: int) -> pa.Table:
        parts = [_keys(x.as_py()) for x in sets["elements"]]
        doc = sets["doc_id"].to_numpy()
        size = sets["size"].to_numpy().astype(np.int64)
        _, dense = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.array([len(x) for x in parts])
        at = np.cumsum(n) - n
        if leader:
            common = _overlaps(dense, at, n, a, b).astype(np.float64)
            j = common / (size[a][:, None] + size[b] - common)
            x, y = np.nonzero((j >= threshold) & (a[:, None] < b))
            a, b, j = a[x], b[y], j[x, y]
        else:
            mark = np.zeros(int(dense.max()) + 1, bool)
            common = np.zeros(len(a), np.int64)
            cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]]))
            for lo, hi in zip(cut[:-1], cut[1:]):
                own = dense[at[a[lo]] : at[a[lo]] + n[a[lo]]]
                mark[own] = True
                for k in range(lo, hi, 2000):
                    o = b[k : min(k + 2000, hi)]
                    hits = mark[dense[C.ragged(at[o], n[o])]]
                    common[k : k + len(o)] = np.add.reduceat(hits, np.cumsum(n[o]) - n[o], dtype=np.int64)
                mark[own] = False
            j = common / (size[a] + size[b] - common)
            ok = j >= threshold
            a, b, j = a[ok], b[ok], j[ok]
        node, root = forest(len(ids), a, b) if mode != "pairs" else (a[:0], a[:0])
        if mode == "connect":
            return pa.table({"a": doc[node], "b": doc[root]})
        # A pair counts in the first of its bundles, and in its cell only if it has none.
        cells = sets["cells"].combine_chunks()
        row = np.repeat(np.arange(len(ids)), pa.compute.list_value_length(cells).to_numpy())
        name = cells.flatten().to_numpy() >> 32
        earlier = (name > 0) & ((name < leader) | (leader == 0))
        first = np.ones(len(a), bool)
        for p, _ in _both(row[earlier], name[earlier], len(ids), a, b):
            first[p] = False
        a, b, j = a[first], b[first], j[first]
        docs = [np.frombuffer(x.as_py(), np.int64) if x.is_valid else doc[k : k + 1] for k, x in enumerate(sets["docs"])]
        flat, m = np.concatenate(docs), np.array([len(x) for x in docs])
        if mode == "links":
            links = np.bincount(a, m[b], len(ids)) + np.bincount(b, m[a], len(ids))
            some = np.flatnonzero(links)
            every, back, times = np.unique(flat, return_inverse=True, return_counts=True)
            again = times[back] > 1
            twice = [every[:0], *(every[d] for _, d in _both(np.repeat(np.arange(len(ids)), m)[again], back[again], len(ids), a, b))]
            twice = np.concatenate(twice)
            zero = np.zeros_like
            return pa.table(
                {
                    "kind": np.repeat(np.array([0, 1, 2], np.int32), [len(node), len(some), len(twice)]), "a": np.concatenate([doc[node], ids[some], twice]),
                    "b": np.concatenate([doc[root], zero(ids[some]), zero(twice)]), "n": np.concatenate([zero(doc[node]), links[some].astype(np.int64), zero(twice) - 2]),
                }
            )
        first = np.cumsum(m) - m
        times = np.repeat(m[b], m[a])
        x, y = np.repeat(flat[C.ragged(first[a], m[a])], times), flat[C.ragged(np.repeat(first[b], m[a]), times)]
        j = np.repeat(j, m[a] * m[b])
        other = x != y
        x, y, j = x[other], y[other], j[other]
        return pa.table({"doc_a": np.minimum(x, y), "doc_b": np.maximum(x, y), "jaccard": j})

    return kernel


def _candidates(docs: DataFrame, threshold: float, n: int, id_col: str, text_col: str, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets that may have a partner, as a payload; groups of copies (doc_id: the least, docs); cells of candidate pairs
    of sets)."""
    spark = docs.sparkSession
    parts = width(spark)
    count = buckets(spark)
    base = stable(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL"), "gram-input")
    sent = in_arrow(base, lambda bs: _spread(bs, n, parts), _SENT).repartitionById(parts, "part")
    counted = in_arrow(sent, lambda bs: _count(bs, parts), _SENT).repartitionById(parts, "part")
    table = written(in_arrow(counted, lambda bs: _assemble(bs, threshold), _SETS), "gram-sets")
    del sent, counted
    release(spark)
    sets = table.where("kind = 0")
    met = in_arrow(sets.select("gid", "set_id", "size", "lone", "prefix", "elements"), lambda bs: _post(bs, parts), _SENT).repartitionById(parts, "part")
    met = in_arrow(met, lambda bs: _meet(bs, threshold, parts, count, hot), _SENT).repartitionById(parts, "part")
    cells = written(in_arrow(met, _unite, "cell long, pairs binary, ids binary"), "gram-cells")
    del met
    release(spark)
    # Counting what is common takes the keys alone.
    payload = sets.select(F.col("set_id").alias("id"), "doc_id", "size", F.expr("substring(elements, 1, length(elements) div 8 * 6)").alias("elements"), "docs")
    return payload, table.where("kind = 1").select("doc_id", "docs"), cells


def _pairs_of_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for docs in b.column(1):
            x = np.frombuffer(docs.as_py(), np.int64)
            for i, j in _pairs_of_runs(np.arange(len(x)), np.full(len(x), len(x)), 500_000):
                yield pa.record_batch({"doc_a": x[i], "doc_b": x[j], "jaccard": np.ones(len(i))})


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for least, docs in zip(b.column(0), b.column(1)):
            x = np.frombuffer(docs.as_py(), np.int64)
            yield pa.record_batch({"leader": np.full(len(x), least.as_py(), np.int64), "doc_id": x, "others": np.full(len(x), len(x) - 1)})


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for doc, docs, links in zip(b.column(0), b.column(1), b.column(2)):
            x = np.frombuffer(docs.as_py(), np.int64) if docs.is_valid else np.array([doc.as_py()], np.int64)
            yield pa.record_batch({"doc_id": x, "links": np.full(len(x), links.as_py(), np.int64)})


def join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b."""
    payload, groups, cells = _candidates(docs, threshold, n, id_col, text_col, hot)
    schema = "doc_a long, doc_b long, jaccard double"
    across = verify(cells, payload, _common(threshold, "pairs"), schema)
    return across.union(in_arrow(groups, _pairs_of_copies, schema)).withColumn("jaccard", F.round("jaccard", 6))


def links(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, class_id, links) for each id: the least id of its connected group of similar ones, and in how many pairs
    of ``join`` it is."""
    payload, groups, cells = _candidates(docs, threshold, n, id_col, text_col, hot)
    found = written(verify(cells, payload, _common(threshold, "links"), "kind int, a long, b long, n long"), "gram-links")
    copies = in_arrow(groups, _members, "leader long, doc_id long, others long")
    roots = components(found.where("kind = 0").select("a", "b").union(copies.select("doc_id", "leader")))
    sets = found.where("kind = 1").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    parts = in_arrow(payload.join(sets, "id").select("doc_id", "docs", "links"), _linked, "doc_id long, links long")
    counted = parts.union(copies.select("doc_id", "others")).union(found.where("kind = 2").select("a", "n")).groupBy("doc_id").agg(F.sum("links").alias("links"))
    every = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    named = every.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(counted, "doc_id", "left")
    return named.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``docs`` with one document, that of the least id, of each connected group of similar ones. Rows without words or
    without id stay; rows that share an id stand or fall together."""
    payload, groups, cells = _candidates(docs, threshold, n, id_col, text_col, hot)
    roots = components(verify(cells, payload.drop("docs"), _common(threshold, "connect"), "a long, b long"))
    copies = in_arrow(groups, _members, "leader long, doc_id long, others long")
    gone = (
        copies.join(roots, copies["leader"] == roots["node"], "left").where(F.col("doc_id") != F.coalesce("root", "leader")).select("doc_id")
        .union(roots.where("node <> root").select("node")).select(F.col("doc_id").alias(inner("gone"))).distinct()
    )
    gone = written(gone, "gram-gone")
    return docs.join(if_small(gone), docs[id_col].cast("long") == F.col(inner("gone")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS t FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 3 THEN [t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] for i in range(1, len(t) - 1)] ELSE [array_to_string(t, ' ')] END) AS gram FROM w WHERE len(t) > 0),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS o FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT unnest([doc_a, doc_b]) AS a, unnest([doc_b, doc_a]) AS b FROM o JOIN s x ON x.doc_id = doc_a JOIN s y ON y.doc_id = doc_b
  WHERE o / (x.n + y.n - o)::DOUBLE >= 0.5),
d AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL),
r AS (SELECT doc_id, doc_id AS class_id FROM d UNION SELECT e.b, r.class_id FROM r JOIN e ON e.a = r.doc_id WHERE r.class_id < e.b)
SELECT d.doc_id, (SELECT min(class_id) FROM r WHERE r.doc_id = d.doc_id) AS class_id, (SELECT count(*) FROM e WHERE e.a = d.doc_id) AS links FROM d
"""
