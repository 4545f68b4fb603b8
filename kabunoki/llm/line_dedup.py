"""Fuzzy deduplication of lines.

A line is normalised to its words. The distinct words are dealt by hash to 2k + 1 classes, or a few more, where k is the
number of edits that similar lines of that length may have; each class has a SimHash over its words, and these are the
line's blocks. An edit touches two classes at most, so by the pigeonhole principle similar lines keep a class in which
all words are equal, and agree on its SimHash, wherever the edits are. A class of too few words or bytes to tell lines
apart is extended by the classes after it; lines of less than 30 words, whose classes are all so small, have their pairs of
classes as blocks. Of many classes the first POSTED suffice: every one of them survives with a chance of about 0.4. Lines
that agree on a block and have lengths that allow it are candidates; unless they are connected already, a pair is verified by its edit distance over words,
banded, for many pairs at once, unless the parities of its words' counts already differ by more than the edits allow. Of
each connected group of similar lines the first occurrence, by document id and line number, stays; the others are cut
from their documents.

Equal lines are collapsed before anything is compared, so a line that a million documents share is one line. Blocks
travel as sorted differences by range of hash. A similarity of at least ``similarity`` means at most
(1 - similarity) * (words of the longer) edits; two lines of less than 10 words are alike only if equal, at 0.9. Lines are
named by 64-bit hashes of their words: among n different lines about n * n / 2**65 pairs share a name by chance (one among
6 * 10**9 lines), and of such a pair one line would be cut. Words are compared by 24 bits.

Cases: lines without words stay and are compared to none; a document that loses all its words is dropped, one that had
none stays; null texts and rows without id stay as they are; rows that share an id are edited alike; equally early
occurrences of a line (in rows that share an id) are one; a very long line has at most twice POSTED blocks and is compared
whole; a run of Chinese, Japanese or Thai letters is one word, so lines of such scripts are alike only where they have
spaces or punctuation; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import columnar as C
from .graph import HOT, buckets, bundles, by_cell, components, forest, leader_of, merged, verify
from .ngram_join import _SENT, _distinct, _fields, _pairs_of_runs, _rows, bounds, planes, unplanes
from .shared import documents, if_small, in_arrow, inner, quoted, release, width, written

SIMILARITY = 0.9
POSTED = 12  # classes of a line that are blocks
SPARE = 4  # classes by which one may be extended
PAIRED = 2  # levels of lines so short that pairs of classes are blocks
#: Edits that similar lines may have, by level; all lines of a level have as many classes.
LEVELS = np.unique(np.concatenate([np.arange(1, 7), np.floor(8 * 1.28 ** np.arange(70))])).astype(np.int64)
BLOCK = 1_000_000
_LINES = "kind int, line long, doc_id long, line_no int, words binary, ids binary"
WORD_BYTES = 3
PARITY = 512  # bits
REMOVED = inner("removed")
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]")


def lines_of(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(word hashes, first word of each line, words in each line, each line's text, its number in its text, bytes of each
    word)."""
    raw, off = C.buffers(C.lower(texts))
    start, end, text = C.words(raw, off)
    breaks = np.flatnonzero(raw == 10)
    before = np.searchsorted(breaks, start)
    number = before - np.searchsorted(breaks, off[:-1])[text]
    new = np.ones(len(start), bool)
    new[1:] = (before[1:] != before[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return C.span_hashes(raw, start, end), first, np.diff(np.append(first, len(start))), text[first], number[first], end - start


def signatures(word: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of each line's words in order."""
    power, inverse = C._powers(len(word) + 1)
    total = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * power[: len(word)], out=total[1:])
    return C.mix64((total[first + count] - total[first]) * inverse[first] + count.astype(np.uint64))


def blocks(word: np.ndarray, first: np.ndarray, count: np.ndarray, size: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(line, 48-bit block key). A line has the blocks of each level that it may share with a similar line."""
    lines, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    edits = lambda n: np.floor((1 - similarity) * n + 1e-9).astype(np.int64)
    most = edits(np.floor(count / similarity + 1e-9))
    low, high = np.searchsorted(LEVELS, np.maximum(edits(count), 1)), np.searchsorted(LEVELS, most)
    for step in range(int((high - low)[most > 0].max(initial=-1)) + 1):
        which = np.flatnonzero((most > 0) & (low + step <= high))
        at = C.ragged(first[which], count[which])
        some = _Classes(word[at], size[at], count[which], (low + step)[which])
        for line, key in some.blocks():
            lines.append(which[line])
            keys.append(key)
    return np.concatenate(lines), np.concatenate(keys) >> np.uint64(16)


class _Classes:
    """The distinct words of lines, sorted by line and class, with running sums of the counters of their SimHashes."""

    COLUMNS = POSTED + SPARE

    def __init__(self, word: np.ndarray, size: np.ndarray, count: np.ndarray, level: np.ndarray):
        self.level, self.paired = level, level < PAIRED
        self.classes = 2 * LEVELS[level] + 1 + self.paired
        h = C.mix64(word)
        own = (h >> np.uint64(40)) * np.repeat(self.classes, count).astype(np.uint64) >> np.uint64(24)
        keep = own < self.COLUMNS
        line = np.repeat(np.arange(len(count), dtype=np.uint64), count)[keep]
        e = line << np.uint64(44) | own[keep] << np.uint64(39) | (h[keep] & np.uint64(2**33 - 1)) << np.uint64(6) | np.minimum(size[keep], 63).astype(np.uint64)
        e.sort()
        e = e[np.concatenate([[True], e[1:] != e[:-1]])] if len(e) else e  # a word counts once, or a frequent one would decide
        cell = (e >> np.uint64(39)).astype(np.int64)
        cell = (cell >> 5) * self.COLUMNS + (cell & 31)
        ends = np.cumsum(np.bincount(cell, minlength=len(count) * self.COLUMNS))
        self.bound = np.concatenate([np.append(0, ends[self.COLUMNS - 1 :: self.COLUMNS][:-1])[:, None], ends.reshape(-1, self.COLUMNS)], axis=1) if len(count) else np.zeros((0, self.COLUMNS + 1), np.int64)
        x = C.mix64(e >> np.uint64(6) & np.uint64(2**33 - 1))
        # Eight counters of a byte to a number: sums of up to 255 words, as differences of running ones, don't carry over.
        self.sums = np.zeros((len(e) + 1, 8), np.uint64)
        np.cumsum(x[:, None] >> np.arange(8, dtype=np.uint64) & np.uint64(0x0101010101010101), axis=0, out=self.sums[1:])
        self.bytes = np.concatenate([[0], np.cumsum((e & np.uint64(63)).astype(np.int64))])

    def _simhash(self, line: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]], tag: int, words: int = 3, size: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether the spans of words say enough; of those that do the line and the key)."""
        n = sum(b - a for a, b in spans)
        ok = (n >= words) & (sum(self.bytes[b] - self.bytes[a] for a, b in spans) >= size)
        n = n[ok]
        ones = sum(self.sums[b[ok]] - self.sums[a[ok]] for a, b in spans).view(np.uint8).reshape(-1, 64)
        key = np.packbits(ones > (np.minimum(n, 255) >> 1).astype(np.uint8)[:, None], axis=1).view(np.uint64).ravel()
        line = line[ok]
        return ok, line, C.mix64(key ^ C.mix64((self.level[line] << 10 | tag).astype(np.uint64)))

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        bound = self.bound
        for level in np.unique(self.level[self.paired]):
            line = np.flatnonzero(self.level == level)
            m = int(self.classes[line[0]])
            for i in range(m):
                for j in range(i + 1, m):
                    a = [(bound[line, c], bound[line, c + 1]) for c in (i, j)]
                    yield self._simhash(line, a, 512 + 32 * i + j, *((2, 12) if level == 0 else (3, 16)))[1:]
        rest = np.flatnonzero(~self.paired)
        for i in range(POSTED):
            line = rest[self.classes[rest] > i]
            line = line[bound[line, i + 1] > bound[line, i]]
            for end in range(i + 1, i + 1 + SPARE):
                over = end - self.classes[line]  # classes from the first on, after the last
                fits = (over <= 0) | (self.classes[line] <= self.COLUMNS) & (over < i)
                line, over = line[fits], np.maximum(over[fits], 0)
                if not len(line):
                    break
                around = [(bound[line, 0], bound[line, over])] if over.any() else []
                ok, own, key = self._simhash(line, [(bound[line, i], bound[line, np.minimum(end, self.classes[line])]), *around], i)
                yield own, key
                line = line[~ok]


class _Block:
    def __init__(self, parts: int, similarity: float):
        self.parts, self.similarity = parts, similarity
        self.clear()

    def clear(self) -> None:
        self.entries, self.signs, self.sizes, self.places, self.words, self.count, self.lines = [], [], [], [], [], 0, 0

    def add(self, ids: np.ndarray, texts: pa.Array) -> None:
        word, first, count, text, number, length = lines_of(texts)
        if not len(first):
            return
        sign = signatures(word, first, count)
        line, key = blocks(word, first, count, length, self.similarity)
        self.entries.append((key, line + self.lines))
        self.signs.append(sign)
        self.sizes.append(count.astype(np.int32))
        self.places.append((ids[text], number.astype(np.int32)))
        self.words.append((word & np.uint64(2 ** (8 * WORD_BYTES) - 1)).astype(np.uint32))
        self.count += len(word)
        self.lines += len(first)

    def rows(self) -> pa.RecordBatch | None:
        if not self.lines:
            return None
        sign, size, words = (np.concatenate(x) for x in (self.signs, self.sizes, self.words))
        ids, number = (np.concatenate(x) for x in zip(*self.places))
        key, line = (np.concatenate(x) for x in zip(*self.entries))
        every, rep, back = np.unique(sign, return_index=True, return_inverse=True)
        # Lines go by the rank of their signature; equal ones in the block are one.
        key, ref = _distinct(key, back[line])
        cut = np.concatenate([[0], np.searchsorted(key, bounds(self.parts)), [len(key)]])
        out = []
        for p in range(self.parts):
            k, r = key[cut[p] : cut[p + 1]], ref[cut[p] : cut[p + 1]]
            if len(k):
                out.append((p, 0, C.pack(k), every[r].tobytes(), planes(size[rep[r]])))
        home = (sign % np.uint64(self.parts)).astype(np.int64)
        order = np.lexsort((number, ids, sign, home))
        cut = np.searchsorted(home[order], np.arange(self.parts + 1))
        at = np.cumsum(size) - size
        raw = words.view(np.uint8).reshape(-1, 4)[:, :WORD_BYTES]
        for p in range(self.parts):
            o = order[cut[p] : cut[p + 1]]
            if not len(o):
                continue
            s = sign[o]
            one = o[np.concatenate([[True], s[1:] != s[:-1]])]
            body = raw[C.ragged(at[one].astype(np.int64), size[one].astype(np.int64))].tobytes()
            out.append((p, 1, planes(ids[o]) + planes(number[o]), s.tobytes(), planes(size[one]) + body))
        self.clear()
        return _rows(out)


def _spread(batches: Iterator[pa.RecordBatch], parts: int, similarity: float) -> Iterator[pa.RecordBatch]:
    block = _Block(parts, similarity)
    for b in batches:
        ids = b.column(0).to_numpy()
        for at, some in C.chunks(b.column(1)):
            block.add(ids[at : at + len(some)], some)
            if block.count >= BLOCK:
                yield block.rows()
    if (last := block.rows()) is not None:
        yield last


def _meet(batches: Iterator[pa.RecordBatch], similarity: float, count: int, hot: int) -> Iterator[pa.RecordBatch]:
    """kind 0: candidate pairs by cell, of lines that agree on a block here (line is the cell, words the pairs); 1:
    occurrences of the lines that belong here; 2: the words of each; 3: the lines of a block that more than ``hot`` have
    (line is their leader)."""
    keys, signs, sizes = [], [], []
    sent: set[int] = set()
    for kind, a, b, c in _fields(batches):
        s = np.frombuffer(b, np.uint64)
        if kind == 0:
            keys.append(C.unpack(a))
            signs.append(s)
            sizes.append(unplanes(c, np.int32))
            continue
        s = s.view(np.int64)
        yield _out(1, s, unplanes(a[: 8 * len(s)], np.int64), unplanes(a[8 * len(s) :], np.int32), None, None)
        one = s[np.concatenate([[True], s[1:] != s[:-1]])]
        size = unplanes(c[: 4 * len(one)], np.int32).astype(np.int64)
        stop = (4 * len(one) + np.cumsum(size) * WORD_BYTES).tolist()
        new = [k for k, x in enumerate(one.tolist()) if x not in sent]
        sent.update(one[new].tolist())
        if new:
            yield _out(2, one[new], None, None, [c[stop[k] - int(size[k]) * WORD_BYTES : stop[k]] for k in new], None)
    if not keys:
        return
    every, first, ref = np.unique(np.concatenate(signs), return_index=True, return_inverse=True)
    size = np.concatenate(sizes)[first].astype(np.int64)
    # Ranked by length, so that within a block the partners of a line that may be long enough follow it.
    order = np.argsort(size, kind="stable")
    every, size = every[order], size[order]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key, ref = _distinct(np.concatenate(keys), rank[ref])
    _, run, length = np.unique(key, return_index=True, return_counts=True)
    many: dict[int, list[np.ndarray]] = {}
    for k in np.flatnonzero(length > hot).tolist():
        some = every[ref[run[k] : run[k] + length[k]]].view(np.int64)
        many.setdefault(leader_of(some), []).append(some)
    for leader, some in many.items():
        yield _out(3, np.array([leader], np.int64), None, None, None, [np.unique(np.concatenate(some)).tobytes()])
    inside = np.flatnonzero((length > 1) & (length <= hot))
    keep = C.ragged(run[inside], length[inside])
    ref = ref[keep]
    stop = np.repeat(np.cumsum(length[inside]), length[inside])
    # The longest partner of n words has floor(n / similarity): within a run, sizes ascend.
    start = np.arange(len(ref))
    runs = np.repeat(np.arange(len(inside)), length[inside])
    if len(ref):
        most = int(size[-1]) + 2
        place = runs * most + size[ref]
        stop = np.minimum(stop, np.searchsorted(place, runs * most + np.minimum(np.floor(size[ref] / similarity + 1e-9).astype(np.int64), most - 1), "right"))
    found, held = [], 4_000_000
    for i, j in _pairs_of_runs(start, stop):
        found.append(np.unique(ref[i].astype(np.uint64) << np.uint64(32) | ref[j].astype(np.uint64)))
        if sum(map(len, found)) > held:
            found, held = merged(found, held)
    if not found:
        return
    pairs = np.unique(np.concatenate(found))
    a, b = every[(pairs >> np.uint64(32)).astype(np.int64)].view(np.int64), every[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)].view(np.int64)
    for cell, p, i in by_cell(a, b, count):
        yield _out(0, np.array([cell], np.int64), None, None, [p], [i])


def _out(kind: int, line: np.ndarray, doc: np.ndarray | None, number: np.ndarray | None, words: list | None, ids: list | None) -> pa.RecordBatch:
    n = len(line)
    return pa.record_batch(
        {
            "kind": np.full(n, kind, np.int32), "line": line, "doc_id": pa.nulls(n, pa.int64()) if doc is None else doc,
            "line_no": pa.nulls(n, pa.int32()) if number is None else number, "words": pa.nulls(n, pa.binary()) if words is None else pa.array(words, pa.binary()),
            "ids": pa.nulls(n, pa.binary()) if ids is None else pa.array(ids, pa.binary()),
        }
    )


def edit_distances(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, limit: int) -> np.ndarray:
    """Edit distances over words of rows of ``a`` and ``b`` (padded by different negative numbers), exact up to ``limit``
    and more than it beyond; bands of 2 * limit + 1."""
    rows, span, far = len(a), 2 * limit + 1, limit + 1
    wide = np.full((rows, b.shape[1] + 2 * limit + 2), -3, b.dtype)
    wide[:, limit : limit + b.shape[1]] = b
    shift = np.arange(span, dtype=np.int32)
    # Cell k of a band in row i is column i + k - limit of the matrix.
    d = np.where(shift >= limit, shift - limit, far).astype(np.int32)[None, :].repeat(rows, 0)
    out = np.full(rows, far, np.int32)
    done = na == 0
    out[done] = np.minimum(nb[done], far)
    for i in range(1, int(na.max(initial=0)) + 1):
        cost = wide[:, i - 1 : i - 1 + span] != a[:, i - 1 : i]
        t = d + cost
        t[:, :-1] = np.minimum(t[:, :-1], d[:, 1:] + 1)
        if i <= limit:
            t[:, : limit - i] = far + limit
            t[:, limit - i] = i
        d = np.minimum(np.minimum.accumulate(t - shift, axis=1) + shift, far + limit)
        end = np.flatnonzero(na == i)
        if len(end):
            k = nb[end] - i + limit
            ok = (k >= 0) & (k < span)
            out[end[ok]] = np.minimum(d[end[ok], k[ok]], far)
    return out


def parities(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows of PARITY bits: of the words that fall to a bit, whether the line has an odd number. An edit turns at most
    two bits."""
    bit = (C.mix64(word.astype(np.uint64)) % np.uint64(PARITY)).astype(np.int64)
    out = np.zeros((len(n), PARITY // 64), np.uint64)
    np.bitwise_xor.at(out, (np.repeat(np.arange(len(n)), n), bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


def _alike(similarity: float):
    def kernel(ids: np.ndarray, a: np.ndarray, b: np.ndarray, lines: pa.Table, leader: int) -> pa.Table:
        parts = [x.as_py() for x in lines["words"]]
        n = np.array([len(x) // WORD_BYTES for x in parts], np.int64)
        at = np.cumsum(n) - n
        raw = np.zeros((int(n.sum()), 4), np.uint8)
        raw[:, :WORD_BYTES] = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, WORD_BYTES)
        word = raw.view(np.uint32).ravel().astype(np.int64)
        odd = parities(word, n)
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        label = np.arange(len(ids))
        for p, q in _across(a, b) if leader else ((a[i : i + 200_000], b[i : i + 200_000]) for i in range(0, len(a), 200_000)):
            apart = label[p] != label[q]
            p, q = p[apart], q[apart]
            limit = np.floor((1 - similarity) * np.maximum(n[p], n[q]) + 1e-9).astype(np.int64)
            gap = np.abs(n[p] - n[q])
            some = gap <= limit
            p, q, limit, gap = p[some], q[some], limit[some], gap[some]
            spare = 2 * limit - gap - np.bitwise_count(odd[p] ^ odd[q]).sum(axis=1, dtype=np.int64)
            order = np.argsort(-spare, kind="stable")[: int((spare >= 0).sum())]
            p, q, limit = p[order], q[order], limit[order]
            # First one partner of each group, on either side, then twice as many each time: mostly few connect the rest.
            tries = 1
            while len(p):
                now = (_places(label[p]) < tries) | (_places(label[q]) < tries)
                good = np.flatnonzero(now)
                good = good[_within(word, at, n, p[good], q[good], limit[good])]
                if len(good):
                    x.append(p[good])
                    y.append(q[good])
                    node, root = forest(len(ids), np.concatenate(x), np.concatenate(y))
                    x, y = [node], [root]
                    label[node] = root
                left = ~now & (label[p] != label[q])
                p, q, limit = p[left], q[left], limit[left]
                tries *= 2
        return pa.table({"a": ids[x[0]], "b": ids[y[0]]})

    return kernel


def _places(x: np.ndarray) -> np.ndarray:
    """The place of each number among those equal to it."""
    order = np.argsort(x, kind="stable")
    run = np.flatnonzero(np.concatenate([[True], x[order][1:] != x[order][:-1]]))
    out = np.empty(len(x), np.int64)
    out[order] = C.ragged(np.zeros(len(run), np.int64), np.diff(np.append(run, len(x))))
    return out


def _across(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (x, y), x < y, of two arrays of places; first those of few x, to connect most lines early."""
    lo = 0
    while lo < len(a):
        some = a[lo : lo + min(max(1, lo), max(1, 400_000 // len(b)))]
        lo += len(some)
        x, y = np.repeat(some, len(b)), np.tile(b, len(some))
        yield x[x < y], y[x < y]


def _within(word: np.ndarray, at: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair of lines is at most its limit."""
    longest = np.maximum(n[a], n[b])
    good = np.zeros(len(a), bool)
    order = np.lexsort((longest, limit))
    lo = 0
    while lo < len(order):
        k = int(limit[order[lo]])
        hi = int(np.searchsorted(limit[order], k, "right"))
        most = max(1, int(4_000_000 // max(1, (2 * k + 1 + int(longest[order[hi - 1]])))))
        o = order[lo : min(hi, lo + most)]
        lo += len(o)
        w = int(longest[o].max())
        pa_, pb = np.full((len(o), w), -1, np.int32), np.full((len(o), w), -2, np.int32)
        for m, x in ((pa_, a[o]), (pb, b[o])):
            row = np.repeat(np.arange(len(o)), n[x])
            m[row, C.ragged(np.zeros(len(o), np.int64), n[x])] = word[C.ragged(at[x], n[x])]
        good[o] = edit_distances(pa_, pb, n[a[o]], n[b[o]], k) <= k
    return good


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, line_no) of the lines that go: all but the first of each connected group of similar lines."""
    spark = docs.sparkSession
    parts, count = width(spark), buckets(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    sent = in_arrow(base, lambda bs: _spread(bs, parts, similarity), _SENT).repartitionById(parts, "part")
    table = written(in_arrow(sent, lambda bs: _meet(bs, similarity, count, hot), _LINES), "lines")
    del sent
    release(spark)
    cells = table.where("kind = 0").select(F.col("line").alias("cell"), F.col("words").alias("pairs"), "ids")
    cells = written(cells.union(bundles(table.where("kind = 3").select(F.col("line").alias("leader"), "ids"))), "line-cells")
    payload = table.where("kind = 2").select(F.col("line").alias("id"), "words")
    roots = components(verify(cells, payload, _alike(similarity), "a long, b long"))
    release(spark)
    every = table.where("kind = 1").select("line", "doc_id", "line_no").distinct()
    named = every.join(roots, every["line"] == roots["node"], "left").select(F.coalesce("root", "line").alias("root"), F.struct("doc_id", "line_no").alias("at"))
    first = named.groupBy("root").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    return named.join(first, "root").where("at <> first").select("at.doc_id", "at.line_no")


def cut_lines(docs: DataFrame, lines: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without these lines, and without documents that lose all their words."""
    schema = T.StructType(list(docs.schema.fields))
    at, names = docs.columns.index(text_col), docs.columns
    gone = written(lines.groupBy(F.col("doc_id").alias(inner("id"))).agg(F.collect_list("line_no").alias(REMOVED)), "lines-gone")
    joined = docs.join(if_small(gone, F.size(REMOVED)), docs[id_col].cast("long") == F.col(inner("id")), "left").select(*[docs[quoted(c)] for c in names], REMOVED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            removed = columns.pop()
            which = np.flatnonzero(np.asarray(removed.is_valid()))
            keep = np.ones(b.num_rows, bool)
            mask, new = np.zeros(b.num_rows, bool), []
            for k in which.tolist():
                drop = set(removed[k].as_py())
                text = "\n".join(x for i, x in enumerate(columns[at][k].as_py().split("\n")) if i not in drop)
                if WORD.search(text):
                    mask[k] = True
                    new.append(text)
                else:
                    keep[k] = False
            if new:
                columns[at] = pa.compute.replace_with_mask(columns[at], pa.array(mask), pa.array(new, columns[at].type))
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return in_arrow(joined, run, schema)


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return cut_lines(docs, repeated_lines(docs, similarity, id_col, text_col), id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir))
