"""Byte-pair encoding as an automaton over token-labelled arcs.

Compiling. Start with one state that has a loop for each byte. The merges are applied in order; the gadget of a merge
(u, v) splits off the state that is reached by u, takes from it the arc v, and adds arcs labelled uv wherever u and then
v could be walked. Since uv ends in v, the state behind uv is a copy of the one behind v as it then was. What results
accepts exactly one walk per word, the one that the merges would give. Written out it would have the square of the
vocabulary in arcs; it is kept as its gadgets instead: per token the merge that made it, and a table of merges. Whether
the state behind u has the arc t is found by undoing gadgets, latest first: it hasn't if the merge (u, t) came before
the time in question; otherwise, if t is the younger, it has it if it had t's first half when t was made, and if u is the
younger, if the state it was copied from had it.

Encoding. Texts are split into words as the vocabulary's authors did (contractions, letters, digits, other signs, white
space). For each end of a word's prefixes exactly one label leads there from a state reached before; these are found for
all distinct words of a chunk at once, by tables. Decoding writes the labels' bytes one after the other.

Cases: a null or empty text has no tokens; strings that look like special tokens are ordinary text; any Unicode text
round-trips; repeated rows are each encoded; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import columnar as C
from .shared import documents, in_arrow

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
SCHEMA = "doc_id long, n_tokens int, tokens array<int>"
NEVER = np.int32(2**31 - 1)
LONG_WORD = 200
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such vocabularies' files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def character_classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            table[c] = LETTER
        elif k == "N":
            table[c] = NUMBER
    table[_SPACES] = SPACE
    return table


class Table:
    """A map from 64-bit keys to 32-bit values by open addressing, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = left[self.values[slot[left]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        slot = self._slot(keys)
        found = self.values[slot]
        hit = self.keys[slot] == keys
        out = np.where(hit, found, -1)
        rest = np.flatnonzero(~hit & (found != -1))
        for _ in range(self.probes):
            if not len(rest):
                break
            slot[rest] = (slot[rest] + 1) & self.mask
            s = slot[rest]
            hit = self.keys[s] == keys[rest]
            out[rest[hit]] = self.values[s[hit]]
            rest = rest[~hit & (self.values[s] != -1)]
        return out


class Automaton:
    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int, int]], classes: np.ndarray | None = None):
        """tokens: their bytes by id; merges: (left, right, made) in order."""
        n = max(tokens) + 1
        self.rank = np.full(n, -1, np.int32)
        self.left = np.arange(n, dtype=np.int32)
        self.right = np.arange(n, dtype=np.int32)
        for k, (u, v, w) in enumerate(merges):
            self.rank[w], self.left[w], self.right[w] = k, u, v
        u, v, _ = np.array(merges or [(0, 0, 0)][:0], dtype=np.uint64).reshape(-1, 3).T
        self.merges = Table(u << np.uint64(32) | v, np.arange(len(merges), dtype=np.int32))
        ids = sorted(tokens)
        # A merge whose halves can't follow each other when its turn comes adds no arc: its token is never written.
        proper = np.zeros(n, bool)
        proper[[t for t in ids if len(tokens[t]) == 1]] = True
        order = np.array([w for _, _, w in merges], np.int64)
        met = self._walk(self.left[order], self.right[order], self.rank[order])
        for w, ok in zip(order.tolist(), met.tolist()):
            proper[w] = ok and proper[self.left[w]] and proper[self.right[w]]
        walkable = [t for t in ids if proper[t]]
        self.blob = np.frombuffer(b"".join(tokens.get(t, b"") for t in range(n)), np.uint8)
        self.size = np.array([len(tokens.get(t, b"")) for t in range(n)], np.int64)
        self.at = np.cumsum(self.size) - self.size
        start, end = self.at[walkable], (self.at + self.size)[walkable]
        self.labels = Table(C.span_hashes(self.blob, start, end), np.array(walkable, np.int32))
        self.by_bytes = {tokens[t]: t for t in walkable}
        count = np.bincount(self.size[walkable])
        self.lengths = [k for k in (3, 2, 4, 1, 5, 6, 7) if k < len(count) and count[k]] + [k for k in range(8, len(count)) if count[k]]
        self.classes = character_classes() if classes is None else classes
        self.memo_keys = self.memo = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo_keys": None, "memo": None}

    def _walk(self, u: np.ndarray, t: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether the state behind u has the arc t after all merges, or after those before ``until``."""
        ok = np.ones(len(u), bool)
        live = np.arange(len(u))
        u, t = u.copy(), t.copy()
        limit = np.full(len(u), NEVER, np.int32) if until is None else until
        while len(live):
            m = self.merges.get(u.astype(np.uint64) << np.uint64(32) | t.astype(np.uint64))
            dead = (m >= 0) & (m < limit)
            ok[live[dead]] = False
            ru, rt = self.rank[u], self.rank[t]
            go = ~dead & ((ru >= 0) | (rt >= 0))
            live, u, t, ru, rt = live[go], u[go], t[go], ru[go], rt[go]
            back = ru > rt
            limit = np.where(back, ru, rt + 1)
            u, t = np.where(back, self.right[u], u), np.where(back, t, self.left[t])
        return ok

    def has_arc(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether the state behind token u has an arc labelled t."""
        if self.memo_keys is None:
            self.memo_keys, self.memo = np.full(1 << 21, -1, np.int64), np.zeros(1 << 21, bool)
        key = u.astype(np.int64) << 32 | t
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
        out = self.memo[slot]
        miss = np.flatnonzero(self.memo_keys[slot] != key)
        if len(miss):
            some, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            got = self._walk(u[miss[first]], t[miss[first]])
            out[miss] = got[back]
            s = slot[miss[first]]
            self.memo_keys[s], self.memo[s] = some, got
        return out

    def encode_word(self, word: bytes) -> list[int]:
        """One word, step by step; for words that are too long for the tables."""
        last = np.zeros(len(word) + 1, np.int32)
        for e in range(1, len(word) + 1):
            for k in self.lengths:
                if k > e or (t := self.by_bytes.get(word[e - k : e])) is None:
                    continue
                if k == e or self.has_arc(last[e - k : e - k + 1], np.array([t], np.int32))[0]:
                    last[e] = t
                    break
        out, e = [], len(word)
        while e:
            out.append(int(last[e]))
            e -= int(self.size[last[e]])
        return out[::-1]

    def encode_words(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words one after the other, how many each has)."""
        size = end - start
        order = np.argsort(-size, kind="stable")
        long = int(np.searchsorted(-size[order], -LONG_WORD))
        by_hand = {int(w): self.encode_word(raw[start[w] : end[w]].tobytes()) for w in order[:long]}
        order = order[long:]
        s, n = start[order], size[order]
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        power, inverse = C._powers(len(raw) + 1)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        longest = int(n[0]) if len(n) else 0
        last = np.zeros((longest + 1, len(order)), np.int32)
        for e in range(1, longest + 1):
            todo = np.arange(int(np.searchsorted(-n, -e, "right")))
            for k in self.lengths:
                if k > e:
                    continue
                if not len(todo):
                    break
                a = s[todo] + (e - k)
                t = self.labels.get(C.mix64((total[a + k] - total[a]) * inverse[a] + np.uint64(k)))
                hit = np.flatnonzero(t >= 0)
                if k < e and len(hit):
                    hit = hit[self.has_arc(last[e - k, todo[hit]], t[hit])]
                if len(hit):
                    last[e, todo[hit]] = t[hit]
                    left = np.ones(len(todo), bool)
                    left[hit] = False
                    todo = todo[left]
        count = np.zeros(len(size), np.int64)
        steps, at, live = [], n.copy(), np.arange(len(order))
        while len(live):
            t = last[at[live], live]
            steps.append((live, t))
            count[order[live]] += 1
            at[live] -= self.size[t]
            live = live[at[live] > 0]
        for w, tokens in by_hand.items():
            count[w] = len(tokens)
        stop = np.cumsum(count)
        out = np.zeros(int(count.sum()), np.int32)
        for k, (w, t) in enumerate(steps):
            out[stop[order[w]] - 1 - k] = t
        for w, tokens in by_hand.items():
            out[stop[w] - len(tokens) : stop[w]] = tokens
        return out, count

    def split(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first byte of each word, its text); words cover all bytes."""
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        b = raw[at]
        code = b.astype(np.int32)
        wide = np.flatnonzero(b >= 0xC0)
        if len(wide):
            p, c = at[wide], code[wide]
            more = [raw[np.minimum(p + k, len(raw) - 1)].astype(np.int32) & 0x3F for k in (1, 2, 3)]
            code[wide] = np.where(
                c < 0xE0, (c & 0x1F) << 6 | more[0],
                np.where(c < 0xF0, (c & 0x0F) << 12 | more[0] << 6 | more[1], (c & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2]),
            )
        kind = self.classes[code]
        n = len(at)
        opens = np.zeros(n + 1, bool)
        opens[np.searchsorted(at, off)] = True
        new = np.ones(n, bool)
        new[1:] = kind[1:] != kind[:-1]
        new |= opens[:n]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        what = kind[first]
        follows = np.zeros(len(first), bool)  # by a run of the same text
        follows[:-1] = ~opens[first[1:]]
        begin = np.zeros(n, bool)
        begin[first] = True
        space = (what == SPACE) & follows
        lone = first + size - 1
        joins = np.flatnonzero(space & (code[np.minimum(lone, n - 1)] == 32))
        begin[lone[space]] = True  # the last white-space character stands apart, or leads the next word
        begin[first[joins + 1]] = False
        glued = np.zeros(len(first), bool)
        glued[joins + 1] = True
        mark = np.flatnonzero((what == OTHER) & (size == 1) & ~glued & follows & (code[first] == 39))
        mark = mark[what[mark + 1] == LETTER]
        if len(mark):
            x = code[first[mark] + 1]
            y = np.where(size[mark + 1] > 1, code[np.minimum(first[mark] + 2, n - 1)], 0)
            one = np.isin(x, [ord(c) for c in "stmd"])
            two = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
            take = np.where(one, 1, np.where(two, 2, 0))
            mark, take = mark[take > 0], take[take > 0]
            begin[first[mark] + 1] = False
            rest = take < size[mark + 1]
            begin[(first[mark] + 1 + take)[rest]] = True
        start = at[begin]
        return start, np.searchsorted(off, start, "right") - 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts one after the other, how many each has)."""
        raw, off = C.buffers(texts)
        start, text = self.split(raw, off)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        end = np.append(start[1:], len(raw))
        _, which, back = np.unique(C.span_hashes(raw, start, end), return_index=True, return_inverse=True)
        tokens, count = self.encode_words(raw, start[which], end[which])
        begin = np.cumsum(count) - count
        every = count[back]
        return tokens[C.ragged(begin[back], every)], np.bincount(text, every, len(texts)).astype(np.int64)

    def count(self, texts: pa.Array) -> np.ndarray:
        """How many tokens each text has."""
        raw, off = C.buffers(texts)
        start, text = self.split(raw, off)
        if not len(start):
            return np.zeros(len(texts), np.int64)
        end = np.append(start[1:], len(raw))
        _, which, back = np.unique(C.span_hashes(raw, start, end), return_index=True, return_inverse=True)
        return np.bincount(text, self.encode_words(raw, start[which], end[which])[1][back], len(texts)).astype(np.int64)

    def decode(self, tokens: np.ndarray, count: np.ndarray) -> list[str]:
        """The texts whose tokens follow each other, so many for each."""
        size = self.size[tokens]
        raw = self.blob[C.ragged(self.at[tokens], size)].tobytes()
        total = np.concatenate([[0], np.cumsum(size)])
        stop = total[np.cumsum(count)]
        begin = np.append(0, stop[:-1]) if len(stop) else stop
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(begin, stop)]


def written_out(tokens: list[int], merges: list[tuple[int, int, int]]) -> dict[int, set[int]]:
    """The automaton with all its arcs, for a small vocabulary of single bytes ``tokens``: for the state behind each token
    the tokens that may follow, by one gadget for each merge in turn. What an ``Automaton`` looks up is held against it."""
    arcs = {u: set(tokens) for u in tokens}
    for u, v, w in merges:
        if u not in arcs or v not in arcs[u]:
            continue  # its halves never meet
        arcs[w] = set(arcs[v])  # behind the merged token all goes on as behind its right half
        arcs[u].discard(v)
        for after in arcs.values():
            if u in after:  # whence its left half was reached, so is it
                after.add(w)
    return arcs


def load(path: str = VOCABULARY) -> Automaton:
    """Compile a byte-level vocabulary file (JSON with the vocabulary and the ordered merges)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = byte_letters()
    vocabulary = model["vocab"]
    tokens = {t: bytes(letters[c] for c in name) for name, t in vocabulary.items() if all(c in letters for c in name)}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return Automaton(tokens, [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs])


def encode(docs: DataFrame, automaton: Automaton, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for b in batches:
            for at, some in C.chunks(b.column(1), 2 << 20):
                tokens, count = machine.encode(some)
                stop = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(some)), pa.array(count.astype(np.int32)), pa.ListArray.from_arrays(pa.array(stop), pa.array(tokens))], names=["doc_id", "n_tokens", "tokens"]
                )

    return in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, SCHEMA)


def decode(encoded: DataFrame, automaton: Automaton) -> DataFrame:
    shared = encoded.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for b in batches:
            lists = b.column(1)
            count = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(machine.decode(lists.flatten().to_numpy(), count), pa.string())], names=["doc_id", "text"])

    return in_arrow(encoded.select("doc_id", F.coalesce("tokens", F.array().cast("array<int>")).alias("tokens")), run, "doc_id long, text string")


def round_trip(docs: DataFrame, automaton: Automaton, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode``, with ``restored``: whether decoding the tokens gives the text (for a null text, an empty one)."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for b in batches:
            for at, some in C.chunks(b.column(1), 2 << 20):
                tokens, count = machine.encode(some)
                stop = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                same = pa.compute.equal(pa.array(machine.decode(tokens, count), pa.string()), pa.compute.fill_null(some.cast(pa.string()), ""))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(some)), pa.array(count.astype(np.int32)), pa.ListArray.from_arrays(pa.array(stop), pa.array(tokens)), same], names=["doc_id", "n_tokens", "tokens", "restored"]
                )

    return in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, SCHEMA + ", restored boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), load())
