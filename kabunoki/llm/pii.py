"""Personal data behind disguises, found on a normalised text and removed from the source text.

Three transducers run one after the other. Each rewrites its matches and keeps, for every character it writes, the span
of source characters it came from:
  1. homoglyphs: full-width forms, mathematical letters, Cyrillic and Greek look-alikes, foreign digits; invisible
     characters vanish;
  2. spelled digits: runs of at least five digit words (English, French, German, Spanish), digits among them; of 7
     digits and more, however many, each is a finding of its own. Runs that meet over commas, full stops and line breaks
     stay apart if each has 7 digits;
  3. at and dot: "[at]", "(dot)", and " at " before a domain whose dots are spelled.
Detectors then run on the normalised text, and their spans are carried back to the source, where each is replaced by its
kind in brackets; everything else stays as it was, character for character.

Texts that no rule could touch (told by one linear-time scan in Arrow, over the whole text) never become Python strings.

Cases: a null text stays null, an empty one empty; findings that overlap go as one, of the kind of the one that begins
first, of those the longest; repeated rows are each treated; very long texts are treated whole; an empty table gives an
empty result; other columns stay as they are, and a column of findings whose name is taken gets underscores behind it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import documents, in_arrow

DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_LOOKS = dict(zip("аеорсухіјѕԁһԛԝАВЕЅІЈКМНОРСТУХαοερνικτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABESIJKMHOPCTYXaoepviktuxABEZHIKMNOPTYX"))
_GONE = "­​‌‍‎‏⁠﻿"


def _table() -> dict[str, str]:
    out = dict(_LOOKS) | {c: "" for c in _GONE}
    wide = [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x0660, 0x066A), *range(0x06F0, 0x06FA), *range(0x0966, 0x0970), *range(0x2460, 0x2469), *range(0x2070, 0x208A)]
    for code in wide:
        c = chr(code)
        n = unicodedata.normalize("NFKC", c)
        if unicodedata.decimal(c, None) is not None:
            n = str(unicodedata.decimal(c))
        if len(n) == 1 and n.isascii() and n != c:
            out[c] = n
    return out | {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "‐": "-", "‑": "-", "–": "-", " ": " "}


HOMOGLYPHS = _table()
_GLYPHS = re.compile("[" + re.escape("".join(HOMOGLYPHS)) + "]")
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"(?<!\w)(?:{_WORD}|\d+)(?:(?:[\s,.\-]{{1,3}})(?:{_WORD}|\d+))*(?!\w)", re.I)
_TOKEN = re.compile(r"\d+|[^\W\d_]+")
_BREAK = re.compile(r"[\s,.\-]*[,.\n\r][\s,.\-]*")
LEAST_DIGITS = 7
_AT_WORDS, _DOT_WORDS = "at|arroba|arobase|chez|ät", "dot|punkt|punto|point"
_DOT_ANY = rf"(?:\s+(?:{_DOT_WORDS})\s+|\s*[\[({{<]\s*(?:{_DOT_WORDS}|\.)\s*[\])}}>]\s*)"
_TLD = "com|org|net|edu|gov|mil|info|biz|dev|app|example|test|io|ai|co|me|eu|uk|us|ca|au|de|fr|es|it|nl|ch|be|pt|pl|se|jp|br|ru|cn|kr|mx"
_AT = re.compile(
    rf"\s*[\[({{<]\s*(?:{_AT_WORDS}|@)\s*[\])}}>]\s*|\s+(?:{_AT_WORDS})\s+(?=[\w\-]+(?:{_DOT_ANY}[\w\-]+)*?{_DOT_ANY}(?:{_TLD})(?!\w))|(?<=\w)\s+@\s*(?=[\w\-]+(?:\.|\s+(?:{_DOT_WORDS})\s|\s*[\[(]))|(?<=\w)\s*@\s+(?=[\w\-]+(?:\.\w|\s+(?:{_DOT_WORDS})\s|\s*[\[(]))",
    re.I,
)
_DOT = re.compile(rf"\s*[\[({{<]\s*(?:{_DOT_WORDS}|\.)\s*[\])}}>]\s*|(?<=\w)\s+(?:{_DOT_WORDS})\s+(?=\w)", re.I)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"

#: (kind, pattern, group of the part that goes)
DETECTORS: list[tuple[str, re.Pattern[str], int]] = [
    ("EMAIL", re.compile(r"[A-Za-z0-9_%+\-À-ÖØ-öø-ÿ](?:[A-Za-z0-9._%+\-À-ÖØ-öø-ÿ]{0,63})@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9\-]{1,63})+"), 0),
    ("SECRET", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"), 0),
    ("SECRET", re.compile(r"(?:token|secret|api[_\- ]?key|access[_\- ]?key|passw(?:or)?d|passwd|pwd|bearer)\s*(?:[:=]|\bis\b)\s*[\"']?([^\s\"']{6,})", re.I), 1),
    ("SECRET", re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]+)"), 0),
    ("SECRET", re.compile(r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[A-Fa-f])(?=[0-9A-Fa-f]*\d)[0-9A-Fa-f]{32,}(?![0-9A-Za-z])"), 0),
    ("IBAN", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"), 0),
    ("IP", re.compile(rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"), 0),
    ("IP", re.compile(r"(?<![:\w])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![:\w])"), 0),
    ("IP", re.compile(r"(?<![:\w])(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){1,7}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![:\w])"), 0),
    ("PHONE", re.compile(r"(?<![\w+])(?:\+\d{1,3}[\s.\-]?)(?:\(\d{1,4}\)[\s.\-]?)?\d{1,4}(?:[\s.\-]?\d{2,4}){1,4}(?!\w)"), 0),
    ("PHONE", re.compile(r"(?<![\w+.\-])(?:\d[\s.\-])?(?:\(\d{2,4}\)[\s.\-]?|\d{3,4}[\s.\-])\d{3}[\s.\-]\d{3,4}(?![\w]|[.\-]\d)"), 0),
    ("SSN", re.compile(r"(?<![\w\-])\d{3}([\- ])\d{2}\1\d{4}(?![\w\-])"), 0),
    ("NUMBER", re.compile(r"(?<![\w.,\-])\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{1,7}(?![\w]|[.,\-]\d)"), 0),
    ("NUMBER", re.compile(r"(?<![\w])\d{9,19}(?!\w)"), 0),
]

#: RE2's \s, \d and - are narrower than Python's over homoglyphs: all white space, hyphens that become "-", all digits.
_S, _H, _D = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}", r"\-‐‑–", r"\p{Nd}"
_APART = rf"[{_S}().{_H}]{{0,3}}"
#: RE2: true of every text on which a transducer or a detector could act.
TRIGGER = (
    rf"(?i)@|{_D}{_APART}{_D}{_APART}{_D}{_APART}{_D}|(?:[0-9a-f]{{1,4}}:){{7}}|[0-9a-f]::[0-9a-f]|(?:{_D}{{1,3}}\.){{3}}{_D}|[0-9a-f]{{32}}|token|secret|key|passw|pwd|bearer|akia|gh[pousr]_|sk[{_H}]|xox|eyj|private"
    rf"|[A-Z]{{2}}{_D}{{2}}(?:[{_S}]?[A-Z0-9]{{4}}){{3}}"
    rf"|[\[({{<][{_S}]*(?:{_AT_WORDS}|{_DOT_WORDS}|\.)[{_S}]*[\])}}>]|[{_S}](?:{_AT_WORDS})[{_S}]+\S+[{_S}]+(?:{_DOT_WORDS})[{_S}]"
    rf"|(?:{_WORD}|{_D}+)(?:[{_S},.{_H}]{{1,3}}(?:{_WORD}|{_D}+)){{4}}"
    "|[ıİ" + "".join(sorted({c for c in HOMOGLYPHS if c not in "–‐‑\xa0"})) + "]"
)


class Tape:
    """A text under rewriting, with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text), dtype=np.int64)
        self.end = self.start + 1
        self.spelled: list[tuple[int, int]] = []  # source spans

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the spans (from, to, by) of the present text; they ascend and don't overlap."""
        if not edits:
            return
        texts, starts, ends, at = [], [], [], 0
        for a, b, by in edits:
            texts += [self.text[at:a], by]
            starts += [self.start[at:a], np.full(len(by), self.start[a])]
            ends += [self.end[at:a], np.full(len(by), self.end[b - 1])]
            at = b
        self.text = "".join(texts) + self.text[at:]
        self.start = np.concatenate([*starts, self.start[at:]])
        self.end = np.concatenate([*ends, self.end[at:]])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a]), int(self.end[b - 1])


def _digits(run: str) -> str:
    return "".join(DIGIT_WORDS.get(t.lower(), t) for t in _TOKEN.findall(run))


def _spelled(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _SPELLED.finditer(text):
        tokens = _TOKEN.findall(m[0])
        words = [t for t in tokens if not t.isdigit()]
        if len(tokens) >= 5 and len(words) >= 2 and len(_digits(m[0])) >= LEAST_DIGITS:
            at = [m.start(), *(m.start() + k for b in _BREAK.finditer(m[0]) for k in b.span()), m.end()]
            parts = [(a, b, _digits(text[a:b])) for a, b in zip(at[::2], at[1::2])]
            out += parts if all(len(d) >= LEAST_DIGITS for _, _, d in parts) else [(m.start(), m.end(), _digits(m[0]))]
    return out


def normalise(text: str) -> Tape:
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite([(m.start(), m.end(), HOMOGLYPHS[m[0]]) for m in _GLYPHS.finditer(text)])
    edits = _spelled(tape.text)
    tape.spelled = [tape.source(a, b) for a, b, _ in edits]
    tape.rewrite(edits)
    tape.rewrite([(m.start(), m.end(), "@") for m in _AT.finditer(tape.text)])
    if "@" in tape.text:
        tape.rewrite([(m.start(), m.end(), ".") for m in _DOT.finditer(tape.text)])
    return tape


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in the source, ascending, without overlaps."""
    tape = normalise(text)
    hits = []
    for kind, pattern, group in DETECTORS:
        for m in pattern.finditer(tape.text):
            a, b = m.span(group)
            hits.append((*tape.source(a, b), kind))
    hits += [(a, b, "NUMBER") for a, b in tape.spelled]
    hits.sort(key=lambda h: (h[0], -h[1]))
    out: list[tuple[int, int, str]] = []
    for h in hits:
        if not out or h[0] >= out[-1][1]:
            out.append(h)
        elif h[1] > out[-1][1]:  # an overlap goes as one
            out[-1] = (out[-1][0], h[1], out[-1][2])
    return out


def redact(text: str) -> tuple[str, list[tuple[int, int, str]]]:
    found = find(text)
    parts, at = [], 0
    for a, b, kind in found:
        parts += [text[at:a], f"[{kind}]"]
        at = b
    return "".join(parts) + text[at:], found


def redact_batch(texts: pa.Array) -> tuple[pa.Array, list[list[dict]]]:
    maybe = pc.fill_null(pc.match_substring_regex(texts, TRIGGER), False)
    which = np.flatnonzero(maybe.to_numpy(zero_copy_only=False))
    findings: list[list[dict]] = [[] for _ in range(len(texts))]
    changed, by = np.zeros(len(texts), bool), []
    for i in which.tolist():
        new, found = redact(texts[i].as_py())
        if found:
            changed[i] = True
            by.append(new)
            findings[i] = [{"kind": k, "start": a, "end": b} for a, b, k in found]
    if by:
        texts = pc.replace_with_mask(texts, pa.array(changed), pa.array(by, texts.type))
    return texts, findings


def deobfuscate(docs: DataFrame, text_col: str = "text", findings: str | None = None) -> DataFrame:
    """``docs`` with personal data replaced in the text; with ``findings``, a column of that name lists kinds and source
    spans (characters, from 0, end excluded)."""
    schema = T.StructType(list(docs.schema.fields))
    finding = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    if findings:
        while findings.lower() in {c.lower() for c in docs.columns}:
            findings += "_"
        schema = schema.add(findings, T.ArrayType(finding))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            columns[at], found = redact_batch(columns[at])
            names = list(b.schema.names)
            if findings:
                columns.append(pa.array(found, kind))
                names.append(findings)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_arrow(docs, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deobfuscate(documents(spark, sf_dir), findings="findings")
