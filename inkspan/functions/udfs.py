"""Arrow functions for what Spark's expressions can't say: spans, normal forms, alignments, edits."""

from __future__ import annotations

import difflib
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.functions.text import PATTERN_WORD, needed

#: Characters or bytes of input whose results a task holds at once, and rows of it.
HELD, HELD_ROWS = 1 << 20, 256


def in_pieces(*columns: pd.Series) -> Iterator[tuple[pd.Series, ...]]:
    """A batch's columns in pieces of at most HELD_ROWS rows and about HELD of the last one's contents; a batch itself may have ten thousand long texts."""
    sizes = columns[-1].map(lambda x: 0 if x is None else len(x)).to_numpy(dtype=np.int64)
    part, start, held = 0, 0, 0
    for part, size in enumerate(sizes.tolist()):
        if part > start and (held + size > HELD or part - start >= HELD_ROWS):
            yield tuple(c.iloc[start:part] for c in columns)
            start, held = part, 0
        held += size
    yield tuple(c.iloc[start:] for c in columns)


SPAN = "array<struct<kind:string,start:int,end:int,text:string>>"


def find_spans(text: Column, patterns: dict[str, str]) -> Column:
    """All matches of each named pattern in a text, by start, end and name, in code points. One pass a text for all families."""
    listed = tuple(patterns.items())

    @F.pandas_udf(SPAN)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = [(kind, re.compile(p), needed(p)) for kind, p in listed]

        def found(text: str) -> list[dict]:
            low = text.lower()
            likely = [(k, p) for k, p, parts in compiled if not parts or any(x in low for x in parts)]
            hits = ({"kind": k, "start": m.start(), "end": m.end(), "text": m.group()} for k, p in likely for m in p.finditer(text))
            return sorted(hits, key=lambda x: (x["start"], x["end"], x["kind"]))

        for batch in batches:
            for (texts,) in in_pieces(batch):
                yield pd.Series([found(t or "") for t in texts])

    return spans(text)


def plain_search(text: Column, word: str, needs: Sequence[Sequence[str] | str]) -> Column:
    """How many words a text has, and the places in `needs` of what it holds, in lower case: one of some strings, or a match of a pattern.

    Spark's `contains` looks byte by byte; a text in which a hundred strings are looked for is worth its way to Python and back.
    """
    places: dict[str, list[int]] = {}
    for n, parts in enumerate(needs):
        for part in () if isinstance(parts, str) else parts:
            places.setdefault(part, []).append(n)
    shapes = [(n, parts) for n, parts in enumerate(needs) if isinstance(parts, str)]
    always = [n for n, parts in enumerate(needs) if not parts]

    @F.pandas_udf("struct<words:int,held:array<int>>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled, words = [(n, re.compile(p)) for n, p in shapes], re.compile(word)

        def held(text: str) -> list[int]:
            low = text.lower()
            out = {n for part, ns in places.items() if part in low for n in ns}
            return sorted(out.union(always, (n for n, p in compiled if p.search(low))))

        for batch in batches:
            for (texts,) in in_pieces(batch):
                texts = [t or "" for t in texts]
                yield pd.DataFrame({"words": [len(words.findall(t)) for t in texts], "held": [held(t) for t in texts]})

    return search(text)


class Strings:
    """Which of some sets of strings have one that a text holds. Only strings all of whose threes of bytes are somewhere in the text are looked for."""

    PLACES = 1 << 14

    def __init__(self, sets: Sequence[Sequence[str]]):
        self.strings = sorted({s.encode() for parts in sets for s in parts})
        of = {s: i for i, s in enumerate(self.strings)}
        self.sets = [[of[s.encode()] for s in parts] for parts in sets]
        threes = [self.threes(s) if len(s) > 2 else np.zeros(1, dtype=np.uint16) for s in self.strings]
        self.all, self.starts = np.concatenate(threes) if threes else np.zeros(0, dtype=np.uint16), np.cumsum([0, *map(len, threes)])[:-1]
        self.short = np.array([len(s) < 3 for s in self.strings], dtype=bool)

    def threes(self, text: bytes) -> np.ndarray:
        b = np.frombuffer(text, dtype=np.uint8).astype(np.uint16)
        return (b[:-2] * np.uint16(961) + b[1:-1] * np.uint16(31) + b[2:]) & np.uint16(self.PLACES - 1)

    def held(self, text: bytes) -> list[bool]:
        if not self.strings:
            return [False] * len(self.sets)
        seen = np.zeros(self.PLACES, dtype=bool)
        seen[self.threes(text)] = True
        likely = np.flatnonzero(np.logical_and.reduceat(seen[self.all], self.starts) | self.short)
        there = {i for i in likely.tolist() if self.strings[i] in text}
        return [not there.isdisjoint(parts) for parts in self.sets]


class TextScan:
    """What `text_scan` tells of one text, by its bytes: signs that part sentences, paragraphs and words are of ASCII."""

    SENTENCE, GAP = re.compile(rb"[^.!?\n]+[.!?]*"), re.compile(rb"\n[ \t\n\x0b\f\r]*\n")
    WORD = re.compile(PATTERN_WORD.replace("['’]", "(?:'|’)").encode())
    JOINTS = b"'", "’".encode()
    #: Signs that aren't of words become spaces, those that part sentences line ends.
    SPACES = bytes(c if c < 128 and chr(c).isalnum() else 10 if c in b".!?\n" else 32 for c in range(256))

    def __init__(self, needs: Sequence[Sequence[str]], vague: Sequence[str], least: int, reliable: int):
        self.least, self.reliable, self.needs = least, reliable, len(needs)
        self.strings, self.vague = Strings([*needs, *([v] for v in vague)]), [v.encode() for v in vague]

    def words(self, low: bytes) -> int:
        return len(self.WORD.findall(low) if self.joined(low) else low.translate(self.SPACES).split())

    def joined(self, low: bytes) -> bool:
        return self.JOINTS[0] in low or self.JOINTS[1] in low

    def __call__(self, text: str | None, low: str | None) -> tuple:
        if text is None or low is None:
            return (None,) * 5
        small = low.encode()
        lows = pieces = self.SENTENCE.findall(small)
        held = self.strings.held(small)
        there = [v for v, h in zip(self.vague, held[self.needs :], strict=True) if h]
        if there or len(text) != len(low):  # no sign of another kind becomes a mark in lower case, so sentences are as many
            pieces = self.SENTENCE.findall(text.encode())
        counts = list(map(self.words, lows)) if self.joined(small) else [len(x.split()) for x in small.translate(self.SPACES).split(b"\n") if x]
        lengths = []
        for n, x in zip(counts, pieces, strict=True):
            x = x.strip(b" \t\n\r\x0b\f")
            if len(x) >= 16 or len(x) >= 4 and len(x.decode()) >= 4:
                lengths.append(n)
        words = sum(counts)
        long = [i for i, x in enumerate(self.GAP.split(small)) if len(x) >= 2 * self.least - 1 and self.words(x) >= self.least] if words >= self.reliable else []
        likely = [x.decode() for x, y in zip(pieces, lows, strict=True) if any(v in y for v in there)] if there else []
        return words, lengths, long, likely, held[: self.needs]


#: Makers of the functions that plans in SQL call, by the names that they have there.
NAMED: dict[str, Callable[[], Callable]] = {}


def text_scan(needs: Sequence[Sequence[str]], vague: Sequence[str], least: int, reliable: int) -> str:
    """Name of a function of a text and the same in lower case: what plans of writing patterns need of its words and sentences, in one Arrow pass.

    words; lengths: words of each sentence of four signs or more; long: places
    of the paragraphs of `least` words or more, of a text of `reliable` words
    or more; vague: sentences that hold one of these strings; held: for each of
    `needs` whether the text holds one of its strings. Spark's own count of
    matches makes an array of them, its `contains` looks byte by byte.
    """

    def scan() -> Callable:
        @F.pandas_udf("struct<words:int,lengths:array<int>,long:array<int>,vague:array<string>,held:array<boolean>>")
        def scanned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            of = TextScan(needs, vague, least, reliable)
            for texts, lows in batches:
                for part in in_pieces(texts, lows):
                    rows = [of(x, y) for x, y in zip(*part, strict=True)]
                    columns = zip(*rows, strict=True) if rows else ((),) * 5
                    yield pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in zip(("words", "lengths", "long", "vague", "held"), columns, strict=True)})

        return scanned

    name = f"inkspan_scan_{zlib.crc32(repr((needs, vague, least, reliable)).encode()):08x}"
    NAMED[name] = scan
    return name


def nfkc(text: Column) -> Column:
    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return normal(text)


def offset_map(text: Column) -> Column:
    """For each character of the NFKC form the index of the character it came from."""

    @F.pandas_udf("array<int>")
    def mapped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [i for i, c in enumerate(t or "") for _ in unicodedata.normalize("NFKC", c)])

    return mapped(text)


def subsequence_length(a, b) -> int:
    """Length of the longest common subsequence: one long integer holds a bit for each item of `a`, cleared where the length grows."""
    if a is None or b is None or not len(a) or not len(b):
        return 0
    places: dict = {}
    for i, item in enumerate(a):
        places.setdefault(item, []).append(i)
    masks = {item: sum(1 << i for i in at) for item, at in places.items()}
    full = (1 << len(a)) - 1
    row = full
    for item in b:
        same = row & masks.get(item, 0)
        if same:
            row = ((row + same) | (row - same)) & full
    return len(a) - row.bit_count()


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two word arrays, one vectorised row a word."""

    @F.pandas_udf("int")
    def length(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([subsequence_length(x, y) for x, y in zip(left, right, strict=True)], dtype="int32")

    return length(a, b)


def sequence_diff(a: Column, b: Column) -> Column:
    """Ordered comparison of two sentence arrays: similarity in percent and counts of equal, added, deleted sentences and replaced blocks."""

    @F.pandas_udf("similarity double, equal int, added int, deleted int, replaced int")
    def diff(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(left, right, strict=True):
            x, y = list(x) if x is not None else [], list(y) if y is not None else []
            match = difflib.SequenceMatcher(None, x, y)
            total = dict.fromkeys(("equal", "insert", "delete", "replace"), 0)
            for tag, i, j, k, m in match.get_opcodes():
                total[tag] += {"equal": j - i, "delete": j - i, "insert": m - k, "replace": 1}[tag]
            rows.append((round(100 * match.ratio(), 1), total["equal"], total["insert"], total["delete"], total["replace"]))
        return pd.DataFrame(rows, columns=["similarity", "equal", "added", "deleted", "replaced"])

    return diff(a, b)


EDIT = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("replacement", T.StringType())]))


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    """Text with its edits made; of edits with one start the longest, then those that overlap an earlier one left out; an article before a changed word is adapted to it."""
    pieces, at = [], 0
    for start, end, new in sorted(edits, key=lambda e: (e[0], -e[1])):
        if start < at:
            continue
        lead = text[at:start]
        article = re.search(r"\b([Aa]n?)(\s+)$", lead)
        if article and new[:1].isalpha():
            fitting = "an" if new[0].lower() in "aeiou" else "a"
            if article[1][0] == "A":
                fitting = fitting.capitalize()
            lead = lead[: article.start()] + fitting + article[2]
        pieces += [lead, new]
        at = end
    return "".join([*pieces, text[at:]])


def apply_edits(text: Column, edits: Column) -> Column:
    @F.pandas_udf("string")
    def applied(texts: pd.Series, changes: pd.Series) -> pd.Series:
        return pd.Series([edited(t or "", [(e["start"], e["end"], e["replacement"]) for e in (c if c is not None else [])]) for t, c in zip(texts, changes, strict=True)])

    return applied(text, edits)
