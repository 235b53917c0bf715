"""Benchmark decontamination with one Aho-Corasick automaton.

Test items and documents are normalised alike: A-Z lower-cased, words cut at
every other ASCII character than letters and digits. A window is `n`
consecutive item words (a shorter item is one window). All windows go into one
automaton over word numbers, as flat arrays built on the driver level by
level: 20 bytes a state, broadcast once. It reads each document's words once;
ends of matches are word numbers, which lead back to offsets in the original
text.

Texts are read in lockstep: after `n` words the automaton's state depends on
the last `n` words only, so texts are cut into segments that overlap by `n`
words, and one vector step moves all segments of a chunk on by a word.

Items are streamed to the driver. A benchmark of more than PART_WORDS words
makes several automata, which read the documents one after another, each
adding to the hits of those before, with a checkpoint between; the results are
those of one automaton.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import LARGE_CHUNK_BYTES, checkpointed, doc_chunks, extended, shared, table, utf8
from inkspan.llm.passages import Roller, word_names

N = 10
#: Item words of one automaton: at most N states of 20 bytes each, 200 MB in all.
PART_WORDS = 1_000_000
#: Words of a segment beyond those that warm its state up.
SEGMENT = 64

#: Lower-case A-Z; ASCII other than letters and digits becomes a space; bytes of other characters stay.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_NORMAL = np.frombuffer(NORMAL, np.uint8)


def words_of(data: np.ndarray, offsets: np.ndarray, roller: Roller) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word of consecutive texts, and at which word each text begins."""
    start = int(offsets[0])
    chunk, cut = _NORMAL[data[start : offsets[-1]]], offsets - start
    word, joint = chunk != 32, np.zeros(len(chunk) + 1, bool)
    joint[cut] = True
    head, tail = word.copy(), word.copy()
    head[1:] &= ~word[:-1] | joint[1:-1]
    tail[:-1] &= ~word[1:] | joint[1:-1]
    heads, tails = np.flatnonzero(head), np.flatnonzero(tail) + 1
    sums = roller.sums(chunk)
    names = word_names(chunk, sums, heads, tails, roller)
    return names, heads, tails, np.searchsorted(heads, cut)


def item_pieces(items: Iterable[tuple[str | None, str | None]], n: int, limit: int) -> Iterator[tuple[str | None, np.ndarray]]:
    """Word hashes of each item; one of over `limit` words in pieces that overlap by n - 1, so that every window is in one."""
    roller = Roller()
    for item, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        names = words_of(raw, np.array([0, len(raw)]), roller)[0]
        for at in range(0, max(1, len(names) - n + 1) if len(names) else 0, max(1, limit)):
            yield item, names[at : at + limit + n - 1]


def parts_of(items: Iterable[tuple[str | None, str | None]], n: int = N, limit: int = PART_WORDS) -> Iterator[list[tuple[str | None, np.ndarray]]]:
    part, size = [], 0
    for item, names in item_pieces(items, n, limit):
        if part and size + len(names) > limit:
            yield part
            part, size = [], 0
        part.append((item, names))
        size += len(names)
    if part:
        yield part


class Automaton:
    """Aho-Corasick over word numbers, as arrays.

    State 0 is the root. States are numbered level by level; `keys` holds
    parent * words + word in order, so the child of an edge is one binary
    search away. `fail` is the longest proper suffix that is a state,
    `word_end` the nearest state on the way of suffixes (itself included) at
    which a window ends, and `starts`/`owners` list the items of each window.
    """

    def __init__(self, part: list[tuple[str | None, np.ndarray]], n: int = N) -> None:
        self.n, self.items = n, sorted({item for item, _ in part}, key=lambda x: (x is None, x or ""))
        number = {item: k for k, item in enumerate(self.items)}
        names = np.concatenate([names for _, names in part])
        self.vocabulary, ids = np.unique(names, return_inverse=True)
        self.words = len(self.vocabulary)
        size = np.array([len(names) for _, names in part])
        first = np.cumsum(size) - size
        windows = np.maximum(size - n + 1, 1)
        begin = np.repeat(first, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        length = np.repeat(np.minimum(size, n), windows)
        owner = np.repeat(np.array([number[item] for item, _ in part], np.int64), windows)
        state, levels, low, depth = np.zeros(len(begin), np.int64), [], [0, 1], [0]
        for level in range(int(length.max())):
            going = length > level
            key = state[going] * self.words + ids[begin[going] + level]
            own, child = np.unique(key, return_inverse=True)
            state[going] = low[-1] + child
            levels.append(own)
            low.append(low[-1] + len(own))
        self.keys = np.concatenate(levels)
        self.depth = np.repeat(np.arange(len(low) - 1, dtype=np.int32), np.diff(low))
        self.fail = np.zeros(low[-1], np.int32)
        for level in range(1, len(levels)):  # children of the root fail to the root
            states = np.arange(low[level + 1], low[level + 2])
            parent, word = np.divmod(self.keys[states - 1], self.words)
            self.fail[states] = self.step(self.fail[parent].astype(np.int64), word)
        ends, at = np.unique(state * len(self.items) + owner), np.zeros(0)
        at, self.owners = np.divmod(ends, len(self.items))
        self.ends, counts = np.unique(at, return_counts=True)
        self.starts = np.concatenate(([0], np.cumsum(counts)))
        self.word_end = np.zeros(low[-1], np.int32)
        self.word_end[self.ends] = self.ends
        for level in range(1, len(levels) + 1):
            states = np.arange(low[level], low[level + 1])
            none = states[self.word_end[states] == 0]
            self.word_end[none] = self.word_end[self.fail[none]]

    def numbers(self, names: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for words of no item."""
        at = np.minimum(np.searchsorted(self.vocabulary, names), self.words - 1)
        return np.where(self.vocabulary[at] == names, at, -1)

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after reading one word each."""
        out = np.zeros(len(state), np.int64)
        left = np.flatnonzero(word >= 0)
        state, word = state[left], word[left]
        while len(left):
            key = state * self.words + word
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            out[left[found]] = at[found] + 1
            more = ~found & (state > 0)
            left, state, word = left[more], self.fail[state[more]].astype(np.int64), word[more]
        return out

    def scan(self, names: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words of consecutive texts are hit, and the distinct (text, item) pairs. Texts begin at the words `begin`."""
        numbers = self.numbers(names)
        hits, size = np.zeros(len(names) + 1, np.int64), np.diff(begin)
        # Segments: of SEGMENT words, read from n - 1 words before on (not beyond their text).
        count = -(-size // SEGMENT)
        text = np.repeat(np.arange(len(size)), count)
        low = np.repeat(begin[:-1], count) + SEGMENT * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        high = np.minimum(low + SEGMENT, begin[1:][text])
        at = np.maximum(low - (self.n - 1), begin[:-1][text])
        some = np.concatenate(([0], np.cumsum(numbers >= 0)))  # segments without an item's word are left out
        going = np.flatnonzero(some[high] > some[at])
        state, pairs = np.zeros(len(text), np.int64), []
        while len(going):
            here = at[going]
            now = self.step(state[going], numbers[here])
            state[going] = now
            end, where = self.word_end[now], np.arange(len(now))
            held = (end > 0) & (here >= low[going])  # matches that end in the warm-up are the segment before's
            where, end = where[held], end[held]
            while len(where):
                last = here[where] + 1
                np.add.at(hits, last - self.depth[end], 1)
                np.add.at(hits, last, -1)
                pairs.append(np.stack((text[going[where]], end), axis=1))
                end = self.word_end[self.fail[end]]
                where, end = where[end > 0], end[end > 0]
            at[going] += 1
            going = going[at[going] < high[going]]
        hit = np.cumsum(hits[:-1]) > 0
        if not pairs:
            return hit, np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(pairs).astype(np.int64), axis=0)
        window = np.searchsorted(self.ends, pairs[:, 1])
        many = self.starts[window + 1] - self.starts[window]
        owners = self.owners[np.repeat(self.starts[window] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        both = np.unique(np.repeat(pairs[:, 0], many) * len(self.items) + owners)
        return hit, *np.divmod(both, len(self.items))


FOUND = "n_words long, hit_words array<int>, items array<string>, spans array<array<int>>"
_HITS, _ITEMS, _SPANS = pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32()))


def reader(automaton, known: bool):
    """Batches with the columns of FOUND behind theirs; `known`: hits and items of automata before are the columns __hit and __items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, roller = automaton(), Roller()
        for batch in batches:
            place = batch.schema.get_field_index
            data, offsets = utf8(batch.column(place("text")))
            before = [batch.column(place(c)).to_pylist() for c in ("__hit", "__items")] if known else None
            counts, hits, items, spans = [], [], [], []
            for i, j in doc_chunks(offsets, LARGE_CHUNK_BYTES):
                names, heads, tails, begin = words_of(data, offsets[i : j + 1], roller)
                size = np.diff(begin)
                hit, text, item = own.scan(names, begin) if own else (np.zeros(len(names), bool), np.zeros(0, np.int64), np.zeros(0, np.int64))
                named: dict[int, set] = {}
                for t, k in zip(text.tolist(), item.tolist(), strict=True):
                    named.setdefault(t, set()).add(own.items[k])
                counts.append(size)
                for r in range(j - i):
                    a, b = begin[r], begin[r + 1]
                    mine, found = hit[a:b], named.get(r, set()) - {None}
                    if known:
                        mine[np.array(before[0][i + r], np.int64)] = True
                        found |= set(before[1][i + r])
                    hits.append(np.flatnonzero(mine).astype(np.int32))
                    items.append(sorted(found))
                    spans.append(original_spans(data[offsets[i + r] : offsets[i + r + 1]], heads[a:b], tails[a:b], mine, int(offsets[i + r] - offsets[i])))
            counts = np.concatenate([np.zeros(0, np.int64), *counts])
            new = [pa.array(counts), pa.array(hits, _HITS), pa.array(items, _ITEMS), pa.array(spans, _SPANS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "n_words", "hit_words", "items", "spans"])

    return run


def original_spans(text: np.ndarray, heads: np.ndarray, tails: np.ndarray, hit: np.ndarray, shift: int) -> list[list[int]]:
    """Code-point ranges, end exclusive, of the runs of hit words in the original text, which begins at byte `shift` of heads and tails."""
    if not hit.any():
        return []
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    points = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80)))
    return np.stack((points[heads[edge[:-1] == 1] - shift], points[tails[edge[1:] == -1] - shift]), axis=1).tolist()


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, part_words: int = PART_WORDS) -> DataFrame:
    """The rows of `docs` with n_words, n_hit, items (sorted ids as strings), spans and contaminated.

    spans are the hit stretches of the original text, [start, end) in code
    points. A null or wordless text has no words and no hits, a null or
    wordless item no windows; an item without id hits words but is not listed.
    Texts and items of any length are read whole; items repeated count once an
    id. Empty tables give no rows or no hits. Repeated rows stay and get equal
    results. Columns of the input with the names of the new ones are replaced.
    """
    spark = docs.sparkSession
    out = docs.drop("n_words", "n_hit", "items", "spans", "contaminated", "hit_words")
    items = ((r.item, r.text) for r in benchmark.select(F.col("item_id").cast("string").alias("item"), "text").toLocalIterator())
    known = False
    for part in parts_of(items, n, part_words):
        if known:
            out = checkpointed(out).withColumnsRenamed({"hit_words": "__hit", "items": "__items"}).drop("n_words", "spans")
        out = out.mapInArrow(reader(shared(spark, Automaton(part, n)), known), extended(out, FOUND)).drop("__hit", "__items")
        known = True
    if not known:
        out = out.mapInArrow(reader(lambda: None, False), extended(out, FOUND))
    return out.withColumns({"n_hit": F.size("hit_words").cast("long"), "contaminated": F.size("hit_words") > 0}).drop("hit_words")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP10_SQL = f"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, array_to_string(w[i : i + {N - 1}], ' ') AS g, least(len(w), {N}) AS k
  FROM iw, unnest(range(1, greatest(len(w) - {N - 1}, 1) + 1)) AS t(i) WHERE len(w) > 0
),
ks AS (SELECT DISTINCT k FROM win),
grams AS (
  SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM dw, ks, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k
),
found AS (SELECT r, i, grams.k, item FROM grams JOIN win ON grams.g = win.g AND grams.k = win.k),
hit AS (SELECT r, count(DISTINCT i + j) AS n FROM found, unnest(range(0, k)) AS t(j) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
  sha256(coalesce(its.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
