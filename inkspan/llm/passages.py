"""Removal of repeated byte passages by prefix-free parsing and suffix arrays.

Every byte covered by a LENGTH-byte string that also starts earlier in the
corpus is removed; strings never cross documents and are judged on the input.

Parse. A rolling hash of every GRAM bytes triggers phrases: the trigger of a
LENGTH-byte string is its least-hashed gram, so it depends on the string alone
and every string has one. The strings that share a trigger occurrence start at
neighbouring bytes; together they span one phrase, and phrases overlap by
LENGTH - 1 bytes, so no string is lost between two.

Dictionary. Phrases are grouped by trigger and content. In highly repetitive
text most occurrences are equal to an earlier phrase: all their strings are
repeats and nothing of their text is looked at again. The first occurrence of
each distinct phrase stays; if its trigger has one phrase only, its strings are
all new. A string of LENGTH bytes holds the half before or the half behind its
trigger of what may stand around it; only strings of a half that another phrase
of the trigger has, too, can be repeats, so triggers that meet by chance, which
grow with the corpus, add nothing. What is left is the dictionary proper:
distinct phrases, or one side of them, that share a trigger and a half with
another one. The phrases of a trigger meet in one task, unless a
sample of the documents shows the trigger to be hot (a passage that a large
share of all documents quote, each in another context): those meet by trigger
and content, and all distinct ones go to the dictionary. The sample decides
only where phrases meet, never what is found.

Suffix array. The dictionary's phrases are gathered by trigger, and a suffix
array over the phrases of each bucket, sorted by prefix doubling to LENGTH
bytes, brings equal strings together; with the order of the parse (doc_id,
start) the first of them is known, and the others are repeats. Equal strings
have equal triggers, so the buckets' arrays combine into the order of the
corpus without a global sort. A trigger with very many phrases (a passage that
a large share of all documents quote, each in another context) isn't gathered
in one bucket: its phrases meet by trigger and half, and those of a half that
has very many, too, are cut into single strings, dealt out by their own hash
after equal strings of one task have been reduced to the first.

All exchanges carry packed arrays of fixed-width records. Documents are dealt
by their id and a hash of their text, twice in one plan, so that exchange is
reused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import LARGE_CHUNK_BYTES, checkpointed, doc_chunks, table, text_or_empty, utf8

LENGTH = 100
GRAM = 24
#: Bytes of corpus a bucket of the dictionary or of documents stands for.
BUCKET_BYTES = 4 << 20
#: Bytes of text whose phrases are sorted at once, and bytes of one very long text that are hashed at once.
PARSE_BYTES, LONG_BYTES = 8 << 20, 4 << 20
#: A trigger with more entries than this is dealt out side by side, a side with more phrases string by string.
CROWDED = 4096
#: Documents, about, in which hot triggers are looked for; distinct phrases there, and by estimate in all documents, that
#: make a trigger hot: fewer are no burden to one task (36 bytes each).
SAMPLE, HOT, HOT_ALL = 50_000, 8, 1_000_000

U = np.uint64
_POSITION = U((1 << 26) - 1)


class Roller:
    """Position-free rolling hashes modulo 2**64 of every substring of a buffer, by prefix sums."""

    def __init__(self, seed: int = 7) -> None:
        random = np.random.Generator(np.random.PCG64(seed))
        self.table = random.integers(0, 1 << 64, 256, U)
        self.base = 0x9E3779B97F4A7C15 | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.backs = np.ones(1, U)

    def reach(self, n: int) -> None:
        size = len(self.powers)
        while size < n:
            step, back = U(pow(self.base, size, 1 << 64)), U(pow(self.inverse, size, 1 << 64))
            self.powers = np.concatenate((self.powers, self.powers * step))
            self.backs = np.concatenate((self.backs, self.backs * back))
            size *= 2

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.reach(len(data) + 1)
        out = np.zeros(len(data) + 1, U)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=out[1:])
        return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


#: Longer words are told by a digest: sums modulo 2**64 have equal values for some pairs of texts of about a thousand letters, whatever the table.
LONG_WORD = 256


def word_names(data: np.ndarray, sums: np.ndarray, heads: np.ndarray, tails: np.ndarray, roller: Roller) -> np.ndarray:
    """A 64-bit name for each word data[head:tail]; sums are the buffer's."""
    names = mix((sums[tails] - sums[heads]) * roller.backs[heads] + (tails - heads).astype(U))
    for i in np.flatnonzero(tails - heads > LONG_WORD).tolist():
        names[i] = int.from_bytes(hashlib.blake2b(data[heads[i] : tails[i]].tobytes(), digest_size=8).digest(), "little")
    return names


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, v
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(v) - width + 1], out[width - span :][: len(v) - width + 1]) if width > span else out


def phrases(data: np.ndarray, ends: np.ndarray, roller: Roller, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """First and last string start, trigger hash, content hash, hashes of the left and right side and number of left strings of each phrase in `data`; documents end at `ends`.

    A phrase's left strings hold the half of what may stand around the trigger
    that is before it, all others the half behind it: a string has a side.
    """
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, U, U, np.uint32, np.uint32, np.int64))
    sums = roller.sums(data)
    grams = mix((sums[gram:] - sums[:-gram]) * roller.backs[: len(data) - gram + 1])
    ranked = (grams & ~_POSITION) | np.arange(len(grams), dtype=U)
    trigger = sliding_min(ranked, length - gram + 1) & _POSITION
    inside = np.ones(n + 1, bool)
    for end in ends:
        inside[max(0, end - length + 1) : end] = False
    inside[n] = False
    changed = np.empty(n + 1, bool)
    changed[0] = changed[n] = True
    np.not_equal(trigger[1:], trigger[:-1], out=changed[1:n])
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    first = np.flatnonzero(inside & (changed | (edge == 1)))
    last = np.flatnonzero(inside[:-1] & (changed[1:] | (edge[1:] == -1)))
    content = mix((sums[last + length] - sums[first]) * roller.backs[first] + U(0x51ED270B))
    place, half = trigger[first].astype(np.int64), (length - gram) // 2
    lefts = np.clip(place - half - first + 1, 0, last - first + 1)

    def side(a: np.ndarray, b: np.ndarray) -> np.ndarray:  # meant where the phrase has strings of that side only
        a, b = np.maximum(a, 0), np.minimum(b, len(data))
        return (mix((sums[b] - sums[a]) * roller.backs[a] + U(0x632BE5AB)) >> U(32)).astype(np.uint32)

    left, right = side(place - half, place + gram), side(place, place + length - half + 1)
    # Triggers have small hashes; hashed once more they spread evenly.
    return first, last, mix(grams[place] * U(3) + U(0x2545F491)), content, left, right, lefts


# Packed records: columns one after another, the bytes of each transposed so that equal high bytes compress.


def pack(columns: list[np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in map(np.ascontiguousarray, columns))


def unpack(blobs: list[bytes], types: list[str]) -> list[np.ndarray]:
    width = sum(np.dtype(t).itemsize for t in types)
    parts: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in types]
    for blob in blobs:
        raw, n, at = np.frombuffer(blob, np.uint8), len(blob) // width, 0
        for part, t in zip(parts, types, strict=True):
            size = np.dtype(t).itemsize
            part.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(t).reshape(n))
            at += n * size
    return [np.concatenate(p) for p in parts]


OCCURRENCE = ["u8", "u8", "i8", "i4", "i4", "i2", "u4", "u4", "i2"]  # trigger, content, doc, tie, first, more, left, right, lefts
SPAN = ["i8", "i4", "i4", "i4"]  # doc, tie, first string start, last string start
ENTRY = [*SPAN, "u8", "u1"]  # and the key by which equal strings meet, and whether it is crowded
PIECE = ["i8", "i4", "i4", "i4"]  # doc, tie, start, bytes


def split_by(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[a]), [c[a:b] for c in columns]


def doc_bucket(doc: np.ndarray, tie: np.ndarray, buckets: int) -> np.ndarray:
    """The same as `doc_bucket_column` for arrays."""
    return ((np.mod(doc, buckets) * 31 + np.mod(tie.astype(np.int64), buckets)) % buckets).astype(np.int32)


def doc_bucket_column(buckets: int) -> Column:
    n = F.lit(buckets).cast("long")
    return F.pmod(F.pmod(F.col("doc"), n) * 31 + F.pmod(F.col("tie").cast("long"), n), n).cast("int")


ROWS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
ROWS_DDL = "kind int, bucket int, blob binary"
OCCURRENCES, REPEATS, ENTRIES, PIECES = range(4)


def rows_of(kind: int, parts: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    parts = list(parts)
    if parts:
        buckets, blobs = zip(*parts, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(parts), pa.int32()), pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], schema=ROWS)


def firsts(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting by keys and then order: the permutation, where each group begins, and which rows equal the group's first in order."""
    at = np.lexsort([*reversed(order), *reversed(keys)])
    n = len(at)
    begins = np.ones(n, bool)
    if n:
        begins[1:] = False
        for k in keys:
            begins[1:] |= k[at][1:] != k[at][:-1]
    group = np.cumsum(begins) - 1
    lead = np.flatnonzero(begins)[group] if n else group
    same = np.ones(n, bool)
    for o in order:
        same &= o[at] == o[at][lead]
    return at, begins, same


def sampled_triggers(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Texts to their distinct triggers and contents."""
    roller = Roller()
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for i, j in doc_chunks(offsets, LARGE_CHUNK_BYTES):
            for _, found in parsed_chunk(data, offsets, i, j, roller, length, gram):
                both = np.unique(np.stack((found[2], found[3])), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["trigger", "content"])


def hot_triggers(rows: DataFrame, length: int, gram: int) -> np.ndarray:
    """Triggers of which a sample of about SAMPLE documents suggests HOT_ALL distinct phrases or more, sorted: at most the sample's phrases over HOT."""
    count = rows.count()
    least = max(HOT, HOT_ALL * min(1.0, SAMPLE / max(1, count)))
    if least > min(count, SAMPLE):  # not even one that stands in every document
        return np.zeros(0, U)
    draw = F.pmod(F.xxhash64("doc", "tie", F.lit(3)), F.lit(1 << 30)) <= int(min(1.0, SAMPLE / max(1, count)) * (1 << 30))
    found = rows.filter(draw).select("text").mapInArrow(lambda batches: sampled_triggers(batches, length, gram), "trigger long, content long").distinct()
    return np.sort(np.array([r.trigger for r in found.groupBy("trigger").count().filter(F.col("count") >= least).collect()], np.int64).view(U))


def parse(batches: Iterator[pa.RecordBatch], buckets: int, length: int, gram: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc, tie, text) to the first occurrences of phrases, by bucket of trigger, and the repeats known already."""
    roller = Roller()
    for batch in batches:
        doc, tie = (np.asarray(batch.column(i)) for i in (0, 1))
        data, offsets = utf8(batch.column(2))
        for i, j in doc_chunks(offsets, PARSE_BYTES):
            yield from parse_part(data, offsets[i : j + 1], doc[i:j], tie[i:j], buckets, roller, length, gram, hot)


def parsed_chunk(data, offsets, i: int, j: int, roller: Roller, length: int, gram: int) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """First byte of a stretch of rows i to j, and of its phrases first and last start, trigger, content, bytes and row of the first, and sides."""
    start, stop = int(offsets[i]), int(offsets[j])
    for a in range(start, max(start + 1, stop), LONG_BYTES):  # only one very long text takes more than one turn
        b = min(stop, a + LONG_BYTES + length - 1)
        first, last, trigger, content, *sides = phrases(data[a:b], offsets[i + 1 : j + 1] - a, roller, length, gram)
        row = np.searchsorted(offsets, first + a, "right") - 1
        yield a, (first, last, trigger, content, first + a - offsets[row], row, *sides)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted known ones."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def parse_part(data, offsets, doc, tie, buckets: int, roller: Roller, length: int, gram: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    found: list[list[np.ndarray]] = []
    for i, j in doc_chunks(offsets, LARGE_CHUNK_BYTES):
        for _, (first, last, trigger, content, at, row, left, right, lefts) in parsed_chunk(data, offsets, i, j, roller, length, gram):
            found.append([trigger, content, doc[row], tie[row], at.astype(np.int32), (last - first).astype(np.int16), left, right, lefts.astype(np.int16)])
    if found:
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        at, begins, same = firsts(columns[:2], columns[2:5])
        columns = [c[at] for c in columns]
        yield from repeats_of([c[~same] for c in columns], buckets)
        columns = [c[begins] for c in columns]
        meet = np.where(among(columns[0], hot), mix(columns[0] ^ columns[1]), columns[0])
        bucket = ((meet >> U(32)) * U(buckets) >> U(32)).astype(np.int32)
        yield from rows_of(OCCURRENCES, ((k, pack(c)) for k, c in split_by(bucket, columns)))


def repeats_of(columns: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    _, _, doc, tie, first, more, *_ = columns
    spans = merged([doc, tie, first, first + more.astype(np.int32)])
    yield from rows_of(REPEATS, ((k, pack(c)) for k, c in split_by(doc_bucket(spans[0], spans[1], buckets), spans)))


def merged(spans: list[np.ndarray]) -> list[np.ndarray]:
    """Spans of string starts, those of one document that touch or overlap put together, in order."""
    doc, tie, first, last = spans
    if not len(doc):
        return [doc, tie, first.astype(np.int32), last.astype(np.int32)]
    at = np.lexsort((first, tie, doc))
    doc, tie, first, last = doc[at], tie[at], first[at].astype(np.int64), last[at].astype(np.int64)
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])
    # A running maximum within documents: lift each document above all values before it.
    lift = (np.cumsum(fresh) - 1) * (np.int64(1) << 33)
    high = np.maximum.accumulate(last + lift)
    begin = np.ones(len(doc), bool)
    begin[1:] = first[1:] + lift[1:] > high[:-1] + 1
    begins = np.flatnonzero(begin)
    ends = np.concatenate((begins[1:], [len(doc)])) - 1
    return [doc[begins], tie[begins], first[begins].astype(np.int32), (high[ends] - lift[ends]).astype(np.int32)]


def sharing(trigger: np.ndarray, side: np.ndarray) -> np.ndarray:
    """With how many phrases, itself included, each phrase shares its trigger and a side's hash."""
    at = np.lexsort((side, trigger))
    begins = np.ones(len(at), bool)
    begins[1:] = (trigger[at][1:] != trigger[at][:-1]) | (side[at][1:] != side[at][:-1])
    count = np.diff(np.append(np.flatnonzero(begins), len(at)))
    out = np.empty(len(at), np.int64)
    out[at] = np.repeat(count, count)
    return out


def dictionary_entries(columns: list[np.ndarray], crowded: int, hot: np.ndarray) -> list[np.ndarray]:
    """Distinct phrases, sorted by trigger, to the entries of the dictionary: the strings of those sides that another phrase of the trigger has, too.

    Equal strings hold equal sides, so no others can be repeats. The two sides
    of a phrase stay together unless the trigger has more than `crowded`
    entries; then phrases meet by side, and if even that is crowded string by
    string.
    """
    starts = np.flatnonzero(np.concatenate(([True], columns[0][1:] != columns[0][:-1])))
    count = np.diff(np.append(starts, len(columns[0])))
    shared = np.repeat(count > 1, count)
    trigger, _, doc, tie, first, more, left, right, lefts = (c[shared | among(columns[0], hot)] for c in columns)
    spread = among(trigger, hot)  # a hot trigger's other phrases may be in other buckets
    sizes, lasts = [], first + more.astype(np.int32)
    for there, side in ((lefts > 0, left), (lefts <= more, right)):
        size = np.zeros(len(trigger), np.int64)
        size[there] = sharing(trigger[there], side[there])
        sizes.append(np.where(there & (spread | (size > 1)), size, 0))
    keep_left, keep_right = sizes[0] > 0, sizes[1] > 0
    _, group = np.unique(trigger, return_inverse=True)
    many = ~spread & (np.bincount(group, keep_left | keep_right)[group] > crowded) if len(trigger) else spread
    cut = first + lefts.astype(np.int32)
    parts = [[keep_left & keep_right & ~many, first, lasts, trigger, spread]]
    for keep, other, low, high, side, size, seed in ((keep_left, keep_right, first, cut - np.int32(1), left, sizes[0], 1), (keep_right, keep_left, cut, lasts, right, sizes[1], 2)):
        alone = keep & (many | ~other)
        parts.append([alone, low, high, np.where(many, mix(trigger ^ (side.astype(U) << U(2) | U(seed))), trigger), spread | (size > crowded)])
    return [np.concatenate(c) for c in zip(*([doc[k], tie[k], low[k], high[k], key[k], crowd[k].astype(np.uint8)] for k, low, high, key, crowd in parts), strict=True)]


def phrase_classes(group: pa.Table, buckets: int, crowded: int, hot: np.ndarray) -> pa.Table:
    """All first occurrences of a bucket of triggers, or of a hot trigger's phrases, to repeats, and to entries of the dictionary."""
    kinds, blobs = group.column("kind").to_pylist(), group.column("blob").to_pylist()
    out = list(rows_of(REPEATS, ((b, x) for k, b, x in zip(kinds, group.column("bucket").to_pylist(), blobs, strict=True) if k == REPEATS)))
    columns = unpack([x for k, x in zip(kinds, blobs, strict=True) if k == OCCURRENCES], OCCURRENCE)
    if len(columns[0]):
        at, begins, same = firsts(columns[:2], columns[2:5])
        columns = [c[at] for c in columns]
        out += repeats_of([c[~same] for c in columns], buckets)
        entry = dictionary_entries([c[begins] for c in columns], crowded, hot)
        out += rows_of(ENTRIES, ((k, pack(c)) for k, c in split_by(doc_bucket(entry[0], entry[1], buckets), entry)))
    return pa.Table.from_batches(out, ROWS)


def fetch(docs: pa.Table, parts: pa.Table, buckets: int, length: int) -> pa.Table:
    """The text of the dictionary's entries in a bucket of documents, as pieces by bucket of trigger or of string."""
    entries = unpack(parts.column("blob").to_pylist(), ENTRY)
    if not len(entries[0]) or not docs.num_rows:
        return pa.Table.from_batches([], ROWS)
    data, offsets = utf8(docs.column("text"))
    doc, tie, first, last, trigger, crowd = entries
    begin = offsets[rows_at(docs, doc, tie)] + first
    plain, out = crowd == 0, []
    pieces = [doc[plain], tie[plain], first[plain], (last - first)[plain] + np.int32(length), begin[plain]]
    bucket = ((trigger[plain] >> U(32)) * U(buckets) >> U(32)).astype(np.int32)
    if not plain.all():
        strings, own, known = single_strings(data, [x[~plain] for x in (doc, tie, first, last, begin)], length)
        out += rows_of(REPEATS, ((k, pack(c)) for k, c in split_by(doc_bucket(known[0], known[1], buckets), known)))
        pieces = [np.concatenate(c) for c in zip(pieces, strings, strict=True)]
        bucket = np.concatenate((bucket, (own % U(buckets)).astype(np.int32)))
    blobs = []
    for k, (*columns, at) in split_by(bucket, pieces):
        size = columns[-1]
        body = data[np.repeat(at - np.cumsum(size, dtype=np.int64) + size, size) + np.arange(size.sum())]
        blobs.append((k, len(at).to_bytes(4, "little") + pack(columns) + body.tobytes()))
    out += rows_of(PIECES, iter(blobs))
    return pa.Table.from_batches(out, ROWS)


def single_strings(data: np.ndarray, entries: list[np.ndarray], length: int) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """The strings of crowded entries, each a piece; of those equal by hash the first only, the others being repeats."""
    doc, tie, first, last, begin = entries
    count = last - first + 1
    size = count + (length - 1)
    low = np.cumsum(size, dtype=np.int64) - size
    body = data[np.repeat(begin - low, size) + np.arange(size.sum())]  # only the entries' text is hashed
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    inner = np.repeat(low, count) + step
    doc, tie, start, at = np.repeat(doc, count), np.repeat(tie, count), (np.repeat(first, count) + step).astype(np.int32), np.repeat(begin, count) + step

    def hashed(seed: int) -> np.ndarray:
        roller = Roller(seed)
        sums = roller.sums(body)
        return mix((sums[inner + length] - sums[inner]) * roller.backs[inner])

    own, check = hashed(7), hashed(11)
    order, begins, same = firsts([own, check], [doc, tie, start])
    late, lead = order[~same], order[begins]
    known = merged([doc[late], tie[late], start[late], start[late]])
    return [doc[lead], tie[lead], start[lead], np.full(len(lead), length, np.int32), at[lead]], own[lead], known


def rows_at(docs: pa.Table, doc: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """A row of `docs` for each (doc, tie); every pair is there, equal rows have equal texts."""
    have = np.asarray(docs.column("doc").combine_chunks()), np.asarray(docs.column("tie").combine_chunks())
    order = np.lexsort((have[1], have[0]))
    key = np.empty(len(order), [("d", "i8"), ("t", "i4")])
    key["d"], key["t"] = have[0][order], have[1][order]
    want = np.empty(len(doc), key.dtype)
    want["d"], want["t"] = doc, tie
    return order[np.searchsorted(key, want)]


def suffix_ranks(body: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """Rank of each suffix by its first `length` bytes (fewer where its piece ends), by prefix doubling.

    left: bytes from each position to the end of its piece.
    """
    n = len(body)
    rank, span = body.astype(np.int64) + 1, 1
    while span < length:
        step = min(span, length - span)
        after = np.zeros(n, np.int64)
        after[: n - step] = np.where(left[: n - step] > step, rank[step:], 0)
        if span < 4:
            rank = rank * np.int64(after.max() + 1) + after
            if span + step >= 4:
                rank = np.unique(rank, return_inverse=True)[1].astype(np.int64) + 1
        else:
            rank = np.unique(rank * np.int64(n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        span += step
    return rank


def equal_strings(group: pa.Table, buckets: int, length: int) -> pa.Table:
    """A bucket of pieces to the repeats among their strings: all but the first of equal ones."""
    kinds, blobs, out = group.column("kind").to_pylist(), group.column("blob").to_pylist(), []
    out += rows_of(REPEATS, ((b, x) for k, b, x in zip(kinds, group.column("bucket").to_pylist(), blobs, strict=True) if k == REPEATS))
    pieces, bodies = [], []
    for blob in (x for k, x in zip(kinds, blobs, strict=True) if k == PIECES):
        n = int.from_bytes(blob[:4], "little")
        width = sum(np.dtype(t).itemsize for t in PIECE)
        pieces.append(unpack([blob[4 : 4 + n * width]], PIECE))
        bodies.append(np.frombuffer(blob, np.uint8, offset=4 + n * width))
    if not pieces:
        return pa.Table.from_batches(out, ROWS)
    doc, tie, start, size = (np.concatenate(c) for c in zip(*pieces, strict=True))
    body = np.concatenate(bodies)
    ends = np.cumsum(size, dtype=np.int64)
    left = np.repeat(ends, size) - np.arange(len(body))
    rank = suffix_ranks(body, left, length)
    whole = np.flatnonzero(left >= length)
    piece = np.searchsorted(ends, whole, "right")
    rank, doc, tie = rank[whole], doc[piece], tie[piece]
    at_string = (start[piece] + (whole - (ends - size)[piece])).astype(np.int32)
    at, _, same = firsts([rank], [doc, tie, at_string])
    late = at[~same]
    spans = merged([doc[late], tie[late], at_string[late], at_string[late]])
    out += rows_of(REPEATS, ((k, pack(c)) for k, c in split_by(doc_bucket(spans[0], spans[1], buckets), spans)))
    return pa.Table.from_batches(out, ROWS)


RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]
)


def cut_out(docs: pa.Table, parts: pa.Table, length: int) -> pa.Table:
    """The documents of a bucket without the bytes that the repeats cover."""
    if not docs.num_rows:
        return pa.Table.from_batches([], RESULT)
    doc, tie, first, last = merged(unpack(parts.column("blob").to_pylist() if parts.num_rows else [], SPAN))
    data, offsets = utf8(docs.column("text"))
    have = np.asarray(docs.column("doc").combine_chunks()), np.asarray(docs.column("tie").combine_chunks())
    ids = docs.column("doc_id").to_pylist()
    spans: dict[tuple[int, int], list[list[int]]] = {}
    for d, t, a, b in zip(doc.tolist(), tie.tolist(), first.tolist(), last.tolist(), strict=True):
        own = spans.setdefault((d, t), [])
        if own and a <= own[-1][1]:
            own[-1][1] = b + length
        else:
            own.append([a, b + length])
    rows = []
    for i, doc_id in enumerate(ids):
        text, at, kept, removed = data[offsets[i] : offsets[i + 1]], 0, [], 0
        runs = spans.get((int(have[0][i]), int(have[1][i])), ())
        for a, b in runs:
            kept.append(text[at:a])
            removed, at = removed + b - a, b
        kept.append(text[at:])
        rows.append((doc_id, len(text), removed, len(runs), b"".join(x.tobytes() for x in kept)))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RESULT, strict=True)], schema=RESULT)


def digested(docs: pa.Table, parts: pa.Table, length: int) -> pa.Table:
    out = cut_out(docs, parts, length)
    digests = pa.array([hashlib.sha256(x).hexdigest() for x in out.column("kept").to_pylist()])
    return out.drop_columns("kept").append_column("kept_sha256", digests)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept, the bytes that remain (or kept_sha256) of each row of `docs`.

    A null text counts as empty. "Earlier" is by doc_id, nulls first; texts
    under one doc_id are told apart and ordered by a hash; rows equal in both
    are one document and get one result each. Texts shorter than `length` lose
    nothing; very long ones are parsed in stretches that overlap. An empty
    table gives no rows; other columns, whatever their names, are ignored.
    """
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"),
        F.hash(text_or_empty()).alias("tie"),
        text_or_empty().alias("text"),
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))
    hot = hot_triggers(rows, length, gram)
    found = rows.select("doc", "tie", "text").mapInArrow(lambda batches: parse(batches, buckets, length, gram, hot), ROWS_DDL)
    classes = found.groupBy("bucket").applyInArrow(lambda group: phrase_classes(group, buckets, CROWDED, hot), ROWS_DDL)
    classes = checkpointed(classes)
    by_bucket = rows.withColumn("bucket", doc_bucket_column(buckets)).groupBy("bucket")
    entries = classes.filter(F.col("kind") == ENTRIES).groupBy("bucket")
    pieces = by_bucket.cogroup(entries).applyInArrow(lambda d, p: fetch(d, p, buckets, length), ROWS_DDL)
    more = pieces.groupBy("bucket").applyInArrow(lambda group: equal_strings(group, buckets, length), ROWS_DDL)
    repeats = classes.filter(F.col("kind") == REPEATS).unionByName(more).groupBy("bucket")
    final = digested if digest else cut_out
    last = "kept_sha256 string" if digest else "kept binary"
    return by_bucket.cogroup(repeats).applyInArrow(lambda d, p: final(d, p, length), f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)
