"""Language identification with bit-sliced Bloom filters over letter trigrams.

Each language has a Bloom filter of its usual trigrams. The filters share
tables of bit masks, one table for each 64 languages: bit l of a slot is the
slot's bit in the filter of language l, so the AND of a trigram's slots names
all languages that have it. A text's counts by language, less the matches
expected by chance at each filter's fill, decide.

Every language of the learning rows gets a filter, however many there are; the
model grows with their number (SLOTS bits a language) and not with the corpus.

Filters are learned from at most about `per_language` texts of each language,
chosen by a hash of their id; every text is then read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import checkpointed, doc_chunks, extended, fold, shared, table, text_or_empty, utf8
from inkspan.llm.passages import U, mix

#: Texts of a language to learn from, about, and trigrams of its filter.
PER_LANGUAGE, GRAMS = 1500, 8000
#: Languages of one table of masks.
MASK_BITS = 64
#: A language's trigram occurs in this share of its texts at least.
COMMON = 0.01
SLOTS = 1 << 18
UNKNOWN = "und"
#: In the place of a trigram: the number of texts read.
TEXTS = -1


def letters(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of rows i to j, 0 for other characters than letters and before each row, and where rows begin."""
    chunk = data[offsets[i] : offsets[j]]
    lead = (chunk & 0xC0) != 0x80
    points = np.frombuffer(chunk.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.concatenate(([0], np.cumsum(lead)))[offsets[i : j + 1] - offsets[i]]
    there = np.flatnonzero(np.bincount(points, minlength=1))
    lower = np.zeros(len(there) and int(there[-1]) + 1, np.uint32)
    for c in there:
        small = chr(c).lower()
        if chr(c).isalpha():
            lower[c] = ord(small) if len(small) == 1 else c
    # One 0 before each row keeps trigrams inside their row.
    begins = before + np.arange(len(before))
    out = np.zeros(len(points) + len(before), np.uint32)
    out[np.arange(len(points)) + np.repeat(np.arange(1, len(before)), np.diff(before))] = lower[points] if len(points) else 0
    return out, begins


def trigrams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the trigrams around each letter, and the letters' places."""
    at = np.flatnonzero(points)
    wide = np.concatenate((points, [0])).astype(U)
    return (wide[at - 1] << U(42)) | (wide[at] << U(21)) | wide[at + 1], at


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, texts that have it), with the number of texts under TEXTS."""
    found: dict[str, Counter] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        data, offsets = utf8(batch.column(1))
        for i, j in doc_chunks(offsets):
            points, begins = letters(data, offsets, i, j)
            codes, at = trigrams(points)
            cuts = np.searchsorted(at, begins)
            for r in range(i, j):
                found.setdefault(langs[r], Counter()).update([TEXTS, *np.unique(codes[cuts[r - i] : cuts[r - i + 1]]).tolist()])
    for lang, grams in found.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.int64()), pa.array(list(grams.values()), pa.int64())], names=["lang", "gram", "n"]
        )


class Filters:
    def __init__(self, grams: dict[str, list[int]], slots: int = SLOTS) -> None:
        self.langs, self.mask, self.tables = sorted(grams), U(slots - 1), []
        for at in range(0, len(self.langs), MASK_BITS):
            langs = self.langs[at : at + MASK_BITS]
            kind = next((k for k, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(langs) <= bits), np.uint64)
            table = np.zeros(slots, kind)
            for bit, lang in enumerate(langs):
                for place in self.places(np.array(grams[lang], U)):
                    np.bitwise_or.at(table, place, kind(1 << bit))
            self.tables.append(table)
        self.chance = np.array([float(own.mean()) ** 2 for own in self.bits(self.tables)])

    def places(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(codes)
        return (h & self.mask).astype(np.int64), ((h >> U(32)) & self.mask).astype(np.int64)

    def bits(self, masks: list[np.ndarray]) -> Iterator[np.ndarray]:
        """For each language in turn its bit of the masks, which come table by table."""
        for number in range(len(self.langs)):
            own = masks[number // MASK_BITS]
            yield (own >> own.dtype.type(number % MASK_BITS)) & own.dtype.type(1)

    def holders(self, codes: np.ndarray) -> list[np.ndarray]:
        """Masks, table by table, of the languages whose filters hold each trigram."""
        a, b = self.places(codes)
        return [table[a] & table[b] for table in self.tables]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each text, and how many of their trigrams each language has."""
        total, hits = [np.zeros(0, np.int64)], [np.zeros((0, len(self.langs)), np.int64)]
        for i, j in doc_chunks(offsets):
            points, begins = letters(data, offsets, i, j)
            codes, at = trigrams(points)
            cuts = np.searchsorted(at, begins)
            total.append(np.diff(cuts))
            own = np.zeros((j - i, len(self.langs)), np.int64)
            for number, bit in enumerate(self.bits(self.holders(codes))):
                own[:, number] = np.diff(np.concatenate(([0], np.cumsum(bit, dtype=np.int64)))[cuts])
            hits.append(own)
        return np.concatenate(total), np.concatenate(hits)

    def decide(self, total: np.ndarray, hits: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of most trigrams beyond chance (ties: first by name) and its share of those of all."""
        if not self.langs:
            return [UNKNOWN] * len(total), np.zeros(len(total))
        true = np.maximum(0.0, (hits - total[:, None] * self.chance) / (1 - self.chance))
        best, whole = true.argmax(axis=1), true.sum(axis=1)
        share = np.divide(true[np.arange(len(best)), best], whole, out=np.full(len(best), 1.0 / len(self.langs)), where=whole > 0)
        return [self.langs[b] if n else UNKNOWN for b, n in zip(best, total, strict=True)], np.where(total > 0, share, 0.0)


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Filters:
    """Filters from (doc_id, text, lang) rows; rows without a language are left out.

    Of each language about `per_language` texts at most are read, chosen by a
    hash of id and text.
    """
    docs = docs.filter(F.col("lang").isNotNull()).select("doc_id", "lang", text_or_empty().alias("text"))
    rows = {r.lang: r.rows for r in docs.groupBy("lang").agg(F.count("*").alias("rows")).collect()}  # one entry a language
    limits = [(lang, int(min(1.0, per_language / n) * (1 << 30))) for lang, n in rows.items()]
    limits = docs.sparkSession.createDataFrame(limits, "__lang string, __limit long")
    chosen = docs.join(F.broadcast(limits), F.col("lang") == F.col("__lang"))
    chosen = chosen.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) <= F.col("__limit")).select("lang", "text")
    counted = chosen.mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = checkpointed(counted)  # of a bounded sample
    texts = counted.filter(F.col("gram") == TEXTS).select("lang", F.col("n").alias("texts"))
    usual = counted.filter(F.col("gram") != TEXTS).join(F.broadcast(texts), "lang").filter(F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("texts") * COMMON)))
    grams: dict[str, list] = {lang: [] for lang in rows}
    for r in usual.collect():
        grams[r.lang].append((-r.n, r.gram))
    return Filters({lang: [g for _, g in sorted(found)[:GRAMS]] for lang, found in grams.items()})


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """The rows of `docs` with lang_pred and score.

    A text that is null or has no letters is `und` with score 0. Texts of any
    length are read whole, in parts of CHUNK_BYTES where rows allow. Ties go to
    the first language by name; repeated rows stay and get equal results; an
    empty table gives no rows; columns of the input with the names of the new
    ones are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    learned = shared(docs.sparkSession, filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = learned()
        for batch in batches:
            named, score = own.decide(*own.counts(*utf8(batch.column(batch.schema.get_field_index("text")))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(named, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, extended(docs, "lang_pred string, score double"))


def op2_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    filters = learn(docs.filter(~F.col("held_out")).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "held_out", "text"), filters).select("doc_id", "held_out", "lang_pred", "score")
