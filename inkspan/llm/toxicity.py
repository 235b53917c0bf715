"""Toxicity: a factorization machine over hashed terms.

Terms are lower-cased words and their beginnings of 3 to 6 characters, hashed
to SLOTS slots. The slots most associated with the label in the training rows
get a weight and a vector of RANK factors; the dot products of the vectors of
two present terms score their joint presence beyond what either says alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import doc_chunks, extended, fold, shared, table, utf8
from inkspan.llm.labelled import labelled_sample
from inkspan.llm.passages import Roller, U, mix

#: Labelled rows to fit on, at most about; fitting takes some seconds on the driver.
SAMPLE = 20_000
SLOTS, TERMS, RANK = 1 << 20, 8192, 8
EPOCHS, BATCH, RATE, SHRINK = 12, 256, 0.1, 2e-4
#: Standard errors by which a chosen slot's share of toxic texts differs from all texts' share, at least:
#: that of these which does best on a quarter of the training rows, fitted on the others.
LEASTS = (2.0, 3.0, 4.0)
THRESHOLD = 0.3
BEGINNINGS = (3, 4, 5, 6)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters, digits and the bytes of other characters than ASCII make words.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def lowered(chunk: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 in small letters."""
    out = _LOWER[chunk]
    late = (chunk[1:] >= 0x80) & (chunk[1:] <= 0x9E) & (chunk[1:] != 0x97) & (chunk[:-1] == 0xC3)
    out[1:][late] += 32
    return out


def terms(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges with the row, counted from the first, and the slot of each term."""
    roller = Roller(seed=23)
    for i, j in doc_chunks(offsets):
        start = int(offsets[i])
        chunk, cut = lowered(data[start : offsets[j]]), offsets[i : j + 1] - start
        joint = np.zeros(len(chunk) + 1, bool)
        joint[cut] = True
        word = _WORD[chunk]
        head, tail = word.copy(), word.copy()
        head[1:] &= ~word[:-1] | joint[1:-1]
        tail[:-1] &= ~word[1:] | joint[1:-1]
        heads, tails = np.flatnonzero(head), np.flatnonzero(tail) + 1
        row = np.searchsorted(cut, heads, "right") - 1
        sums = roller.sums(chunk)
        lead = np.flatnonzero((chunk & 0xC0) != 0x80)
        lead = np.concatenate((lead, np.full(max(BEGINNINGS) + 1, len(chunk))))
        first = np.searchsorted(lead, heads)
        rows, slots = [row], [mix((sums[tails] - sums[heads]) * roller.backs[heads] + U(1)) >> U(44)]
        for n in BEGINNINGS:
            end = lead[first + n]
            longer = end < tails
            a, b = heads[longer], end[longer]
            rows.append(row[longer])
            slots.append(mix((sums[b] - sums[a]) * roller.backs[a] + U(2)) >> U(44))
        yield i, j, np.concatenate(rows), np.concatenate(slots).astype(np.int64)


def present(row: np.ndarray, term: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, term), by row."""
    key = np.unique(row.astype(np.int64) * width + term)
    return key // width, key % width


class Factors:
    def fit(self, rows: list[np.ndarray], y: np.ndarray, least: float = LEASTS[0], seed: int = 5) -> Factors:
        """rows: the distinct slots of each training text."""
        all_slots = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        have = np.bincount(all_slots, minlength=SLOTS).astype(float)
        toxic = np.bincount(all_slots, y[owner], SLOTS)
        expected = have * share
        # Signed square root of each slot's part of the chi-squared statistic; slots in fewer than three texts say nothing.
        weight = np.where(have >= 3, np.abs(toxic - expected) / np.sqrt(expected * (1 - share) + 1), 0.0)
        chosen = np.argsort(-weight, kind="stable")[:TERMS]
        chosen = chosen[weight[chosen] > least]
        self.place = np.full(SLOTS, -1, np.int32)
        self.place[chosen] = np.arange(len(chosen))
        random = np.random.Generator(np.random.PCG64(seed))
        self.w = np.zeros(len(chosen) + 1)  # the last stands for no term
        self.v = np.vstack([random.normal(0, 0.02, (len(chosen), RANK)), np.zeros((1, RANK))])
        held = self.place[all_slots] >= 0
        owner, term = owner[held], self.place[all_slots[held]].astype(np.int64)
        ends = np.searchsorted(owner, np.arange(len(rows) + 1))
        sum_w, sum_v, sum_b = np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(EPOCHS if len(chosen) else 0):
            order = random.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                mine = order[at : at + BATCH]
                size = ends[mine + 1] - ends[mine]
                index = np.repeat(ends[mine] - np.cumsum(size) + size, size) + np.arange(size.sum())
                t, r = term[index], np.repeat(np.arange(len(mine)), size)
                total, s = self._raw(r, t, len(mine))
                g = 1 / (1 + np.exp(-np.clip(total, -35, 35))) - y[mine]
                grad_w = np.bincount(t, g[r], len(self.w)) + SHRINK * self.w * len(mine)
                pull = g[r][:, None] * (s[r] - self.v[t])
                grad_v = np.stack([np.bincount(t, pull[:, k], len(self.w)) for k in range(RANK)], axis=1) + SHRINK * self.v * len(mine)
                grad_w, grad_v, grad_b = grad_w / len(mine), grad_v / len(mine), g.mean()
                sum_w += grad_w**2
                sum_v += grad_v**2
                sum_b += grad_b**2
                self.w -= RATE * grad_w / np.sqrt(sum_w)
                self.v -= RATE * 0.3 * grad_v / np.sqrt(sum_v)
                self.base -= RATE * grad_b / np.sqrt(sum_b)
        return self

    def _raw(self, row: np.ndarray, term: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Logits of rows with the given terms, and the sums of the terms' vectors."""
        own = self.v[term]
        s = np.stack([np.bincount(row, own[:, k], rows) for k in range(RANK)], axis=1)
        squares = np.bincount(row, (own**2).sum(axis=1), rows)
        return self.base + np.bincount(row, self.w[term], rows) + 0.5 * ((s**2).sum(axis=1) - squares), s

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        """The same of texts given by their distinct slots."""
        slots = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        owner, term = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), self.place[slots]
        return self._raw(owner[term >= 0], term[term >= 0].astype(np.int64), len(rows))[0]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        for i, j, row, slot in terms(data, offsets):
            term = self.place[slot]
            held = term >= 0
            row, term = present(row[held], term[held].astype(np.int64), len(self.w))
            out[i:j] = self._raw(row, term, j - i)[0]
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def chosen_least(rows: list[np.ndarray], y: np.ndarray, leasts: Sequence[float] = LEASTS) -> float:
    """Of the bounds for choosing slots, the one of the least log loss on every fourth row, the model being fitted on the others."""
    inner = np.arange(len(rows)) % 4 == 3
    if not y[inner].any() or not y[~inner].any():
        return leasts[0]
    losses = []
    for least in leasts:
        total = Factors().fit([r for r, held in zip(rows, inner, strict=True) if not held], y[~inner], least).logits([r for r, held in zip(rows, inner, strict=True) if held])
        losses.append(float(np.logaddexp(0, np.where(y[inner] > 0, -total, total)).mean()))
    return leasts[int(np.argmin(losses))]


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Factors:
    """A model of labels.toxic, fitted on labelled documents outside fold 2 of 4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, j, row, slot in terms(*utf8(batch.column(1))):
                row, slot = present(row, slot, SLOTS)
                found += np.split(slot.astype(np.int32), np.searchsorted(row, np.arange(1, j - i)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "y", "x"])

    sample = labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), 4) != 2, rows).select("doc_id", "text", "y")
    # About `rows` rows of some kB: the distinct terms of a text.
    found = sorted((r.doc_id, r.y, bytes(r.x)) for r in sample.mapInArrow(run, "doc_id long, y double, x binary").toLocalIterator())
    found.sort(key=lambda row: zlib.crc32(str(row[0]).encode()))
    rows, y = [np.frombuffer(x, np.int32) for _, _, x in found], np.array([y for _, y, _ in found])
    return Factors().fit(rows, y, chosen_least(rows, y))


def with_toxicity(docs: DataFrame, model: Factors) -> DataFrame:
    """The rows of `docs` with score, from 0 to 1; null and empty texts get the model's base score.

    Texts of any length are read whole; equal texts have equal scores.
    Repeated rows stay; an empty table gives no rows; a column `score` of the
    input is replaced. Without any labelled row every score is 0.5.
    """
    docs = docs.drop("score")
    fitted = shared(docs.sparkSession, model)  # SLOTS places and TERMS vectors, 5 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = fitted().score
        for batch in batches:
            found = score(*utf8(batch.column(batch.schema.get_field_index("text"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, extended(docs, "score double"))


def op4_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = with_toxicity(docs.withColumn("held_out", fold(F.col("doc_id"), 4) == 2), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
