"""Document quality: a generalised additive model with pairwise interactions.

Features of a text are cut into bins at quantiles of the training rows. Cyclic
boosting visits the features in turn and adds a small step of a shallow tree
(up to four leaves over one feature's bins) to that feature's lookup table;
afterwards the pairs of features that explain most of what is left get tables
of their own, boosted by trees of one cut in each. A score is the logistic
function of a sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import doc_chunks, extended, fold, shared, table, utf8
from inkspan.llm.labelled import labelled_sample
from inkspan.llm.passages import Roller, U, mix

#: Labelled rows to fit on, at most about; fitting takes some seconds on the driver.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 48, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15
THRESHOLD = 0.3

FEATURES = (
    "log_words", "word_length", "upper", "digit", "symbol", "bang", "bar", "comma", "stop", "non_ascii",
    "repeat_next", "repeat_second", "distinct", "top_word", "line_length", "repeat_line", "symbol_words", "upper_words", "longest_word",
)

_CLASS = np.zeros((256, 8), np.float32)
_CLASS[65:91, 0] = 1  # upper-case ASCII
_CLASS[48:58, 1] = 1
for _c in b"#$%&*@~^_<>{}[]\\=+/":
    _CLASS[_c, 2] = 1
_CLASS[ord("!"), 3] = 1
_CLASS[ord("|"), 4] = 1
_CLASS[[ord(","), ord(";")], 5] = 1
_CLASS[[ord("."), ord("?")], 6] = 1
_CLASS[128:, 7] = 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each whole text; an empty text has zeros."""
    roller, rows = Roller(), []
    for i, j in doc_chunks(offsets):
        start = int(offsets[i])
        chunk, cut = data[start : offsets[j]], offsets[i : j + 1] - start
        size = np.maximum(1, np.diff(cut)).astype(float)
        out = np.zeros((j - i, len(FEATURES)))
        for k, at in enumerate((2, 3, 4, 5, 6, 7, 8, 9)):
            run = np.concatenate(([0], np.cumsum(_CLASS[chunk, k], dtype=np.float64)))
            out[:, at] = np.diff(run[cut]) / size
        joint = np.zeros(len(chunk) + 1, bool)
        joint[cut] = True
        word = ~_SPACE[chunk]
        head, tail = word.copy(), word.copy()
        head[1:] &= ~word[:-1] | joint[1:-1]
        tail[:-1] &= ~word[1:] | joint[1:-1]
        heads, tails = np.flatnonzero(head), np.flatnonzero(tail) + 1
        sums = roller.sums(_LOWER[chunk])
        names = mix((sums[tails] - sums[heads]) * roller.backs[heads] + (tails - heads).astype(U))
        begin = np.searchsorted(heads, cut)
        count = np.maximum(1, np.diff(begin)).astype(float)
        long = (tails - heads).astype(float)
        odd = (_CLASS[chunk, 2] + _CLASS[chunk, 3]) > 0
        odd_end = odd[tails - 1] if len(tails) else np.zeros(0, bool)
        up = np.concatenate(([0], np.cumsum(_CLASS[chunk, 0])))
        shout = (up[tails] - up[heads]) >= 2
        per = lambda x: np.diff(np.concatenate(([0.0], np.cumsum(x)))[begin])
        out[:, 0] = np.log1p(np.diff(begin))
        out[:, 1] = per(long) / count
        same = np.zeros((2, len(names)))
        for step in (1, 2):
            same[step - 1, step:] = names[step:] == names[:-step]
        out[:, 10], out[:, 11] = per(same[0]) / count, per(same[1]) / count
        out[:, 16], out[:, 17] = per(odd_end) / count, per(shout) / count
        breaks = np.flatnonzero(chunk == 10)
        at_break = np.searchsorted(breaks, cut)
        for r in range(j - i):
            own = names[begin[r] : begin[r + 1]]
            if len(own):
                kinds, times = np.unique(own, return_counts=True)
                out[r, 12], out[r, 13], out[r, 18] = len(kinds) / len(own), times.max() / len(own), long[begin[r] : begin[r + 1]].max()
            edges = np.concatenate(([cut[r]], breaks[at_break[r] : at_break[r + 1]] + 1, [cut[r + 1]]))
            lines = (sums[edges[1:]] - sums[edges[:-1]]) * roller.backs[edges[:-1]]
            out[r, 14], out[r, 15] = np.log1p(size[r] / len(lines)), 1 - len(np.unique(lines)) / len(lines)
        rows.append(out)
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


def best_cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of bins with gradient and curvature sums."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = np.where((left_h > least) & (right_h > least), left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - g.sum() ** 2 / (h.sum() + 1), -1.0)
    at = int(gain.argmax()) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) else (-1.0, 0)


def tree(g: np.ndarray, h: np.ndarray, depth: int = 2, least: float = 2.0) -> np.ndarray:
    """Leaf values by bin of a tree of the given depth."""
    gain, at = best_cut(g, h, least)
    if depth == 0 or gain <= 0:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate((tree(g[:at], h[:at], depth - 1, least), tree(g[at:], h[at:], depth - 1, least)))


class Additive:
    """Lookup tables by feature and by pair of features."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T] if len(x) else [np.zeros(0)] * x.shape[1]
        self.coarse = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for c in x.T] if len(x) else self.edges
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        if not len(x):
            return self
        bins = [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)]
        total = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for f, b in enumerate(bins):
                p = 1 / (1 + np.exp(-total))
                n = len(self.tables[f])
                step = RATE * np.clip(tree(np.bincount(b, y - p, n), np.bincount(b, p * (1 - p), n)), -4, 4)
                self.tables[f] += step
                total += step[b]
        rough = [np.searchsorted(e, c, "right") for e, c in zip(self.coarse, x.T, strict=True)]
        p = 1 / (1 + np.exp(-total))
        gains = []
        for a in range(len(rough)):
            for b in range(a):
                m = len(self.coarse[b]) + 1
                cell, n = rough[a] * m + rough[b], (len(self.coarse[a]) + 1) * m
                g, h = np.bincount(cell, y - p, n), np.bincount(cell, p * (1 - p), n)
                gains.append((float((g**2 / (h + 1)).sum()), a, b))
        for _, a, b in sorted(gains, reverse=True)[:PAIRS]:
            self.pairs.append((a, b))
            self.pair_tables.append(np.zeros((len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)))
        for _ in range(PAIR_ROUNDS):
            for (a, b), values in zip(self.pairs, self.pair_tables, strict=True):
                p = 1 / (1 + np.exp(-total))
                cell = rough[a] * values.shape[1] + rough[b]
                g = np.bincount(cell, y - p, values.size).reshape(values.shape)
                h = np.bincount(cell, p * (1 - p), values.size).reshape(values.shape)
                # The cut of one feature after which cuts of the other gain most: either alone may gain nothing.
                both = [sum(max(0.0, best_cut(g[half].sum(axis=0), h[half].sum(axis=0), 2.0)[0]) for half in (slice(0, at), slice(at, None))) for at in range(1, len(g))]
                at = 1 + int(np.argmax(both)) if both else 0
                step = np.empty_like(values)
                for half in (slice(0, at), slice(at, None)):
                    if g[half].size:
                        step[half] = tree(g[half].sum(axis=0), h[half].sum(axis=0), 1)
                step = RATE * np.clip(step, -4, 4)
                values += step
                total += step.ravel()[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for edges, values, c in zip(self.edges, self.tables, x.T, strict=True):
            total += values[np.searchsorted(edges, c, "right")]
        for (a, b), values in zip(self.pairs, self.pair_tables, strict=True):
            total += values[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Additive:
    """A model of labels.quality, fitted on labelled documents outside fold 0 of 5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(*utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    sample = labelled_sample(docs, labels, "quality", fold(F.col("doc_id"), 5) != 0, rows).select("doc_id", "text", "y")
    found = sorted(sample.mapInArrow(run, "doc_id long, y double, x array<double>").collect())  # about `rows` short rows
    x = np.array([r.x for r in found]).reshape(len(found), len(FEATURES))
    return Additive().fit(x, np.array([r.y for r in found]))


def with_quality(docs: DataFrame, model: Additive) -> DataFrame:
    """The rows of `docs` with score, from 0 to 1; null and empty texts are scored as texts without words.

    Texts of any length are read whole; equal texts have equal scores.
    Repeated rows stay; an empty table gives no rows; a column `score` of the
    input is replaced. Without any labelled row every score is 0.5.
    """
    docs = docs.drop("score")
    fitted = shared(docs.sparkSession, model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = fitted().score
        for batch in batches:
            x = features(*utf8(batch.column(batch.schema.get_field_index("text"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(x))], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, extended(docs, "score double"))


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = with_quality(docs.withColumn("held_out", fold(F.col("doc_id"), 5) == 0), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
