"""Near-duplicate documents by MinHash, with every link confirmed on full sets.

1. A document's set is its distinct word shingles. Equal sets are one class;
   only classes go on, so copies cost nothing more.
2. HASHES universal hash minima make BANDS bands of ROWS minima. At similarity
   0.8 two sets share no band with a chance of about 3 in a million.
3. Classes that share a band are compared by signature there: one byte a
   minimum estimates the similarity; a spanning forest of the pairs estimated
   at `slack` below the threshold or nearer (over four standard errors) is
   kept, at most one edge a class and band. Its components are candidates.
4. In each group of candidates the full sets are compared: a breadth-first
   search links a set to all sets not yet reached that truly are near, which
   gives a spanning forest of the confirmed links. Large-star and small-star
   rounds join forests to components.

Groups too large for one task are cut into blocks, and every pair of blocks is
compared, so no link between different sets is lost at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import checkpointed, doc_chunks, table, text_or_empty, utf8
from inkspan.llm.components import components
from inkspan.llm.passages import Roller, U, mix, word_names
from inkspan.llm.skew import likely_in, limit, salted_join

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Sets that one block of a signature comparison, or of a comparison of full sets, holds.
SIGNATURE_BLOCK, SET_BLOCK = 4096, 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _odd(count: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, count, U) | U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, roller: Roller) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; a shorter text is one shingle, a wordless one none."""
    factors = _odd(k + 1, 97)
    for i, j in doc_chunks(offsets):
        start = int(offsets[i])
        chunk = _LOWER[data[start : offsets[j]]]
        word = ~_SPACE[chunk]
        joint = np.zeros(len(chunk) + 1, bool)  # a new text begins
        joint[offsets[i:j] - start] = True
        head = word.copy()
        head[1:] &= ~word[:-1] | joint[1:-1]
        tail = word.copy()
        tail[:-1] &= ~word[1:] | joint[1:-1]
        heads, tails = np.flatnonzero(head), np.flatnonzero(tail) + 1
        sums = roller.sums(chunk)
        words = word_names(chunk, sums, heads, tails, roller)
        begin = np.searchsorted(heads, offsets[i : j + 1] - start)
        full = np.zeros(max(0, len(words) - k + 1), U)
        for n in range(k):
            full += words[n : n + len(full)] * factors[n]
        full = mix(full)
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            if b - a >= k:
                yield np.unique(full[a : b - k + 1])
            elif b > a:
                yield mix((words[a:b] * factors[: b - a]).sum(dtype=U, keepdims=True) + factors[k : k + 1] * U(b - a))
            else:
                yield np.zeros(0, U)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), ~U(0))
    for at in range(0, len(shingles), 1024):
        out = np.minimum(out, (a[:, None] * shingles[None, at : at + 1024] + b[:, None]).min(axis=1))
    return out


def summarise(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, check, text) to (doc_id, check, n, class, bands, bytes)."""
    roller, a, b, rows, mark = Roller(), _odd(HASHES, 1), _odd(HASHES, 2), _odd(ROWS, 3), _odd(2, 4)
    for batch in batches:
        sizes, classes, bands, bits = [], [], [], []
        last: tuple[bytes, tuple] | None = None
        for s in shingle_sets(*utf8(batch.column(2)), k, roller):
            sizes.append(len(s))
            if not len(s):
                for x in (classes, bands, bits):
                    x.append(None)
                continue
            first = mix(np.arange(len(s), dtype=U) * mark[0] + s)
            name = np.array([(first * mark[0]).sum(dtype=U), mix(s * mark[1] + U(5)).sum(dtype=U)], U).tobytes()
            if last is None or last[0] != name:
                sig = signature(s, a, b)
                band = mix((sig.reshape(BANDS, ROWS) * rows).sum(axis=1, dtype=U) + np.arange(BANDS, dtype=U) * mark[1])
                last = name, (band.view(np.int64), (mix(sig) & U(255)).astype(np.uint8).tobytes())
            classes.append(name)
            bands.append(last[1][0])
            bits.append(last[1][1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
            names=["doc_id", "check", "n", "class", "bands", "bits"],
        )


def spread(member: DataFrame, group: str, node: str, size: str, block: int, buckets: int) -> DataFrame:
    """Rows dealt to tasks: a group of up to `block` rows together, a larger one by pairs of its blocks."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(node), blocks.cast("long")).cast("int")
    pair = lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j"))
    dealt = member.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), pair)))
    return dealt.withColumn("bucket", F.pmod(F.xxhash64(group, "pair"), F.lit(buckets)).cast("int"))


def runs(*keys: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of each set of equal keys with two rows or more."""
    order = np.lexsort(keys)
    if not len(order):
        return
    new = np.zeros(len(order) - 1, bool)
    for k in keys:
        new |= k[order][1:] != k[order][:-1]
    cuts = np.concatenate(([0], np.flatnonzero(new) + 1, [len(order)]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > 1:
            yield order[a:b]


def forest(count: int, near) -> list[tuple[int, int]]:
    """A spanning forest: near(i, rest) says which of the rows `rest` are linked to row i."""
    rest, edges = np.arange(count), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            edges += [(i, int(x)) for x in rest[hit]]
            queue += [int(x) for x in rest[hit]]
            rest = rest[~hit]
    return edges


def joined_edges(nodes: np.ndarray, edges: list[tuple[int, int]]) -> pa.Table:
    """Edges between rows as stars: the node of each row with an edge, and the least node of its component."""
    kinds, kind = np.unique(nodes, return_inverse=True)  # a node may stand in several rows
    root = list(range(len(kinds)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    pairs = kind[np.array(edges, np.int64).reshape(-1, 2)]
    for a, b in pairs.tolist():
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    found = np.unique(pairs)
    tops = np.array([top(i) for i in found.tolist()], np.int64)
    return pa.table({"u": pa.array(kinds[found[found != tops]]), "v": pa.array(kinds[tops[found != tops]])})


def plain_key(column: pa.ChunkedArray) -> np.ndarray:
    """Any column as integers that are equal where its values are."""
    return np.asarray(column.combine_chunks().dictionary_encode().indices) if column.num_chunks else np.zeros(0, np.int32)


def similar_signatures(group: pa.Table, least: float) -> pa.Table:
    group = group.sort_by("node")  # so that trees grow from their least node
    nodes = np.asarray(group.column("node").combine_chunks())
    bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint8).reshape(len(nodes), HASHES)
    pair = group.column("pair").combine_chunks().flatten()
    found = []
    for rows in runs(plain_key(group.column("band")), np.asarray(pair[0]), np.asarray(pair[1])):
        own = bits[rows]
        if len(rows) == 2:
            if (own[0] == own[1]).mean() >= least:
                found.append((int(rows[0]), int(rows[1])))
            continue
        found += [(int(rows[i]), int(rows[j])) for i, j in forest(len(rows), lambda i, rest, own=own: (own[rest] == own[i]).mean(axis=1) >= least)]
    return joined_edges(nodes, found)


def similar_sets(group: pa.Table, k: int, percent: int) -> pa.Table:
    group = group.sort_by("node")
    nodes = np.asarray(group.column("node").combine_chunks())
    sets = list(shingle_sets(*utf8(group.column("text")), k, Roller()))
    pair = group.column("pair").combine_chunks().flatten()
    found = []
    for rows in runs(plain_key(group.column("root")), np.asarray(pair[0]), np.asarray(pair[1])):
        own = [sets[r] for r in rows]
        size = np.array([len(s) for s in own])
        owner = np.repeat(np.arange(len(own)), size)
        values = np.concatenate(own)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]

        def near(i: int, rest: np.ndarray, own=own, size=size, owner=owner, values=values) -> np.ndarray:
            low, high = np.searchsorted(values, own[i], "left"), np.searchsorted(values, own[i], "right")
            span = high - low
            at = np.repeat(low - np.cumsum(span) + span, span) + np.arange(span.sum())
            both = np.bincount(owner[at], minlength=len(own))[rest]
            return 100 * both >= percent * (size[rest] + size[i] - both)

        found += [(int(rows[i]), int(rows[j])) for i, j in forest(len(rows), near)]
    return joined_edges(nodes, found)


#: What tells a text from others, without nulls: so a join needs no null-safe comparison.
PLACE = ["at_id", "at_null", "at_check"]


def place(doc_id: Column, check: Column) -> list[Column]:
    return [F.coalesce(doc_id, F.lit(0)).alias(PLACE[0]), doc_id.isNull().alias(PLACE[1]), check.alias(PLACE[2])]


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, slack: float = 0.15) -> DataFrame:
    """doc_id, check (a hash of the text), n_shingles, component_id and kept for each row of `docs`.

    Words are runs of other characters than ASCII spaces, A-Z lower-cased.
    Texts that are null, empty or wordless have no shingles and are linked
    with nothing: their component is their own id. Other components take the
    least doc_id among their rows (null if all are null); rows repeated in the
    input stay, and all rows under a component's id are kept. Texts of any
    length are compared whole. kept says that a row's id is its component's.
    An empty table gives no rows; other columns, whatever their names, are
    ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("check"), text_or_empty().alias("text"))
    schema = "doc_id long, check long, n long, class binary, bands array<long>, bits binary"
    seen = checkpointed(rows.mapInArrow(lambda batches: summarise(batches, k), schema))
    classes = checkpointed(
        seen.filter("n > 0")
        .groupBy("class")
        .agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "check")).alias("at"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
    )  # from here on a class goes by a number, which the checkpoint holds fast
    count, filled, most = classes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0))).first()
    bands = classes.select("node", F.explode("bands").alias("band"))
    shared = checkpointed(bands.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"))
    widest = shared.agg(F.max("size")).first()[0] or 0
    buckets = max(8, count // 4000)
    meeting = salted_join(bands, shared, "band", "size", "node", BANDS * count, widest).join(classes.select("node", "bits"), "node")
    meeting = spread(meeting, "band", "node", "size", SIGNATURE_BLOCK, buckets)
    maybe = meeting.groupBy("bucket").applyInArrow(lambda g: similar_signatures(g, percent / 100 - slack), "u long, v long")
    grouped = checkpointed(components(maybe))
    sizes = grouped.groupBy("root").agg(F.count("*").alias("size"))
    nodes = grouped.count()
    wanted = salted_join(grouped, sizes, "root", "size", "node", nodes).join(classes.select("node", "at.doc_id", "at.check"), "node")
    wanted = checkpointed(wanted.select("root", "node", "size", *place(F.col("doc_id"), F.col("check"))))
    # Only the candidates' texts, and a few that a filter of bounded size can't tell from them, are shuffled.
    near = likely_in(rows, wanted, place(F.col("doc_id"), F.col("check")), [F.col(c) for c in PLACE], "__near").filter("__near")
    texts = near.select(*place(F.col("doc_id"), F.col("check")), "text").dropDuplicates(PLACE)
    wanted = spread(wanted.join(texts, PLACE), "root", "node", "size", SET_BLOCK, buckets)
    links = wanted.groupBy("bucket").applyInArrow(lambda g: similar_sets(g, k, percent), "u long, v long")
    joined = components(links).join(classes.select("node", "class", "least", "copies"), "node")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    named = salted_join(joined, least, "root", "size", "node", nodes).select("class", "component_id", "copies")
    alone = classes.join(joined.select("node"), "node", "left_anti").select("class", F.col("least").alias("component_id"), "copies")
    known = named.unionByName(alone)
    known = checkpointed(known) if most > limit(filled) else known  # read twice where a class of many copies is dealt out
    out = salted_join(seen.filter("n > 0").select("doc_id", "check", "n", "class"), known, "class", "copies", "doc_id", filled, most)
    empty = seen.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    own = ["doc_id", "check", F.col("n").alias("n_shingles"), "component_id"]
    out = out.select(*own).unionByName(empty.select(*own))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4).drop("check")


#: The same in DuckDB by comparing all sets that share a shingle; for small tables.
OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
g AS (SELECT DISTINCT r, array_to_string(w[i : i + 3], ' ') AS gram, least(len(w), 4) AS k FROM w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.k = b.k AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT x, y FROM p JOIN n a ON a.r = p.x JOIN n b ON b.r = p.y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach(x, y) AS (SELECT r, r FROM w UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
c AS (SELECT reach.x AS r, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.y GROUP BY reach.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, w.doc_id IS NOT DISTINCT FROM c.component_id AS kept
FROM w JOIN c USING (r) LEFT JOIN n USING (r)
"""
