"""Repair of conversation structure by an associative scan of min-plus matrices.

A conversation is in order if the initials of its roles read (s?(ua)+)?. The
states are the start, after s, after u and after a. Each turn is a 4x4 matrix:
its entry (p, q) is the cheapest way from state p to q that inserts turns and
then keeps, reroles or deletes this one, as an element (cost, audit); of equal
costs the ASCII-least audit wins. Products of matrices are associative, so a
conversation is a tree of products: an up-sweep multiplies, a down-sweep tells
each node the states before and after it, and each turn its edits.

Audits needn't be carried along. An audit and the state before it tell the
state after it and, with the turns, its cost. Every audit of a matrix ends
with the letter of its last turn and has one such letter a turn, so none is
the beginning of another of its row. Hence the audits of a row (one state
before) differ, and their order, a rank of 0 to 3, decides all ties of a
product: of two ways the one whose first part ranks lower; through the same
middle state, the one whose second part does. An element is cost * 4 + rank.

Rows are dealt out by ranges of (conversation, turn), so that a conversation
of any length is spread over tasks. Each task multiplies what it holds;
conversations that end inside it are done there. Pieces of the others meet
in a tree over tasks, as matrices of sixteen numbers and a few counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import checkpointed, table

#: What a piece of a conversation holds at most, besides one long turn; and tasks whose products meet in one node.
PIECE_ROWS, PIECE_BYTES, FAN = 1 << 14, 1 << 18, 1024
#: Classes of initials, and the state that an inserted or reroled turn leads to from each state.
INITIALS, AFTER = "sua", (2, 2, 3, 2)
INFINITE = 1 << 58
#: From each state: cost and number of turns inserted at the end of a conversation.
FINISH = ((0, 0), (4, 2), (2, 1), (0, 0))
SPACES = r"\x20\x09-\x0D"


def turn_matrix(initial: int, delete: bool, cut: bool) -> tuple[np.ndarray, list[list[str]]]:
    """Elements of one turn with insert closure before it, and their audits; initial: 0 to 2 for s, u, a, else 3."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for p in range(4):
        k = p
        for inserts in range(3):
            ways = [(k, 3, "D")]
            if not delete:
                ways.append((AFTER[k], 2 + cut, "R"))
                if (initial == 0 and k == 0) or initial + 1 == AFTER[k]:
                    ways.append((initial + 1, int(cut), "K"))
            for q, cost, letter in ways:
                found = (2 * inserts + cost, "I" * inserts + letter)
                best[p, q] = min(best.get((p, q), found), found)
            k = AFTER[k]
    keys, audits = np.full((4, 4), INFINITE * 4, np.int64), [[""] * 4 for _ in range(4)]
    for p in range(4):
        row = sorted((audit, q, cost) for (a, q), (cost, audit) in best.items() if a == p)
        for rank, (audit, q, cost) in enumerate(row):
            keys[p, q], audits[p][q] = cost * 4 + rank, audit
    return keys, audits


def kind(initial: int, delete: bool, cut: bool) -> int:
    return initial * 4 + delete * 2 + cut


_TURNS = [turn_matrix(k >> 2, bool(k & 2), bool(k & 1)) for k in range(16)]
KEYS = np.stack([keys for keys, _ in _TURNS])
AUDITS = [audits for _, audits in _TURNS]
IDENTITY = np.where(np.eye(4, dtype=bool), 0, INFINITE * 4).astype(np.int64)


def middle(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best middle state of each product entry [n, 4, 4] and its cost."""
    ways = ((a >> 2)[:, :, :, None] + (b >> 2)[:, None, :, :]) * 4 + (a & 3)[:, :, :, None]
    best = ways.argmin(axis=2)
    return best, np.minimum(np.take_along_axis(ways, best[:, :, None, :], 2)[:, :, 0, :] >> 2, INFINITE)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best, cost = middle(a, b)
    first = np.take_along_axis(a & 3, best, 2)
    second = np.take_along_axis(b & 3, best, 1)
    return cost * 4 + (first * 4 + second).argsort(axis=2).argsort(axis=2)


def pairs_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in runs of `sizes`: left rows of the next level's nodes, which of them have a right neighbour, and new sizes."""
    halves = (sizes + 1) // 2
    run = np.repeat(np.arange(len(sizes)), halves)
    within = np.arange(halves.sum()) - np.repeat(np.cumsum(halves) - halves, halves)
    return np.repeat(np.cumsum(sizes) - sizes, halves) + 2 * within, 2 * within + 1 < sizes[run], halves


def up_sweep(keys: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of (matrices, nodes a run), from the rows to at most one node a run."""
    levels = [(keys, sizes)]
    while len(sizes) and sizes.max() > 1:
        left, has, sizes = pairs_of(sizes)
        above = keys[left]
        above[has] = product(keys[left[has]], keys[left[has] + 1])
        keys = above
        levels.append((keys, sizes))
    return levels


def down_sweep(levels: list[tuple[np.ndarray, np.ndarray]], before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States before and after each row, from those of the top nodes."""
    for keys, sizes in reversed(levels[:-1]):
        left, has, _ = pairs_of(sizes)
        p, q = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        p[left], q[left] = before, after
        best, _ = middle(keys[left[has]], keys[left[has] + 1])
        k = best[np.arange(len(best)), before[has], after[has]]
        q[left[has]] = p[left[has] + 1] = k
        q[left[has] + 1] = after[has]
        before, after = p, q
    return before, after


def tops(levels: list[tuple[np.ndarray, np.ndarray]], runs: int) -> np.ndarray:
    out = np.broadcast_to(IDENTITY, (runs, 4, 4)).copy()
    out[levels[0][1] > 0] = levels[-1][0]
    return out


def chosen(top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State that each whole conversation ends its own turns in, and the cost of its repair."""
    ways = top[:, 0, :] + np.array([cost * 4 for cost, _ in FINISH])
    end = ways.argmin(axis=1)
    return end, ways[np.arange(len(end)), end] >> 2


def illegal(before: int, after: int) -> bool:
    return (before, after) not in ((0, 1), (1, 2), (2, 1))

COUNTS = ("blank", "duplicate", "truncated", "illegal")
#: What consecutive rows of a conversation are summed up by: counts, different turn numbers with the least and the most, the first and
#: last class of initial (-1: no row), the matrix.
SUMMARY = pa.struct([*((c, pa.int64()) for c in (*COUNTS, "distinct", "low", "high", "first", "last")), ("matrix", pa.list_(pa.int64()))])
NOTHING = dict.fromkeys((*COUNTS, "distinct"), 0) | {"low": None, "high": None, "first": -1, "last": -1}


def append(out: dict, r: dict) -> None:
    """Add the counts of the rows that follow."""
    for c in (*COUNTS, "distinct"):
        out[c] += r[c]
    if r["first"] >= 0:
        out["illegal"] += out["last"] >= 0 and illegal(out["last"], r["first"])
        out["first"] = out["first"] if out["first"] >= 0 else r["first"]
        out["last"] = r["last"]
    if r["low"] is not None:
        out["distinct"] -= out["high"] == r["low"]
        out["low"] = r["low"] if out["low"] is None else out["low"]
        out["high"] = r["high"]


def totals(summary: dict, cost: int) -> dict:
    """What is told of a whole conversation."""
    gaps = 0 if summary["low"] is None else summary["high"] - summary["low"] + 1 - summary["distinct"]
    return {"gaps": gaps, **{c: int(summary[c]) for c in COUNTS}, "cost": cost}


class Piece:
    """Rows of one conversation in one task. begins, ends: whether its first and last rows are surely among them."""

    def __init__(self, conv: int | None, number: int, begins: bool) -> None:
        self.conv, self.number, self.begins, self.ends = conv, number, begins, True
        self.kinds: list[int] = []
        self.repeats: list[int] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.rows = self.bytes = 0
        self.summary = dict(NOTHING)

    def add(self, turn: int | None, role: str, text: str, state: int, first: bool, copies: int) -> None:
        """Equal rows; state: 0 sound, 1 truncated, 2 blank; first: no such role and text came before."""
        found = INITIALS.find(role[:1]) if role else -1
        initial = found if found >= 0 else 3
        alone = int(state < 2 and first)
        blank = copies if state == 2 else 0
        counts = {"blank": blank, "duplicate": copies - alone - blank, "truncated": alone * state, "illegal": (copies - 1) * illegal(initial, initial)}
        append(self.summary, counts | {"distinct": int(turn is not None), "low": turn, "high": turn, "first": initial, "last": initial})
        if alone:
            self.kinds.append(kind(initial, False, state == 1))
            self.repeats.append(1)
            self.roles.append(role)
            self.texts.append(text)
            self.bytes += len(text)
        self.kinds.append(kind(initial, True, False))
        self.repeats.append(copies - alone)
        self.rows += copies

    def full(self) -> bool:
        return self.rows >= PIECE_ROWS or self.bytes >= PIECE_BYTES


def spelled(kinds: np.ndarray, before: np.ndarray, after: np.ndarray, roles: list[str], texts: list[str]) -> tuple[str, list[dict]]:
    """Audit and repaired turns of rows between known states; roles and texts are of the rows that needn't go."""
    audit, turns, at = [], [], 0
    for t, p, q in zip(kinds.tolist(), before.tolist(), after.tolist(), strict=True):
        letters = AUDITS[t][p][q]
        audit.append(letters)
        for letter in letters:
            if letter in "IR":
                p = AFTER[p]
                turns.append({"role": "user" if p == 2 else "assistant", "text": texts[at] if letter == "R" else ""})
            elif letter == "K":
                turns.append({"role": roles[at], "text": texts[at]})
        at += not t & 2
    return "".join(audit), turns


def ending(state: int) -> tuple[str, list[dict]]:
    """Turns inserted at the end."""
    count = FINISH[state][1]
    return "I" * count, [{"role": role, "text": ""} for role in ("user", "assistant")[2 - count :]]


_TOTALS = [(c, pa.int64()) for c in ("gaps", *COUNTS, "cost")]
_TURNS_TYPE = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_PLACE = [("conv_id", pa.int64()), ("part", pa.int64()), ("piece", pa.int64())]
_SPELLED = [("audit", pa.string()), ("turns", _TURNS_TYPE)]
_RAW = [("kinds", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("summary", SUMMARY)]
_STATES = [("before", pa.int64()), ("after", pa.int64()), ("final", pa.bool_())]
PACKED = pa.schema([*_PLACE, ("whole", pa.bool_()), *_TOTALS, *_SPELLED, *_RAW])
NODES = pa.schema([*_PLACE, ("summary", SUMMARY)])
PLACED = pa.schema([*_PLACE, *_TOTALS, *_STATES])
REPAIRED = pa.schema([*_PLACE, ("whole", pa.bool_()), *_TOTALS, *_SPELLED])
DIGESTED = pa.schema([("conv_id", pa.int64()), *_TOTALS, ("audit", pa.string()), ("repaired_sha256", pa.string())])


def ddl(schema: pa.Schema) -> str:
    """The same schema for Spark."""

    def named(t: pa.DataType) -> str:
        if pa.types.is_list(t):
            return f"array<{named(t.value_type)}>"
        if pa.types.is_struct(t):
            return f"struct<{', '.join(f'{f.name}: {named(f.type)}' for f in t)}>"
        return {"int64": "long", "bool": "boolean"}.get(str(t), str(t))

    return ", ".join(f"{f.name} {named(f.type)}" for f in schema)


def finished(pieces: list[Piece], part: int) -> pa.RecordBatch:
    """Pieces as rows; those that are whole conversations are repaired at once."""
    kinds = [np.repeat(np.array(p.kinds, np.uint8), np.array(p.repeats, np.int64)) for p in pieces]
    sizes = np.array([len(k) for k in kinds], np.int64)
    levels = up_sweep(KEYS[np.concatenate(kinds)], sizes)
    matrices = tops(levels, len(pieces))
    end, cost = chosen(matrices)
    before, after = down_sweep(levels, np.zeros(int((sizes > 0).sum()), np.int64), end[sizes > 0])
    cuts, rows = np.cumsum(sizes) - sizes, []
    for i, p in enumerate(pieces):
        row = dict.fromkeys(PACKED.names) | {"conv_id": p.conv, "part": part, "piece": p.number, "whole": p.begins and p.ends}
        if row["whole"]:
            own = slice(cuts[i], cuts[i] + sizes[i])
            audit, turns = spelled(kinds[i], before[own], after[own], p.roles, p.texts)
            more, added = ending(int(end[i]))
            row |= totals(p.summary, int(cost[i])) | {"audit": audit + more, "turns": turns + added}
        else:
            row |= {"kinds": kinds[i].tobytes(), "roles": p.roles, "texts": p.texts, "summary": p.summary | {"matrix": matrices[i].ravel().tolist()}}
        rows.append(row)
    return pa.RecordBatch.from_pylist(rows, PACKED)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, conv_id, turn, role, text, state, copies, marker), sorted, to pieces of bounded size."""
    now: Piece | None = None
    done: list[Piece] = []
    first, held = False, 0
    for batch in batches:
        for part, conv, turn, role, text, state, copies, marker in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != now.conv:
                done += [now] if now else []
                now, first = Piece(conv, now.number + 1 if now else 0, now is not None), False
            if marker:
                first = True
                continue
            while copies:
                if now.full():
                    now.ends = False
                    done.append(now)
                    now = Piece(conv, now.number + 1, False)
                some = min(copies, PIECE_ROWS)
                held += some + len(text) // 16
                now.add(turn, role, text, state, first, some)
                first, copies = False, copies - some
            if done and held >= PIECE_ROWS:
                yield finished(done, part)
                done, held = [], 0
    if now is not None:
        now.ends = False
        yield finished([*done, now], part)


def ordered(group: pa.Table) -> list[dict]:
    return group.sort_by([("part", "ascending"), ("piece", "ascending")]).to_pylist()


def summed(shift: int) -> Callable[[pa.Table], pa.Table]:
    """Consecutive pieces of a conversation, in any order, to one node, that of its tasks' numbers without `shift` bits."""

    def node(group: pa.Table) -> pa.Table:
        rows, out = ordered(group), dict(NOTHING)
        for r in rows:
            append(out, r["summary"])
        keys = np.array([r["summary"]["matrix"] for r in rows], np.int64).reshape(-1, 4, 4)
        out["matrix"] = up_sweep(keys, np.array([len(rows)]))[-1][0][0].ravel().tolist()
        return pa.Table.from_pylist([{"conv_id": rows[0]["conv_id"], "part": rows[0]["part"] >> shift, "piece": 0, "summary": out}], NODES)

    return node


def topmost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations' nodes with the states before and after them."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            end, cost = chosen(np.array([r["summary"]["matrix"]], np.int64).reshape(1, 4, 4))
            rows.append({"conv_id": r["conv_id"], "part": r["part"], "piece": 0, **totals(r["summary"], int(cost[0])), "before": 0, "after": int(end[0]), "final": True})
        yield pa.RecordBatch.from_pylist(rows, PLACED)


def parted(children: pa.Table, parent: pa.Table) -> pa.Table:
    """The states before and after each child of a node whose own are known."""
    rows, [own] = ordered(children), parent.to_pylist()
    keys = np.array([r["summary"]["matrix"] for r in rows], np.int64).reshape(-1, 4, 4)
    before, after = down_sweep(up_sweep(keys, np.array([len(rows)])), np.array([own["before"]]), np.array([own["after"]]))
    return pa.Table.from_pylist(
        [own | {"part": r["part"], "piece": r["piece"], "before": int(p), "after": int(q), "final": own["final"] and r is rows[-1]} for r, p, q in zip(rows, before, after, strict=True)], PLACED
    )


def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces between known states, repaired."""
    for batch in batches:
        for i in range(batch.num_rows):
            [r] = batch.slice(i, 1).to_pylist()
            kinds = np.frombuffer(r["kinds"], np.uint8)
            levels, some = up_sweep(KEYS[kinds], np.array([len(kinds)])), len(kinds) > 0
            audit, turns = spelled(kinds, *down_sweep(levels, np.array([r["before"]][:some]), np.array([r["after"]][:some])), r["roles"], r["texts"])
            more, added = ending(r["after"]) if r["final"] else ("", [])
            yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in REPAIRED.names} | {"whole": False, "audit": audit + more, "turns": turns + added}], REPAIRED)


def repaired(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """Repaired conversations of `rows` (conv_id, turn, role, text), in pieces.

    copies: how often each row stands there (a long, once if not given); a row of 0 copies only names its conversation.
    Rows are taken by turn, null turns first, equal turns by role, then by the
    text's first 64 code points and its SHA-256. Null roles and texts count as
    one space, so a null text is blank. Initials are case-sensitive; a role
    whose initial isn't s, u or a, an empty one too, can't be kept. Repeated
    rows are duplicates, texts of any length are read whole, other columns are
    ignored, an empty table gives no rows.

    Returned are conv_id, part and piece (the order of a conversation's
    pieces), whole (it has this piece only), of the whole conversation gaps,
    blank, duplicate, truncated, illegal and cost, and of the piece the audit
    and the repaired turns as (role, text). A conversation inside one task is
    one piece, even a long one is cut into pieces of bounded size.
    """
    spoken = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    named = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), spoken.alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("copies")
    )
    none = F.col("copies") == 0
    for c in ("turn", "role", "text"):  # rows that only name a conversation become one
        named = named.withColumn(c, F.when(~none, F.col(c)))
    named = named.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    state = F.when(~F.col("text").rlike(f"[^{SPACES}]"), 2).when(F.col("text").rlike(f"[.!?][{SPACES}]*\\z"), 0).otherwise(1)
    # A marker stands before the first row of each role and text; it is told by a digest, so texts are dealt out once.
    named = named.withColumns({"opening": F.left("text", F.lit(64)), "digest": F.sha2("text", 256)})
    firsts = named.filter("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).getField("turn").alias("turn"), F.first("opening").alias("opening"))
    markers = firsts.withColumns({"text": F.lit(None).cast("string"), "copies": F.lit(0).cast("long"), "state": F.lit(0), "marker": F.lit(True)})
    all_rows = named.withColumns({"state": state, "marker": F.lit(False)}).unionByName(markers.select(*named.columns, "state", "marker"))
    order = ["conv_id", "turn", "role", "opening", "digest"]
    dealt = all_rows.repartitionByRange(*order).sortWithinPartitions(*order, F.col("marker").desc())
    dealt = dealt.select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "turn", "role", "text", "state", "copies", "marker")
    pieces = checkpointed(dealt.mapInArrow(packed, ddl(PACKED)))
    parts = pieces.filter("not whole")
    levels, shift = [parts.select(*NODES.names)], 0
    most = parts.agg(F.max("part")).first()[0] or 0
    block = lambda by: F.shiftright("part", by).alias("block")
    while True:
        levels.append(levels[-1].groupBy("conv_id", block(shift)).applyInArrow(summed(shift), ddl(NODES)))
        if not most:
            break
        most, shift = most // FAN, FAN.bit_length() - 1
    placed = levels[-1].mapInArrow(topmost, ddl(PLACED))
    for i in range(len(levels) - 2, -1, -1):
        by = shift if i else 0
        placed = levels[i].groupBy("conv_id", block(by)).cogroup(placed.groupBy("conv_id", block(0))).applyInArrow(parted, ddl(PLACED))
    spelt = parts.select("part", "piece", "kinds", "roles", "texts").join(placed, ["part", "piece"]).mapInArrow(written, ddl(REPAIRED))
    return pieces.filter("whole").select(*REPAIRED.names).unionByName(spelt)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces, a conversation's in order, to one row a conversation; texts go into the hash piece by piece."""
    last, audit, state, begun = None, [], None, False

    def closed() -> pa.RecordBatch:
        row = {c: last.get(c) for c in DIGESTED.names} | {"audit": "".join(audit), "repaired_sha256": state.hexdigest()}
        return pa.RecordBatch.from_pylist([row], DIGESTED)

    for batch in batches:
        for i in range(batch.num_rows):
            [r] = batch.slice(i, 1).to_pylist()
            if last is None or last["conv_id"] != r["conv_id"]:
                if last is not None:
                    yield closed()
                audit, state, begun = [], hashlib.sha256(), False
            turns = r.pop("turns")
            state.update(("\n" * (begun and bool(turns)) + "\n".join(f"{t['role']}:{t['text']}" for t in turns)).encode())
            last, begun = r, begun or bool(turns)
            audit.append(r["audit"])
    if last is not None:
        yield closed()


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations damaged by a hash of `conv_id:turn`: rows with `copies` (0: dropped, 2: repeated); nulls are one space."""
    known = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    draw = F.crc32(F.concat(known["conv_id"], F.lit(":"), known["turn"]).cast("binary")) % 20
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(draw == 4, "user").otherwise(known["role"]).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.translate(known["text"], ".!?", "")).otherwise(known["text"]).alias("text"),
        F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, repaired, with a digest of each; the hash of a conversation in several pieces reads them in order, one by one."""
    pieces = repaired(damaged(table(spark, sf_dir, "conversations")), F.col("copies"))
    whole = pieces.filter("whole").mapInArrow(digests, ddl(DIGESTED))
    rest = pieces.filter("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return whole.unionByName(rest.mapInArrow(digests, ddl(DIGESTED)))


#: The same in DuckDB, turn by turn: the cheapest way to each state, with its audit and lines.
OP11_SQL = r"""
WITH RECURSIVE hex AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc
),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS key
  FROM conversations
),
drawn AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], key), lambda c, b: xor(c // 256, crc[1 + xor(c, b) % 256])), 4294967295) % 20 AS d FROM keyed, hex
),
after AS (
  SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM drawn, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM after),
seen AS (
  SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut
  FROM numbered
),
inserts(p, k, n) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
edits(k, letter, initial, q, cost) AS (
  VALUES (0, 'D', NULL, 0, 3), (1, 'D', NULL, 1, 3), (2, 'D', NULL, 2, 3), (3, 'D', NULL, 3, 3), (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0),
    (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0), (0, 'R', NULL, 2, 2), (1, 'R', NULL, 2, 2), (2, 'R', NULL, 3, 2), (3, 'R', NULL, 2, 2)
),
reach AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, state, cost, audit, lines FROM (
    SELECT r.conv_id, s.i, e.q AS state, r.cost + 2 * n.n + e.cost + CASE WHEN e.letter <> 'D' AND s.cut THEN 1 ELSE 0 END AS cost, r.audit || repeat('I', n.n) || e.letter AS audit,
      list_concat(list_concat(r.lines, CASE n.n WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN [CASE r.state WHEN 2 THEN 'assistant:' ELSE 'user:' END] ELSE ['user:', 'assistant:'] END),
        CASE e.letter WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [s.role || ':' || s.text] ELSE [CASE e.q WHEN 2 THEN 'user:' ELSE 'assistant:' END || s.text] END) AS lines,
      row_number() OVER (PARTITION BY r.conv_id, e.q ORDER BY r.cost + 2 * n.n + e.cost + CASE WHEN e.letter <> 'D' AND s.cut THEN 1 ELSE 0 END, r.audit || repeat('I', n.n) || e.letter) AS place
    FROM reach r JOIN seen s ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND s.i = r.i + 1 JOIN inserts n ON n.p = r.state JOIN edits e ON e.k = n.k
    WHERE (e.initial IS NULL OR e.initial = s.initial) AND (e.letter = 'D' OR NOT (s.blank OR s.again))
  ) WHERE place = 1
),
sums AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM seen GROUP BY conv_id
),
ends AS (
  SELECT r.conv_id, cost + CASE state WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END AS cost, audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
    list_concat(lines, CASE state WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE CAST([] AS VARCHAR[]) END) AS lines, s.n, s.gaps, s.blank, s.duplicate, s.truncated, s.illegal
  FROM reach r LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM r.conv_id WHERE r.i = coalesce(s.n, 0)
)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS place FROM ends) WHERE place = 1
"""
