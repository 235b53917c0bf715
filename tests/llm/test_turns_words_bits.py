"""Conversation repair, spelling variants and SimHash against plain code, and on odd rows."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkspan.llm import conversations, decontamination, neardup, queries, sharding, simhash, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\f\r"
SQL_QUERIES = ["op11_conversation_repair", "op12_spelling_variants"]


@pytest.mark.parametrize("name", SQL_QUERIES)
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_rows_are_the_sql_s(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    rows = queries.QUERIES[name](spark, folder)
    found = con.execute(queries.ORACLES[name])
    order = [[d[0] for d in found.description].index(c) for c in rows.columns]
    assert collections.Counter(tuple(r) for r in rows.collect()) == collections.Counter(tuple(r[i] for i in order) for r in found.fetchall())


# 11. Conversation structure repair


def plain_repair(rows):
    """Dijkstra over (turns done, state) with whole audits, least cost and then least audit first; rows are in order."""
    seen, counts, left = set(), collections.Counter(), []
    for role, text in rows:
        spoken = text.strip(SPACE)
        blank, again = not spoken, (role, text) in seen
        seen.add((role, text))
        cut = not blank and not again and spoken[-1] not in ".!?"
        counts["blank"] += blank
        counts["duplicate"] += again and not blank
        counts["truncated"] += cut
        left.append((role, text, blank or again, cut))
    counts["illegal"] = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(left) and state in ("", "a"):
            return counts, cost, audit, "\n".join(lines)
        to = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[to]
        heapq.heappush(heap, (cost + 2, audit + "I", at, to, (*lines, f"{name}:")))
        if at < len(left):
            role, text, must, cut = left[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, lines))
            if not must:
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", at + 1, to, (*lines, f"{name}:{text}")))
                if role[:1] == to or (role[:1], state) == ("s", ""):
                    heapq.heappush(heap, (cost + cut, audit + "K", at + 1, role[:1], (*lines, f"{role}:{text}")))


def check_repair(spark, rows, **more):
    """rows: (conv_id, turn, role, text) in the order in which they count, without nulls but in conv_id and turn."""
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = conversations.repaired(frame, **more)
    got = collections.defaultdict(list)
    for r in sorted(pieces.collect(), key=lambda r: (r.part, r.piece)):
        got[r.conv_id].append(r)
    expected = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        expected[conv].append((turn, role, text))
    assert got.keys() == expected.keys()
    for conv, turns in expected.items():
        counts, cost, audit, text = plain_repair([x[1:] for x in turns])
        own = got[conv]
        assert "".join(r.audit for r in own) == audit and {r.cost for r in own} == {cost}
        assert "\n".join(f"{t.role}:{t.text}" for r in own for t in r.turns) == text
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        assert {(r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) for r in own} == {(gaps, *(counts[c] for c in ("blank", "duplicate", "truncated", "illegal")))}
    return got


def random_turns(rng, count):
    roles, texts = ["system", "user", "assistant", "tool", "s", "", "User"], ["", " ", "yes.", "no", "why? ", "ok!", "a\nb", "x"]
    return [(rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts) if rng.random() < 0.3 else f"text {rng.random()}" + rng.choice([".", "", "? "])) for _ in range(count)]


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool"]), st.sampled_from(["", "a.", "b", "c!", "d."])), max_size=9))
@settings(max_examples=300, deadline=None)
def test_matrices_find_the_cheapest_and_least_audit(rows):
    counts, cost, audit, _ = plain_repair(rows)
    seen, kinds = set(), []
    for role, text in rows:
        must = not text or (role, text) in seen
        kinds.append(conversations.kind("sua".find(role[0]) % 4, must, not must and text[-1] not in ".!?"))
        seen.add((role, text))
    kinds = np.array(kinds, np.int64)
    some = len(kinds) > 0
    levels = conversations.up_sweep(conversations.KEYS[kinds], np.array([len(kinds)]))
    end, found = conversations.chosen(conversations.tops(levels, 1))
    states = conversations.down_sweep(levels, np.zeros(int(some), np.int64), end[: int(some)])
    letters = "".join(conversations.AUDITS[k][p][q] for k, p, q in zip(kinds, *states, strict=True))
    assert (found[0], letters + conversations.ending(end[0])[0]) == (cost, audit)


@given(st.lists(st.integers(0, 15), min_size=3, max_size=12), st.data())
@settings(max_examples=200, deadline=None)
def test_products_of_matrices_are_associative(kinds, data):
    a, b, c = (conversations.up_sweep(conversations.KEYS[np.array(k)], np.array([len(k)]))[-1][0] for k in np.array_split(kinds, 3))
    left, right = conversations.product(conversations.product(a, b), c), conversations.product(a, conversations.product(b, c))
    reachable = left < conversations.INFINITE * 4
    assert (reachable == (right < conversations.INFINITE * 4)).all() and (left >> 2 == right >> 2).all()
    for x, y in zip(left[0], right[0], strict=True):
        some = x < conversations.INFINITE * 4
        assert (np.argsort(x[some] & 3) == np.argsort(y[some] & 3)).all()


def test_conversations_of_all_lengths(spark):
    rng = random.Random(4)
    rows = [(conv, turn * rng.choice([1, 1, 1, 2]) if conv % 2 else turn, role, text) for conv in range(60) for turn, (role, text) in enumerate(random_turns(rng, rng.randint(1, 14)))]
    rows = [(c, sum(1 for x in rows[:i] if x[0] == c) + (3 if c % 7 == 0 and i % 2 else 0), r, t) for i, (c, _, r, t) in enumerate(rows)]
    check_repair(spark, sorted(rows, key=lambda r: r[:3] + (r[3][:64], hashlib.sha256(r[3].encode()).hexdigest())))


def test_a_long_conversation_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE_ROWS", 50)
    monkeypatch.setattr(conversations, "FAN", 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(5)
    rows = [(7, turn, role, text) for turn, (role, text) in enumerate(random_turns(rng, 3000))]
    rows += [(conv, turn, role, text) for conv in (6, 8) for turn, (role, text) in enumerate(random_turns(rng, 4))]
    try:
        got = check_repair(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.part for r in got[7]}) > 1 and len(got[7]) > 20


def test_odd_conversations(spark):
    long = "word " * 60_000 + "end."
    rows = [(None, None, "user", "a."), (None, 1, "assistant", "b."), (1, None, "assistant", "z."), (1, -5, "user", "q?"), (1, -5, "user", "q?"), (1, 9, "user", long), (1, 9, "user", long)]
    rows += [(2, 1, "user", "same.")] * 40 + [(3, 1, " ", "x."), (3, 2, "", "y.")]
    check_repair(spark, rows)
    schema = "conv_id long, turn long, role string, text string, part string, audit string, copies string, state int"
    frame = spark.createDataFrame([(4, 1, None, "hm.", "p", "a", "c", 5), (4, 2, "assistant", None, "p", "a", "c", 5), (5, 1, "user", "gone", "p", "a", "c", 5)], schema)
    found = {r.conv_id: r for r in conversations.repaired(frame, F.when(F.col("conv_id") == 5, 0).otherwise(1)).collect()}
    assert (found[4].blank, found[4].illegal, found[4].cost, found[4].audit, found[4].turns) == (1, 1, 6, "DD", [])
    assert [found[5][c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns")] == [0] * 6 + ["", []]
    assert conversations.repaired(frame.limit(0)).count() == 0


def test_damage_follows_the_hash(spark):
    rows = [(c, t, "assistant", "One. Two? No! so") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in conversations.damaged(frame).collect():
        key = f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}"
        draw = zlib.crc32(key.encode()) % 20
        role, text = (" ", " ") if r.conv_id is None else ("assistant", "One. Two? No! so")
        assert r.copies == {0: 0, 3: 2}.get(draw, 1) and r.role == ("user" if draw == 4 else role)
        assert r.text == ("" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text)


def test_digests_of_pieces_and_of_whole_conversations_agree(spark, sf_dir, monkeypatch):
    rows = sorted(map(tuple, queries.QUERIES["op11_conversation_repair"](spark, sf_dir).collect()))
    monkeypatch.setattr(conversations, "PIECE_ROWS", 2)
    assert sorted(map(tuple, queries.QUERIES["op11_conversation_repair"](spark, sf_dir).collect())) == rows
    again = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert {r[0] for r in rows} == {r.conv_id for r in again.select("conv_id").distinct().collect()}


# 12. Spelling variants


def edits(word, letters):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}


def plain_variants(counts, ratio=5):
    letters, form, out = {c for w in counts for c in w}, {}, {}
    for w, n in counts.items():
        near = sorted(((-counts[x], x) for x in edits(w, letters) - {w} if x in counts))
        form[w] = near[0][1] if near and -near[0][0] >= ratio * n else None
        out[w] = len(near)
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        yield (w, form[w], root, counts[w], out[w], counts[form[w]] if form[w] else None)


def check_variants(spark, counts):
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variants(frame).collect()), key=str) == sorted(plain_variants(counts), key=str)


def test_variants_of_random_and_crowded_words(spark):
    rng = random.Random(6)
    counts = {"".join(rng.choices("abé", k=rng.randint(6, 8))): rng.choice([5, 5, 6, 25, 30, 150, 800, 4000]) for _ in range(700)}
    check_variants(spark, counts)  # few letters: every mask is crowded
    base = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzàÿ", k=rng.randint(6, 40))) for _ in range(40)]
    counts = {w: rng.randint(5, 60) for b in base for w in rng.sample(sorted(edits(b, "abxÿ")), 20) + [b] if len(w) >= 6}
    check_variants(spark, counts)


def test_chains_of_forms_and_ties(spark):
    chain = ["aaaaaaaaaaaaaaaaaaaa"[: 6 + i] for i in range(12)]
    check_variants(spark, {w: 5 ** (i + 1) for i, w in enumerate(chain)})
    check_variants(spark, {"banana": 5, "bananb": 25, "banané": 25, "Bananas": 24, "a" * 5000: 5, "a" * 4999 + "b": 30})


def test_words_lose_letters_by_hash(spark):
    rows = [(d, "Straße NAÏVE naïve Été-été élan x" * 3) for d in range(300)] + [(None, "word"), (None, None), (1, ""), (2, "12 ,;")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("run", F.lit("clash"))
    got = collections.Counter(r[0] for r in spelling.runs(frame).select(spelling.misspelled(7)).collect())
    expected = collections.Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            expected[run if h % 7 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    assert got == expected
    assert spelling.variants(spelling.vocabulary(frame.limit(0).select(F.col("text").alias("word")))).count() == 0


# 13. SimHash


def plain_simhash(text):
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", (text or "").translate(LOWER)) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values):
    values, root = np.array(values, np.uint64), list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 2) + i + 1:
            a, b = top(i), top(int(j))
            root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def test_documents_fingerprints_and_components(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    near = [(10_000 + i, rows[i % 7][1] + " x" * i) for i in range(30)]
    values = [plain_simhash(t) for _, t in rows + near]
    ids = [d for d, _ in rows + near]
    least = collections.defaultdict(list)
    tops = plain_components(values)
    for d, t in zip(ids, tops, strict=True):
        least[t].append(d)
    got = simhash.near_fingerprints(spark.createDataFrame(rows + near, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.bits % (1 << 64), r.component_id) for r in got} == {d: (v, min(least[t])) for d, v, t in zip(ids, values, tops, strict=True)}
    assert [r for r in queries.QUERIES["op13_simhash_gray"](spark, sf_dir).collect() if int(r.fingerprint, 16) != plain_simhash(dict(rows)[r.doc_id])] == []


@pytest.mark.parametrize("limit", [32, 100, 1 << 13])
def test_crowded_groups_are_split_and_lose_no_link(spark, monkeypatch, limit):
    rng = random.Random(7)
    hubs = [rng.getrandbits(64) for _ in range(20)] + [0, (1 << 64) - 1]
    values = {h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for h in hubs for _ in range(40)} | {rng.getrandbits(20) for _ in range(300)}
    values = sorted(values)
    classes = spark.createDataFrame([(simhash.signed(v),) for v in values], "bits long")
    found = None
    for rows in simhash.groups(classes, 2, limit):
        assert (rows.groupBy("mask", F.col("bits").bitwiseAND(F.col("mask"))).count().agg(F.max("count")).first()[0] or 0) <= limit
        links = rows.groupBy(F.pmod(F.col("mask"), F.lit(5))).applyInArrow(lambda g: simhash.stars(g, 2), "u long, v long")
        found = links if found is None else found.unionByName(links)
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for r in found.collect():
        a, b = top(r.u % (1 << 64)), top(r.v % (1 << 64))
        root[max(a, b)] = min(a, b)
    tops = plain_components(values)
    assert [top(v) for v in values] == [values[t] for t in tops]


@given(st.lists(st.integers(0, (1 << 64) - 1) | st.integers(0, 255), unique=True, max_size=120), st.integers(0, 4))
@settings(max_examples=100, deadline=None)
def test_the_index_finds_every_pair_once(values, most):
    bits = np.array(values, np.uint64)
    index = simhash.GrayIndex(bits, bits.astype(np.int64) % 2 if most % 2 else np.zeros(len(bits), np.int64))
    got = [tuple(sorted((int(index.bits[a]), int(index.bits[b])))) for i, j in index.links(most) for a, b in zip(i, j, strict=True)]
    expected = [tuple(sorted(p)) for p in itertools.combinations(values, 2) if (p[0] ^ p[1]).bit_count() <= most and (not most % 2 or (p[0] ^ p[1]) % 2 == 0)]
    assert sorted(got) == sorted(expected)


def test_gray_neighbours_differ_in_one_bit():
    codes = np.arange(1 << 10, dtype=np.uint64)
    ordered = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(ordered[1:] ^ ordered[:-1]) == 1).all()


def test_odd_texts_have_fingerprints(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [(1, None), (2, ""), (3, " \n"), (None, None), (4, "One"), (5, "oNE"), (5, "oNE"), (6, long), (7, long), (None, long), (8, "a b É"), (9, "a b É")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("bits", "size", "component_id", "mask")})
    got = simhash.near_fingerprints(frame).collect()
    assert sorted((str(r.doc_id), r.bits % (1 << 64), r.component_id) for r in got) == sorted(
        (str(d), plain_simhash(t), c) for (d, t), c in zip(rows, [1, 1, 1, 1, 4, 4, 4, 6, 6, 6, 8, 8], strict=True)
    )
    assert simhash.near_fingerprints(frame.limit(0)).count() == 0


# Words and hot keys of earlier operators


def test_long_words_of_one_polynomial_hash_are_told_apart(spark):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    x, y = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))  # equal sums modulo 2**64 for any odd base
    rows = spark.createDataFrame([(1, f"one {x} two three"), (2, f"one {y} two three"), (3, f"one {x} two three")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(rows, k=4).collect()} == {1: 1, 2: 2, 3: 1}
    raw = np.frombuffer(f"{x} {y} {x}".encode(), np.uint8)
    names = decontamination.words_of(raw, np.array([0, len(raw)]), decontamination.Roller())[0]
    assert names[0] == names[2] != names[1]


def test_hot_classes_bands_and_keys_are_dealt_out(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=60) for _ in range(40)]
    rows = [(i, " ".join(base[0])) for i in range(1500)] + [(5000 + i, " ".join(base[0][:58] + [f"x{i}"])) for i in range(700)] + [(9000 + i, " ".join(b)) for i, b in enumerate(base)] + [(9900, None), (9901, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame).collect()}
    expected = {d: 0 if d < 5700 or d == 9000 else d for d, _ in rows}
    assert got == expected
    shards = sharding.shard_documents(frame).collect()
    by_text = collections.defaultdict(set)
    for r in shards:
        by_text[r.text or ""].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values()) and len(shards) == len(rows)
    for s in range(16):
        assert sorted(r.slot for r in shards if r.shard == s) == list(range(sum(r.shard == s for r in shards)))
