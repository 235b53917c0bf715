"""Document fingerprints by one-permutation MinHash, in DataFrame expressions only.

One hash of every shingle (five words; a shorter text is one shingle) is drawn:
its top byte names one of BINS bins, the rest is its value there, and each bin
keeps its least value. Empty bins are filled by optimal densification: bin i
probes the bins (a_i + r * b_i) mod BINS for r = 0, 1, ... and copies the first
that is not empty; b_i is odd, so the probes meet every bin. Four low-order
bits of each bin, mixed with the bin's number, are packed, sixteen bins to a
long.

The likeness of two fingerprints is the share P of equal bins, corrected for
equal bits by chance: (P - 1/16) / (1 - 1/16), never below 0.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

from inkspan.llm.common import checkpointed, table, text_or_empty

SHINGLE = 5
BINS = 256
BITS = 4
PER_LONG = 64 // BITS
#: Bins are aggregated in groups of so many.
GROUP = 16
GROUPS = BINS // GROUP
#: Probes that are tried one by one. The first later one that meets a filled bin j is the least of
#: (j - a) / b mod BINS over the filled bins: of them there are few when so many probes fail.
QUICK_PROBES = 16
SPACE = "[ \\t\\n\\x0B\\f\\r]+"
EMPTY_BIN = (1 << 56) - 1  # low 56 bits of a sentinel
#: Rows that one task numbers and pairs with their successor, about.
ROWS_A_BUCKET = 500
MAX_BUCKETS = 100_000


def fingerprinted(texts: DataFrame, keys: list[str], text: str, name: str) -> DataFrame:
    """The columns `keys`, which tell the rows apart, and `name`: the packed fingerprint of the column `text`.

    The work is done on exploded rows, which Spark compiles, not in lambdas,
    which it interprets. All aggregations are by `keys`: if the rows already
    lie together by one of them, nothing is shuffled. Texts without words get
    an empty array.
    """
    words = texts.select(*keys, F.filter(F.split(F.lower(F.col(text)), SPACE), lambda w: w != "").alias("__words"))
    count = F.size("__words")
    shingles = F.when(count == 0, 0).otherwise(F.greatest(count - (SHINGLE - 1), F.lit(1)))
    # One row a shingle, and one empty row a group of bins, so that each group comes up.
    words = words.withColumn("__n", shingles).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") + (GROUPS - 1))))
    parts = (F.get("__words", F.col("__i") + k) for k in range(SHINGLE))
    hashed = words.select(*keys, "__n", F.when(F.col("__i") < F.col("__n"), F.xxhash64(*parts)).alias("__h"), F.col("__i"))
    group = F.coalesce(F.shiftrightunsigned("__h", 60), F.col("__i") - F.col("__n")).cast("int")
    slot = F.shiftrightunsigned("__h", 56).bitwiseAND(GROUP - 1)
    hashed = hashed.select(*keys, "__n", group.alias("__g"), slot.alias("__s"), F.col("__h").bitwiseAND(EMPTY_BIN).alias("__v"))
    least = hashed.groupBy(*keys, "__n", "__g").agg(*(F.min(F.when(F.col("__s") == k, F.col("__v"))).alias(f"__{k}") for k in range(GROUP)))
    groups = least.select(*keys, "__n", F.struct("__g", F.array(*(f"__{k}" for k in range(GROUP))).alias("v")).alias("__group"))
    bins = groups.groupBy(*keys, "__n").agg(F.sort_array(F.collect_list("__group")).alias("__groups"))
    bins = bins.select(*keys, "__n", F.flatten("__groups.v").alias("__bins"))
    # Filled bins as value * 256 + number: values have 56 bits.
    bins = bins.withColumn("__filled", F.expr("filter(transform(__bins, (v, j) -> shiftleft(v, 8) | j), x -> x is not null)"))
    bins = bins.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    bins = bins.withColumns({"__a": F.expr(f"cast(xxhash64(__i) & {BINS - 1} as int)"), "__b": F.expr(f"cast(shiftrightunsigned(xxhash64(__i), 8) & {BINS - 1} as int) | 1")})
    # Newton's steps from 1 / b = b mod 8 to mod 64 and beyond BINS.
    once = f"((__b * (2 - __b * __b)) & {BINS - 1})"
    bins = bins.withColumn("__inverse", F.expr(f"({once} * (2 - __b * {once})) & {BINS - 1}"))
    probe = lambda r: f"__bins[(__a + {r} * __b) & {BINS - 1}]"
    turn = f"((cast(x & {BINS - 1} as int) - __a) * __inverse) & {BINS - 1}"
    least = f"array_min(transform(__filled, (x, p) -> ({turn}) * {BINS} + p))"
    # Naming the column outside the lambda too keeps Catalyst from pasting its expression into it.
    rest = f"if(__inverse > 0, shiftrightunsigned(get(__filled, {least} & {BINS - 1}), 8), null)"
    filled = f"coalesce(__bins[__i], {', '.join(map(probe, range(QUICK_PROBES)))}, {rest})"
    nibbles = bins.select(*keys, "__n", "__i", F.expr(f"xxhash64({filled}, __i)").bitwiseAND((1 << BITS) - 1).alias("__nibble"))
    place = F.expr(f"shiftleft(__nibble, ({PER_LONG - 1} - __i % {PER_LONG}) * {BITS})")
    nibbles = nibbles.select(*keys, "__n", F.expr(f"__i div {PER_LONG}").alias("__w"), place.alias("__part"))
    longs = [F.bit_or(F.when(F.col("__w") == w, F.col("__part"))).alias(f"__{w}") for w in range(BINS // PER_LONG)]
    packed = nibbles.groupBy(*keys, "__n").agg(*longs)
    some = F.array(*(f"__{w}" for w in range(BINS // PER_LONG)))
    return packed.select(*keys, F.when(F.col("__n") > 0, some).otherwise(F.expr("cast(array() as array<bigint>)")).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance, 0 to 1, of two packed fingerprints; 1 for two empty ones, 0 for one empty."""
    mask = (1 << 64) // 15  # the lowest bit of each nibble
    signed = mask if mask < 1 << 63 else mask - (1 << 64)

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseOR(F.shiftrightunsigned(z, 3))
        return F.bit_count(z.bitwiseAND(F.lit(signed)))

    apart = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << BITS)
    both = F.greatest(F.lit(0.0), ((1.0 - apart / F.lit(float(BINS))) - chance) / (1.0 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both)


def as_string(packed: Column) -> Column:
    """Hexadecimal digits, one a bin."""
    return F.array_join(F.transform(packed, lambda x: F.lower(F.lpad(F.hex(x), PER_LONG, "0"))), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each distinct (doc_id, text) of `docs`, with fingerprint, an array of 16 longs.

    A null text counts as empty; texts without words have an empty array;
    equal texts, and texts equal but for case and spaces, equal fingerprints.
    Texts of any length are read whole, a row a shingle. An empty table gives
    no rows; other columns, whatever their names, are ignored.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = rows.withColumn("__id", F.xxhash64("doc_id", "text")).repartition("__id").dropDuplicates(["__id", "doc_id", "text"])
    return fingerprinted(rows, ["__id", "doc_id", "text"], "text", "fingerprint").drop("__id")


def in_order(docs: DataFrame, rows_a_bucket: int = ROWS_A_BUCKET) -> tuple[DataFrame, WindowSpec]:
    """Rows dealt into buckets so that a row's successor, by descending doc_id, is in its bucket.

    Null ids come last; rows of one id follow one another by descending hash
    of their text. Rows are cut into even buckets at approximate quantiles of
    the ids, and an id that fills several buckets (null ids, say) at quantiles
    of the hashes; only rows equal in both stay together. The rows at a
    bucket's upper end are also guests behind the last row of the bucket above,
    and the first rows of all behind the last of all, where the order begins
    again. Returns the rows with __bucket and __guest, and the window.
    """
    spark = docs.sparkSession
    keyed = docs.withColumns({"__key": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__tie": F.xxhash64("text")})
    keys = checkpointed(keyed.select("__key", "__tie"))
    buckets = min(MAX_BUCKETS, max(1, -(-keys.count() // rows_a_bucket)))
    points = [i / buckets for i in range(1, buckets)]
    times = Counter((keys.agg(F.percentile_approx("__key", points, 10 * buckets)).first()[0] or ()) if points else ())  # at most MAX_BUCKETS ids
    heavy = [key for key, n in times.items() if n > 2]
    cuts = {(key, (1 << 63) - 1) for key in times}
    if heavy:  # each fills two buckets or more, so they are few
        inside = keys.join(F.broadcast(spark.createDataFrame([(k,) for k in heavy], "__key long")), "__key").groupBy("__key")
        even = max(times[key] for key in heavy)
        for r in inside.agg(F.percentile_approx("__tie", [i / even for i in range(1, even)], 10 * even).alias("ties")).toLocalIterator():
            cuts |= {(r["__key"], tie) for tie in r.ties[:: max(1, even // times[r["__key"]])]}
    cuts = sorted(cuts)
    middle = "((z.lo + z.hi) div 2)"
    here = f"cast({middle} as int)"
    below = f"__ids[{here}] < __key or (__ids[{here}] = __key and __ties[{here}] < __tie)"
    search = (
        "aggregate(sequence(1, 20), named_struct('lo', 0L, 'hi', cast(size(__ids) as bigint)), (z, i) -> "
        f"if(z.lo >= z.hi, z, if({below}, named_struct('lo', {middle} + 1, 'hi', z.hi), named_struct('lo', z.lo, 'hi', {middle}))), "
        "z -> cast(z.lo as int))"
    )
    longs = lambda values: F.lit(values).cast("array<bigint>") if values else F.expr("cast(array() as array<bigint>)")

    def homes(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"__ids": longs([k for k, _ in cuts]), "__ties": longs([t for _, t in cuts])})
        return rows.withColumn("__home", F.expr(search)).drop("__ids", "__ties")

    # The upper end of each bucket that has rows, and the bucket above it: at most MAX_BUCKETS rows.
    tops = sorted((r["__home"], r.top[0], r.top[1]) for r in homes(keys).groupBy("__home").agg(F.max(F.struct("__key", "__tie")).alias("top")).collect())
    tops = [(home, key, tie, above) for (home, key, tie), (above, _, _) in zip(tops, tops[1:] + tops[:1], strict=True)]
    tops = F.broadcast(spark.createDataFrame(tops, "__home int, __top_key long, __top_tie long, __above int"))
    frame = homes(keyed).join(tops, "__home")
    place = lambda b, g: F.struct(F.col(b).alias("bucket"), F.lit(g).alias("guest"))
    both = F.array(place("__home", False), place("__above", True))
    upper = (F.col("__key") == F.col("__top_key")) & (F.col("__tie") == F.col("__top_tie"))
    frame = frame.withColumn("__place", F.explode(F.when(upper, both).otherwise(F.slice(both, 1, 1))))
    frame = frame.withColumns({"__bucket": F.col("__place.bucket"), "__guest": F.col("__place.guest")}).drop("__place", "__home", "__above", "__top_key", "__top_tie")
    order = W.partitionBy("__bucket").orderBy("__guest", F.col("__key").desc(), F.col("__tie").desc(), F.col("text").asc_nulls_first())
    return frame, order


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and the next document's.

    The edited text has the last floor(n/2) code points replaced by the first
    as many (or all) of the next document's, by descending doc_id, the first
    following the last. A null text counts as empty and its edited text is
    empty; an empty table gives no rows; rows of one id are ordered by a hash
    of their text, nulls among the ids come last; repeated rows stay, each
    followed by its twin. Texts of any length are read whole; other columns,
    whatever their names, are ignored.
    """
    frame, order = in_order(docs.select("doc_id", text_or_empty().alias("text")))
    frame = frame.repartition("__bucket").withColumns({"__row": F.row_number().over(order), "__next": F.lead("text").over(order)})
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.substring("__next", F.lit(1), F.floor(n / 2).cast("int")))
    frame = frame.withColumn("__edited", F.when(~F.col("__guest"), edited))
    version = lambda k, text: F.struct(F.lit(k).alias("k"), text.alias("text"))
    both = F.array(version(0, F.col("text")), version(1, F.col("__edited")))
    frame = frame.select(
        "__bucket",
        "__row",
        "__guest",
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.unhex(F.sha2(F.col("__edited").cast("binary"), 256)).alias("__sha"),
        F.explode(F.when(F.col("__guest"), F.slice(both, 1, 1)).otherwise(both)).alias("__version"),
    ).withColumns({"__k": F.col("__version.k"), "__text": F.col("__version.text")})
    prints = fingerprinted(frame, ["__bucket", "__row", "__k", "__guest", "doc_id", "n_chars", "__sha"], "__text", "__print")
    # A row's text is followed by its edited text and that by the next row's text.
    follow = W.partitionBy("__bucket").orderBy("__row", "__k")
    prints = prints.withColumns({"__edited_print": F.lead("__print", 1).over(follow), "__next_print": F.lead("__print", 2).over(follow)})
    return prints.filter((F.col("__k") == 0) & ~F.col("__guest")).select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("__sha")).alias("edited_sha256"),
        as_string(F.col("__print")).alias("fingerprint"),
        as_string(F.col("__edited_print")).alias("edited_fingerprint"),
        likeness(F.col("__print"), F.col("__edited_print")).alias("near_edited"),
        likeness(F.col("__print"), F.col("__next_print")).alias("near_next"),
    )


def op1_oph_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))
