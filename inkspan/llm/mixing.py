"""Mixing sources to target weights.

Words are summed per source; water-filling turns weights into targets that
stop at `cap` times the source; a source's repetition rate is its target over
its size. Each document is taken floor(rate) times, and once more if a uniform
number hashed from the seed, its id and its text is below the rate's fraction.

Sources are rows of a table like any others: they are numbered range by range
and filled up in rounds of sums, so their number has no bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import aside, checkpointed, table, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
SEED = "mix-1"
#: Up to so many sources their rates are broadcast (some MB); beyond, Spark joins by key and splits skewed ones.
BROADCAST_SOURCES = 100_000


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Sources with `rank` from 0 in code-point order, null last."""
    # A first letter stands before each name and a later one for null, so one column orders them.
    key = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))
    rows = checkpointed(sources.withColumn("__key", key))
    rows = rows.repartitionByRange("__key").sortWithinPartitions("__key").withColumn("__id", F.monotonically_increasing_id())
    rows = checkpointed(rows)  # partitions are in order, and an id's upper bits are its partition
    part = F.shiftright("__id", 33)
    before, starts = 0, []
    for r in sorted(rows.groupBy(part.alias("part")).count().collect()):  # a row a partition
        starts.append((r["part"], before))
        before += r["count"]
    starts = rows.sparkSession.createDataFrame(starts, "__part long, __start long")
    rows = rows.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return rows.withColumn("rank", F.col("__start") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__key", "__id", "__part", "__start")


def targets(sources: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, source_size, weight) with target: shares of all words by weight, none above cap * source_size, the excess reshared.

    In each round the sources whose share is above their cap get the cap; the
    rest share what is left. At most as many rounds as sources, mostly two.
    """
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    size, weight, level = F.col("source_size"), F.col("weight"), None
    full = size <= 0
    while True:
        sums = sources.agg(F.sum(F.when(full, cap * size)).alias("taken"), F.sum(F.when(~full, weight)).alias("weight"), F.count(F.when(full, 1)).alias("full")).first()
        left = total - (sums.taken or 0.0)
        share = F.lit(left) * weight / F.lit(sums.weight or 1.0)
        if level == sums.full:
            return sources.withColumn("target", F.when(full, cap * size).otherwise(share))
        # Shares only grow from round to round, so what is full stays full.
        level, full = sums.full, full | (share > cap * size)


def uniform(seed: str, *columns: Column) -> Column:
    """A number in [0, 1) from 32 bits of an MD5 of the seed and the columns."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The rows of `docs` with size, source_size, target (its source's) and copies.

    Sources stand in code-point order, null last, and take the weights in turn.
    A null or empty text has size 0; a source without words has target 0 and
    its rows no copies. Rows equal in id and text decide alike; repeated rows
    stay; an empty table gives no rows. Texts of any length are counted whole.
    Columns of the input with the names of the new ones are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "copies").withColumn("size", word_count())
    sums = ranked(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    given = F.array(*(F.lit(float(w)) for w in weights))
    aimed = targets(sums.withColumn("weight", F.get(given, (F.col("rank") % len(weights)).cast("int"))), cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = checkpointed(aimed.select(F.col("source").alias("__source"), "source_size", "target", rate.alias("__rate")))
    rates = F.broadcast(rates) if rates.count() <= BROADCAST_SOURCES else rates
    rate = F.col("__rate")
    draw = uniform(seed, F.col("doc_id"), F.md5(text_or_empty().cast("binary")))
    return (
        docs.join(rates, F.col("source").eqNullSafe(F.col("__source")), "left")
        .withColumn("copies", (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int"))
        .drop("__source", "__rate")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each row of `docs` as often as the plan takes it, with the columns of `docs` as they are."""
    renamed, own = aside(docs, "doc_id", "text", "source")
    plan = mix_plan(renamed, weights, cap, seed).filter("copies > 0")
    return plan.withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*own)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


#: The same in DuckDB: sources in order of cap over weight fill up until the rest stays below theirs.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) AS cap,
    CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM s
),
f AS (
  SELECT *, (SELECT CAST(sum(size) AS DOUBLE) FROM d) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share, cap / weight AS level
  FROM w WHERE source_size > 0
),
e AS (SELECT rest, share FROM f WHERE rest * weight / share <= cap ORDER BY level LIMIT 1),
t AS (
  SELECT w.source, w.source_size, CASE WHEN w.source_size = 0 THEN 0.0
    WHEN (SELECT rest FROM e) IS NULL OR (SELECT rest FROM e) * w.weight / (SELECT share FROM e) > w.cap THEN w.cap
    ELSE (SELECT rest FROM e) * w.weight / (SELECT share FROM e) END AS target FROM w
),
r AS (
  SELECT d.doc_id, d.size, t.source_size, CAST(t.target AS DOUBLE) AS target, CASE WHEN t.source_size > 0 THEN CAST(t.target AS DOUBLE) / t.source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || d.digest), 1, 8) AS BIGINT) / 4294967296.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
