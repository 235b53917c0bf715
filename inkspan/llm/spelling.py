"""Grouping of spelling variants by letter-parity masks.

A word's mask has a bit for each letter (code points fold onto MASK_BITS bits):
whether it stands an odd number of times. One inserted or deleted letter flips
one bit, a replaced one at most two; so of three bands of the mask one at least
stays as it is. Words are joined on equal bands with lengths at most one apart,
and verified.

Masks alone put words of the same few letters into large buckets, so a bucket
is split by a second invariant: one edit lies in one half of a word and leaves
the other as it is. With m the length of the shorter word, either the first
m // 2 letters of both or the last m - m // 2 are equal. The join is on (m,
band, half) and loses no pair. A pair that meets by several bands or halves
counts at the first of them.

The table of words is the vocabulary, not the corpus: counted with partial
sums, it alone is joined. A word has at most some hundreds of near words times
its length, so no word is a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import checkpointed, table, text_or_empty

RUN = r"[A-Za-zÀ-ÿ]+"
#: Letters go to bands by their code point modulo BANDS, and to one of BAND_BITS bits there.
BANDS, BAND_BITS = 3, 21
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: A form's n is at least RATIO times its word's, and below 2**63; so a chain of forms has at most 27 steps, 5 doublings.
DOUBLINGS = 5


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run): runs of letters of each whole text with A-Z lower-cased; doc_id as text, a null one empty."""
    lower = F.translate(text_or_empty(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))


def misspelled(every: int) -> Column:
    """The run, or where `every` divides the crc32 of `doc_id:run`, the run without its code point crc32 % length."""
    draw = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    at = (draw % F.length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return F.when(draw % every == 0, without).otherwise(F.col("run"))


def vocabulary(words: DataFrame, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the column word of `words`: those of enough code points and occurrences."""
    return words.filter(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= count)


def parity_mask() -> Column:
    """The bits of the letters that stand an odd number of times in `word`."""
    bit = f"shiftleft(1L, cast(ascii(c) % {BANDS} * {BAND_BITS} + ascii(c) div {BANDS} % {BAND_BITS} as int))"
    return F.expr(f"aggregate(split(word, ''), 0L, (mask, c) -> mask ^ {bit})")


def same_band(a: Column, b: Column, band: int) -> Column:
    return a.bitwiseXOR(b).bitwiseAND(F.lit((1 << BAND_BITS) - 1 << band * BAND_BITS)) == 0


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, other, n): both directions of every pair of `words` (word, n, each once) that one insertion, deletion or replacement of
    a code point turns into each other, with the other's n."""
    masked = words.withColumn("mask", parity_mask())

    def met(m: Column) -> Column:
        """Keys of the bands and halves at a shorter length `m`, each with its number."""
        half = (m / 2).cast("int")
        halves = F.substring("word", F.lit(1), half), F.substring("word", F.length("word") - m + half + 1, m)
        band = lambda b: F.col("mask").bitwiseAND(F.lit((1 << BAND_BITS) - 1 << b * BAND_BITS))
        return F.array(*(F.struct(F.lit(2 * b + side).alias("slot"), F.xxhash64(m, F.lit(2 * b + side), band(b), text).alias("key")) for b in range(BANDS) for side, text in enumerate(halves)))

    length = F.length("word")
    short = masked.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("mask").alias("a_mask"), F.inline(met(length)))
    long = masked.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("mask").alias("b_mask"), F.explode(F.concat(met(length), met(length - 1)).getField("key")).alias("key"))
    a, b, m = F.col("a"), F.col("b"), F.length("a")
    half = (m / 2).cast("int")
    first_band = F.coalesce(*(F.when(same_band(F.col("a_mask"), F.col("b_mask"), i), i) for i in range(BANDS)))
    first_slot = first_band * 2 + F.when(F.substring("a", F.lit(1), half) == F.substring("b", F.lit(1), half), 0).otherwise(1)
    apart = F.length(b) - m
    pairs = short.join(long, "key").filter(((apart == 1) | (apart == 0) & (a < b)) & (F.col("slot") == first_slot) & (F.levenshtein(a, b, 1) == 1))
    both = F.array(F.struct(a.alias("word"), b.alias("other"), F.col("b_n").alias("n")), F.struct(b.alias("word"), a.alias("other"), F.col("a_n").alias("n")))
    return pairs.select(F.inline(both))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each row of `forms` (word, form): the last form that following forms leads to."""
    jumps = checkpointed(forms.select("word", F.col("form").alias("root")))
    for _ in range(DOUBLINGS):
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumps = checkpointed(jumps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not jumps.filter("moved").head(1):
            break
    return jumps.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of each row of `words` (word, n; each word once).

    Near words are one edit of a code point away. A word's form is its near
    word of largest n, of equal ones the least in code-point order, if that n
    is at least `ratio` times the word's; else null. Its root is the end of
    the chain of forms, itself if it has none. Words that are null or empty are
    near no other by this method and stand alone; an empty table gives no rows.
    """
    words = checkpointed(words.select("word", "n"))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "other")).alias("best"))
    best_n = -F.col("best.less")
    has = best_n >= ratio * F.col("n")
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, best_n).alias("form_n")
    )
    known = checkpointed(known)
    out = known.join(roots(known.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of the words of all documents, with letters lost by hash."""
    found = runs(table(spark, sf_dir, "documents")).select(misspelled(199).alias("word"))
    return variants(vocabulary(found))


#: The same in DuckDB by deletions: words of one length are near if they are equal without the same letter, others if one is the other without a letter.
OP12_SQL = r"""
WITH RECURSIVE hex AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc
),
found AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents
),
counted AS (SELECT id, run, count(*) AS n FROM found GROUP BY ALL),
keyed AS (
  SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [195, CAST(ord(x) AS BIGINT) - 64] END)) AS key FROM counted
),
drawn AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], key), lambda c, b: xor(c // 256, crc[1 + xor(c, b) % 256])), 4294967295) AS h FROM keyed, hex),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM drawn),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gone AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v, unnest(range(1, length(word) + 1)) AS t(i)),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, v.word, v.n FROM gone g JOIN v ON v.word = g.rest
  UNION SELECT v.word, g.word, g.n FROM gone g JOIN v ON v.word = g.rest
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, encode(other)) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
known AS (
  SELECT v.word, v.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 5 * v.n THEN r.other END AS form, CASE WHEN r.n >= 5 * v.n THEN r.n END AS form_n
  FROM v LEFT JOIN ranked r ON r.word = v.word AND r.place = 1
),
chain AS (SELECT word, form AS root FROM known WHERE form IS NOT NULL UNION ALL SELECT c.word, k.form FROM chain c JOIN known k ON k.word = c.root WHERE k.form IS NOT NULL),
tops AS (SELECT c.word, c.root FROM chain c JOIN known k ON k.word = c.root WHERE k.form IS NULL)
SELECT known.word, form, coalesce(tops.root, known.word) AS root, n, n_near, form_n FROM known LEFT JOIN tops ON tops.word = known.word
"""
