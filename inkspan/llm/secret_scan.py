"""Secret scans: fixed patterns plus sliding-window entropy, in DataFrame expressions only.

Spans of a pattern come from the lengths of the matches and of the pieces
between them, summed up by doubling: a text of n matches takes n log n steps.
Entropy candidates are runs of token characters; a fold over the characters of
a run keeps the counts in the last WINDOW characters, packed into a few longs,
and with them the sum of c*log2(c), so each step costs one character in and
one out, whatever the length of the run. A
run is a secret if some window's entropy reaches the threshold of the run's
character class and no allow-list pattern fits the run.

Texts without a candidate pass three regular-expression tests and no fold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import table, text_or_empty

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8
#: Order of kinds at the same start.
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Codes of the candidates' characters, from "+" to "z".
FIRST_CODE, CODES = 43, 80
#: (class, whole-run pattern, bits a character over a window): the first class that fits decides.
CLASSES = (("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0), ("upper", r"^[A-Z0-9]+$", 3.5), ("token", r"^[A-Za-z0-9+/_=-]+$", 3.8))
#: Runs that look random but aren't secrets.
ALLOW = (
    r"^[0-9]+$",
    r"^[^0-9]+$",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example",
    r"(?i)abcdefghij|0123456789|qwertyuiop",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
)

_SPAN = "struct<start:bigint,end:bigint>"


def running_sums(values: Column) -> Column:
    """Sums of an array up to and with each place: in each of log2(n) turns a place adds the sum of as many places before it as it has."""

    def turn(sums: Column, k: Column) -> Column:
        far = F.expr("1").cast("int")
        return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - F.call_function("shiftleft", far, k)), F.lit(0).cast("bigint")))

    turns = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, values, turn)


def match_spans(docs: DataFrame, kind: str, kept: bool) -> DataFrame:
    """Add `kind`, the code-point spans of the matches __found_kind between the pieces __pieces_kind; `kept`: of those only that __keep_kind says."""
    found, pieces, long, ends = (f"__{part}_{kind}" for part in ("found", "pieces", "long", "ends"))
    docs = docs.withColumn(long, F.transform(found, lambda x: F.length(x).cast("bigint")))
    docs = docs.withColumn(ends, F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), long, lambda piece, own: F.length(piece) + own))
    docs = docs.withColumn(ends, F.when(F.size(ends) > 0, running_sums(F.col(ends))))
    spans = F.zip_with(ends, long, lambda end, own: F.struct((end - own).alias("start"), end.alias("end")))
    if kept:
        spans = F.filter(spans, lambda _, i: F.get(F.col(f"__keep_{kind}"), i))
    # Naming the columns outside the lambdas too keeps Catalyst from pasting their expressions into them.
    some = (F.size(ends) > 0) & (F.size(long) > 0)
    if kept:
        some = some & (F.size(f"__keep_{kind}") > 0)
    return docs.withColumn(kind, F.when(some, spans).otherwise(F.array().cast(f"array<{_SPAN}>"))).drop(long, ends)


def best_window_entropy(run: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits a character, of the windows of `run` (a run shorter than a window is one)."""
    bits = window.bit_length()  # of one count
    held = 62 // bits  # counts of a long
    codes = F.transform(F.split(run, ""), lambda c: F.ascii(c) - FIRST_CODE)  # a run is ASCII
    leaving = F.concat(F.array_repeat(F.lit(-1), window), codes)
    length = F.length(run)
    width = F.least(F.lit(window), length).cast("double")

    def xlog(c: Column) -> Column:
        return F.when(c > 0, c * F.log2(F.greatest(c, F.lit(1.0)))).otherwise(F.lit(0.0))

    def unit(code: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(code, F.lit(held)) * bits)

    def count(words: Column, code: Column) -> Column:
        word = F.coalesce(F.get(words, F.floor(code / held).cast("int")), F.lit(0).cast("bigint"))
        return F.call_function("shiftrightunsigned", word, F.pmod(code, F.lit(held)) * bits).bitwiseAND((1 << bits) - 1).cast("double")

    def step(acc: Column, x: Column) -> Column:
        """One character in, one out; before that, the total of the window that ended a step ago is looked at."""
        entering, left = x["entering"], x["leaving"]
        up, down = count(acc["words"], entering), count(acc["words"], left)
        same = entering == left
        change = xlog(up + 1) - xlog(up) + F.when(left >= 0, xlog(down - 1) - xlog(down)).otherwise(F.lit(0.0))
        none = F.lit(0).cast("bigint")
        words = F.transform(
            acc["words"],
            lambda w, k: w + F.when(k == F.floor(entering / held), unit(entering)).otherwise(none) - F.when(k == F.floor(left / held), unit(left)).otherwise(none),
        )
        return F.struct(
            F.when(same, acc["words"]).otherwise(words).alias("words"),
            F.when(same, acc["total"]).otherwise(acc["total"] + change).alias("total"),
            F.when(left >= 0, F.least(acc["least"], acc["total"])).otherwise(acc["least"]).alias("least"),
        )

    words = F.array_repeat(F.lit(0).cast("bigint"), -(-CODES // held))
    zero = F.struct(words.alias("words"), F.lit(0.0).alias("total"), F.lit(1e300).alias("least"))
    steps = F.zip_with(codes, F.slice(leaving, F.lit(1), length), lambda e, o: F.struct(e.alias("entering"), o.alias("leaving")))
    return F.aggregate(steps, zero, step, lambda acc: F.log2(width) - F.least(acc["least"], acc["total"]) / width)


def is_secret(run: Column, window: int = WINDOW, classes: Sequence = CLASSES, allow: Sequence[str] = ALLOW) -> Column:
    bar = F.lit(math.inf)
    for _, pattern, bits in reversed(classes):
        bar = F.when(run.rlike(pattern), F.lit(bits)).otherwise(bar)
    allowed = F.lit(False)
    for pattern in allow:
        allowed = allowed | run.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(best_window_entropy(run, window) >= bar)


def scan_secrets(docs: DataFrame, window: int = WINDOW, classes: Sequence = CLASSES, allow: Sequence[str] = ALLOW) -> DataFrame:
    """The rows of `docs` with assign, access, hex and entropy: arrays of (start, end) in code points, end exclusive.

    A null text counts as empty; empty texts have empty arrays, an empty table
    no rows; repeated rows stay and get equal results. Texts of any length are
    read whole, in time in proportion to their length but for the logarithm of
    their matches. Columns of the input with the names of the new ones are
    replaced.
    """
    text = text_or_empty()
    docs = docs.drop(*KINDS)
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "entropy": CANDIDATE}
    tests = {
        "assign": text.rlike(r"(?i:password|passwd|secret|token|api_?key)"),
        "access": text.contains("AKIA"),
        "hex": text.rlike(HEX),
        "entropy": text.rlike(CANDIDATE),
    }
    out = docs.withColumns({f"__found_{k}": F.when(tests[k], F.regexp_extract_all(text, F.lit(patterns[k]), F.lit(0))) for k in KINDS})
    out = out.withColumns({f"__pieces_{k}": F.when(F.size(f"__found_{k}") > 0, F.split(text, patterns[k], -1)) for k in KINDS})
    values = F.when(F.size("__found_assign") > 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)))
    out = out.withColumns(
        {
            "__keep_assign": F.transform(values, lambda v: F.length(v) >= ASSIGN_LEAST),
            "__keep_entropy": F.transform("__found_entropy", lambda run: is_secret(run, window, classes, allow)),
        }
    )
    for kind in KINDS:
        out = match_spans(out, kind, kept=kind in ("assign", "entropy"))
    return out.drop(*(f"__{part}_{k}" for part in ("found", "pieces", "keep") for k in KINDS))


def digest(kinds: Sequence[str]) -> Column:
    """kind:start:end of the spans, by start and then by the order of kinds, comma-joined."""

    def of(k: int):  # a lambda with a default would be taken for one of two arguments
        return lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"))

    marked = [F.transform(kind, of(k)) for k, kind in enumerate(kinds)]
    names = F.array(*(F.lit(k) for k in kinds))
    return F.array_join(
        F.transform(F.array_sort(F.concat(*marked)), lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(digest(KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
        digest(KINDS).alias("spans"),
    )
