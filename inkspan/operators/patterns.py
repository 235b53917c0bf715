"""Evidence of the nine writing-pattern categories and of copied assistant marks, with offsets, and the sentences it lies in.

All patterns are sought in one pass over a text; the rest is array expressions
of the same row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.text import PATTERN_SENTENCE, PATTERN_WORD
from inkspan.functions.udfs import find_spans
from inkspan.operators.revision import SUGGESTED
from inkspan.plans.signals import ANCHOR, ANCHORED, CHATBOT, CITATIONS, CLAIMS, HEDGES, LABELS, MARKERS, PROVENANCE, RHETORIC, STRUCTURES, TRANSITIONS, VAGUE

#: Evidence rows of a category that a profile shows, and in which sentences are flagged.
SHOWN = 12
# Kinds of the patterns of a category, in their order.
KINDS = {
    "structure": ("formulaic introduction", "negative parallelism", "announcement framing", "generic conclusion", "stock significance frame"),
    "register": ("assistant opener", "assistant closer", "reasoning narration"),
    "rhetoric": ("not-X-but-Y frame", "performed discovery", "mini-aphorism", "comparative framing", "significance flourish"),
    "provenance": ("unfilled template placeholder", "AI-assistant citation markup", "AI-tool tracking link"),
}
PUNCTUATION = {
    "em dash": "—", "spaced double hyphen": r"(?<!-)\s--\s(?!-)", "wrapped em-dash aside": r"—[^—\n]{2,100}—",
    "announcement colon": r"(?i)\b(?:the (?:problem|answer|reason|rule|point)|what matters)\s*:",
}


def sought() -> dict[str, str]:
    """Pattern by "category|order|kind"."""
    found = {f"predictability|{i}|stock vocabulary": rf"(?i)\b{m}\b" for i, m in enumerate(MARKERS)}
    found |= {f"hedging|{i}|hedge": "(?i)" + p for i, p in enumerate(HEDGES)} | {f"transitions|{i}|formulaic transition": "(?im)" + p.replace("(?m)", "") for i, p in enumerate(TRANSITIONS)}
    for category, patterns in (("structure", STRUCTURES), ("register", CHATBOT), ("rhetoric", RHETORIC), ("provenance", PROVENANCE)):
        found |= {f"{category}|{i}|{kind}": "(?i)" + p for i, (kind, p) in enumerate(zip(KINDS[category], patterns, strict=True))}
    return found | {f"punctuation|{i}|{kind}": p for i, (kind, p) in enumerate(PUNCTUATION.items())} | {"sentence|0|": PATTERN_SENTENCE}


ROW = "array<struct<start:int,end:int,kind:string,text:string>>"


def any_like(text: Column, patterns, flags: str = "") -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(flags + p)
    return found


def profile(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with sentences (start, end, text) and a column of evidence (start, end, kind, text) for each category and `provenance`.

    Evidence is in order of start, end and kind, each once; that of `register`
    in order of its patterns. A null text counts as empty.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("__found", find_spans(text, sought()))
    of = lambda category: F.filter("__found", lambda s: s["kind"].startswith(category + "|"))
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+", ""), r"\s+$", "")
    row = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring_index(s["kind"], "|", -1).alias("kind"), plain(s["text"]).alias("text"))
    own = {c: F.array_sort(F.array_distinct(F.transform(of(c), row))) for c in ("predictability", "hedging", "transitions", "structure", "rhetoric", "provenance")}
    order = lambda s: F.struct(F.get(F.split(s["kind"], r"\|"), F.lit(1)).alias("n"), row(s).alias("row"))
    own["register"] = F.transform(F.array_sort(F.transform(of("register"), order)), lambda x: x["row"])
    # One wrapped aside is enough.
    first = F.transform(F.slice(F.filter(of("punctuation"), lambda s: s["kind"].endswith("aside")), 1, 1), row)
    own["punctuation"] = F.array_sort(F.array_distinct(F.concat(F.transform(F.filter(of("punctuation"), lambda s: ~s["kind"].endswith("aside")), row), first)))
    left = lambda s: F.length(F.regexp_extract(s["text"], r"^\s*", 0))
    sentence = lambda s: F.struct((s["start"] + left(s)).alias("start"), (s["start"] + left(s) + F.length(plain(s["text"]))).cast("int").alias("end"), plain(s["text"]).alias("text"))
    rows = rows.withColumns(own | {"sentences": F.filter(F.transform(of("sentence"), sentence), lambda s: F.length(s["text"]) >= 4)})
    bullets = F.regexp_count(text, F.lit(r"(?m)^[ \t]*(?:[-*•]|\d+[.)])\s+"))
    heavy = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("list-heavy structure").alias("kind"), F.concat(bullets.cast("string"), F.lit(" list items")).alias("text"))
    rows = rows.withColumn("structure", F.when(bullets >= 5, F.array_sort(F.concat("structure", F.array(heavy)))).otherwise(F.col("structure")))
    rows = rows.withColumn("__lengths", F.transform("sentences", lambda s: F.regexp_count(F.lower(s["text"]), F.lit(PATTERN_WORD))))
    three = lambda i: F.slice("__lengths", i + 1, F.lit(3))
    alike = F.filter(F.sequence(F.lit(0), F.size("__lengths") - 3), lambda i: (F.array_max(three(i)) - F.array_min(three(i)) <= 5) & (F.array_min(three(i)) >= 8))
    listed = lambda i: F.concat(F.lit("Sentence lengths ["), F.array_join(F.transform(three(i), lambda n: n.cast("string")), ", "), F.lit("]"))
    run = lambda i: F.struct(F.get("sentences", i)["start"].alias("start"), F.get("sentences", i + 2)["end"].alias("end"), F.lit("uniform sentence run").alias("kind"), listed(i).alias("text"))
    # Naming the columns outside the lambdas too keeps Catalyst from pasting their expressions into them.
    enough = (F.size("__lengths") >= 3) & (F.size("sentences") >= 3)
    rows = rows.withColumn("burstiness", F.when(enough, F.transform(alike, run)).otherwise(F.array().cast(ROW)))
    bare = lambda s: ~s["text"].rlike(ANCHORED) & ~s["text"].rlike(ANCHOR)
    vague = F.filter("sentences", lambda s: any_like(s["text"], VAGUE, "(?i)") & bare(s))
    cut = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("unanchored claim").alias("kind"), F.substring(s["text"], 1, 220).alias("text"))
    rows = rows.withColumn("__vague", F.transform(vague, cut))
    # Claims by the careful splitter; of equal ones of up to 220 characters the first.
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?i)(et al\.)\s+", "$1\x02"), r"([.!?])\s+", "$1\x01"), r"\n\s*\n", "\x01")
    claims = F.filter(F.transform(F.split(marked, "\x01"), plain), lambda s: (F.length(s) > 20) & any_like(s, CLAIMS, "(?i)") & ~any_like(s, CITATIONS.values()))
    rows = rows.withColumn("__claims", F.filter(claims, lambda s: ~F.exists("__vague", lambda v: v["text"] == s)))
    first = F.filter("__claims", lambda s, i: (F.length(s) > 220) | ~F.array_contains(F.slice("__claims", F.lit(1), i), s))
    at = lambda s: F.greatest(F.lit(0), F.position(s, text) - 1)
    claim = lambda s: F.struct(at(s).alias("start"), (at(s) + F.length(s)).alias("end"), F.lit("claim without recognized citation").alias("kind"), F.substring(s, 1, 220).alias("text"))
    claims = F.when(F.size("__claims") > 0, F.transform(first, claim)).otherwise(F.array().cast(ROW))
    return rows.withColumn("specificity", F.concat("__vague", claims)).drop("__found", "__lengths", "__vague", "__claims")


def evidence(docs: DataFrame) -> DataFrame:
    """doc_id, category, place, kind, start, end, text and suggestion of every piece of evidence."""
    rows = profile(docs)
    names = [*LABELS, "provenance"]
    each = F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("rows")) for c in names))
    rows = rows.select("doc_id", F.explode(each).alias("c")).select("doc_id", "c.category", F.posexplode("c.rows").alias("place", "e"))
    wording = F.create_map(*(F.lit(x) for pair in SUGGESTED.items() for x in pair))
    suggestion = F.when(F.col("category") == "predictability", F.try_element_at(wording, F.lower("e.text")))
    return rows.select("doc_id", "category", (F.col("place") + 1).cast("long").alias("place"), "e.kind", F.col("e.start").cast("long").alias("start_offset"), F.col("e.end").cast("long").alias("end_offset"), "e.text", suggestion.alias("suggestion"))


def flagged_sentences(docs: DataFrame) -> DataFrame:
    """Sentences that overlap the shown evidence of some category, with the labels of those."""
    rows = profile(docs).select("doc_id", F.explode("sentences").alias("s"), *LABELS)
    over = lambda c: F.exists(F.slice(c, 1, SHOWN), lambda e: (e["end"] > e["start"]) & (e["start"] < F.col("s.end")) & (e["end"] > F.col("s.start")))
    reasons = F.array_sort(F.filter(F.array(*(F.when(over(c), label) for c, label in LABELS.items())), lambda x: x.isNotNull()))
    words = F.regexp_count(F.lower("s.text"), F.lit(PATTERN_WORD)).cast("long")
    return rows.select("doc_id", F.col("s.start").cast("long").alias("start_offset"), F.col("s.end").cast("long").alias("end_offset"), words.alias("words"), F.array_join(reasons, "; ").alias("reasons")).filter("reasons <> ''")
