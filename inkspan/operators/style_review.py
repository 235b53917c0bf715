"""Style review by rules: findings by block, rule metrics, category points and the index, as plans over typed blocks.

Rules are a small table of patterns. Of each block the patterns are kept that
can match (a plain search for strings that every match needs), their matches
get offsets by running sums, and overlapping matches of one rule are folded to
the shorter. A document's blocks meet once, as counts by rule; thresholds,
points, categories and the index follow in that row. Texts are never shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkspan.functions.numbers import rounded
from inkspan.functions.scans import bound, matches, scanned
from inkspan.functions.text import PATTERN_WORD, looked_for, needed
from inkspan.functions.udfs import plain_search
from inkspan.operators.blocks import ELIGIBLE, EXCLUDED, plain_blocks
from inkspan.plans.dialect import BOUNDARY, spelled_out


class Rule(NamedTuple):
    name: str
    category: str
    strength: str
    least: int
    rate: float
    cap: float
    patterns: tuple[str, ...]
    kinds: tuple[str, ...]


PROSE = ("paragraph", "list_item")
TITLED = ("paragraph", "heading", "list_item", "table_cell")
QUOTED_TOO = (*TITLED, "quotation", "code", "reference")
# The rules, with least count, least rate per 1000 words, cap of the category's points and the kinds of blocks
# they look into; then points by strength, checks of lines, promotional weights.
RULES = (
    Rule("inflated_vocabulary", "language", "weak", 2, 4, 12, ("delv(?:e|es|ed|ing)", "pivotal", "intricate", "tapestr(?:y|ies)", "testament", "robust", "transformative", "ever[- ]changing landscape"), (*TITLED, "caption")),
    Rule("promotional_praise", "promotional_language", "moderate", 2, 3, 14, ("vibrant", "cutting[- ]edge", "game[- ]chang(?:ing|er)", "remarkable journey", "powerful reminder", "unlock(?:s|ed|ing)? (?:the )?potential", "showcas(?:e|es|ed|ing)", "seamless(?:ly)?"), ("paragraph", "heading", "list_item", "caption")),
    Rule("formulaic_transitions", "discourse", "weak", 2, 3, 12, ("furthermore", "moreover", "additionally", "in conclusion", "to summarize", "in summary", "it is (?:important|worthwhile) to note"), PROSE),
    Rule("significance_legacy", "content", "moderate", 2, 2, 14, ("(?:stands|serves) as", "(?:a )?(?:testament|reminder) to", "(?:crucial|pivotal|vital|significant|key) role", "underscor(?:e|es|ed|ing) (?:its|the) (?:importance|significance)", "reflect(?:s|ed|ing)? broader", "enduring legacy", "shap(?:e|es|ed|ing) the (?:future|landscape)"), PROSE),
    Rule("generic_analytical_verbs", "content", "weak", 3, 5, 10, ("highlight(?:s|ed|ing)", "emphasiz(?:e|es|ed|ing)", "reflect(?:s|ed|ing)", "symboliz(?:e|es|ed|ing)", "contribut(?:e|es|ed|ing) to", "foster(?:s|ed|ing)", "enhanc(?:e|es|ed|ing)"), PROSE),
    Rule("vague_authority", "evidence_language", "moderate", 1, 1, 16, ("experts? suggest", "widely regarded", "studies show", "research (?:shows|suggests|indicates)", "it is widely (?:known|accepted|recognized)", "many (?:believe|argue|consider)"), PROSE),
    Rule("negative_parallelism", "rhetoric", "moderate", 2, 1, 14, ("not (?:just|only) [^.!?]{2,90}?[,;]? but (?:also )?[^.!?]{2,100}", "not [^.!?]{2,80}?[,;]? but [^.!?]{2,100}", "[^.!?]{2,60}? rather than [^.!?]{2,60}"), PROSE),
    Rule("rule_of_three", "rhetoric", "weak", 2, 1, 8, ("\\b[\"'’A-Za-z][^,.;:]{1,35}, [^,.;:]{1,35}, (?:and|or) [^,.;:]{1,35}",), PROSE),
    Rule("trailing_participial", "rhetoric", "moderate", 2, 1, 12, (", (?:highlighting|underscoring|reflecting|symbolizing|demonstrating|ensuring|fostering|contributing|enhancing) .{5,100}[.!?]",), PROSE),
    Rule("future_outlook", "structure", "weak", 1, 1, 8, ("despite (?:these|the) challenges", "looking ahead", "future prospects", "the future (?:looks|remains) bright", "only time will tell", "continued (?:growth|success|innovation)"), ("paragraph",)),
    Rule("chatbot_residue", "generation_residue", "stronger", 1, 1, 22, ("i hope this helps", "let me know if you have any questions", "as an ai (?:language )?model", "my knowledge cutoff", "i (?:cannot|can't) comply with", "(?:your|the) prompt (?:asks|requested|instructs)", "here (?:is|are) (?:a|the|some) (?:revised|draft|requested)"), QUOTED_TOO),
    Rule("internal_tokens", "generation_residue", "stronger", 1, 1, 24, ("contentReference", "oaicite", "oai_citation", "turn\\d+(?:search|view|fetch)\\d+", "attributableIndex", "\\[cite:\\s*\\d+\\]", "span_\\d+\\(start_span\\)", "grok_(?:card|render_citation_card_json)", "ppl-ai-file-upload", ":::writing"), QUOTED_TOO),
    Rule("unfilled_placeholder", "generation_residue", "stronger", 1, 1, 20, ("\\[(?:insert|add|replace|provide|describe|summarize|cite)[^\\]\\n]{0,80}\\]", "<INSERT[^>]{0,80}>"), TITLED),
)
POINTS = {"weak": 2.0, "moderate": 5.0, "stronger": 8.0}
LINE_CHECKS = {
    "emoji_section_marker": r"^[ \t]*[\U0001F300-\U0001FAFF]",
    "decorative_separator": r"^[ \t]*(?:[-*_]\s*){3,}$",
    "leftover_markdown": r"(?:^|\s)(?:#{1,6}\s+|\*\*[^*]+\*\*|```)",
    "bold_label_bullet": r"^[ \t]*(?:[-*+]\s+)?\*\*[^*]{1,60}:\*\*",
}
PROMOTION = {"academic_report": 1.0, "business_report": 0.75, "general_essay": 1.0, "technical_documentation": 0.6}
LEAST_WORDS, ACTIVE_CATEGORIES = 120, 3

# Checks with their names, and who makes them.
_HEURISTIC, _EXACT, _HUMAN, _NONE, _OUTSIDE = "Implemented heuristic check", "Implemented deterministic check", "Requires human review", "Not applicable to uploaded documents", "Optional external verification"
COVERAGE = (
    ("significance_legacy", "Undue significance, legacy, and broader trends", _HEURISTIC), ("notability_media", "Canned notability, attribution, and media coverage", _HUMAN),
    ("superficial_analysis", "Superficial analysis and participial clauses", _HEURISTIC), ("promotional_language", "Promotional or advertisement-like language", _EXACT),
    ("vague_association", "Vague connection or association", _HEURISTIC), ("vague_authority", "Vague attribution and consensus", _HEURISTIC),
    ("future_outlook", "Generic challenges and future outlook", _HEURISTIC), ("awards_recognition", "Awards and recognition section", _HUMAN),
    ("ai_vocabulary", "High density of starter vocabulary", _EXACT), ("copulative_avoidance", "Avoidance of basic copulatives", _HUMAN),
    ("negative_parallelism", "Repeated negative parallelism", _EXACT), ("proper_noun_leads", "List or broad title treated as a proper noun", _NONE),
    ("rule_of_three", "Repeated three-part enumeration", _HEURISTIC), ("headings", "Heading hierarchy and repetition", _EXACT),
    ("boldface", "Excessive boldface and inline bold labels", _EXACT), ("em_dash", "Em-dash usage and spacing", _EXACT),
    ("emoji", "Emoji used as section formatting", _EXACT), ("tables", "Unusual or repetitive tables", _HUMAN),
    ("smart_punctuation", "Curly quotes and apostrophes", _EXACT), ("thematic_breaks", "Decorative thematic breaks", _EXACT),
    ("collaborative_residue", "Assistant-to-user communication", _EXACT), ("cutoff_disclaimer", "Knowledge-cutoff or source disclaimer", _EXACT),
    ("placeholder", "Template and placeholder text", _EXACT), ("markdown", "Accidental Markdown syntax", _EXACT),
    ("broken_wikitext", "Broken or internal reference markup", _EXACT), ("citation_links", "Broken URLs, DOI, ISBN, and reference linkage", _EXACT),
    ("network_citations", "Network DOI, URL, and metadata verification", _OUTSIDE), ("claim_support", "Whether a citation supports a claim", _HUMAN),
    ("comment_indicators", "Comment-specific indicators", _NONE), ("edit_summaries", "Wikipedia edit-summary behavior", _NONE),
    ("account_history", "Account history and style shifts", _NONE), ("bias", "Political or cultural bias", _HUMAN),
    ("external_semantics", "Semantic similarity or external model classification", _OUTSIDE),
)

#: What is found without a rule's threshold: marks, line checks and what is told by a block's own format.
DASH, QUOTES, SKIPPED, BOLD = "em_dash_usage", "smart_punctuation", "skipped_heading_level", "excessive_bold"
MOST_BOLD, SHOWN_BOLD = 0.35, 160
#: All kinds of findings by number, and their category and strength.
NAMES = (*(r.name for r in RULES), DASH, QUOTES, *LINE_CHECKS, SKIPPED, BOLD)
CATEGORY = {r.name: r.category for r in RULES} | dict.fromkeys((DASH, QUOTES), "punctuation") | dict.fromkeys((*LINE_CHECKS, SKIPPED, BOLD), "formatting")
STRENGTH = {r.name: r.strength for r in RULES}
CAPS = {c: max([r.cap for r in RULES if r.category == c], default={"punctuation": 4.0, "formatting": 8.0}.get(c)) for c in sorted(set(CATEGORY.values()))}


def number(name: str) -> int:
    return NAMES.index(name)


def _patterns() -> list[tuple[int, str, tuple[str, ...] | None, list[str] | str]]:
    """Number of the kind, pattern for Spark, kinds of blocks (None: all) and strings of which each match holds one, or a simpler pattern."""
    bounded = lambda p: "(?i)" + looked_for(p) + r"(?<![A-Za-z0-9_])(?:" + spelled_out(p, BOUNDARY) + r")(?![A-Za-z0-9_])"
    # Told of the text in lower case, where a letter may have become two: twice as long as in the rules.
    paired = r"not [^.!?]{2,200} but "
    more = {p: paired for p in RULES[[r.name for r in RULES].index("negative_parallelism")].patterns if p.startswith("not ")} | {p: r", [^,.;:]{1,70}, (?:and|or) " for r in RULES if r.name == "rule_of_three" for p in r.patterns}
    # A run without commas that no comma follows has none further back either: it isn't given back.
    spark = lambda p: bounded(p).replace("[^,.;:]{1,35}, ", "[^,.;:]{1,35}+, ")
    out = [(number(r.name), spark(p), r.kinds, more.get(p) or needed("(?i)" + p)) for r in RULES for p in r.patterns]
    out += [(number(DASH), "—", None, ["—"]), (number(QUOTES), "[“”‘’]", None, ["“", "”", "‘", "’"])]
    lines = {n: "(?md)" + p.replace(r"\U0001F300-\U0001FAFF", r"\x{1F300}-\x{1FAFF}") for n, p in LINE_CHECKS.items()}
    markup = ["#", "**", "```"]
    needs = {"emoji_section_marker": "[\U0001F300-\U0001FAFF]", "decorative_separator": r"(?m)^[ \t]*[-*_]", "leftover_markdown": markup, "bold_label_bullet": [":**"]}
    return out + [(number(n), p, None, needs[n]) for n, p in lines.items()]


PATTERNS = _patterns()


def apart(spans: Column) -> Column:
    """Sorted spans, of two that overlap the shorter, or else the first."""
    empty = F.slice(spans, F.lit(1), F.lit(0))
    end = lambda s: s["start"] + s["length"]

    def step(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        shorter = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(s))
        return F.when(F.size(kept) == 0, F.array(s)).when(s["start"] >= end(last), F.concat(kept, F.array(s))).when(s["length"] < last["length"], shorter).otherwise(kept)

    return F.aggregate(spans, empty, step)


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def listed(values) -> str:
    return ", ".join(quoted(v) if isinstance(v, str) else str(v) for v in values)


def likely(kind: Column, held: Column) -> Column:
    """Numbers of the patterns that can match in a block of a kind that holds what these need."""
    kinds = F.expr("array(" + ", ".join("null" if k is None else f"array({listed(k)})" for _, _, k, _ in PATTERNS) + ")")
    return F.filter(held, lambda n: F.get(kinds, n).isNull() | F.array_contains(F.get(kinds, n), kind))


def found_in(text: Column, numbers: Column) -> Column:
    """rule (its number), start and length of all findings of the numbered patterns in a block."""
    rules, regexes = F.expr(f"array({listed(r for r, *_ in PATTERNS)})"), F.expr(f"array({listed(p for _, p, *_ in PATTERNS)})")
    hits = F.transform(numbers, lambda n: F.struct(F.get(rules, n).alias("rule"), matches(text, F.get(regexes, n)).alias("spans")))

    def of_rule(all_: Column, rule: Column) -> Column:
        spans = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(all_, lambda h: h["rule"] == rule), lambda h: h["spans"]))))
        return F.transform(bound(spans, apart), lambda s: F.struct(rule.alias("rule"), s["start"].alias("start"), s["length"].alias("length")))

    return bound(hits, lambda h: F.flatten(F.transform(F.array_distinct(F.transform(h, lambda x: x["rule"])), lambda rule: of_rule(h, rule))))


def unfolded(rows: DataFrame, items: str, item: str) -> DataFrame:
    """A row for each of the items of a column of arrays without nulls.

    `explode` of a computed column puts a filter on its size below all columns
    that it is made of, which are then made once for each of its conditions
    and once more for the rows; a filter on the items stays above.
    """
    return rows.withColumn(item, F.explode_outer(items)).filter(F.col(item).isNotNull()).drop(items)


def _block_findings(docs: DataFrame, blocks: Column, radius: int = 0) -> DataFrame:
    """A row a block (one without a block for a document that has none): row, doc_id, b, words, found; with a radius also what stands around the block and the document's eligible_words."""
    level = lambda b: F.coalesce(b["heading_level"], F.lit(0))
    # The last level before each block, behind the number of its heading: the greatest is the last.
    leveled = lambda all_: scanned(F.transform(all_, lambda b, i: F.when(level(b) > 0, (i + 1) * 100 + level(b)).otherwise(0)), F.lit(0), lambda x, y: F.greatest(x, y))
    text = F.coalesce("text", F.lit(""))

    def told(b: Column, before: Column) -> Column:
        skips = (level(b) > before % 100 + 1) & (before > 0)
        around = []
        if radius:
            low, high = F.greatest(F.lit(0), b["start"] - radius), b["start"] + F.length(b["text"])
            around = [F.substring(text, low + 1, b["start"] - low).alias("before"), F.substring(text, high + 1, F.lit(radius)).alias("after")]
        return F.struct(b.alias("b"), skips.alias("skips"), *around)

    eligible = lambda all_: F.aggregate(F.filter(all_, lambda b: b["kind"].isin(*ELIGIBLE)), F.lit(0), lambda n, b: n + F.regexp_count(b["text"], F.lit(PATTERN_WORD)))
    of_document = lambda all_: [eligible(all_).alias("eligible_words")] if radius else []
    listed = bound(blocks, lambda all_: F.struct(*of_document(all_), bound(leveled(all_), lambda at: F.zip_with(all_, at, told)).alias("blocks")))
    own = ["x.eligible_words"] if radius else []
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), listed.alias("x")).select("doc_id", "row", *own, F.explode_outer("x.blocks").alias("x"))
    rows = rows.select("doc_id", "row", *(["eligible_words"] if radius else []), "x.*").withColumn("search", plain_search(F.col("b.text"), PATTERN_WORD, [p[3] for p in PATTERNS]))
    rows = rows.withColumns({"words": F.col("search.words"), "likely": likely(F.col("b.kind"), F.col("search.held"))})
    whole = lambda name: F.array(F.struct(F.lit(number(name)).alias("rule"), F.lit(0).alias("start"), F.length("b.text").alias("length")))
    own = F.when(F.size("likely") > 0, found_in(F.col("b.text"), F.col("likely"))).otherwise(F.slice(whole(BOLD), 1, 0))
    own = F.concat(own, F.when(F.col("skips"), whole(SKIPPED)).otherwise(F.slice(whole(SKIPPED), 1, 0)), F.when(F.col("b.bold_share") > MOST_BOLD, whole(BOLD)).otherwise(F.slice(whole(BOLD), 1, 0)))
    return rows.withColumn("found", F.when(F.col("b").isNotNull(), own)).drop("search", "likely")


def _reviews(docs: DataFrame, blocks: Column) -> DataFrame:
    """doc_id, words, findings, and `rules`: the metrics of all rules; `hits`: counts by number of kind of the blocks that have findings."""
    rows = _block_findings(docs, blocks)
    each = f"sequence(0, {len(NAMES) - 1})"
    rows = rows.withColumn("hit", F.expr(f"CASE WHEN size(found) > 0 THEN struct(b.kind AS kind, transform({each}, r -> size(filter(found, f -> f.rule = r))) AS counts) END"))
    of_kinds = lambda kinds: F.coalesce(F.sum(F.when(F.col("b.kind").isin(*kinds), F.col("words"))), F.lit(0)).cast("long")
    grouped = rows.groupBy("row", "doc_id").agg(of_kinds(ELIGIBLE).alias("eligible_words"), of_kinds(EXCLUDED).alias("excluded_words"), F.collect_list("hit").alias("hits"))
    sums = lambda hits: f"transform({each}, r -> CAST(aggregate({hits}, 0, (n, h) -> n + h.counts[r]) AS BIGINT))"
    grouped = grouped.withColumn("kept", F.expr(f"filter(hits, h -> h.kind NOT IN ({listed(EXCLUDED)}))"))
    grouped = grouped.withColumns({
        "all_counts": F.expr(sums("hits")), "counts": F.expr(sums("kept")), "touched": F.expr(f"transform({each}, r -> CAST(size(filter(hits, h -> h.counts[r] > 0)) AS BIGINT))"),
        "most": F.expr(f"transform({each}, r -> CAST(coalesce(array_max(transform(kept, h -> h.counts[r])), 0) AS BIGINT))"),
    })
    metrics = []
    for r, rule in enumerate(RULES):
        rate = f"counts[{r}] / greatest(1, eligible_words) * 1000"
        metrics.append(
            f"""struct({quoted(rule.name)} AS rule_id, {quoted(rule.category)} AS category, all_counts[{r}] AS count, counts[{r}] AS eligible_count, {rounded(rate, 2)} AS per_1000, touched[{r}] AS affected_blocks,
  most[{r}] AS local_concentration, counts[{r}] >= {rule.least} AND {rate} >= {rule.rate} AS threshold_met)"""
        )
    findings = F.expr("aggregate(all_counts, 0L, (n, c) -> n + c)")
    return grouped.withColumns({"findings": findings, "rules": F.expr(f"array({', '.join(metrics)})"), "dashes": F.expr(f"all_counts[{number(DASH)}]")})


def _categories(profile: str) -> Column:
    """Points, cap, scored findings and shared blocks of all categories, from a row of `_reviews`."""

    def counted(name: str) -> str:
        """Findings of a kind that count in a block."""
        here = "true" if name in (SKIPPED, BOLD) else f"h.kind IN ({listed(ELIGIBLE)})" if name == DASH else f"h.kind NOT IN ({listed(EXCLUDED)})"
        met = f" AND rules[{number(name)}].threshold_met" if name in STRENGTH else ""
        return "0" if name == QUOTES else f"CASE WHEN {here}{met} THEN h.counts[{number(name)}] ELSE 0 END"

    # Scored findings by category in each block.
    by_block = ", ".join(" + ".join(counted(n) for n in NAMES if CATEGORY[n] == c) for c in CAPS)
    out = []
    for k, (c, cap) in enumerate(CAPS.items()):
        count = f"aggregate(scored, 0L, (n, b) -> n + b[{k}])"
        if c == "punctuation":
            points = f"greatest(0D, {rounded('dashes / greatest(1, eligible_words) * 1000', 2)} - 2D) * 0.25D"
        elif c == "formatting":
            points = f"{count} * 1.5D"
        else:
            times = PROMOTION[profile] if c == "promotional_language" else 1.0
            points = " + ".join(f"CASE WHEN rules[{number(r.name)}].threshold_met THEN {POINTS[r.strength]}D * least(2D, counts[{number(r.name)}] / {r.least}) * {times}D ELSE 0D END" for r in RULES if r.category == c)
        shared = f"CAST(size(filter(scored, b -> b[{k}] > 0 AND size(filter(b, n -> n > 0)) > 1)) AS BIGINT)"
        out.append(f"struct({quoted(c)} AS category, {rounded(f'least({cap}D, {points})', 1)} AS points, {cap}D AS cap, {count} AS scored_findings, {shared} AS shared_blocks)")
    return F.expr(f"get(transform(array(transform(hits, h -> array({by_block}))), scored -> array({', '.join(out)})), 0)")


def style_review(docs: DataFrame, profile: str = "academic_report", blocks: Column | None = None) -> DataFrame:
    """Words, index, active categories and a recommendation of each text of `docs` (doc_id, text).

    blocks: the typed blocks of a row, those of a plain text if not given. A
    null text has no blocks and, as any of fewer than LEAST_WORDS words, no
    index. Repeated rows are reviewed each; other columns are ignored.
    """
    rows = _reviews(docs, plain_blocks(F.col("text")) if blocks is None else blocks).withColumn("categories", _categories(profile))
    few = F.col("eligible_words") < LEAST_WORDS
    active = F.size(F.filter("categories", lambda c: c["points"] > 0)).cast("long")
    advice = F.when(few, "insufficient_text").when(F.col("active_categories") >= ACTIVE_CATEGORIES, "review_categories").otherwise("review_passages")
    rows = rows.select("doc_id", "eligible_words", "excluded_words", F.when(~few, F.expr(rounded(f"aggregate(categories, 0D, (n, c) -> n + c.points) / {sum(CAPS.values())}D * 100", 1))).alias("style_index"), active.alias("active_categories"), "findings")
    return rows.withColumn("recommendation", advice)


def rule_metrics(docs: DataFrame, blocks: Column | None = None) -> DataFrame:
    """Counts, rate, spread and threshold of each rule that a text meets."""
    rows = _reviews(docs, plain_blocks(F.col("text")) if blocks is None else blocks)
    return unfolded(rows.select("doc_id", "rules"), "rules", "m").filter("m.count > 0").select("doc_id", "m.*")


def category_points(docs: DataFrame, profile: str = "academic_report", blocks: Column | None = None) -> DataFrame:
    """Points, cap, scored findings and blocks shared with other categories, by category."""
    rows = _reviews(docs, plain_blocks(F.col("text")) if blocks is None else blocks)
    return unfolded(rows.select("doc_id", _categories(profile).alias("categories")), "categories", "c").select("doc_id", "c.*")


def style_findings(docs: DataFrame, radius: int = 90, blocks: Column | None = None) -> DataFrame:
    """Every finding with its id, offsets in code points, words, context, and why it doesn't count, if so."""
    rows = _block_findings(docs, plain_blocks(F.col("text")) if blocks is None else blocks, radius)
    rows = unfolded(rows.select("doc_id", "row", "eligible_words", "b", "before", "after", "found"), "found", "f")
    n, kind, low = F.col("f.rule"), F.col("b.kind"), F.col("f.start")
    pick = lambda values: F.get(F.array(*(F.lit(v) for v in values)), n)
    count = F.count(F.when(~kind.isin(*EXCLUDED), 1)).over(W.partitionBy("row", "rule_id"))
    # Of a bold block only the beginning is shown.
    size = F.when(n == number(BOLD), F.least(F.lit(SHOWN_BOLD), F.col("f.length"))).otherwise(F.col("f.length"))
    whole = F.concat("before", "b.text", "after")
    begin = F.length("before") + low
    start, end = F.col("b.start") + low, F.col("b.start") + low + F.col("f.length")
    around = F.substring(whole, F.greatest(F.lit(0), begin - radius) + 1, F.least(begin, F.lit(radius)) + F.col("f.length") + radius)
    rows = rows.select(
        "doc_id", "row", "eligible_words", pick(NAMES).alias("rule_id"), pick([CATEGORY[x] for x in NAMES]).alias("category"), pick([STRENGTH.get(x, "weak") for x in NAMES]).alias("strength"),
        F.col("b.block_no").cast("long").alias("block_no"), kind.alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"), F.substring("b.text", low + 1, size).alias("matched"),
        F.trim(F.regexp_replace(F.regexp_replace(F.replace(around, F.lit("\n"), F.lit(" ")), r"^\s+", ""), r"(?<!\s)\s++\z", "")).alias("context"), "b",
        pick([r.least for r in RULES] + [0] * (len(NAMES) - len(RULES))).alias("least"), pick([float(r.rate) for r in RULES] + [0.0] * (len(NAMES) - len(RULES))).alias("rate"),
    ).withColumn("met", (count >= F.col("least")) & (count / F.greatest(F.lit(1), F.col("eligible_words")) * 1000 >= F.col("rate")))
    named = F.col("rule_id")
    reason = (
        F.when(named == QUOTES, "no_weight").when(named.isin(SKIPPED, BOLD), None).when((named == DASH) & ~F.col("kind").isin(*ELIGIBLE), "block_type")
        .when(F.col("kind").isin(*EXCLUDED), "block_type").when(named.isin(*STRENGTH) & ~F.col("met"), "below_threshold")
    )
    key = F.concat_ws(":", "rule_id", F.concat(F.lit("block-"), "block_no"), "start", "end")
    rows = rows.withColumns({"reason": reason, "finding_id": F.concat(F.lit("finding-"), F.substring(F.sha1(key.cast("binary")), 1, 12))}).withColumn("excluded", F.col("reason").isNotNull())
    return rows.select("doc_id", "finding_id", "rule_id", "category", "strength", "block_no", "kind", "start", "end", "matched", "context", "excluded", "reason")
