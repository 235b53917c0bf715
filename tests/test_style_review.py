"""The style review and typed blocks of small texts."""

import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from inkspan.functions.numbers import rounded
from inkspan.functions.scans import matches, scanned, starts
from inkspan.functions.text import PATTERN_WORD, looked_for
from inkspan.functions.udfs import plain_search
from inkspan.operators.blocks import block_rows, kept_text, plain_blocks, typed_blocks
from inkspan.operators.style_review import PATTERNS, apart, category_points, rule_metrics, style_findings, style_review

FILL = "plain words go on " * 40


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_running_results_of_long_arrays(spark):
    for n in (0, 1, 255, 256, 257, 70_000):
        row = spark.range(1).select(F.when(F.lit(n) > 0, F.sequence(F.lit(1), F.lit(max(n, 1)))).otherwise(F.array().cast("array<int>")).alias("v"))
        sums, most = row.select(starts(F.transform("v", lambda x: x % 7)), scanned(F.transform("v", lambda x: x * 31 % 1009), F.lit(-1), lambda a, b: F.greatest(a, b))).first()
        total, high = 0, -1
        for k in range(n):
            assert (sums[k], most[k]) == (total, high)
            total, high = total + (k + 1) % 7, max(high, (k + 1) * 31 % 1009)
        assert len(sums) == len(most) == n


@pytest.mark.parametrize("pattern", ["a+", "—", r"\bé\w*", "(?m)^x", "😀."])
def test_matches_have_their_places(spark, pattern):
    rows = ["", "aa—a 😀b éa\nx\nxx", "none", "😀😀😀a"]
    found = texts(spark, *rows).orderBy("doc_id").select(matches(F.col("text"), F.lit(pattern.replace("\\b", "(?<![a-zé])").replace("\\w", "[a-zé]")))).collect()
    assert [[(m.start, m.start + m.length) for m in r[0]] for r in found] == [[m.span() for m in re.finditer(pattern, t)] for t in rows]


def test_halves_round_as_they_lie(spark):
    numbers = [i / 1000 for i in range(0, 6000, 5)] + [(2 * i + 1) / 200 for i in range(900)] + [i / 8 for i in range(200)]
    frame = spark.createDataFrame([(x,) for x in numbers], "x double")
    assert frame.selectExpr(rounded("x", 1), rounded("x", 2)).collect() == [(round(x, 1), round(x, 2)) for x in numbers]


def test_blocks_end_at_blank_lines(spark):
    text = "  one\ntwo  \n \n> said\n\nReferences\nA, B.\n"
    rows = texts(spark, text, "", " \n\n", None).select("doc_id", F.explode(plain_blocks(F.col("text"))).alias("b")).collect()
    assert [(r.doc_id, r.b.block_no, r.b.start, r.b.kind, r.b.text) for r in rows] == [(0, 1, 2, "paragraph", "one\ntwo"), (0, 2, 14, "quotation", "> said"), (0, 3, 22, "reference", "References\nA, B.")]


def plain_typed(text, form):
    """Blocks read one after another."""
    out, inside, listed = [], False, False
    for n, raw in enumerate(re.split(r"\n\s*\n", text), 1):
        value, level = raw.strip(), None
        if not value:
            continue
        if form == "md" and value.startswith("```"):
            kind, inside = "code", value.count("```") % 2 == 1
        elif inside:
            kind, inside = "code", "```" not in value
        elif re.fullmatch(r"(?i)(?:#{1,6}\s*)?(?:references|works cited|bibliography)[:#*\s]*", value):
            kind, listed, level = "heading", True, max(1, len(value) - len(value.lstrip("#")))
        elif listed:
            kind = "reference"
        elif form == "md" and re.match(r"#{1,6}\s+", value):
            kind, level = "heading", len(value) - len(value.lstrip("#"))
        else:
            code = value.startswith("```") or form in ("tex", "ipynb") and "[Mathematical Formula]" in value
            kind = "list_item" if re.match(r"(?:[-*+] |\d+[.)] )", value) else "quotation" if re.match(r">\s", value) else "code" if code else "paragraph"
        out.append((n, kind, value, level))
    return out


def test_typed_blocks_of_all_formats_cut_out_of_their_source(spark):
    pieces = ["# Head", "## Two\nlines", "```\nx", "```py\na\n```", "y ``` z", "- item", "1) item", "> said", "References", "**bibliography**:", "## works cited ##", "[Mathematical Formula]", "plain — 😀 é", "   ", "``` ```", "Appendix B", "end ```"]
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice(["md", "txt", "tex", "ipynb"]), rng.choice(["\n\n", "\n \t\n", "\n\n\n"]).join(rng.choices(pieces, k=rng.randint(1, 14)))) for i in range(150)] + [(150, "md", None), (151, "md", ""), (152, "txt", " \n \n")]
    docs = spark.createDataFrame(rows, "doc_id long, format string, text string").withColumns({"kind": F.lit("clash"), "start": F.lit(0)})
    found = block_rows(docs, typed_blocks(F.col("text"), F.col("format"))).orderBy("doc_id", "block_no").collect()
    for i, form, text in rows:
        own, expected = [r for r in found if r.doc_id == i], plain_typed(text or "", form)
        assert [(r.block_no, r.kind, r.text, r.heading_level) for r in own] == expected, (form, text)
        assert all(text[r.source_start : r.source_end] == r.text for r in own)
        joined = "\n\n".join(v for _, _, v, _ in expected)
        assert all(joined[r.start : r.end] == r.text for r in own)
    kept = {r.doc_id: r.k for r in docs.select("doc_id", kept_text(typed_blocks(F.col("text"), F.col("format"))).alias("k")).collect()}
    for i, form, text in rows:
        left, gone, behind = [], {"table_cell": 0, "code": 0, "appendix": 0, "reference": 0}, False
        for _, kind, value, _ in plain_typed(text or "", form):
            behind = behind or bool(re.match(r"(?i)\s*(?:appendix|appendices)\b", value))
            reason = "code" if kind == "code" else "appendix" if behind else "reference" if kind == "reference" else None
            if reason:
                gone[reason] += 1
            else:
                left.append(value)
        assert kept[i].text == "\n\n".join(left) and {k: kept[i][f"skipped_{k}"] for k in gone} == gone


def test_long_runs_of_spaces_and_lines_take_no_longer(spark):
    began = time.perf_counter()
    docs = texts(spark, "a" + " " * 100_000 + "b", "a\n" * 50_000, ("word \n" + " " * 50 + "\n") * 20_000, "(" * 100_000)
    assert docs.select(F.size(plain_blocks(F.col("text")))).collect()[2][0] == 20_000
    assert style_review(docs).count() == 4 and time.perf_counter() - began < 60


def spans(*pairs):
    return F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b - a).alias("length")) for a, b in pairs))


def test_overlaps_keep_the_shorter_span(spark):
    found = spark.range(1).select(apart(spans((0, 9), (2, 5), (5, 8))).alias("a"), apart(spans((0, 3), (0, 7), (6, 8))).alias("b")).first()
    assert [(s.start, s.start + s.length) for s in found.a] == [(2, 5), (5, 8)] and [(s.start, s.start + s.length) for s in found.b] == [(0, 3), (6, 8)]


def test_index_adds_capped_points(spark):
    docs = texts(spark, FILL + "robust robust robust pivotal Studies show it.")
    rule = {r.rule_id: r for r in rule_metrics(docs).collect()}
    assert set(rule) == {"inflated_vocabulary", "vague_authority"}
    assert rule["inflated_vocabulary"].eligible_count == 4 and rule["inflated_vocabulary"].threshold_met and rule["inflated_vocabulary"].local_concentration == 4
    assert {c.category: c.points for c in category_points(docs).collect() if c.points} == {"language": 4.0, "evidence_language": 5.0}
    [r] = style_review(docs).collect()
    assert r.eligible_words == 167 and r.style_index == round(9 / (12 + 14 + 12 + 14 + 16 + 14 + 8 + 24 + 4 + 8) * 100, 1)


def test_promotion_weighs_by_profile(spark):
    docs = texts(spark, FILL + "A vibrant and vibrant place.")
    found = {p: next(c.points for c in category_points(docs, p).collect() if c.category == "promotional_language") for p in ("academic_report", "technical_documentation")}
    assert found == {"academic_report": 5.0, "technical_documentation": 3.0}


def test_quotations_count_only_where_a_rule_looks_there(spark):
    docs = texts(spark, "> I hope this helps, robust.\n\nNothing else.")
    assert [(f.rule_id, f.kind, f.excluded, f.reason) for f in style_findings(docs).collect()] == [("chatbot_residue", "quotation", True, "block_type")]
    assert style_review(docs).first().style_index is None


def test_underscores_are_part_of_words(spark):
    assert style_findings(texts(spark, "robust_plan and xrobust")).count() == 0


def test_format_of_blocks_is_reviewed(spark):
    docs = spark.createDataFrame([(1, "# A\n\n### B\n\nplain\n\n## C\n\n#### D")], "doc_id long, text string")
    found = style_findings(docs, blocks=typed_blocks(F.col("text"), F.lit("md"))).filter("rule_id = 'skipped_heading_level'").orderBy("start").collect()
    assert [(f.block_no, f.matched, f.excluded) for f in found] == [(2, "### B", False), (5, "#### D", False)]
    bold = F.transform(plain_blocks(F.col("text")), lambda b: b.withField("bold_share", F.when(b["block_no"] == 3, 0.36).otherwise(0.35)))
    assert [(f.block_no, f.matched) for f in style_findings(docs, blocks=bold).filter("rule_id = 'excessive_bold'").collect()] == [(3, "plain")]
    assert next(c.points for c in category_points(docs, blocks=bold).collect() if c.category == "formatting") == 1.5 * 5


def test_findings_carry_words_and_ids(spark):
    docs = spark.createDataFrame([(1, "😀 x — y [insert name] **Bold:** z"), (2, None), (3, ""), (3, "")], "doc_id long, text string")
    rows = style_findings(docs).collect()
    by_rule = {r.rule_id: r for r in rows}
    assert {r.doc_id for r in rows} == {1} and {"em_dash_usage", "emoji_section_marker", "leftover_markdown", "unfilled_placeholder"} <= set(by_rule)
    dash = by_rule["em_dash_usage"]
    assert (dash.start, dash.end, dash.matched) == (4, 5, "—") and dash.context.startswith("😀 x") and not dash.excluded
    assert dash.finding_id == "finding-" + hashlib.sha1(b"em_dash_usage:block-1:4:5").hexdigest()[:12]
    assert by_rule["unfilled_placeholder"].matched == "[insert name]"
    reviews = style_review(docs.withColumn("style_index", F.lit(1))).orderBy("doc_id").collect()
    assert [(r.doc_id, r.style_index, r.findings > 0) for r in reviews] == [(1, None, True), (2, None, False), (3, None, False), (3, None, False)]
    assert rule_metrics(docs.filter("doc_id > 1")).count() == 0
    assert category_points(docs.limit(0)).count() == 0 and category_points(docs.filter("doc_id = 3")).count() == 2 * 10


def test_findings_are_not_made_again_to_count_them(spark):
    docs = texts(spark, FILL + "We delve, robust and robust.")
    for rows in (style_findings(docs), rule_metrics(docs), category_points(docs)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"^\W*Filter .*(?:contains|regexp_extract_all|array\(struct)\(", plan, re.M)
    assert [r["count"] for r in rule_metrics(docs).filter("rule_id = 'inflated_vocabulary'").collect()] == [3]


def test_plain_search_takes_each_block_once_and_misses_no_match(spark):
    held = ["a, bb, and c", "not only fast but also small", "here is a draft", "Underscoring its significance", "[cite: 4]", "😀 x", "- * -", "NOT " + "İ" * 80 + " but yy", "x, " + "İ" * 35 + ", or z", "none", "", "`**b:** c`"]
    docs = texts(spark, *held, *(f"{t}. {t.upper()}" for t in held), "\n\n".join(held))
    rows = docs.select("doc_id", "text", plain_search(F.col("text"), PATTERN_WORD, [p[3] for p in PATTERNS]).alias("s"))
    for r in rows.collect():
        assert r.s.words == len(re.findall(PATTERN_WORD, r.text)) and r.s.held == sorted(set(r.s.held))
    for n, (_, regex, _, _) in enumerate(PATTERNS):
        assert rows.filter(F.col("text").rlike(regex) & ~F.array_contains("s.held", n)).count() == 0, regex
    for found in (style_review(docs), rule_metrics(docs), category_points(docs)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "contains(" not in plan.lower().replace("array_contains(", "")


def test_patterns_tell_their_first_signs():
    assert [looked_for(p) for p in ("delv(?:e|ed)", "(?:a )?(?:testament|reminder) to", r"\[cite", "[^.]{2} rather", r"\bx", "(?:a)?", "I|you")] == ["(?=[d])", "(?=[art])", r"(?=[\[])", "", "", "", "(?=[iy])"]
