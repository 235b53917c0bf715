"""The typed blocks and the style review told in DuckDB's SQL, step by step: blocks by a recursive reading, matches laid end to end, spans folded in a list."""

from __future__ import annotations

import re

from inkspan.operators.style_review import ACTIVE_CATEGORIES, BOLD, CAPS, CATEGORY, DASH, LEAST_WORDS, LINE_CHECKS, POINTS, QUOTES, RULES, SKIPPED, STRENGTH
from inkspan.functions.text import PATTERN_WORD

GAP = r"\n\s*\n"
ELIGIBLE, EXCLUDED = "('paragraph', 'heading', 'list_item', 'table_cell', 'caption')", "('quotation', 'reference', 'code', 'template')"
LEFT, RIGHT = r"regexp_replace({}, '^\s+', '')", r"regexp_replace({}, '\s+$', '')"
#: Any last letter of a run without the given ones, no word going on behind it.
_LAST = r"(?:[A-Za-z0-9_]\b|[^{0}A-Za-z0-9_]\B)"
#: Patterns that begin or end with any letter, as this engine, which can't look around, has to be asked.
SPECIAL = {
    "not (?:just|only) [^.!?]{2,90}?[,;]? but (?:also )?[^.!?]{2,100}": r"\bnot (?:just|only) [^.!?]{2,90}?[,;]? but (?:also )?[^.!?]{1,99}" + _LAST.format(".!?"),
    "not [^.!?]{2,80}?[,;]? but [^.!?]{2,100}": r"\bnot [^.!?]{2,80}?[,;]? but [^.!?]{1,99}" + _LAST.format(".!?"),
    "[^.!?]{2,60}? rather than [^.!?]{2,60}": r"(?:\b[A-Za-z0-9_]|\B[^.!?A-Za-z0-9_])[^.!?]{1,59}? rather than [^.!?]{1,59}" + _LAST.format(".!?"),
    "\\b[\"'’A-Za-z][^,.;:]{1,35}, [^,.;:]{1,35}, (?:and|or) [^,.;:]{1,35}": r"\b[A-Za-z][^,.;:]{1,35}, [^,.;:]{1,35}, (?:and|or) [^,.;:]{0,34}" + _LAST.format(",.;:"),
}


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def bounded(p: str) -> str:
    """A pattern between letters and digits, none of which may touch it."""
    if p in SPECIAL:
        return "(?i)" + SPECIAL[p]
    begins, ends = re.match(r"[A-Za-z0-9(]", p), re.search(r"[A-Za-z0-9)?+]$", p)
    return "(?i)" + (r"\b" if begins else r"\B") + f"(?:{p})" + (r"\b" if ends else r"\B")


def parts(source: str) -> str:
    """CTEs `src` and `pieces`: i, start and text of each part between blank lines, empty ones too."""
    return f"""src AS ({source}),
cut AS (SELECT doc_id, format, unnest(string_split_regex(text, '{GAP}')) AS piece, unnest(list_concat(regexp_extract_all(text, '{GAP}'), [NULL])) AS gap,
  generate_subscripts(string_split_regex(text, '{GAP}'), 1) AS i FROM src WHERE text IS NOT NULL),
laid AS (SELECT *, sum(length(piece) + coalesce(length(gap), 0)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) - coalesce(length(gap), 0) AS low FROM cut),
pieces AS (SELECT doc_id, format, i, CAST(low + length(piece) - length({LEFT.format("piece")}) AS BIGINT) AS start, {RIGHT.format(LEFT.format("piece"))} AS text FROM laid),
full_pieces AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM pieces WHERE text <> '')"""


def plain(source: str) -> str:
    """CTEs up to `blocks` of plain texts."""
    return f"""{parts(source)},
blocks AS (SELECT doc_id, CAST(n AS BIGINT) AS block_no, text, start, CAST(NULL AS INTEGER) AS heading_level,
  CASE WHEN substring(text, 1, 1) IN ('>', '"', '“') THEN 'quotation' WHEN regexp_matches(text, '(?i)^(?:references|works cited|bibliography)(?:$|[^\\p{{L}}\\p{{N}}_])') THEN 'reference' ELSE 'paragraph' END AS kind
  FROM full_pieces)"""


def typed(source: str) -> str:
    """CTEs (recursive) up to `blocks` of texts of several formats, read one after another with what is open."""
    fences = "(length(text) - length(replace(text, '```', ''))) // 3"
    code = "(p.format = 'md' AND starts_with(p.text, '```') OR r.open)"
    head = r"regexp_matches(p.text, '(?i)^(?:#{1,6}\s*)?(?:references|works cited|bibliography)[:#*\s]*$')"
    kind = rf"""CASE WHEN {code} THEN 'code' WHEN {head} THEN 'heading' WHEN r.listed THEN 'reference' WHEN p.format = 'md' AND regexp_matches(p.text, '^#{{1,6}}\s+') THEN 'heading'
    WHEN regexp_matches(p.text, '^(?:[-*+] |\d+[.)] )') THEN 'list_item' WHEN regexp_matches(p.text, '^>\s') THEN 'quotation'
    WHEN starts_with(p.text, '```') OR p.format IN ('tex', 'ipynb') AND contains(p.text, '[Mathematical Formula]') THEN 'code' ELSE 'paragraph' END"""
    return f"""{parts(source)},
numbered AS (SELECT *, {fences} AS fences FROM full_pieces),
reading AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS start, '' AS text, '' AS kind, false AS open, false AS listed FROM src
  UNION ALL
  SELECT p.doc_id, p.n, p.i, p.start, p.text, {kind}, CASE WHEN p.format = 'md' AND starts_with(p.text, '```') THEN p.fences % 2 = 1 WHEN p.fences > 0 THEN false ELSE r.open END, r.listed OR (NOT {code} AND {head})
  FROM reading r JOIN numbered p ON p.doc_id = r.doc_id AND p.n = r.n + 1
),
blocks AS (SELECT doc_id, CAST(i AS BIGINT) AS block_no, text, start, kind, CASE WHEN kind = 'heading' THEN greatest(1, length(regexp_extract(text, '^#*'))) END AS heading_level FROM reading WHERE n > 0)"""


def found() -> str:
    """CTEs from `blocks` to `spans`: doc_id, block_no, kind, rule_id, low, size of all findings."""
    rows = []

    def one(rule: str, pattern: str, where: str = "true") -> None:
        rows.append(f"""SELECT doc_id, block_no, kind, '{rule}' AS rule_id, sum(length(piece) + length(m)) OVER (PARTITION BY doc_id, block_no ORDER BY k) - length(m) AS low, length(m) AS size FROM (
  SELECT doc_id, block_no, kind, unnest(found) AS m, unnest(pieces[1:len(found)]) AS piece, generate_subscripts(found, 1) AS k FROM (
  SELECT doc_id, block_no, kind, regexp_extract_all(text, {quoted(pattern)}) AS found, string_split_regex(text, {quoted(pattern)}) AS pieces FROM blocks WHERE {where}))""")

    for r in RULES:
        for p in r.patterns:
            one(r.name, bounded(p), f"kind IN ({', '.join(map(quoted, r.kinds))})")
    one(DASH, "—")
    one(QUOTES, "[“”‘’]")
    for name, p in LINE_CHECKS.items():
        one(name, "(?m)" + p.replace(r"\U0001F300-\U0001FAFF", r"\x{1F300}-\x{1FAFF}"))
    return f"""raw AS ({' UNION ALL '.join(rows)}),
listed AS (SELECT doc_id, block_no, kind, rule_id, list_transform(list_sort(list_distinct(list({{'low': CAST(low AS BIGINT), 'size': CAST(size AS BIGINT)}}))), lambda x: [x]) AS spans FROM raw GROUP BY ALL),
folded AS (SELECT doc_id, block_no, kind, rule_id, list_reduce(spans, lambda kept, x: CASE WHEN x[1].low >= kept[len(kept)].low + kept[len(kept)].size THEN list_concat(kept, x)
  WHEN x[1].size < kept[len(kept)].size THEN list_concat(kept[1:len(kept) - 1], x) ELSE kept END) AS spans FROM listed),
levels AS (SELECT *, lag(heading_level) OVER (PARTITION BY doc_id ORDER BY block_no) AS before FROM blocks WHERE heading_level IS NOT NULL),
spans AS (SELECT doc_id, block_no, kind, rule_id, s.low AS low, s.size AS size FROM (SELECT doc_id, block_no, kind, rule_id, unnest(spans) AS s FROM folded)
  UNION ALL SELECT doc_id, block_no, kind, '{SKIPPED}', 0, length(text) FROM levels WHERE heading_level > before + 1)"""


def metrics() -> str:
    """CTEs to `metrics` (a row a document and rule), `scored` and `words`."""
    case = lambda f: "CASE rule_id " + " ".join(f"WHEN '{r.name}' THEN {f(r)}" for r in RULES) + " END"
    category = "CASE rule_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY.items()) + " END"
    words = f"len(regexp_extract_all(text, '{PATTERN_WORD.replace(chr(39), chr(39) * 2)}'))"
    return f"""{found()},
words AS (SELECT src.doc_id, CAST(coalesce(sum({words.replace("text", "b.text")}) FILTER (b.kind IN {ELIGIBLE}), 0) AS BIGINT) AS eligible_words, CAST(coalesce(sum({words.replace("text", "b.text")}) FILTER (b.kind IN {EXCLUDED}), 0) AS BIGINT) AS excluded_words
  FROM src LEFT JOIN blocks b ON b.doc_id = src.doc_id GROUP BY src.doc_id),
by_block AS (SELECT doc_id, block_no, kind, rule_id, count(*) AS n FROM spans GROUP BY ALL),
metrics AS (SELECT b.doc_id, rule_id, {category} AS category, CAST(sum(n) AS BIGINT) AS count, CAST(coalesce(sum(n) FILTER (kind NOT IN {EXCLUDED}), 0) AS BIGINT) AS eligible_count,
  coalesce(sum(n) FILTER (kind NOT IN {EXCLUDED}), 0) / CAST(greatest(1, any_value(eligible_words)) AS DOUBLE) * 1000 AS rate,
  count(*) AS affected_blocks, CAST(coalesce(max(n) FILTER (kind NOT IN {EXCLUDED}), 0) AS BIGINT) AS local_concentration FROM by_block b JOIN words w ON w.doc_id = b.doc_id GROUP BY b.doc_id, rule_id),
judged AS (SELECT *, coalesce(eligible_count >= {case(lambda r: r.least)} AND rate >= {case(lambda r: r.rate)}, false) AS met FROM metrics),
marked AS (SELECT s.*, {category} AS category, CASE WHEN rule_id = '{QUOTES}' THEN 'no_weight' WHEN rule_id IN ('{SKIPPED}', '{BOLD}') THEN NULL WHEN rule_id = '{DASH}' AND kind NOT IN {ELIGIBLE} THEN 'block_type'
  WHEN kind IN {EXCLUDED} THEN 'block_type' WHEN rule_id IN ({', '.join(map(quoted, STRENGTH))}) AND NOT met THEN 'below_threshold' END AS reason FROM spans s JOIN (SELECT doc_id, rule_id, met FROM judged) j USING (doc_id, rule_id)),
scored AS (SELECT doc_id, block_no, category, count(*) AS n, count(*) OVER (PARTITION BY doc_id, block_no) AS together FROM marked WHERE reason IS NULL GROUP BY doc_id, block_no, category)"""


def rounded(x: str, digits: int) -> str:
    return f"CAST(format('{{:.{digits}f}}', {x}) AS DOUBLE)"


def categories(promotion: float = 1.0) -> str:
    """CTEs to `categories`: a row a document and category."""
    points = "CASE rule_id " + " ".join(f"WHEN '{r.name}' THEN {POINTS[r.strength]} * least(2.0, eligible_count / CAST({r.least} AS DOUBLE)) * {promotion if r.category == 'promotional_language' else 1.0}" for r in RULES) + " END"
    caps = ", ".join(f"('{c}', CAST({cap} AS DOUBLE))" for c, cap in CAPS.items())
    dashes = rounded("coalesce(d.n, 0) / CAST(greatest(1, w.eligible_words) AS DOUBLE) * 1000", 2)
    return f"""{metrics()},
caps(category, cap) AS (VALUES {caps}),
earned AS (SELECT doc_id, category, sum({points}) AS points FROM judged WHERE met GROUP BY doc_id, category),
counted AS (SELECT doc_id, category, CAST(sum(n) AS BIGINT) AS scored_findings, count(*) FILTER (together > 1) AS shared_blocks FROM scored GROUP BY doc_id, category),
dashes AS (SELECT doc_id, count(*) AS n FROM spans WHERE rule_id = '{DASH}' GROUP BY doc_id),
categories AS (SELECT w.doc_id, c.category, c.cap, coalesce(k.scored_findings, 0) AS scored_findings, coalesce(k.shared_blocks, 0) AS shared_blocks,
  {rounded(f"least(c.cap, CASE c.category WHEN 'punctuation' THEN greatest(0.0, {dashes} - 2.0) * 0.25 WHEN 'formatting' THEN 1.5 * coalesce(k.scored_findings, 0) ELSE coalesce(e.points, 0.0) END)", 1)} AS points
  FROM words w CROSS JOIN caps c LEFT JOIN earned e ON e.doc_id = w.doc_id AND e.category = c.category LEFT JOIN counted k ON k.doc_id = w.doc_id AND k.category = c.category LEFT JOIN dashes d ON d.doc_id = w.doc_id)"""


def style_documents(blocks: str) -> str:
    return f"""WITH RECURSIVE {blocks}, {categories()},
totals AS (SELECT doc_id, sum(points) AS points, count(*) FILTER (points > 0) AS active FROM categories GROUP BY doc_id),
many AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id)
SELECT w.doc_id, w.eligible_words, w.excluded_words, CASE WHEN w.eligible_words >= {LEAST_WORDS} THEN {rounded(f"t.points / {sum(CAPS.values())} * 100", 1)} END AS style_index, t.active AS active_categories, coalesce(m.n, 0) AS findings,
  CASE WHEN w.eligible_words < {LEAST_WORDS} THEN 'insufficient_text' WHEN t.active >= {ACTIVE_CATEGORIES} THEN 'review_categories' ELSE 'review_passages' END AS recommendation
FROM words w JOIN totals t ON t.doc_id = w.doc_id LEFT JOIN many m ON m.doc_id = w.doc_id"""


def style_rule_metrics(blocks: str) -> str:
    return f"""WITH RECURSIVE {blocks}, {metrics()}
SELECT doc_id, rule_id, category, count, eligible_count, {rounded("rate", 2)} AS per_1000, affected_blocks, local_concentration, met AS threshold_met FROM judged WHERE rule_id IN ({', '.join(map(quoted, STRENGTH))})"""


def style_categories(blocks: str) -> str:
    return f"WITH RECURSIVE {blocks}, {categories()} SELECT doc_id, category, points, cap, scored_findings, shared_blocks FROM categories"


def style_evidence(blocks: str, radius: int = 90) -> str:
    strength = "CASE rule_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STRENGTH.items()) + " ELSE 'weak' END"
    around = f"replace(substring(src.text, CAST(greatest(0, m.low + b.start - {radius}) AS BIGINT) + 1, CAST(m.low + b.start + m.size + {radius} - greatest(0, m.low + b.start - {radius}) AS BIGINT)), chr(10), ' ')"
    return f"""WITH RECURSIVE {blocks}, {metrics()},
placed AS (SELECT m.doc_id, rule_id, category, {strength} AS strength, m.block_no, m.kind, CAST(b.start + m.low AS BIGINT) AS "start", CAST(b.start + m.low + m.size AS BIGINT) AS "end", substring(b.text, CAST(m.low AS BIGINT) + 1, CAST(m.size AS BIGINT)) AS matched,
  {RIGHT.format(LEFT.format(around))} AS context, reason FROM marked m JOIN blocks b ON b.doc_id = m.doc_id AND b.block_no = m.block_no JOIN src ON src.doc_id = m.doc_id)
SELECT doc_id, 'finding-' || substring(sha1(rule_id || ':block-' || block_no || ':' || "start" || ':' || "end"), 1, 12) AS finding_id, rule_id, category, strength, block_no, kind, "start", "end", matched, context, reason IS NOT NULL AS excluded, reason FROM placed"""


def block_rows(blocks: str) -> str:
    return f"""WITH RECURSIVE {blocks}
SELECT doc_id, block_no, kind, sha256(text) AS text_sha256, heading_level, start AS source_start, start + length(text) AS source_end,
  CAST(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY block_no) - length(text) - 2 AS BIGINT) AS "start", CAST(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY block_no) - 2 AS BIGINT) AS "end" FROM blocks"""


def kept_documents(blocks: str) -> str:
    return rf"""WITH RECURSIVE {blocks},
told AS (SELECT *, max(CASE WHEN regexp_matches(text, '(?i)^\s*(?:appendix|appendices)(?:$|[^\p{{L}}\p{{N}}_])') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_no) AS behind FROM blocks),
reasons AS (SELECT *, CASE WHEN kind IN ('table_cell', 'code') THEN kind WHEN behind = 1 THEN 'appendix' WHEN kind = 'reference' THEN 'reference' END AS reason FROM told)
SELECT src.doc_id, sha256(coalesce(string_agg(r.text, chr(10) || chr(10) ORDER BY block_no) FILTER (reason IS NULL), '')) AS text_sha256, count(*) FILTER (reason = 'table_cell') AS skipped_table_cell, count(*) FILTER (reason = 'code') AS skipped_code,
  count(*) FILTER (reason = 'appendix') AS skipped_appendix, count(*) FILTER (reason = 'reference') AS skipped_reference FROM src LEFT JOIN reasons r ON r.doc_id = src.doc_id GROUP BY src.doc_id"""
