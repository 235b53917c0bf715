"""Exclusions from overlap, typed blocks, openings, summaries and rewording options."""

from __future__ import annotations

from inkspan.functions.text import MATCH_WORD, PLAIN_WORD, careful_sentences, trimmed
from inkspan.plans.overlap import QUOTE, coverage, quoted_words
from inkspan.plans.signals import CITATIONS, EMPTY, HIGH, LABELS, _source, evidence_score, pattern_scores, top_signals, unsupported_claims
from inkspan.plans.textstats import big, dbl

# Verbs and their replacements in reworded options.
#: Fixed value: the first line of a bibliography that overlap may leave out.
LISTED = r"(?im)^[ \t]*(?:#+[ \t]*|\d+\.[ \t]*)?(?:references|bibliography|works cited|reference list)[ \t]*(?::[ \t]*)?$"
VERBS = (("shows", "demonstrates"), ("proves", "substantiates"), ("uses", "employs"), ("helps", "facilitates"), ("says", "posits"))


def _source_rows(d) -> str:
    return f"({_source(d)})" + (" t" if d.name == "spark" else "")


def overlap_variants(d) -> str:
    """Overlap of all words, of the body, of the bibliography, and of quotations, and with quotations and bibliography left out.

    Quoted words are numbered from the words of the pieces between quotations;
    the bibliography's words are those behind the first header line.
    """
    body = d.at(d.split(d.replace("text", LISTED, "\x03"), r"\x03"), "0")
    share = lambda a, b: f"CASE WHEN {b} = 0 THEN {dbl('0.0')} ELSE {d.round(f"{dbl('100.0')} * {a} / {b}", 2)} END"
    return f"""WITH {coverage(d)},
{quoted_words(d)},
b AS (SELECT doc_id, {d.count("text", MATCH_WORD)} AS n, {d.count(body, MATCH_WORD)} AS body_n FROM documents),
raw AS (SELECT DISTINCT doc_id, k FROM cover),
m AS (
  SELECT r.doc_id, count(*) AS raw, sum(CASE WHEN r.k < b.body_n THEN 1 ELSE 0 END) AS in_body, sum(CASE WHEN r.k >= b.body_n THEN 1 ELSE 0 END) AS in_bib,
    sum(CASE WHEN q.k IS NOT NULL THEN 1 ELSE 0 END) AS in_quotes, sum(CASE WHEN q.k IS NULL AND r.k < b.body_n THEN 1 ELSE 0 END) AS scored
  FROM raw r JOIN b ON r.doc_id = b.doc_id LEFT JOIN quoted q ON r.doc_id = q.doc_id AND r.k = q.k GROUP BY r.doc_id
),
e AS (SELECT q.doc_id, count(*) AS quoted, sum(CASE WHEN q.k >= b.body_n THEN 1 ELSE 0 END) AS quoted_bib FROM quoted q JOIN b ON q.doc_id = b.doc_id GROUP BY q.doc_id)
SELECT b.doc_id, {big("b.n")} AS total_words, {big("b.n - b.body_n")} AS bibliography_words, {big("coalesce(e.quoted, 0)")} AS quoted_words,
  {share("coalesce(m.raw, 0)", "b.n")} AS raw_similarity, {share("coalesce(m.in_body, 0)", "b.body_n")} AS body_similarity,
  {share("coalesce(m.in_bib, 0)", "(b.n - b.body_n)")} AS bibliography_similarity, {share("coalesce(m.in_quotes, 0)", "coalesce(e.quoted, 0)")} AS quotation_similarity,
  {share("coalesce(m.scored, 0)", "(b.body_n - coalesce(e.quoted, 0) + coalesce(e.quoted_bib, 0))")} AS scored_similarity
FROM b LEFT JOIN m ON b.doc_id = m.doc_id LEFT JOIN e ON b.doc_id = e.doc_id"""


def skipped_headings(d) -> str:
    """Headings more than one level below the heading before them."""
    lines = d.each(_source_rows(d), d.split("text", r"\n"), "l", "line")
    return f"""WITH h AS (SELECT doc_id, l, length({d.first("line", r"^(#{1,6})\s", 1)}) AS level FROM {lines} WHERE {d.like("line", r"^#{1,6}\s")}),
p AS (SELECT doc_id, l, level, lag(level) OVER (PARTITION BY doc_id ORDER BY l) AS before FROM h)
SELECT doc_id, {big("l")} AS line_no, {big("level")} AS heading_level, coalesce(level > before + 1, false) AS skips FROM p"""


def check_summary(d) -> str:
    """One verdict a document from its patterns, provenance marks and evidence, and up to three fixes in order of priority.

    Fixes are provenance marks first, then the top signals, then claims
    without a citation.
    """
    verdict = f"""CASE WHEN NOT p.enough THEN 'insufficient_text' WHEN p.provenance > 0 OR p.pattern_score >= {HIGH} OR (e.evidence_score IS NOT NULL AND e.evidence_score < 60) THEN 'needs_review' ELSE 'clear' END AS verdict,
  {big(f"CASE WHEN NOT p.enough THEN 1 ELSE CASE WHEN p.provenance > 0 THEN 1 ELSE 0 END + CASE WHEN p.pattern_score >= {HIGH} THEN 1 ELSE 0 END + CASE WHEN e.evidence_score < 60 THEN 1 ELSE 0 END END")} AS reasons"""
    if d.name == "spark":  # a text's patterns are looked for once, its fixes told in its row
        signals = ", ".join(f"struct(-{n} AS score, -n_{n} AS rows, '{label}' AS label, '{n}' AS what)" for n, label in LABELS.items())
        named = "transform(slice(array_sort(filter(array({}), s -> s.score < 0)), 1, 3), s -> CASE WHEN s.score <= -2 THEN 'high:' ELSE 'moderate:' END || s.what)".format(signals)
        fixes = f"slice(concat(array_repeat('critical:provenance', CAST(coalesce(least(3, provenance), 0) AS INT)), {named}, CASE WHEN open THEN array('high:citation') ELSE {EMPTY} END), 1, 3)"
        return f"""WITH p AS (SELECT doc_id, pattern_score, provenance, enough, {fixes} AS fixes FROM ({pattern_scores(d, "coalesce(size(open_claims) > 0, false) AS open")}) t), e AS ({evidence_score(d)})
SELECT p.doc_id, p.pattern_score, p.provenance, e.evidence_score,
  {verdict},
  {big("size(p.fixes)")} AS fixes, array_join(p.fixes, ',') AS top_fixes FROM p JOIN e ON p.doc_id = e.doc_id"""
    fixes = f"""SELECT doc_id, 1 AS kind, k AS place, 'critical' AS priority, 'provenance' AS what FROM {d.numbers("marks", "0", "least(3, provenance)", "k")}
UNION ALL SELECT doc_id, 2 AS kind, place AS k, CASE WHEN score >= 2 THEN 'high' ELSE 'moderate' END AS priority, category AS what FROM signals
UNION ALL SELECT doc_id, 3 AS kind, 1 AS k, 'high' AS priority, 'citation' AS what FROM open_claims"""
    return f"""WITH p AS ({pattern_scores(d)}), e AS ({evidence_score(d)}), marks AS (SELECT doc_id, CAST(provenance AS INT) AS provenance FROM p), signals AS ({top_signals(d)}),
open_claims AS (SELECT DISTINCT doc_id FROM ({unsupported_claims(d)}) u), fixes AS ({fixes}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, place) AS n FROM fixes),
f AS (SELECT doc_id, {big("count(*)")} AS fixes, {d.joined("priority || ':' || what", "n")} AS top_fixes FROM r WHERE n <= 3 GROUP BY doc_id)
SELECT p.doc_id, p.pattern_score, p.provenance, e.evidence_score,
  {verdict},
  coalesce(f.fixes, 0) AS fixes, coalesce(f.top_fixes, '') AS top_fixes
FROM p JOIN e ON p.doc_id = e.doc_id LEFT JOIN f ON p.doc_id = f.doc_id"""


def reworded(d) -> str:
    """Three options to reword each sentence of the documents.

    Of the verbs the first in the list that occurs is replaced, once.
    """
    rows = d.each("documents", careful_sentences(d), "s", "piece")
    words = d.all(d.replace(trimmed(d, "piece"), r"[.!?]+$", ""), PLAIN_WORD)
    once = lambda old, new: f"substring(o, 1, strpos(o, ' {old} ') - 1) || ' {new} ' || substring(o, strpos(o, ' {old} ') + {len(old) + 2})"
    if d.name == "spark":
        once = lambda old, new: f"substring(o, 1, instr(o, ' {old} ') - 1) || ' {new} ' || substring(o, instr(o, ' {old} ') + {len(old) + 2})"
    verb = "CASE " + " ".join(f"WHEN contains(o, ' {old} ') THEN {once(old, new)}" for old, new in VERBS) + " ELSE o END"
    half = lambda low, high: d.join_words(d.part("w", low, high))
    return f"""WITH c AS (SELECT doc_id, s, {words} AS w FROM {rows}),
o AS (SELECT doc_id, s, w, {d.size("w")} AS n, lower({d.at("w", "0")}) || ' ' || {half("1", d.size("w"))} AS o FROM c WHERE {d.size("w")} > 0)
SELECT doc_id, {big("s")} AS sentence_no, {big("n")} AS words, 'According to the cited literature, ' || o || '.' AS active,
  'Empirical findings suggest that ' || {verb} || ' (the cited literature, 2024).' AS passive,
  CASE WHEN n > 6 THEN 'Regarding ' || lower({half("0", "CAST(floor(n / 2) AS INT)")}) || ', subsequent analysis confirms that ' || {half("CAST(floor(n / 2) AS INT)", "n")} || '.'
    ELSE 'Notably, ' || o || ', reflecting core principles documented in the cited literature.' END AS analytical FROM o"""


def math_counts(d) -> str:
    """Inline and block formulas."""
    wrapped = f"(SELECT doc_id, text || ' $x^2$ and $$y$$ ' || CASE WHEN doc_id % 2 = 0 THEN '$a$' ELSE '' END AS text FROM documents) t"
    block = d.count("text", r"\$\$[^$]+\$\$")
    return f"""SELECT doc_id, {big(block)} AS blocks, {big(f"{d.count(d.replace('text', r'[$][$][^$]+[$][$]', ' '), '[$][^$]+[$]')}")} AS inline FROM {wrapped}"""


def attribution(d) -> str:
    """Quoted and cited sentences in four kinds."""
    rows = d.each(_source_rows(d), careful_sentences(d), "s", "piece")
    quoted, cited = d.like("piece", QUOTE), "(" + " OR ".join(d.like("piece", p) for p in CITATIONS.values()) + ")"
    return f"""SELECT doc_id, kind, {big("count(*)")} AS sentences FROM (
  SELECT doc_id, CASE WHEN {quoted} AND {cited} THEN 'quoted and cited' WHEN {quoted} THEN 'quoted' WHEN {cited} THEN 'cited' ELSE 'neither' END AS kind
  FROM {rows} WHERE length({trimmed(d, "piece")}) > 0) k GROUP BY doc_id, kind"""


PLANS = {
    f.__name__: f for f in (overlap_variants, skipped_headings, check_summary, reworded, math_counts, attribution)
}
