"""Punctuation, line checks and the list of what the style review covers; the review itself is in operators.style_review."""

from __future__ import annotations

from inkspan.functions.text import PATTERN_SENTENCE
from inkspan.operators.style_review import COVERAGE, LINE_CHECKS
from inkspan.plans.signals import _source
from inkspan.plans.textstats import big, dbl

def punctuation_metrics(d) -> str:
    """Dashes, hyphens and curly quotes; em dashes by the spaces at them; sentences with one, with several, with a pair around an aside."""
    em, both, neither = d.count("text", "—"), d.marks_with("text", "—", r"\s", True), d.marks_with("text", "—", r"\s", False)
    sentences = d.each(f"({_source(d)})" + (" t" if d.name == "spark" else ""), d.all("text", PATTERN_SENTENCE), "s", "piece")
    share = lambda n: d.round(f"{dbl(n)} / greatest(1, sentences) * 100", 2)
    return f"""WITH x AS (SELECT doc_id, {big(em)} AS em_dashes, {big(d.count("text", "–"))} AS en_dashes, {big(d.count("text", "-"))} AS hyphens,
  {big(d.count("text", "[“”‘’]"))} AS smart_quotes, {big(both)} AS spaced_both, {big(neither)} AS unspaced,
  {d.round(f'{dbl(em)} / greatest(1, {d.count("text", r"[A-Za-z0-9]+(?:['’][A-Za-z]+)?")}) * 1000', 2)} AS em_dashes_per_1000 FROM ({_source(d)}) t),
y AS (SELECT doc_id, {big("count(*)")} AS sentences, {big(f"sum(CASE WHEN {d.count('piece', '—')} > 0 THEN 1 ELSE 0 END)")} AS with_dash, {big(f"sum(CASE WHEN {d.count('piece', '—')} > 1 THEN 1 ELSE 0 END)")} AS with_several,
  {big(f"sum(CASE WHEN {d.like('piece', r'—[^—' + chr(92) + 'n]{2,120}—')} THEN 1 ELSE 0 END)")} AS paired FROM {sentences} WHERE {d.like("piece", r"[^\s]")} GROUP BY doc_id)
SELECT x.*, x.em_dashes - x.spaced_both - x.unspaced AS mixed, coalesce(y.with_several, 0) AS sentences_with_several, coalesce(y.paired, 0) AS paired,
  coalesce({share("y.with_dash")}, {dbl("0")}) AS sentences_with_dash_pct FROM x LEFT JOIN y ON x.doc_id = y.doc_id"""


def formatting_findings(d) -> str:
    """Emoji markers, separators, leftover markup and bold labels by line; a line may have several."""
    lines = d.each(f"({_source(d)})" + (" t" if d.name == "spark" else ""), d.split("text", r"\n"), "l", "line")
    checks = {name: p.replace("\U0001F300-\U0001FAFF", r"\x{1F300}-\x{1FAFF}").replace(r"\U0001F300-\U0001FAFF", r"\x{1F300}-\x{1FAFF}") for name, p in LINE_CHECKS.items()}
    counts, names = d.array(big(d.count("line", p)) for p in checks.values()), d.array(f"'{n}'" for n in checks)
    return f"""WITH f AS (SELECT doc_id, l, {names} AS names, {counts} AS counts FROM {lines}),
k AS (SELECT doc_id, l, kind, {d.at("counts", "n")} AS findings FROM {d.each("f", "names", "n", "kind")})
SELECT doc_id, {big('l')} AS line_no, kind, findings FROM k WHERE findings > 0"""


def review_coverage(d) -> str:
    """What the review checks and what it leaves to others."""
    quote = lambda s: "'" + s + "'"
    rows = ", ".join(f"({n}, {quote(key)}, {quote(what)}, {quote(status)})" for n, (key, what, status) in enumerate(COVERAGE, 1))
    return f"SELECT {big('place')} AS place, check_id, description, status FROM (VALUES {rows}) AS v(place, check_id, description, status)"


PLANS = {f.__name__: f for f in (punctuation_metrics, formatting_findings, review_coverage)}
