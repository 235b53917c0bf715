"""The evidence operators' results told in DuckDB's SQL, independently of their code: matches and pieces laid end to end give offsets."""

from __future__ import annotations

from inkspan.functions.text import PATTERN_SENTENCE, PATTERN_WORD, careful_sentences, trimmed
from inkspan.operators.patterns import KINDS, SHOWN
from inkspan.operators.revision import SUGGESTED
from inkspan.plans.dialect import DUCK
from inkspan.plans.signals import ANCHOR, ANCHORED, CHATBOT, CITATIONS, CLAIMS, HEDGES, LABELS, MARKERS, PROVENANCE, RHETORIC, STRUCTURES, TRANSITIONS, VAGUE, _source, ci

D = DUCK


def spans(pattern: str, category: str, place: int, kind: str) -> str:
    seen = D.bounded("text", pattern)
    return f"""SELECT doc_id, '{category}' AS category, {place} AS n, '{kind}' AS kind, low, high, substring(text, CAST(low AS BIGINT) + 1, CAST(high - low AS BIGINT)) AS raw FROM (
  SELECT doc_id, text, sum(length(piece) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS low, sum(length(piece) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS high FROM (
  SELECT doc_id, text, unnest(found) AS m, unnest(pieces[1:len(found)]) AS piece, generate_subscripts(found, 1) AS i
  FROM (SELECT doc_id, text, {D.all(seen, pattern)} AS found, {D.split(seen, pattern)} AS pieces FROM src)))"""


def evidence_ctes() -> str:
    """CTEs up to `ev`: doc_id, category, place, kind, low, high, text of the evidence; and `sents`."""
    sought = [(p, "predictability", i, "stock vocabulary") for i, p in enumerate(ci(rf"\b{m}\b") for m in MARKERS)]
    sought += [(ci(p), "hedging", i, "hedge") for i, p in enumerate(HEDGES)] + [("(?im)" + p.replace("(?m)", ""), "transitions", i, "formulaic transition") for i, p in enumerate(TRANSITIONS)]
    for category, patterns in (("structure", STRUCTURES), ("register", CHATBOT), ("rhetoric", RHETORIC), ("provenance", PROVENANCE)):
        sought += [(ci(p), category, i, KINDS[category][i]) for i, p in enumerate(patterns)]
    sought += [("—", "punctuation", 0, "em dash"), (ci(r"\b(?:the (?:problem|answer|reason|rule|point)|what matters)\s*:"), "punctuation", 3, "announcement colon")]
    found = " UNION ALL ".join(spans(*s) for s in sought)
    bare = f"NOT ({D.like('sentence', ANCHORED)}) AND NOT ({D.like('sentence', ANCHOR)})"
    vague = " OR ".join(D.like("sentence", ci(p)) for p in VAGUE)
    claims = " OR ".join(D.like("sentence", ci(p)) for p in CLAIMS)
    cited = " OR ".join(D.like("sentence", p) for p in CITATIONS.values())
    bullets = D.count("text", r"(?m)^[ \t]*(?:[-*•]|\d+[.)])\s+")
    dashes = r"regexp_matches(substring(text, i, 4), '^\s--\s$') AND (i = 1 OR substring(text, i - 1, 1) <> '-') AND substring(text, i + 4, 1) <> '-'"
    return f"""src AS ({_source(D)}),
raw AS ({found}
UNION ALL SELECT * FROM ({spans("—[^—" + chr(92) + "n]{2,100}—", "punctuation", 2, "wrapped em-dash aside")}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY low) = 1
UNION ALL SELECT doc_id, 'punctuation', 1, 'spaced double hyphen', i - 1, i + 3, substring(text, i, 4) FROM (SELECT doc_id, text, unnest(range(1, length(text) - 2)) AS i FROM src WHERE contains(text, '--')) WHERE {dashes}
UNION ALL SELECT doc_id, 'structure', 9, 'list-heavy structure', 0, 0, {bullets} || ' list items' FROM src WHERE {bullets} >= 5),
one AS (SELECT doc_id, category, kind, low, high, any_value({trimmed(D, "raw")}) AS text, min(n) AS n FROM raw WHERE category <> 'register' GROUP BY ALL
  UNION ALL SELECT doc_id, category, kind, low, high, {trimmed(D, "raw")}, n FROM raw WHERE category = 'register'),
listed AS (SELECT doc_id, category, row_number() OVER (PARTITION BY doc_id, category ORDER BY CASE WHEN category = 'register' THEN n ELSE 0 END, low, high, kind) AS place, kind, low, high, text FROM one),
sents AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY low) AS s, low + length(regexp_extract(raw, '^\\s*')) AS low, low + length(regexp_extract(raw, '^\\s*')) + length({trimmed(D, "raw")}) AS high,
  {trimmed(D, "raw")} AS sentence, {D.count("lower(raw)", PATTERN_WORD)} AS words FROM ({spans(PATTERN_SENTENCE, "", 0, "")}) WHERE length({trimmed(D, "raw")}) >= 4),
runs AS (SELECT a.doc_id, a.s, a.low, c.high, [a.words, b.words, c.words] AS w FROM sents a JOIN sents b ON a.doc_id = b.doc_id AND b.s = a.s + 1 JOIN sents c ON a.doc_id = c.doc_id AND c.s = a.s + 2
  WHERE greatest(a.words, b.words, c.words) - least(a.words, b.words, c.words) <= 5 AND least(a.words, b.words, c.words) >= 8),
vague AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY low) AS place, low, high, substring(sentence, 1, 220) AS text FROM sents WHERE ({vague}) AND {bare}),
claimed AS (SELECT doc_id, k, sentence FROM (SELECT doc_id, {trimmed(D, "piece")} AS sentence, k FROM (
  SELECT doc_id, unnest({careful_sentences(D)}) AS piece, generate_subscripts({careful_sentences(D)}, 1) AS k FROM src)) WHERE length(sentence) > 20 AND ({claims}) AND NOT ({cited})),
lone AS (SELECT c.*, row_number() OVER (PARTITION BY c.doc_id, c.sentence ORDER BY k) AS again FROM claimed c WHERE NOT EXISTS (SELECT 1 FROM vague v WHERE v.doc_id = c.doc_id AND v.text = c.sentence)),
open_claims AS (SELECT l.doc_id, row_number() OVER (PARTITION BY l.doc_id ORDER BY k) AS place, strpos(text, sentence) - 1 AS low, sentence FROM lone l JOIN src ON src.doc_id = l.doc_id WHERE again = 1 OR length(sentence) > 220),
ev AS (SELECT * FROM listed
  UNION ALL SELECT doc_id, 'burstiness', row_number() OVER (PARTITION BY doc_id ORDER BY s), 'uniform sentence run', low, high, 'Sentence lengths [' || array_to_string(w, ', ') || ']' FROM runs
  UNION ALL SELECT doc_id, 'specificity', place, 'unanchored claim', low, high, text FROM vague
  UNION ALL SELECT o.doc_id, 'specificity', o.place + coalesce(n, 0), 'claim without recognized citation', low, low + length(sentence), substring(sentence, 1, 220)
    FROM open_claims o LEFT JOIN (SELECT doc_id, count(*) AS n FROM vague GROUP BY doc_id) v ON v.doc_id = o.doc_id)"""


def span_evidence() -> str:
    wording = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SUGGESTED.items())
    return f"""WITH {evidence_ctes()}
SELECT doc_id, category, CAST(place AS BIGINT) AS place, kind, CAST(low AS BIGINT) AS start_offset, CAST(high AS BIGINT) AS end_offset, text,
  CASE WHEN category = 'predictability' THEN CASE lower(text) {wording} END END AS suggestion FROM ev"""


def flagged_sentences() -> str:
    label = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " END"
    return f"""WITH {evidence_ctes()}
SELECT s.doc_id, CAST(s.low AS BIGINT) AS start_offset, CAST(s.high AS BIGINT) AS end_offset, CAST(any_value(s.words) AS BIGINT) AS words, string_agg(DISTINCT {label}, '; ' ORDER BY {label}) AS reasons
FROM sents s JOIN ev e ON s.doc_id = e.doc_id AND e.low < s.high AND e.high > s.low AND e.high > e.low AND e.place <= {SHOWN} AND e.category <> 'provenance' GROUP BY s.doc_id, s.low, s.high"""


def cleanup_edits(most: int = 12) -> str:
    """Edits offered and refused, and their places; of overlapping ones the first, at one place the longest, is made."""
    from inkspan.operators.revision import PROTECTED

    wording = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SUGGESTED.items())
    found = " UNION ALL ".join(spans(ci(rf"\b{m}\b"), m, 0, m) for m in SUGGESTED)
    short = {k: p.replace('[^"”\\n]{1,2000}', '[^"”\\n]{1,1000}[^"”\\n]{0,1000}') for k, p in PROTECTED.items()}  # no repetition beyond 1000 here
    kept = " UNION ALL ".join(spans(p, k, 0, k) for k, p in short.items())
    return f"""WITH src AS ({_source(D)}), marks AS ({found}), kept AS ({kept}),
few AS (SELECT doc_id, kind, low, high, CASE kind {wording} END AS new FROM marks QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY low, high, kind) <= {most}),
edits AS (SELECT f.*, EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = f.doc_id AND k.low < f.high AND k.high > f.low) AS inside FROM few f WHERE new NOT LIKE '(%')
SELECT src.doc_id, CAST(count(*) FILTER (WHERE NOT inside) AS BIGINT) AS edits, CAST(count(*) FILTER (WHERE inside) AS BIGINT) AS refused,
  coalesce(string_agg(low || '-' || high || ':' || new, ',' ORDER BY low, high, kind) FILTER (WHERE NOT inside), '') AS places FROM src LEFT JOIN edits ON src.doc_id = edits.doc_id GROUP BY src.doc_id"""
