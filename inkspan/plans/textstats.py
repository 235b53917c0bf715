"""Token, sentence, readability and rhythm measures of whole documents."""

from __future__ import annotations

from inkspan.functions.text import (
    MATCH_WORD, PATTERN_SENTENCE, PATTERN_WORD, PLAIN_WORD, READING_WORD, careful_sentences, checker_words, marked_sentences, match_words, trimmed,
)

D = "CAST({} AS DOUBLE)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def aliased(source: str) -> str:
    """A table or a bracketed SELECT, named t."""
    return source if source.endswith(" t") else f"{source} t"


def token_stats(d) -> str:
    """Words of a document by each of the tokenizers."""
    return f"""SELECT doc_id, {big(d.count("text", MATCH_WORD))} AS match_words, {big(d.size(checker_words(d)))} AS checker_words,
  {big(d.count("lower(text)", PATTERN_WORD))} AS pattern_words, {big(d.count("text", PATTERN_WORD))} AS style_words,
  {big(d.count("text", READING_WORD))} AS reading_words, {big(d.count("text", PLAIN_WORD))} AS plain_words,
  {big(d.distinct_size(match_words(d)))} AS distinct_words FROM documents"""


def sentence_stats(d) -> str:
    """Sentences of a document by each of the splitters, and paragraphs."""
    marked = d.each("documents", marked_sentences(d), "s", "piece")
    careful = d.each("documents", careful_sentences(d), "s", "piece")
    found = d.each("documents", d.all("text", PATTERN_SENTENCE), "s", "piece")
    plain = d.each("documents", d.split("text", "[.!?]+"), "s", "piece")
    paragraphs = d.each("documents", d.split("text", r"\n\s*\n"), "s", "piece")
    size = f"length({trimmed(d, 'piece')})"
    return f"""WITH m AS (SELECT doc_id, sum(CASE WHEN {size} > 3 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN {size} > 5 THEN 1 ELSE 0 END) AS b FROM {marked} GROUP BY doc_id),
c AS (SELECT doc_id, sum(CASE WHEN {size} > 0 THEN 1 ELSE 0 END) AS n FROM {careful} GROUP BY doc_id),
p AS (SELECT doc_id, sum(CASE WHEN {size} >= 4 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN {size} > 0 THEN 1 ELSE 0 END) AS b FROM {found} GROUP BY doc_id),
r AS (SELECT doc_id, sum(CASE WHEN {size} > 0 THEN 1 ELSE 0 END) AS n FROM {plain} GROUP BY doc_id),
g AS (SELECT doc_id, sum(CASE WHEN {size} > 0 THEN 1 ELSE 0 END) AS n FROM {paragraphs} GROUP BY doc_id)
SELECT t.doc_id, {big("coalesce(c.n, 0)")} AS careful_sentences, {big("coalesce(m.a, 0)")} AS checker_sentences, {big("coalesce(m.b, 0)")} AS vector_sentences,
  {big("coalesce(p.a, 0)")} AS pattern_sentences, {big("coalesce(p.b, 0)")} AS style_sentences, {big("coalesce(r.n, 0)")} AS reading_sentences, {big("coalesce(g.n, 0)")} AS paragraphs
FROM documents t LEFT JOIN c ON t.doc_id = c.doc_id LEFT JOIN m ON t.doc_id = m.doc_id LEFT JOIN p ON t.doc_id = p.doc_id
  LEFT JOIN r ON t.doc_id = r.doc_id LEFT JOIN g ON t.doc_id = g.doc_id"""


def syllables(d, word: str) -> str:
    """Vowel groups, without a last silent e, at least one."""
    groups = d.count(word, "[aeiouy]+")
    silent = f"CASE WHEN {d.like(word, 'e$')} AND NOT ({d.like(word, 'le$')}) AND {groups} > 1 THEN 1 ELSE 0 END"
    return f"greatest(1, {groups} - {silent})"


def readability(d) -> str:
    words = d.each("documents", d.all("text", READING_WORD), "i", "word")
    sentences = d.each("documents", d.split("text", "[.!?]+"), "s", "piece")
    return f"""WITH w AS (SELECT doc_id, count(*) AS words, sum({syllables(d, "lower(word)")}) AS syllables FROM {words} GROUP BY doc_id),
s AS (SELECT doc_id, sum(CASE WHEN length({trimmed(d, "piece")}) > 0 THEN 1 ELSE 0 END) AS sentences FROM {sentences} GROUP BY doc_id),
m AS (
  SELECT t.doc_id, w.words, w.syllables, {dbl("w.words")} / greatest(1, s.sentences) AS asl, {dbl("w.syllables")} / w.words AS asw
  FROM documents t LEFT JOIN w ON t.doc_id = w.doc_id LEFT JOIN s ON t.doc_id = s.doc_id
),
f AS (
  SELECT doc_id, coalesce(words, 0) AS words, coalesce(syllables, 0) AS syllables, asl,
    CASE WHEN words IS NULL THEN {dbl("100.0")} ELSE {d.round(f'greatest({dbl("0")}, least({dbl("100")}, {dbl("206.835")} - {dbl("1.015")} * asl - {dbl("84.6")} * asw))', 1)} END AS ease,
    CASE WHEN words IS NULL THEN NULL ELSE {d.round(f'greatest({dbl("1")}, {dbl("0.39")} * asl + {dbl("11.8")} * asw - {dbl("15.59")})', 1)} END AS grade FROM m
)
SELECT doc_id, {big("words")} AS words, {big("syllables")} AS syllables, ease AS flesch_reading_ease, grade AS fk_grade_level,
  CASE WHEN ease >= 80 THEN 'Very easy' WHEN ease >= 60 THEN 'Standard' WHEN ease >= 40 THEN 'Fairly difficult' WHEN ease >= 20 THEN 'Difficult' ELSE 'Very complex' END AS reading_ease,
  CASE WHEN grade IS NULL OR grade <= 5 THEN 'Elementary school' WHEN grade <= 8 THEN 'Middle school' WHEN grade <= 12 THEN 'High school'
    WHEN grade <= 14 THEN 'Late high school / early college' WHEN grade <= 16 THEN 'College' ELSE 'Advanced college' END AS reading_level,
  CASE WHEN words = 0 THEN {dbl("0.0")} ELSE greatest({dbl("0.1")}, {d.round(f'{dbl("words")} / {dbl("220.0")}', 1)}) END AS reading_time_minutes FROM f"""


def _lengths(d, source: str) -> str:
    """Sentences of at least four characters in order, with their words."""
    found = d.each(source, d.all("text", PATTERN_SENTENCE), "s", "piece")
    return f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS n, {d.count("lower(piece)", PATTERN_WORD)} AS len
FROM {found} WHERE length({trimmed(d, "piece")}) >= 4"""


def burstiness(d, source: str = "documents") -> str:
    """Coefficient of variation of sentence lengths, at most 100; 50 for fewer than two sentences."""
    return f"""WITH l AS ({_lengths(d, source)}),
v AS (SELECT doc_id, count(*) AS n, avg({dbl("len")}) AS mean, stddev_pop({dbl("len")}) AS sd FROM l GROUP BY doc_id)
SELECT t.doc_id, {big("coalesce(v.n, 0)")} AS sentences,
  CASE WHEN coalesce(v.n, 0) < 2 THEN {dbl("50.0")} WHEN v.mean = 0 THEN {dbl("0.0")} ELSE {d.round(f'least({dbl("100.0")}, v.sd / v.mean * 100)', 2)} END AS burstiness
FROM {aliased(source)} LEFT JOIN v ON t.doc_id = v.doc_id"""


def uniform_runs(d, source: str = "documents") -> str:
    """Runs of three sentences whose lengths are within five words of each other, none under eight words."""
    frame = "OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)"
    return f"""SELECT doc_id, {big("count(*)")} AS uniform_runs, {big("min(n)")} AS first_sentence FROM (
  SELECT doc_id, n, max(len) {frame} AS high, min(len) {frame} AS low, count(*) {frame} AS wide FROM ({_lengths(d, source)}) l
) r WHERE wide = 3 AND high - low <= 5 AND low >= 8 GROUP BY doc_id"""


def rhythm_score(d, source: str = "documents") -> str:
    return f"""SELECT b.doc_id, b.sentences, b.burstiness, coalesce(u.uniform_runs, 0) AS uniform_runs,
  {big("CASE WHEN b.sentences < 5 THEN 0 WHEN b.burstiness < 18 OR coalesce(u.uniform_runs, 0) >= 3 THEN 3 WHEN b.burstiness < 27 OR coalesce(u.uniform_runs, 0) >= 2 THEN 2 WHEN b.burstiness < 35 OR coalesce(u.uniform_runs, 0) = 1 THEN 1 ELSE 0 END")} AS score
FROM ({burstiness(d, source)}) b LEFT JOIN ({uniform_runs(d, source)}) u ON b.doc_id = u.doc_id"""


def lexical_stats(d) -> str:
    """Distinct share of the words and their normalised entropy."""
    words = d.each("documents", d.all("lower(text)", PATTERN_WORD), "i", "word")
    return f"""WITH c AS (SELECT doc_id, word, count(*) AS n FROM {words} GROUP BY doc_id, word),
t AS (SELECT doc_id, sum(n) AS total, count(*) AS kinds, sum(n * log2({dbl("n")})) AS s FROM c GROUP BY doc_id)
SELECT a.doc_id, CASE WHEN t.total IS NULL THEN {dbl("0.0")} ELSE {d.round(f'{dbl("t.kinds")} / t.total * 100', 2)} END AS lexical_diversity,
  CASE WHEN t.total IS NULL THEN {dbl("0.0")} ELSE {d.round(f'(log2({dbl("t.total")}) - t.s / t.total) / CASE WHEN t.kinds > 1 THEN log2({dbl("t.kinds")}) ELSE 1 END * 100', 2)} END AS entropy
FROM documents a LEFT JOIN t ON a.doc_id = t.doc_id"""


def quotations(d) -> str:
    """Quotations of more than ten characters."""
    quote = "\"[^\"\\n]+\"|“[^”]+”|«[^»]+»"
    found = d.each("documents", d.all("text", quote), "q", "quote")
    return f"SELECT doc_id, {big('q')} AS quote_no, quote, {big(d.count('quote', MATCH_WORD))} AS words FROM {found} WHERE length(quote) > 12"


def term_frequencies(d) -> str:
    """Each checker word of each document and its count."""
    words = d.each("documents", checker_words(d), "i", "word")
    return f"SELECT doc_id, word, {big('count(*)')} AS n FROM {words} GROUP BY doc_id, word"


def shingle_counts(d) -> str:
    """Distinct four-word shingles of checker words; a shorter text is one."""
    grams = " || ' ' || ".join(d.at("w", f"i + {k}" if k else "i") for k in range(4))
    if d.name == "spark":  # told in each text's own row
        return f"""SELECT doc_id, {big(f"CASE WHEN size(w) = 0 THEN 0 WHEN size(w) < 4 THEN 1 ELSE coalesce(size(array_distinct(transform(sequence(0, size(w) - 4), i -> {grams}))), 1) END")} AS shingles
FROM (SELECT doc_id, {checker_words(d)} AS w FROM documents) t"""
    rows = d.numbers("t", "0", f"{d.size('w')} - 3", "i")
    return f"""WITH t AS (SELECT doc_id, {checker_words(d)} AS w FROM documents),
g AS (SELECT doc_id, count(DISTINCT {grams}) AS n FROM {rows} GROUP BY doc_id)
SELECT t.doc_id, {big(f"CASE WHEN {d.size('w')} = 0 THEN 0 ELSE coalesce(g.n, 1) END")} AS shingles FROM t LEFT JOIN g ON t.doc_id = g.doc_id"""


def limit_violations(d) -> str:
    """Whether a text is within 100,000 characters and its passages within 500 words."""
    pieces = d.each("documents", marked_sentences(d), "s", "piece")
    return f"""WITH p AS (SELECT doc_id, max({d.count("piece", PLAIN_WORD)}) AS longest FROM {pieces} GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN length(t.text) > 100000 THEN 'document too long' WHEN p.longest > 500 THEN 'passage too long' END AS error
FROM documents t LEFT JOIN p ON t.doc_id = p.doc_id"""


def exact_duplicates(d) -> str:
    """Documents whose text, without punctuation and case, stands under a smaller doc_id, which they point to."""
    normal = trimmed(d, d.replace("lower(text)", r"[^\p{L}\p{N}_]+", " "))
    return f"""SELECT doc_id, first_id FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY {d.sha(normal)}) AS first_id FROM documents) r WHERE doc_id > first_id"""


def digests(d) -> str:
    return f"""SELECT doc_id, {d.sha("text")} AS sha256, substring(text, 1, 500) AS head, substring(text, greatest(1, length(text) - 499), 500) AS tail FROM documents"""


def language_coverage(d) -> str:
    """Share of ASCII letters among all letters; English rules fully apply from 0.85."""
    return f"""SELECT doc_id, {d.round(f'{dbl(d.count("text", "[A-Za-z]"))} / greatest(1, {d.count("text", r"\p{L}")})', 3)} AS english_share,
  CASE WHEN {dbl(d.count("text", "[A-Za-z]"))} / greatest(1, {d.count("text", r"\p{L}")}) >= 0.85 THEN 'standard' ELSE 'limited' END AS coverage FROM documents"""


PLANS = {
    f.__name__: f
    for f in (
        token_stats, sentence_stats, readability, burstiness, uniform_runs, rhythm_score, lexical_stats, quotations, term_frequencies, shingle_counts,
        limit_violations, exact_duplicates, digests, language_coverage,
    )
}
