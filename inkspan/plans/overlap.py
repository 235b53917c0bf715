"""Exact-passage overlap of documents with a corpus.

Windows of four words meet by equality. Windows on one diagonal (document
position less source position) that follow one another form an island, which is
a maximal equal run; islands need a window with two words outside COMMON. At
each such window the longest run of a source counts, of equal ones that with
the least source position. Coverage is the union of the counting runs.

The windows are cut inside each document's word array and only those that occur
in the corpus leave it, so the documents' words are never shuffled.
"""

from __future__ import annotations

from inkspan.functions.text import MATCH_WORD, careful_sentences, match_words

# Words that alone don't make a window count.
COMMON = "a an the and or but if then of in on at to for from by with as is are was were be been this that these those it its we our they their".split()

#: Quotations of three kinds.
QUOTE = "\"[^\"\\n]+\"|“[^”]+”|«[^»]+»"
#: Risk bands by overall similarity.
LOW, MEDIUM = 15, 40


def _grams(d, source: str, key: str, at: str, judged: bool) -> str:
    w = [d.at("w", f"{at} + {k}" if k else at) for k in range(4)]
    common = ", ".join(f"'{c}'" for c in COMMON)
    eligible = " + ".join(f"CASE WHEN {x} IN ({common}) THEN 0 ELSE 1 END" for x in w)
    text = " || ' ' || ".join(w)
    table = d.numbers(source, "0", f"{d.size('w')} - 3", at)
    return f"SELECT {key}, {at}, {text} AS gram{f', ({eligible}) >= 2 AS eligible' if judged else ''} FROM {table}"


def document_windows(d, docs: str = "documents") -> str:
    """Windows of the documents: doc_id, i, gram."""
    return f"WITH dw AS (SELECT doc_id, {match_words(d)} AS w FROM {docs}) {_grams(d, 'dw', 'doc_id', 'i', False)}"


def corpus_windows(d) -> str:
    """Windows of the corpus: src, j, gram, eligible."""
    return f"WITH cw AS (SELECT item_id AS src, {match_words(d)} AS w FROM benchmark) {_grams(d, 'cw', 'src', 'j', True)}"


def coverage(d, docs: str = "documents", hits: str = "") -> str:
    """CTEs up to `cover`: the covered word positions k of each document and source, with their source position. hits: a table of equal windows, if they were found elsewhere."""
    found = f"""dg AS ({_grams(d, "dw", "doc_id", "i", False)}),
cg AS ({_grams(d, "cw", "src", "j", True)}),
hits AS (SELECT dg.doc_id, cg.src, dg.i, cg.j, dg.i - cg.j AS diag, cg.eligible FROM dg JOIN cg ON dg.gram = cg.gram),"""
    return f"""
dw AS (SELECT doc_id, {match_words(d)} AS w FROM {docs}),
cw AS (SELECT item_id AS src, {match_words(d)} AS w FROM benchmark),
{f"hits AS (SELECT doc_id, src, i, j, i - j AS diag, eligible FROM {hits})," if hits else found}
kept AS (
  SELECT * FROM (SELECT *, max(CASE WHEN eligible THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, src, diag) AS good FROM hits) h WHERE good = 1
),
island AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, src, diag ORDER BY i) AS grp FROM kept),
run AS (
  SELECT doc_id, src, diag, i, j, eligible, min(i) OVER (PARTITION BY doc_id, src, diag, grp) AS low, max(i) OVER (PARTITION BY doc_id, src, diag, grp) + 4 AS high FROM island
),
ranked AS (
  SELECT doc_id, src, diag, i, low, high, row_number() OVER (PARTITION BY doc_id, src, i ORDER BY high - low DESC, j) AS place FROM run WHERE eligible
),
best AS (SELECT doc_id, src, diag, low, high, min(i) AS first_i FROM ranked WHERE place = 1 GROUP BY doc_id, src, diag, low, high),
spread AS (SELECT doc_id, src, diag, first_i, k FROM {d.numbers("best", "low", "high", "k")}),
cover AS (SELECT doc_id, src, k, {d.min_by("k - diag", "first_i")} AS source_k FROM spread GROUP BY doc_id, src, k)"""


def overlap_scores(d, hits: str = "") -> str:
    return f"""WITH {coverage(d, hits=hits)},
matched AS (SELECT doc_id, count(DISTINCT k) AS n FROM cover GROUP BY doc_id),
total AS (SELECT doc_id, CAST({d.count("text", MATCH_WORD)} AS BIGINT) AS words FROM documents)
SELECT t.doc_id, t.words AS total_words, CAST(coalesce(m.n, 0) AS BIGINT) AS matched_words,
  CASE WHEN t.words = 0 THEN 0.0 ELSE {d.round("CAST(100.0 AS DOUBLE) * coalesce(m.n, 0) / t.words", 2)} END AS overall_similarity,
  CASE WHEN CAST(100.0 AS DOUBLE) * coalesce(m.n, 0) < {LOW} * t.words OR t.words = 0 THEN 'Low Risk'
       WHEN CAST(100.0 AS DOUBLE) * coalesce(m.n, 0) < {MEDIUM} * t.words THEN 'Medium Risk' ELSE 'High Risk' END AS risk
FROM total t LEFT JOIN matched m ON t.doc_id = m.doc_id"""


def overlap_by_source(d) -> str:
    return f"""WITH {coverage(d)},
per AS (SELECT doc_id, src, count(*) AS n FROM cover GROUP BY doc_id, src)
SELECT per.doc_id, per.src AS source_id, CAST(per.n AS BIGINT) AS common_words, CAST({d.size("cw.w")} AS BIGINT) AS source_words,
  {d.round(f'CAST(100.0 AS DOUBLE) * per.n / {d.size("dw.w")}', 2)} AS similarity,
  CAST(row_number() OVER (PARTITION BY per.doc_id ORDER BY per.n DESC, per.src) AS BIGINT) AS place
FROM per JOIN dw ON per.doc_id = dw.doc_id JOIN cw ON per.src = cw.src"""


def source_breakdown(d) -> str:
    """Every source that covers words of a document: its share, its words, and the sentences with a covered word of it, most similar first."""
    sentences = d.each("touched", careful_sentences(d), "s", "sentence")
    return f"""WITH {coverage(d)},
touched AS (SELECT t.doc_id, t.text FROM documents t JOIN (SELECT DISTINCT doc_id FROM cover) c ON t.doc_id = c.doc_id),
sents AS (SELECT doc_id, s, {d.size(match_words(d, "sentence"))} AS n FROM {sentences}),
bounds AS (SELECT doc_id, s, n, sum(n) OVER (PARTITION BY doc_id ORDER BY s) AS high, sum(n) OVER (PARTITION BY doc_id) AS words FROM sents),
slots AS (SELECT doc_id, s, words, k FROM {d.numbers("(SELECT doc_id, s, words, CAST(high - n AS INT) AS low, CAST(high AS INT) AS high FROM bounds WHERE n > 0) b", "low", "high", "k")}),
per AS (SELECT c.doc_id, c.src, max(b.words) AS words, count(*) AS n, count(DISTINCT b.s) AS sentences FROM cover c JOIN slots b ON b.doc_id = c.doc_id AND b.k = c.k GROUP BY c.doc_id, c.src),
shares AS (SELECT per.*, {d.size("cw.w")} AS source_words, {d.round("CAST(100.0 AS DOUBLE) * n / words", 2)} AS similarity FROM per JOIN cw ON per.src = cw.src)
SELECT doc_id, src AS source_id, similarity, CAST(n AS BIGINT) AS common_words, CAST(source_words AS BIGINT) AS source_words, CAST(sentences AS BIGINT) AS matched_sentences,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, src) AS BIGINT) AS place FROM shares"""


def overlap_top_source(d) -> str:
    return f"SELECT doc_id, source_id, common_words, similarity FROM ({overlap_by_source(d)}) t WHERE place = 1"


def overlap_passages(d) -> str:
    return f"""WITH {coverage(d)}, {passages(d)}
SELECT doc_id, src AS source_id, CAST(low AS BIGINT) AS token_start, CAST(high AS BIGINT) AS token_end,
  CAST(source_low AS BIGINT) AS source_token_start, CAST(high - low AS BIGINT) AS word_count FROM passage"""


def passages(d) -> str:
    """CTEs behind `coverage`: the runs of words that cover a document in the order of a source."""
    return """marked AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, src ORDER BY k) AS g1, source_k - k AS g2 FROM cover),
passage AS (SELECT doc_id, src, g1, g2, min(k) AS low, max(k) + 1 AS high, min(source_k) AS source_low FROM marked GROUP BY doc_id, src, g1, g2)"""


def quoted_words(d, docs: str = "documents") -> str:
    """CTEs up to `quoted`: the positions k of the words inside quotations, numbered from the words of the pieces between them."""
    pieces = d.each(docs, d.split("text", QUOTE), "q", "piece")
    return f"""p AS (SELECT doc_id, q, {d.count("piece", MATCH_WORD)} AS np, {d.count(f"coalesce({d.at(d.all('text', QUOTE), 'q')}, '')", MATCH_WORD)} AS nq FROM {pieces}),
s AS (SELECT doc_id, nq, sum(np) OVER (PARTITION BY doc_id ORDER BY q) + coalesce(sum(nq) OVER (PARTITION BY doc_id ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM p),
spans AS (SELECT doc_id, low, low + nq AS high FROM s WHERE nq > 0),
quoted AS (SELECT doc_id, k FROM {d.numbers("spans", "low", "high", "k")})"""


def overlap_sentences(d) -> str:
    """Coverage of each matched sentence, the source that covers most of it, that source's first passage in it, and whether it is quoted or cited.

    Words are numbered by sentence in matched documents only, so that they
    meet the covered words by equality.
    """
    from inkspan.plans.signals import CITATIONS

    sentences = d.each("touched", careful_sentences(d), "s", "sentence")
    cite = "coalesce(" + ", ".join(f"nullif({d.first('sentence', p)}, '')" for p in CITATIONS.values()) + ", '')"
    return f"""WITH {coverage(d)}, {passages(d)},
touched AS (SELECT t.doc_id, t.text FROM documents t JOIN (SELECT DISTINCT doc_id FROM cover) c ON t.doc_id = c.doc_id),
{quoted_words(d, "touched")},
sents AS (SELECT doc_id, s, sentence, {d.size(match_words(d, "sentence"))} AS n FROM {sentences}),
bounds AS (SELECT doc_id, s, sentence, n, sum(n) OVER (PARTITION BY doc_id ORDER BY s) AS high FROM sents),
slots AS (SELECT doc_id, s, k FROM {d.numbers("(SELECT doc_id, s, CAST(high - n AS INT) AS low, CAST(high AS INT) AS high FROM bounds WHERE n > 0) b", "low", "high", "k")}),
inside AS (SELECT b.doc_id, b.s, c.src, c.k FROM slots b JOIN cover c ON b.doc_id = c.doc_id AND c.k = b.k),
per AS (SELECT doc_id, s, src, count(*) AS hits FROM inside GROUP BY doc_id, s, src),
top AS (SELECT doc_id, s, src, row_number() OVER (PARTITION BY doc_id, s ORDER BY hits DESC, src) AS place FROM per),
tot AS (SELECT doc_id, s, count(DISTINCT k) AS matched FROM inside GROUP BY doc_id, s),
said AS (SELECT DISTINCT b.doc_id, b.s FROM slots b JOIN quoted q ON b.doc_id = q.doc_id AND b.k = q.k),
nearest AS (
  SELECT b.doc_id, b.s, b.sentence, b.n, top.src, tot.matched, x.low AS at, x.high - x.low AS words, x.source_low, row_number() OVER (PARTITION BY b.doc_id, b.s ORDER BY x.low, x.high) AS place
  FROM bounds b JOIN top ON b.doc_id = top.doc_id AND b.s = top.s AND top.place = 1 JOIN tot ON b.doc_id = tot.doc_id AND b.s = tot.s
  JOIN passage x ON b.doc_id = x.doc_id AND x.src = top.src AND x.low < b.high AND x.high > b.high - b.n
)
SELECT t.doc_id, CAST(t.s AS BIGINT) AS sentence_no, CAST(t.n AS BIGINT) AS words, CAST(t.matched AS BIGINT) AS matched_words,
  {d.round("CAST(100.0 AS DOUBLE) * t.matched / t.n", 2)} AS similarity, t.src AS source_id, t.sentence, {cite} AS citation, said.doc_id IS NOT NULL AS is_quoted,
  CAST(t.at AS BIGINT) AS passage_start, CAST(t.words AS BIGINT) AS passage_words, CAST(t.source_low AS BIGINT) AS source_start
FROM nearest t LEFT JOIN said ON t.doc_id = said.doc_id AND t.s = said.s WHERE t.place = 1"""


def gradebook(d) -> str:
    """One row a submission, most similar first; empty ones are errors."""
    from inkspan.plans.signals import citation_links, pattern_scores

    p = d.plainly()
    share = f"CASE WHEN o.words = 0 THEN 0.0 ELSE {d.round("CAST(100.0 AS DOUBLE) * matched / o.words", 2)} END"
    part = "CAST(100.0 AS DOUBLE) * matched"
    return f"""WITH {coverage(d)},
counted AS (SELECT doc_id, src, k, count(*) OVER (PARTITION BY doc_id, src) AS n FROM cover),
ranked_sources AS (SELECT doc_id, src, k, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, src) AS place FROM counted),
quoting AS (SELECT doc_id, count(DISTINCT k) AS matched, max(CASE WHEN place = 1 THEN src END) AS source FROM ranked_sources GROUP BY doc_id),
told AS (SELECT doc_id, {d.like("text", "[^ ]")} AS filled, CAST({d.count("text", MATCH_WORD)} AS BIGINT) AS words FROM documents),
o AS (SELECT t.doc_id, t.filled, t.words, coalesce(q.matched, 0) AS matched, q.source FROM told t LEFT JOIN quoting q ON t.doc_id = q.doc_id)
SELECT o.doc_id, CASE WHEN filled THEN 'success' ELSE 'error' END AS status, CASE WHEN filled THEN '' ELSE 'Empty document' END AS error, {share} AS overall_similarity,
  CASE WHEN {part} < {LOW} * o.words OR o.words = 0 THEN 'Low Risk' WHEN {part} < {MEDIUM} * o.words THEN 'Medium Risk' ELSE 'High Risk' END AS risk,
  s.pattern_score, s.pattern_band, source AS highest_matching_source, o.words AS total_words, c.citations
FROM o LEFT JOIN ({pattern_scores(p)}) s ON o.doc_id = s.doc_id LEFT JOIN ({citation_links(p)}) c ON o.doc_id = c.doc_id
ORDER BY overall_similarity DESC, o.doc_id"""


def high_risk(d) -> str:
    """Submissions, mean scores, and how many have a high risk by overlap or by their pattern score."""
    return f"""SELECT CAST(count(*) AS BIGINT) AS submissions, CAST(sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS BIGINT) AS processed,
  {d.round("avg(CASE WHEN status = 'success' THEN overall_similarity END)", 2)} AS average_similarity, {d.round("avg(CASE WHEN status = 'success' THEN pattern_score END)", 2)} AS average_pattern_score,
  CAST(sum(CASE WHEN status = 'success' AND (risk = 'High Risk' OR pattern_score >= 65) THEN 1 ELSE 0 END) AS BIGINT) AS high_risk_submissions FROM ({gradebook(d)}) g"""


def risk_bands(d) -> str:
    return f"""SELECT CAST(count(*) AS BIGINT) AS total, {d.round("coalesce(avg(overall_similarity), 0)", 2)} AS average_similarity,
  CAST(coalesce(sum(CASE WHEN risk = 'High Risk' THEN 1 ELSE 0 END), 0) AS BIGINT) AS high_risk,
  CAST(coalesce(sum(CASE WHEN risk = 'Medium Risk' THEN 1 ELSE 0 END), 0) AS BIGINT) AS medium_risk,
  CAST(coalesce(sum(CASE WHEN risk = 'Low Risk' THEN 1 ELSE 0 END), 0) AS BIGINT) AS low_risk
FROM ({overlap_scores(d)}) o"""


def match_page(d, page: int = 1, size: int = 10, least: int = 4, allowed: tuple[str, ...] = ("lorem", "ipsum", "dolor", "sit", "amet")) -> str:
    """A page of each document's matched sentences with how they are attributed.

    Sentences of fewer words than `least`, and those made of allowed words
    only, are left out.
    """
    listed = ", ".join(f"'{w.lower()}'" for w in allowed)
    words = d.each("rows_of", match_words(d, "sentence"), "i", "word")
    quoted, cited = f"(is_quoted OR {d.like('sentence', '[' + chr(34) + '“”]')})", f"(citation <> '' OR {d.like('sentence', r'[(][^)]*[0-9]{4}[^)]*[)]')})"
    return f"""WITH rows_of AS ({overlap_sentences(d)}),
other AS (SELECT DISTINCT doc_id, sentence_no FROM {words} WHERE word NOT IN ({listed})),
kept AS (SELECT r.*, row_number() OVER (PARTITION BY r.doc_id ORDER BY r.sentence_no) AS place FROM rows_of r JOIN other o ON r.doc_id = o.doc_id AND r.sentence_no = o.sentence_no WHERE r.words >= {least})
SELECT doc_id, CAST(place AS BIGINT) AS place, sentence_no, source_id, similarity, CASE WHEN {quoted} AND {cited} THEN 'properly_attributed' WHEN {cited} THEN 'citation_present_review_wording'
  WHEN {quoted} THEN 'quote_needs_citation' ELSE 'attribution_not_detected' END AS attribution_status FROM kept WHERE place > {(page - 1) * size} AND place <= {page * size}"""


def paraphrase_advice(d) -> str:
    """Advice for each matched sentence by its similarity."""
    return f"""SELECT doc_id, sentence_no, similarity, CASE WHEN similarity >= 80 THEN 'verbatim: synthesize in own words and attribute' WHEN similarity >= 60 THEN 'substantial: invert structure and cite'
  ELSE 'moderate: quote or cite' END AS advice FROM ({overlap_sentences(d)}) s"""


def benchmark_confusion(d) -> str:
    """Token-level confusion of the matcher on made-up cases of known truth, by category.

    A case stands between ten and five words of its own: 30 words of a corpus
    item (verbatim), none (original), or three (short_copy, below the matcher's
    window). Scores are in percent of a case's words.
    """
    own = lambda n: " || ' ' || ".join(f"'zq{k}x' || item_id" for k in range(n))
    kind = "CASE item_id % 3 WHEN 0 THEN 'verbatim' WHEN 1 THEN 'original' ELSE 'short_copy' END"
    return f"""WITH iw AS (SELECT item_id, {match_words(d)} AS w FROM benchmark),
made AS (SELECT item_id, {kind} AS category, CASE item_id % 3 WHEN 0 THEN {d.join_words(d.head("w", 30))} WHEN 1 THEN '' ELSE {d.join_words(d.head("w", 3))} END AS taken,
  CASE item_id % 3 WHEN 0 THEN least(30, {d.size("w")}) WHEN 1 THEN 0 ELSE least(3, {d.size("w")}) END AS n FROM iw),
cases AS (SELECT item_id AS doc_id, category, n, {own(10)} || ' ' || taken || ' ' || {own(5)} AS text FROM made),
{coverage(d, "cases")},
truth AS (SELECT doc_id, k FROM {d.numbers("cases", "10", "CAST(10 + n AS INT)", "k")}),
found AS (SELECT DISTINCT doc_id, k FROM cover),
both_k AS (SELECT coalesce(t.doc_id, f.doc_id) AS doc_id, CASE WHEN t.k IS NOT NULL AND f.k IS NOT NULL THEN 1 ELSE 0 END AS tp, CASE WHEN t.k IS NULL THEN 1 ELSE 0 END AS fp, CASE WHEN f.k IS NULL THEN 1 ELSE 0 END AS fn
  FROM truth t FULL OUTER JOIN found f ON t.doc_id = f.doc_id AND t.k = f.k),
per AS (SELECT c.doc_id, c.category, c.n, {d.size("dw.w")} AS total, coalesce(sum(b.tp), 0) AS tp, coalesce(sum(b.fp), 0) AS fp, coalesce(sum(b.fn), 0) AS fn
  FROM cases c JOIN dw ON c.doc_id = dw.doc_id LEFT JOIN both_k b ON c.doc_id = b.doc_id GROUP BY c.doc_id, c.category, c.n, {d.size("dw.w")}),
s AS (SELECT *, total - tp - fp - fn AS tn, abs({d.round("CAST(100.0 AS DOUBLE) * (tp + fp) / total", 2)} - {d.round("CAST(100.0 AS DOUBLE) * (tp + fn) / total", 2)}) AS error FROM per),
c AS (SELECT category, count(*) AS cases, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS passages,
  sum(CASE WHEN n > 0 AND 2 * tp >= n THEN 1 ELSE 0 END) AS passages_recovered, avg(error) AS mae FROM s GROUP BY category)
SELECT category, CAST(cases AS BIGINT) AS cases, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
  {d.round("CAST(tp AS DOUBLE) / nullif(tp + fp, 0)", 4)} AS token_precision, {d.round("CAST(tp AS DOUBLE) / nullif(tp + fn, 0)", 4)} AS token_recall,
  {d.round("CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0)", 4)} AS token_f1, {d.round("CAST(fp AS DOUBLE) / nullif(fp + tn, 0)", 4)} AS false_positive_rate,
  CAST(passages AS BIGINT) AS passages, {d.round("CAST(passages_recovered AS DOUBLE) / nullif(passages, 0)", 4)} AS passage_recall, {d.round("mae", 2)} AS score_mae FROM c"""


PLANS = {
    "overlap_scores": overlap_scores,
    "overlap_by_source": overlap_by_source,
    "source_breakdown": source_breakdown,
    "overlap_top_source": overlap_top_source,
    "overlap_passages": overlap_passages,
    "overlap_sentences": overlap_sentences,
    "gradebook": gradebook,
    "high_risk": high_risk,
    "paraphrase_advice": paraphrase_advice,
    "risk_bands": risk_bands,
    "match_page": match_page,
    "benchmark_confusion": benchmark_confusion,
}
