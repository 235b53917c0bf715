"""Vectors, drafts, analytics tables and interval plans."""

from __future__ import annotations

from inkspan.functions.text import MARK, MATCH_WORD, PLAIN_WORD, checker_words, marked_sentences, match_words, trimmed
from inkspan.plans.textstats import big, dbl

# Words of little weight in term-frequency cosines.
LIGHT = "a an the and or but if then of in on at to for from by with as is are was were be been this that these those it its".split()
#: Queries of the top-k plans: every id divisible by this; they meet all rows.
QUERY_STEP = 50


def embedding_topk(d, k: int = 5) -> str:
    """The most similar vectors of each query vector by cosine in percent; ties to the smaller id. Oracle of the blockwise query."""
    norm = f"sqrt({d.dot('embedding', 'embedding')})"
    return f"""WITH v AS (SELECT vec_id, embedding, {norm} AS norm FROM embeddings),
q AS (SELECT vec_id AS query_id, embedding AS qe, norm AS qn FROM v WHERE vec_id % {QUERY_STEP} = 0),
s AS (SELECT q.query_id, v.vec_id, round(greatest(0, least(100, {d.dot("q.qe", "v.embedding")} / (q.qn * v.norm) * 100)), 2) AS similarity FROM q JOIN v ON q.query_id <> v.vec_id)
SELECT query_id, vec_id, similarity, {big("place")} AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS place FROM s) r WHERE place <= {k}"""


def term_counts(d, table: str, key: str) -> str:
    """Weighted term counts of a table's texts."""
    light = ", ".join(f"'{w}'" for w in LIGHT)
    return f"""SELECT {key} AS id, word, count(*) * CASE WHEN word IN ({light}) THEN {dbl("0.4")} ELSE {dbl("1.0")} END AS n
  FROM {d.each(table, checker_words(d), "i", "word")} GROUP BY {key}, word"""


def _tf(d) -> str:
    """Weighted term counts of documents and of the corpus, with norms."""
    part = lambda name, key, table: f"""{name}c AS ({term_counts(d, table, key)}),
{name}n AS (SELECT id, sqrt(sum(n * n)) AS norm FROM {name}c GROUP BY id)"""  # noqa: E731
    return part("d", "doc_id", "documents") + ",\n" + part("b", "item_id", "benchmark")


def tf_cosine(d) -> str:
    """The corpus item of each document with the nearest term vector; ties to the smaller id. Oracle of the blockwise query."""
    return f"""WITH {_tf(d)},
s AS (SELECT dc.id AS doc_id, bc.id AS item_id, sum(dc.n * bc.n) AS dot FROM dc JOIN bc ON dc.word = bc.word GROUP BY dc.id, bc.id),
r AS (SELECT s.doc_id, s.item_id, round(100 * s.dot / (dn.norm * bn.norm), 1) AS similarity FROM s JOIN dn ON s.doc_id = dn.id JOIN bn ON s.item_id = bn.id)
SELECT doc_id, item_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, item_id) AS place FROM r) t WHERE place = 1"""


def word_dice(d) -> str:
    """Dice coefficient of the distinct words of corpus items and documents that share at least half an item's words."""
    return f"""WITH a AS (SELECT DISTINCT doc_id, word FROM {d.each("documents", match_words(d), "i", "word")}),
b AS (SELECT DISTINCT item_id, word FROM {d.each("benchmark", match_words(d), "i", "word")}),
an AS (SELECT doc_id, count(*) AS n FROM a GROUP BY doc_id), bn AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*) AS both_n FROM a JOIN b ON a.word = b.word GROUP BY doc_id, item_id)
SELECT s.doc_id, s.item_id, round({dbl("2.0")} * s.both_n / (an.n + bn.n), 4) AS dice FROM s JOIN an ON s.doc_id = an.doc_id JOIN bn ON s.item_id = bn.item_id WHERE 2 * s.both_n >= bn.n"""


def _drafts(d) -> str:
    """Two drafts of each document: its text, and its text without the sentences whose length is divisible by three, with one more."""
    sentences = d.each("documents", marked_sentences(d), "s", "piece")
    clean = trimmed(d, "piece")
    normal = trimmed(d, d.replace(f"lower({clean})", r"[^\p{L}\p{N}_]+", " "))
    return f"""one AS (SELECT doc_id, s, {clean} AS sentence, {normal} AS norm FROM {sentences} WHERE length({clean}) > 3),
two AS (SELECT doc_id, s, sentence, norm FROM one WHERE length(sentence) % 3 <> 0 UNION ALL SELECT doc_id, 1000000 AS s, 'One added sentence.' AS sentence, 'one added sentence' AS norm FROM documents)"""


def draft_diff(d) -> str:
    """Unchanged, added and deleted sentences between two drafts by normalised text, and the share kept."""
    return f"""WITH {_drafts(d)},
k1 AS (SELECT DISTINCT doc_id, norm FROM one), k2 AS (SELECT DISTINCT doc_id, norm FROM two),
n2 AS (SELECT t.doc_id, count(*) AS n, sum(CASE WHEN k1.norm IS NULL THEN 1 ELSE 0 END) AS added FROM two t LEFT JOIN k1 ON t.doc_id = k1.doc_id AND t.norm = k1.norm GROUP BY t.doc_id),
n1 AS (SELECT t.doc_id, count(*) AS n, sum(CASE WHEN k2.norm IS NULL THEN 1 ELSE 0 END) AS deleted FROM one t LEFT JOIN k2 ON t.doc_id = k2.doc_id AND t.norm = k2.norm GROUP BY t.doc_id)
SELECT n2.doc_id, {big("coalesce(n1.n, 0)")} AS sentences_v1, {big("n2.n")} AS sentences_v2, {big("n2.n - n2.added")} AS unchanged, {big("n2.added")} AS added,
  {big("coalesce(n1.deleted, 0)")} AS deleted, {d.round(f'{dbl("100.0")} * (n2.n - n2.added) / n2.n', 1)} AS continuity FROM n2 LEFT JOIN n1 ON n2.doc_id = n1.doc_id"""


def draft_deltas(d) -> str:
    return f"""WITH {_drafts(d)}, a AS (SELECT doc_id, sum({d.count("sentence", MATCH_WORD)}) AS w, count(*) AS n FROM one GROUP BY doc_id),
b AS (SELECT doc_id, sum({d.count("sentence", MATCH_WORD)}) AS w, count(*) AS n FROM two GROUP BY doc_id)
SELECT b.doc_id, {big("b.w - coalesce(a.w, 0)")} AS words_delta, {big("b.n - coalesce(a.n, 0)")} AS sentences_delta FROM b LEFT JOIN a ON a.doc_id = b.doc_id"""


def interval_union(d) -> str:
    """Union of the spans [5 i, 5 i + length) of the i-th words of each document; touching spans are one."""
    words = d.each("documents", match_words(d), "i", "word")
    return f"""WITH spans AS (SELECT doc_id, 5 * i AS low, 5 * i + length(word) AS high FROM {words}),
m AS (SELECT *, max(high) OVER (PARTITION BY doc_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR low > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS part FROM m),
u AS (SELECT doc_id, part, min(low) AS low, max(high) AS high FROM g GROUP BY doc_id, part)
SELECT doc_id, {big("count(*)")} AS unions, {big("sum(high - low)")} AS covered, {big("max(high - low)")} AS longest FROM u GROUP BY doc_id"""


def trailing_events(d, days: int = 30) -> str:
    """Events of the last days before the newest, and of all time, by type."""
    cut = f"(SELECT max(ts) FROM events) - INTERVAL {days} DAY" if d.name != "spark" else f"(SELECT max(ts) FROM events) - INTERVAL '{days}' DAY"
    return f"""SELECT event_type, {big("count(*)")} AS all_time, {big(f"sum(CASE WHEN ts >= {cut} THEN 1 ELSE 0 END)")} AS trailing FROM events GROUP BY event_type"""


def daily_events(d) -> str:
    return f"SELECT CAST(CAST(date_trunc('day', ts) AS DATE) AS {d.text_type}) AS day, event_type, {big('count(*)')} AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"


def subscribers(d) -> str:
    """The first event of each user as a subscription, addresses compared without case, newest first."""
    mail = f"lower({trimmed(d, 'mail')})"
    return f"""WITH m AS (SELECT event_id, ts, ' User' || CAST(user_id AS {d.text_type}) || '@Example.ORG ' AS mail FROM events),
r AS (SELECT {mail} AS email, ts, event_id, row_number() OVER (PARTITION BY {mail} ORDER BY ts, event_id) AS k FROM m),
v AS (SELECT email, ts, event_id FROM r WHERE k = 1 AND {d.like("email", r"^[^\s@]+@[^\s@]+\.[^\s@]+$")} AND length(email) <= 254)
SELECT email, event_id, ts FROM v ORDER BY ts DESC, email"""


def page_text(d) -> str:
    """Text of the pages without scripts, styles, comments and tags."""
    bare = d.replace("html", r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return f"SELECT page_id, url, {trimmed(d, d.replace(d.replace(bare, '(?s)<[^>]*>', ' '), chr(92) + 's+', ' '))} AS text FROM pages"


def html_escaped(d) -> str:
    return "SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;') AS html FROM documents"


def source_list(d) -> str:
    """The corpus by name, with counts and a preview."""
    return f"""SELECT item_id, substring({d.replace("text", r"\n", " ")}, 1, 160) AS preview, {big(d.count("text", MATCH_WORD))} AS words,
  {big("length(text)")} AS characters FROM benchmark ORDER BY item_id"""


def search_phrases(d, most: int = 8, words: int = 12) -> str:
    """Up to eight evenly spaced opening phrases of a text's sentences, different but for case.

    Sentences have more than 35 characters and six words, phrases more than 25
    characters; labels like "Abstract:" and marks at the ends are cut off.
    """
    ended = d.replace("text", r"([.!?])\s+", "<1>" + "\x01")
    sentences = d.each("documents", d.split(d.replace(ended, r"\n+", "\x01"), MARK), "s", "piece")
    clean = d.replace(trimmed(d, "piece"), r"(?i)^(title|abstract|introduction|topic|paper|section\s*\d*):\s*", "")
    phrase = d.replace(d.replace(d.join_words(d.head("w", words)), r"^[^\p{L}\p{N}_]+", ""), r"[^\p{L}\p{N}_]+$", "")
    places = ", ".join(f"round({i} * (n - 1) / {most - 1}.0)" for i in range(most))
    return f"""WITH p AS (SELECT doc_id, s, {d.all(clean, PLAIN_WORD)} AS w FROM {sentences} WHERE length({trimmed(d, "piece")}) > 35),
q AS (SELECT doc_id, s, {phrase} AS phrase FROM p WHERE {d.size("w")} >= 6),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(phrase) ORDER BY s) AS again FROM q WHERE length(phrase) > 25),
n AS (SELECT doc_id, phrase, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM u WHERE again = 1)
SELECT doc_id, phrase, {big("k")} AS phrase_no FROM n WHERE n <= {most} OR k IN ({places})"""


PLANS = {
    f.__name__: f
    for f in (
        draft_diff, draft_deltas, interval_union, trailing_events, daily_events, subscribers, page_text,
        html_escaped, source_list, search_phrases,
    )
}
