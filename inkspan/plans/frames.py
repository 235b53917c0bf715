"""Queries over DataFrame operators; those without SQL are held against brute force in the tests."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkspan.functions.numbers import scaled
from inkspan.functions.scans import matches
from inkspan.functions.text import checker_words, match_words
from inkspan.functions.udfs import common_subsequence, nfkc, sequence_diff
from inkspan.operators import patterns
from inkspan.operators.blocks import block_rows, kept_text, typed_blocks
from inkspan.operators.citations import smart_citation, template_citation
from inkspan.operators.passage_index import PassageIndex
from inkspan.operators.revision import cleanup
from inkspan.operators.set_join import similar_sets, word_set
from inkspan.operators.sparse import products
from inkspan.operators.style_review import category_points, rule_metrics, style_findings, style_review
from inkspan.operators.vectors import hashed_vectors, top_k
from inkspan.plans import evidence, review_sql, signals, tables
from inkspan.plans.dialect import AFTER, BEFORE, BOUNDARY, DUCK, SPARK, spelled_out, views
from inkspan.plans.overlap import corpus_windows, document_windows, overlap_by_source, overlap_scores
from inkspan.plans.signals import _source
from inkspan.plans.tables import QUERY_STEP
from inkspan.sources.readers import markdown_text
from inkspan.sources.shared import shared_folder
from inkspan.sources.tables import read_table
from inkspan.streaming.overlap import windowed_events


#: Addresses given to the corpus items in turn, as the tables have none.
URLS = ("", "https://export.arxiv.org/abs/1", "https://en.wikipedia.org/wiki/X", "https://notarxiv.org/a")


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(views(spark, sf_dir, _source(SPARK)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def hashed_vector_norms(spark, sf_dir):
    """Every document's hashed vector."""
    return hashed_vectors(documents(spark, sf_dir))


def embedding_topk(spark, sf_dir):
    """The five vectors most similar to every vector whose id is divisible by QUERY_STEP."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = top_k(vectors.filter(F.col("vec_id") % QUERY_STEP == 0), vectors, "vec_id", "embedding")
    return found.select("query_id", F.col("id").alias("vec_id"), "similarity", F.col("place").cast("long").alias("place"))


def tf_cosine(spark, sf_dir):
    """The corpus item of each document with the nearest term vector, light words weighing less; ties to the smaller id."""
    texts = lambda name, key: read_table(spark, sf_dir, name).select(F.col(key).alias("id"), "text")
    light = frozenset(tables.LIGHT)
    weigh = lambda words, counts: counts * np.array([0.4 if w in light else 1.0 for w in words])

    def near(dot, left, right):
        cosine = dot / np.maximum(np.sqrt(left[:, None] * right), 1e-300)
        return cosine >= cosine.max(axis=1, keepdims=True) - 0.002  # all that may round to a block's best

    found = products(texts("documents", "doc_id"), texts("benchmark", "item_id"), checker_words(SPARK), weigh, near)
    found = found.withColumn("similarity", scaled(100 * F.col("dot") / (F.sqrt("left_square") * F.sqrt("right_square")), 1))
    best = found.withColumn("place", F.row_number().over(W.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id"))).filter("place = 1")
    return best.select(F.col("left_id").alias("doc_id"), F.col("right_id").alias("item_id"), "similarity")


def word_dice(spark, sf_dir):
    """Dice coefficient of the distinct words of corpus items and documents that share at least half an item's words."""
    texts = lambda name, key: read_table(spark, sf_dir, name).select(F.col(key).alias("id"), "text")
    found = products(texts("documents", "doc_id"), texts("benchmark", "item_id"), match_words(SPARK), lambda words, counts: np.ones(len(counts)), lambda dot, left, right: 2 * dot >= right[None, :])
    dice = scaled(2.0 * F.col("dot") / (F.col("left_square") + F.col("right_square")), 4)
    return found.select(F.col("left_id").alias("doc_id"), F.col("right_id").alias("item_id"), dice.alias("dice"))


def corpus_index(spark: SparkSession, sf_dir: str) -> PassageIndex:
    """The stored index of the corpus of a folder, written once a session."""
    index = PassageIndex(spark, f"inkspan_{zlib.crc32(sf_dir.encode()):08x}")
    if not index.exists():
        index.build(spark.sql(views(spark, sf_dir, corpus_windows(SPARK))), f"{shared_folder(spark)}/{index.name}")
    return index


def indexed_overlap(spark, sf_dir):
    """Overlap of all documents by the stored index of the corpus."""
    hits = corpus_index(spark, sf_dir).hits(spark.sql(views(spark, sf_dir, document_windows(SPARK))))
    name = f"inkspan_hits_{zlib.crc32(sf_dir.encode()):08x}"
    hits.createOrReplaceTempView(name)
    return spark.sql(views(spark, sf_dir, overlap_scores(SPARK, name)))


#: Least Dice similarity, in percent, of sentences that are told.
NEAR_SENTENCES = 60


def similar_sentences(spark, sf_dir):
    """Sentences of documents and of the corpus, of four words or more each, that share many of their words."""
    split = lambda text: F.split(F.regexp_replace(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), r"\n\s*\n", "\u0001"), "\u0001")
    long = lambda rows: rows.filter(F.regexp_count("sentence", F.lit(r"[^\s]+")) >= 4).withColumn("words", word_set(F.col("sentence")))
    drafts = long(documents(spark, sf_dir).select("doc_id", F.posexplode(split(F.col("text"))).alias("sentence_no", "sentence")))
    corpus = long(read_table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(split(F.col("text"))).alias("source_sentence", "sentence")))
    found = similar_sets(drafts, corpus, ["doc_id", "sentence_no"], ["item_id", "source_sentence"], NEAR_SENTENCES)
    return found.select("doc_id", F.col("sentence_no").cast("long"), "item_id", F.col("source_sentence").cast("long"), "shared", "dice")


def document_topk(spark, sf_dir):
    """The five documents most similar to every document whose id is divisible by QUERY_STEP, by hashed vectors."""
    rows = documents(spark, sf_dir).select("doc_id", "text")
    asked = rows.filter(F.col("doc_id") % QUERY_STEP == 0)
    return top_k(hashed_vectors(asked), hashed_vectors(rows), "doc_id", "vector", counts=(asked.count(), rows.count()))


def span_evidence(spark, sf_dir):
    """Evidence of all nine categories and provenance marks, with offsets, kinds and suggestions."""
    return patterns.evidence(injected(spark, sf_dir))


def flagged_sentences(spark, sf_dir):
    """Sentences that overlap shown evidence of some category, with the labels of those."""
    return patterns.flagged_sentences(injected(spark, sf_dir))


def closest_passages(spark, sf_dir):
    """For each of the first 50 sentences of a document and each source that it quotes, the nearest of the source's first 100 sentences by hashed vectors.

    Sentences meet by document and source only; ties go to the earlier sentence.
    """
    pieces = lambda text: F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.length(F.trim(s)) > 5)
    cited = spark.sql(views(spark, sf_dir, overlap_by_source(SPARK))).select("doc_id", F.col("source_id").alias("item_id"))
    drafts = documents(spark, sf_dir).join(cited.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.posexplode(F.slice(pieces("text"), 1, 50)).alias("n", "sentence"))
    corpus = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.posexplode(F.slice(pieces("text"), 1, 100)).alias("m", "sentence"))
    vectors = lambda rows, keys: hashed_vectors(rows.withColumn("key", F.struct(*keys)), "key", "sentence").select("key.*", "vector")
    drafts, corpus = vectors(drafts, ["doc_id", "n"]), vectors(corpus, ["item_id", "m"]).withColumnRenamed("vector", "other")
    dot = F.aggregate(F.zip_with("vector", "other", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = drafts.join(cited, "doc_id").join(corpus, "item_id").withColumn("similarity", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * dot)), 2))
    best = pairs.groupBy("doc_id", "item_id", "n").agg(F.max(F.struct("similarity", (-F.col("m")).alias("m"))).alias("best"))
    return best.select("doc_id", F.col("n").alias("sentence_no"), "item_id", (-F.col("best.m")).alias("source_sentence"), "best.similarity")


def cleanup_edits(spark, sf_dir):
    """Edits offered and refused, and their places and wordings."""
    place = lambda e: F.concat(e["start"].cast("string"), F.lit("-"), e["end"].cast("string"), F.lit(":"), e["replacement"])
    rows = cleanup(injected(spark, sf_dir))
    return rows.select("doc_id", F.size("edits").cast("long").alias("edits"), F.size("refused").cast("long").alias("refused"), F.array_join(F.transform("edits", place), ",").alias("places"))


def normalized_text(spark, sf_dir):
    return injected(spark, sf_dir).select("doc_id", F.sha2(nfkc(F.col("text")), 256).alias("nfkc_sha256"))


def draft_sequence(spark, sf_dir):
    """Ordered comparison of each document with itself without every third sentence."""
    pieces = F.filter(F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.length(F.trim(s)) > 3)
    rows = documents(spark, sf_dir).select("doc_id", pieces.alias("a")).withColumn("b", F.filter("a", lambda s, i: i % 3 != 2))
    return rows.select("doc_id", sequence_diff(F.col("a"), F.col("b")).alias("d")).select("doc_id", "d.*")


def common_words(spark, sf_dir):
    """Longest common word subsequence of each document's first and second halves."""
    words = F.split(F.trim("text"), r"\s+")
    rows = documents(spark, sf_dir).select("doc_id", words.alias("w")).withColumn("h", F.floor(F.size("w") / 2).cast("int"))
    return rows.select("doc_id", common_subsequence(F.slice("w", F.lit(1), F.col("h")), F.slice("w", F.col("h") + 1, F.col("h"))).alias("length"))


def markdown_documents(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", markdown_text(F.concat(F.lit("# Title\n**bold** [link](http://x) "), "text")).alias("text"))


def event_windows(spark, sf_dir):
    """Daily counts by the streaming plan, run in batch."""
    return windowed_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def smart_citations(spark, sf_dir):
    """Ready-made citations of corpus items by name and address; addresses are made up by id."""
    name = F.format_string("item_%d-notes.txt", F.col("item_id").cast("long"))
    url = F.element_at(F.array(*(F.lit(u) for u in URLS)), (F.col("item_id") % len(URLS) + 1).cast("int"))
    corpus = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return corpus.select("item_id", smart_citation(name, url).alias("c")).select("item_id", "c.*")


def template_citations(spark, sf_dir):
    """Templates for corpus items that nobody looked up."""
    corpus = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return corpus.select("item_id", template_citation(F.format_string(" unknown item_%d ", F.col("item_id").cast("long"))).alias("c")).select("item_id", "c.*")


#: What stands before and behind the injected texts, by id, so that they have headings, lists, quotations, code, formulas, references and appendices.
WRAPPED = (
    ("md", "# Robust title\n\n### Deep part\n\n> It was said: robust, robust.\n\n- a robust item\n\n", "\n\n## References\n\nFurthermore, a robust book.\n\n```\nrobust code\n\nmore of it ``` end\n\nAppendix, a list"),
    ("md", "```py\nrobust = 1\n\n\nprint(robust)\n```\n\n  1. first \n\n", "\n \n\nAppendix A\n\nMore on it."),
    ("txt", "# no heading here\n\n```\nplain\n\n* item — one\n\n", "\n\nBibliography:\n\nA, B.\n\n\n\n> C, D."),
    ("tex", "[Mathematical Formula]\n\n2) second\n\n", "\n\nWorks Cited\n\n[Mathematical Formula]\n\nappendices"),
    ("ipynb", "Intro.\n\n> quoted\n\n", "\n\nHere [Mathematical Formula] too.\n\nReferenced work, not a header"),
)


def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, format and text: injected texts, their lines as blocks, as extracted from files of several formats."""
    pick = lambda n: F.get(F.array(*(F.lit(w[n]) for w in WRAPPED)), (F.col("doc_id") % len(WRAPPED)).cast("int"))
    return injected(spark, sf_dir).select("doc_id", pick(0).alias("format"), F.concat(pick(1), F.replace("text", F.lit("\n"), F.lit("\n\n")), pick(2)).alias("text"))


def _wrapped_sql() -> str:
    pick = lambda n: "CASE doc_id % " + str(len(WRAPPED)) + " " + " ".join(f"WHEN {k} THEN '{w[n]}'".replace("\n", "' || chr(10) || '") for k, w in enumerate(WRAPPED)) + " END"
    return f"SELECT doc_id, {pick(0)} AS format, {pick(1)} || replace(text, chr(10), chr(10) || chr(10)) || {pick(2)} AS text FROM ({_source(DUCK)})"


def typed_block_rows(spark, sf_dir):
    """Typed blocks of texts of all formats, with their places in the source and in the joined text; cut out of the source, not copied."""
    docs = wrapped(spark, sf_dir)
    rows = block_rows(docs, typed_blocks(F.col("text"), F.col("format")))
    return rows.select("doc_id", F.col("block_no").cast("long"), "kind", F.sha2("text", 256).alias("text_sha256"), "heading_level", *(F.col(c).cast("long").alias(c) for c in ("source_start", "source_end", "start", "end")))


def block_types(spark, sf_dir):
    """Size and type of each block."""
    rows = block_rows(wrapped(spark, sf_dir), typed_blocks(F.col("text"), F.col("format")))
    return rows.select("doc_id", F.col("block_no").cast("long"), F.length("text").cast("long").alias("characters"), F.col("kind").alias("block_type"))


def section_words(spark, sf_dir):
    """Blocks and characters by type, and whether they are scored."""
    rows = block_types(spark, sf_dir).groupBy("doc_id", "block_type").agg(F.count("*").alias("blocks"), F.sum("characters").alias("characters"))
    return rows.withColumn("scored", ~F.col("block_type").isin("code", "reference", "quotation"))


def kept_documents(spark, sf_dir):
    """The text that is left without code, references and appendices, and how many blocks went for which reason."""
    kept = wrapped(spark, sf_dir).select("doc_id", kept_text(typed_blocks(F.col("text"), F.col("format"))).alias("k")).select("doc_id", "k.*")
    return kept.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "skipped_table_cell", "skipped_code", "skipped_appendix", "skipped_reference")


def informal_terms(spark, sf_dir, most: int = 12, radius: int = 25):
    """The first twelve informal terms of a text, by the order of the list and then of the text, with 25 characters on either side and formal wordings; told in each text's own row."""
    terms = list(signals.INFORMAL)
    text = F.col("text")
    regexes = F.array(*(F.lit("(?i)" + spelled_out(rf"\b{t}\b", BOUNDARY, BEFORE, AFTER)) for t in terms))
    held = F.expr("array_compact(array(" + ", ".join(f"CASE WHEN contains(low, '{t}') THEN {k} END" for k, t in enumerate(terms)) + "))")
    rows = injected(spark, sf_dir).withColumn("low", F.lower("text")).withColumn("held", held)
    hits = F.flatten(F.transform("held", lambda k: F.transform(matches(text, F.get(regexes, k)), lambda m: F.struct(k.alias("k"), m["start"].alias("low"), m["length"].alias("own")))))
    begin = lambda h: F.greatest(F.lit(0), h["low"] - radius)
    shown = lambda h: F.concat(F.lit("..."), F.replace(F.substring("text", begin(h) + 1, h["low"] + h["own"] + radius - begin(h)), F.lit("\n"), F.lit(" ")), F.lit("..."))
    told = F.transform(F.slice(hits, 1, most), lambda h, i: F.struct((i + 1).cast("long").alias("place"), F.substring("text", h["low"] + 1, h["own"]).alias("term"), h["low"].cast("long").alias("start_offset"), shown(h).alias("snippet"), h["k"].alias("k")))
    wordings = F.get(F.array(*(F.lit(", ".join(signals.INFORMAL[t])) for t in terms)), F.col("k"))
    return rows.select("doc_id", F.inline(told)).select("doc_id", "place", "term", "start_offset", "snippet", wordings.alias("wordings"))


def style_rules(spark, sf_dir):
    """Rule metrics over typed blocks."""
    return rule_metrics(wrapped(spark, sf_dir), typed_blocks(F.col("text"), F.col("format")))


def style_index(spark, sf_dir):
    """Index over typed blocks."""
    return style_review(wrapped(spark, sf_dir), blocks=typed_blocks(F.col("text"), F.col("format")))


def style_documents(spark, sf_dir):
    """Index and recommendation by all rules."""
    return style_review(injected(spark, sf_dir))


def style_rule_metrics(spark, sf_dir):
    return rule_metrics(injected(spark, sf_dir))


def style_categories(spark, sf_dir):
    return category_points(injected(spark, sf_dir))


def style_evidence(spark, sf_dir):
    return style_findings(injected(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        hashed_vector_norms, embedding_topk, tf_cosine, word_dice, indexed_overlap, similar_sentences, document_topk, span_evidence, flagged_sentences, closest_passages, cleanup_edits, normalized_text, draft_sequence, common_words, markdown_documents,
        event_windows, smart_citations, template_citations, typed_block_rows, block_types, section_words, kept_documents, informal_terms, style_rules, style_index, style_documents, style_rule_metrics, style_categories, style_evidence,
    )
}
_PLAIN, _TYPED = review_sql.plain(f"SELECT doc_id, 'txt' AS format, text FROM ({_source(DUCK)})"), review_sql.typed(_wrapped_sql())
_TYPES = f"SELECT doc_id, block_no, source_end - source_start AS characters, kind AS block_type FROM ({review_sql.block_rows(_TYPED)})"
_SENTENCES = r"string_split_regex(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n\s*\n', chr(1), 'g'), chr(1))"
ORACLES = {
    "indexed_overlap": overlap_scores(DUCK),
    "similar_sentences": rf"""WITH s AS (SELECT doc_id, unnest({_SENTENCES}) AS sentence, generate_subscripts({_SENTENCES}, 1) - 1 AS n FROM documents),
c AS (SELECT item_id, unnest({_SENTENCES}) AS sentence, generate_subscripts({_SENTENCES}, 1) - 1 AS m FROM benchmark),
a AS (SELECT doc_id, n, list_distinct(regexp_extract_all(lower(sentence), '[a-z0-9]+')) AS words FROM s WHERE len(regexp_extract_all(sentence, '[^\s]+')) >= 4),
b AS (SELECT item_id, m, list_distinct(regexp_extract_all(lower(sentence), '[a-z0-9]+')) AS words FROM c WHERE len(regexp_extract_all(sentence, '[^\s]+')) >= 4),
p AS (SELECT a.doc_id, a.n, b.item_id, b.m, count(*) AS shared, any_value(a.size + b.size) AS sizes FROM (SELECT *, len(words) AS size, unnest(words) AS word FROM a) a JOIN (SELECT *, len(words) AS size, unnest(words) AS word FROM b) b ON a.word = b.word GROUP BY ALL)
SELECT doc_id, CAST(n AS BIGINT) AS sentence_no, item_id, CAST(m AS BIGINT) AS source_sentence, shared, round(CAST(200 AS DOUBLE) * shared / sizes, 1) AS dice FROM p WHERE 200 * shared >= {NEAR_SENTENCES} * sizes""",
    "typed_block_rows": review_sql.block_rows(_TYPED),
    "block_types": _TYPES,
    "section_words": f"SELECT doc_id, block_type, count(*) AS blocks, CAST(sum(characters) AS BIGINT) AS characters, block_type NOT IN ('code', 'reference', 'quotation') AS scored FROM ({_TYPES}) GROUP BY doc_id, block_type",
    "informal_terms": signals.informal_terms(DUCK),
    "kept_documents": review_sql.kept_documents(_TYPED),
    "style_rules": review_sql.style_rule_metrics(_TYPED),
    "style_index": review_sql.style_documents(_TYPED),
    "style_documents": review_sql.style_documents(_PLAIN),
    "style_rule_metrics": review_sql.style_rule_metrics(_PLAIN),
    "style_categories": review_sql.style_categories(_PLAIN),
    "style_evidence": review_sql.style_evidence(_PLAIN),
    "embedding_topk": tables.embedding_topk(DUCK),
    "tf_cosine": tables.tf_cosine(DUCK),
    "word_dice": tables.word_dice(DUCK),
    "span_evidence": evidence.span_evidence(),
    "flagged_sentences": evidence.flagged_sentences(),
    "cleanup_edits": evidence.cleanup_edits(),
    "event_windows": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "smart_citations": """WITH t AS (SELECT item_id, 'Item ' || item_id || ' Notes' AS title, CASE item_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'https://export.arxiv.org/abs/1' WHEN 2 THEN 'https://en.wikipedia.org/wiki/X' ELSE 'https://notarxiv.org/a' END AS url FROM benchmark)
SELECT item_id, CASE item_id % 4 WHEN 0 THEN title || '. (2024). Institutional Scholarly Archive.' WHEN 1 THEN 'Author et al. (2024). ' || title || '. arXiv preprint ' || url || '.'
    WHEN 2 THEN 'Wikipedia contributors. (2024). ' || title || '. In Wikipedia, The Free Encyclopedia.' ELSE title || '. (2024). Institutional Scholarly Archive, ' || url || '.' END AS apa,
  CASE item_id % 4 WHEN 0 THEN '"' || title || '." Institutional Repository, 2024.' WHEN 1 THEN '"' || title || '." arXiv, 2024, ' || url || '.'
    WHEN 2 THEN '"' || title || '." Wikipedia, Wikimedia Foundation, 2024, ' || url || '.' ELSE '"' || title || '." Institutional Repository, 2024, ' || url || '.' END AS mla,
  CASE item_id % 4 WHEN 1 THEN '[1] "' || title || '," arXiv preprint, 2024, ' || url || '.' WHEN 2 THEN '[1] "' || title || '," Wikipedia, The Free Encyclopedia, 2024. [Online]. Available: ' || url || '.'
    ELSE '[1] "' || title || '," Institutional Academic Database, 2024.' END AS ieee FROM t""",
    "template_citations": """WITH t AS (SELECT item_id, 'Unknown Item_' || item_id AS title FROM benchmark)
SELECT item_id, 'Unknown author (n.d.). ' || title || '. Unknown publication.' AS apa, 'Unknown author "' || title || '." Unknown publication, n.d..' AS mla,
  '[1] Unknown author, "' || title || '," Unknown publication, n.d..' AS ieee, 'Unknown author "' || title || '." Unknown publication (n.d.).' AS chicago,
  '@article{authorn.d.article,' || chr(10) || '  author = {Unknown author},' || chr(10) || '  title  = {{' || title || '}},' || chr(10) || '  year   = {n.d.}' || chr(10) || '}' AS bibtex FROM t""",
    "markdown_documents": r"SELECT doc_id, regexp_replace(regexp_replace('Title' || chr(10) || 'bold link ' || text, '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*\n]+)\*', '\1', 'g') AS text FROM documents",
}
