"""Readers, corpus maintenance and reports over inputs made of the tables, whose right results SQL can tell."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions.udfs import in_pieces
from inkspan.sources.errors import KNOWN, public_message
from inkspan.sources.readers import addable_sources, changed_sources, decoded, delete_source, docx_blocks, extract_text, inverted_to_text, latex_prose, notebook_text, unzip
from inkspan.sources.shared import checkpointed, shared_folder
from inkspan.sources.sinks import html_reports
from inkspan.sources.stores import add_sources, address_store, corpus_store, delete_sources, record_views, subscribe, view_store, view_summary
from inkspan.sources.tables import read_table

#: Characters that XML can't hold or changes.
UNFIT = r"[\x00-\x08\x0B-\x1F]"
HEAD = '<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
ROW = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>left</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>right</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def docx_file(lines: list[str]) -> bytes:
    """A DOCX file of a heading, lines of which every second is a list item, and a table."""
    said = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    style = lambda name: f'<w:pPr><w:pStyle w:val="{name}"/></w:pPr>'
    body = f"<w:p>{style('Heading2')}{said('Report')}</w:p>" + "".join(f"<w:p>{style('ListBullet') if n % 2 else ''}{said(line)}</w:p>" for n, line in enumerate(lines)) + ROW
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", HEAD + body + "</w:body></w:document>")
    return out.getvalue()


def zip_file(name: str, text: str) -> bytes:
    """A ZIP file of a text, a hidden file, a file of a type that isn't read and a folder."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("essays/", "")
        for path, content in ((f"essays/{name}.txt", text), ("__MACOSX/essays/x.txt", "no"), ("essays/.hidden.txt", "no"), ("essays/picture.png", "no"), ("essays/notes.md", "Short notes.")):
            archive.writestr(path, content)
    return out.getvalue()


def docx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("binary")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            for (texts,) in in_pieces(batch):
                yield texts.map(lambda t: docx_file(t.split("\n")))

    text = F.regexp_replace(F.coalesce("text", F.lit("")), UNFIT, "")
    return documents(spark, sf_dir).select("doc_id", F.format_string("/in/%d.docx", "doc_id").alias("path"), made(text).alias("content"))


def docx_documents(spark, sf_dir):
    """Text of every document written as a DOCX file and read again."""
    return extract_text(docx_files(spark, sf_dir)).select("filename", "status", sha(F.col("text")).alias("text_sha256"))


def docx_typed_blocks(spark, sf_dir):
    """Number, kinds and offsets of the blocks of every document written as a DOCX file."""
    rows = docx_blocks(docx_files(spark, sf_dir).select("path", "content"))
    kinds = [F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("heading", "list_item", "paragraph", "table_cell")]
    return rows.groupBy("path").agg(F.max("block_no").cast("long").alias("blocks"), *kinds, F.max("heading_level").cast("long").alias("level"), F.max("end").cast("long").alias("end_offset"))


def damaged_file(number: int, text: str) -> tuple[str, bytes]:
    """A file by its number: good, cut off, damaged inside, encrypted, beyond the limits by its own account, or of a wrong type."""
    case, good = number % 7, docx_file(text.split("\n"))
    local, central = good.index(b"PK\x03\x04"), good.index(b"PK\x01\x02")
    packed = local + 30 + len("word/document.xml")
    if case == 1:
        good = good[: len(good) // 2]
    elif case == 2:
        good = good[:packed] + b"\xff" * 12 + good[packed + 12 :]
    elif case == 3:  # the flag of encrypted entries
        good = good[: local + 6] + b"\x01" + good[local + 7 : central + 8] + b"\x01" + good[central + 9 :]
    elif case == 4:  # the size after expansion
        good = good[: central + 24] + (1 << 30).to_bytes(4, "little") + good[central + 28 :]
    elif case == 5:
        return f"/in/{number}.exe", good
    return f"/in/{number}.docx", b"" if case == 6 else good


def damaged_files(spark, sf_dir):
    """What becomes of a file of each document, six of seven of which are damaged or not allowed, as it is and inside a ZIP file."""

    @F.pandas_udf("path string, content binary, zipped binary")
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in (piece for batch in batches for piece in in_pieces(*batch)):
            rows = []
            for number, text in zip(ids, texts, strict=True):
                path, content = damaged_file(number, text)
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                    archive.writestr(path[1:], content)
                    archive.writestr("in/notes.md", "Short notes.")
                whole = out.getvalue()
                rows.append((path, content, whole[:20] if number % 2 else whole))
            yield pd.DataFrame(rows, columns=["path", "content", "zipped"])

    text = F.regexp_replace(F.coalesce("text", F.lit("")), UNFIT, "")
    files = documents(spark, sf_dir).select("doc_id", made("doc_id", text).alias("f")).select("doc_id", "f.*")
    entries = unzip(files.select(F.format_string("/in/%d.zip", "doc_id").alias("path"), F.col("zipped").alias("content")))
    lost = entries.filter("error IS NOT NULL").select(F.col("archive").alias("path"), F.lit("unreadable").alias("status"), "error")
    read = extract_text(files.select("path", "content")).unionByName(extract_text(entries.filter("error IS NULL").select(F.concat("archive", F.lit("/"), "path").alias("path"), "content")))
    return read.select("path", "status", "error").unionByName(lost)


def notebook_documents(spark, sf_dir):
    """Text of every document as a notebook's cell, whose source is a list of lines or one string, and of a quoted string in code."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), UNFIT, "")
    code = F.struct(F.lit("code").alias("cell_type"), F.array(F.lit('x = """quoted"""\n'), F.lit("y = 1")).alias("source"))
    whole = F.to_json(F.struct(F.array(F.struct(F.lit("markdown").alias("cell_type"), text.alias("source"))).alias("cells")))
    listed = F.to_json(F.struct(F.array(F.struct(F.lit("markdown").alias("cell_type"), F.array(text, F.lit("!")).alias("source")), code).alias("cells")))
    made = F.when(F.col("doc_id") % 2 == 0, whole).otherwise(listed)
    return documents(spark, sf_dir).select("doc_id", sha(notebook_text(made)).alias("text_sha256"))


def zipped_documents(spark, sf_dir):
    """Every document from a ZIP file with other entries, which are left out or read too."""

    @F.pandas_udf("binary")
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ids, texts in (piece for batch in batches for piece in in_pieces(*batch)):
            yield pd.Series([zip_file(f"doc{i}", t) for i, t in zip(ids, texts, strict=True)])

    files = documents(spark, sf_dir).select(F.format_string("/in/%d.zip", "doc_id").alias("path"), made("doc_id", F.coalesce("text", F.lit(""))).alias("content"))
    entries = unzip(files).select(F.col("archive"), "path", "content")
    return extract_text(entries).select("path", "filename", "status", sha(F.col("text")).alias("text_sha256")).groupBy("filename", "status", "text_sha256").agg(F.count("*").alias("files"))


def decoded_documents(spark, sf_dir):
    """Every document as UTF-8 bytes behind a mark, or as Latin-1 bytes with ? for what that can't hold."""
    text = F.concat(F.lit("é "), F.coalesce("text", F.lit("")))
    latin = F.encode(F.regexp_replace(text, r"[^\x{00}-\x{FF}]", "?"), "ISO-8859-1")
    content = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(b"\xef\xbb\xbf"), text.cast("binary"))).otherwise(latin)
    return documents(spark, sf_dir).select("doc_id", sha(decoded(content)).alias("text_sha256"))


def latex_documents(spark, sf_dir):
    """Prose of the documents wrapped in LaTeX."""
    wrapped = F.concat(F.lit("\\section{Title} % note\n\\cite{key} $x^2$ \\textbf{x"), F.regexp_replace("text", r"[{}$%\\]", ""), F.lit("}"))
    return documents(spark, sf_dir).select("doc_id", sha(latex_prose(wrapped)).alias("prose_sha256"))


def inverted_documents(spark, sf_dir):
    """Texts put together again from maps of words to positions. Texts are dealt out by id while they are whole, so their words aren't shuffled."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = documents(spark, sf_dir).select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(words).alias("p", "w")).groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps"))
    rows = rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    return rows.select("doc_id", sha(inverted_to_text(F.col("m"))).alias("text_sha256"))


def signature_table(spark: SparkSession, sf_dir: str, day: int) -> DataFrame:
    """Signatures of made-up files on two days: some go, come or change."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").filter((F.col("p_partkey") % 7 != day) | (F.col("p_partkey") % 7 > 2))
    grown = F.when((F.col("p_partkey") % 5 == 0) & F.lit(day == 2), 1).otherwise(0)
    return parts.select(F.format_string("/in/%d.txt", "p_partkey").alias("path"), F.lit("2024-01-01").cast("timestamp").alias("modificationTime"), (F.col("p_size").cast("long") + grown).alias("length"))


def corpus_changes(spark, sf_dir):
    """Files added, removed and changed between two scans."""
    return changed_sources(signature_table(spark, sf_dir, 1), signature_table(spark, sf_dir, 2))


def corpus_additions(spark, sf_dir):
    """The corpus without one source, and the new sources that may be appended, one a key."""
    corpus = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.format_string("item_%d.txt", "item_id").alias("source_key"))
    new = documents(spark, sf_dir).select(F.format_string("item_%d.txt", (F.col("doc_id") / 2).cast("long")).alias("source_key"))
    kept = delete_source(corpus, "item_1.txt")
    return kept.withColumn("how", F.lit("kept")).unionByName(addable_sources(kept, new).withColumn("how", F.lit("added")))


def own_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def published_corpus(spark, sf_dir):
    """A stored corpus after three changes: the corpus' items, then all documents under names that are new, there already, of a wrong type or none, then every fifth item gone; the second change's statuses, too."""
    store = corpus_store(spark, own_folder(spark, "corpus"))
    name = lambda key, suffix: F.concat(F.lit("item_"), F.col(key).cast("string"), suffix)
    items = read_table(spark, sf_dir, "benchmark")
    add_sources(store, items.select(name("item_id", F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content")))
    suffix = F.element_at(F.array(F.lit(".txt"), F.lit(".exe"), F.lit("/x.txt"), F.lit(".md")), (F.col("doc_id") % 4 + 1).cast("int"))
    content = F.when(F.col("doc_id") % 9 == 0, F.lit(" ")).otherwise(F.coalesce("text", F.lit("")))
    told = checkpointed(add_sources(store, documents(spark, sf_dir).select(name("doc_id", suffix).alias("path"), content.cast("binary").alias("content"))))
    delete_sources(store, items.filter("item_id % 5 = 0").select(name("item_id", F.lit(".txt")).alias("source_key")))
    there = store.read().select("source_key", F.lit("stored").alias("status"), F.lit(None).cast("string").alias("error"), sha(F.col("text")).alias("text_sha256"))
    return told.withColumn("text_sha256", F.lit(None).cast("string")).unionByName(there)


def subscriber_store(spark, sf_dir):
    """Addresses made of the events' users, in two runs whose later one holds all again: one row an address, with its first consent of the run that brought it, and what the second run was told."""
    store = address_store(spark, own_folder(spark, "addresses"))
    email = F.concat(F.when(F.col("event_id") % 3 == 0, F.lit(" User")).otherwise(F.lit("user")), F.col("user_id").cast("string"), F.when(F.col("event_id") % 50 == 7, F.lit("@nowhere")).otherwise(F.lit("@Example.org")))
    rows = read_table(spark, sf_dir, "events").select("event_id", email.alias("email"), F.col("ts").alias("consented_at"), F.col("event_type").alias("source"))
    subscribe(store, rows.filter("event_id % 4 = 0"))
    told = checkpointed(subscribe(store, rows)).groupBy("email", "status").agg(F.count("*").alias("times"))
    return told.select("email", "status", "times", F.lit(None).cast("timestamp").alias("consented_at")).unionByName(store.read().select("email", F.lit("stored").alias("status"), F.lit(1).cast("long").alias("times"), "consented_at"))


def stored_views(spark, sf_dir):
    """Events as page views, stored in two appends; those of the last week and of all time."""
    store, events = view_store(spark, own_folder(spark, "views")), read_table(spark, sf_dir, "events")
    for half in (0, 1):
        record_views(store, events.filter(F.col("event_id") % 2 == half).select(F.concat(F.lit("/"), "event_type").alias("path"), F.col("ts").alias("viewed_at")))
    last = events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    return view_summary(store, F.timestamp_micros(F.lit(last)), 7)


def highlighted_reports(spark, sf_dir):
    """HTML reports of every document with three spans, two of which overlap."""
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    rows = documents(spark, sf_dir).filter(F.length("text") >= 30).select("doc_id", "text", F.array(span(20, 30), span(0, 5), span(3, 8)).alias("spans"), F.lit(12.5).alias("overall_similarity"))
    return html_reports(rows).select("doc_id", sha(F.col("html")).alias("html_sha256"))


def public_errors(spark, sf_dir):
    """What is shown for made-up errors, one for each event."""
    text = F.when(F.col("event_id") % 5 == 0, F.element_at(F.array(*(F.lit(k) for k in KNOWN)), (F.col("event_id") % len(KNOWN) + 1).cast("int")))
    text = text.when(F.col("event_id") % 5 == 1, "Options must be an object.").when(F.col("event_id") % 5 == 2, F.concat(F.lit("Unsupported file format: ."), "event_type")).otherwise(F.concat(F.lit("/srv/"), "event_type"))
    kind = F.when(F.col("event_id") % 5 == 3, "BadZipFile").otherwise("ValueError")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", public_message(text, kind).alias("shown"))


_CLEAN = rf"regexp_replace(coalesce(text, ''), '{UNFIT}', '', 'g')"
_LINES = f"list_filter(string_split({_CLEAN}, chr(10)), lambda x: regexp_matches(x, '[^\\s]'))"
_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')"
_GAP = "chr(10) || chr(10)"

QUERIES = {
    f.__name__: f
    for f in (
        docx_documents, docx_typed_blocks, damaged_files, notebook_documents, zipped_documents, decoded_documents, latex_documents, inverted_documents, corpus_changes, corpus_additions, published_corpus, subscriber_store, stored_views, highlighted_reports, public_errors,
    )
}
_KNOWN = ", ".join("'" + k + "'" for k in KNOWN)
ORACLES = {
    "public_errors": f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN list_extract([{_KNOWN}], event_id % {len(KNOWN)} + 1) WHEN 1 THEN 'Report data has an invalid structure.'
  WHEN 2 THEN 'Unsupported file format.' WHEN 3 THEN 'The uploaded file is not a valid ZIP archive.' ELSE 'The request could not be processed.' END AS shown FROM events""",
    "docx_documents": f"""SELECT doc_id || '.docx' AS filename, 'success' AS status,
  sha256('Report' || {_GAP} || array_to_string(list_append({_LINES}, 'left right'), {_GAP})) AS text_sha256 FROM documents""",
    "docx_typed_blocks": f"""WITH l AS (SELECT doc_id, unnest(string_split({_CLEAN}, chr(10))) AS line, generate_subscripts(string_split({_CLEAN}, chr(10)), 1) AS n FROM documents),
k AS (SELECT * FROM l WHERE regexp_matches(line, '[^\\s]')),
c AS (SELECT d.doc_id, count(k.n) AS n, count(*) FILTER (WHERE k.n % 2 = 0) AS items, coalesce(sum(length(line) + 2), 0) AS size FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id)
SELECT '/in/' || doc_id || '.docx' AS path, n + 3 AS blocks, CAST(1 AS BIGINT) AS heading, items AS list_item, n - items AS paragraph, CAST(2 AS BIGINT) AS table_cell, CAST(2 AS BIGINT) AS level,
  CAST(8 + size + 6 + 5 AS BIGINT) AS end_offset FROM c""",
    "damaged_files": """WITH c AS (SELECT doc_id, CASE doc_id % 7 WHEN 5 THEN 'in/' || doc_id || '.exe' ELSE 'in/' || doc_id || '.docx' END AS name, doc_id % 2 = 0 AS opens,
  CASE doc_id % 7 WHEN 0 THEN 'success' WHEN 4 THEN 'too large' WHEN 5 THEN 'unsupported' ELSE 'unreadable' END AS status,
  CASE doc_id % 7 WHEN 0 THEN NULL WHEN 4 THEN 'DOCX expanded content exceeds extraction limits.' WHEN 5 THEN 'Unsupported file format.' ELSE 'Failed to read DOCX file. It may be corrupt, encrypted, or unsupported.' END AS error FROM documents)
SELECT '/' || name AS path, status, error FROM c
UNION ALL SELECT '/in/' || doc_id || '.zip/' || name, status, error FROM c WHERE opens AND doc_id % 7 <> 5
UNION ALL SELECT '/in/' || doc_id || '.zip/in/notes.md', 'success', NULL FROM c WHERE opens
UNION ALL SELECT '/in/' || doc_id || '.zip', 'unreadable', 'The uploaded file is not a valid ZIP archive.' FROM c WHERE NOT opens""",
    "notebook_documents": f"""SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN {_CLEAN} ELSE {_CLEAN} || '!' || {_GAP} || 'quoted' END) AS text_sha256 FROM documents""",
    "zipped_documents": """WITH f AS (SELECT 'doc' || doc_id || '.txt' AS filename, trim(coalesce(text, ''), ' ') AS text FROM documents UNION ALL SELECT 'notes.md', 'Short notes.' FROM documents)
SELECT filename, CASE WHEN text = '' THEN 'empty' ELSE 'success' END AS status, CASE WHEN text <> '' THEN sha256(text) END AS text_sha256, count(*) AS files FROM f GROUP BY ALL""",
    "decoded_documents": r"""WITH t AS (SELECT doc_id, 'é ' || coalesce(text, '') AS text FROM documents)
SELECT doc_id, sha256(trim(CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g') END, ' ')) AS text_sha256 FROM t""",
    "latex_documents": r"""WITH t AS (SELECT doc_id, 'Title ' || chr(10) || '(key, 2024)  [Math]  x' || regexp_replace(text, '[{}$%\\]', '', 'g') AS text FROM documents)
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\s+$', '')) AS prose_sha256 FROM t""",
    "inverted_documents": r"""SELECT doc_id, sha256(array_to_string(regexp_extract_all(text, '[^\s]+'), ' ')) AS text_sha256 FROM documents WHERE regexp_matches(text, '[^\s]')""",
    "corpus_changes": """SELECT '/in/' || p_partkey || '.txt' AS path, CASE WHEN p_partkey % 7 = 1 THEN 'added' WHEN p_partkey % 7 = 2 THEN 'removed' ELSE 'changed' END AS change
FROM part WHERE p_partkey % 7 IN (1, 2) OR p_partkey % 5 = 0""",
    "corpus_additions": """WITH kept AS (SELECT 'item_' || item_id || '.txt' AS source_key FROM benchmark WHERE item_id <> 1)
SELECT source_key, 'kept' AS how FROM kept UNION ALL
SELECT DISTINCT 'item_' || (doc_id // 2) || '.txt', 'added' FROM documents WHERE 'item_' || (doc_id // 2) || '.txt' NOT IN (SELECT source_key FROM kept)""",
    "published_corpus": """WITH t AS (SELECT doc_id, 'item_' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.exe' WHEN 2 THEN '/x.txt' ELSE '.md' END AS source_key, CASE WHEN doc_id % 9 = 0 THEN '' ELSE trim(coalesce(text, ''), ' ') END AS text FROM documents),
j AS (SELECT *, CASE WHEN doc_id % 4 IN (1, 2) THEN 'Invalid source filename.' WHEN text = '' THEN 'Source contains no extractable text.' END AS error, source_key IN (SELECT 'item_' || item_id || '.txt' FROM benchmark) AS known FROM t)
SELECT source_key, CASE WHEN error IS NOT NULL THEN 'rejected' WHEN known THEN 'exists' ELSE 'added' END AS status, error, CAST(NULL AS VARCHAR) AS text_sha256 FROM j
UNION ALL SELECT source_key, 'stored', NULL, sha256(text) FROM j WHERE error IS NULL AND NOT known
UNION ALL SELECT 'item_' || item_id || '.txt', 'stored', NULL, sha256(trim(text, ' ')) FROM benchmark WHERE item_id % 5 <> 0""",
    "subscriber_store": """WITH e AS (SELECT event_id, ts, 'user' || user_id || CASE WHEN event_id % 50 = 7 THEN '@nowhere' ELSE '@example.org' END AS email FROM events),
first AS (SELECT email, min(ts) AS ts FROM e WHERE event_id % 4 = 0 AND event_id % 50 <> 7 GROUP BY email),
later AS (SELECT email, min(ts) AS ts FROM e WHERE event_id % 50 <> 7 AND email NOT IN (SELECT email FROM first) GROUP BY email)
SELECT email, CASE WHEN contains(email, '@nowhere') THEN 'rejected' WHEN email IN (SELECT email FROM first) THEN 'exists' ELSE 'added' END AS status, count(*) AS times, CAST(NULL AS TIMESTAMP) AS consented_at FROM e GROUP BY email
UNION ALL SELECT email, 'stored', 1, ts FROM first UNION ALL SELECT email, 'stored', 1, ts FROM later""",
    "stored_views": "SELECT count(*) FILTER (ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS page_views, count(*) AS all_time_page_views, CAST(7 AS BIGINT) AS days FROM events",
    "highlighted_reports": f"""SELECT doc_id, sha256('<!doctype html><meta charset=utf-8><title>Overlap report</title><h1>Document ' || doc_id || ': 12.50 %</h1><p><mark>' || {_ESCAPED.format('substring(text, 1, 8)')}
  || '</mark>' || {_ESCAPED.format('substring(text, 9, 12)')} || '<mark>' || {_ESCAPED.format('substring(text, 21, 10)')} || '</mark>' || {_ESCAPED.format('substring(text, 31)')} || '</p>') AS html_sha256
FROM documents WHERE length(text) >= 30""",
}
