"""Files to documents: directory scans, text extraction by extension, archives, and corpus maintenance."""

from __future__ import annotations

import importlib.util
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions.udfs import in_pieces
from inkspan.sources.errors import ARCHIVE, DOCX_BROKEN, DOCX_LIMITS, EMPTY, FILE_LIMIT, FORMAT, GENERAL, LARGE_ARCHIVE, LARGE_ENTRY, MANY_ENTRIES, PDF_BROKEN

EXTENSIONS = ("txt", "md", "docx", "pdf", "rtf", "csv", "tex", "bib", "ipynb")
MAX_FILE_BYTES, MAX_ARCHIVE_FILES, MAX_ARCHIVE_BYTES, MAX_DOCX_ENTRIES = 8 << 20, 100, 32 << 20, 2000
#: What damaged, encrypted and unsupported archives and their XML raise.
BROKEN = (zipfile.BadZipFile, zlib.error, struct.error, ElementTree.ParseError, RuntimeError, EOFError, OSError, LookupError, ValueError)
WORDS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def decoded(content: Column) -> Column:
    """UTF-8 without its mark where the bytes are valid, Latin-1 otherwise."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.trim(F.regexp_replace(text, "^\\x{FEFF}", ""))


def latex_prose(text: Column) -> Column:
    """LaTeX as prose: comments out, citations as (key, 2024), formulas named, other commands dropped."""
    # What is replaced, in this order.
    steps = (
        (r"(?m)(?<!\\)%.*$", ""),
        (r"\\(?:cite[pt]?|parencite)\{([^}]+)\}", "($1, 2024)"),
        (r"(?s)\\begin\{(equation|align|gather|multline)\*?\}.*?\\end\{\1\*?\}", " [Mathematical Formula] "),
        (r"(?s)\$\$.*?\$\$", " [Math Display] "),
        (r"\$.*?\$", " [Math] "),
        (r"\\(?:section|subsection|subsubsection|paragraph|textbf|textit|emph|underline|caption)\{([^}]+)\}", "$1"),
        (r"\\(?:begin|end)\{[^}]+\}", ""),
        (r"\\item", "• "),
        (r"\\[a-zA-Z]+", " "),
        (r"[{}]", ""),
        (r"[ \t]+", " "),
        (r"\n{3,}", "\n\n"),
    )
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", ""))


def notebook_text(text: Column) -> Column:
    """Markdown cells and the triple-quoted strings of code cells; the raw text if there are none. A cell's source is a list of strings or one string."""
    cells = F.from_json(text, "struct<cells:array<struct<cell_type:string,source:string>>>")["cells"]

    def pieces(cell: Column) -> Column:
        listed = F.from_json(cell["source"], "array<string>")  # null for one string
        source = F.when(cell["source"].startswith("["), F.coalesce(F.concat_ws("", F.filter(listed, lambda s: s.isNotNull())), cell["source"])).otherwise(F.coalesce(cell["source"], F.lit("")))
        quoted = F.filter(F.transform(F.regexp_extract_all(source, F.lit(r'(?s)"""(.*?)"""'), F.lit(1)), F.trim), lambda s: s != "")
        return F.when(cell["cell_type"] == "markdown", F.array(source)).when(cell["cell_type"] == "code", quoted).otherwise(F.array().cast("array<string>"))

    joined = F.concat_ws("\n\n", F.flatten(F.transform(cells, pieces)))
    return F.when(F.coalesce(joined, F.lit("")) != "", joined).otherwise(text)


def markdown_text(text: Column) -> Column:
    for pattern, new in ((r"```[^\n]*\n?", ""), (r"(?m)^#{1,6}\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*\n]+)\*", "$1"), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"`([^`]+)`", "$1")):
        text = F.regexp_replace(text, pattern, new)
    return text


def docx_body(content: bytes) -> tuple[ElementTree.Element | None, str | None]:
    """The body of a DOCX file, or why it can't be read. Its declared sizes are looked at before anything is expanded."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            if len(archive.infolist()) > MAX_DOCX_ENTRIES or sum(i.file_size for i in archive.infolist()) > MAX_ARCHIVE_BYTES:
                return None, DOCX_LIMITS
            body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{WORDS}body")
    except BROKEN:
        return None, DOCX_BROKEN
    return (body, None) if body is not None else (None, DOCX_BROKEN)


def said(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{WORDS}t"))


def docx_text(content: bytes) -> tuple[str | None, str | None]:
    """Paragraphs of a DOCX file and then its table rows, or no text and why it can't be read."""
    body, error = docx_body(content)
    if error:
        return None, error
    lines = [said(node) for node in body if node.tag == f"{WORDS}p"]
    for row in (r for node in body if node.tag == f"{WORDS}tbl" for r in node.iter(f"{WORDS}tr")):
        lines.append(" ".join(filter(None, (said(cell).strip() for cell in row.iter(f"{WORDS}tc")))))
    return "\n\n".join(x for x in lines if x.strip()), None


def pdf_text(content: bytes) -> str | None:
    """Text of a PDF file page by page; None if it can't be read, or if there is no reader."""
    try:
        from pypdf import PdfReader
        from pypdf.errors import PyPdfError
    except ImportError:
        return None
    try:
        pages = [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]
    except (PyPdfError, ValueError, KeyError):
        return None
    return "\n\n".join(p.strip() for p in pages if p.strip())


def pdf_readable() -> bool:
    return importlib.util.find_spec("pypdf") is not None


def pdf_column(content: Column) -> Column:
    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: None if c is None else pdf_text(c))

    return read(content)


def docx_column(content: Column) -> Column:
    @F.pandas_udf("text string, error string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (contents,) in in_pieces(batch):
                yield pd.DataFrame([(None, None) if c is None else docx_text(c) for c in contents], columns=["text", "error"], dtype=object)

    return read(content)


def docx_parts(content: bytes) -> list[dict] | None:
    """Typed parts of a DOCX file, paragraphs before table cells: headings with their level, list items, bold and italic spans; None if it can't be read."""
    body, error = docx_body(content)
    if error:
        return None
    parts, cells = [], []

    def switched_on(run, name: str) -> bool:
        mark = run.find(f"{WORDS}rPr/{WORDS}{name}")
        return mark is not None and mark.get(f"{WORDS}val") not in ("0", "false", "none")

    for node in body:
        if node.tag == f"{WORDS}tbl":
            cells += [said(cell).strip() for cell in node.iter(f"{WORDS}tc")]
        elif node.tag == f"{WORDS}p" and said(node).strip():
            named = node.find(f"{WORDS}pPr/{WORDS}pStyle")
            style = "" if named is None else named.get(f"{WORDS}val") or ""
            level = re.search(r"\d+", style)
            kind = "heading" if style.lower().startswith("heading") else "list_item" if "list" in style.lower() else "paragraph"
            spans: dict[str, list] = {"b": [], "i": []}
            at = 0
            for run in node.iter(f"{WORDS}r"):
                end = at + len(said(run))
                for name, listed in spans.items():
                    if end > at and switched_on(run, name):
                        listed.append([at, end])
                at = end
            parts.append({"kind": kind, "text": said(node), "heading_level": int(level.group()) if level and kind == "heading" else None, "bold_spans": spans["b"], "italic_spans": spans["i"]})
    return parts + [{"kind": "table_cell", "text": c, "heading_level": None, "bold_spans": None, "italic_spans": None} for c in cells if c]


def docx_blocks(files: DataFrame) -> DataFrame:
    """(path, content) of DOCX files to their typed blocks, with offsets in the text of all blocks two line breaks apart. Unreadable files give none."""
    schema = "array<struct<kind:string,text:string,heading_level:int,bold_spans:array<array<int>>,italic_spans:array<array<int>>>>"

    @F.pandas_udf(schema)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            for (contents,) in in_pieces(batch):
                yield contents.map(lambda c: None if c is None else docx_parts(c))

    rows = files.filter(extension(F.col("path")) == "docx").select("path", read("content").alias("parts"))
    before = F.aggregate(F.slice("parts", F.lit(1), F.col("block_no")), F.lit(0), lambda n, p: n + F.length(p["text"]) + 2)
    rows = rows.select("path", "parts", F.posexplode("parts").alias("block_no", "p")).withColumn("start", before)
    return rows.select("path", (F.col("block_no") + 1).alias("block_no"), "p.*", "start", (F.col("start") + F.length("p.text")).alias("end"))


def signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Path, time and size of each file of an allowed type; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(folder)
    return files.filter(extension(F.col("path")).isin(*EXTENSIONS)).select("path", "modificationTime", "length")


def changed_sources(known: DataFrame, now: DataFrame) -> DataFrame:
    """Files added, changed or removed between two tables of signatures."""
    same = F.col("a.modificationTime").eqNullSafe(F.col("b.modificationTime")) & F.col("a.length").eqNullSafe(F.col("b.length"))
    both = known.alias("a").join(now.alias("b"), F.col("a.path") == F.col("b.path"), "full")
    change = F.when(F.col("a.path").isNull(), "added").when(F.col("b.path").isNull(), "removed").when(~same, "changed")
    return both.select(F.coalesce("a.path", "b.path").alias("path"), change.alias("change")).filter("change IS NOT NULL")


def extract_text(files: DataFrame) -> DataFrame:
    """(path, content) to path, filename, text, status (success, empty, unsupported, too large or unreadable) and error, the message to show.

    A file that can't be read is a row with its status, never a failed job. A
    file beyond the limit isn't looked into. PDF text needs the library pypdf;
    without it such files are unsupported. A null content is unreadable.
    """
    pdf = pdf_readable()
    kind = extension(F.col("path"))
    known = kind.isin(*EXTENSIONS) & (F.lit(pdf) | (kind != "pdf"))
    large = F.length("content") > MAX_FILE_BYTES
    content = F.when(known & ~large, F.col("content"))
    plain = decoded(content)
    text = F.when(kind == "docx", F.col("docx.text")).when(kind == "tex", latex_prose(plain)).when(kind == "ipynb", notebook_text(plain)).when(kind != "pdf", plain)
    if pdf:
        text = F.when(kind == "pdf", pdf_column(F.when(kind == "pdf", content))).otherwise(text)
    rows = files.withColumn("docx", docx_column(F.when(kind == "docx", content))).withColumn("text", text)
    status = F.when(~known, "unsupported").when(large, "too large").when(F.col("docx.error") == DOCX_LIMITS, "too large").when(F.col("text").isNull(), "unreadable").when(F.trim("text") == "", "empty").otherwise("success")
    error = F.when(~known, FORMAT).when(large, FILE_LIMIT).when(F.col("text").isNull(), F.when(kind == "docx", F.coalesce("docx.error", F.lit(DOCX_BROKEN))).when(kind == "pdf", PDF_BROKEN).otherwise(GENERAL)).when(F.trim("text") == "", EMPTY)
    rows = rows.withColumns({"status": status, "error": error})
    return rows.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.when(F.col("status") == "success", F.col("text")).alias("text"), "status", "error")


def scan_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The readable, non-empty files of a folder as corpus rows. Types and sizes are told by the listing; other files aren't opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(folder).filter(F.col("length") <= MAX_FILE_BYTES)
    files = files.filter(extension(F.col("path")).isin(*EXTENSIONS))
    return extract_text(files).filter(F.col("status") == "success").select(F.col("filename").alias("source_key"), "filename", "text", F.lit("institutional_corpus").alias("source_type"))


def archive_entries(content: bytes | None) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    """Name, bytes and error of each allowed entry of a ZIP file; an archive beyond the limits is one error."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
            infos = archive.infolist()
            if len(infos) > MAX_ARCHIVE_FILES:
                yield None, None, MANY_ENTRIES
            elif sum(i.file_size for i in infos) > MAX_ARCHIVE_BYTES:
                yield None, None, LARGE_ARCHIVE
            elif any(i.file_size > MAX_FILE_BYTES or i.flag_bits & 1 for i in infos):
                yield None, None, LARGE_ENTRY
            else:
                for i in infos:
                    hidden = i.filename.startswith("__MACOSX") or i.filename.rsplit("/", 1)[-1].startswith(".")
                    if not i.is_dir() and not hidden and i.filename.rsplit(".", 1)[-1].lower() in EXTENSIONS:
                        try:
                            yield i.filename, archive.read(i), None
                        except BROKEN:
                            yield i.filename, None, GENERAL
    except BROKEN:
        yield None, None, ARCHIVE


def unzip(archives: DataFrame) -> DataFrame:
    """(path, content) of ZIP files to (archive, path, content, error) of their allowed entries.

    An archive that is damaged, encrypted or beyond the limits is one row with
    an error, a damaged entry one with its name; the rest of the job goes on.
    """

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for paths, contents in in_pieces(frame["path"], frame["content"]):
                rows = [(path, *entry) for path, content in zip(paths, contents, strict=True) for entry in archive_entries(content)]
                yield pd.DataFrame(rows, columns=["archive", "path", "content", "error"])

    return archives.select("path", "content").mapInPandas(entries, "archive string, path string, content binary, error string")


def addable_sources(corpus: DataFrame, new: DataFrame) -> DataFrame:
    """The new rows whose source_key isn't in the corpus, one a key: what may be appended."""
    return new.dropDuplicates(["source_key"]).join(corpus.select("source_key"), "source_key", "left_anti").select(*new.columns)


def delete_source(corpus: DataFrame, key: str) -> DataFrame:
    return corpus.filter(~F.col("source_key").eqNullSafe(key))


def inverted_to_text(positions: Column) -> Column:
    """A map from words to their positions as text."""
    pairs = F.flatten(F.transform(F.map_entries(positions), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.concat_ws(" ", F.transform(F.array_sort(pairs), lambda x: x["w"]))
