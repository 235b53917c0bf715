"""Arrow functions, readers, sinks and streams on small inputs."""

import io
import json
import re
import zipfile

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkspan.functions.text import PATTERN_SENTENCE, PATTERN_WORD, needed
from inkspan.functions.udfs import HELD, HELD_ROWS, TextScan, common_subsequence, edited, find_spans, in_pieces, nfkc, offset_map, sequence_diff, subsequence_length
from inkspan.operators.revision import cleanup
from inkspan.operators import vectors
from inkspan.operators.vectors import hashed_vectors, top_k
from inkspan.plans import catalogue, review, signals
from inkspan.plans.dialect import DUCK, SPARK, query
from inkspan.sources import readers, sinks
from inkspan.streaming.overlap import stream_overlap, windowed_events


def test_spans_count_code_points(spark):
    row = spark.createDataFrame([("😀 ab ab",), (None,)], "t string").select(find_spans(F.col("t"), {"x": "ab"}).alias("s")).collect()
    assert [(s.start, s.end) for s in row[0].s] == [(2, 4), (5, 7)]
    assert row[1].s == []


def test_normal_forms(spark):
    row = spark.createDataFrame([("ﬁn",)], "t string").select(nfkc(F.col("t")).alias("n"), offset_map(F.col("t")).alias("m")).first()
    assert row.n == "fin" and row.m == [0, 0, 1]


def test_subsequence_and_diff(spark):
    frame = spark.createDataFrame([(["a", "b", "c", "d"], ["b", "x", "d"]), ([], ["a"])], "a array<string>, b array<string>")
    rows = frame.select(common_subsequence(F.col("a"), F.col("b")).alias("n"), sequence_diff(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.n for r in rows] == [2, 0]
    assert rows[1].d.added == 1 and rows[1].d.similarity == 0.0


@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_subsequence_length(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    assert subsequence_length(a, b) == table[-1, -1]


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (r"(?i)\b(?:often|perhaps)\b", ["often", "perhaps"]),
        (r"(?i)\bmay (?:Help|lead)\b", ["may "]),
        (r"(?:abc)?d*", []),
        (r"(?:abc|\d+)", []),
        (r"(?!abc)x", []),
        (r"(?i)\bÉtoile", ["toile"]),
        (r"[\p{L}]+abc", []),
    ],
)
def test_needed_strings(pattern, want):
    assert needed(pattern) == want


@pytest.mark.parametrize("name", ["MARKERS", "HEDGES", "TRANSITIONS", "STRUCTURES", "CHATBOT", "RHETORIC", "VAGUE", "PROVENANCE", "CLAIMS", "INFORMAL", "ANONYMITY"])
def test_matches_hold_a_needed_string(name):
    for pattern in getattr(signals, name):
        parts = needed("(?i)" + pattern)
        for snippet in signals.SNIPPETS:
            for found in re.finditer("(?i)" + pattern, snippet):
                assert not parts or any(p in found.group().lower() for p in parts)


@pytest.mark.parametrize(
    ("text", "edits", "want"),
    [
        ("a pivotal role", [(2, 14, "important role")], "an important role"),
        ("An old tool", [(3, 6, "new")], "A new tool"),
        ("abcd", [(0, 2, "x"), (1, 3, "y")], "xcd"),
        ("abc", [], "abc"),
    ],
)
def test_edits(text, edits, want):
    assert edited(text, edits) == want


def test_cleanup_refuses_protected_text(spark):
    frame = spark.createDataFrame([(1, 'We utilize "robust" tools and a robust plan.'), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in cleanup(frame).collect()}
    assert rows[1].revised == 'We use "robust" tools and a reliable plan.'
    assert [e.reason for e in rows[1].refused] == ["quotation"]
    assert rows[2].edits == [] and rows[2].revised == ""
    with pytest.raises(ValueError):
        cleanup(frame, "longer")


def test_hashed_vectors_and_top_k(spark):
    import zlib

    texts = {1: "red cat", 2: "Red, cat!", 3: "blue dog runs", 4: ""}
    vectors = {r.doc_id: np.array(r.vector) for r in hashed_vectors(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = np.zeros(128)
    for term, weight in (("red", 1.0), ("cat", 1.0), ("red_cat", 1.5)):
        h = zlib.crc32(term.encode())
        want[h % 128] += weight if h % 2 == 0 else -weight
    assert np.allclose(vectors[1], want / np.linalg.norm(want)) and np.allclose(vectors[1], vectors[2])
    assert not vectors[4].any()
    frame = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors.items()], "doc_id long, vector array<double>")
    best = {(r.query_id, r.place): (r.id, r.similarity) for r in top_k(frame.filter("doc_id = 1"), frame, "doc_id", "vector", 2).collect()}
    assert best[1, 1] == (2, 100.0)


def docx(paragraphs):
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    body += "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document {space}><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_corpus_scan(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿plain é".encode())
    (tmp_path / "b.txt").write_bytes("latin é".encode("latin-1"))
    (tmp_path / "c.tex").write_text("\\section{Head} % gone\n\\cite{key} and $x$ \\textbf{bold}")
    (tmp_path / "d.ipynb").write_text(json.dumps({"cells": [{"cell_type": "markdown", "source": ["# Hi"]}, {"cell_type": "code", "source": ['"""Doc."""\n', "x = 1"]}]}))
    (tmp_path / "e.docx").write_bytes(docx(["one", "two"]))
    (tmp_path / "f.docx").write_bytes(b"broken")
    (tmp_path / "g.exe").write_bytes(b"no")
    (tmp_path / "h.txt").write_bytes(b"  ")
    found = {r.filename: r.text for r in readers.scan_corpus(spark, str(tmp_path)).collect()}
    assert found == {"a.txt": "plain é", "b.txt": "latin é", "c.tex": "Head \n(key, 2024) and [Math] bold", "d.ipynb": "# Hi\n\nDoc.", "e.docx": "one\n\ntwo\n\nx y"}
    files = spark.read.format("binaryFile").load(str(tmp_path))
    states = {r.filename: r.status for r in readers.extract_text(files).collect()}
    assert states["f.docx"] == "unreadable" and states["g.exe"] == "unsupported" and states["h.txt"] == "empty"


def test_docx_blocks(spark):
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda text, mark="": f"<w:r><w:rPr>{mark}</w:rPr><w:t>{text}</w:t></w:r>"
    body = f'<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr>{run("Head")}</w:p><w:tbl><w:tr><w:tc><w:p>{run(" x ")}</w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>'
    body += f'<w:p>{run("ab", "<w:b/>")}{run("cd", "<w:i/>")}{run("ef", "<w:b w:val=&quot;0&quot;/>".replace("&quot;", chr(34)))}</w:p><w:p/><w:p><w:pPr><w:pStyle w:val="ListBullet"/></w:pPr>{run("item")}</w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
    files = spark.createDataFrame([("a.docx", bytearray(out.getvalue())), ("b.docx", bytearray(b"no")), ("c.docx", None)], "path string, content binary")
    rows = readers.docx_blocks(files).orderBy("block_no").collect()
    assert [(r.block_no, r.kind, r.text, r.heading_level, r.start, r.end) for r in rows] == [
        (1, "heading", "Head", 2, 0, 4), (2, "paragraph", "abcdef", None, 6, 12), (3, "list_item", "item", None, 14, 18), (4, "table_cell", "x", None, 20, 21),
    ]
    assert rows[1].bold_spans == [[0, 2]] and rows[1].italic_spans == [[2, 4]]


def test_changed_sources(spark, tmp_path):
    for name in ("a.txt", "b.txt", "c.txt", "d.exe"):
        (tmp_path / name).write_text(name)
    known = spark.createDataFrame(readers.signatures(spark, str(tmp_path)).collect())
    assert readers.changed_sources(known, known).count() == 0
    (tmp_path / "a.txt").write_text("another length")
    (tmp_path / "b.txt").unlink()
    (tmp_path / "e.md").write_text("new")
    rows = readers.changed_sources(known, readers.signatures(spark, str(tmp_path))).collect()
    assert {(r.path.rsplit("/", 1)[1], r.change) for r in rows} == {("a.txt", "changed"), ("b.txt", "removed"), ("e.md", "added")}


def test_archives_and_corpus_changes(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("x/a.txt", "hello")
        archive.writestr("__MACOSX/a.txt", "no")
        archive.writestr(".hidden.txt", "no")
    rows = readers.unzip(spark.createDataFrame([("z.zip", bytearray(out.getvalue())), ("bad.zip", bytearray(b"no"))], "path string, content binary")).collect()
    assert {(r.archive, r.path, r.error) for r in rows} == {("z.zip", "x/a.txt", None), ("bad.zip", None, "The uploaded file is not a valid ZIP archive.")}
    corpus = spark.createDataFrame([("a", "1")], "source_key string, text string")
    new = spark.createDataFrame([("a", "2"), ("b", "3"), ("b", "3")], "source_key string, text string")
    assert [r.source_key for r in readers.addable_sources(corpus, new).collect()] == ["b"]
    assert readers.delete_source(corpus, "a").count() == 0
    positions = spark.createDataFrame([({"world": [1], "hello": [0, 2]},)], "m map<string,array<int>>")
    assert positions.select(readers.inverted_to_text(F.col("m"))).first()[0] == "hello world hello"


def test_report_marks_united_spans(spark):
    rows = spark.createDataFrame([(1, "a<b cd ef", [(4, 6), (0, 3), (3, 5)], 12.5)], "doc_id long, text string, spans array<struct<start:int,end:int>>, overall_similarity double")
    html = sinks.html_reports(rows).first().html
    assert html.endswith("<p><mark>a&lt;b cd</mark> ef</p>") and "12.50 %" in html


def test_streams(spark, sf_dir, tmp_path):
    docs = spark.createDataFrame([(1, "red blue green white black"), (2, "nothing here")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    corpus = spark.createDataFrame([(7, "blue green white black")], "item_id long, text string")
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    query = stream_overlap(stream, corpus).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r.doc_id, r.item_id, r.i) for r in spark.table("found").collect()] == [(1, 7, 1)]
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert windowed_events(events).agg(F.sum("n")).first()[0] == events.count()


def test_boundaries_see_all_letters_in_both_dialects(spark):
    import duckdb

    from inkspan.plans.dialect import DUCK, SPARK

    texts = ["Thshea Stteä", "Thshea Sttea ä", "édelve delve", "delve1 delvé", "2019年 2019", "été_delve", "don't delve-in"]
    for pattern, expected in ((r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b", [0, 1, 0, 0, 0, 0, 0]), (r"(?i)\bdelve\b", [0, 0, 1, 0, 0, 0, 1]), (r"\b(?:19|20)\d{2}\b", [0, 0, 0, 0, 1, 0, 0]), (r"^[\w-]+\b", [1, 1, 1, 1, 1, 1, 1])):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        assert [r[0] for r in rows.orderBy("i").selectExpr(SPARK.count("text", pattern)).collect()] == expected
        assert [duckdb.execute(f"SELECT {DUCK.count('t', pattern)} FROM (SELECT ? AS t)", [t]).fetchone()[0] for t in texts] == expected
        assert [len(re.findall(pattern, t)) for t in texts] == expected


def test_bad_files_are_rows(spark):
    def zipped(entries, method=zipfile.ZIP_DEFLATED):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", method) as archive:
            for name, content in entries:
                archive.writestr(name, content)
        return bytearray(out.getvalue())

    word = "<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:body><w:p><w:r><w:t>Hello there</w:t></w:r></w:p></w:body></w:document>"
    good = zipped([("word/document.xml", word)])
    encrypted = bytearray(good)
    encrypted[6] |= 1
    encrypted[good.index(b"PK\x01\x02") + 8] |= 1
    at = 30 + len("word/document.xml")
    broken = good[:at] + b"\xff" * 8 + good[at + 8 :]
    method = bytearray(good)
    method[8] = method[good.index(b"PK\x01\x02") + 10] = 99
    files = {
        "good.docx": good, "encrypted.docx": encrypted, "broken.docx": broken, "method.docx": method, "cut.docx": good[:50], "empty.docx": bytearray(), "null.docx": None, "xml.docx": zipped([("word/document.xml", "<w:document")]),
        "none.docx": zipped([("other.xml", "x")]), "many.docx": zipped([("word/document.xml", word)] + [(f"x{i}", "") for i in range(2000)], zipfile.ZIP_STORED), "huge.txt": bytearray(b"x" * ((8 << 20) + 1)), "blank.md": bytearray(b"  "), "prog.exe": good,
        "list.ipynb": bytearray(b"not json"),
    }
    rows = {r.path: r for r in readers.extract_text(spark.createDataFrame(list(files.items()), "path string, content binary")).collect()}
    unreadable = "Failed to read DOCX file. It may be corrupt, encrypted, or unsupported."
    assert rows["good.docx"].text == "Hello there" and rows["good.docx"].error is None and rows["list.ipynb"].text == "not json"
    for name in ("encrypted", "broken", "method", "cut", "empty", "null", "xml", "none"):
        assert (rows[f"{name}.docx"].status, rows[f"{name}.docx"].text, rows[f"{name}.docx"].error) == ("unreadable", None, unreadable), name
    assert (rows["many.docx"].status, rows["many.docx"].error) == ("too large", "DOCX expanded content exceeds extraction limits.")
    assert {n: rows[n].status for n in ("huge.txt", "blank.md", "prog.exe")} == {"huge.txt": "too large", "blank.md": "empty", "prog.exe": "unsupported"}
    assert readers.docx_blocks(spark.createDataFrame(list(files.items()), "path string, content binary")).count() == 1
    archives = {
        "ok.zip": zipped([("a/b.txt", "text"), ("__MACOSX/c.txt", "no"), ("d.exe", "no")]), "many.zip": zipped([(f"{i}.txt", "x") for i in range(101)]), "encrypted.zip": encrypted, "cut.zip": good[:50], "null.zip": None,
        "large.zip": zipped([("big.txt", b"0" * ((8 << 20) + 1))]), "sum.zip": zipped([(f"{i}.txt", b"0" * (8 << 20)) for i in range(5)]), "damaged.zip": zipped([("one.txt", "first"), ("two.txt", "second" * 50)]),
    }
    archives["damaged.zip"][30 + len("one.txt")] ^= 0xFF
    found = {(r.archive, r.path, r.error) for r in readers.unzip(spark.createDataFrame(list(archives.items()), "path string, content binary")).collect()}
    invalid = "The uploaded file is not a valid ZIP archive."
    assert found == {
        ("ok.zip", "a/b.txt", None), ("many.zip", None, "Archive contains too many entries (maximum 100)."), ("encrypted.zip", None, "Archive contains an oversized or encrypted entry."),
        ("cut.zip", None, invalid), ("null.zip", None, invalid), ("large.zip", None, "Archive contains an oversized or encrypted entry."), ("sum.zip", None, "Archive expanded size exceeds 32 MB."),
        ("damaged.zip", "one.txt", "The request could not be processed."), ("damaged.zip", "two.txt", None),
    }


def test_readability_rounds_as_its_sql(spark, tmp_path):
    """Grades whose exact value is a half: 0.39 * 296 + 11.8 - 15.59 = 111.65 is a little less as a double."""
    texts = [" ".join(["cat"] * n) for n in range(1, 400)] + [" ".join(["water"] * n) for n in range(1, 200)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = {r.doc_id: r.fk_grade_level for r in catalogue.QUERIES["readability"](spark, str(tmp_path)).collect()}
    assert found == dict(con.execute(f"SELECT doc_id, fk_grade_level FROM ({catalogue.ORACLES['readability']})").fetchall())
    assert found[295] == 111.7


def test_batches_are_cut_before_their_results_are_made():
    """Ten thousand texts of a batch are never held with all their results; every row stays, in order."""
    texts = pd.Series(["x" * 5000] * 700 + ["y" * (3 << 20), None, ""] + ["z"] * 1000)
    pieces = list(in_pieces(pd.Series(range(len(texts))), texts))
    assert [i for ids, _ in pieces for i in ids] == list(range(len(texts)))
    assert all(len(t) <= HELD_ROWS and (len(t) == 1 or sum(len(x or "") for x in t) <= HELD) for _, t in pieces)
    assert [len(t) for (t,) in in_pieces(pd.Series([], dtype=object))] == [0]


def test_spans_and_docx_files_of_a_batch_in_pieces(spark, monkeypatch):
    from inkspan.functions import udfs

    monkeypatch.setattr(udfs, "HELD_ROWS", 3)
    rows = [(i, None if i == 7 else "ab " * i) for i in range(20)]
    frame = spark.createDataFrame(rows, "i int, t string").coalesce(1)
    assert {r.i: len(r.s) for r in frame.select("i", find_spans(F.col("t"), {"x": "ab"}).alias("s")).collect()} == {i: 0 if i == 7 else i for i in range(20)}
    files = frame.select("i", F.format_string("/in/%d.docx", "i").alias("path"), F.lit(b"no file").alias("content"))
    assert {r.status for r in readers.extract_text(files).collect()} == {"unreadable"}
    assert readers.unzip(files).count() == 20


def test_words_and_shingles_of_a_text_are_not_shuffled(spark, tmp_path):
    texts = ["a b c d a b c d e", "", None, "one two", "one two three four", "w " * 50]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    shingles = catalogue.QUERIES["shingle_counts"](spark, str(tmp_path))
    assert {r.doc_id: r.shingles for r in shingles.collect()} == {0: 5, 1: 0, 2: 1, 3: 1, 4: 1, 5: 1}
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Join" not in plan(shingles) and "Aggregate" not in plan(shingles)
    whole = catalogue.QUERIES["inverted_documents"](spark, str(tmp_path))
    assert "hashpartitioning(doc_id" in plan(whole) and ", w#" not in "".join(x for x in plan(whole).split("\n") if "hashpartitioning" in x)


def test_length_of_a_hashed_vector_is_taken_once(spark):
    vectors = hashed_vectors(spark.createDataFrame([(1, "one two"), (2, "")], "doc_id long, text string"))
    assert vectors._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    lengths = {r.doc_id: sum(x * x for x in r.vector) for r in vectors.collect()}
    assert lengths[1] == pytest.approx(1) and lengths[2] == 0


def test_pattern_signals_put_a_text_in_lower_case_once(spark, tmp_path):
    """A text that no claim can be in isn't cut into sentences to look for them; one with some still has them."""
    texts = [(0, "No more."), (1, "Studies show it.  Studies show it. Most people agree here. "), (2, None), (3, " \t. Studies show it (Smith, 2020).")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = signals.pattern_evidence(SPARK)
    assert plan.count("lower(text)") == 1
    assert signals._in_row(SPARK).count("lower(text)") == 1
    found = query(signals.specificity)(spark, str(tmp_path)).orderBy("doc_id").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    held = con.execute(signals.specificity(DUCK) + " ORDER BY t.doc_id").fetchall()
    assert [tuple(r) for r in found if r.doc_id != 2] == [r for r in held if r[0] != 2] and found[1].unanchored == 3


def test_vectors_count_terms_in_their_row_and_queries_meet_rows_without_a_product_of_blocks(spark, tmp_path):
    import zlib

    long = "ж" * 90
    texts = [(1, "Naïve cat cat"), (2, f"one {long} two {long}"), (3, None), (3, "x y"), (3, " z_1\u00a0\u0085q "), (None, "a"), (None, "b c"), (4, "--- ...")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    want = {}
    for key, text in texts:
        words = re.sub(r"[^\w\s]|[^\S \t\n\r\f\v]|[\x1c-\x1f\x85\xa0]", " ", (text or "").lower()).split()
        sums = want.setdefault(key, np.zeros(128))
        for term, weight in [(w, 1.0) for w in words] + [(a + "_" + b, 1.5) for a, b in zip(words, words[1:])]:
            h = zlib.crc32(term.encode())
            sums[h % 128] += weight if h % 2 == 0 else -weight
    found = hashed_vectors(frame).collect()
    assert len(found) == len(want)
    for r in found:
        assert np.allclose(r.vector, want[r.doc_id] / max(np.linalg.norm(want[r.doc_id]), 1e-9)), r.doc_id
    nested = hashed_vectors(frame.selectExpr("struct(doc_id, 1 AS n) AS key", "text"), "key").collect()
    assert {r.key.doc_id: r.vector for r in nested} == {r.doc_id: r.vector for r in found} and len(nested) == len(found)
    frame.filter("doc_id < 3").selectExpr("doc_id * 50 AS doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    best = catalogue.QUERIES["document_topk"](spark, str(tmp_path))
    plan = best._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "posexplode" not in plan and plan.count("FileScan") == 2
    assert sorted((r.query_id, r.id, r.place) for r in best.collect()) == [(50, 100, 1), (100, 50, 1)]


@pytest.mark.parametrize("tile", [7, 64])
def test_nearest_rows_are_those_of_all_pairs(spark, monkeypatch, tile):
    """With copies, rows of no similarity, vectors of nothing, ties that the smaller id wins, and fewer rows than places."""
    rng = np.random.default_rng(tile)
    x = rng.integers(-1, 2, (150, 16)).astype(float)
    x[40:60], x[60:75], x[75] = x[0], 0, -x[0]
    ids = rng.permutation(150) * 3
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    asked = np.flatnonzero(ids % 2 == 0)

    def best(rows, k):
        s = np.round(np.clip(100 * np.einsum("id,jd->ij", unit[asked], unit[rows]), 0, 100), 2)
        pairs = {(q, i): s[a, b] for a, q in enumerate(ids[asked]) for b, i in enumerate(ids[rows]) if q != i}
        return {q: sorted(((-v, i) for (p, i), v in pairs.items() if p == q))[:k] for q in ids[asked]}

    monkeypatch.setattr(vectors, "ROW_TILE", tile)
    monkeypatch.setattr(vectors, "QUERY_TILE", 11)
    monkeypatch.setattr(vectors, "PAIRS", 5)
    for rows, k in ((np.arange(150), 5), (np.arange(3), 5), (np.arange(55, 90), 2)):
        nearest = vectors.Nearest(ids[asked], x[asked], k)
        nearest.add(ids[rows], x[rows])
        found = {q: [(-v, i) for v, i in zip(s, n) if v >= 0] for q, s, n in zip(nearest.queries, nearest.similarity, nearest.ids)}
        assert found == best(rows, k)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 20)
    monkeypatch.setattr(vectors, "LEAST_ROWS", 40)
    frame = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "doc_id long, vector array<double>")
    found = vectors.top_k(frame.filter("doc_id % 2 = 0"), frame, "doc_id", "vector", 5)
    assert sorted((r.query_id, r.place, -r.similarity, r.id) for r in found.collect()) == sorted((q, n + 1, *row) for q, rows in best(np.arange(150), 5).items() for n, row in enumerate(rows))
    assert vectors.top_k(frame.limit(0), frame, "doc_id", "vector").count() == 0 and vectors.top_k(frame, frame.limit(0), "doc_id", "vector").count() == 0


def test_text_scan_tells_what_plain_code_does():
    """Marks, joints, letters that become two in lower case, short sentences, and strings of one to many bytes, held and not."""
    texts = ["", "İ a.b'c1 x.  ab.. é! éé..  ab. \tabc!\n\n\x0b\nstudies show’s it’s1 many people— [a] --x", "don't can’t 'x' a'b'c a'1", "Many people\tagree. " * 40 + "\n \n" + "w " * 34 + "\n\nİİ " + "W2 " * 35]
    needs, vague, spaces = [("—",), ("[",), ("studies show", "zz"), ("peo", "--"), ("delve",), ("bc",)], ["many people", "studies show", "absent"], " \t\n\r\x0b\f"
    of, word = TextScan(needs, vague, 35, 40), re.compile(PATTERN_WORD).findall
    for text in texts:
        low, sentences = text.lower(), re.findall(PATTERN_SENTENCE, text)
        lengths = [len(word(x.lower())) for x in sentences if len(x.strip(spaces)) >= 4]
        long = [i for i, x in enumerate(re.split(r"\n[ \t\n\x0b\f\r]*\n", text)) if len(word(x.lower())) >= 35] if len(word(low)) >= 40 else []
        assert of(text, low) == (len(word(low)), lengths, long, [x for x in sentences if any(v in x.lower() for v in vague)], [any(p in low for p in parts) for parts in needs])
    assert of(None, None) == (None,) * 5


def test_check_summary_looks_for_patterns_once(spark, tmp_path):
    """And has DuckDB's rows, with more marks than fixes, open claims only, ties of signals, joints, and texts of nothing."""
    texts = [
        "", "No more.", "[TODO] and [TBD] and [your name] and [client name] here. We delve into a tapestry.", "Studies show it is so for all of us.", "It's a robust plan. Perhaps it's not just fast but simple. Certainly! In conclusion, we utilize it.",
        "Furthermore, it helps. " * 30 + "\n\n" + "plain words " * 40, "Studies show it’s so, says Smith (2020). It is known that 45% of users agree.\nReferences\nSmith, A. (2020). A book about tests.", "[TODO] Research suggests that it is widely known to most people.",
    ]
    spark.createDataFrame([(26 * k, t) for k, t in enumerate(texts)] + [(7, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a book about tests of plain words here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    summary = query(review.check_summary)(spark, str(tmp_path))
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Relation [doc_id") <= 4
    found = {r.doc_id: tuple(r) for r in summary.collect()}
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    held = {r[0]: r for r in con.execute(review.check_summary(DUCK)).fetchall()}
    assert {k: v for k, v in found.items() if k != 7} == {k: v for k, v in held.items() if k != 7} and len(found) == len(texts) + 1
    assert found[52][-1] == ",".join(["critical:provenance"] * 3) and found[78][-1].endswith("high:citation") and found[7][-2:] == (0, "")


def test_patterns_pass_by_places_of_another_sign_only_where_case_is_ignored():
    assert SPARK.pattern(r"(?i)\bnot here").startswith('r"(?i)(?=[n])') and "(?=[" not in SPARK.pattern(r"\b(?:Department|University) of").split("(?:")[0]
    assert "(?=[" not in SPARK.pattern(r"(?i)\b[A-Z]+x") and SPARK.pattern(r"(?i)\b(?:a|Bc|de)").startswith('r"(?i)(?=[abd])')


def test_copies_of_one_vector_are_bounded(monkeypatch):
    """Of equal rows only the first places + 1 by id meet queries; near copies are looked at again a few pairs at a time."""
    x = np.random.default_rng(1).normal(size=(1, 16)).repeat(3000, axis=0)
    x[1500:] += 1e-9 * np.arange(1500)[:, None]
    nearest, ids, pairs = vectors.Nearest(np.arange(3000), x, 5), np.arange(3000), []
    assert len(nearest.apart(ids, x)) == 6 + 1499
    meet = nearest.meet
    monkeypatch.setattr(nearest, "meet", lambda q, ids, rows, r: (pairs.append(len(q)), meet(q, ids, rows, r)))
    nearest.add(ids, x)
    assert max(pairs) <= vectors.PAIRS
    assert nearest.ids[0].tolist() == [1, 2, 3, 4, 5] and nearest.ids[3].tolist() == [0, 1, 2, 4, 5] and nearest.ids[2999].tolist() == [0, 1, 2, 3, 4]
