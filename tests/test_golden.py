"""Plans over hand-made documents, against rows worked out by hand."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from inkspan.operators.patterns import evidence, flagged_sentences
from inkspan.operators.revision import cleanup
from inkspan.plans import overlap, review, signals, tables
from inkspan.plans.dialect import DUCK, SPARK, query, views

REFERENCES = "\nReferences\n[1] Smith, J. (2019). A first entry.\n[2] Brown, C. (2021). A second entry.\nJonesson, K. (2018). Another author's entry.\n"
DOCUMENTS = {
    1: "We saw [1, 2] and then [1, 3]. As Jones (2018) said, and (Smith, 2019) too." + REFERENCES,
    2: "a -- b -- c --- d\t--\te --f",
    3: "Abstract\nThis study examines a dataset. It is crucial.\nMethods\nWe looked.",
    4: "My Title\n\nAnn Author\n\n" + "One plain paragraph of many words follows here and it goes on for quite a while so that twenty words are there. Yes.\n\n2. Results\nNone.",
    5: "Nothing located here",
    6: "",
    7: "alpha beta gamma delta epsilon zeta eta theta. Then \"alpha beta gamma delta\" was quoted (Lee, 2020). Unrelated words stand at the end.",
}
CORPUS = {10: "Alpha beta gamma delta epsilon zeta eta theta iota.", 11: "Wholly different words make up this item."}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("golden"))
    spark.createDataFrame([(k, t) for k, t in DOCUMENTS.items()], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in CORPUS.items()], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows(spark, folder, plan):
    """Rows of a plan over the documents as they are, by doc_id."""
    found = {}
    for r in spark.sql(views(spark, folder, plan(SPARK.plainly()))).collect():
        found.setdefault(r.doc_id, []).append(r)
    return found


def test_citations_link_by_all_their_numbers_and_by_whole_surnames(spark, folder):
    found = rows(spark, folder, signals.citation_links)[1][0]
    assert (found.citations, found.linked, found.unlinked, found.entries) == (4, 2, 2, 3)
    lone = {r.content for r in rows(spark, folder, signals.citations_without_reference)[1]}
    assert lone == {"1, 3", "Jones"}  # no entry 3, and Jonesson is another name
    assert [r.entry[:8] for r in rows(spark, folder, signals.uncited_references)[1]] == ["Jonesson"]


def odd_documents(spark, path):
    """Documents with several headers, marks of our own, entries over many lines, numbers that two entries have, and no text."""
    references = "\n## References:\n[1] Smith, J. (2019). A first\n   entry of two lines.\n\n[2] Short.\n[1] Other, A. (2020). Has the same number.\nBibliography\nDoe, J. (2020). Behind a second header.\nlower line goes on\r\n* Star, S. (2018). An entry with a star."
    texts = {
        0: None, 13: "", 26: "Plain [1] words (Smith, 2019; Doe, 2020) and Star (2018), (Nobody, 1999)." + references, 39: "A mark \x03 of ours [1]." + references,
        52: "References\nSmith, J. (2019). The text begins with its header (Smith, 2019).", 65: "According to recent data [1], 12% of them agree et al.   \n\nIt is known here (Lee 12). Studies show; short.\n \nResearch\x01suggests no claim at all, it is\nproven by none.",
        78: "References to [7] inside a line, but no header. İt is known that 5 percent of (smith, 2020) fail.", 91: "Works  cited\n1. Jones, A. (2019). A numbered entry.\n\n\x03\nJones", 104: "As Jones (2019) says [1-2], [1] and [9].\nReference list\n1. Jones, A. (2019). A numbered entry.\n",
    }
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(10, "12% of them agree et al. it is known")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


PARTED = ("citation_links", "uncited_references", "citations_without_reference", "bibliography_entries", "duplicate_references", "alphabetized_references", "citation_scan", "claims", "unsupported_claims", "evidence_score")


def test_parted_texts_have_the_rows_of_their_sql(spark, tmp_path):
    odd_documents(spark, str(tmp_path))
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    for name in PARTED:
        found = query(signals.PLANS[name])(spark, str(tmp_path))
        stated = con.execute(signals.PLANS[name](DUCK))
        order = [found.columns.index(c[0]) for c in stated.description]
        key = lambda row: tuple(map(str, row))
        assert sorted((tuple(r[i] for i in order) for r in found.collect()), key=key) == sorted(stated.fetchall(), key=key), name


def test_citations_of_a_style_hold_its_signs():
    for pattern, signs in zip(signals.CITATIONS.values(), signals.OPENED.values(), strict=True):
        text = "As Jones (2019) argues [1, 2], see (Miller 23) or (Brown et al., 2021) or Lee; Lee, 2020;"
        found = [m.group() for m in re.finditer(pattern, text)]
        assert found and all(any(s in m for s in signs) for m in found)


def test_claims_and_links_read_a_text_once(spark, folder):
    """Once for their own, once for the passages that the source quality comes from; the joins of the SQL would read it a dozen times."""
    reads = {"evidence_score": 2, "citation_links": 1, "uncited_references": 1, "citations_without_reference": 1, "citation_scan": 1}
    for name, times in reads.items():
        plan = spark.sql(views(spark, folder, signals.PLANS[name](SPARK)))._jdf.queryExecution().sparkPlan().toString()
        assert len(re.findall(r"FileScan parquet \[doc_id#\d+L,text#\d+\]", plan)) == times, name


def test_arrays_of_texts_are_made_once(spark, folder):
    """Not once more for a filter on their size, which Catalyst puts before the explosion of a named array."""
    for name in ("bibliography_entries", "citation_scan", "claims", "uncited_references", "citations_without_reference"):
        plan = spark.sql(views(spark, folder, signals.PLANS[name](SPARK)))._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"(?m)^[ :+-]*Filter ", plan), name


def test_citations_have_places(spark, folder):
    found = {(r.style, r.raw): r.start_offset for r in rows(spark, folder, signals.citation_scan)[1]}
    text = DOCUMENTS[1]
    assert found[("IEEE", "[1, 2]")] == text.index("[1, 2]") and found[("IEEE", "[1, 3]")] == text.index("[1, 3]")
    assert found[("APA_PAREN", "(Smith, 2019)")] == text.index("(Smith")


def test_double_dashes_stand_between_spaces(spark, folder):
    assert rows(spark, folder, signals.pattern_evidence)[2][0].double_dashes == 3


def test_texts_without_words_are_insufficient(spark, folder):
    found = rows(spark, folder, signals.pattern_scores)
    assert (found[6][0].pattern_band, found[6][0].reliability, found[6][0].points) == ("Insufficient Text", "insufficient", 0)
    assert found[5][0].reliability == "limited"
    assert rows(spark, folder, review.check_summary)[6][0].verdict == "insufficient_text"


def test_openings(spark, folder):
    found = {k: (r[0].label, r[0].opening) for k, r in rows(spark, folder, signals.openings).items()}
    assert found[3] == ("abstract", "This study examines a dataset. It is crucial.")
    assert found[4] == ("first substantial paragraph", "One plain paragraph of many words follows here and it goes on for quite a while so that twenty words are there. Yes.")
    assert found[5] == ("not located", "") and found[6] == ("not located", "")
    assert rows(spark, folder, signals.thesis_score)[3][0].score == 40 + 25 + 20 + 15


def test_sentences_have_passages_and_attribution(spark, folder):
    found = rows(spark, folder, overlap.overlap_sentences)[7]
    assert [(r.sentence_no, r.matched_words, r.words, r.source_id, r.is_quoted, r.citation) for r in found] == [(0, 8, 8, 10, False, ""), (1, 4, 9, 10, True, "(Lee, 2020)")]
    assert [(r.passage_start, r.passage_words, r.source_start) for r in found] == [(0, 8, 0), (9, 4, 0)]
    page = rows(spark, folder, overlap.match_page)[7]
    assert [r.attribution_status for r in page] == ["attribution_not_detected", "properly_attributed"]


def test_gradebook_has_errors_and_order(spark, folder):
    found = query(overlap.gradebook)(spark, folder).collect()
    assert found[0].doc_id == 7 and found[0].highest_matching_source == 10 and found[0].status == "success"
    assert [r.status for r in found if r.doc_id == 6] == ["error"]


def test_search_phrases(spark, folder):
    found = [r.phrase for r in rows(spark, folder, tables.search_phrases)[4]]
    assert found == ["One plain paragraph of many words follows here and it goes on"]


def test_longest_of_edits_at_one_place_is_made(spark):
    docs = spark.createDataFrame([(1, "We delve into a myriad of tools and leverage a robust plan."), (2, 'A "robust" plan, robust https://robust.org/x.'), (3, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in cleanup(docs, protected=["leverage"]).collect()}
    assert found[1].revised == "We look into many tools and leverage a reliable plan."
    assert {(e.original, e.reason) for e in found[1].refused} == {("leverage", "protected term: leverage")}
    assert found[2].revised == 'A "robust" plan, reliable https://robust.org/x.'
    assert {e.reason for e in found[2].refused} == {"quotation", "URL or DOI"} and found[3].edits == []
    shorter = cleanup(docs.filter("doc_id = 1"), length="shorter").first()
    assert [e.original for e in shorter.edits] == ["a myriad of"] and "excluded by shorter length mode" in {e.reason for e in shorter.refused}


def test_evidence_and_flags(spark):
    text = "Certainly! We delve into it. Studies show significant improvement. Plain words stand here."
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    found = evidence(docs).collect()
    assert {r.doc_id for r in found} == {1}
    assert {(r.category, r.text) for r in found} == {("predictability", "delve"), ("predictability", "delve into"), ("specificity", "Studies show significant improvement."), ("register", "Certainly!")}
    assert all(text[r.start_offset : r.end_offset] == r.text for r in found)
    assert {r.suggestion for r in found if r.category == "predictability"} == {"look into"}
    flags = flagged_sentences(docs).orderBy("start_offset").collect()
    assert [r.reasons for r in flags] == ["Assistant-style register", "Predictable vocabulary", "Specificity and grounding"]
    assert evidence(docs.filter(F.lit(False))).count() == 0
