"""The island plan against seed and extend, word by word, on small alphabets."""

import random

import pytest

from inkspan.plans import overlap
from inkspan.plans.dialect import SPARK


def brute_force(words, sources):
    """Covered positions by source: from every window that counts, the longest equal run, first source position on ties."""
    cover = {}
    for key, other in sources.items():
        for i in range(len(words) - 3):
            window = words[i : i + 4]
            if sum(w not in overlap.COMMON for w in window) < 2:
                continue
            best = None
            for j in range(len(other) - 3):
                if other[j : j + 4] != window:
                    continue
                low, high = 0, 4
                while i - low > 0 and j - low > 0 and words[i - low - 1] == other[j - low - 1]:
                    low += 1
                while i + high < len(words) and j + high < len(other) and words[i + high] == other[j + high]:
                    high += 1
                if best is None or low + high > best[1] - best[0]:
                    best = (i - low, i + high)
            if best:
                cover.setdefault(key, set()).update(range(*best))
    return cover


def run(spark, docs, corpus, plan):
    spark.createDataFrame(docs, "doc_id long, text string").createOrReplaceTempView("t_docs")
    spark.createDataFrame(corpus, "item_id long, text string").createOrReplaceTempView("t_corpus")
    sql = plan(SPARK).replace("FROM documents", "FROM t_docs").replace("FROM benchmark", "FROM t_corpus")
    return spark.sql(sql).collect()


def test_matches_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["the", "of", "red", "blue", "cat"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(60)]
    corpus = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for i in range(6)]
    found = {}
    for r in run(spark, docs, corpus, overlap.overlap_by_source):
        found[r.doc_id, r.source_id] = r.common_words
    sources = {i: t.split() for i, t in corpus}
    want = {(i, key): len(ks) for i, t in docs for key, ks in brute_force(t.split(), sources).items()}
    assert found == want


@pytest.mark.parametrize(
    ("text", "source", "matched", "total"),
    [
        ("alpha beta gamma delta epsilon one two three four five six seven", "alpha beta gamma delta epsilon", 5, 12),
        ("the of and in to for", "the of and in to for", 0, 6),
        ("alpha beta gamma", "alpha beta gamma", 0, 3),
        ("", "alpha beta gamma delta", 0, 0),
        ("Étoile brille fort ici", "étoile BRILLE fort ici", 4, 4),
        ("same words again here", "same words again here", 4, 4),
    ],
)
def test_known_overlaps(spark, text, source, matched, total):
    (row,) = run(spark, [(1, text)], [(1, source)], overlap.overlap_scores)
    assert (row.matched_words, row.total_words) == (matched, total)
    assert row.overall_similarity == (round(100 * matched / total, 2) if total else 0.0)
