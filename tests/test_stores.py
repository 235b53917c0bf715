"""Stored tables: whole versions, failing writers, other writers and streams."""

import datetime
import os
import time

import pytest
from pyspark.sql import functions as F

from inkspan.sources import snapshots, stores
from inkspan.sources.snapshots import Snapshots

SCHEMA = "k string, n long"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def content(store):
    return sorted((r.k, r.n) for r in store.read().collect())


def test_versions_hold_whole_changes(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), SCHEMA, "k", 4)
    assert store.version() == 0 and content(store) == []
    assert sorted(r.k for r in store.insert_new(rows(spark, ("a", 2), ("a", 1), ("b", 3), (None, 9)), "n").collect()) == ["a", "b"]
    assert content(store) == [("a", 1), ("b", 3)] and store.version() == 1
    assert store.insert_new(rows(spark, ("a", 0))).count() == 0 and store.version() == 1  # nothing new: no version
    assert store.replace(rows(spark, ("b", 4), ("c", 5)), rows(spark, ("a", 0), ("x", 0))) == 2
    assert content(store) == [("b", 4), ("c", 5)] and sorted(map(tuple, store.read(1).collect())) == [("a", 1), ("b", 3)]
    store.append(rows(spark, ("c", 6)))
    assert content(Snapshots(spark, str(tmp_path), SCHEMA, "k", 4)) == [("b", 4), ("c", 5), ("c", 6)]


def test_a_failing_writer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = Snapshots(spark, str(tmp_path), SCHEMA, "k", 4)
    store.insert_new(rows(spark, ("a", 1)))
    with pytest.raises(Exception, match="broken"):
        store.insert_new(rows(spark, ("b", 1)).withColumn("n", F.raise_error(F.lit("broken")).cast("long")))
    assert content(store) == [("a", 1)] and store.version() == 1
    monkeypatch.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("no space")))
    with pytest.raises(OSError, match="no space"):
        store.replace(rows(spark, ("a", 2)))
    assert content(store) == [("a", 1)] and content(Snapshots(spark, str(tmp_path), SCHEMA, "k", 4)) == [("a", 1)]


def test_writers_that_meet_lose_nothing(spark, tmp_path, monkeypatch):
    one, two = (Snapshots(spark, str(tmp_path), SCHEMA, "k", 4) for _ in range(2))
    one.insert_new(rows(spark, ("a", 1)))
    written, met = one._written, []

    def late(frame):
        if not met:
            met.append(two.insert_new(rows(spark, ("b", 2), ("c", 2))).count())
        return written(frame)

    monkeypatch.setattr(one, "_written", late)
    assert [r.k for r in one.insert_new(rows(spark, ("b", 3), ("d", 3))).collect()] == ["d"]  # b came first from the other
    assert content(one) == [("a", 1), ("b", 2), ("c", 2), ("d", 3)]
    monkeypatch.setattr(one, "_publish", lambda *a: False)
    monkeypatch.setattr(snapshots, "ATTEMPTS", 2)
    with pytest.raises(snapshots.Conflict):
        one.append(rows(spark, ("e", 1)))


def test_a_batch_is_applied_once(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), SCHEMA, "k", 4)
    assert store.replace(rows(spark, ("a", 1)), stream="s", batch=0) == 1
    assert store.replace(rows(spark, ("a", 2)), stream="s", batch=0) == 1 and content(store) == [("a", 1)]
    assert store.replace(rows(spark, ("a", 3)), stream="s", batch=1) == 2 and content(store) == [("a", 3)]


def test_sources_are_validated_and_never_overwritten(spark, tmp_path):
    store = stores.corpus_store(spark, str(tmp_path))
    files = [("keep.txt", b"original content"), ("../out.txt", b"x"), ("a\\b.txt", b"x"), ("", b"x"), ("no.exe", b"x"), ("blank.md", b"  "), ("bad.docx", b"zip"), ("two.txt", b"b"), ("two.txt", b"a"), (None, b"x")]
    frame = lambda f: spark.createDataFrame([(p, bytearray(c)) for p, c in f], "path string, content binary")
    told = sorted((str(r.source_key), r.status, r.error) for r in stores.add_sources(store, frame(files)).collect())
    name = "Invalid source filename."
    assert told == sorted([
        ("keep.txt", "added", None), ("../out.txt", "rejected", name), ("a\\b.txt", "rejected", name), ("", "rejected", name), ("no.exe", "rejected", name), ("None", "rejected", name), ("blank.md", "rejected", "Source contains no extractable text."),
        ("bad.docx", "rejected", "Failed to read DOCX file. It may be corrupt, encrypted, or unsupported."), ("two.txt", "added", None), ("two.txt", "exists", None),
    ], key=lambda t: (t[0], t[1], t[2]))
    assert [(r.status, r.error) for r in stores.add_sources(store, frame([("keep.txt", b"replacement")])).collect()] == [("exists", None)]
    assert {r.source_key: r.text for r in store.read().collect()} == {"keep.txt": "original content", "two.txt": "a"}
    version = store.version()
    assert stores.delete_sources(store, spark.createDataFrame([("two.txt",), ("../out.txt",), ("none.txt",)], "source_key string")) == version + 1
    assert [r.source_key for r in store.read().collect()] == ["keep.txt"]


def test_a_second_reader_sees_what_a_stream_follows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    store, second = (stores.corpus_store(spark, str(tmp_path / "store")) for _ in range(2))
    seen = lambda: {r.source_key: r.text for r in second.read().collect()}
    (folder / "a.txt").write_text("first text")
    (folder / "skip.exe").write_text("no")
    query = stores.follow(spark, str(folder), store, str(tmp_path / "ticks"), every="1 second")

    def wait(expected):
        until = time.time() + 60
        while seen() != expected and time.time() < until and query.exception() is None:
            time.sleep(0.5)
        assert query.exception() is None and seen() == expected

    try:
        wait({"a.txt": "first text"})
        (folder / "b.md").write_text("second text")
        wait({"a.txt": "first text", "b.md": "second text"})
        (folder / "a.txt").write_text("first text, changed")
        os.remove(folder / "b.md")
        wait({"a.txt": "first text, changed"})
        version = second.version()
        time.sleep(3)
        assert second.version() == version  # ticks without a change make no version
    finally:
        query.stop()


def test_two_runs_leave_one_row_an_address(spark, tmp_path):
    store = stores.address_store(spark, str(tmp_path))
    day = datetime.datetime(2024, 1, 1)
    frame = spark.createDataFrame(
        [(" Ann@Example.org", day + datetime.timedelta(2), None), ("ann@example.org ", day, "x" * 100), ("bob@example", day, "s"), ("a b@c.de", day, "s"), (None, day, "s"), ("x" * 250 + "@y.de", day, "s")], "email string, consented_at timestamp, source string"
    )
    for status in ("added", "exists"):
        told = [(r.email, r.status) for r in stores.subscribe(store, frame).collect()]
        assert sorted(s for e, s in told if e == "ann@example.org") == [status] * 2 and all(s == "rejected" for e, s in told if e != "ann@example.org")
    [row] = store.read().collect()
    assert (row.email, row.consented_at, row.source) == ("ann@example.org", day, "x" * 80)
