"""Versions, the index, chained streams, quarantine and retained originals: runs that repeat, break and resume."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from bidloom.operators import index as I
from bidloom.operators.versions import Versions
from bidloom.sources import quarantine as Z
from bidloom.sources import retained as B
from bidloom.streaming import ingest


def counting(asked):
    """An embedding that notes the texts it sees."""

    def embed(texts):
        asked.append(sorted(r.text for r in texts.collect()))
        return texts.select("digest", F.array(F.length("text").cast("double")).alias("vector"))

    return embed


def chunks(spark, rows):
    return spark.createDataFrame([(o, i, t) for o, texts in rows.items() for i, t in enumerate(texts)], "owner_key string, chunk_index long, text string")


def state(spark, path):
    found = I.read_index(spark, path)
    out = {}
    for r in found.collect() if found else []:
        assert r.vector == [float(len(r.text))] and len(r.point_id) == 36
        out.setdefault(r.owner_key, {})[r.chunk_index] = r.text
    return {o: [t for _, t in sorted(c.items())] for o, c in out.items()}


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/chunks/**/*.parquet", recursive=True)}


def test_owners_replace_theirs(spark, tmp_path):
    path, asked = str(tmp_path / "index"), []
    embed = counting(asked)
    first = {f"o{i}": [f"text {i % 3}", f"own {i}"] for i in range(12)}
    assert I.read_index(spark, path) is None
    assert I.replace_owners(chunks(spark, first), path, embed, buckets=4) == 1
    assert state(spark, path) == first and asked[-1] == sorted({t for c in first.values() for t in c})
    # The same once more writes nothing; a shorter, a longer, a gone and a new owner are the only ones to change.
    before = files(path)
    assert I.replace_owners(chunks(spark, first), path, embed, buckets=4) is None and files(path) == before and len(asked) == 1
    change = {"o0": ["text 0"], "o1": ["text 1", "own 1", "more"], "new": ["own 5"]}
    given = spark.createDataFrame([("o0",), ("o1",), ("o2",), ("new",), ("never",)], "owner_key string")
    assert I.replace_owners(chunks(spark, change), path, embed, given, buckets=4) == 2
    want = {**first, **change}
    del want["o2"]
    assert state(spark, path) == want and asked[-1] == ["more"]
    assert I.replace_owners(chunks(spark, change), path, embed, given, buckets=4) is None
    # Files of the first version are as they were, and those of buckets without a change are still read.
    assert {f: t for f, t in files(path).items() if "version=1" in f} == before
    I.vacuum(spark, path)
    assert state(spark, path) == want


def test_other_owners_files_stay(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = {f"o{i}": [f"t{i}"] for i in range(40)}
    I.replace_owners(chunks(spark, rows), path, counting([]), buckets=16)
    before = files(path)
    I.replace_owners(chunks(spark, {"o3": ["changed"]}), path, counting([]), buckets=16)
    new = set(files(path)) - set(before)
    assert all(files(path)[f] == t for f, t in before.items()) and len({f.split("bucket=")[1].split("/")[0] for f in new}) == 1


def test_a_run_that_breaks_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    I.replace_owners(chunks(spark, {"a": ["x"], "b": ["y"]}), path, counting([]), buckets=2)

    def broken(self, version, rows):
        raise RuntimeError("lost before the manifest")

    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", broken)
        with pytest.raises(RuntimeError):
            I.replace_owners(chunks(spark, {"a": ["z"]}), path, counting([]), buckets=2)
    assert state(spark, path) == {"a": ["x"], "b": ["y"]}
    asked = []
    assert I.replace_owners(chunks(spark, {"a": ["z"]}), path, counting(asked), buckets=2) == 2
    assert state(spark, path) == {"a": ["z"], "b": ["y"]} and asked == [["z"]]


def test_all_owners_gone_and_rows_repeated(spark, tmp_path):
    path = str(tmp_path / "index")
    twice = chunks(spark, {"a": ["x"]}).union(chunks(spark, {"a": ["x"]}))
    I.replace_owners(twice, path, counting([]), buckets=2)
    assert I.read_index(spark, path).count() == 2
    assert I.replace_owners(chunks(spark, {"a": ["x"]}), path, counting([]), buckets=2) == 2  # one row fewer is a change
    gone = spark.createDataFrame([("a",)], "owner_key string")
    assert I.replace_owners(chunks(spark, {"a": ["x"]}).limit(0), path, counting([]), gone, buckets=2) == 3
    assert state(spark, path) == {}


def test_chunks_are_numbered_on_through_their_sources(spark):
    kind = "owner_key string, section string, page_number int, place int, text string"
    document = spark.createDataFrame([("a", "doc", 2, 0, "p2"), ("a", "doc", 1, 1, "p1b"), ("a", "doc", 1, 0, "p1a"), ("b", "doc", 1, 0, " "), ("b", "doc", 1, 1, "b1")], kind)
    story = spark.createDataFrame([("a", "story", 1, 0, "n"), ("b", "story", 1, 0, None)], kind)
    projects = spark.createDataFrame([("a", "past", 9, 0, "q9"), ("a", "past", 3, 0, "q3"), ("c", "past", 1, 0, "c")], kind)
    got = sorted((r.owner_key, r.chunk_index, r.text) for r in I.numbered_chunks([document, story, projects]).collect())
    assert got == [("a", 0, "p1a"), ("a", 1, "p1b"), ("a", 2, "p2"), ("a", 3, "n"), ("a", 4, "q3"), ("a", 5, "q9"), ("b", 0, "b1"), ("c", 0, "c")]


def test_payload_leaves_out_what_is_not_there(spark):
    df = spark.createDataFrame([("a", None, 0), ("b", 3, None)], "text string, page int, chunk_index int")
    assert [r.payload for r in I.payload(df, ["text", "page", "chunk_index"]).orderBy("text").collect()] == ['{"text":"a","chunk_index":0}', '{"text":"b","page":3}']


EVENTS = "event_id long, ts timestamp, job_id long, state string"


def put(spark, folder, rows):
    spark.createDataFrame(rows, "event_id long, at long, job_id long, state string").select("event_id", F.timestamp_seconds("at").alias("ts"), "job_id", "state").coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.01)


def both_streams(spark, tmp_path, chunks_of):
    (tmp_path / "events").mkdir()
    events = ingest.read_stream(spark, str(tmp_path / "events"), EVENTS, 1)
    states = ingest.job_states(events, "job_id", "ts", "state")
    return states, lambda: ingest.run_epochs(states, str(tmp_path / "states")), lambda: ingest.index_decided(spark, str(tmp_path / "states"), states.schema, "job_id", chunks_of, str(tmp_path / "indexed"))


def test_second_stream_resumes_after_a_stop(spark, tmp_path):
    """The states' stream runs alone, twice; the second stream then finds all of it, and again what came after."""
    chunks_of = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, None), (3, "d")], "job_id long, text string")
    states, one, two = both_streams(spark, tmp_path, chunks_of)

    def table():
        latest = ingest.latest_versions(spark, f"{tmp_path}/states/epochs", states.schema, ["job_id"])
        return sorted((r.job_id, r.state, r.index_state, r.chunks_indexed) for r in ingest.patched(latest, ingest.index_results(spark, f"{tmp_path}/indexed", "job_id long"), "job_id").collect())

    put(spark, f"{tmp_path}/events", [(1, 10, 1, "queued"), (2, 11, 2, "running"), (3, 12, 3, "succeeded")])
    one()
    put(spark, f"{tmp_path}/events", [(4, 20, 1, "succeeded"), (5, 21, 2, "succeeded"), (6, 22, 4, "succeeded")])
    one()  # stopped here: nothing is indexed yet
    assert not os.path.exists(f"{tmp_path}/indexed/epochs")
    two()
    assert table() == [(1, "succeeded", "ready", 2), (2, "succeeded", "failed", None), (3, "succeeded", "ready", 1), (4, "succeeded", "ready", 0)]
    put(spark, f"{tmp_path}/events", [(7, 30, 3, "running"), (8, 31, 5, "queued")])
    one()
    two()
    assert table() == [(1, "succeeded", "ready", 2), (2, "succeeded", "failed", None), (3, "running", None, None), (4, "succeeded", "ready", 0), (5, "queued", None, None)]


def test_an_epoch_that_breaks_is_tried_again(spark, tmp_path, monkeypatch):
    chunks_of = spark.createDataFrame([(1, "a")], "job_id long, text string")
    _, one, two = both_streams(spark, tmp_path, chunks_of)
    put(spark, f"{tmp_path}/events", [(1, 10, 1, "succeeded"), (2, 11, 2, "succeeded")])
    one()
    whole = ingest.run_epochs

    def breaking(stream, folder, write=None):
        def once(batch, epoch):
            write(batch, epoch)
            raise RuntimeError("lost after the files, before the checkpoint")

        whole(stream, folder, once)

    monkeypatch.setattr(ingest, "run_epochs", breaking)
    with pytest.raises(Exception, match="lost after"):
        two()
    monkeypatch.setattr(ingest, "run_epochs", whole)
    two()
    got = ingest.index_results(spark, f"{tmp_path}/indexed", "job_id long").collect()
    assert sorted((r.job_id, r.index_state, r.chunks_indexed) for r in got) == [(1, "ready", 1), (2, "ready", 0)]


SCHEMA = StructType([StructField("id", LongType()), StructField("text", StringType())])


def test_broken_lines_and_files_become_rows(spark, tmp_path):
    folder = tmp_path / "batch"
    (folder / "sub dir").mkdir(parents=True)
    (folder / "good.json").write_text('{"id": 1, "text": "a"}\n\n{"id": 2, "text": "b", "more": []}\n')
    (folder / "sub dir" / "mixed é.json").write_text('{"id": 3, "text": "c"}\n{"id": 4, "te\n{"id": "x", "text": "d"}\n{"text": "e"}\n[1]\n{"id": 9, "text": ""}\n')
    (folder / "bad.json").write_text("not json\n")
    (folder / "none.json").write_text("\n \n")
    (folder / "cut.json.gz").write_bytes(b"\x1f\x8b\x08\x00 this is no archive")
    lines = Z.lines_of_files(spark, str(folder))
    rows = Z.parsed(lines, SCHEMA, ["id", "text"], {"blank": F.col("record.text") != ""})
    found = {r.file: tuple(r) for r in Z.report(rows, lines, Z.files_of(spark, str(folder)), ["malformed", "wrong type", "missing", "blank"]).collect()}
    assert {f: (*r[3:9], r[10]) for f, r in found.items()} == {
        "good.json": (2, 2, 0, 0, 0, 0, "ok"), "sub dir/mixed é.json": (6, 1, 2, 1, 1, 1, "partial"), "bad.json": (1, 0, 1, 0, 0, 0, "failed"), "none.json": (0, 0, 0, 0, 0, 0, "empty"),
        "cut.json.gz": (0, 0, 0, 0, 0, 0, "unreadable"),
    }
    assert sorted(tuple(r) for r in Z.good_rows(rows).select("id", "text").collect()) == [(1, "a"), (2, "b"), (3, "c")]
    errors = {(r.kind, r.message) for r in Z.quarantined(rows).collect()}
    assert ("missing", "missing: id") in errors and ("blank", "does not hold: blank") in errors and len(errors) == 6


def test_inspect_previews_pages(spark):
    page = spark.createDataFrame([(1, 1, " a \n\n b " + "x" * 200, "native", [[["c"]]]), (1, 2, None, "ocr", None)], "doc_id int, page_number int, text string, method string, tables array<array<array<string>>>")
    got = sorted((r.page_number, r.chars, r.tables, r.preview) for r in Z.inspect(page).collect())
    assert got == [(1, 208, 1, "a b " + "x" * 96), (2, 0, 0, "")]


def test_backfill_twice_and_after_a_break(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("a", "f1", None), ("b", "f2", None), ("c", "f1", None), ("d", "gone", None), ("e", "f3", "has"), ("f", None, None)], "name string, source_file string, content_hash string")
    files_ = spark.createDataFrame([("f1", bytearray(b"same")), ("f2", bytearray(b"same")), ("f3", bytearray(b"other")), ("f4", bytearray(b"not asked"))], "source_file string, content binary")

    def broken(self, version, rows):
        raise RuntimeError("lost before the manifest")

    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", broken)
        with pytest.raises(RuntimeError):
            B.backfill(rows, files_, path)
    assert B.stored_digests(spark, path) is None and B.stored_contents(spark, path) is None
    for _ in range(2):
        out = {r.name: (r.outcome, r.content_hash and len(r.content_hash)) for r in B.backfill(rows, files_, path).collect()}
        assert out == {"a": ("stored", 64), "b": ("stored", 64), "c": ("stored", 64), "d": ("missing", None), "e": ("already", 3), "f": ("missing", None)}
        assert Versions(spark, path).last() == 1
    assert [bytes(r.content) for r in B.stored_contents(spark, path).collect()] == [b"same"]
    more = spark.createDataFrame([("g", "f4", None), ("h", "f1", None)], rows.schema)
    B.backfill(more, files_, path)
    assert Versions(spark, path).last() == 2 and sorted(bytes(r.content) for r in B.stored_contents(spark, path).collect()) == [b"not asked", b"same"]
