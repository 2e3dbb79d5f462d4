"""Pieces, archives, licences and chats: round trips and brute force."""

import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bidloom.llm import chat, licences, pieces, warc
from bidloom.llm.queries import QUERIES, SQL
from bidloom.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
DOC = "doc_id long, text string"
EDGE = [(None, "hello world"), (1, None), (2, ""), (3, "  two  spaces "), (3, "  two  spaces "), (4, "▁ mark ▁▁"), (5, "漢字 né\n\t\x00"), (6, "ab" * 30_000), (7, "word " * 20_000)]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(pieces.default_model())


def all_paths(v, text, n):
    s = pieces.MARK + text.replace(" ", pieces.MARK)
    ends = pieces.segment_edges(v, s)

    @cache
    def paths(j):
        return [(0.0, ())] if j == 0 else [(a + sc, (*p, (i, j, k))) for i, sc, k in ends[j] for a, p in paths(i)]

    return sorted((a for a, _ in paths(len(s))), reverse=True)[:n]


def ranks(v):
    """The same pieces with whole scores, so that very many paths tie."""
    return pieces.Vocabulary(v.pieces, [float(-(i % 3) - 1) for i in range(len(v.pieces))], v.ids, v.byte_ids)


TEXTS = ["", "x", "Hello", "the the", "ab ab ab", "a  b", "inging", "né", "漢 ab", "▁ a▁"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("n", [1, 3, 6])
@pytest.mark.parametrize("long", [pieces.LONG, 2])
def test_n_best_against_all_segmentations(vocabulary, monkeypatch, text, n, long):
    monkeypatch.setattr(pieces, "LONG", long)
    monkeypatch.setattr(pieces, "BLOCK", 3)
    for v in (vocabulary, ranks(vocabulary)):
        tokens, scores, edits = pieces.encode_texts(pieces.SegmentEncoder(v), [text], n)[0]
        if "▁" not in text:
            assert np.allclose(scores, all_paths(v, text, n))
        seen = {tuple(pieces.apply_edits(tokens.tolist(), e)) for e in edits}
        assert len(seen) == len(edits) and all(v.decode(t) == text for t in seen)


def test_long_segments_equal_short_ones(vocabulary, monkeypatch):
    rng = np.random.default_rng(4)
    for v in (vocabulary, ranks(vocabulary)):
        for _ in range(20):
            text = "".join(rng.choice(list("abcdeinorst"), 60))
            short = pieces.encode_texts(pieces.SegmentEncoder(v), [text], 5)[0]
            monkeypatch.setattr(pieces, "LONG", 10)
            monkeypatch.setattr(pieces, "BLOCK", 13)
            long = pieces.encode_texts(pieces.SegmentEncoder(v), [text], 5)[0]
            monkeypatch.undo()
            assert np.allclose(short[1], long[1]) and len(long[2]) == 5
            assert v is not vocabulary or [pieces.apply_edits(short[0].tolist(), e) for e in short[2]] == [pieces.apply_edits(long[0].tolist(), e) for e in long[2]]


@pytest.mark.parametrize("size", [20_000, 1_000_000])
def test_unbroken_text_takes_seconds(vocabulary, size):
    """Letters without a space, and scores that tie: time in proportion to the length."""
    import time

    text = "".join(np.random.default_rng(size).choice(list("abcdefghijklmnopqrstuvwxyz"), size))
    for v in (vocabulary, ranks(vocabulary)):
        began = time.time()
        tokens, scores, edits = pieces.encode_texts(pieces.SegmentEncoder(v), [text], 4)[0]
        assert time.time() - began < 2 + size / 15_000
        paths = [pieces.apply_edits(tokens.tolist(), e) for e in edits]
        assert len({tuple(p) for p in paths}) == 4 and all(v.decode(p) == text for p in paths) and scores == sorted(scores, reverse=True)


@tables
def test_token_counts_are_near_the_librarys(vocabulary):
    import pyarrow.parquet as pq
    import sentencepiece

    texts = pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()[:100]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    own = sum(len(t) for t, _, _ in pieces.encode_texts(pieces.SegmentEncoder(vocabulary), texts, 1))
    assert abs(own / sum(map(len, sp.encode(texts))) - 1) < 0.03


def test_memory_and_slices_do_not_matter(vocabulary):
    texts = ["the quick brown fox", "the lazy dog 漢", "", "fox " * 50, "▁x"]
    small = pieces.SegmentEncoder(vocabulary, memory=2)
    for t in texts * 2:
        a, b = pieces.encode_texts(small, [t], 3)[0], pieces.encode_texts(pieces.SegmentEncoder(vocabulary), texts, 3)[texts.index(t)]
        assert a[0].tolist() == b[0].tolist() and a[1] == b[1]


def test_pieces_round_trip(spark, vocabulary):
    df = spark.createDataFrame(EDGE, DOC).withColumn("tokens", F.lit("clash"))
    got = pieces.encode_documents(df, pieces.default_model(), n=2)
    rows = got.collect()
    assert len(rows) == len(EDGE) and all(r.decoded for r in rows if r.tokens is not None) and sum(r.tokens is None for r in rows) == 1
    back = pieces.decode_tokens(got, pieces.default_model())
    assert sorted(map(str, [(r.doc_id, r.text) for r in back.collect()])) == sorted(map(str, EDGE))
    assert pieces.encode_documents(df.limit(0), pieces.default_model()).count() == 0


def test_readme_names_the_known_licences():
    from pathlib import Path

    readme = (Path(__file__).resolve().parents[2] / "README.md").read_text()
    assert all(name in readme for name, _ in [*licences.NOTICES, *licences.DIGESTS])


def test_long_licences_by_digest(spark):
    """Whole public texts, where the box has them, in other case, with other wrapping and copyright lines."""
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    docs = [(i, "Copyright 2024 Somebody\n" + (folder / f).read_text().upper().replace("   ", "  \n "), name) for i, (f, name) in enumerate(files.items()) if (folder / f).exists()]
    docs += [(100 + i, t + " and one more condition", None) for i, t, _ in docs]
    bsd = next(t for n, t in licences.NOTICES if n == "BSD-3-Clause")
    docs += [(200, "BSD 3-Clause License\n\nCopyright (c) 2020, A Person\nAll rights reserved.\n\n" + bsd, "BSD-3-Clause"), (201, re.sub(r"(?<=[.:] )\d\. ", "\n* ", bsd), "BSD-3-Clause")]
    got = licences.licence_scan(spark.createDataFrame([d[:2] for d in docs], DOC), licences.known_table(spark))
    assert {r.doc_id: r.licence for r in got.collect()} == {i: name for i, _, name in docs}


@tables
@pytest.mark.parametrize("name", ["op7_licence_digests", "op8_lsm_exact_dedup", "op10_snapshot_collapse"])
def test_queries_against_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(SQL[name])
    columns = sorted(want.columns)
    rows = [tuple(str(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()]
    assert sorted(rows) == sorted(tuple(str(r[c]) for c in columns) for r in QUERIES[name](spark, SF).collect())


def test_every_path_is_returned_as_a_digest(spark, tmp_path):
    import hashlib

    spark.createDataFrame(EDGE, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op4_sentencepiece_nbest"](spark, str(tmp_path)).collect()}
    for r in pieces.encode_documents(spark.createDataFrame(EDGE, DOC), pieces.default_model(), n=4).collect():
        g = got[r.doc_id]
        if r.tokens is None:
            assert g.path_digests is None and g.decoded is None
            continue
        want = [hashlib.md5(np.array(pieces.apply_edits(r.tokens, [(e["at"], e["size"], e["tokens"]) for e in path]), "<i4").tobytes()).hexdigest() for path in r.edits]
        assert g.path_digests == want and len(set(want)) == g.n_best == len(g.scores) and g.token_digest == want[0] and g.decoded
    assert any(g.path_digests and len(g.path_digests) == 4 for g in got.values())


def test_strings_of_one_hash_are_encoded_again(vocabulary, monkeypatch):
    """Two letters that hash alike give tokens of another text; with other hashes the tokens are right."""
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["the quick fox", "the quack fox", None])], ["doc_id", "text"])
    right = next(pieces._runner(vocabulary, 3, False)([batch])).to_pylist()
    from dataclasses import replace

    broken = replace(vocabulary)
    hashes = broken.char_hash.copy()
    hashes[ord("i")] = hashes[ord("a")]
    broken.__dict__["char_hash"] = hashes
    assert not all(r["decoded"] for r in _undone(monkeypatch, broken, batch) if r["decoded"] is not None)
    assert next(pieces._runner(broken, 3, False)([batch])).to_pylist() == right and right[0]["decoded"]


def _undone(monkeypatch, v, batch):
    with monkeypatch.context() as m:
        m.setattr(pieces, "TRIES", 0)
        return next(pieces._runner(v, 3, False)([batch])).to_pylist()


@pytest.mark.parametrize("digest", [False, True])
def test_a_wrong_later_path_is_not_decoded(vocabulary, monkeypatch, digest):
    whole = pieces.encode_texts

    def broken(encoder, texts, n):
        return [(tokens, scores, [*edits[:-1], [(0, 1, [])]]) for tokens, scores, edits in whole(encoder, texts, n)]

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["the quick fox"])], ["doc_id", "text"])
    right = next(pieces._runner(vocabulary, 3, digest)([batch])).to_pylist()[0]
    monkeypatch.setattr(pieces, "encode_texts", broken)
    wrong = next(pieces._runner(vocabulary, 3, digest)([batch])).to_pylist()[0]
    assert len(right["scores"]) == 3 and right["decoded"] and not wrong["decoded"]


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_round_trip(version):
    blocks = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\n\nhttp://x 0 0 0 5\n", b"", b"plain\r\n\r\n"]
    data = warc.arc_version_block(version, "f.arc", "20010203040506") + b"\n"
    for i, b in enumerate(blocks):
        data += warc.arc_record(version, f"http://h/{i} with blank", "1.2.3.4", "2001020304", "text/html", b) + b"\n"
    got = list(warc.parse_arc(data))
    assert [b for _, b, _ in got] == blocks and [f["URL"] for f, _, _ in got] == [f"http://h/{i} with blank" for i in range(3)]
    out = b"".join(warc.convert_record(f, b, warc.record_id(line, "a/f.arc", i), None) + b"\r\n\r\n" for i, (f, b, line) in enumerate(got))
    records = list(warc.parse_warc(out))
    assert [b for _, b in records] == blocks and records[0][0]["warc-date"] == "2001-02-03T04:00:00Z" and [r["warc-type"] for r, _ in records] == ["response", "resource", "resource"]
    assert len({r["warc-record-id"] for r, _ in records}) == 3
    with pytest.raises(ValueError, match="truncated"):
        list(warc.parse_arc(data[:-3]))
    with pytest.raises(ValueError, match="version block"):
        list(warc.parse_arc(warc.arc_record("1", "http://x", "0", "0", "t", b"x")))


def brute_pages(rows, least=0):
    groups = {}
    for i, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        first = max(groups[body])
        revisit = i != first and len(body) >= least
        out.append((i, len(body), warc.sha1_base32(body), "revisit" if revisit else "response", first if revisit else None, True))
    return sorted(out)


@pytest.mark.parametrize("version, least", [("1", 0), ("2", 3)])
def test_pages_through_archives(spark, version, least):
    rows = [(i, f"http://h/{i}", t) for i, t in enumerate(["a", "same", "same", None, "", "é漢\r\n\r\nWARC/1.1", "same", "x" * 70_000, "HTTP/1.1 no head"])] + [(90, None, "b"), (91, "http://a b\nc", "b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit(1)).repartition(3)
    got = warc.pages_through_archives(df, Scratch(spark), version, least)
    assert sorted(tuple(r) for r in got.collect()) == brute_pages(rows, least)


def test_archives_are_cut_by_bytes(spark, tmp_path):
    """Repeated rows have identifiers of their own, files stay below the bound, and a longer page has its own."""
    import gzip

    rows = [(i, f"http://h/{i}", f"page {i} " * 40) for i in range(60)] + [(60, "u", "long " * 4000), (60, "u", "long " * 4000), (None, "n", None), (None, "n", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    warc.write_arc(df, f"{tmp_path}/arc", file_bytes=4000)
    warc.convert(f"{tmp_path}/arc", f"{tmp_path}/warc", Scratch(spark), file_bytes=4000)
    for kind, overhead in (("arc", 0), ("warc", 0)):
        files = sorted((tmp_path / kind).glob("**/*.gz"))
        sizes = [len(gzip.decompress(f.read_bytes())) for f in files]
        assert len(files) > 10 and sum(s > 4200 for s in sizes) == (2 if kind == "arc" else 1)
    records = warc.read_warc(spark, f"{tmp_path}/warc").collect()
    assert len(records) == len(rows) == len({r.id for r in records}) and all(r.block_ok for r in records)
    got = warc.pages_through_archives(df, Scratch(spark), file_bytes=4000).collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got if r.page_id in (60, None)) == sorted(
        [("60", "response", "None"), ("60", "revisit", "60"), ("None", "response", "None"), ("None", "revisit", "None")]
    )


def through(spark, rows, tasks, **kw):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(tasks)
    return [tuple(r) for r in warc.pages_through_archives(df, Scratch(spark), **kw).collect()]


def test_equal_rows_over_several_files_have_one_response(spark):
    """Files of one task have the same name in different folders: identifiers tell them apart."""
    for rows, kw in (([(5, "u", "same")] * 4100, {}), ([(5, "u", "same")] * 8, {"file_bytes": 700})):
        got = through(spark, rows, 1, **kw)
        assert sorted(r[3] for r in got) == ["response"] + ["revisit"] * (len(rows) - 1) and {r[4] for r in got if r[3] == "revisit"} == {5}


def test_revisits_refer_to_their_own_payload_at_equal_places(spark):
    rows = [(30, "u", "aaaa"), (10, "v", "aaaa"), (31, "u", "bbbb"), (11, "w", "cccc")]
    assert sorted(through(spark, rows, 1, file_bytes=480)) == brute_pages(rows)


def test_repeated_pages_over_small_files(spark):
    rows = [(i, "u", f"page {i % 7}") for i in range(40)] * 50
    got = through(spark, rows, 3, file_bytes=3000)
    assert len(got) == 2000 and sum(r[3] == "response" for r in got) == 7
    largest = {f"page {k}".encode(): max(i for i in range(40) if i % 7 == k) for k in range(7)}
    digest = {warc.sha1_base32(b): i for b, i in largest.items()}
    assert all(r[4] == digest[r[2]] if r[3] == "revisit" else r[0] == digest[r[2]] for r in got)


def test_archives_name_themselves_once(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(i, "u", "x" * 200) for i in range(40)], "page_id long, url string, html string").repartition(3)
    warc.write_arc(df, f"{tmp_path}/arc", file_bytes=1500)
    warc.convert(f"{tmp_path}/arc", f"{tmp_path}/warc", Scratch(spark), file_bytes=1500)
    own = []
    for f in (tmp_path / "warc").glob("**/*.gz"):
        fields, _ = next(warc.parse_warc(gzip.decompress(f.read_bytes())))
        assert fields["warc-type"] == "warcinfo"
        own.append(fields["warc-record-id"])
    arcs = [gzip.decompress(f.read_bytes()).split(b" ", 1)[0] for f in (tmp_path / "arc").glob("**/*.gz")]
    assert len(own) > 3 and len(set(own)) == len(own) and len(set(arcs)) == len(arcs) > 3


def test_shared_names_raise(spark):
    arcs = spark.createDataFrame([("file:/a/b/f=0/x",), ("file:/a/b/f=1/x",), ("file:///a//b/f=0/x",)], "path string")
    warc.raise_on_shared_names(arcs.limit(2), "file:///a/b")
    with pytest.raises(ValueError, match="2 archives have the name f=0/x"):
        warc.raise_on_shared_names(arcs, "file:///a/b")
    assert [warc.below("file:///a/b/", p) for p in ("file:/a/b/f=0/x", "file:/a/c/x")] == ["f=0/x", "/a/c/x"]
    ids = {warc.record_id("line", f, p) for f in ("f=0/x", "f=1/x") for p in (0, 1)}
    assert len(ids) == 4


def test_streams_are_read_in_steps():
    import gzip

    blocks = [b"x" * 50_000, b"", b"y\r\n" * 9000]
    data = warc.arc_version_block("1", "f", "2020") + b"\n" + b"".join(warc.arc_record("1", f"http://{i}", "0", "2020", "t", b) + b"\n" for i, b in enumerate(blocks))
    for content in (data, gzip.compress(data)):
        for step in (1, 7, 4096):
            assert [b for _, b, _ in warc.parse_arc(warc._Plain(content, step))] == blocks


def test_no_pages(spark):
    assert warc.pages_through_archives(spark.createDataFrame([], "page_id long, url string, html string"), Scratch(spark)).count() == 0


@tables
def test_op6_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(tuple(r) for r in QUERIES["op6_arc_to_warc"](spark, SF).collect()) == brute_pages(rows)


def test_licences(spark):
    known = licences.known_table(spark)
    mit = next(t for i, t in licences.NOTICES if i == "MIT" and len(t) > 100)
    docs = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(" ", "\n ").replace("SUBLICENSE", "sub-licence")),
        (2, "prose here\nReleased under the MIT Licence!\nmore"),
        (3, "it was Released under the MIT License. they said"),
        (4, None),
        (5, "© 2020\n(c) me"),
        (None, "licensed under CC BY-NC 4.0"),
        (6, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
        (6, ""),
    ]
    got = licences.licence_scan(spark.createDataFrame(docs, DOC).withColumn("licence", F.lit("clash")), known)
    rows = sorted(((str(r.doc_id), r.licence, tuple(r.line_licences)) for r in got.collect()), key=str)
    want = [("1", "MIT", ()), ("2", None, ("MIT",)), ("3", None, ()), ("4", None, ()), ("5", None, ()), ("None", "CC-BY-NC-4.0", ("CC-BY-NC-4.0",)), ("6", None, ("Apache-2.0", "MIT")), ("6", None, ())]
    assert rows == sorted(want, key=str)
    assert licences.licence_scan(spark.createDataFrame([], DOC), known).count() == 0
    assert licences.licence_scan(spark.createDataFrame(docs, DOC), known.limit(0)).where("licence IS NOT NULL").count() == 0


def test_many_known_licences_are_joined(spark, monkeypatch):
    """A table too large for an expression gives the same rows, by joins alone."""
    known = licences.known_table(spark)
    mit = next(t for i, t in licences.NOTICES if i == "MIT" and len(t) > 100)
    long = "prose words\n" * 30_000
    docs = [(1, mit), (2, "prose\nReleased under the MIT Licence!\nLicensed under the Apache License, Version 2.0."), (2, None), (None, ""), (4, long + "Released under the MIT License."), (5, mit.replace(" ", "\n")), (5, mit.replace(" ", "\n"))]
    df = spark.createDataFrame(docs, DOC).withColumn("lines", F.lit("clash")).withColumn("digest", F.lit("x"))
    rows = lambda: sorted(((str(r.doc_id), r.text_digest, r.licence, tuple(r.line_licences)) for r in licences.licence_scan(df, known).collect()), key=str)
    want = rows()
    monkeypatch.setattr(licences, "MOST_IN_EXPRESSION", 3)
    assert rows() == want and [r[2:] for r in want if r[0] == "4"] == [(None, ("MIT",))]
    plan = licences.licence_scan(df, known)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and licences.licence_scan(df.limit(0), known).count() == 0


def brute_chats(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r or "", x or ""))
    order = lambda v: tuple((-1 if e is None else 0, e or 0) if not isinstance(e, str) else (0, e) for e in v)
    convs = {c: [(r, x) for _, r, x in sorted(v, key=order)] for c, v in by.items()}
    kept = []
    for c, v in convs.items():
        longer = any(len(o) > len(v) and o[: len(v)] == v for o in convs.values())
        twin = any(o == v and (k is None or (c is not None and k < c)) for k, o in convs.items() if k != c)
        if not longer and not twin:
            kept.append(c)
    return {c: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in convs[c]) for c in kept}


def test_maximal_conversations(spark):
    a = [("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", "ok")]
    rows = [(c, t, *a[t]) for c, n in ((1, 4), (2, 2), (3, 3), (4, 4), (5, 1)) for t in range(n)]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "other"), (7, 0, None, None), (8, 0, "user", "x"), (8, 0, "user", "x"), (9, 0, "user", "x"), (None, 0, "user", "null id"), (10, None, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash")).repartition(4)
    got = chat.maximal_conversations(df, Scratch(spark)).orderBy("conv_id", "place").collect()
    texts = {}
    for r in got:
        assert r.starts_at == len(texts.get(r.conv_id, ""))
        texts[r.conv_id] = texts.get(r.conv_id, "") + r.rendered
    assert texts == brute_chats(rows)
    assert chat.maximal_conversations(df.limit(0), Scratch(spark)).count() == 0


def test_very_long_turns(spark):
    long = "word " * 200_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", "ok"), (2, 0, "user", long), (3, 0, "user", long + "x"), (4, 0, "user", long), (4, 1, "assistant", long)]
    got = {}
    for r in chat.maximal_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), Scratch(spark)).orderBy("conv_id", "place").collect():
        got[r.conv_id] = got.get(r.conv_id, "") + r.rendered
    assert got == brute_chats(rows) and set(got) == {1, 3, 4}


def test_one_conversation_over_many_partitions(spark):
    rows = [(1, i, "user", f"t{i % 7}") for i in range(3000)] + [(2, i, "user", f"t{i % 7}") for i in range(2999)] + [(3, 0, "user", "t0")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.maximal_conversations(df, Scratch(spark)).collect()
    assert {r.conv_id for r in out} == {1} and sorted(r.place for r in out) == list(range(1, 3001))
