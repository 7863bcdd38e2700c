"""Operator 7: exact round trips, revisits, and the archive format itself."""

import hashlib
import struct

import pytest
import zstandard
from conftest import SMALL
from oracle_check import compare, duck

from mentionlake.llm import warc as W


def rows_of(spark, rows, folder, **how):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    W.write_archives(frame, folder, **how)
    return W.read_archives(spark, folder, "bigint", with_payload=True).collect()


def test_round_trip_with_copies_nulls_and_large_pages(spark, tmp_path):
    big, small = "é<p>" * 400, "x" * 999
    rows = [(1, "http://a/ b\r\nc", big, "z"), (5, None, big, "z"), (3, "u", big, "z"), (5, None, big, "z"), (None, "u", big, "z")]
    rows += [(7, "u", small, None), (8, "u", small, None), (9, "u", None, None), (10, "u", "", None), (11, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 90_000, None)]
    rows += [(100 + i, "u", f"<html><body>page {i} " + "common words of all pages " * 50, None) for i in range(60)]
    got = rows_of(spark, rows, f"file:{tmp_path}/w", limit=100_000)
    assert len(got) == len(rows)
    texts = {}
    for k, _, html, _ in rows:
        texts.setdefault(k, html or "")
    for r in got:
        raw = texts[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        again = r.page_id in (1, 3, None)
        assert (r.record_type, r.refers_to) == (("revisit", 5) if again else ("response", None))
        assert r.payload is None if again else bytes(r.payload) == raw


def test_archive_begins_with_its_dictionary_and_frames_stand_alone(tmp_path):
    records = [W.page_record(str(i), "u", b"some page text " * 40 + str(i).encode(), hashlib.sha1(b"x").hexdigest(), 1, None, "d") for i in range(300)]
    body = W.pack(records, "d")
    magic, size = struct.unpack_from("<II", body)
    assert magic == 0x184D2A5D and len(body) < sum(map(len, records)) / 4
    words = zstandard.ZstdCompressionDict(body[8 : 8 + size])
    rest, n = body[8 + size :], 0
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
        text = one.decompress(rest)
        assert text.startswith(b"WARC/1.1\r\n") and (n == 0 or text == records[n - 1])
        rest, n = one.unused_data, n + 1
    assert n == 301 and [b for _, _, b in W.unpack(W.pack([], "d"))] == [b"format: WARC File Format 1.1\r\n"]


def test_damage_is_noticed():
    body = W.pack([W.page_record("1", "u", b"abc", hashlib.sha1(b"abc").hexdigest(), 3, None, "d")], "d")
    with pytest.raises(ValueError, match="dictionary"):
        list(W.unpack(b"x" * 8 + body))


def test_empty_table(spark, tmp_path):
    assert rows_of(spark, [], f"file:{tmp_path}/e") == []


def test_whole_table_equals_sql(spark):
    status, _, _, diff = compare(spark, duck(SMALL), W.op7_warc, W.OP7_SQL, SMALL)
    assert status == "ok", diff


def test_archives_of_attempts_that_did_not_count_are_neither_read_nor_kept(spark, tmp_path):
    folder = f"file:{tmp_path}/w"
    rows = [(i, "u", f"page {i} " * 300, None) for i in range(40)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    first = {r.name for r in W.write_archives(frame.repartition(3), folder, limit=20_000).collect()}
    # A lost or doubled attempt cuts the stream elsewhere and leaves archives the list does not name.
    stray = W.pack([W.page_record(str(i), "u", rows[i][2].encode(), hashlib.sha1(rows[i][2].encode()).hexdigest(), len(rows[i][2]), None, "d") for i in range(9)], "d")
    (tmp_path / "w" / "0-00000099-00000.warc.zst").write_bytes(stray)
    assert sorted(r.page_id for r in W.read_archives(spark, folder).collect()) == list(range(40))
    W.delete_strays(spark, folder)
    on_disk = lambda: {f.name for f in (tmp_path / "w").glob("*.warc.zst")}
    assert on_disk() == first
    # Written again with other cuts, nothing is doubled and no former archive stays.
    second = W.write_archives(frame.repartition(7), folder, limit=35_000)
    assert on_disk() == {r.name for r in second.collect()} and not on_disk() & first
    assert sorted(r.page_id for r in W.read_archives(spark, folder).collect()) == list(range(40))
    assert second.groupBy().sum("records").first()[0] == 40


def test_columns_with_clashing_names_take_no_part(spark, tmp_path):
    frame = spark.createDataFrame([(1, "u", "a" * 2000, "x", 7, "y"), (2, "u", "a" * 2000, "x", 8, "y")], "page_id long, url string, html string, payload string, size long, largest string")
    W.write_archives(frame, f"file:{tmp_path}/w")
    assert {(r.page_id, r.record_type, r.refers_to) for r in W.read_archives(spark, f"file:{tmp_path}/w").collect()} == {(2, "response", None), (1, "revisit", 2)}
