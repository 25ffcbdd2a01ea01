import gzip
import hashlib
import zlib

import pytest

from edgelake.llm import warc
from edgelake.session import new_table_path

BIG = "x" * 150


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


def test_round_trip(spark):
    rows = [
        (5, "http://a", BIG), (3, "http://b\r\nX: y", BIG), (9, None, BIG), (9, None, BIG), (None, "u", BIG), (1, "u", "short"), (2, "u", "short"),
        (7, "u", None), (8, "u", ""), (10, "u", "é\r\n\r\nWARC/1.1\r\n" * 20), (11, "u", "y" * 300_000), (3, "again", BIG),
    ]
    got = warc.archive_round_trip(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h for i, _, h in rows if i == r.page_id) or ""
        data = html.encode()
        assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha256(data).hexdigest()
        revisit = html == BIG and r.page_id != 3
        assert (r.record_type, r.refers_to) == (("revisit", 3) if revisit else ("response", None))


def test_ids_that_are_all_null(spark):
    got = warc.archive_round_trip(pages(spark, [(None, None, BIG), (None, None, BIG)])).collect()
    assert [(r.record_type, r.refers_to, r.payload_bytes) for r in got] == [("response", None, 150)] * 2


def test_archives_hold_one_stream_and_then_a_member_per_record(spark):
    folder = new_table_path(spark, "warc-test")
    df = pages(spark, [(i, "u", f"page {i} " * 40) for i in range(50)])
    warc.write_archives(warc.revisits(df), f"{folder}/one", per_archive=20)
    index = warc.normalise(spark, f"{folder}/one", f"{folder}/many")
    found = index.collect()
    assert len(found) == 50 and len({r.archive for r in found}) >= 3
    for r in found:
        with open(warc.place(r.archive)[1], "rb") as f:
            f.seek(r.offset)
            whole = gzip.decompress(f.read(r.length))
        assert whole.startswith(b"WARC/1.1\r\n") and whole.endswith(b"\r\n\r\n")
    paths = [r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{folder}/one").select("path").collect()]
    for path in paths:
        data = open(warc.place(path)[1], "rb").read()
        single = zlib.decompressobj(31)
        single.decompress(data)
        assert single.eof and not single.unused_data
    small = warc.read_records(index, range_bytes=500).collect()
    assert sorted(r.page_id for r in small) == list(range(50))
    twice = warc.normalise(spark, f"{folder}/many", f"{folder}/twice")
    assert twice.count() == 50


def test_no_rows(spark):
    assert warc.archive_round_trip(pages(spark, [(1, "u", "a")]).where("false")).count() == 0


def test_inflating_is_bounded():
    import io

    packed = gzip.compress(b"x" * 50_000_000) + gzip.compress(b"") + gzip.compress(b"tail")
    pieces = [len(p) for p in warc._inflated(io.BytesIO(packed))]
    assert sum(pieces) == 50_000_004 and max(pieces) <= warc.CHUNK
    with pytest.raises(ValueError, match="cut off"):
        list(warc._inflated(io.BytesIO(packed[:-9])))
