import hashlib

import zstandard

from sylva.llm.warc import classify, frame, lookup, parse, read_index, read_records, record_index, seek_table, write_bundles
from sylva.session import materialize

LONG = "<p>" + "é" * 60
ROWS = [(5, "http://a/\r\nX: y", LONG), (3, None, LONG), (9, "u", LONG), (4, "u", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"),
        (None, "u", LONG), (11, "u", "WARC/1.1\r\n\r\n" * 30000), (3, "again", LONG), (2**60 + 1, "u", "x" * 100), (2**60 + 2, "u", "x" * 100)]


def pages(spark):
    return spark.createDataFrame([(*r, "extra") for r in ROWS], "page_id long, url string, html string, record_type string")


def want():
    out = []
    for i, _, html in ROWS:
        b = (html or "").encode()
        same = [j for j, _, h in ROWS if (h or "").encode() == b and j is not None]
        again = len(b) >= 100 and same and i != min(same)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    for frame_bytes in (1, 500, 1 << 20):
        got = read_records(write_bundles(classify(pages(spark)), frame_bytes=frame_bytes, bundle_bytes=200))
        rows = got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").collect()
        assert sorted((tuple(r)[:5] for r in rows), key=str) == want()
        assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in rows)


def test_bundle_layout(spark):
    for r in write_bundles(classify(pages(spark)), frame_bytes=300).collect():
        content = bytes(r["content"])
        whole = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
        frames = seek_table(content)
        assert whole == b"".join(frame(content, k) for k in range(len(frames) - 1))
        for name, k, start, length in record_index(content):
            assert parse(frame(content, k)[start : start + length])["record_id"] == name


def test_lookup(spark):
    bundles = materialize(write_bundles(classify(pages(spark)), frame_bytes=300))
    asked = spark.createDataFrame([("<urn:page:7>",), ("<urn:page:999>",), ("<urn:page:7>",)], "record_id string")
    assert [r["page_id"] for r in lookup(bundles, asked).collect()] == [7]
    assert read_index(bundles).count() == len(ROWS)


def test_no_pages(spark):
    assert read_records(write_bundles(classify(pages(spark).where("false")))).count() == 0
