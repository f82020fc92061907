"""WARC archives as seekable Zstandard bundles.

A bundle is one binary value of a table, so that Spark writes and commits it
like any other data. Its layout: independent Zstandard frames, each holding some
whole records; a skippable frame with the record index; a skippable frame with
the seek table as footer. A standard decoder reads the frames and skips the
rest; one record is had from one frame.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import query, table
from sylva.session import materialize

# Fixed values of the file formats.
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
VERSION = b"WARC/1.1\r\n"

FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 4 * 1024 * 1024
LEAST_PAYLOAD = 100

BUNDLE = "bundle_id string, n_records long, content binary"
INDEX = "record_id string, bundle_id string, frame int, start long, length long"
RECORD = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def classify(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Adds payload_digest, payload_bytes, record_type and refers_to to pages.

    Among equal payloads of at least ``least`` bytes the smallest page_id is the
    response. A null html is an empty payload. Null ids count as largest; if a
    group has only those, all are responses, as are rows that share the smallest
    id. Only digests met twice are joined; they are written out first, so a hot
    digest is a skewed partition that Spark may split."""
    body = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    body = body.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    large = body.where(F.col("payload_bytes") >= least)
    first = materialize(large.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    out = body.join(first, "payload_digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return out.select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"))


def _name(page_id: str | None) -> str:
    return f"<urn:page:{page_id or 'none'}>"


def _number(name: str | None) -> int | None:
    tail = (name or "").rstrip(">").rpartition(":")[2]
    return int(tail) if tail and tail != "none" else None


def _record(row) -> bytes:
    """One record; what a revisit leaves out is its payload."""
    kept = bytes(row.payload) if row.record_type == "response" else b""
    head = [
        ("WARC-Type", row.record_type), ("WARC-Record-ID", _name(row.page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{row.payload_digest}"), ("WARC-Payload-Length", str(int(row.payload_bytes))),
        ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(kept)))]
    if row.url is not None:
        head.append(("WARC-Target-URI", quote(row.url, safe="")))
    if row.record_type == "revisit":
        head += [("WARC-Refers-To", _name(row.refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + kept + b"\r\n\r\n"


def _skip(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class _Bundle:
    """Gathers records and gives the finished bundle."""

    def __init__(self, frame_bytes: int, level: int):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.open, self.open_size, self.size = [], 0, 0

    def add(self, name: str, record: bytes) -> None:
        self.index.append((name, len(self.sizes), self.open_size, len(record)))
        self.open.append(record)
        self.open_size += len(record)
        if self.open_size >= self.frame_bytes:
            self.close()

    def close(self) -> None:
        if self.open:
            frame = self.packer.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.open_size))
            self.size += len(frame)
            self.open, self.open_size = [], 0

    def done(self) -> bytes:
        self.close()
        index = _skip(SKIPPABLE, self.packer.compress(json.dumps(self.index).encode()))
        entries = [*self.sizes, (len(index), 0)]
        footer = b"".join(struct.pack("<II", *x) for x in entries) + struct.pack("<IBI", len(entries), 0, SEEK_MAGIC)
        return b"".join(self.frames) + index + _skip(SEEK_TABLE, footer)

    def row(self) -> pd.DataFrame:
        content = self.done()
        return pd.DataFrame({"bundle_id": [hashlib.sha256(content).hexdigest()[:32]], "n_records": [len(self.index)], "content": [content]})


def write_bundles(records: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = 3) -> DataFrame:
    """Bundles of the rows of ``classify``, one table row each, about ``bundle_bytes`` of compressed data long.

    Partitions stay where they are; a task holds one open bundle. A record larger
    than a frame has a frame of its own. No rows give no bundle. A bundle's id is
    that of its content."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = _Bundle(frame_bytes, level)
        for batch in batches:
            for row in batch.itertuples(index=False):
                now.add(_name(row.page_id), _record(row))
                if now.size >= bundle_bytes:
                    yield now.row()
                    now = _Bundle(frame_bytes, level)
        if now.index:
            yield now.row()

    # Ids travel as text: pandas would make a column with nulls floating.
    ids = [F.col(c).cast("string").alias(c) for c in ("page_id", "refers_to")]
    return records.select("url", "payload", "payload_digest", "payload_bytes", "record_type", *ids).mapInPandas(pack, BUNDLE)


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(place, compressed size, size) of the frames, from the footer alone."""
    n, _, magic = struct.unpack_from("<IBI", content, len(content) - 9)
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    out, place = [], 0
    for k in range(n):
        packed, size = struct.unpack_from("<II", content, len(content) - 9 - 8 * (n - k))
        out.append((place, packed, size))
        place += packed
    return out


def frame(content: bytes, k: int) -> bytes:
    place, packed, size = seek_table(content)[k]
    return zstandard.ZstdDecompressor().decompress(content[place : place + packed], max_output_size=size)


def record_index(content: bytes) -> list[tuple[str, int, int, int]]:
    """(record id, frame, place in the frame, length) of every record."""
    place, packed, _ = seek_table(content)[-1]
    unpack = zstandard.ZstdDecompressor().decompressobj()
    return [tuple(x) for x in json.loads(unpack.decompress(content[place + 8 : place + packed]))]


def parse(record: bytes) -> dict:
    """The fields of one record; a payload that doesn't match its digest raises."""
    if not record.startswith(VERSION):
        raise ValueError("not a WARC record")
    head, _, rest = record[len(VERSION) :].partition(b"\r\n\r\n")
    said = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
    payload = rest[: int(said["Content-Length"])]
    digest, kind = said["WARC-Payload-Digest"].removeprefix("sha256:"), said["WARC-Type"]
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(said["WARC-Payload-Length"])):
        raise ValueError(f"damaged record {said['WARC-Record-ID']}")
    return {
        "record_id": said["WARC-Record-ID"], "page_id": _number(said["WARC-Record-ID"]), "url": said.get("WARC-Target-URI"), "record_type": kind,
        "refers_to": _number(said.get("WARC-Refers-To")), "payload_bytes": int(said["WARC-Payload-Length"]), "payload_digest": digest,
        "payload": payload if kind == "response" else None}


def _table(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")], dtype=object)
    for c in ("page_id", "refers_to"):
        out[c] = pd.array(out[c].to_list(), "Int64")
    return out.astype({"payload_bytes": "int64"})


def read_records(bundles: DataFrame) -> DataFrame:
    """Every record of every bundle, frame after frame; ``url`` is percent-encoded."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                places: dict[int, list] = {}
                for _, k, start, length in record_index(content):
                    places.setdefault(k, []).append((start, length))
                for k, spans in places.items():
                    data = frame(content, k)
                    yield _table([parse(data[a : a + n]) for a, n in spans])

    return bundles.select("content").mapInPandas(unpack, RECORD)


def read_index(bundles: DataFrame) -> DataFrame:
    """Where each record is; no data frame is unpacked for it."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bundle_id, content in zip(batch["bundle_id"], batch["content"], strict=True):
                rows = record_index(content)
                yield pd.DataFrame({
                    "record_id": [r[0] for r in rows], "bundle_id": bundle_id, "frame": [r[1] for r in rows],
                    "start": [r[2] for r in rows], "length": [r[3] for r in rows]})

    return bundles.select("bundle_id", "content").mapInPandas(listed, INDEX)


def lookup(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records whose record_id is in ``wanted``; only their frames are unpacked. ``bundles`` is a written table, as it is read twice."""
    places = read_index(bundles).join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    # One row for a frame: a frame's records are few, a bundle's many.
    places = places.groupBy("bundle_id", "frame").agg(F.collect_list(F.struct("start", "length")).alias("spans"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content, k, spans in zip(batch["content"], batch["frame"], batch["spans"], strict=True):
                data = frame(content, int(k))
                yield _table([parse(data[s["start"] : s["start"] + s["length"]]) for s in spans])

    return bundles.join(places, "bundle_id").select("content", "frame", "spans").mapInPandas(fetch, RECORD)


@query("op9_warc", """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM d)
    SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
           CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM f""")
def op9_warc(spark, sf_dir):
    bundles = materialize(write_bundles(classify(table(spark, sf_dir, "pages"))))
    return read_records(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
