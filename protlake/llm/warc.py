"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames of about ``frame_bytes`` that decompress on their own. A bundle file is its frames followed by a seek table in
a skippable frame (the public seekable format: sizes of every frame, their number, a magic number at the very end), so a reader finds any
frame from the file's last bytes. The index maps a record to its bundle, frame and place in the frame.

Each task writes one bundle under a name of its own into the shared folder and reports it in the index, which Spark commits as a whole:
files of lost or repeated tasks are in no index and are never read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from protlake.llm import textkit as tk
from protlake.session import scratch_path, staged

# fixed values of the seekable format
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1

FRAME_BYTES = 1 << 20
FRAMES_A_TASK = 16
REVISIT_BYTES = 1000
INDEX_SCHEMA = "page_id long, bundle string, frame long, frame_start long, frame_bytes long, record_start long, record_bytes long"


def record(page_id: int | None, url: str | None, kind: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record. A revisit has no block; its headers keep digest and size of the payload that it stands for."""
    block = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at ``at`` and the place behind it."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    n = int(headers["Content-Length"])
    return headers, data[end + 4:end + 4 + n], end + 4 + n + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Footer for frames given as (compressed, plain) sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed, plain) of every frame of an open bundle of ``size`` bytes."""
    source.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC or flags & 0x80:
        raise ValueError("not a bundle with a plain seek table")
    source.seek(size - 9 - 8 * count)
    sizes = list(struct.iter_unpack("<II", source.read(8 * count)))
    out, at = [], 0
    for packed, plain in sizes:
        out.append((at, packed, plain))
        at += packed
    return out


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def typed(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Pages as records: ``page_id``, ``url``, ``html``, ``digest``, ``kind``, ``refers_to``."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
                        F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    several = (rows.filter((F.col("bytes") >= least) & F.col("page_id").isNotNull()).groupBy("digest", "bytes")
               .agg(F.max("page_id").alias("last"), F.min("page_id").alias("first")).filter("first < last").select(F.col("digest").alias("d"), F.col("bytes").alias("b"), "last"))
    held = rows.join(several, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")) & F.col("page_id").isNotNull(), "left")
    other = F.col("last").isNotNull() & (F.col("last") != F.col("page_id"))
    return held.select("page_id", "url", "html", "digest", F.when(other, "revisit").otherwise("response").alias("kind"), F.when(other, F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = REVISIT_BYTES, frame_bytes: int = FRAME_BYTES, level: int = 3) -> DataFrame:
    """Write bundles below ``folder`` (reachable by all executors) and give the index, one row per page.

    Of pages with equal payloads of at least ``least`` bytes the one with the largest page_id is the response and the others revisit it; smaller ones and
    pages without an id are all responses. Null html is an empty payload. Rows that repeat a page are written as often. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        filesystem, base = _filesystem(folder)
        filesystem.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.zst"
        press, out, frames, at = zstandard.ZstdCompressor(level=level), None, [], 0
        waiting: list[bytes] = []
        size, ids = 0, []

        def close_frame() -> pa.RecordBatch:
            nonlocal at, size, out
            if out is None:
                out = filesystem.open_output_stream(f"{base}/{name}", compression=None)
            plain = b"".join(waiting)
            packed = press.compress(plain)
            out.write(packed)
            frames.append((len(packed), len(plain)))
            n = len(waiting)
            lengths = [len(x) for x in waiting]
            places = [0, *pd.Series(lengths).cumsum().tolist()[:-1]]
            index = pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([f"{folder}/{name}"] * n), pa.array([len(frames) - 1] * n, pa.int64()), pa.array([at] * n, pa.int64()),
                 pa.array([len(packed)] * n, pa.int64()), pa.array(places, pa.int64()), pa.array(lengths, pa.int64())],
                names=["page_id", "bundle", "frame", "frame_start", "frame_bytes", "record_start", "record_bytes"])
            at += len(packed)
            waiting.clear()
            ids.clear()
            size = 0
            return index

        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            for i in range(batch.num_rows):
                page_id, url, html, digest, kind, refers_to = (c[i].as_py() for c in columns)
                one = record(page_id, url, kind, html.encode("utf-8", "surrogatepass"), digest, refers_to)
                if waiting and size + len(one) > frame_bytes:
                    yield close_frame()
                waiting.append(one)
                ids.append(page_id)
                size += len(one)
        if waiting:
            yield close_frame()
        if out is not None:
            out.write(seek_table(frames))
            out.close()

    return typed(pages, least).mapInArrow(run, INDEX_SCHEMA)


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_archives(spark: SparkSession, index: DataFrame) -> DataFrame:
    """All records of the bundles in ``index``, frame by frame as their seek tables say.

    Digest and size of a response come from its payload as read; a payload that doesn't match its header fails the job. A revisit has those of its
    header. A task reads about ``FRAMES_A_TASK`` frames.
    """
    frames = index.select("bundle", "frame").distinct()
    frames = frames.repartition(max(1, -(-frames.count() // FRAMES_A_TASK)), "bundle", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, opened, source, table = zstandard.ZstdDecompressor(), None, None, []
        for batch in batches:
            for bundle, frame in sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if bundle != opened:
                    if source is not None:
                        source.close()
                    filesystem, path = _filesystem(bundle)
                    source, opened = filesystem.open_input_file(path), bundle
                    table = read_seek_table(source, source.size())
                start, packed, plain = table[frame]
                source.seek(start)
                data = unpack.decompress(source.read(packed), max_output_size=max(plain, 1))
                rows, at = [], 0
                while at < len(data):
                    headers, block, at = parse(data, at)
                    digest, n = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                    if headers["WARC-Type"] == "response":
                        found = hashlib.sha1(block).hexdigest()
                        if found != digest or len(block) != n:
                            raise ValueError(f"damaged record {headers['WARC-Record-ID']} in {bundle}")
                    number = headers["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
                    refers = headers.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">")
                    rows.append((int(number) if number else None, n, digest, headers["WARC-Type"], int(refers) if refers else None, headers.get("WARC-Target-URI")))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)],
                        names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])
        if source is not None:
            source.close()

    return frames.mapInArrow(run, READ_SCHEMA)


def read_record(index_row: dict) -> tuple[dict[str, str], bytes]:
    """One record through its index row: one seek, one frame."""
    import zstandard

    filesystem, path = _filesystem(index_row["bundle"])
    with filesystem.open_input_file(path) as source:
        start, packed, plain = read_seek_table(source, source.size())[index_row["frame"]]
        source.seek(start)
        data = zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=max(plain, 1))
    headers, block, _ = parse(data, index_row["record_start"])
    return headers, block


def archived(pages: DataFrame, folder: str | None = None, **how) -> DataFrame:
    """Write ``pages`` to archives (by default in a new part of the shared folder) and read every record back."""
    spark = pages.sparkSession
    with tk.batches(spark):
        index = staged(write_archives(pages, folder or scratch_path(spark, "warc-bundles"), **how), "warc-index")
    return read_archives(spark, index)
