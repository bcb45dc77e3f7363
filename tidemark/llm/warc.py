"""Web archives as bundles of independent Zstandard frames with a seek table at the end.

Each task writes its records into bundles in a shared folder. A frame holds whole records and can be
read alone; the seek table (the published seekable format: a skippable frame at the end) gives the
sizes of all frames; the index maps each record to its bundle, frame, and place within the frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, fresh, table

INDEX = "page_id long, record_id string, bundle string, frame long, frame_at long, frame_size long, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, bundle string, frame long, offset long"
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE, NO_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAME = "urn:x-page:"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record of an HTTP response, or of a revisit that has the response's headers alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    target = "".join(c for c in (url or "") if c.isprintable() and c != " ")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{_NAME}{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        *([("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{_NAME}{refers_to}>")] if refers_to is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The fields and the block of the record at ``at``, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    start = end + 4
    stop = start + int(fields["Content-Length"])
    block = data[start:stop]
    if sha1_base32(block) != fields["WARC-Block-Digest"].removeprefix("sha1:") or data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} is damaged")
    return fields, block, stop + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), NO_CHECKSUMS, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(tail: bytes) -> list[tuple[int, int]]:
    """Compressed and plain sizes of the frames, from the last bytes of a bundle."""
    n, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    body = tail[-9 - 8 * n : -9]
    return [struct.unpack_from("<II", body, 8 * i) for i in range(n)]


def _open(uri: str):
    """The file system of a shared folder's address and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class BundleWriter:
    """Appends frames to one bundle; the file gets its name only when it is whole."""

    def __init__(self, folder: str, name: str, level: int):
        import zstandard

        self.fs, root = _open(folder)
        self.fs.create_dir(root, recursive=True)
        self.final, self.name = f"{root}/{name}", name
        self.part = f"{self.final}.{TaskContext.get().taskAttemptId()}"
        self.out = self.fs.open_output_stream(self.part)
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.at = 0

    def frame(self, plain: bytes) -> tuple[int, int, int]:
        packed = self.zstd.compress(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain)))
        place = (len(self.frames) - 1, self.at, len(packed))
        self.at += len(packed)
        return place

    def close(self) -> None:
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.fs.move(self.part, self.final)  # a second attempt brings the same bytes


def with_refers_to(pages: DataFrame, scratch: Scratch, least_bytes: int, digest: str, refers: str) -> DataFrame:
    """``pages`` plus the hex digest and, for all but the first page of an equal payload, its page_id.

    Only payloads that occur more than once are joined; they are counted where they lie first. The
    page ids of a payload are never gathered, so a payload that a third of all pages share is no
    burden: its rows meet one row, and a large side is split by adaptive execution.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    (first,) = fresh(pages, "first_page")
    hashed = pages.withColumn(digest, F.sha1(payload))
    large = hashed.where(F.octet_length(payload) >= least_bytes)
    shared = large.groupBy(F.col(digest).alias("d")).agg(F.min("page_id").alias(first), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = scratch.put(shared, "shared-payloads")
    joined = hashed.join(shared, F.col(digest) == F.col("d"), "left").drop("d")
    return joined.withColumn(refers, F.when(F.col("page_id") != F.col(first), F.col(first))).drop(first)


def write_archives(pages: DataFrame, folder: str, *, least_bytes: int = 0, frame_bytes: int = 1 << 20, bundle_bytes: int = 1 << 28, level: int = 6, date: str = "2024-01-01T00:00:00Z", scratch: Scratch | None = None) -> DataFrame:
    """Writes one record per page into bundles in ``folder`` and returns the index, itself a table.

    ``pages`` has page_id, url and html; other columns are ignored. Null html is an empty payload, a
    null url an empty target. Of equal payloads of ``least_bytes`` or more, that with the smallest
    page_id is a response and the rest revisit it; rows that repeat that page_id are responses too,
    and rows without a page_id are responses always. A page longer than a frame is a frame of its own.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = with_refers_to(own, scratch, least_bytes, "digest", "refers_to").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, n, held, waiting = None, 0, [], 0
        part = TaskContext.get().partitionId()

        def flush() -> pd.DataFrame:
            nonlocal held, waiting, writer, n
            if writer is None:
                writer = BundleWriter(folder, f"bundle-{part:06d}-{n:04d}.warc.zst", level)
                n += 1
            frame, at, size = writer.frame(b"".join(r for _, r in held))
            out, offset = [], 0
            for page_id, r in held:
                out.append((page_id, f"{_NAME}{'' if page_id is None else page_id}", f"{folder}/{writer.name}", frame, at, size, offset, len(r)))
                offset += len(r)
            held, waiting = [], 0
            if writer.at >= bundle_bytes:
                writer.close()
                writer = None
            return pd.DataFrame(out, columns=["page_id", "record_id", "bundle", "frame", "frame_at", "frame_size", "offset", "length"]).astype({"page_id": "Int64"})

        for b in batches:
            for page_id, url, html, refers in zip(b["page_id"], b["url"], b["html"], b["refers_to"], strict=True):
                page_id = None if pd.isna(page_id) else int(page_id)
                r = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), None if pd.isna(refers) else int(refers), date)
                if held and waiting + len(r) > frame_bytes:
                    yield flush()
                held.append((page_id, r))
                waiting += len(r)
        if held:
            yield flush()
        if writer is not None:
            writer.close()

    return scratch.put(rows.mapInPandas(run, INDEX), "index")


def read_archives(index: DataFrame, *, task_bytes: int = 1 << 27) -> DataFrame:
    """Reads the records that the index names, each frame once, and checks every digest.

    Frames are dealt out by name to so many tasks that each reads about ``task_bytes`` and no core is
    idle; an empty index gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        zstd = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for bundle, frame, at, size, wanted in zip(b["bundle"], b["frame"], b["frame_at"], b["frame_size"], b["offsets"], strict=True):
                fs, path = _open(bundle)
                with fs.open_input_file(path) as f:
                    f.seek(at)
                    plain = zstd.decompress(f.read(size))
                for offset in sorted(wanted):
                    fields, block, _ = parse(plain, offset)
                    head, payload = block.split(b"\r\n\r\n", 1)
                    length = int(head.decode().split("Content-Length: ")[1].split("\r\n")[0])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (len(payload) != length or sha1_base32(payload) != digest):
                        raise ValueError(f"the payload at {offset} in frame {frame} of {bundle} is damaged")
                    own = fields["WARC-Record-ID"][1:-1].removeprefix(_NAME)
                    to = fields.get("WARC-Refers-To", "<>")[1:-1].removeprefix(_NAME)
                    out.append((int(own) if own else None, length, digest, fields["WARC-Type"], int(to) if to else None, fields["WARC-Target-URI"], bundle.rpartition("/")[2], frame, offset))
            yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "bundle", "frame", "offset"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    plain_bytes = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-plain_bytes // task_bytes))
    frames = index.repartition(tasks, "bundle", "frame").groupBy("bundle", "frame", "frame_at", "frame_size").agg(F.collect_list("offset").alias("offsets"))
    return frames.mapInPandas(run, RECORDS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page into bundles beside the scratch tables and reads them back."""
    scratch = Scratch(spark)
    index = write_archives(table(spark, sf_dir, "pages"), f"{scratch.root}/archives", scratch=scratch)
    return read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((cast('0x' || substr(h, {5 * g + 1}, 5) as integer) >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
OP7_SQL = f"""
with p as (select page_id, coalesce(html, '') as body from pages), d as (select page_id, strlen(body) as n, sha1(body) as h from p),
f as (select *, min(page_id) over (partition by h) as first from d)
select page_id, n as payload_bytes, {_BASE32} as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from f
"""
