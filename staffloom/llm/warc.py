"""WARC archives, each record compressed by itself with a dictionary of its archive.

An archive starts with a skippable frame that holds a Zstandard dictionary; the frames after it are one record each,
so that a record can be read alone. The dictionary of an archive is built from the archive's own records, whole and spread evenly
over it, up to ``sample_bytes`` in all and one record more.

Records with equal payloads of ``least`` bytes or more are stored once: the one with the smallest id is the response, the
others are revisit records that refer to it. Which is decided by aggregation over payload digests, before anything is written.

Archives go to the shared folder. A task writes under a name of its own attempt and renames the finished file; only files of
tasks that succeeded are in the manifest, which is itself a written table, so a lost executor neither loses nor doubles a record.

Defined results: a null payload is an empty one; a null id is a response of its own; an empty table gives no archives; a repeated row gives a record each,
with the same id and type.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffloom.llm.shared import broadcast_within, written
from staffloom.sources.tables import shared_folder

SKIPPABLE = 0x184D2A5D  # the frame that holds the dictionary
NEW_LINE = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page}')}>"


def record(page: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload of its own."""
    kind = "response" if refers_to is None else "revisit"
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(page),
        "WARC-Date": DATE,
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Page-ID": page,
        "X-Payload-Length": str(len(payload)),
    }
    if refers_to is not None:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-ID": refers_to}
    body = payload if refers_to is None else b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + NEW_LINE * 2 + body
    headers |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}".encode("utf-8", "surrogatepass") + NEW_LINE for k, v in headers.items()) + NEW_LINE + block + NEW_LINE * 2


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = raw.partition(NEW_LINE * 2)
    lines = head.split(NEW_LINE)
    if lines[0] != b"WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.decode("utf-8", "surrogatepass").split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(NEW_LINE * 2)[2]


def samples_of(records: list[bytes], sample_bytes: int) -> list[bytes]:
    """Whole records spread evenly over the list, of about ``sample_bytes`` in all."""
    step, out, taken = max(1, -(-sum(map(len, records)) // sample_bytes)), [], 0
    for r in records[::step]:
        if taken >= sample_bytes:
            break
        out.append(r)
        taken += len(r)
    return out


def dictionary(records: list[bytes], size: int, sample_bytes: int) -> bytes:
    """A dictionary from records spread evenly over the list; raw content where there are too few to train one."""
    samples = samples_of(records, sample_bytes)
    try:
        return zstandard.train_dictionary(size, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def archive(records: list[bytes], level: int, size: int, sample_bytes: int) -> tuple[bytes, list[int]]:
    """The bytes of an archive and where each record begins."""
    raw = dictionary(records, size, sample_bytes)
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw))
    stored = zstandard.ZstdCompressor(level=level).compress(raw)
    parts = [struct.pack("<II", SKIPPABLE, len(stored)) + stored]
    places, at = [], len(parts[0])
    for r in records:
        places.append(at)
        parts.append(packer.compress(r))
        at += len(parts[-1])
    return b"".join(parts), places


def records_of(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one after another, reading it in chunks."""
    magic, length = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't begin with its dictionary")
    raw = zstandard.ZstdDecompressor().decompress(stream.read(length))
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    rest = stream.read(chunk)
    while rest:
        frame, out = reader.decompressobj(), []
        while True:
            out.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data or stream.read(chunk)
                break
            rest = stream.read(chunk)
            if not rest:
                raise ValueError("the archive ends within a record")
        yield b"".join(out)


def opened(folder: str):
    """(file system, path) of a folder by its address; tasks reach the shared store with it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)


#: Revisits up to which their marks are broadcast; beyond, the payloads are shuffled to them.
BROADCAST_REVISITS = 500_000


def with_types(pages: DataFrame, key: str, body: str, url: str, least: int) -> DataFrame:
    """Adds payload, digest, length and refers_to (null: a response).

    The first page of each digest comes from partial aggregates; a digest of a third of all rows is one row by then. Marks of revisits are
    narrow and, if few, broadcast, so that payloads stay where they were read.
    """
    payload = F.coalesce(F.col(body).cast("binary"), F.lit("").cast("binary"))
    full = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    marks = full.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page").alias("first"), F.max("page").alias("last")).where("first < last")
    groups = written(marks.select(F.col("digest").alias("_digest"), "first"), "warc-groups")
    refers_to = F.when(F.col("page") > F.col("first"), F.col("first").cast("string")).alias("refers_to")
    return full.join(broadcast_within(groups, BROADCAST_REVISITS), F.col("digest") == F.col("_digest"), "left").select("page", "url", "payload", "digest", refers_to)


def write_archives(pages: DataFrame, key: str = "page_id", body: str = "html", url: str = "url", least: int = 100, archive_bytes: int = 16 << 20, level: int = 3, dictionary_size: int = 64 << 10, sample_bytes: int = 4 << 20, folder: str | None = None) -> DataFrame:
    """Writes a record per page; returns the manifest: path, n_records, bytes.

    archive_bytes: records gathered for one archive before it is closed, the bound of a task's memory.
    """
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        held, size, number = [], 0, 0

        def close() -> pd.DataFrame:
            raw, _ = archive(held, level, dictionary_size, sample_bytes)
            name = f"{root}/part-{task.partitionId():05d}-{number:05d}"
            with store.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp", compression=None) as out:
                out.write(raw)
            store.move(f"{name}.{task.taskAttemptId()}.tmp", f"{name}-{task.taskAttemptId()}.warc.zst")
            return pd.DataFrame([(f"{name}-{task.taskAttemptId()}.warc.zst", len(held), len(raw))], columns=["path", "n_records", "bytes"])

        for batch in batches:
            for page, address, payload, digest, refers_to in batch.itertuples(index=False, name=None):
                held.append(record(page or "", address, payload, digest, refers_to))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    return written(with_types(pages, key, body, url, least).select(F.col("page").cast("string"), "url", "payload", "digest", "refers_to").mapInPandas(write, "path string, n_records long, bytes long"), "warc-manifest").withColumn("folder", F.lit(folder))


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, stored_digest (of a response's stored payload)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder, path in zip(batch["folder"], batch["path"], strict=True):
                store, _ = opened(folder)
                rows = []
                with store.open_input_stream(path, compression=None) as stream:
                    for raw in records_of(stream):
                        headers, payload = parsed(raw)
                        kind = headers["WARC-Type"]
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"page {headers['X-Page-ID']}: the payload doesn't match its digest")
                        rows.append((int(headers["X-Page-ID"]) if headers["X-Page-ID"] else None, int(headers["X-Payload-Length"]), digest, kind, int(headers["X-Refers-To-Page-ID"]) if kind == "revisit" else None))
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = manifest.select("folder", "path")
    n = max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism))
    return files.repartition(n).mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
