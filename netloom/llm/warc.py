"""WARC archives: a writer, a normaliser of monolithic gzip files, and a reader that goes by the sidecar index.

A monolithic archive is one gzip stream over many records, so no record can be read without all before it. The normaliser inflates such a file
once, as a stream, rewrites every record as a gzip member of its own and writes the members' offsets beside it. Files go through pyarrow's
file systems into a folder that all executors share. A file's name holds a random part, and only files that a finished task has reported are ever
read: a task that runs again leaves a file that nobody reads, never a broken one.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import Store, delete, small

#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_REVISIT = 100
#: Bytes of payload after which a task begins another archive.
FILE_BYTES = 256 << 20
READ = 1 << 20

#: Fixed by the WARC 1.1 standard.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(headers: dict[str, str], payload: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(payload)}\r\n\r\n"
    return VERSION + lines.encode() + payload + b"\r\n\r\n"


def one_line(value: str | None) -> str:
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in value or "")


class Parser:
    """Records out of an inflated stream that arrives in pieces; holds one record at most."""

    def __init__(self):
        self.held = bytearray()
        self.head: dict[str, str] | None = None
        self.raw_head = 0

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
        """(headers by their names in lower case, block, the whole record) of each record that is now complete."""
        self.held += piece
        while True:
            if self.head is None:
                end = self.held.find(b"\r\n\r\n")
                if end < 0:
                    return
                lines = bytes(self.held[:end]).decode("utf-8").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError("not a WARC record")
                self.head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                self.raw_head = end + 4
            whole = self.raw_head + int(self.head["content-length"]) + 4
            if len(self.held) < whole:
                return
            raw = bytes(self.held[:whole])
            head, begin = self.head, self.raw_head
            del self.held[:whole]
            self.head = None
            yield head, raw[begin:-4], raw

    def close(self) -> None:
        if self.held:
            raise ValueError("the stream ends within a record")


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in bounded pieces; raises if the last member is cut short."""
    engine, within = zlib.decompressobj(31), False
    for chunk in chunks:
        while chunk:
            within = True
            out = engine.decompress(chunk, READ)
            if out:
                yield out
            if engine.eof:
                chunk, engine, within = engine.unused_data, zlib.decompressobj(31), False
            else:
                chunk = engine.unconsumed_tail
    tail = engine.flush()
    if tail:
        yield tail
    if within and not engine.eof:
        raise ValueError("the gzip stream ends early")


def http_head(payload_bytes: int) -> bytes:
    """What stands before the payload in the block of a response."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def _chunks(stream) -> Iterator[bytes]:
    while chunk := stream.read(READ):
        yield chunk


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    return files, path


def _write_monolithic(folder: str, level: int, file_bytes: int, date: str) -> Callable:
    """Archives of the rows (id, url, payload, digest, target, target_url), each one gzip stream; a row (path, records) for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, engine, name, count, size, done = None, None, "", 0, 0, []
        files, path = _opened(folder)

        def close() -> None:
            nonlocal out
            out.write(engine.flush())
            out.close()
            out = None
            done.append((name, count))

        for batch in batches:
            ids, urls, payloads, digests, refers, refers_urls = (batch.column(i) for i in range(6))
            for i in range(len(batch)):
                if out is None:
                    name, count, size = f"{path}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, engine = files.open_output_stream(name, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                payload = payloads[i].as_py()
                target = refers[i].as_py()
                page = ids[i].as_py()
                head = {
                    "WARC-Type": "response" if target is None else "revisit",
                    "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page}')}>",
                    "WARC-Date": date,
                    "WARC-Target-URI": one_line(urls[i].as_py()),
                    "WARC-Page-ID": "" if page is None else str(page),
                    "WARC-Payload-Digest": f"sha256:{digests[i].as_py()}",
                    "WARC-Payload-Length": str(len(payload)),
                    "Content-Type": "application/http; msgtype=response",
                }
                if target is not None:
                    head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{target}')}>", "WARC-Refers-To-Page-ID": str(target)}
                    head |= {"WARC-Refers-To-Target-URI": one_line(refers_urls[i].as_py()), "WARC-Refers-To-Date": date}
                out.write(engine.compress(record(head, http_head(len(payload)) + (payload if target is None else b""))))
                count, size = count + 1, size + len(payload)
                if size >= file_bytes:
                    close()
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    return run


def _normalise(folder: str, level: int) -> Callable:
    """Rewrites each archive of the rows (path, ...) with a member for each record and an index beside it; a row for each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _opened(folder)
        for batch in batches:
            for source, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{path}/{uuid.uuid4().hex}.warc.gz"
                offset, entries, parser = 0, [], Parser()
                with files.open_input_stream(source, compression=None) as stream, files.open_output_stream(target, compression=None) as out, files.open_output_stream(f"{target}.idx") as index:
                    for piece in inflate(_chunks(stream)):
                        for head, _, raw in parser.feed(piece):
                            engine = zlib.compressobj(level, zlib.DEFLATED, 31)
                            member = engine.compress(raw) + engine.flush()
                            out.write(member)
                            index.write(json.dumps({"offset": offset, "length": len(member), "uri": head.get("warc-target-uri"), "page": head.get("warc-page-id"), "type": head["warc-type"]}).encode() + b"\n")
                            entries.append((offset, len(member)))
                            offset += len(member)
                    parser.close()
                if expected is not None and len(entries) != expected:
                    raise ValueError(f"{source} has {len(entries)} records instead of {expected}")
                if entries:
                    yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([len(entries)], pa.int64())], names=["path", "records"])

    return run


def _read_back(folder: str) -> Callable:
    """Every record of the normalised archives in folder, found by its offset in the sidecar index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _opened(folder)
        for batch in batches:
            for source, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_stream(f"{source}.idx") as stream:
                    entries = [json.loads(x) for x in stream.read().splitlines()]
                if len(entries) != expected:
                    raise ValueError(f"{source} has {len(entries)} records in its index instead of {expected}")
                with files.open_input_file(source) as archive:
                    for at in range(0, len(entries), 256):
                        rows = []
                        for e in entries[at : at + 256]:
                            raw = zlib.decompress(archive.read_at(e["length"], e["offset"]), 31)
                            ((head, block, _),) = Parser().feed(raw)
                            payload = block.partition(b"\r\n\r\n")[2]
                            digest = head["warc-payload-digest"].removeprefix("sha256:")
                            n = int(head["warc-payload-length"])
                            if head["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != n):
                                raise ValueError(f"{source} at {e['offset']}: the payload is not the one that was written")
                            page, refers = head["warc-page-id"], head.get("warc-refers-to-page-id")
                            rows.append((int(page) if page else None, n, digest, head["warc-type"], int(refers) if refers else None, source, e["offset"], e["length"]))
                        yield pa.RecordBatch.from_pylist([dict(zip(RECORDS.names, r, strict=True)) for r in rows], schema=RECORDS)

    return run


RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("member_offset", pa.int64()), ("member_length", pa.int64())])


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """archives(path, ...) of gzip WARC files to (path, records) of the same records with a gzip member each and path.idx beside it.

    Where archives has a column records, a file with another number of records raises, as does one that ends early.
    """
    records = F.col("records") if "records" in archives.columns else F.lit(None)
    one_each = archives.select("path", records.cast("long").alias("records")).repartition(max(1, archives.count()), "path")
    return one_each.mapInArrow(_normalise(folder, level), "path string, records long")


def archive_pages(pages: DataFrame, store: Store, level: int = 6, file_bytes: int = FILE_BYTES, date: str | None = None) -> DataFrame:
    """pages(page_id, url, html, ...) written as WARC, normalised and read back: a row per input row with where it lies.

    The payload is html in UTF-8; null html is an empty payload, a null url an empty one. Of equal payloads of at least LEAST_REVISIT bytes the
    smallest page_id is the response and the others are revisits of it, which store no payload. date is that of every record, by default the time of the call. Rows without an id are always responses. Rows
    that repeat the page_id of a response are responses too. Other columns are ignored; an empty table gives an empty result.
    """
    date = date or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.encode(html, "utf-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # narrow rows only are shuffled to find equal payloads; the pages stay where they are
    large = store.cut(rows.select("id", "url", "digest", F.octet_length("payload").alias("n")).where(F.col("id").isNotNull() & (F.col("n") >= LEAST_REVISIT)).select("id", "url", "digest"), "digests")
    first = large.groupBy("digest").agg(F.min(F.struct("id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("first.id").alias("target"), F.col("first.url").alias("target_url"))
    revisits = store.cut(large.select("id", "digest").join(first, "digest").where("id <> target").distinct(), "revisits")
    decided = rows.join(small(revisits, 100_000), ["id", "digest"], "left").select("id", "url", "payload", "digest", "target", "target_url")
    written = store.cut(decided.mapInArrow(_write_monolithic(f"{store.root}/streams", 1, file_bytes, date), "path string, records long"), "written")
    normal = store.cut(normalise(written, f"{store.root}/archives", level), "normal")
    delete(pages.sparkSession, f"{store.root}/streams")
    return normal.repartition(max(1, normal.count()), "path").mapInArrow(_read_back(f"{store.root}/archives"), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, member_offset long, member_length long")
