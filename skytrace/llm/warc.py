"""WARC archives with a two-level capture index.

Tasks write gzip records to archive files in the shared folder and return where each record went; Spark commits those rows, so
files of lost attempts are never referred to. Index lines (reversed-host key, record's place) are range-partitioned and sorted;
each part is a file of gzip blocks, with a sidecar directory that holds each block's first key. A lookup goes from the list of
parts to the sidecar to one block by binary search, then reads the record's byte range. Folders are opened through
pyarrow's file systems (file, HDFS and object stores).
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.llm.common import bound_batches, lookup
from skytrace.session import ensure_checkpoint_dir, store

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 128 << 20
BLOCK_LINES = 2048
PART_LINES = 1_000_000
SPAN_BYTES = 32 << 20
CAPTURED = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PLACED = "page_id {id}, key string, kind string, file string, at long, length long"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:/"):
        folder = "file:///" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def reversed_host_key(url: str | None) -> str:
    """``http://m.Example.org:80/a?b`` -> ``org,example,m)/a?b``; what has no host keeps its text after ``)/``."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text)
        host = parts.hostname or ""
    except ValueError:
        return ")/" + text
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    port = text.split("//", 1)[-1].split("/", 1)[0].rpartition("@")[2].rpartition(":")[2]
    shown = f":{port}" if port.isdigit() and port not in ("80", "443") and host else ""
    return ",".join(reversed(host.split("."))) + shown + ")" + (path if path.startswith("/") else "/" + path)


def _header(value: object) -> str:
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in str(value))


def _record_id(page_id: object) -> str:
    return "<urn:capture:page:none>" if page_id is None else f"<urn:capture:page:{page_id}>"


def record(page_id: object, url: str | None, payload: bytes, digest: str, revisit: bool, target: object) -> bytes:
    """One gzip member: a response with its payload, or a revisit that names the response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {CAPTURED}",
            f"WARC-Target-URI: {_header(url or 'about:blank')}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(target)}"]
    head += [f"Content-Length: {len(block)}", "", ""]
    coder = zlib.compressobj(3, zlib.DEFLATED, 31)
    return coder.compress("\r\n".join(head).encode()) + coder.compress(block + b"\r\n\r\n") + coder.flush()


def parse(member: bytes) -> dict:
    """Fields of one gzip member; digest and size come from the payload itself, for a revisit from its headers."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    named = lambda key: None if key not in fields or fields[key].endswith(":none>") else fields[key].rsplit(":", 1)[1][:-1]
    if kind == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
        digest = fields["WARC-Payload-Digest"][5:]
    return {"page_id": named("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "kind": kind, "size": size, "digest": digest,
            "refers_to": named("WARC-Refers-To"), "payload": payload if kind == "response" else None}


def _write_archives(batches: Iterator[pa.RecordBatch], folder: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    out, name, at = None, "", 0
    system, root = _open(folder)
    for batch in batches:
        ids, urls, payloads, digests, revisits, targets = (batch.column(i) for i in range(6))
        rows = []
        for page, url, payload, digest, again, target in zip(ids, urls, payloads, digests, revisits, targets):
            if out is None or at >= ARCHIVE_BYTES:
                if out is not None:
                    out.close()
                name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                out = system.open_output_stream(f"{root}/{name}", compression=None)
            link = url.as_py()
            member = record(page.as_py(), link, payload.as_py(), digest.as_py(), again.as_py(), target.as_py())
            out.write(member)
            rows.append((reversed_host_key(link), "revisit" if again.as_py() else "response", name, at, len(member)))
            at += len(member)
        keys, kinds, files, places, lengths = zip(*rows) if rows else ((), (), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [ids.cast(kind), pa.array(keys, pa.string()), pa.array(kinds, pa.string()), pa.array(files, pa.string()), pa.array(places, pa.int64()), pa.array(lengths, pa.int64())],
            ["page_id", "key", "kind", "file", "at", "length"])
    if out is not None:
        out.close()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every row of ``pages(page_id, url, html)``; (page_id, key, kind, file, at, length) of the records.

    A null html is an empty payload, a null url ``about:blank``. Of rows with equal payloads of at least 1000 bytes, the one with the largest
    page_id is the response (all of them, if that page_id is repeated), the others are revisits. Other columns are not read.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = bound_batches(pages).select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("target"))
    rows = lookup(rows, store(large.where("n > 1").select("digest", "target", F.lit(True).alias("shared"))), "digest", "left")
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("target"))
    rows = rows.select("page_id", "url", "payload", "digest", revisit.alias("revisit"), "target")
    spark_kind = pages.schema["page_id"].dataType.simpleString()
    arrow_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[spark_kind]
    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    return store(rows.mapInArrow(lambda it: _write_archives(it, folder, arrow_kind), PLACED.format(id=spark_kind)))


def _write_part(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    system, root = _open(folder)
    name, out, at, held, directory, last, size = f"{uuid.uuid4().hex}.cdx", None, 0, [], [], "", 0

    def flush() -> None:
        nonlocal at
        block = zlib.compress("\n".join(held).encode(), 6)
        directory.append([held[0].split("\t", 1)[0], at, len(block), len(held)])
        out.write(block)
        at += len(block)
        held.clear()

    for batch in batches:
        for row in batch.to_pylist():
            out = out or system.open_output_stream(f"{root}/{name}", compression=None)
            last = row["key"].replace("\t", "%09").replace("\n", "%0A")
            size += row["length"]
            held.append("\t".join([last, json.dumps([row["page_id"], row["kind"], row["file"], row["at"], row["length"]])]))
            if len(held) == BLOCK_LINES:
                flush()
    if out is not None:
        if held:
            flush()
        out.close()
        with system.open_output_stream(f"{root}/{name}.dir", compression=None) as side:
            side.write(json.dumps(directory).encode())
        yield pa.RecordBatch.from_pylist(
            [{"first": directory[0][0], "last": last, "file": name, "lines": sum(d[3] for d in directory), "bytes": size}],
            pa.schema([("first", pa.string()), ("last", pa.string()), ("file", pa.string()), ("lines", pa.int64()), ("bytes", pa.int64())]))


def write_index(placed: DataFrame, folder: str) -> DataFrame:
    """Sorted index parts of the stored records: (first, last, file, lines, bytes of the records) per part."""
    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    parts = max(1, -(-placed.count() // PART_LINES))
    order = ["key", "page_id", "file", "at"]
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return store(ordered.mapInArrow(lambda it: _write_part(it, folder), "first string, last string, file string, lines long, bytes long"))


def _block(system: pafs.FileSystem, path: str, at: int, length: int) -> list[str]:
    with system.open_input_file(path) as f:
        return zlib.decompress(f.read_at(length, at)).decode().split("\n")


def read_records(entries: DataFrame, folder: str, size: int, payloads: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) from byte ranges of the archives.

    ``size``, the bytes of all records, sets the number of tasks: about one per 32 MB.
    """
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(fields + [("payload", pa.binary())] * payloads)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        name, f = None, None
        for batch in batches:
            rows, held = [], 0
            for want in batch.to_pylist():
                if want["file"] != name:
                    name, f = want["file"], system.open_input_file(f"{root}/{want['file']}")
                got = parse(f.read_at(want["length"], want["at"]))
                row = {"page_id": got["page_id"] and int(got["page_id"]), "url": got["url"], "payload_bytes": got["size"], "payload_digest": got["digest"], "record_type": got["kind"], "refers_to": got["refers_to"] and int(got["refers_to"])}
                rows.append(row | {"payload": got["payload"]} if payloads else row)
                held += got["size"] * payloads
                if held > SPAN_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)

    spans = entries.repartition(max(1, -(-size // SPAN_BYTES)), "file", F.floor(F.col("at") / (SPAN_BYTES // 8))).sortWithinPartitions("file", "at")
    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return spans.mapInArrow(read, kinds + ", payload binary" * payloads)


def find(urls: DataFrame, parts: DataFrame, index_folder: str) -> DataFrame:
    """(url, file, at, length) of every capture of ``urls(url)``: parts, then sidecar, then block by binary search.

    The list of parts has one row per million records and is sent to the tasks; it is refused beyond 100,000 rows.
    """
    rows = sorted(parts.select("first", "last", "file").limit(100_001).collect())
    if len(rows) > 100_000:
        raise ValueError("too many index parts: raise PART_LINES")
    lasts = [r["last"] for r in rows]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(index_folder)

        @lru_cache(maxsize=64)
        def directory(name: str) -> list:
            with system.open_input_file(f"{root}/{name}.dir") as f:
                return json.loads(f.read())

        for batch in batches:
            out = []
            for url in batch.column(0).to_pylist():
                key = reversed_host_key(url).replace("\t", "%09").replace("\n", "%0A")
                for part in rows[bisect_left(lasts, key):]:
                    if part["first"] > key:
                        break
                    blocks = directory(part["file"])
                    firsts = [b[0] for b in blocks]
                    for _, at, length, _ in blocks[max(0, bisect_left(firsts, key) - 1):bisect_right(firsts, key)]:
                        out.append({"url": url, "key": key, "file": part["file"], "at": at, "length": length})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("url", pa.string()), ("key", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("length", pa.int64())]))

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(index_folder)
        schema = pa.schema([("url", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("length", pa.int64())])
        place, lines, out = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if place != (row["file"], row["at"]):
                    place, lines = (row["file"], row["at"]), _block(system, f"{root}/{row['file']}", row["at"], row["length"])
                key = row["key"] + "\t"
                for line in lines[bisect_left(lines, key):]:
                    if not line.startswith(key):
                        break
                    out.append({"url": row["url"], **dict(zip(("file", "at", "length"), json.loads(line.split("\t", 1)[1])[2:]))})
                if len(out) >= BLOCK_LINES:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    # a key's captures may fill many blocks: blocks are spread over tasks, each opened once
    lines = parts.agg(F.sum("lines")).first()[0] or 0
    near = urls.select("url").mapInArrow(places, "url string, key string, file string, at long, length long")
    spread = near.repartition(max(1, -(-lines // (32 * BLOCK_LINES))), "file", "at").sortWithinPartitions("file", "at", "key")
    return spread.mapInArrow(captures, "url string, file string, at long, length long")


def shared_folder(pages: DataFrame) -> str:
    ensure_checkpoint_dir(pages.sparkSession)
    return f"{pages.sparkSession.sparkContext.getCheckpointDir()}/warc/{uuid.uuid4().hex}"


def read_back(urls: DataFrame, parts: DataFrame, folder: str) -> DataFrame:
    """The records of all captures of ``urls(url)``, found by searching the index. Each revisit is held against the response it names: size and digest
    are the response's, and a revisit without such a response is an error. If ``urls`` holds every url, fewer captures than the index lists are an error too."""
    entries = store(find(urls.distinct(), parts, f"{folder}/index").select("file", "at", "length").distinct())
    listed = parts.agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes")).first()
    if entries.count() != (listed["lines"] or 0):
        raise RuntimeError(f"the index lists {listed['lines']} captures, the search found {entries.count()}")
    records = store(read_records(entries, f"{folder}/archives", listed["bytes"] or 0))
    whole = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("held"))
    named = records.where("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    joined = lookup(records, store(whole.join(named, ["refers_to", "payload_digest"], "left_semi").distinct()), ["refers_to", "payload_digest"], "left")
    lost = (F.col("record_type") == "revisit") & (F.col("held").isNull() | (F.col("held") != F.col("payload_bytes")))
    size = F.when(lost, F.raise_error(F.concat(F.lit("no matching response for the revisit of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))).otherwise(F.col("payload_bytes"))
    return joined.withColumn("payload_bytes", size.cast("long")).select(*records.columns)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages and their index, then find every page's url in the index and read its records. An empty table writes no file."""
    folder = folder or shared_folder(pages)
    parts = write_index(write_archives(pages, f"{folder}/archives"), f"{folder}/index")
    return read_back(pages.select(F.col("url").cast("string").alias("url")), parts, folder)
