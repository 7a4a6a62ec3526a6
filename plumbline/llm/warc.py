"""WARC archives with a two-level capture index (operator 1).

Level one: captures sorted by reversed-host URL key, in compressed blocks of an index
shard. Level two: each shard's sparse directory of its blocks' first keys; above them the
shards' own key ranges. A lookup bisects the shards, then one directory, and range-reads
blocks and records only.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import store

MANIFEST = "key string, page_id long, file string, at long, size long"
CAPTURE = MANIFEST
SHARD = "first_key string, last_key string, file string, n_blocks long, n_captures long"
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


#: Characters that a key keeps; others are percent-encoded. A tab, which ends a key in an index line, sorts before all.
_KEY_SAFE = "!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~"


def url_key(url: str | None) -> str:
    """``https://blog.example.com/a?b`` as ``com,example,blog)/a?b``; null and no host: ``)...``."""
    if not url:
        return ")"
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").rstrip("."), u.port
    except ValueError:
        host, port = "", None
    if not host:
        return quote(")" + url.lower(), safe=_KEY_SAFE)
    tail = (u.path or "/") + (f"?{u.query}" if u.query else "")
    at = f":{port}" if port and port not in (80, 443) else ""
    return quote((",".join(reversed(host.split("."))) + at + ")" + tail).lower(), safe=_KEY_SAFE)


def _header_text(value: str) -> str:
    return quote(value, safe="!#$%&'()*+,-./:;=?@[]_~")


def _record(row_id: int, page_id, url: str | None, payload: bytes, digest: str, refers: tuple | None) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit keeps the HTTP head, which says the full length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}:{row_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, f"WARC-Target-URI: {_header_text(url)}")
    if refers:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:x-page:{'' if refers[0] is None else refers[0]}:{refers[1]}>",
        ]
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields (lower-case names), HTTP head and payload of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def write_archives(pages: DataFrame, out: str, min_bytes: int = 0, max_file: int = 1 << 30) -> DataFrame:
    """Write a record for every row (page_id, url, html) below ``out``; returns the manifest.

    Of rows with equal payloads of ``min_bytes`` or more, that with the largest page_id (null is
    smallest; of repeated rows, one) is the response and the others are revisits of it. A null
    html is an empty payload. Each task attempt writes its own files and only those of the
    attempt that Spark commits reach the manifest, so lost executors leave no doubles.
    ``pages`` must give its rows in the same order when it is read again, as files do.
    """
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
        F.monotonically_increasing_id().alias("rid"),
    ).withColumn("digest", F.sha1("payload"))
    top = base.groupBy("digest").agg(F.max(F.struct("page_id", "rid")).alias("top"))
    # one row a digest on the right: a hot digest's rows on the left can be split at will
    rows = base.join(top, "digest", "left").select(
        "rid", "page_id", "url", "payload", "digest",
        F.when((F.octet_length("payload") >= min_bytes) & (F.col("rid") != F.col("top.rid")), F.col("top.page_id")).alias("ref_page"),
        F.when((F.octet_length("payload") >= min_bytes) & (F.col("rid") != F.col("top.rid")), F.col("top.rid")).alias("ref_rid"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store.file_system(out)
        fs.create_dir(root, recursive=True)
        task, sink, at, k, found = TaskContext.get(), None, 0, 0, []
        for batch in batches:
            for rid, page, url, payload, digest, ref_page, ref_rid in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is None or at >= max_file:
                    if sink is not None:
                        sink.close()
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{k}.warc.gz"
                    sink, at, k = fs.open_output_stream(f"{root}/{name}", compression=None), 0, k + 1
                name32 = base64.b32encode(bytes.fromhex(digest)).decode()
                data = _record(rid, page, url, payload, name32, None if ref_rid is None else (ref_page, ref_rid))
                sink.write(data)
                found.append((url_key(url), page, name, at, len(data)))
                at += len(data)
            if len(found) >= 20000:
                yield _rows(found, MANIFEST)
                found = []
        if sink is not None:
            sink.close()
        if found:
            yield _rows(found, MANIFEST)

    return store.materialize(rows.mapInArrow(run, MANIFEST), "warc-manifest")


def build_index(manifest: DataFrame, out: str, block_lines: int = 256) -> DataFrame:
    """Sort captures by key into shards of compressed blocks below ``out``; returns the shards.

    Captures of one hot key may span blocks and shards: the order goes on with page and place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store.file_system(out)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"shard-{task.partitionId():05d}-{task.taskAttemptId()}.idx"
        sink, at, directory, lines, n, last = None, 0, [], [], 0, None

        def flush():
            nonlocal at, lines
            body = "\n".join(lines).encode()
            data = zlib.compress(body, 6)
            directory.append((lines[0].split("\t", 1)[0], at, len(data)))
            sink.write(data)
            at, lines = at + len(data), []

        for batch in batches:
            for key, page, file, start, size in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is None:
                    sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                last = key
                lines.append(f"{key}\t{'' if page is None else page}\t{file}\t{start}\t{size}")
                n += 1
                if len(lines) == block_lines:
                    flush()
        if sink is None:
            return
        if lines:
            flush()
        body = zlib.compress("\n".join(f"{k}\t{a}\t{s}" for k, a, s in directory).encode(), 6)
        sink.write(body)
        sink.write(struct.pack("<QQ", at, len(body)))
        sink.close()
        yield _rows([(directory[0][0], last, name, len(directory), n)], SHARD)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = manifest.repartitionByRange(n, "key", "page_id", "file", "at").sortWithinPartitions("key", "page_id", "file", "at")
    return store.materialize(keyed.mapInArrow(run, SHARD), "warc-shards")


def lookup(keys: DataFrame, shards: DataFrame, index_dir: str) -> DataFrame:
    """All captures of the given distinct keys (column ``key``), one row each.

    The driver holds the shards' key ranges only, one row a shard (as many as shuffle
    partitions). Keys are dealt to the shards that may hold them; each shard's task
    bisects the block directory and reads the blocks it needs.
    """
    ranges = sorted((r.first_key, r.last_key, r.file) for r in shards.collect())
    firsts, lasts, files = ([r[i] for r in ranges] for i in range(3))

    def route(batches):
        for batch in batches:
            out = []
            for k in batch.column(0).to_pylist():
                i = bisect_left(lasts, k)
                while i < len(files) and firsts[i] <= k:
                    out.append((files[i], k))
                    i += 1
            if out:
                yield _rows(out, "shard string, key string")

    def search(batches):
        fs, root = store.file_system(index_dir)
        state: dict = {}

        def block(i):
            if state.get("block") != i:
                _, at, size = state["directory"][i]
                state["lines"] = zlib.decompress(state["file"].read_at(size, at)).decode().split("\n")
                state["block"] = i
            return state["lines"]

        for batch in batches:
            out = []
            for shard, key in zip(*(c.to_pylist() for c in batch.columns)):
                if state.get("shard") != shard:
                    f = fs.open_input_file(f"{root}/{shard}")
                    end = f.size()
                    at, size = struct.unpack("<QQ", f.read_at(16, end - 16))
                    rows = (x.split("\t") for x in zlib.decompress(f.read_at(size, at)).decode().split("\n"))
                    directory = [(k, int(a), int(s)) for k, a, s in rows]
                    state = {"shard": shard, "file": f, "directory": directory, "keys": [d[0] for d in directory]}
                i = max(0, bisect_left(state["keys"], key) - 1)
                while i < len(state["keys"]) and state["keys"][i] <= key:
                    lines = block(i)
                    j = bisect_left(lines, key + "\t")
                    while j < len(lines) and lines[j].startswith(key + "\t"):
                        k, page, file, start, size = lines[j].split("\t")
                        out.append((k, int(page) if page else None, file, int(start), int(size)))
                        j += 1
                        if len(out) >= 20000:  # one key may have most of a shard's captures
                            yield _rows(out, CAPTURE)
                            out = []
                    i += 1
            if out:
                yield _rows(out, CAPTURE)

    routed = keys.select("key").mapInArrow(route, "shard string, key string")
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return routed.repartition(n, "shard").sortWithinPartitions("shard", "key").mapInArrow(search, CAPTURE)


def read_records(captures: DataFrame, archive_dir: str, span: int = 8 << 20) -> DataFrame:
    """Range-read the captures' records; a response's payload is held against its digest."""

    def run(batches):
        fs, root = store.file_system(archive_dir)
        name = file = None
        for batch in batches:
            out = []
            for file_name, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                if file_name != name:
                    name, file = file_name, fs.open_input_file(f"{root}/{file_name}")
                fields, http, payload = parse_record(file.read_at(size, at))
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2]
                n = int(http.rpartition(b"Content-Length: ")[2])
                if kind == "response" and (n != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"{name} at {at}: the payload is not what its digest says")
                page, refers = (fields[k].split(":")[2] if k in fields else "" for k in ("warc-record-id", "warc-refers-to"))
                out.append((int(page) if page else None, n, digest, kind, int(refers) if refers else None, fields.get("warc-target-uri")))
            if out:
                yield _rows(out, PAGE)

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = captures.select("file", "at", "size").repartition(n, "file", F.floor(F.col("at") / span)).sortWithinPartitions("file", "at")
    return dealt.mapInArrow(run, PAGE)


def roundtrip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive ``pages``, index the captures, and read every page back through the index."""
    archives, index = store.new_dir(spark, "warc"), store.new_dir(spark, "warc-index")
    manifest = write_archives(pages, archives, min_bytes)
    shards = build_index(manifest, index)
    return read_records(lookup(manifest.select("key").distinct(), shards, index), archives)


_TYPES = {"string": pa.string(), "long": pa.int64()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])
