"""WARC: a deterministic sharded writer (range sort, roll by compressed size, digests, manifest commit) and its reader."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


#: HTML bytes of a shard, from which the number of shards follows.
SHARD_BYTES = 256 << 20


def _store(folder: str):
    """File system and path of the shared folder, for tasks; Hadoop's name of an S3 store is taken too."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(f"s3://{folder[6:]}" if folder.startswith("s3a://") else folder)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, key)}>"


def encode(key: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record with regenerated headers; the same row gives the same bytes. A revisit has no payload."""
    block = HTTP_HEAD if refers_to is not None else HTTP_HEAD + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(key)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(c for c in url or "" if c not in "\r\n")),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields += [("X-Page-Id", key), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        fields += [("X-Refers-To-Page", refers_to)]
    fields += [("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def members(stream: io.RawIOBase, step: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream one by one, in memory bounded by the largest."""
    packed, out, d = b"", [], zlib.decompressobj(31)
    while chunk := packed or stream.read(step):
        out.append(d.decompress(chunk))
        packed = b""
        if d.eof:
            packed = d.unused_data
            yield b"".join(out)
            out, d = [], zlib.decompressobj(31)
    if out and any(out):
        raise ValueError("the archive ends inside a record")


def decode(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; its length and block digest are checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a record: {lines[0][:40]}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(rest) != len(block) + 4 or f"sha1:{digest(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return fields, block


def marked(pages: DataFrame, min_revisit_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """The pages (mark 1), and before each page that revisits another a row (mark 0) with its payload hash and the id it refers to.

    Of equal payloads the smallest id is the response. Payloads are grouped by SHA-256 with partial aggregates over digests alone; the marks
    reach the pages by the writer's own range partitioning, so pages are shuffled once.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.lit(1).alias("mark"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.lit(None).cast(pages.schema[id_col].dataType).alias("refers_to"))
    keyed = rows.where(F.octet_length("html") >= min_revisit_bytes).select("page_id", F.unhex(F.sha2("html", 256)).alias("h"))
    first = keyed.groupBy("h").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("h", "first")
    later = keyed.join(first, "h").where("page_id > first").select("page_id", F.lit(0).alias("mark"), F.lit(None).cast("string").alias("url"), F.hex("h").alias("html"), F.col("first").alias("refers_to")).distinct()
    return rows.unionByName(later)


def write_warc(pages: DataFrame, folder: str, *, roll_bytes: int = 64 << 20, shards: int | None = None, min_revisit_bytes: int = 0, level: int = 6, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row into `folder`; returns the manifest: path, records, bytes, sha256, first_id, last_id.

    Rows are range-partitioned by id (sampled splitters) and sorted inside each shard; a shard's file is rolled
    once it reaches `roll_bytes` compressed. A file is written under a temporary name of its task attempt and
    renamed when whole, so that a lost executor or a speculative attempt leaves no half file; the manifest, which
    names the files that count, is written last under a temporary name and renamed. The bytes of each record follow from
    its row alone, and for a given `shards` the order of records in the archive set is that of the ids.
    A null payload is empty, a null url an empty target; repeated ids give repeated records; an empty table gives
    an empty manifest. Extra columns are not read.
    """
    spark = pages.sparkSession
    rows = marked(pages, min_revisit_bytes, id_col, url_col, html_col)
    total = pages.agg(F.sum(F.octet_length(html_col))).first()[0] or 0
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    spread = F.when(F.col("page_id").isNull(), F.xxhash64("url", "html"))  # rows without an id are dealt out too
    ranged = rows.repartitionByRange(n, F.col("page_id"), spread).sortWithinPartitions("page_id", "mark", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    schema = f"path string, records long, bytes long, sha256 string, first_id {kind}, last_id {kind}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        done, state = [], None

        def close() -> None:
            nonlocal state
            state["out"].close()
            final = f"{root}/part-{context.partitionId():06d}-{len(done):04d}.warc.gz"
            if store.get_file_info(final).is_file:  # of an earlier attempt at this task, with the same bytes: some stores don't overwrite
                store.delete_file(final)
            store.move(state["temp"], final)
            done.append({"path": final.rsplit("/", 1)[1], "records": state["n"], "bytes": state["bytes"], "sha256": state["sha"].hexdigest(), "first_id": state["first"], "last_id": state["last"]})
            state = None

        marks: dict = {}
        for batch in batches:
            for key, mark, url, html, ref in zip(*(batch.column(c) for c in ("page_id", "mark", "url", "html", "refers_to")), strict=True):
                key, html = key.as_py(), html.as_py()
                if key not in marks:
                    marks = {key: {}}
                if not mark.as_py():
                    marks[key][html] = ref.as_py()
                    continue
                payload = html.encode()
                ref = marks[key].get(hashlib.sha256(payload).hexdigest().upper()) if marks[key] else None
                if state is None:
                    temp = f"{root}/.tmp-{context.partitionId()}-{context.taskAttemptId()}-{len(done)}"
                    state = {"temp": temp, "out": store.open_output_stream(temp), "n": 0, "bytes": 0, "sha": hashlib.sha256(), "first": key}
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                packed = packer.compress(encode("" if key is None else str(key), url.as_py(), payload, None if ref is None else str(ref))) + packer.flush()
                state["out"].write(packed)
                state["sha"].update(packed)
                state["n"] += 1
                state["bytes"] += len(packed)
                state["last"] = key
                if state["bytes"] >= roll_bytes:
                    close()
        if state is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_id", batch.schema.field("page_id").type), ("last_id", batch.schema.field("page_id").type)]))

    temp, final = f"{folder}/.manifest-{uuid.uuid4().hex}", f"{folder}/manifest"
    ranged.mapInArrow(write, schema).write.parquet(temp)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(final).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.rename(path(temp), path(final)):
        raise OSError(f"{final} exists or can't be written")
    for left in store.globStatus(path(f"{folder}/.tmp-*")) or []:  # of failed attempts
        store.delete(left.getPath(), False)
    return spark.read.schema(schema).parquet(final)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files in the manifest: columns file, page_id string, url, headers (JSON), record_type,
    refers_to string, payload binary (null for a revisit), payload_digest, payload_bytes. Digests and file
    hashes are checked. Each file is streamed by one task; files are dealt out by name."""
    manifest = spark.read.parquet(f"{folder}/manifest").select("path", "sha256")
    schema = "file string, page_id string, url string, headers string, record_type string, refers_to string, payload binary, payload_digest string, payload_bytes long"
    arrow = pa.schema([("file", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("headers", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Hashed(io.RawIOBase):
            def __init__(self, inner):
                self.inner, self.sha = inner, hashlib.sha256()

            def read(self, n=-1):
                chunk = self.inner.read(n)
                self.sha.update(chunk)
                return chunk

        store, root = _store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{root}/{row['path']}", compression=None) as raw:
                    stream = Hashed(raw)
                    for record in members(stream):
                        fields, block = decode(record)
                        revisit = fields["WARC-Type"] == "revisit"
                        payload = None if revisit else block.partition(b"\r\n\r\n")[2]
                        found = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if payload is not None and (digest(payload) != found or len(payload) != int(fields["X-Payload-Length"])):
                            raise ValueError(f"{row['path']}: payload of {fields['WARC-Record-ID']} is damaged")
                        rows.append({"file": row["path"], "page_id": fields["X-Page-Id"] or None, "url": fields["WARC-Target-URI"], "headers": json.dumps(fields), "record_type": fields["WARC-Type"], "refers_to": fields.get("X-Refers-To-Page"), "payload": payload, "payload_digest": found, "payload_bytes": int(fields["X-Payload-Length"])})
                        size += len(block)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, size = [], 0
                    if stream.sha.hexdigest() != row["sha256"]:
                        raise ValueError(f"{row['path']} differs from its manifest entry")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "path").mapInArrow(read, schema)
