"""WARC archives written from and read into a chunked record table.

A payload is never put together from its chunks.  The writer receives rows
(record, chunk number, bytes) and adds each to an open gzip member; the reader
inflates a record a block at a time and yields rows (record, chunk number, byte
count, SHA-256 of the payload so far), so the last row of a record has the
digest and length of the whole payload.  Memory is bounded by the chunk size on
both sides.

A payload of at least ``least`` bytes that more than one record has is stored
once, in the response with the smallest id; the others are revisit records of
the identical-payload profile that refer to it.

Defined results: a null payload is an empty one; a null id is written as an
empty field and read as null, and takes no part in choosing the response (if
all ids of a payload are null, all are responses); rows that repeat both id and
payload are records of the same type.  An empty table makes no archive.  Only
the id, URL and payload columns are used.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import filesystem, keep, new_path

CHUNK = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_types(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = 100) -> DataFrame:
    """``pages`` as rows ``id, url, payload, payload_bytes, digest, refers_to``."""
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit("")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(url, F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    narrow = rows.select("id", "payload_bytes", "digest").where(F.col("payload_bytes") >= least)
    firsts = narrow.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # kept, so that its size is known: a small table is broadcast and no payload is
    # moved, beside a large one the rows of a common payload can be split
    firsts = keep(firsts, "firsts")
    revisit = F.when(F.col("id").isNull() | (F.col("id") != F.col("first")), F.col("first"))
    return rows.join(firsts, "digest", "left").select("id", "url", "payload", "payload_bytes", "digest", revisit.alias("refers_to"))


def chunk_rows(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table: a row for each ``chunk`` bytes of a payload, one
    at least; revisits have one without bytes."""
    size = F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(0)
    last = F.greatest(F.ceil(size / F.lit(chunk)).cast("int") - 1, F.lit(0))
    rows = records.withColumn("size", size).select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    part = F.when(F.col("size") > 0, F.expr(f"substring(payload, chunk_no * {chunk} + 1, {chunk})")).otherwise(F.lit(b""))
    return rows.select("id", "url", "digest", "payload_bytes", "refers_to", "size", "chunk_no", part.alias("chunk"), (F.col("chunk_no") == last).alias("last"))


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write an archive for each partition into ``folder``; the manifest
    (``file``, ``records``) names the finished ones.

    A file has its task's attempt in its name, and only files that a successful
    attempt reported are in the manifest: a lost executor leaves strays that
    nothing reads.
    """

    def run(batches):
        context, fs, path = TaskContext.get(), *filesystem(folder)
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        out, count = None, 0
        for batch in batches:
            columns = [batch.column(k) for k in range(batch.num_columns)]
            for k in range(batch.num_rows):
                ident, url, digest, total, refers, size, number, chunk, last = (c[k].as_py() for c in columns)
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                if number == 0:
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(member.compress(_header(ident, url, digest, total, refers, size)))
                    count += 1
                out.write(member.compress(chunk))
                if last:
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64())], ["file", "records"])

    return chunk_rows(records).mapInArrow(run, "file string, records long")


def _header(ident, url, digest, total, refers, size) -> bytes:
    kind = "response" if refers is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if ident is None else ident}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += ["WARC-Target-URI: " + "".join(url.splitlines()), f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {total}"]
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*lines, f"Content-Length: {size}", "", ""]).encode()


def records_of(stream, block: int = CHUNK) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """(header fields, payload blocks) for each record of a gzip archive.

    The blocks of a record must be used up before the next one is asked for.
    """
    state = {"member": zlib.decompressobj(31), "raw": b"", "held": b"", "done": False}

    def more() -> bool:
        """Inflate up to a block more into ``held``; false at the archive's end."""
        while not state["done"]:
            member = state["member"]
            if member.eof:
                state["raw"] = member.unused_data or state["raw"]
                member = state["member"] = zlib.decompressobj(31)
            raw = state["raw"] or stream.read(block)
            if not raw:
                state["done"] = True
                return False
            got = member.decompress(raw, block)
            state["raw"] = member.unconsumed_tail
            if got:
                state["held"] += got
                return True
        return False

    while True:
        while (end := state["held"].find(b"\r\n\r\n")) < 0:
            if not more():
                if state["held"].strip():
                    raise ValueError("a WARC archive ends inside a record")
                return
        lines = state["held"][:end].decode().split("\r\n")
        state["held"] = state["held"][end + 4 :]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        left = [int(fields["Content-Length"])]

        def body(left=left):
            while left[0]:
                if not state["held"] and not more():
                    raise ValueError("a WARC archive ends inside a payload")
                part, state["held"] = state["held"][: left[0]], state["held"][left[0] :]
                left[0] -= len(part)
                yield part

        yield fields, body()
        for _ in body():
            pass
        while len(state["held"]) < 4:
            if not more():
                raise ValueError("a WARC record has no end")
        state["held"] = state["held"][4:]


READ = "id long, url string, record_type string, refers_to long, chunk_no int, chunk_bytes long, payload_bytes long, running_digest string, last boolean"


def read(manifest: DataFrame, block: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives that ``manifest`` names.

    ``running_digest`` and ``payload_bytes`` cover the payload up to and with
    the row's chunk; on the row of a revisit they are those of its header.  A
    response whose payload isn't the one of its header fails the job.
    """

    def run(batches):
        names = [f.strip() for f in READ.split(",")]
        schema = pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[f.split()[1]]) for f in names])
        rows = []
        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, path = filesystem(file)
                with fs.open_input_stream(path, compression=None) as stream:
                    for row in _chunks(stream, block):
                        rows.append(row)
                        if len(rows) >= 8192:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return manifest.select("file").mapInArrow(run, READ)


def _ident(field: str) -> int | None:
    text = field.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def _chunks(stream, block: int) -> Iterator[dict]:
    for fields, body in records_of(stream, block):
        digest, said = hashlib.sha256(), fields["WARC-Payload-Digest"].removeprefix("sha256:")
        base = {"id": _ident(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": _ident(fields.get("WARC-Refers-To", ""))}
        if base["record_type"] == "revisit":
            yield base | {"chunk_no": 0, "chunk_bytes": 0, "payload_bytes": int(fields["WARC-Payload-Length"]), "running_digest": said, "last": True}
            continue
        size, done, number = int(fields["Content-Length"]), 0, 0
        for part in body:
            digest.update(part)
            done += len(part)
            yield base | {"chunk_no": number, "chunk_bytes": len(part), "payload_bytes": done, "running_digest": digest.hexdigest(), "last": done == size}
            number += 1
        if not size:
            yield base | {"chunk_no": 0, "chunk_bytes": 0, "payload_bytes": 0, "running_digest": digest.hexdigest(), "last": True}
        if digest.hexdigest() != said:
            raise ValueError(f"payload digest of record {base['id']} does not match")


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = 100) -> DataFrame:
    """Write ``pages`` as archives under the shared folder and read them back:
    the chunked record table."""
    spark: SparkSession = pages.sparkSession
    folder = new_path(spark, "warc")
    manifest = keep(write(record_types(pages, id_col, payload_col, least), folder), "manifest")
    return read(manifest.repartition(max(manifest.count(), 1)))
