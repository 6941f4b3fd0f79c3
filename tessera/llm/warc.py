"""WARC archives by index: records are written with an offset index, then selected ones are read in coalesced byte ranges.

Every record is its own gzip member, so that an index row (archive, offset, length) is enough to read it. A writer task
rolls to a new archive after `roll_bytes`. Archive names are unique for each attempt of a task and only rows of
successful attempts reach the index, so a task that is run again after an executor is lost leaves nothing wrong behind.

Defined cases: null html is an empty payload, a null URL an empty target; a null page_id is written as an empty id and
read as null; of rows that agree in page_id and payload one is the response, told by its place in the table, so that pages
must be a table that is read alike each time, as files are. Other columns of the pages are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INDEX_SCHEMA = "page_id long, url string, digest string, archive string, offset long, length long"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
DATE = "2024-01-01T00:00:00Z"


def plan_records(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """Adds payload, digest and refers_to: the page whose record has the payload, null for a response.

    Copies of one payload meet as (digest, size) groups of two longs, pre-aggregated; the html itself is joined with the
    groups that have copies only, and a hot digest is split by the adaptive skew join.
    """
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
        F.monotonically_increasing_id().alias("row_id"),
    ).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    first = F.max(F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("k"), "page_id", "row_id"))
    groups = (
        page.filter(F.col("size") >= min_revisit_bytes)
        .groupBy("digest", "size")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "size", F.col("first.page_id").alias("first_id"), F.col("first.row_id").alias("first_row"))
    )
    joined = page.join(groups, ["digest", "size"], "left")
    return joined.select(
        "page_id", "url", "payload", "digest",
        (F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row_id"))).alias("revisit"),
        F.when(F.col("first_row") != F.col("row_id"), F.col("first_id")).alias("refers_to"),
    )


def _header(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _record(page_id, url: str, payload: bytes, digest: str, revisit: bool, refers_to) -> bytes:
    name = "" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header(url)}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>",
        ]
    body = b"" if revisit else payload
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archives(records: DataFrame, path: str, roll_bytes: int = 64 << 20, level: int = 1) -> DataFrame:
    """Write archives below path; returns the index of their records (a written table)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        out, name, at = None, "", 0
        for batch in batches:
            cols = batch.to_pydict()
            rows: dict[str, list] = {k: [] for k in ("page_id", "url", "digest", "archive", "offset", "length")}
            for page_id, url, payload, digest, revisit, refers_to in zip(*(cols[k] for k in ("page_id", "url", "payload", "digest", "revisit", "refers_to")), strict=True):
                if out is None or at >= roll_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)  # members are compressed one by one
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = pack.compress(_record(page_id, url, payload, digest, revisit, refers_to)) + pack.flush()
                out.write(member)
                for k, v in zip(rows, (page_id, url, digest, name, at, len(member)), strict=True):
                    rows[k].append(v)
                at += len(member)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        if out is not None:
            out.close()

    spark = records.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(fs_path)
    index = records.select("page_id", "url", "payload", "digest", "revisit", "refers_to").mapInArrow(write, INDEX_SCHEMA)
    index.write.mode("overwrite").parquet(f"{path}-index")
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{path}-index")


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int, list[int]]]:
    """Join sorted (offset, length) ranges that lie within `gap` of each other into reads of about `most` bytes.

    Returns (start, end, indices of the ranges inside)."""
    reads: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(ranges):
        end = offset + length
        if reads and offset - reads[-1][1] <= gap and end - reads[-1][0] <= most:
            start, was, inside = reads[-1]
            reads[-1] = (start, max(was, end), [*inside, i])
        else:
            reads.append((offset, end, [i]))
    return reads


def _parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def _id(value: str) -> int | None:
    inside = value.removeprefix("<urn:page:").removesuffix(">")
    return int(inside) if inside else None


def read_records(index: DataFrame, path: str, gap: int = 1 << 16, most: int = 8 << 20, task_bytes: int = 16 << 20, with_payload: bool = True) -> DataFrame:
    """Read the records of the index rows: sorted by archive and offset, then in coalesced byte ranges, about task_bytes a task.

    Digest and length of a response are taken from the payload that was read; those of a revisit from its header."""

    def load(archive: pa.NativeFile, rows: list[dict]) -> Iterator[dict]:
        for start, end, inside in coalesce_ranges([(r["offset"], r["length"]) for r in rows], gap, most):
            data = archive.read_at(end - start, start)
            for i in inside:
                at = rows[i]["offset"] - start
                fields, payload = _parse(zlib.decompress(data[at : at + rows[i]["length"]], 31))
                response = fields["warc-type"] == "response"
                yield {
                    "page_id": _id(fields["warc-record-id"]),
                    "url": fields["warc-target-uri"],
                    "record_type": fields["warc-type"],
                    "refers_to": _id(fields.get("warc-refers-to", "")),
                    "payload_bytes": len(payload) if response else int(fields["x-payload-length"]),
                    "payload_digest": hashlib.sha1(payload).hexdigest() if response else base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(),
                    "payload": payload if with_payload else None,
                }

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            rows = batch.to_pylist()
            start = 0
            while start < len(rows):
                stop = start
                while stop < len(rows) and rows[stop]["archive"] == rows[start]["archive"]:
                    stop += 1
                with fs.open_input_file(f"{root}/{rows[start]['archive']}") as archive:
                    out: list[dict] = []
                    held = 0
                    for x in load(archive, rows[start:stop]):
                        out.append(x)
                        held += len(x["payload"] or b"")
                        if held > most:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out, held = [], 0
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                start = stop

    tasks = -(-(index.agg(F.sum("length")).first()[0] or 0) // task_bytes)
    ordered = index.repartitionByRange(max(1, tasks), "archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.select("archive", "offset", "length").mapInArrow(read, RECORD_SCHEMA)
