"""WARC files and a Merkle fixity audit of their replicas.

An archive is a folder of WARC files in which each record is a gzip member of its own, so that a record can be read from its offset
alone. Spark's text writer writes them, with an empty gzip member as its line separator: a lost executor's files are
written again and never twice. Each task writes its own rows in their order, a new file for each FILE_BYTES: no key decides where a
row goes. An index of an archive, or of a replica, is read from its own stored bytes: damaged ones are told, not met with an error.

Records get hashes of their stored bytes; the records of an ordered range of offsets of a file make a leaf; FANOUT leaves, in order,
make a node, and so on up to a file's root; FANOUT files make a node, up to one root for the archive. An audit compares the roots of
two replicas and goes down only where they differ; records are compared from the first range on in which a file differs.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.llm.shared import pieces, written

#: Stored bytes at which a file ends, files that a task may write, bytes of a leaf's range, and children of a node.
FILE_BYTES, TASK_FILES, RANGE_BYTES, FANOUT = 1 << 25, 1 << 20, 1 << 16, 16
DATE = "2020-01-01T00:00:00Z"
END = "\r\n\r\n"
#: An empty gzip member: stands behind each record.
EMPTY = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 0xFF, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
_MAGIC = b"\x1f\x8b\x08"
#: Bytes that are unzipped at once.
STEP = 1 << 16
_PAGE = re.compile(r"<urn:page:(-?[0-9]{1,18})>")
INDEX = "file long, offset long, stored long, stored_sha256 string, state string, record_id string, page_id long, url string, length long, sha256 string"


def record_of(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC resource record without the END that follows it. A null id is empty, a null address has no header, a null html
    is an empty body; line ends in an address are percent-encoded."""
    address = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {DATE}"), F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), address), F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.coalesce(F.octet_length(html), F.lit(0)).cast("string"),
        F.lit(END), F.coalesce(html, F.lit("")),
    )


def _write(rows: DataFrame, path: str) -> None:
    """Write rows (file, value), gzip members, those of a file in order, as WARC files."""
    rows.select("file", F.col("value").cast("string").alias("value")).write.partitionBy("file").option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def member(record: bytes) -> bytes:
    return gzip.compress(record, 1, mtime=0)


def archive(pages: DataFrame, path: str) -> None:
    """Write pages (page_id, url, html) as WARC files, a record for each row; no shuffle. An empty table makes no file."""

    def run(batches):
        file, size, at, last = TaskContext.get().partitionId() * TASK_FILES, 0, 0, (TaskContext.get().partitionId() + 1) * TASK_FILES - 1
        for batch in pieces(batches, 0):
            files, places, members = [], [], []
            for record in batch.column(0).to_pylist():
                stored = member(record + END.encode())
                if size and size + len(stored) > FILE_BYTES:
                    file, size = file + 1, 0
                    if file > last:
                        raise ValueError(f"a task writes {TASK_FILES} files at most")
                size, at = size + len(stored) + len(EMPTY), at + 1
                files.append(file)
                places.append(at)
                members.append(stored)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(places, pa.int64()), pa.array(members, pa.binary())], ["file", "place", "value"])

    rows = pages.select(record_of(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html")).cast("binary").alias("value"))
    _write(rows.mapInArrow(run, "file long, place long, value binary").sortWithinPartitions("file", "place"), path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the WARC files of a folder, of about FILE_BYTES or one record each. A local file system's own checksums
    aren't looked at: it is the audit that tells damage."""
    raw = spark.read.option("fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem").option("fs.file.impl.disable.cache", True)
    files = raw.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", r"/file=(\d+)/", 1).cast("long").alias("file"), "content")


def unzipped(content: bytes, at: int) -> tuple[str, bytes, int]:
    """State (ok, truncated, unreadable), what a gzip member at an offset holds, and the offset behind it."""
    reader, out, end = zlib.decompressobj(31), [], at
    try:
        while not reader.eof and end < len(content):
            out.append(reader.decompress(content[end : end + STEP]))
            end = min(end + STEP, len(content))
    except zlib.error:
        return "unreadable", b"", at
    return ("ok" if reader.eof else "truncated"), b"".join(out), end - len(reader.unused_data)


def headers(record: bytes) -> dict[str, str] | None:
    """Header fields of a WARC record, names in lower case; None if it isn't one, or its header is cut off."""
    end = record.find(b"\r\n\r\n")
    if not record.startswith(b"WARC/") or end < 0:
        return None
    lines = record[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines) if sep}


def size_of(record: bytes, known: dict[str, str]) -> int | None:
    """Bytes of a record by its header; None if that doesn't say."""
    length = known.get("content-length", "")
    return record.find(b"\r\n\r\n") + 4 + int(length) + 4 if length.isascii() and length.isdigit() and len(length) < 19 else None


def told(at: int, stored: bytes, record: bytes, state: str) -> tuple:
    """A row of an index, but for its file."""
    known = headers(record)
    if state == "ok" and (known is None or (size := size_of(record, known)) is None or len(record) > size):
        state = "unreadable"
    elif state == "ok" and len(record) < size:
        state = "truncated"
    known = known or {}
    page = _PAGE.fullmatch(known.get("warc-record-id", ""))
    digest = hashlib.sha256(record).hexdigest() if state == "ok" else None
    return at, len(stored), hashlib.sha256(stored).hexdigest(), state, known.get("warc-record-id"), int(page[1]) if page else None, known.get("warc-target-uri"), len(record) if state == "ok" else None, digest


def members(content: bytes) -> Iterator[tuple[int, bytes, bytes, str]]:
    """(offset, stored bytes, record, state) of the members of a file, or of its records if it isn't zipped. Behind what can't be read
    it goes on at the next place where a member can be."""
    at = 0
    while at < len(content):
        if content.startswith(EMPTY, at):
            at += len(EMPTY)
            continue
        if content.startswith(b"WARC/", at):
            known = headers(content[at:])
            size = size_of(content[at:], known) if known else None
            end = min(at + size, len(content)) if size else len(content)
            state, record = ("ok" if size and at + size <= len(content) else "truncated"), content[at:end]
        else:
            state, record, end = unzipped(content, at)
            if state != "ok":
                end = content.find(_MAGIC, at + 1)
                while end >= 0 and unzipped(content, end)[0] != "ok":
                    end = content.find(_MAGIC, end + 1)
                state, end = ("unreadable", end) if end >= 0 else (state, len(content))
        yield at, content[at:end], record, state
        at = end


def index(spark: SparkSession, path: str) -> DataFrame:
    """Of the records of an archive, read from its files: (file, offset, stored, stored_sha256, state, record_id, page_id, url, length,
    sha256). stored: bytes in the file; state: ok, truncated (the file or the record ends too soon) or unreadable (not a gzip member, or
    not a WARC record); length and sha256: of the record itself, null if it can't be read. Any record id is taken; page_id is that of
    ids of this archive."""
    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in INDEX.split(", ")]

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(file, *told(*x)) for x in members(content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return stored(spark, path).mapInArrow(run, INDEX)


def _hash_of(parts: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(parts)), lambda x: F.concat_ws(":", *[x[k].cast("string") for k in ("a", "b", "h")])), "\n"), 256)


def tree(found: DataFrame, depth: int, height: int) -> list[DataFrame]:
    """Levels of the tree of records (file, offset, stored, stored_sha256), leaves first: each (file, node, hash).

    Of depth + 1 levels a node gathers FANOUT nodes of its file, then height levels gather FANOUT files. A
    group holds one range's records, or FANOUT children.
    """
    leaf = found.groupBy("file", F.floor(F.col("offset") / RANGE_BYTES).cast("long").alias("node")).agg(
        _hash_of(F.struct(F.col("offset").alias("a"), F.col("stored").alias("b"), F.col("stored_sha256").alias("h"))).alias("hash")
    )
    levels = [written(leaf, "merkle-0")]
    for k in range(depth + height):
        up = [F.col("file"), F.floor(F.col("node") / FANOUT).cast("long").alias("node")] if k < depth else [F.floor(F.col("file") / FANOUT).cast("long").alias("file"), F.lit(0).cast("long").alias("node")]
        part = F.struct(F.col("file").alias("a"), F.col("node").alias("b"), F.col("hash").alias("h"))
        levels.append(written(levels[-1].groupBy(*up).agg(_hash_of(part).alias("hash")), f"merkle-{k + 1}"))
    return levels


def shape(*found: DataFrame) -> tuple[int, int]:
    """Levels inside files, and above them, that bring the replicas to one root each."""
    rows = [f.agg(F.max("offset"), F.max("file"), F.min("file")).first() for f in found]
    depth, n = 0, max([0, *(r[0] // RANGE_BYTES for r in rows if r[0] is not None)])
    while n:
        depth, n = depth + 1, n // FANOUT
    height, low, high = 0, min([0, *(r[2] for r in rows if r[2] is not None)]), max([0, *(r[1] for r in rows if r[1] is not None)])
    while low != high:  # floor division takes -1 to -1: files below 0 keep a root of their own
        if (low, high) == (-1, 0):
            break
        height, low, high = height + 1, low // FANOUT, high // FANOUT
    return depth, height


def mismatches(first: DataFrame, second: DataFrame) -> DataFrame:
    """(file, node): the ranges of offsets in which the records of two replicas differ, found from the roots down."""
    depth, height = shape(first, second)
    a, b = tree(first, depth, height), tree(second, depth, height)
    wrong: DataFrame | None = None
    for k in range(depth + height, -1, -1):
        left, right = a[k], b[k]
        if wrong is not None:
            up = [F.col("file").alias("__file"), F.col("node").alias("__node")]
            if k < depth:
                on = (F.col("file") == F.col("__file")) & (F.floor(F.col("node") / FANOUT) == F.col("__node"))
            else:
                on = F.floor(F.col("file") / FANOUT) == F.col("__file")
            left, right = (x.join(wrong.select(*up).hint("merge"), on, "left_semi") for x in (left, right))
        both = left.withColumnRenamed("hash", "x").join(right.withColumnRenamed("hash", "y").hint("merge"), ["file", "node"], "full")
        wrong = written(both.where(~F.col("x").eqNullSafe(F.col("y"))).select("file", "node"), "mismatches")
        if wrong.isEmpty():
            break
    return wrong


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """(file, offset, status, side) of the records in which the second of two replicas (indexes) isn't the first.

    status: changed (a record with the same id has other bytes), unreadable or truncated (the second's bytes at this place can't
    be read), missing (not in the second; side `first`) and extra (only in the second; side `second`, also for what can't be
    read where the first has no record). A record that stands elsewhere in its file with the same bytes, behind one that
    was added or lost, is right. Equal replicas, and two empty ones, give no row; a file that one hasn't got differs in
    all its records. Equal records are compared one by one, in order.
    """
    start = mismatches(first, second).groupBy("file").agg((F.min("node") * RANGE_BYTES).alias("__start")).withColumnRenamed("file", "__file")
    inside = (F.col("file") == F.col("__file")) & (F.col("offset") >= F.col("__start"))

    def numbered(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy("offset")))

    kept = ["file", "offset", "stored_sha256", "state", "record_id"]
    left, right = (numbered(x.select(*kept).join(start.hint("merge"), inside, "left_semi"), "file", "stored_sha256") for x in (first, second))
    same = ["file", "stored_sha256", "__n"]
    left, right = written(left, "first-open"), written(right, "second-open")
    left, right = left.join(right.select(*same).hint("merge"), same, "left_anti").drop("__n"), right.join(left.select(*same).hint("merge"), same, "left_anti").drop("__n")
    # what is left meets by record id, or by the place of what can't be read
    left = written(numbered(left.withColumn("key", F.coalesce("record_id", F.lit(""))), "file", "key"), "first-left")
    right = written(numbered(right.withColumn("key", F.coalesce("record_id", F.lit(""))), "file", "key"), "second-left")
    named = right.select("file", "key", "__n", F.col("state").alias("x"), F.col("offset").alias("__at"))
    placed = right.where("state <> 'ok'").select("file", "offset", F.col("state").alias("y"))
    both = left.join(named.where("key <> ''").hint("merge"), ["file", "key", "__n"], "left").join(placed.hint("merge"), ["file", "offset"], "left")
    both = written(both.withColumn("status", F.when(F.col("x") == "ok", "changed").otherwise(F.coalesce("x", "y", F.lit("missing")))), "audit-first")
    used = both.where("x is not null").select("file", F.col("__at").alias("offset")).unionByName(both.where("x is null and y is not null").select("file", "offset"))
    extra = right.join(used.hint("merge"), ["file", "offset"], "left_anti").select("file", "offset", F.lit("extra").alias("status"), F.lit("second").alias("side"))
    return both.select("file", "offset", "status", F.lit("first").alias("side")).unionByName(extra)


def damaged(spark: SparkSession, path: str, to: str) -> None:
    """Write a replica of an archive for a drill, with known damage by id: every 61st record has the second half of its text
    overwritten, the next one's last byte of text is changed (the date of an empty one), the one after is left out."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                out = []
                for at, kept, record, state in members(content.as_py()):
                    page, data = told(at, kept, record, state)[5], bytearray(record)
                    part, n = None if page is None else page % 61, len(record)
                    body, date = record.find(b"\r\n\r\n") + 4, record.find(b"WARC-Date: ") + 11
                    if part in (0, 1) and body == n - 4:  # an empty body
                        data[date] ^= 1
                    elif part == 0:
                        half = (body + n - 4) // 2
                        data[half : n - 4] = b"?" * (n - 4 - half)
                    elif part == 1:
                        data[n - 5] ^= 1
                    if part != 2:
                        out.append(member(bytes(data)) if part in (0, 1) else kept)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(out), pa.int64()), pa.array(range(len(out)), pa.int64()), pa.array(out, pa.binary())], ["file", "place", "value"])

    _write(stored(spark, path).mapInArrow(run, "file long, place long, value binary").sortWithinPartitions("file", "place"), to)


def fixity(pages: DataFrame, path: str) -> DataFrame:
    """Archive the pages, damage a replica, audit it: the first's index with the status of every record (ok if the audit hasn't told
    it), and what only the second has."""
    spark = pages.sparkSession
    archive(pages, f"{path}/first")
    known = written(index(spark, f"{path}/first"), "warc-index")
    damaged(spark, f"{path}/first", f"{path}/second")
    second = written(index(spark, f"{path}/second"), "replica-index")
    found = written(audit(known, second), "damage")
    told_ = lambda side: found.where(F.col("side") == side).select("file", "offset", "status")
    return known.join(told_("first").hint("merge"), ["file", "offset"], "left").withColumn("status", F.coalesce("status", F.lit("ok"))).unionByName(second.join(told_("second").hint("merge"), ["file", "offset"]))
