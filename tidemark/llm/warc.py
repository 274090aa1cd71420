"""WARC archives: written by Spark's own committed writer, read back with boundary-chain verification.

Writing: a record is one gzip member. Spark's text writer puts bytes out unchanged and follows each row by the "line
separator", here an empty gzip member, so a part file is a gzip file of whole records that any WARC reader takes, and
a task that is lost and run again leaves no record twice. Of records with equal payloads of REVISIT_BYTES or more one
is the response, that of the largest page_id; the others are revisits that name it.

Reading: a task looks for every place in a file where a record may start (the magic, and headers that parse), and emits
candidates: the place, the place of its successor and what the record says. Payloads may hold the magic; so the
candidates of a file are linked to their successors, and pointer jumping from the file's start marks those that the chain
reaches: in round k everything marked marks what lies 2^k records on. All others are payload. An archive is whole only if the
chain ends at the end of the file; if not, `broken` tells where it stops, and read_warc fails. Gzip members and plain files are both read.

Bounds: one task holds one file, which the writer keeps near FILE_BYTES of payload (a single longer page is a file of its own
at worst), and the candidates of one file, 40 bytes each. Spark reads a file as one value, so files of 2 GB and more, which this
writer never makes, are refused by Spark with an error; other archives must be split first.

Defined cases: a null html is an empty payload. A null url is left out of the headers. A null page_id is written as
'null' and read back as null. Rows with equal ids and payloads are of one type. Empty tables give empty tables. Only
page_id, url and html are read, so other columns can't clash.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import attach, shared_dir, staged, temporary

REVISIT_BYTES, FILE_BYTES, LEVEL = 1000, 64_000_000, 4
#: A gzip member of no bytes, as the text writer's line separator in ISO 8859-1.
EMPTY = gzip.compress(b"", mtime=0)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
CHAIN = "file string, size bigint, at bigint, next bigint, record boolean, url string, " + RECORDS


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or, if it refers to another page, a revisit without."""
    revisit = refers_to is not None
    block = HTTP % size + (b"" if revisit else payload or b"")
    name = lambda x: f"<urn:page:{'null' if x is None else x}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}"] if url is not None else []
    head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str | None = None) -> str:
    """Write a record for each row of `pages` (page_id, url, html); give the archive's folder, a temporary one if none is given."""
    spark, own = pages.sparkSession, not path
    path = path or f"{shared_dir(spark)}/tidemark/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload")).withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    same = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # Groups are one row each, combined before the shuffle; the pages themselves are shuffled only if groups are too many to broadcast.
    rows = attach(rows, staged(same.select("digest", "size", "first"), "same"), "digest", "size")
    rows = rows.withColumn("refers_to", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i) for i in range(6)]
            out = [gzip.compress(record(*(c[i].as_py() for c in cols)), LEVEL, mtime=0) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    made_of = rows.select("page_id", "url", "payload", "size", "digest", "refers_to").mapInArrow(made, "value binary")
    per_file = max(1, FILE_BYTES // max(1, int(rows.agg(F.avg("size")).first()[0] or 1)))
    out = made_of.select(F.col("value").cast("string")).write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1")
    out.option("maxRecordsPerFile", per_file).text(path)
    return temporary(spark, path) if own else path


_HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)+)\r\n")


def _parsed(data: bytes, at: int = 0) -> tuple[dict[str, str], int, int] | None:
    """Headers of a record at a place, where its block starts and where the record ends; None if there is none."""
    m = _HEAD.match(data, at)
    if not m:
        return None
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in m[1].decode("utf-8", "replace").split("\r\n"))}
    if not head.get("content-length", "").isdigit():
        return None
    end = m.end() + int(head["content-length"])
    return (head, m.end(), end + 4) if data[end : end + 4] == b"\r\n\r\n" else None


def _said(data: bytes, head: dict[str, str], start: int, end: int) -> tuple:
    """(record, url, page_id, payload_bytes, payload_digest, record_type, refers_to) of a parsed record."""
    page = lambda k: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", head.get(k, ""))) else None
    block = data[start : end - 4]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = head.get("warc-type")
    if kind == "revisit":
        size = re.search(rb"(?i)content-length: (\d+)", http)
        said = (int(size[1]) if size else None, head.get("warc-payload-digest", "").removeprefix("sha1:"))
    else:
        said = (len(payload), hashlib.sha1(payload).hexdigest())
    return (True, head.get("warc-target-uri"), page("warc-record-id"), *said, kind, page("warc-refers-to"))


def _member(view: memoryview, at: int, step: int = 1 << 14) -> tuple[bytes, int]:
    """What the gzip member at a place holds and where it ends, 0 if the file ends first; read in steps, as what follows a member is copied."""
    z, out = zlib.decompressobj(31), []
    while not z.eof and at < len(view):
        out.append(z.decompress(view[at : at + step]))
        at += step
    return b"".join(out), min(at, len(view)) - len(z.unused_data) if z.eof else 0


def candidates(data: bytes) -> Iterator[tuple]:
    """(at, next, ...) for each place in a file where a record may start; empty gzip members are links without a record."""
    none = (False, None, None, None, None, None, None)
    if data[:2] == b"\x1f\x8b":
        at, view = data.find(b"\x1f\x8b\x08"), memoryview(data)
        while at >= 0:
            try:
                inner, end = _member(view, at)
                found = _parsed(inner)
                if end and (not inner or found and found[2] == len(inner)):
                    yield (at, end, *(_said(inner, *found) if found else none))
            except zlib.error:
                pass
            at = data.find(b"\x1f\x8b\x08", at + 1)
        return
    at = data.find(b"WARC/1.")
    while at >= 0:
        if found := _parsed(data, at):
            yield (at, found[2], *_said(data, *found))
        at = data.find(b"WARC/1.", at + 1)


def reachable(at: np.ndarray, after: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Which candidates the chain from 0 reaches, by pointer jumping, and where it stops: at `size` if the file is whole."""
    order = np.argsort(at)
    places = at[order]
    k = np.searchsorted(places, after[order])
    jump = np.where((k < len(places)) & (places[np.minimum(k, len(places) - 1)] == after[order]), k, len(places)) if len(places) else k
    jump = np.append(jump, len(places))  # the last pointer stays where it is
    marked = np.zeros(len(jump), dtype=bool)
    if len(places) and places[0] == 0:
        marked[0] = True
    while True:
        before = marked.sum()
        marked[jump[marked]] = True
        jump = jump[jump]
        if marked.sum() == before and (jump == len(places)).all():
            break
    got = np.zeros(len(at), dtype=bool)
    got[order] = marked[:-1]
    return got, int(after[got].max()) if got.any() else 0


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """CHAIN rows of the records that each file's chain reaches, and `broken`: where the chain stops short, else null. A file whose chain
    stops before any record has one row without a record."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("size", pa.int64()), ("at", pa.int64()), ("next", pa.int64()), ("record", pa.bool_()), ("url", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for i in range(b.num_rows):
                data = b.column(1)[i].as_py()
                rows = [(b.column(0)[i].as_py(), len(data), *x) for x in candidates(data)]
                rows = rows or [(b.column(0)[i].as_py(), len(data), -1, -1, False, *[None] * 6)]  # a file without a candidate is broken at 0
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def chained(df: pd.DataFrame) -> pd.DataFrame:
        got, end = reachable(df["at"].to_numpy(), df["next"].to_numpy(), int(df["size"].iloc[0]))
        whole = end == df["size"].iloc[0]
        out = df[got & df["record"].to_numpy()]
        if not whole and not len(out):
            out = df.iloc[:1].assign(record=False, url=None, page_id=None, payload_bytes=None, payload_digest=None, record_type=None, refers_to=None)
        return out.assign(broken=None if whole else end)

    files = spark.read.format("binaryFile").load(path).select("path", "content").where(F.length("content") > 0)
    return files.mapInArrow(found, CHAIN).groupBy("file").applyInPandas(chained, CHAIN + ", broken bigint")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """RECORDS of an archive's folder. A file whose chain doesn't end at its end fails the read, as records after the break would be
    missing; read_chain() gives what comes before."""
    said = F.concat(F.lit("the records of "), F.col("file"), F.lit(" break off at byte "), F.col("broken").cast("string"))
    chain = read_chain(spark, path).where(F.col("broken").isNull() | F.raise_error(said).isNotNull())
    return chain.select(*(x.split()[0] for x in RECORDS.split(", ")))
