"""WARC archives by way of a chunked record table.

Payloads are handled as rows of record id and chunk number. Writing: a scan digests each payload chunk by chunk; equal
payloads elect one response by digest; each record becomes chunk rows with a running byte count and digest, and every task
streams the chunk rows it is handed into gzip members of its own archive in the shared folder. Reading: every archive is streamed; a record becomes chunk rows that carry the running byte
count and digest, so no record is held in memory as a whole. A record's last chunk row has the digest of its payload.

An archive's name holds the attempt that wrote it, and only archives that the finished job lists are read: what a lost or
repeated task leaves behind is never seen.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlefold.llm.common import fresh_path, stored

CHUNK = 1 << 18
ARCHIVE_SCHEMA = "archive string, records long"
CHUNK_SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, chunk_no int, data binary, bytes_so_far long, digest string, declared_digest string, is_last boolean"
)
#: A record to be written, cut into chunks; ``so_far`` is the digest up to and including the chunk.
RECORD_SCHEMA = "page_id long, url string, n long, digest string, refers_to long, chunk_no int, data binary, bytes_so_far long, so_far string, is_last boolean"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
RECORD_ARROW, CHUNK_ARROW = (pa.schema([(name, _ARROW[kind]) for name, kind in map(str.split, schema.split(", "))]) for schema in (RECORD_SCHEMA, CHUNK_SCHEMA))
_URN = "urn:page:"


def _base32(sha) -> str:
    return base64.b32encode(sha.digest()).decode()


def _chunks(text: str | None, size: int = CHUNK) -> Iterator[bytes]:
    for at in range(0, len(text or ""), size):
        yield text[at : at + size].encode("utf-8", "surrogatepass")


def payload(text: Column) -> Column:
    """Struct of ``n`` (bytes) and ``digest`` (bare base32 SHA-1) of the UTF-8 payload; null: empty."""

    def measure(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            sha, n = hashlib.sha1(), 0
            for chunk in _chunks(text):
                sha.update(chunk)
                n += len(chunk)
            out.append((n, _base32(sha)))
        return pd.DataFrame(out, columns=["n", "digest"])

    return F.pandas_udf(measure, T.StructType([T.StructField("n", T.LongType()), T.StructField("digest", T.StringType())]))(text.cast("string"))


def elect(light: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to`` to rows of ``page_id``, ``n``, ``digest``: the largest id of an equal payload, null for that row itself."""
    best = light.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("best")).withColumnRenamed("digest", "d")
    other = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    return light.hint("merge").join(best, F.col("digest") == F.col("d"), "left").select("page_id", "n", "digest", F.when(other, F.col("best")).alias("refers_to"))


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _qualified(df: DataFrame, path: str) -> str:
    """The path with its file system, which is the cluster's default one if it names none."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    p = jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(conf).makeQualified(p).toString()
    return re.sub(r"^file:/(?!/)", "file:///", uri)


def _header(kind: str, record_id: str, length: int, *more: tuple[str, str | None]) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "2000-01-01T00:00:00Z"), *more, ("Content-Length", str(length))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None) + "\r\n").encode("utf-8", "surrogatepass")


def _clean_uri(uri: str | None) -> str | None:
    return None if uri is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


def write(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = 0, level: int = 3) -> DataFrame:
    """Write one archive per task below ``path`` (default: a new one in the shared folder); returns ``archive``, ``records``.

    Of equal payloads of at least ``min_bytes`` bytes the row with the largest id is a response, the others are revisits
    of it without payload; smaller payloads are all responses. Null payloads are empty. Rows with the same id and payload
    are alike. A null id is less than any other. Only the three named columns are read.
    """
    path = _qualified(pages, path or fresh_path(pages.sparkSession, "warc"))
    html = F.col(f"`{text_col}`").cast("string")
    source = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), html.alias("html"), payload(html).alias("p"))
    light = stored(source.select("page_id", "p.*"), "warc-digests")
    roles = elect(light, min_bytes).select(F.col("page_id").alias("rid"), F.col("digest").alias("rd"), "refers_to").distinct()
    rows = source.hint("merge").join(roles, F.col("page_id").eqNullSafe(F.col("rid")) & (F.col("p.digest") == F.col("rd")))

    named = rows.select("page_id", "url", "html", "p.n", "p.digest", "refers_to")
    return stored(named.mapInArrow(_cut, RECORD_SCHEMA).mapInArrow(_writer(path, level), ARCHIVE_SCHEMA), "warc-archives")


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of some 8 MB of payload or 10,000 rows; one without rows if there are none."""
    held: list[tuple] = []
    weight = 0

    def batch() -> pa.RecordBatch:
        cols = list(zip(*held)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    for row in rows:
        held.append(row)
        weight += size(row)
        if weight > 1 << 23 or len(held) >= 10_000:
            yield batch()
            held, weight = [], 0
    yield batch()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records as chunk rows, a record's in a row and in order; a revisit is one row without data."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            for k in range(b.num_rows):
                page, url, text, n, digest, refers = (b.column(i)[k].as_py() for i in range(6))
                same = (page, _clean_uri(url), n, digest, refers)
                if refers is not None:
                    yield (*same, 0, None, 0, None, True)
                    continue
                sha, size, no, last = hashlib.sha1(), 0, 0, max(0, -(-len(text or "") // CHUNK) - 1)
                for chunk in _chunks(text) if text else (b"",):
                    sha.update(chunk)
                    size += len(chunk)
                    yield (*same, no, chunk, size, _base32(sha), no == last)
                    no += 1

    return _batches(rows(), RECORD_ARROW, lambda row: len(row[6] or b""))


def _writer(path: str, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes chunk rows of ``RECORD_SCHEMA`` as they come, each record a gzip member, into one archive below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open_fs(path)
        fs.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        records, out, member, due = 0, None, None, 0
        for b in batches:
            for page, url, n, digest, refers, no, data, size, so_far, is_last in zip(*(b.column(i) for i in range(10))):
                out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                no, data, digest = no.as_py(), data.as_py(), digest.as_py()
                if no != due:
                    raise ValueError(f"chunk {no} of page {page} came where chunk {due} was due")
                if not no:
                    member = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(member.compress(_record_head(page.as_py(), url.as_py(), n.as_py(), digest, refers.as_py())))
                if data:
                    out.write(member.compress(data))
                due = no + 1
                if is_last.as_py():
                    if data is not None and (size.as_py(), so_far.as_py()) != (n.as_py(), digest):
                        raise ValueError(f"page {page} is cut differently than it was digested")
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
                    records, due = records + 1, 0
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([records], pa.int64())], ["archive", "records"])

    return run


def _record_head(page: int | None, url: str | None, n: int, digest: str, refers: int | None) -> bytes:
    shared = (("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"))
    record = f"{_URN}{'' if page is None else page}"
    if refers is None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
        return _header("response", record, len(http) + n, *shared, ("Content-Type", "application/http; msgtype=response")) + http
    more = (("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{_URN}{refers}>"))
    return _header("revisit", record, 0, *shared, *more)


def _records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], int]]:
    """Headers and block length of each record; the caller reads the block, then the record's end is skipped here."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            head[key.strip().lower()] = value.strip()
        yield head, int(head["content-length"])
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {head.get('warc-record-id')} does not end where its length says")


def read(archives: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk table of the listed archives: rows of ``CHUNK_SCHEMA``, one at least per record.

    ``bytes_so_far`` and ``digest`` run over the payload up to and including the chunk; ``data`` is null unless asked for.
    A payload that does not match its declared digest raises.
    """
    count = max(1, archives.count())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for archive in b.column(0).to_pylist():
                fs, path = _open_fs(archive)
                with fs.open_input_stream(path, compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) as stream:
                    for head, left in _records(stream):
                        kind = head["warc-type"]
                        if kind == "response":
                            while line := stream.readline():  # the HTTP header
                                left -= len(line)
                                if not line.strip():
                                    break
                        ref = head.get("warc-refers-to")
                        same = (head["warc-record-id"].strip("<>"), kind, head.get("warc-target-uri"), ref and ref.strip("<>"))
                        declared = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        sha, size, no = hashlib.sha1(), 0, 0
                        while True:
                            data = stream.read(min(CHUNK, left))
                            if left and not data:
                                raise ValueError(f"{archive} ends inside record {same[0]}")
                            sha.update(data)
                            size, left = size + len(data), left - len(data)
                            digest = _base32(sha)
                            if not left and kind == "response" and declared not in (None, digest):
                                raise ValueError(f"record {same[0]} of {archive} is damaged")
                            yield (*same, no, data if with_data else None, size, digest, declared, not left)
                            no += 1
                            if not left:
                                break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(rows(batches), CHUNK_ARROW, lambda row: len(row[5] or b""))

    return archives.select("archive").repartition(count).mapInArrow(run, CHUNK_SCHEMA)


def page_records(chunks: DataFrame) -> DataFrame:
    """Per record: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``; a revisit has its response's payload."""
    number = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    last = stored(
        chunks.where("is_last").select(number("record_id").alias("page_id"), "bytes_so_far", "digest", "declared_digest", "record_type", number("refers_to").alias("refers_to")), "warc-records"
    )
    full = last.where("record_type = 'response'").select(F.col("page_id").alias("rid"), F.col("bytes_so_far").alias("n"), F.col("digest").alias("d")).distinct()
    found = last.hint("merge").join(full, (F.col("refers_to") == F.col("rid")) & (F.col("declared_digest") == F.col("d")), "left")
    revisit = F.col("record_type") == "revisit"
    return found.select(
        "page_id", F.when(revisit, F.col("n")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("d")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to",
    )
