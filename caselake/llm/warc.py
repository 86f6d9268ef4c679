"""Web archives (WARC 1.1): an index first, then coalesced byte-range reads of the wanted records.

Writing. A narrow pass takes size and SHA-256 of each payload. Rows with equal payloads of at least
``revisit_bytes`` are one group; its smallest id is the response, the others become revisit records,
which hold no payload and are made from the narrow rows alone. Payloads go from the scan into the task's
own archive, one gzip member per record; two Bloom filters in the scan leave out the revisits, so no
payload moves but those of the few rows for which a filter cannot tell. The task that writes a
record also returns its index row (archive, offset, length, URL, digest, ...). An archive's name is new
for each attempt of a task and only the index says which archives count, so a task that is lost or runs
twice leaves a file that nobody reads.

Reading. Any selection of index rows is dealt out by (archive, stretch of the archive), sorted by
offset, and neighbours less than ``gap`` bytes apart are fetched by one read of at most ``most`` bytes (a
longer record is read alone). Payloads are hashed again; one that differs from its header is an error.

Executors open archives by their URI (local and shared folders, S3, HDFS, GCS, Azure).

Defined cases. Null payloads are empty, null URLs have no URL header, control characters in URLs are
percent-encoded in the header (the index keeps the URL as it is). A null id has no id header and comes
after all others when the smallest is sought. Of rows that share id and payload exactly one is the
response. Payloads below ``revisit_bytes`` are always responses. An empty table gives an empty index.
Other columns are not read. Equal payloads may be a third of all rows: their rows are reduced to one per
task before they meet, and the join that names the response splits a hot payload's narrow rows."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselake.llm import bloom, rowkeys
from caselake.llm.textwords import slices
from caselake.session import materialize

REVISIT_BYTES = 100
#: An archive is closed at about this size.
ARCHIVE_BYTES = 1 << 30
GAP, MOST = 64 << 10, 8 << 20
#: Index rows of one stretch of an archive are read by one task.
STRETCH = 64 << 20
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = ("record_id string, page_id string, url string, payload_bytes long, payload_digest string, record_type string, "
          "refers_to string, archive string, offset long, length long")


# --- records ----------------------------------------------------------------------
def _header(lines) -> bytes:
    return "\r\n".join([*(f"{k}: {v}" if k else v for k, v in lines if v is not None), "", ""]).encode()


def _safe(value: str | None) -> str | None:
    return None if value is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(row: dict, date: str) -> bytes:
    """One record: a response with an HTTP head and the payload, or a revisit without a block."""
    response = row["record_type"] == "response"
    payload = (row["payload"] or "").encode() if response else b""
    block = _header([("", "HTTP/1.1 200 OK"), ("Content-Type", "text/html; charset=utf-8"),
                     ("Content-Length", len(payload))]) + payload if response else b""
    head = _header([
        ("", "WARC/1.1"), ("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(row['record_id'])}>"),
        ("WARC-Date", date), ("WARC-Target-URI", _safe(row["url"])), ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
        ("WARC-Profile", None if response else _SAME_PAYLOAD),
        ("WARC-Refers-To", None if response else f"<urn:uuid:{uuid.UUID(row['refers_record'])}>"),
        ("X-Page-Id", _safe(row["page_id"])), ("X-Refers-To-Page-Id", _safe(row["refers_to"])),
        ("X-Payload-Length", row["payload_bytes"]),
        ("Content-Type", "application/http; msgtype=response" if response else None), ("Content-Length", len(block))])
    return head + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict, bytes]:
    """Headers (names in lower case) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    size = int(fields["content-length"])
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


def _opened(root: str):
    """The file system and the folder's path in it."""
    uri = re.sub("^file:/+", "/", root)
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


class _Archive:
    """The archives of one task: a new file once the last has ``limit`` bytes."""

    def __init__(self, root: str, limit: int, level: int):
        (self.fs, self.folder), self.limit, self.level, self.out = _opened(root), limit, level, None
        self.fs.create_dir(self.folder, recursive=True)

    def add(self, record: bytes) -> tuple[str, int, int]:
        if self.out is not None and self.at >= self.limit:
            self.close()
        if self.out is None:
            self.name, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None, buffer_size=1 << 20)
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = packer.compress(record) + packer.flush()
        self.out.write(member)
        self.at += len(member)
        return self.name, self.at - len(member), len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _archived(records: DataFrame, root: str, limit: int, level: int, date: str) -> DataFrame:
    """Writes the records, returns their index rows."""
    kept = ["record_id", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches):
        archive = _Archive(root, limit, level)
        try:
            for batch in batches:
                for part in slices(batch, "payload"):
                    places = [archive.add(record_bytes(row, date)) for row in part.to_pylist()]
                    names, offsets, lengths = zip(*places)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in kept), pa.array(names), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                        [*kept, "archive", "offset", "length"])
        finally:
            archive.close()

    return records.mapInArrow(run, _INDEX)


# --- writing ----------------------------------------------------------------------
def _response_ids(narrow: DataFrame, revisit_bytes: int) -> DataFrame:
    """Per repeated payload: payload_digest, and id and key of the row that is the response. Fixed-width
    buffers keep both steps hash aggregates with partial results in each task."""
    per_id = narrow.filter(F.col("payload_bytes") >= revisit_bytes).groupBy("payload_digest", "page_id").agg(
        F.min("row_key").alias("first_key"), F.count(F.lit(1)).alias("n"))
    groups = per_id.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.sum("n").alias("n")).filter("n > 1")
    first = per_id.select(F.col("payload_digest").alias("of"), F.col("page_id").alias("of_id"), "first_key")
    return groups.join(first, (F.col("payload_digest") == F.col("of")) & F.col("refers_to").eqNullSafe(F.col("of_id"))).select(
        "payload_digest", "refers_to", "first_key")


def _without(wide: DataFrame, narrow: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``wide`` whose ``row_key`` is not in ``gone`` (a column ``row_key``). The rows that a filter
    of ``gone`` holds back wrongly are found among the narrow rows; only these move."""
    n_blocks = bloom.blocks_for(gone.count())
    built = materialize(bloom.build(gone, "row_key", n_blocks), "warc-filter")
    unsure = materialize(bloom.ask(narrow.select("row_key"), "row_key", n_blocks, built, "__maybe").filter("__maybe").join(
        gone, "row_key", "left_anti").select(F.col("row_key").alias("unsure_key")), "warc-unsure")
    asked = bloom.ask(wide, "row_key", n_blocks, built, "__maybe")
    _, held = bloom.apart(asked.filter("__maybe").drop("__maybe"), "row_key", unsure, "unsure_key", "warc-unsure")
    return asked.filter("not __maybe").drop("__maybe").unionByName(
        held.join(unsure, F.col("row_key") == F.col("unsure_key"), "left_semi"))


def write(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, level: int = 6,
          date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Archives of all rows below ``root``; returns the stored index: one row per record with record_id,
    page_id (as text), url, payload_bytes, payload_digest (hex), record_type, refers_to (the response's page
    id, for revisits), archive, offset, length."""
    pages = rowkeys.stored(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                                        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload")), "warc-pages")
    wide = rowkeys.with_key(pages, "row_key")
    sized = [F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")]
    narrow = materialize(wide.select("row_key", "page_id", "url", *sized), "warc-narrow")
    firsts = materialize(_response_ids(narrow, revisit_bytes), "warc-responses")
    revisits = materialize(narrow.join(firsts, "payload_digest").filter("row_key <> first_key"), "warc-revisits")
    responses = _without(wide, narrow, revisits.select("row_key"))
    record = F.md5(F.col("row_key").cast("string"))
    # An all-null id group is the response of its revisits as well; its id header is then missing.
    rows = responses.select(
        record.alias("record_id"), F.col("page_id").cast("string").alias("page_id"), "url", "payload", *sized,
        F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"),
        F.lit(None).cast("string").alias("refers_record")).unionByName(revisits.select(
            record.alias("record_id"), F.col("page_id").cast("string").alias("page_id"), "url",
            F.lit(None).cast("string").alias("payload"), "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"),
            F.col("refers_to").cast("string").alias("refers_to"), F.md5(F.col("first_key").cast("string")).alias("refers_record")))
    return materialize(_archived(rows, root, archive_bytes, level, date), "warc-index")


# --- reading ----------------------------------------------------------------------
def ranges(archives, offsets: np.ndarray, lengths: np.ndarray, gap: int, most: int) -> list[tuple[int, int]]:
    """(first, last + 1) of the runs of sorted records that one read fetches."""
    runs, first = [], 0
    for i in range(1, len(offsets) + 1):
        if i == len(offsets) or archives[i] != archives[first] or offsets[i] - offsets[i - 1] - lengths[i - 1] > gap \
                or offsets[i] + lengths[i] - offsets[first] > most:
            runs.append((first, i))
            first = i
    return runs


def read(index: DataFrame, root: str, payload: bool = True, gap: int = GAP, most: int = MOST, stretch: int = STRETCH) -> DataFrame:
    """The records that ``index`` (rows of ``write``'s index, any selection) names, from their archives:
    record_id, page_id, url, record_type, payload_bytes, payload_digest, refers_to and, where asked, the
    payload (null for a revisit)."""
    wanted = index.select("record_id", "archive", "offset", "length")
    sorted_rows = wanted.repartition(F.col("archive"), F.floor(F.col("offset") / stretch)).sortWithinPartitions("archive", "offset")
    schema = ("record_id string, page_id string, url string, record_type string, payload_bytes long, payload_digest string, "
              "refers_to string") + (", payload string" if payload else "")
    out = pa.schema([(field.split()[0], pa.int64() if field.endswith("long") else pa.string()) for field in schema.split(", ")])

    def record(raw, record_id):
        fields, body = parse_record(zlib.decompress(raw, 31))
        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
        if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
            raise ValueError(f"record {record_id}: the payload does not have the digest of its header")
        row = {"record_id": record_id, "page_id": fields.get("x-page-id"), "url": fields.get("warc-target-uri"), "record_type": kind,
               "payload_bytes": len(body) if kind == "response" else int(fields["x-payload-length"]), "payload_digest": digest,
               "refers_to": fields.get("x-refers-to-page-id")}
        return row | ({"payload": body.decode() if kind == "response" else None} if payload else {})

    def run(batches):
        fs, folder = _opened(root)
        name = file = None
        for batch in batches:
            ids, archives = batch.column("record_id").to_pylist(), batch.column("archive").to_pylist()
            offsets, lengths = np.asarray(batch.column("offset")), np.asarray(batch.column("length"))
            for first, end in ranges(archives, offsets, lengths, gap, most):
                if archives[first] != name:
                    name, file = archives[first], fs.open_input_file(f"{folder}/{archives[first]}")
                start = int(offsets[first])
                data = memoryview(file.read_at(int(offsets[end - 1] + lengths[end - 1]) - start, start))
                found, size = [], 0
                for i in range(first, end):
                    at = int(offsets[i]) - start
                    found.append(record(data[at:at + int(lengths[i])], ids[i]))
                    size += found[-1]["payload_bytes"]
                    if size > most or i == end - 1:
                        yield pa.RecordBatch.from_pylist(found, out)
                        found, size = [], 0

    return sorted_rows.mapInArrow(run, schema)
