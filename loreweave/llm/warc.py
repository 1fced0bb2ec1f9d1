"""WARC archives with an index that is written first and read by byte ranges.

Each page becomes a gzip member of an archive: a response with its payload, or, if a page with a smaller
id has the same payload, a revisit that refers to it. Tasks write archives into the shared folder and
yield the index: archive, offset, length, URL and digest of each record. Readers sort the selected records
by archive and offset and join neighbouring ones to one read.

Defined results: a null html is an empty payload; of equal rows one is the response; null ids come last;
URLs may be null or hold any character; an empty table gives an empty index; further columns are ignored.
An archive of an attempt that was lost is in no index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import as_text, join_unique, shared_folder, slices, stored

#: Bytes after which a task begins a new archive; bytes between two records, and of a read, up to which one read serves both.
ARCHIVE_BYTES, GAP, READ_BYTES = 256 << 20, 64 << 10, 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
INDEX = "archive string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long"
INDEX_SCHEMA = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def record_id(page_id: int | None, url: str | None, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}\n{url}\n{digest}\n{copy}')}>"


def record(kind: str, page_id: int | None, url: str | None, digest: str, n_bytes: int, payload: bytes, refers: tuple[int | None, str | None] | None, copy: int = 0) -> bytes:
    """One record; digest is the payload's SHA-1 in base32. A revisit has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, url, digest, copy)), ("WARC-Date", DATE), ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%-._~")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("X-Page-Id", "" if page_id is None else page_id)]
    if refers is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*refers, digest)), ("X-Refers-To-Page", "" if refers[0] is None else refers[0])]
    head.append(("Content-Length", len(http) + len(payload)))
    return b"".join([b"WARC/1.1\r\n", "".join(f"{k}: {v}\r\n" for k, v in head).encode(), b"\r\n", http, payload, b"\r\n\r\n"])


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's header fields, HTTP header and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Archives:
    """Archives that one task attempt writes; their names are its own."""

    def __init__(self, folder: str):
        self.folder, self.out, self.name, self.at = folder, None, "", 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= ARCHIVE_BYTES:
            self.close()
            self.name = f"{self.folder}/pages-{uuid.uuid4().hex}.warc.gz"
            system, path = fs.FileSystem.from_uri(self.name)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            self.out, self.at = system.open_output_stream(path, compression=None), 0
        member = _member(data)
        self.out.write(member)
        self.at += len(member)
        return self.name, self.at - len(member), len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _write(folder: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = _Archives(folder)
        try:
            for batch in batches:
                for part in slices(batch, "html"):
                    rows = []
                    for r in part.to_pylist():
                        digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                        payload = (r["html"] or "").encode()
                        for copy in range(r["copies"]):
                            refers = (r["first_id"], r["first_url"]) if kind == "revisit" else None
                            at = archives.add(record(kind, r["page_id"], r["url"], digest, r["n_bytes"], payload, refers, copy))
                            rows.append(dict(zip(INDEX_SCHEMA.names, (*at, r["url"], digest, r["page_id"], kind, r["first_id"] if refers else None), strict=True)))
                    yield pa.RecordBatch.from_pylist(rows, schema=INDEX_SCHEMA)
        finally:
            archives.close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) as archives into the folder and gives their index."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html).alias("sha1"))
    # of equal payloads one goes through the shuffle for each task that has it
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url", "html")
    firsts = rows.groupBy("sha1").agg(F.min(order).alias("x")).select("sha1", "x.page_id", "x.url", "x.html", F.octet_length("x.html").cast("long").alias("n_bytes"), F.lit(1).alias("copies"), F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("string").alias("first_url"))
    responses = stored(firsts.mapInArrow(_write(folder, "response"), INDEX), "warc-index")
    ids = stored(rows.groupBy("sha1", "page_id", "url", F.octet_length("html").cast("long").alias("n_bytes")).agg(F.count("*").cast("int").alias("n")), "warc-pages")
    first = responses.select("digest", F.col("page_id").alias("first_id"), F.col("url").alias("first_url"))
    keyed = ids.withColumn("digest", base32(F.col("sha1")))
    joined = join_unique(keyed, first, "digest", ids.count())
    same = F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    others = joined.withColumn("copies", F.when(same, F.col("n") - 1).otherwise(F.col("n"))).where("copies > 0").select("sha1", "page_id", "url", F.lit(None).cast("string").alias("html"), "n_bytes", "copies", "first_id", "first_url")
    return responses.unionByName(stored(others.mapInArrow(_write(folder, "revisit"), INDEX), "warc-index"))


def base32(sha1_hex):
    """The base32 form of a SHA-1 in hex: 160 bits are 32 characters of 5 bits."""
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = F.concat(*[F.lpad(F.conv(F.substring(sha1_hex, 1 + 10 * k, 10), 16, 2), 40, "0") for k in range(4)])
    return F.concat(*[F.substring(F.lit(digits), F.conv(F.substring(bits, 1 + 5 * k, 5), 2, 10).cast("int") + 1, F.lit(1)) for k in range(32)])


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows come sorted by archive and offset."""
    name, source = None, None

    def fetch(run: list[dict]) -> Iterator[pa.RecordBatch]:
        nonlocal name, source
        if run[0]["archive"] != name:
            name = run[0]["archive"]
            system, path = fs.FileSystem.from_uri(name)
            source = system.open_input_file(path)
        start = run[0]["offset"]
        data = source.read_at(run[-1]["offset"] + run[-1]["length"] - start, start)
        out, held = [], 0
        for r in run:
            fields, http, payload = parse(zlib.decompress(data[r["offset"] - start : r["offset"] - start + r["length"]], 31))
            if out and held + len(payload) > READ_BYTES:  # few bytes may unpack to many
                yield pa.RecordBatch.from_pylist(out, schema=RECORD_SCHEMA)
                out, held = [], 0
            held += len(payload)
            length = int(http.rpartition(b"Content-Length: ")[2])
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if fields["WARC-Type"] == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                raise ValueError(f"{name} has another payload at {r['offset']} than its header says")
            number = lambda k: int(fields[k]) if fields.get(k) else None
            out.append({"page_id": number("X-Page-Id"), "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page"), "payload": payload.decode() if fields["WARC-Type"] == "response" else None})
        yield pa.RecordBatch.from_pylist(out, schema=RECORD_SCHEMA)

    run: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            end = run[-1]["offset"] + run[-1]["length"] if run else 0
            if run and (r["archive"] != run[-1]["archive"] or r["offset"] > end + GAP or r["offset"] + r["length"] > run[0]["offset"] + READ_BYTES):
                yield from fetch(run)
                run = []
            run.append(r)
    if run:
        yield from fetch(run)


def read_records(selected: DataFrame) -> DataFrame:
    """The records of the selected index rows, by coalesced reads. Parts of an archive may go to several tasks."""
    ordered = selected.select("archive", "offset", "length").repartition("archive", F.floor(F.col("offset") / (4 * READ_BYTES))).sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(_read, RECORDS)
