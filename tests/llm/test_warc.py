import base64
import hashlib
from collections import Counter

from pyspark.sql import functions as F

from loreweave.llm import warc

ROWS = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://b/ü \r\nX: y", ""), (None, "http://c", "<p>x</p>"), (5, "http://d", "é\r\n\r\nWARC/1.1\r\n" * 3), (6, "http://e", "y" * 3_000_000), (None, None, "only null id"), (7, "http://f", "\u0000")]


def _frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "extra", "d", 1) for r in rows], "page_id long, url string, html string, archive string, digest string, offset long")


def _want(rows):
    first, out = {}, Counter()
    for i, _, html in rows:
        k = html or ""
        if k not in first or first[k] is None or (i is not None and i < first[k]):
            first[k] = i
    done = set()
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        revisit = (html or "") in done
        done.add(html or "")
        out[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first[html or ""] if revisit else None)] += 1
    return out


def test_round_trip(spark):
    out = warc.read_records(warc.write_archives(_frame(spark))).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == _want(ROWS)
    payloads = {r.page_id: r.payload for r in out if r.record_type == "response"}
    assert payloads[5] == ROWS[6][2] and payloads[6] == ROWS[7][2]


def test_selected_records_only(spark):
    index = warc.write_archives(_frame(spark))
    assert index.columns[:5] == ["archive", "offset", "length", "url", "digest"]
    some = warc.read_records(index.where(F.col("page_id").isin(5, 6))).collect()
    assert sorted(r.page_id for r in some) == [5, 6]


def test_records_are_valid_members(spark):
    import gzip

    from pyarrow import fs

    index = warc.write_archives(_frame(spark))
    name = index.where("page_id = 5").first().archive
    system, path = fs.FileSystem.from_uri(name)
    data = gzip.decompress(system.open_input_file(path).readall())
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n")


def test_base32(spark):
    rows = [(hashlib.sha1(str(i).encode()).hexdigest(),) for i in range(20)]
    got = spark.createDataFrame(rows, "h string").select("h", warc.base32(F.col("h")).alias("b")).collect()
    assert all(r.b == base64.b32encode(bytes.fromhex(r.h)).decode() for r in got)


def test_empty(spark):
    assert warc.read_records(warc.write_archives(_frame(spark, []))).count() == 0


def test_batches_are_bounded_by_what_records_unpack_to(spark):
    pages = [(k, f"u{k}", f"{k} " + "a" * (1 << 20)) for k in range(20)]
    index = warc.write_archives(_frame(spark, pages)).select("archive", "offset", "length").sort("archive", "offset").toArrow()
    sizes = [batch.num_rows for batch in warc._read(iter(index.to_batches()))]
    assert sum(sizes) == 20 and max(sizes) <= 4
