import gzip
import hashlib
import zlib

import pytest
from pyspark.errors import PythonException

from progcorpus.llm import common, warc

SCHEMA = "page_id long, url string, html string, digest string"


def brute(rows):
    top = {}
    for i, h in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    out = []
    for i, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and i is not None and top[h or ""] != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response",
                    top[h or ""] if again else None))
    return sorted(out, key=str)


ROWS = [(1, "é" * 500), (2, "é" * 500), (9, "é" * 500), (3, "x" * 999), (4, "x" * 999), (5, None), (6, ""), (None, "é" * 500),
        (7, "a\r\n\r\nWARC/1.1\r\n\r\nb\0c" * 100), (8, "a\r\n\r\nWARC/1.1\r\n\r\nb\0c" * 100), (10, "y" * 700_000), (11, "y" * 700_000),
        (9, "é" * 500), (1, "other" * 300)]


def pages(spark, rows):
    return spark.createDataFrame([(i, None if i == 3 else f"http://h/ {i}\n", h, "z") for i, h in rows], SCHEMA)


def test_round_trip_equals_brute_force(spark):
    got = sorted(map(tuple, warc.round_trip(pages(spark, ROWS)).collect()), key=str)
    assert got == brute(ROWS)
    assert warc.round_trip(pages(spark, ROWS).limit(0)).collect() == []


def test_members_index_and_payloads(spark):
    src, dst, again = (common.scratch(spark, "t") for _ in range(3))
    warc.write_archives(pages(spark, ROWS), src, records_per_file=4)
    index = warc.normalise(spark, src, dst).collect()
    assert len(index) == len(ROWS)
    for r in index:
        fs, base = common.local_path(dst)
        with fs.open_input_file(f"{base}/{r.archive}") as f:
            member = f.read_at(r.length, r.offset)
        d = zlib.decompressobj(31)
        raw = d.decompress(member)
        assert d.eof and not d.unused_data and raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    got = {(r.page_id, r.payload_digest): r for r in warc.read_records(spark, dst, payload=True).collect()}
    for i, h in ROWS:
        r = got[(i, hashlib.sha1((h or "").encode()).hexdigest())]
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == (h or "").encode()
        assert (r.url is None) == (i == 3)
    key = lambda r: (r.archive, r.offset, r.length, r.id)
    assert sorted(map(key, warc.normalise(spark, dst, again).collect())) == sorted(map(key, index))


@pytest.mark.parametrize("raw", [
    gzip.compress(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort\r\n\r\n"),
    gzip.compress(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nshort\r\n\r\n" * 9)[:-9],
    gzip.compress(b"junk\r\n\r\n"),
])
def test_damaged_archives_are_named(spark, raw):
    src = common.scratch(spark, "t")
    fs, base = common.local_path(src)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/bad.gz", compression=None) as f:
        f.write(raw)
    with pytest.raises(PythonException, match="bad.warc.gz"):
        warc.normalise(spark, src, common.scratch(spark, "t"))


def test_sources_of_one_name_are_refused(spark):
    src = common.scratch(spark, "t")
    fs, base = common.local_path(src)
    for name in ("x.gz", "y.gz", "sub/x.warc.gz"):
        fs.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
        with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
            f.write(gzip.compress(b""))
    with fs.open_output_stream(f"{base}/x.txt.gz", compression=None) as f:
        f.write(gzip.compress(b""))
    with pytest.raises(ValueError, match="x.warc.gz"):
        warc.normalise(spark, src, common.scratch(spark, "t"))


def test_reads_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "STRETCH", 2000)
    monkeypatch.setattr(warc, "TASK_BYTES", 4000)
    rows = [(i, f"{i} {hashlib.sha256(str(i).encode()).hexdigest() * 20}") for i in range(300)]
    src, dst = (common.scratch(spark, "t") for _ in range(2))
    warc.write_archives(pages(spark, rows), src)
    warc.normalise(spark, src, dst)
    read = warc.read_records(spark, dst)
    size = sum(r.length for r in warc.read_index(spark, dst).collect())
    assert read.rdd.getNumPartitions() >= size // 4000 > 4
    assert read.count() == len(rows)


def test_clashing_names(spark):
    names = ["archive", "offset", "length", "type", "id", "refers_to", "digest", "payload_digest", "record_type", "_top", "n"]
    rows = [(i, f"http://h/{i}", "same " * 300, *["v"] * len(names)) for i in range(5)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, " + ", ".join(f"{n} string" for n in names))
    got = sorted(map(tuple, warc.round_trip(table).collect()), key=str)
    assert got == brute([r[:1] + r[2:3] for r in rows])


def test_pages(spark, sf_docs):
    import os

    SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")

    table = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r.page_id, r.html) for r in table.collect()]
    assert sorted(map(tuple, warc.round_trip(table).collect()), key=str) == brute(rows)
