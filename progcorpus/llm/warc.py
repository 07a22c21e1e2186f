"""WARC archives: a writer, a normaliser of monolithic gzip files with a sidecar
offset index, and a reader that goes through the index.

``write_archives(pages, folder)`` writes one record per row of any table with
``page_id``, ``url`` and ``html`` as ``.gz`` files that are each *one* gzip
stream.  The payload is the html in UTF-8 behind a small HTTP header.  Of the
rows with equal payloads of at least 1000 bytes the one with the largest
``page_id`` is a ``response``; the others are ``revisit`` records that refer to
it and carry the HTTP header only.  Smaller payloads are all responses.

``normalise(spark, source, target)`` inflates every archive below ``source``
once, as a stream, and rewrites it as ``<name>.warc.gz`` with each record a gzip
member of its own, next to ``<name>.warc.gz.idx``: one JSON line per record with
the member's ``offset`` and ``length``, type, ids and digest.  It holds one
chunk of a record in memory at a time.  It takes archives of any mixture of
members (so normalising twice changes nothing); a file that ends inside a
record or a stream raises ``ValueError`` with its name.  Files are written
under another name and renamed, the index last, so a task that is lost halfway
or run twice leaves whole files.

``read_index`` gives the sidecar rows, ``read_records`` the records: each
task takes a stretch of an archive of about ``STRETCH`` bytes, fetches it with one
ranged read and inflates its members, checking payload digests.

``round_trip(pages)`` does all of it and returns
``page_id, payload_bytes, payload_digest, record_type, refers_to``.

Nulls: null html is an empty payload; a null url is left out of the record; a
row with a null ``page_id`` is always a response and reads back with a null id.
Rows repeated in full are records of the same type; no row is lost.  An empty
table gives archives without records and no rows.  Other columns are ignored.
The archives lie in the shared folder of the session (any file system that
both Spark and pyarrow can open).

Scale: only ids and digests meet in the choice of revisits.  Digest groups are
aggregated before they are joined back, and both sides of that join are plain
shuffles, so adaptive execution splits a payload that a third of all pages
have; the html itself moves once, by ``page_id``.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from progcorpus.llm.common import local_path, scratch, ship, store

REVISIT_BYTES = 1000            # least payload that is revisited
RECORDS_PER_FILE = 100_000      # most records of one archive
CHUNK = 1 << 18                 # bytes inflated at a time
STRETCH = 8 << 20               # bytes of an archive that one read fetches
TASK_BYTES = 64 << 20           # bytes of archives that one task reads
LEVEL = 6                       # compression of the rewritten members

# fixed values of the format
VERSION, CRLF, END = b"WARC/1.1", "\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"   # the tables have no dates

INDEX_SCHEMA = ("archive string, offset long, length long, type string, id string, refers_to string, "
                "digest string")
RECORD_SCHEMA = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
                 "refers_to long, url string")


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, digest, refers_to`` of the rows to write as revisits."""
    html = F.coalesce(F.col("html"), F.lit(""))
    facts = pages.select("page_id", F.sha1(html).alias("digest"), F.octet_length(html).alias("size")).where(
        (F.col("size") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    winners = store(facts.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_min"))
                    .where(F.col("refers_to") != F.col("_min")).select("digest", "refers_to"), "warc-winners")
    return (facts.join(winners, "digest").where(F.col("page_id") != F.col("refers_to"))
            .select("page_id", "digest", "refers_to").distinct())


def write_archives(pages: DataFrame, folder: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """One gzip stream per file, one record per row."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    again = store(revisits(pages), "warc-revisits").toDF("_w_page", "_w_digest", "_w_refers")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.withColumn("_digest", F.sha1(html))
    rows = rows.join(again, (rows.page_id == again._w_page) & (rows._digest == again._w_digest), "left")
    size = F.octet_length(html)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    size.cast("string"), F.lit(CRLF * 2))
    revisit = F.col("_w_refers").isNotNull()
    block_size = F.octet_length(http) + F.when(revisit, 0).otherwise(size)
    uri = F.regexp_replace("url", r"[\x00-\x20]", "%20")

    def header(name, value, when=None):
        line = F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
        return F.coalesce(line if when is None else F.when(when, line), F.lit(""))

    def urn(col):
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(col).cast("string"), F.lit("")), F.lit(">"))

    record = F.concat(
        F.lit(VERSION.decode() + CRLF),
        header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", urn("page_id")),
        header("WARC-Date", F.lit(DATE)),
        header("WARC-Target-URI", uri),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        header("WARC-Refers-To", urn("_w_refers"), revisit),
        header("WARC-Profile", F.lit(PROFILE), revisit),
        header("Content-Type", F.lit("application/http;msgtype=response")),
        header("Content-Length", block_size.cast("string")),
        F.lit(CRLF), http, F.when(revisit, F.lit("")).otherwise(html))
    (rows.select(record.alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(folder))


class _Inflated:
    """The bytes of a gzip file of one or more members, a chunk at a time."""

    def __init__(self, stream, name: str):
        self.stream, self.name = stream, name
        self.member, self.raw, self.buffer, self.open = None, b"", bytearray(), False

    def fill(self) -> bool:
        """Inflate one more chunk into the buffer; false at the end."""
        while True:
            if not self.raw:
                self.raw = self.stream.read(CHUNK)
                if not self.raw:
                    if self.open:
                        raise ValueError(f"{self.name}: the gzip stream is cut off")
                    return False
            if not self.open:
                self.member, self.open = zlib.decompressobj(31), True
            out = self.member.decompress(self.raw, CHUNK)
            self.raw = self.member.unconsumed_tail
            if self.member.eof:
                self.raw, self.open = self.member.unused_data, False
            if out:
                self.buffer += out
                return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes up to and with ``mark``; None at the end of the file."""
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self.fill():
                if self.buffer.strip():
                    raise ValueError(f"{self.name}: ends inside a record header")
                return None
        out = bytes(self.buffer[:at + len(mark)])
        del self.buffer[:at + len(mark)]
        return out

    def take(self, n: int):
        """The next ``n`` bytes in pieces."""
        while n:
            if not self.buffer and not self.fill():
                raise ValueError(f"{self.name}: ends inside a record")
            piece = bytes(self.buffer[:n])
            del self.buffer[:n]
            n -= len(piece)
            yield piece


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _rewrite(source, target, archive: str, index) -> None:
    """Every record of ``source`` as a member of ``target``; index lines to ``index``."""
    data, offset = _Inflated(source, archive), 0
    while (head := data.until(END)) is not None:
        head = head.lstrip(b"\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError(f"{archive}: no record at {offset}")
        h = _headers(head)
        member, length = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
        size = int(h["content-length"])
        length += target.write(member.compress(head))
        for piece in data.take(size):
            length += target.write(member.compress(piece))
        for piece in data.take(len(END)):
            if piece.strip(b"\r\n"):
                raise ValueError(f"{archive}: a record at {offset} is longer than it says")
        length += target.write(member.compress(END) + member.flush())
        index.write(json.dumps({
            "archive": archive, "offset": offset, "length": length, "type": h.get("warc-type"),
            "id": h.get("warc-record-id"), "refers_to": h.get("warc-refers-to"),
            "digest": h.get("warc-payload-digest")}).encode() + b"\n")
        offset += length


def _target_name(path: str) -> str:
    return os.path.basename(path).removesuffix(".gz").removesuffix(".txt").removesuffix(".warc") + ".warc.gz"


def _normalise_batches(target_folder: str):
    def run(batches):
        import uuid

        import pyarrow as pa

        out_fs, out = local_path(target_folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, p = local_path(path)
                name = _target_name(p)
                tmp = f"{out}/_{uuid.uuid4().hex}"
                with fs.open_input_stream(p, compression=None, buffer_size=1 << 20) as source, \
                        out_fs.open_output_stream(f"{tmp}.gz", compression=None, buffer_size=1 << 20) as target, \
                        out_fs.open_output_stream(f"{tmp}.idx", compression=None, buffer_size=1 << 20) as index:
                    _rewrite(source, target, name, index)
                out_fs.move(f"{tmp}.gz", f"{out}/{name}")
                out_fs.move(f"{tmp}.idx", f"{out}/{name}.idx")
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])
    return run


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite every ``.gz`` archive below ``source`` into ``target``; the index.  Sources
    that would get the same name (``x.gz`` and ``x.warc.gz``) are refused."""
    ship(__name__, "progcorpus.llm.common")
    fs, path = local_path(target)
    fs.create_dir(path, recursive=True)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"^(.*?)(?:\.warc)?(?:\.txt)?\.gz$", "$1")
    twice = files.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("a"), F.max("path").alias("b")) \
        .where(F.col("n") > 1).first()
    if twice is not None:
        raise ValueError(f"both {twice.a} and {twice.b} would be rewritten as {_target_name(twice.a)}")
    files.mapInArrow(_normalise_batches(target), "path string").write.format("noop").mode("overwrite").save()
    return read_index(spark, target)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar rows of all archives in ``folder``."""
    return spark.read.schema(INDEX_SCHEMA).option("pathGlobFilter", "*.idx").json(folder)


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _record(member: bytes, archive: str):
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url`` of a member, and the payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(END)
    h = _headers(head)
    block = rest[:int(h["content-length"])]
    http, _, payload = block.partition(END)
    kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:")
    size = int(_headers(http)["content-length"])
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{archive}: the payload of {h['warc-record-id']} isn't what its header says")
    return (_page(h["warc-record-id"]), size, digest, kind, _page(h.get("warc-refers-to")),
            h.get("warc-target-uri")), payload


def _read_batches(folder: str, with_payload: bool):
    def run(batches):
        import pyarrow as pa

        fs, base = local_path(folder)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]

        def flush(rows, payloads):
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            if with_payload:
                cols.append(pa.array(payloads, pa.binary()))
            return pa.RecordBatch.from_arrays(cols, names=names + ["payload"] * with_payload)

        def stretches():
            """Runs of neighbouring members of one archive."""
            held: list[tuple[str, int, int]] = []
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    if held and (row[0] != held[0][0] or row[1] != held[-1][1] + held[-1][2]
                                 or row[1] - held[0][1] >= STRETCH):
                        yield held
                        held = []
                    held.append(row)
            if held:
                yield held

        for held in stretches():
            archive, first = held[0][0], held[0][1]
            with fs.open_input_file(f"{base}/{archive}") as f:
                raw = f.read_at(held[-1][1] + held[-1][2] - first, first)
            got = [_record(raw[o - first:o - first + n], archive) for _, o, n in held]
            yield flush([r for r, _ in got], [p if r[3] == "response" else None for r, p in got])
    return run


def read_records(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """All records of the archives in ``folder``, through the sidecar index; with
    ``payload``, the payload bytes too (null for revisits)."""
    ship(__name__, "progcorpus.llm.common")
    index = read_index(spark, folder).select("archive", "offset", "length")
    total = index.agg(F.sum("length")).first()[0] or 0
    # index rows are a few bytes each; the tasks are sized by the bytes they fetch
    tasks = max(1, -(-total // TASK_BYTES), min(spark.sparkContext.defaultParallelism, -(-total // STRETCH)))
    spread = index.repartition(tasks, "archive", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("archive", "offset")
    return spread.mapInArrow(_read_batches(folder, payload), RECORD_SCHEMA + (", payload binary" if payload else ""))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back; a row per page."""
    spark = pages.sparkSession
    stream, archives = scratch(spark, "warc-streams"), scratch(spark, "warc-archives")
    write_archives(pages, stream)
    normalise(spark, stream, archives)
    return read_records(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""
