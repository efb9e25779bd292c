"""Web archives with a two-level capture index.

Pages are sorted by reversed-host URL key over the whole cluster. Every task writes one shard: an archive of
gzip-compressed WARC records in key order, an index of compressed blocks of capture lines, and a sparse directory with one
entry per block (first and last key, place of the block). A lookup goes down the two levels: binary search in
the shard's directory, one ranged read of the block it names, binary search there, then ranged reads of the records.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.shared import slices, work_folder, written

LINES_PER_BLOCK = 64
DATE = "2000-01-01T00:00:00Z"
SHARD = "shard string, captures long, low string, high string"
HIT = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "archive string, offset long, length long"
)


def url_key(url: str = "url") -> Column:
    """Reversed-host key of a URL: ``https://a.example.com:80/p?q#f`` becomes ``com,example,a)/p?q``; null becomes empty."""
    text = F.coalesce(F.col(url), F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"(?s)#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*", 0), r"^.*@|:[0-9]*$", ""))
    path = F.regexp_replace(rest, r"^[^/?]*", "")
    return F.when(text == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path))


def with_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(key, page_id, url, html, digest, first_id): ``first_id`` is set where another page's record holds the payload.

    Payloads that occur once drop out of the grouped table, so it is small beside the pages; Spark broadcasts it if
    its written size allows and otherwise joins by digest, where adaptive execution splits a payload of many pages.
    """
    captured = pages.select(
        url_key().alias("key"), "page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    known = captured.where(F.length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    shared = written(known.where("n > 1 AND first_id IS NOT NULL").drop("n"), "warc-payloads")
    own = F.when((F.length("html") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return captured.join(shared, "digest", "left").withColumn("first_id", own)


def _header(text: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: a response with its HTTP message, or a revisit that names the response and has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    block = http + payload
    if refers_to is not None:
        block = http
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode("utf-8", "surrogatepass")
    return gzip.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parsed(member: bytes) -> dict:
    """The fields of one record. A response's digest and length are taken from the payload itself, a revisit's from its headers."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared, digest = int(http.rpartition(b": ")[2]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda name: None if "null" in fields[name] else int(fields[name].strip("<>").rpartition(":")[2])
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != declared or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To") if revisit else None, "payload_bytes": declared, "payload_digest": digest,
        "payload": None if revisit else payload,
    }


def _writer(folder: str):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        shard = f"{task.partitionId():06d}-{task.taskAttemptId()}"  # a task that runs again writes files of its own
        archive = index = None
        directory, lines, offset, place, captures, span = [], [], 0, 0, 0, []

        def close_block():
            nonlocal place
            block = zlib.compress("\n".join(json.dumps(line) for line in lines).encode("utf-8", "surrogatepass"))
            directory.append([lines[0][0], lines[-1][0], place, len(block)])
            index.write(block)
            place += len(block)
            lines.clear()

        for batch in slices(batches, "html"):
            if archive is None:
                archive, index = (fs.open_output_stream(f"{root}/{shard}.{kind}", compression=None) for kind in ("warc.gz", "cdx"))
            for key, page_id, url, html, digest, first_id in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "url", "html", "digest", "first_id"))):
                member = record(page_id, url, html, digest, first_id)
                archive.write(member)
                lines.append([key, offset, len(member)])
                offset, captures = offset + len(member), captures + 1
                span = [span[0] if span else key, key]
                if len(lines) == LINES_PER_BLOCK:
                    close_block()
        if archive is None:
            return
        if lines:
            close_block()
        archive.close()
        index.close()
        with fs.open_output_stream(f"{root}/{shard}.dir") as out:
            out.write(zlib.compress(json.dumps(directory).encode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_pylist([{"shard": shard, "captures": captures, "low": span[0], "high": span[1]}])

    return write


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 100) -> tuple[str, DataFrame]:
    """Writes the archives of ``pages`` (page_id, url, html) to ``folder``; returns it and the table of its shards.

    Of pages with equal payloads of ``least_bytes`` or more, the smallest page_id is stored and the others become revisits of it; rows
    that repeat this page_id count as stored too. A null html is an empty payload, a null url has the empty key,
    a null page_id is never the one revisited (if all are null, all are stored). Other columns are not read. No rows: no shards.
    The range sort orders equal keys by page_id, so a host or URL with a third of all captures fills several shards.
    """
    folder = folder or work_folder(pages.sparkSession, "warc")
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    ordered = with_revisits(pages, least_bytes).repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return folder, written(ordered.mapInArrow(_writer(folder), SHARD), "warc-shards")


def _reader(folder: str, with_payload: bool):
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        opened, files, held, entries, lasts = None, (), (None, None), [], []
        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("archive", pa.string()), ("offset", pa.int64()),
            ("length", pa.int64()), *([("payload", pa.binary())] if with_payload else []),
        ])
        found, size = [], 0
        for batch in batches:
            for shard, key in zip(batch.column("shard").to_pylist(), batch.column("key").to_pylist()):
                if shard != opened:
                    for file in files:
                        file.close()
                    opened, held = shard, (None, None)
                    files = tuple(fs.open_input_file(f"{root}/{shard}.{kind}") for kind in ("warc.gz", "cdx"))
                    with fs.open_input_stream(f"{root}/{shard}.dir") as source:
                        entries = json.loads(zlib.decompress(source.read()))
                    lasts = [entry[1] for entry in entries]
                at = bisect_left(lasts, key)  # the first block whose last key is not below the wanted key
                while at < len(entries) and entries[at][0] <= key:
                    if held[0] != at:
                        held = (at, [json.loads(line) for line in zlib.decompress(files[1].read_at(entries[at][3], entries[at][2])).split(b"\n")])
                    first = bisect_left(held[1], key, key=lambda line: line[0])
                    for line_key, offset, length in held[1][first:]:
                        if line_key != key:
                            break
                        fields = parsed(files[0].read_at(length, offset))
                        found.append(fields | {"archive": f"{shard}.warc.gz", "offset": offset, "length": length})
                        size += fields["payload_bytes"] * with_payload + 300
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(found, schema)
                            found, size = [], 0
                    at += 1
        for file in files:
            file.close()
        if found:
            yield pa.RecordBatch.from_pylist(found, schema)

    return read


def lookup(folder: str, shards: DataFrame, urls: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every capture whose key equals that of a URL in ``urls`` (column url), each once, read from the archives.

    The shards' key ranges do not overlap but for a key that fills several; their table has one row per writing task, is joined
    by range to the distinct wanted keys, and a task then walks its keys in order, so each block is read once.
    A revisit comes back with the length and digest of the full payload, and no payload.
    """
    keys = urls.select(url_key().alias("key")).distinct()
    bounds = sorted(map(tuple, shards.select("low", "high", "shard").collect()))  # one row per writing task
    lows, highs, names = ([bound[i] for bound in bounds] for i in range(3))

    def assigned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = []
            for key in batch.column("key").to_pylist():
                at = bisect_left(highs, key)
                while at < len(names) and lows[at] <= key:
                    pairs.append((names[at], key))
                    at += 1
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs])], ["shard", "key"])

    order = ["shard", "key"]  # dealt by range, so that there are as many reading tasks as shards and a large shard is read by several
    wanted = keys.mapInArrow(assigned, "shard string, key string").repartitionByRange(max(1, len(names)), *order).sortWithinPartitions(*order)
    return wanted.mapInArrow(_reader(folder, with_payload), HIT + (", payload binary" if with_payload else ""))


OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Nulls, empty and long texts, ties, repeated rows and empty tables: see :func:`write_archives` and :func:`lookup`."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder, shards = write_archives(pages)
    return lookup(folder, shards, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
