"""WARC archives, written with an index first and read back by byte ranges.

Writing: each task writes one archive of gzip members (one per record) and returns
an index row per record: file, offset, length, URL, digest and the record's other
headers.  A file's name is new for every attempt and only the index of the attempt
that succeeded names it, so a repeated or lost task leaves no wrong entry; the index
is stored before anything reads it.

Payloads that are equal (SHA-256) and at least ``min_revisit`` bytes long are stored
once, by the row with the smallest page_id; the others are ``revisit`` records that
name it.  Who that is comes from an aggregation on digests alone, and only digests
that occur twice or more meet the pages again.

Reading: selected index rows are dealt by (file, ``span`` bytes of the file), sorted
by offset, and neighbours no further apart than ``gap`` are fetched in one read of at
most ``span`` bytes or one record.

Null html is an empty payload and a null url an empty one; a null page_id is written
as such and names a group only if all its ids are null; rows that repeat the smallest
page_id are responses too.  An empty table writes no archive and reads no row.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.llm.common import id_back, id_text, python_ready, table, written
from txnwatch.session import work_dir

MIN_REVISIT = 100
SPAN = 16 << 20
GAP = 64 << 10
DATE = "1970-01-01T00:00:00Z"        # the pages carry no fetch time
INDEX = ("page_id string, file string, offset long, length long, url string, payload_digest string, payload_bytes long, "
         "record_type string, refers_to string")


def record(page_id, url: str, html: str, digest: str, record_type: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but keeps the payload's digest and size."""
    payload = html.encode("utf-8", "surrogatepass")
    block = payload if record_type == "response" else b""
    name = page_id or ""
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{name}>",
            f"WARC-Date: {DATE}", "WARC-Target-URI: " + _one_line(url), f"WARC-Payload-Digest: sha256:{digest}",
            f"X-Payload-Length: {len(payload)}", "Content-Type: text/html;charset=utf-8", f"Content-Length: {len(block)}"]
    if record_type == "revisit":
        head[5:5] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                     f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def parse(data: bytes) -> dict:
    """The headers of a record and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    out = dict(x.split(": ", 1) for x in lines[1:])
    n = int(out["Content-Length"])
    if lines[0] != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError("damaged WARC record")
    return out | {"block": rest[:n]}


def _write(batches: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    name = f"{base}/{uuid.uuid4().hex}.warc.gz"
    out, at = None, 0
    try:
        for b in batches:
            if out is None and len(b):
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(name, compression=None)
            offset, length = [], []
            for r in b.itertuples(index=False):
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = pack.compress(record(r.page_id, r.url, r.html, r.payload_digest, r.record_type, r.refers_to)) + pack.flush()
                out.write(data)
                offset.append(at)
                length.append(len(data))
                at += len(data)
            yield b.drop(columns="html").assign(file=name, offset=offset, length=length)[[x.split()[0] for x in INDEX.split(", ")]]
    finally:
        if out is not None:
            out.close()


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write a record per row (page_id, url, html) under ``folder``, a URI that all executors
    share; returns the stored index."""
    python_ready(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"),
                        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest"))
    twice = written(rows.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest")
                    .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "warc-copies")
    later = F.coalesce((F.col("page_id") != F.col("first")) | (F.col("page_id").isNull() & F.col("first").isNotNull()), F.lit(False))
    typed = rows.join(twice, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_digest", "payload_bytes",
        F.when(later, "revisit").otherwise("response").alias("record_type"), F.when(later, F.col("first")).alias("refers_to"))
    typed = typed.withColumns({c: id_text(c) for c in ("page_id", "refers_to")})
    index = typed.mapInPandas(lambda it: _write(it, folder), INDEX)
    return written(id_back(index, "page_id", "refers_to"), "warc-index")


def _ranges(own: pd.DataFrame, span: int, gap: int) -> Iterator[pd.DataFrame]:
    """Runs of records (sorted by offset) to fetch in one read."""
    begin = 0
    offset, end = own["offset"].to_numpy(), (own["offset"] + own["length"]).to_numpy()
    for i in range(1, len(own) + 1):
        if i == len(own) or offset[i] - end[i - 1] > gap or end[i] - offset[begin] > span:
            yield own.iloc[begin:i]
            begin = i


def _read(batches: Iterator[pd.DataFrame], folder: str, span: int, gap: int) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    store, _ = fs.FileSystem.from_uri(folder)
    for b in batches:
        for name, own in b.groupby("file", sort=False):
            with store.open_input_file(name) as f:
                for run in _ranges(own.sort_values("offset"), span, gap):
                    base = int(run["offset"].iloc[0])
                    data = f.read_at(int(run["offset"].iloc[-1] + run["length"].iloc[-1]) - base, base)
                    rows = []
                    for at, n in zip(run["offset"], run["length"]):
                        r = parse(zlib.decompress(data[at - base:at - base + n], 31))
                        ident = r["WARC-Record-ID"][len("<urn:page:"):-1]
                        refers = r.get("WARC-Refers-To")
                        rows.append((ident or None, r["WARC-Target-URI"], r["block"], r["WARC-Type"],
                                     r["WARC-Payload-Digest"].removeprefix("sha256:"), int(r["X-Payload-Length"]),
                                     refers[len("<urn:page:"):-1] if refers else None))
                    yield pd.DataFrame(rows, columns=["page_id", "url", "payload", "record_type", "payload_digest", "payload_bytes", "refers_to"])


def read_records(index: DataFrame, folder: str, span: int = SPAN, gap: int = GAP) -> DataFrame:
    """The records that the rows of ``index`` name, read from the archives: page_id, url, payload
    (empty for revisits), record_type, payload_digest, payload_bytes, refers_to."""
    python_ready(index.sparkSession)
    place = index.select("file", "offset", "length", F.floor(F.col("offset") / span).alias("part"))
    # as many tasks as the archives have spans: index rows are small, what they name is not
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    dealt = place.repartition(max(1, -(-total // span)), "file", "part").sortWithinPartitions("file", "offset").drop("part")
    out = dealt.mapInPandas(lambda it: _read(it, folder, span, gap),
                            "page_id string, url string, payload binary, record_type string, payload_digest string, "
                            "payload_bytes long, refers_to string")
    return id_back(out, "page_id", "refers_to")


def payload_checks(records: DataFrame) -> DataFrame:
    """``records`` with the digest and size of what was read: a response is measured again, a
    revisit has its header's."""
    response = F.col("record_type") == "response"
    return records.select(
        "page_id", F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return payload_checks(read_records(index, folder))


OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
