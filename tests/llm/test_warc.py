import gzip
import hashlib

from pyspark.sql import functions as F

from txnwatch.llm import warc
from txnwatch.session import work_dir

BIG = "<p>" + "héllo\r\n\r\nWARC/1.1\r\n" * 20
ROWS = [(5, "http://a/1", BIG), (3, "http://a/2", BIG), (3, "http://a/2", BIG), (9, None, None), (8, "u\r\nX: y", ""), (None, "n", BIG),
        (7, "s", "short"), (2, "s", "short"), (11, "long", "x" * 300_000), (12, "long", "x" * 300_000), (None, "q", "z" * 200), (None, "q", "z" * 200)]


def _pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, file string, offset int")


def _brute(rows):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (h or "") and r[0] is not None]
        first = min(same, default=None)
        revisit = len(data) >= 100 and first is not None and i != first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return out


def test_round_trip(spark):
    for span, gap in ((warc.SPAN, warc.GAP), (700, 0)):
        folder = work_dir(spark, "warc-test")
        index = warc.write_archives(_pages(spark).repartition(3), folder)
        records = warc.read_records(index, folder, span, gap)
        assert sorted(map(tuple, warc.payload_checks(records).collect()), key=str) == sorted(_brute(ROWS), key=str)
        got = {(r.page_id, bytes(r.payload)) for r in records.where("record_type = 'response'").collect()}
        assert (11, b"x" * 300_000) in got and (3, BIG.encode()) in got
        # a selection reads just its records; index rows point at whole gzip members
        some = warc.read_records(index.where("page_id in (5, 7)"), folder).collect()
        assert sorted(r.page_id for r in some) == [5, 7]
        row = index.where("page_id = 7").first()
        with open(row.file, "rb") as f:
            f.seek(row.offset)
            assert b"\r\n\r\nshort\r\n\r\n" in gzip.decompress(f.read(row.length))


def test_ranges_are_coalesced(spark):
    import pandas as pd

    own = pd.DataFrame({"offset": [0, 10, 25, 1000, 1010], "length": [10, 15, 5, 10, 500]})
    assert [len(r) for r in warc._ranges(own, span=600, gap=8)] == [3, 2]
    assert [len(r) for r in warc._ranges(own, span=27, gap=8)] == [2, 1, 1, 1]


def test_empty(spark):
    folder = work_dir(spark, "warc-test")
    index = warc.write_archives(_pages(spark).where("page_id > 99"), folder)
    assert index.count() == 0 and warc.read_records(index, folder).count() == 0


def test_pages(spark):
    sf = "/root/testdata/sf0.001"
    got = warc.op9_warc(spark, sf)
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(sf + "/pages.parquet").collect()]
    assert sorted(map(tuple, got.collect())) == sorted(_brute(rows))
    assert got.select(F.count_distinct("page_id")).first()[0] == len(rows)
