import hashlib
import re

from pyspark.sql import functions as F

from txnwatch.llm.exact_dedup import drop_exact_copies, exact_groups


def _docs(spark, rows, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, kept string, _row string").write.parquet(path)
    return spark.read.parquet(path)


ROWS = [(5, "a  b", "x", "r"), (3, "a\t\n b", "x", "r"), (3, "a b", "y", "r"), (9, None, None, None), (8, "", "z", None),
        (None, "a b", None, None), (7, " a b", None, None), (None, "only", None, None), (None, "only", None, None),
        (1, "w" * 100_000, None, None), (2, "w" * 100_000 + " ", None, None), (-4, "é x", None, None)]


def _brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t, *_ in rows]
    out = []
    for (i, *_), t in zip(rows, norm):
        ids = [r[0] for r, n in zip(rows, norm) if n == t]
        known = [x for x in ids if x is not None]
        out.append((i, min(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups_match_brute_force(spark, tmp_path):
    df = _docs(spark, ROWS, tmp_path)
    for digest in (None, lambda c: F.unhex(F.lpad(F.hex(F.length(c) % 2), 2, "0"))):   # the second one collides
        got = exact_groups(df, **({"digest": digest} if digest else {})).collect()
        key = [(r.doc_id, r.keep_id, r.group_size) for r in got]
        assert sorted(key, key=str) == sorted([b[:3] for b in _brute(ROWS)], key=str)
        assert sum(r.kept for r in got) == 7        # one row a text, repeated rows too
        if digest is None:
            assert sorted(r.text_sha256 for r in got) == sorted(b[3] for b in _brute(ROWS))


def test_drop_keeps_columns_and_one_row_a_text(spark, tmp_path):
    df = _docs(spark, ROWS, tmp_path)
    out = drop_exact_copies(df)
    assert out.columns == ["doc_id", "text", "kept", "_row"]
    assert out.count() == 7


def test_empty(spark, tmp_path):
    df = _docs(spark, [], tmp_path)
    assert exact_groups(df).count() == 0
    assert drop_exact_copies(df).count() == 0


def test_executors_that_change_lose_nothing(spark, tmp_path):
    """Spark deals files to tasks by the cores it has: keys must not follow the deal."""
    path = str(tmp_path / "d")
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(6).write.parquet(path)
    name, counts = "spark.sql.leafNodeDefaultParallelism", set()
    before = spark.conf.get(name, None)
    try:
        for build, read in ((4, 4), (4, 1), (1, 4)):
            spark.conf.set(name, build)
            out, groups = drop_exact_copies(spark.read.parquet(path)), exact_groups(spark.read.parquet(path)).where("kept")
            spark.conf.set(name, read)
            counts |= {out.count(), groups.count()}
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    assert len(counts) == 1


def test_derived_tables_are_stored_first(spark, tmp_path):
    df = _docs(spark, ROWS, tmp_path)
    twice = df.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))       # rows of one place in a file
    assert drop_exact_copies(twice).count() == 7
    assert drop_exact_copies(df.unionByName(df)).count() == 7
    assert sum(r.kept for r in exact_groups(twice).collect()) == 7
