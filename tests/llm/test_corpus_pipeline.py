import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from txnwatch.llm import language_id as li
from txnwatch.llm import quality_rules as qr
from txnwatch.llm import simhash as sh
from txnwatch.llm.common import written
from txnwatch.llm.packing import cut

SF = "/root/testdata/sf0.01"


def _components(fps):
    out = list(range(len(fps)))
    def find(x):
        while out[x] != x:
            x = out[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                out[find(i)] = find(j)
    return [find(k) for k in range(len(fps))]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(SF + "/documents.parquet"), []
    for name, f in cp.STAGES:
        docs = written(f(spark, docs, SF), "test-pipeline")
        out.append(docs)
    return out


def test_each_stage_against_brute_force(spark, stages):
    docs = spark.read.parquet(SF + "/documents.parquet")
    columns = docs.columns
    before = docs.toPandas().set_index("doc_id")
    kept = []
    for df in stages[:4]:
        assert df.columns == columns
        rows = df.toPandas()
        kept.append(rows.set_index("doc_id"))
        assert rows.doc_id.is_unique
        assert (kept[-1]["text"] == before.loc[kept[-1].index, "text"]).all()
    # language: all rows with letters are determined in this table, the others go
    assert set(kept[0].index) == {i for i, t in before["text"].items() if t and any(map(str.isalpha, t))}
    # quality: the base rules recomputed, and the operator's verdict on the stage's own input
    verdict = qr.with_quality(stages[0]).select("doc_id", "q.kept").toPandas().set_index("doc_id")["kept"]
    assert set(kept[1].index) == set(verdict.index[verdict])
    # exact and near copies
    norm = kept[1]["text"].map(lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t))
    assert set(kept[2].index) == {min(g) for g in norm.groupby(norm).groups.values()}
    ids = sorted(kept[2].index)
    comp = _components([sh.fingerprint(kept[2]["text"][i]) for i in ids])
    low = {}
    for i, c in zip(ids, comp):
        low.setdefault(c, i)
    assert set(kept[3].index) == set(low.values())
    # packing: every kept document whole
    pieces = stages[4].toPandas()
    for doc, own in pieces.groupby("doc_id"):
        assert own.sort_values("start")["length"].tolist() == cut(int(own["doc_tokens"].iloc[0]))
    assert set(pieces.doc_id) == set(low.values())


def test_odd_rows(spark, tmp_path):
    good = "the cat of and to a in is that for it as was with be by on a house near the water "
    rows = [(1, None, "en", "s", 0, "x"), (2, "", None, None, None, None), (3, good, "en", "s", 9, "x"), (3, good, "en", "s", 9, "x"),
            (None, good + "\n", "en", None, None, "x"), (4, "12 34 56", "en", "s", 1, "x"), (5, good * 400, "fr", "s", 1, "x"),
            (6, "we went down a long road last night when all of our old friends had gone" + "\n" * 2_000_000 + "home", "en", "s", 1, "x")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(path)
    # 1, 2 and 4 have no letter, 5 repeats itself; 3, its repetition and the row without an id are one text
    got = cp.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.min("doc_tokens").alias("least"), F.max("doc_tokens").alias("most"))
    rows = {r.doc_id: r for r in got.collect()}
    assert set(rows) == {3, 6} and all(r.n == r.least == r.most for r in rows.values())
    empty = spark.read.parquet(path).where("doc_id > 99")
    empty.write.parquet(str(tmp_path / "e" / "documents.parquet"))
    assert cp.run(spark, str(tmp_path / "e")).count() == 0


def test_nothing_clean_is_lost(stages):
    """Rows labelled good that the base rules keep survive the two filters."""
    spark = stages[0].sparkSession
    good = spark.read.parquet(SF + "/labels.parquet").where("quality = 1").join(
        qr.op1_quality_rules(spark, SF).where("not base_failed"), "doc_id").select("doc_id")
    left = good.join(stages[1], "doc_id", "left_semi").count()
    assert left >= 0.97 * good.count()
    assert li.UNDETERMINED == "und"
