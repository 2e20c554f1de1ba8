import random
import re
from collections import Counter

import duckdb
import pytest

from txnwatch.llm import quality_rules as qr

TEXTS = [None, "", " \n\t ", "one", "a b c d e a b c d e", "x " * 300, "the of and to in " * 30 + "fresh words here",
         "line one two\nline one two\n\n \nother", "#*$%&|<> é\u2003ß 中文", "w" * 50_000, "a b c d e f g\x0b\x0cb c d e f g h",
         "the cat of and to a in is that for it as was with be by on " * 5]


def _brute(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", t) if x]
    win = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(win)
    covered = {k for i, x in enumerate(win) if n[x] > 1 for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_counts_match_brute_force(spark):
    rows = [(i, t, g, "clash") for i, t in enumerate(TEXTS) for g in ("en", None, "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, q string")
    for r in qr.with_quality(df, qr.DivergenceRules(min_reference=10), out="v").collect():
        v = r.v
        assert (v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed) == _brute(r.text)
        assert not (v.base_failed and v.kept)


def test_no_reference_and_empty_table(spark):
    df = spark.createDataFrame([(1, "some words " * 4 + "that stand on their own here", "en")], "doc_id long, text string, lang string")
    v = qr.with_quality(df).first().q
    assert v.char_distance is None and v.kept is not None
    assert qr.drop_low_quality(df.where("doc_id < 0")).columns == ["doc_id", "text", "lang"]
    assert qr.drop_low_quality(df.where("doc_id < 0")).count() == 0


def test_junk_goes_and_clean_stays():
    """On the driver's labelled rows: most junk is found, nearly no clean text is dropped."""
    from txnwatch.session import build_session

    spark = build_session("local[4]")
    sf = "/root/testdata/sf0.01"
    got = qr.op1_quality_rules(spark, sf).join(spark.read.parquet(sf + "/labels.parquet"), "doc_id").toPandas()
    judged = got[got.n_words >= 40]
    bad, good = judged[judged.quality == 0], judged[(judged.quality == 1) & ~judged.base_failed]
    assert (~bad.kept).mean() > 0.9
    assert good.kept.mean() > 0.99


def test_sql_twin(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(qr.op1_sql()).df().set_index("doc_id").sort_index()
    got = qr.op1_quality_rules(spark, sf).toPandas().set_index("doc_id").sort_index()
    for c in want.columns:
        if c.endswith("distance"):
            assert got[c].to_numpy(float) == pytest.approx(want[c].to_numpy(float), nan_ok=True, abs=1e-8)
        else:
            assert (got[c] == want[c]).all(), c


def _rows_of_both(spark, path):
    """Rows of the query and of its SQL over one documents table."""
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    want = con.execute(qr.op1_sql()).df().set_index("doc_id").sort_index()
    got = qr.op1_quality_rules(spark, str(path)).toPandas().set_index("doc_id").sort_index()
    assert list(got.columns) == list(want.columns)
    for c in want.columns:
        if c.endswith("distance"):
            assert got[c].to_numpy(float) == pytest.approx(want[c].to_numpy(float), nan_ok=True, abs=1e-8)
        else:
            assert (got[c] == want[c]).all(), c
    return got


def test_sql_twin_on_hot_copies_gibberish_and_other_languages(spark, tmp_path):
    """One operator: the query, its SQL and the pipeline stage agree where the clauses and references matter."""
    rng = random.Random(23)
    gibberish = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 7))) + "q" for _ in range(n))
    numbers = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    hot = numbers(300)
    rows = [(i, _prose(60 + 5 * i, "en", i), "en") for i in range(60)] + [(100 + i, _prose(80 + 5 * i, "fr", 500 + i), "fr") for i in range(40)]
    rows += [(200 + i, hot, "en") for i in range(120)] + [(400, numbers(20_000), "en")]
    junk = [(500, gibberish(120), "en"), (501, gibberish(600), "fr"), (502, _prose(300, "fr", 9), "en"), (503, numbers(15), "en"), (504, gibberish(30), "en")]
    other = [(600 + i, "".join(rng.choice("的一是在不了有和人这") + (" " if k % 3 == 2 else "") for k in range(400)), "zh") for i in range(20)]
    other += [(700, _prose(200, "en", 77), None), (701, None, "en"), (702, "", None), (703, gibberish(200), None)]
    spark.createDataFrame(rows + junk + other, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = _rows_of_both(spark, tmp_path)
    assert got.loc[:59].kept.all() and got.loc[100:139].kept.all()          # copies move no reference
    assert not got.loc[200:400].kept.any() and not got.loc[500:502].kept.any() and not got.loc[703].kept
    assert got.loc[600:619].kept.all() and got.loc[700].kept                # no reference, no verdict
    assert got.loc[503:504].kept.all()                                      # too short for a verdict
    stage = {r.doc_id for r in qr.drop_low_quality(spark.read.parquet(str(tmp_path / "documents.parquet"))).select("doc_id").collect()}
    assert stage == set(got.index[got.kept])


def test_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "some words " * 12, "en", "own")], "doc_id long, text string, lang string, q string")
    out = qr.with_quality(df)
    assert out.columns == ["doc_id", "text", "lang", "q", "q_"] and out.first().q == "own"


def _prose(n, lang, seed):
    """Words of which a third are the common words of ``lang``, the others of letters that all texts share."""
    rng = random.Random(seed)
    return " ".join(rng.choice(qr.COMMON_WORDS[lang]) if rng.random() < 0.33 else "".join(rng.choices("etaoinshrdlu", k=rng.randint(4, 8)))
                    for _ in range(n))


def _with_prose(spark, odd):
    rows = [(i, _prose(60 + 5 * i, "en", i), "en") for i in range(60)] + [(1000 + i, t, "en") for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return {r.doc_id: r.q for r in qr.with_quality(df).collect()}


def test_words_alone_reject(spark):
    """Plain-letter gibberish and a text in another language than its label go; a half-and-half mixture stays."""
    rng = random.Random(7)
    gibberish = [" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 7))) + "q" for _ in range(n)) for n in (120, 400, 2000)]
    half = [_prose(n // 2, "en", n) + " " + gibberish[1][:3 * n] for n in (120, 400)]
    got = _with_prose(spark, [*gibberish, _prose(120, "fr", 1), _prose(800, "fr", 2), *half])
    assert all(got[i].kept for i in range(60))
    for i in range(1000, 1005):
        assert got[i].char_distance < 0.17 and not got[i].base_failed and not got[i].kept
    assert got[1005].kept and got[1006].kept


def test_copies_and_long_texts_move_no_reference(spark):
    """A hot group of copies and one very long number table: clean texts stay, the junk goes."""
    rng = random.Random(11)
    numbers = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    hot = numbers(300)
    clean = [(i, _prose(60 + 5 * i, "en", i), "en") for i in range(60)]
    junk = [(1000 + i, hot, "en") for i in range(60)] + [(2000, numbers(20_000), "en"), (2001, "the of and to " * 5_000, "en")]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    assert {r.doc_id for r in qr.drop_low_quality(df).collect()} == {r[0] for r in clean}
    alone = {r.doc_id: r.q.char_distance for r in qr.with_quality(df.where("doc_id < 1000")).collect()}
    assert {r.doc_id: r.q.char_distance for r in qr.with_quality(df).where("doc_id < 1000").collect()} == alone
