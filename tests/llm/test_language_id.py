import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from txnwatch.llm import language_id as li

PATH = public_tokenizers.path("piece_bpe_32k.model")


def _segmentations(word, vocab_of):
    """Every cut of a word into pieces (or single unknown characters)."""
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        p = word[:n]
        if p in vocab_of or (n == 1 and p not in vocab_of):
            for rest in _segmentations(word[n:], vocab_of):
                yield (p, *rest)


@pytest.fixture(scope="module")
def vocab_of():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}


WORDS = ["the", "a", "thinger", "été", "漢字x", "\U0001f642", "▁b", "abc▁", "zzzzzz", "Über"]


def test_forward_sums_all_segmentations(vocab_of):
    rng = np.random.default_rng(0)
    table = li.pieces(PATH)
    probs = rng.random((table.size, 3)) * 1e-3
    got = li.WordLattice(WORDS, table).forward(probs)
    for w, row in zip(WORDS, got):
        want = sum(np.prod([probs[vocab_of[p]] if p in vocab_of else np.full(3, li.UNKNOWN) for p in seg], axis=0)
                   for seg in _segmentations("▁" + w, vocab_of))
        assert row == pytest.approx(np.log(want), rel=1e-9)


def test_expected_counts(vocab_of):
    table, u = li.pieces(PATH), 1 / li.pieces(PATH).size
    weights = np.arange(1, 2 * len(WORDS) + 1, dtype=float).reshape(-1, 2)
    got = li.WordLattice(WORDS, table).expected_counts(weights, u)
    want = np.zeros_like(got)
    for w, weight in zip(WORDS, weights):
        segs = list(_segmentations("▁" + w, vocab_of))
        mass = np.array([np.prod([u if p in vocab_of else li.UNKNOWN for p in s]) for s in segs])
        for s, m in zip(segs, mass / mass.sum()):
            for p in s:
                if p in vocab_of:
                    want[vocab_of[p]] += m * weight
    assert np.allclose(got, want)


def test_long_word_stays_in_range():
    table = li.pieces(PATH)
    probs = np.full((table.size, 2), 1e-5)
    x = li.WordLattice(["ab" * 2_000, "x"], table).forward(probs)
    assert np.isfinite(x).all() and x[0, 0] < -1000


def test_edge_rows(spark):
    text = {"en": "the cat and the house of the water that is here", "fr": "le chat et la maison de la mer qui est dans le jardin"}
    rows = [(i, t, g, "x") for i, (g, t) in enumerate(itertools.islice(itertools.cycle(text.items()), 12))]
    rows += [(50, None, "en", "x"), (51, "", None, "x"), (52, "12 34 !!", "fr", None), (None, "the house", None, "x"), (53, "w" * 3_000, "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = li.fit(df, PATH, train_rows=None)
    got = {r.doc_id: (r.p, r.score) for r in li.predict(df, model, out="p").collect()}
    assert got[0][0] == "en" and got[1][0] == "fr" and got[None][0] == "en"
    assert {got[k] for k in (50, 51, 52)} == {("und", 0.0)}
    assert li.drop_undetermined(df).columns == df.columns
    kept = li.drop_undetermined(df.withColumn("lang", F.lit(None).cast("string"))).select("doc_id").collect()
    assert {r.doc_id for r in kept} == {None, 53, *range(12)}
    empty = df.where("doc_id > 99")
    nothing = li.fit(empty, PATH)
    assert nothing.languages == [] and li.predict(empty, nothing, out="p").count() == 0
    assert {r.p for r in li.predict(df, nothing, out="p").collect()} == {"und"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = li.op7_language_id(spark, sf).toPandas().merge(spark.read.parquet(sf + "/documents.parquet").toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert len(got) == 1000 and got.score.between(0, 1).all()
    print("held-out accuracy", (held.lang_pred == held.lang).mean())
    assert (held.lang_pred == held.lang).mean() > 0.97


def test_words_are_scored_some_at_a_time(monkeypatch):
    import numpy as np
    import public_tokenizers

    from txnwatch.llm import language_id as li

    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = np.random.default_rng(5)
    probs = rng.random((li.pieces(path).size, 3))
    model = li.LanguageModel(["a", "b", "c"], np.full(3, 1 / 3), probs / probs.sum(axis=0), path)
    texts = [" ".join("".join(map(chr, rng.integers(97, 123, rng.integers(1, 30)))) for _ in range(20)) for _ in range(40)]
    expected = model.classify(texts)
    most, init = [], li.WordLattice.__init__
    monkeypatch.setattr(li.WordLattice, "__init__", lambda self, words, vocab: (most.append(len(words)), init(self, words, vocab))[1])
    monkeypatch.setattr(li, "WORDS_AT_ONCE", 50)
    got = model.classify(texts)
    assert got[0] == expected[0] and (got[1] == expected[1]).all()
    assert len(most) > 10 and max(most) == 50
