import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from txnwatch.llm import sentencepiece_codec as sc

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def _texts():
    rng = random.Random(8)
    sets = ["ab ", "the inger oun", "  \n\t", "éèçß ü", "中文字日本 ", "🙂①\x00€ ", "0123.,-", "▁x <s>", "a"]
    out = ["", " ", "  Hello  world \n", "<s>a</s><unk>", "▁▁", "a ▁b"]
    for _ in range(800):
        a = rng.choice(sets) + rng.choice(sets)
        out.append("".join(rng.choice(a) for _ in range(rng.randrange(1, 60))))
    return out + ["a" * 5000, " " * 4000, "ab" * 3000, "lorem" * 1000, "中" * 3000]


def test_ids_equal_the_library(library):
    texts = _texts()
    got = sc.encode_texts(sc.load(PATH), texts)
    for t, g, w in zip(texts, got, library.encode(texts)):
        assert g.tolist() == w, t[:50]


def test_streaming_gives_the_same_ids_in_a_small_window(library):
    model = sc.load(PATH)
    for t in _texts():
        v, got, s = sc.StreamingViterbi(model, every=7), [], model.symbols(t)
        for k in range(0, len(s), 5):
            got += v.feed(s[k:k + 5])
        assert got + v.finish() == library.encode(t)
    v = sc.StreamingViterbi(model)
    v.feed(model.symbols("some words and others " * 2000))
    assert v.most <= 64 + 2 * model.longest


def _best(model, s):
    """Highest sum of scores over all segmentations, by the whole-text recursion."""
    best = [0.0] + [-np.inf] * len(s)
    for j in range(1, len(s) + 1):
        for k in range(1, min(j, model.longest) + 1):
            score = model.scores.get(s[j - k:j], model.lowest if k == 1 else -np.inf)
            best[j] = max(best[j], best[j - k] + score)
    return best[-1]


def test_unigram_models_maximise_the_score():
    rng = random.Random(1)
    pieces = ["<unk>", "▁", "a", "b", *{"".join(rng.choice("ab▁") for _ in range(rng.randrange(2, 6))) for _ in range(40)}]
    model = sc.PieceModel.of(pieces, [0.0] + [-rng.random() * 9 - 1 for _ in pieces[1:]])
    for _ in range(300):
        t = "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 200)))
        ids = sc.encode_texts(model, [t])[0].tolist()
        assert model.decode(ids).replace(" ⁇ ", "c") == t or "c" in t
        s = model.symbols(t)
        got = sum(model.scores[pieces[i]] if i else model.lowest for i in ids)
        assert got == pytest.approx(_best(model, s))


def test_decode_equals_the_library(library):
    rng, model = random.Random(6), sc.load(PATH)
    for _ in range(400):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(1, 12))]
        assert model.decode(ids) == library.decode(ids), ids


def test_tables(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "same", None), (3, "same", None), (4, "é中" * 20_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    ids = sc.encode(df, PATH)
    got = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in ids.collect()), key=str)
    assert got == sorted(((i, library.encode(t or "")) for i, t, _ in rows), key=str)
    assert sorted((r.decoded for r in sc.decode(ids, PATH).collect())) == sorted(t or "" for _, t, _ in rows)
    assert sc.encode(df.where("doc_id > 9"), PATH).count() == 0


def test_documents(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(sf + "/documents.parquet").collect()}
    for r in sc.op2_sentencepiece(spark, sf).collect():
        want = np.array(library.encode(docs[r.doc_id]), "<u4")
        assert (r.n_pieces, r.ids_crc32, r.round_trip) == (len(want), zlib.crc32(want.tobytes()), True)
