import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from txnwatch.llm import byte_bpe
from txnwatch.llm.token_counts import count_texts, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABETS = ["ab '", " \n\t x", "'strevlmd !", "éèç àüß", "0123456789-.", "中文日本語の", "🙂👍🏽éж",
             "<|endoftext|> ", "thinger ou.,", "\u0085 ᠎​ ﻿", "a"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _texts():
    rng = random.Random(11)
    out = ["", "'re's'll'x'r'v'l'", "a's b'S 's''s", "x<|endoftext|>y <|endoftext|><|endoftext|>", "\n\n x  y \n", "<|endoftext|"]
    for _ in range(1500):
        a = rng.choice(ALPHABETS) + (rng.choice(ALPHABETS) if rng.random() < .5 else "")
        out.append("".join(rng.choice(a) for _ in range(rng.randrange(1, 60))))
    return out + ["a" * 5000, " " * 3000 + "x", "ab" * 4000, "é" * 3000, "thinger" * 900, "".join(rng.choice("acgt") for _ in range(20_000))]


@pytest.mark.parametrize("width", [7, 64, 1024])
def test_counts_equal_the_library(library, width):
    texts = _texts()
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert count_texts(texts, byte_bpe.load(PATH), width).tolist() == want


def test_machine_is_dropped_when_full(library):
    bpe = byte_bpe.ByteBpe(PATH)
    bpe.machine.max_transitions = 50
    texts = _texts()[:200]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = np.concatenate([count_texts(texts[i:i + 20], bpe) for i in range(0, 200, 20)])
    assert got.tolist() == want


def test_table(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "word " * 600, None), (3, "word " * 600, None), (4, "é" * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = [tuple(r) for r in token_counts(df, PATH).collect()]
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
    assert sorted(got, key=str) == sorted([(*w, w[2] > 512) for w in want], key=str)
    assert token_counts(df.where("doc_id > 9"), PATH).count() == 0


def test_documents(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts(df, PATH).collect()}
    rows = df.collect()
    want = library.encode_batch([r.text for r in rows], add_special_tokens=False)
    assert got == {r.doc_id: len(e.ids) for r, e in zip(rows, want)}


def test_large_ids_beside_nulls_stay_exact(spark):
    big = 2**62 + 1
    df = spark.createDataFrame([(big, "a"), (None, "b"), (-big, "c")], "doc_id long, text string")
    assert {r.doc_id for r in token_counts(df, PATH).collect()} == {big, None, -big}
