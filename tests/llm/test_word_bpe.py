import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import SF001
from txnwatch.llm import queries, word_bpe
from txnwatch.llm.common import table
from txnwatch.llm.lexicon import Lexicon, build

PATH = public_tokenizers.path("word_bpe_49k.json")

ODD = [None, "", " ", "Hello World's  CAFÉ\n12", "a<|endoftext|>b <|startoftext|>", "ΑΣ ΟΔΟΣ İstanbul ﬁ ǅ", "éä ẛ̣",
       "日本語テキスト 😀!!", "\x00\x1c\x1fx\x85y\xa0z", "don't I'LL we'Ve 'Tis ''s", "x" * 20_000, "ab" * 10_000 + "é" * 5_000, "1234567890" * 500, "​ a　b",
       "ʼn ⅷ Ⅷ ² ½ ª º", "the the The THE", "!?" * 3000, "<|endoftext", "\U0001d400\U00010400", "ꭰ Ꭰ ჩ Ჩ"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_automaton_holds_exactly_its_entries():
    rng = random.Random(3)
    entries = {}
    for _ in range(3000):
        w = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 9)))
        entries[w] = tuple(rng.randint(0, 5) for _ in range(rng.randint(0, 4)))
    lex = Lexicon(build(entries))
    words = [*entries, *(bytes(rng.choice(b"abcde") for _ in range(rng.randint(0, 9))) for _ in range(3000)), b"", b"a" * 500]
    held, sizes, ids = lex.lookup(words)
    at = 0
    for w, h, n in zip(words, held.tolist(), sizes.tolist()):
        assert h == (w in entries)
        assert tuple(ids[at:at + n]) == entries.get(w, ())
        at += n
    assert at == len(ids)


def test_automaton_shares_suffixes():
    entries = {p + s: (k,) for k, p in enumerate([b"walk", b"talk", b"jump"]) for s in (b"", b"s", b"ed", b"ing")}
    lex = Lexicon(build(entries))
    assert len(lex.final) < sum(map(len, entries)) / 3
    assert not Lexicon(build({})).lookup([b"a", b""])[0].any()


def test_merge_is_the_library(library):
    bpe = word_bpe.load(PATH)
    lex = Lexicon(build({w.encode(): bpe.merge(w) for w in ("the", "hello", "café")}))
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("aAbé 's1²!\ńß漢<|>endoftext") for _ in range(200)) for _ in range(300)]
    n, ids = word_bpe.encode_texts(bpe, lex, texts)
    at = 0
    for t, k in zip(texts, n.tolist()):
        assert ids[at:at + k].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)[:80]
        at += k


def test_every_character_is_the_library(library):
    bpe = word_bpe.load(PATH)
    lex = Lexicon(build({}))
    chars = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c}{c}1{c}" for c in chars]
    n, ids = word_bpe.encode_texts(bpe, lex, texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def _expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), \
        hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_query_is_the_library(spark, library):
    rows = {r.doc_id: r for r in queries.QUERIES["op12_word_bpe"](spark, SF001).collect()}
    docs = table(spark, SF001, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        assert tuple(rows[d.doc_id])[1:] == _expected(library, d.text)


def test_odd_tables(spark, library):
    odd = [(k, t, "x") for k, t in enumerate(ODD)] + [(None, "Null id", "x"), (3, ODD[3], "x")]
    df = spark.createDataFrame(odd, "doc_id long, text string, ids string")      # a clashing extra column
    out = word_bpe.decode(word_bpe.encode(df, PATH), PATH).collect()
    assert len(out) == len(odd)
    by_id = {r.doc_id: r for r in out}
    for i, t, _ in odd:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert by_id[i].ids == ids and by_id[i].decoded == library.decode(ids, skip_special_tokens=False)
    assert sorted(map(str, word_bpe.round_trip(df, PATH).collect())) == sorted(map(str, out))
    assert word_bpe.encode(df.limit(0), PATH).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in word_bpe.decode(nulls, PATH).collect()} == {1: None, 2: ""}


def test_the_lexicon_is_mapped_and_only_speeds_up(spark):
    df = table(spark, SF001, "documents")
    name = word_bpe.compile_lexicon(df, PATH, words=50)
    lex = word_bpe._mapped(name)
    assert isinstance(lex.ids.base, np.memmap) or isinstance(lex.ids, np.memmap)
    small = {r.doc_id: r.ids for r in word_bpe.encode(df, PATH, name).collect()}
    full = {r.doc_id: r.ids for r in word_bpe.encode(df, PATH).collect()}
    assert small == full
