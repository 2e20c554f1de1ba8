import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from txnwatch.llm import packing as pk

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", "a", "word " * 3000, "<|endoftext|>x <|endof", "é中🙂 \n\n x", "same", "same", "y" * 40_000, " x", "x ", "  ", " ",
         " " * 2_000_000 + "a", "b" + "\n" * 2_000_000 + "c", "d \t" + "\u3000" * 50_000 + "e"]


def _check(rows, texts_by_id, context=1024):
    library = Tokenizer.from_file(PATH)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(texts_by_id)
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 for r in rows)
    for doc, text in texts_by_id.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and 0 < r.length <= context
            assert r.length & (r.length - 1) == 0                       # never padded
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_cut():
    for n in range(1, 5000):
        sizes = pk.cut(n)
        assert sum(sizes) == n and sizes == sorted(sizes, reverse=True)
        assert len([s for s in sizes if s < 1024]) == (n % 1024).bit_count()


def test_pieces(spark, tmp_path):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, start string")
    _check(pk.packed_digests(df).collect(), dict(enumerate(TEXTS)))
    assert pk.packed_digests(df.where("doc_id < 0")).count() == 0
    assert pk.packed_digests(df.selectExpr("cast(null as long) doc_id", "text")).count() > len(TEXTS)
    pk.write_buckets(pk.pack(df, PATH, context=64), str(tmp_path / "b"))
    got = spark.read.parquet(str(tmp_path / "b"))
    assert got.where("bucket <> length or length > 64").count() == 0
    with pytest.raises(ValueError):
        pk.pack(df, PATH, context=1000)


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(sf + "/documents.parquet").collect()}
    _check(pk.op6_packing(spark, sf).collect(), docs)


def test_ids_equal_the_library_on_odd_text():
    rng = random.Random(2)
    library, enc = Tokenizer.from_file(PATH), pk.load(PATH)
    assert enc.cuts
    marks = ["'s", "'re", "'", " ", "  ", "\n", "\t", "\xa0", "\u2003", "\u0085", "\x1c", "é", "é", "中", "🙂", "½", "١", "a", "B", "0", "_", "<|endoftext|>"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(40))) for _ in range(4000)] + [None]
    sizes, ids = enc.encode(texts)
    at = 0
    for t, n in zip(texts, sizes.tolist()):
        assert ids[at:at + n].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)
        at += n
    assert at == len(ids)


def test_a_worker_stays_small():
    # bytes that a worker keeps for a compiled transition, and what is left of them once they are dropped
    import subprocess
    import sys

    code = """if True:
        import random, tracemalloc
        from txnwatch.llm import packing as pk
        encoder = pk.Encoder(%r)
        rng = random.Random(3)
        words = [" " + "".join(rng.choice("etaoinshrdlu") for _ in range(6)) for _ in range(40_000)]
        tracemalloc.start()
        encoder._by_rules(words)
        machine = encoder.rules.machine
        size, kept = machine.n, tracemalloc.get_traced_memory()[0]
        machine.max_transitions = 0
        machine.make_room()
        print(kept / size, tracemalloc.get_traced_memory()[0] / kept)
    """ % PATH
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300).stdout
    kept, left = map(float, out.split())
    assert kept < 400 and left < 0.5


def test_a_task_without_rows():
    from txnwatch.llm import language_id

    assert list(pk._pieces(iter([]), PATH, 1024, 0)) == []
    assert list(language_id._expected(iter([]), public_tokenizers.path("piece_bpe_32k.model"))) == []
