import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from conftest import SF001
from txnwatch.llm import alignment, queries
from txnwatch.llm.byte_bpe import _byte_of_char
from txnwatch.llm.common import table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

ODD = [None, "", " ", "   \n\n  x", "hello  wörld 日本𓀀\n x", "a▁b", "a<|endoftext|>b </s> <s><0x41>", "\x00\x1c a", "😀😀 👨‍👩‍👧 é́", "tab\t tab \r\n nbsp\xa0 x",
       "x" * 5000, " " * 3000 + "y", "漢字かな交じり文" * 300, "don't we'll 123 4567 ;\r );\r\n", "  ﬁ ", "a  b   c    d\n\n\ne", "  　 z", "hello hello hello"]


class Plain:
    """Whole texts, byte by byte."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.byte = _byte_of_char()

    def tokens(self, text):
        if not text:
            return [], []
        e = self.a.encode(" " + text, add_special_tokens=False)
        ta = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in e.ids]
        tb = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            tb.append((i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        if {b"".join(x for _, x in ta), b"".join(x for _, x in tb)} != {(" " + text).encode()}:
            return [], []
        return ta, tb

    def align(self, text):
        ta, tb = self.tokens(text)
        spans = []
        for side in (ta, tb):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low < e <= c) for side in spans))
            low = c
        links, k = [], 0
        for i, s, e in spans[0]:
            while k < len(spans[1]) and spans[1][k][2] <= s:
                k += 1
            m = k
            while m < len(spans[1]) and spans[1][m][1] < e:
                links.append((i, spans[1][m][0]))
                m += 1
        return len(ta), len(tb), groups, links

    def rows(self, docs):
        done = [(i, *self.align(t)) for i, t in docs]
        count = Counter(p for *_, links in done for p in set(links))
        top = defaultdict(int)
        for (a, b), n in count.items():
            top[a] = max(top[a], n)
        return sorted(((i, na, nb, len(g), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links),
                        hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, na, nb, g, links in done), key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_is_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF001, "documents").collect()]
    docs = [(i, t) for i, t in docs]
    assert _rows(queries.QUERIES["op11_token_alignment"](spark, SF001)) == Plain().rows(docs)


def test_odd_texts_groups_and_links():
    pair, plain = alignment.load(A, B), Plain()
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab \n\té日😀▁;\r'") for _ in range(60)) for _ in range(400)] \
        + ["".join(rng.choice(["the ", "naïve", " ", "\n", "42", "東京", "\U0001f600", "...", "\r\n"]) for _ in range(40)) for _ in range(200)]
    assert pair.cuts
    n_a, n_b, n_groups, n_links, groups, la, lb, ln = (c.to_pylist() for c in alignment.align_texts(pair, texts))
    for k, t in enumerate(texts):
        a, b, g, links = plain.align(t)
        assert (n_a[k], n_b[k], n_groups[k], n_links[k], groups[k]) == (a, b, len(g), len(links), ";".join(g)), repr(t)[:60]
        assert dict(zip(zip(la[k], lb[k]), ln[k])) == Counter(links)


def test_refine_counts_on_by_bytes():
    import numpy as np

    # " a", then a four-byte character whose three tokens report it whole, then "b"
    begin, end, size = np.array([0, 2, 2, 2, 6]), np.array([2, 6, 6, 6, 7]), np.array([2, 1, 2, 1, 1])
    assert alignment.refine(begin, end, size).tolist() == [2, 3, 5, 6, 7]
    # byte pieces: empty spans, then the whole character
    assert alignment.refine(np.array([0, 1, 1, 1]), np.array([1, 1, 1, 4]), np.array([1, 1, 1, 1])).tolist() == [1, 2, 3, 4]


def test_odd_tables(spark):
    rows = [(k, t, 1) for k, t in enumerate(ODD)] + [(None, "hello there", 1), (4, ODD[4], 1), (4, ODD[4], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int")
    want = Plain().rows([(i, t) for i, t, _ in rows])
    for head in (1, 40, alignment.HEAD):
        out = alignment.with_scores(alignment.align(df, A, B), head)
        from pyspark.sql import functions as F
        digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
        assert _rows(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)) == want
    assert alignment.with_scores(alignment.align(df.limit(0), A, B)).count() == 0
