import random
import re
import zlib
from collections import Counter, defaultdict

from conftest import SF001
from txnwatch.llm import queries, spelling
from txnwatch.llm.common import table

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def counts(docs):
    seen = Counter()
    for doc_id, text in docs:
        for run in map(lower, RUN.findall(text or "")):
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def brute(words):
    """Rows by deletion neighbourhoods: two words are near if they share a word with one letter out, or one is that of the other."""
    holes = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            holes[w[:k], w[k + 1:]].add(w)
    out = {}
    near = {}
    for w in words:
        found = set()
        for k in range(len(w)):
            found |= holes[w[:k], w[k + 1:]]
            found.add(w[:k] + w[k + 1:])
        near[w] = {v for v in found if v in words and v != w}
    for w in words:                                    # insertions are the deletions of the other
        for v in near[w]:
            near[v].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def rows(df):
    got = df.collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def test_query_is_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF001, "documents").collect()]
    want = brute(counts(docs))
    assert rows(queries.QUERIES["op13_spelling_variants"](spark, SF001)) == want
    assert any(v[0] for v in want.values())


def test_words_of_odd_documents(spark):
    docs = [(k, "Ünïted ünïted UNITED x÷y×zÀÿ straße " * 3) for k in range(200)]
    docs += [(None, "nullid nullid nullid nullid nullid"), (7, None), (8, ""), (9, "short"), (9, "short"), (3, "a" * 30_000 + " " + "\n".join(["repeated"] * 5))]
    docs += [(10, "b" * 5000 + "c ")] * 5
    df = spark.createDataFrame([(i, t, "w") for i, t in docs], "doc_id long, text string, word string")
    got = {r.word: r.n for r in spelling.corpus_words(df).collect()}
    assert got == counts(docs)
    assert rows(spelling.variants(spelling.corpus_words(df))) == brute(counts(docs))
    assert spelling.variants(spelling.corpus_words(df.limit(0))).count() == 0


def test_random_dense_words(spark):
    rng = random.Random(11)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 8))): rng.randint(1, 400) for _ in range(2500)}
    got = rows(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute(words)


def test_chains_runs_and_salted_nodes(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARE", 7)
    rng = random.Random(12)
    words = {"prefixprefix" + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 4))): rng.randint(1, 9) for _ in range(1500)}
    words |= {"a" * k: 5 ** (k % 9) for k in range(6, 60)}
    words |= {"chainchain" + "z" * k: 6 ** k for k in range(8)}
    words |= {"q" * 3000: 10, "q" * 2999 + "r": 100, "q" * 3001: 1000}
    got = rows(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute(words)


def test_no_join_is_broadcast(spark, monkeypatch):
    """What Spark takes for a small table (compressed, or before an explode) must not pass through the driver."""
    plans, store = [], spelling.written
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(spelling, "written", lambda df, name: plans.append((name, plan(df))) or store(df, name))
    words = {"abcdefgh" + "x" * k: 6 ** k for k in range(4)}
    out = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    plans.append(("result", plan(out)))
    assert rows(out) == brute(words)
    assert sum(p.count("SortMergeJoin") for _, p in plans) >= 8
    assert not [name for name, p in plans if "Broadcast" in p]
