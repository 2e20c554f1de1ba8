"""Encoding and decoding with word-end BPE files through a lexicon automaton.

The words of all documents are counted; the most frequent ones (at most ``words``, a
documented bound on the model, not on the result) are merged once and compiled into a minimal
acyclic transducer from bytes to ids (``lexicon``).  Its array is stored in the shared
folder and handed out as a Spark file; every executor maps its copy into memory, so
the Python workers of a machine share it.  A word that the lexicon does not hold is
merged exactly, whatever its length.

A text is cut at the special strings of the file; each part is normalised (NFC, blanks,
lower case) and cut into words.  Characters are lower-cased and classed as the library
itself does, asked once per character; a part that is not in NFC, or holds a character
on whose class the two sides disagree, goes through the library's own steps.

Null text is empty and has no ids; a null id stays null; repeated rows are encoded each
for itself.  Decoding joins the tokens of the ids with a space, as the library does for
a file without a decoder; null ids decode to null.  An empty table gives no rows.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.llm.byte_bpe import _byte_of_char
from txnwatch.llm.common import Memory, python_ready, table, written
from txnwatch.llm.lexicon import Lexicon, build, ragged
from txnwatch.session import work_dir

WORDS = 50_000            # words in the lexicon (at most; a bound on its size)
LOOSE = 1 << 20           # characters that are encoded together
SEEN = 1 << 19            # words whose ids a worker remembers
SHORT = 32                # symbols of a word up to which looking through all pairs beats a heap

# Fixed value: the published word pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same on lower-case texts of ASCII and of Latin-1, whose classes are settled.
_ASCII = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_LATIN = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Lower(dict):
    """Lower case by code point, learnt from the library character by character; ``odd`` collects
    the characters that the two pattern engines would class differently."""

    def __init__(self, normalise, kind):
        super().__init__()
        self.normalise, self.kind, self.odd = normalise, kind, set()

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        low = self.normalise(c)
        if any(self.kind(x) != _kind(x) for x in low):
            self.odd.update(low)
        self[cp] = low
        return low


def _kind(c: str) -> str:
    import regex

    return "L" if regex.match(r"\p{L}", c) else "N" if regex.match(r"\p{N}", c) else "S" if regex.match(r"\s", c) else "O"


class WordBpe:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, normalisers = spec["model"], [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"]
        if (model["type"], normalisers, [s["type"] for s in split], spec["decoder"], model.get("dropout"), model.get("ignore_merges")) != (
                "BPE", ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], None, None, False) \
                or split[0]["pattern"] != {"Regex": PATTERN} or split[1]["add_prefix_space"] or split[1]["use_regex"]:
            raise ValueError(f"{path} is not a word-end BPE file of the expected kind")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens with options")
        library = Tokenizer.from_file(path)
        self._normalise, self._pre = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        self._words = regex.compile(PATTERN)
        self._lower = _Lower(self._normalise, self._library_kind)
        self._char_of = {b: c for c, b in _byte_of_char().items()}
        self._byte_of = _byte_of_char()
        suffix = model["end_of_word_suffix"]
        vocab = model["vocab"]
        self.inner = [vocab[self._char_of[b]] for b in range(256)]
        self.last = [vocab[self._char_of[b] + suffix] for b in range(256)]
        self.merges = {}
        for rank, m in enumerate(model["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.by_id = np.full(max([*vocab.values(), *self.added.values()]) + 1, "", object)      # tokens
        for t, i in [*vocab.items(), *self.added.items()]:
            self.by_id[i] = t

    def _library_kind(self, c: str) -> str:
        if not self._pre(c):
            return "S"
        return "L" if len(self._pre("a" + c)) == 1 else "O" if len(self._pre("!" + c)) == 1 else "N"

    def _part(self, text: str) -> list[str]:
        if text.isascii():
            return _ASCII.findall(text.lower())
        if _latin(text):
            return _LATIN.findall(text.lower())
        if unicodedata.is_normalized("NFC", text):
            low = text.translate(self._lower)
            if not self._lower.odd or self._lower.odd.isdisjoint(low):
                return self._words.findall(low)
        return [bytes(self._byte_of[c] for c in w).decode() for w, _ in self._pre(self._normalise(text))]

    def words(self, text: str | None) -> list[str]:
        """The words of a text; special strings stand among them behind a blank, which no word holds."""
        if not text:
            return []
        if not any(t in text for t in self.added):
            return self._part(text)
        out: list = []
        for k, part in enumerate(self._added.split(text)):
            out += [" " + part] if k % 2 else self._part(part)
        return out

    def ids(self, word: str) -> tuple:
        """Ids of one of ``words``."""
        return (self.added[word[1:]],) if word[0] == " " else self.merge(word)

    def merge(self, word: str) -> tuple:
        """Ids of a word by its merges: lowest rank first, of equal ranks the leftmost."""
        data = word.encode()
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def _merge_short(self, ids: list) -> tuple:
        """All pairs' merges side by side, looked through for every merge."""
        found, never = self.merges.get, (len(self.merges), -1)
        pairs = [found(p, never) for p in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best is never:
                break
            k = pairs.index(best)
            ids[k:k + 2] = [best[1]]
            del pairs[k]
            if k:
                pairs[k - 1] = found((ids[k - 1], ids[k]), never)
            if k < len(pairs):
                pairs[k] = found((ids[k], ids[k + 1]), never)
        return tuple(ids)

    def _merge_long(self, ids: list) -> tuple:
        """The same with a heap of merges, n log n."""
        n = len(ids)
        before, after, heap = list(range(-1, n - 1)), list(range(1, n + 1)), []
        for k in range(n - 1):
            m = self.merges.get((ids[k], ids[k + 1]))
            if m:
                heap.append((m[0], k, m[1]))
        heapq.heapify(heap)
        while heap:
            rank, k, made = heapq.heappop(heap)
            r = after[k]
            if ids[k] < 0 or r >= n or self.merges.get((ids[k], ids[r])) != (rank, made):
                continue                                   # one of the two is gone or has grown
            ids[k], ids[r] = made, -1
            after[k] = after[r]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (m := self.merges.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (m[0], a, m[1]))
        return tuple(i for i in ids if i >= 0)


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


@functools.lru_cache(maxsize=2)
def _mapped(name: str) -> Lexicon:
    """The lexicon handed out as Spark file ``name``, mapped into memory."""
    return Lexicon(np.load(SparkFiles.get(name), mmap_mode="r"))


@functools.lru_cache(maxsize=1)
def _seen(path: str) -> Memory:
    """The words that this worker has met, in all its tasks."""
    return Memory(SEEN)


def encode_texts(bpe: WordBpe, lexicon: Lexicon, texts: list, memory: Memory | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of every text, and the ids of all texts in turn; ``memory`` keeps the words met so far."""
    memory = Memory() if memory is None else memory
    split = [bpe.words(t) for t in texts]
    code, new = memory.codes(split)
    per_text = np.zeros(len(texts), np.int64)
    if not len(code):
        return per_text, np.zeros(0, np.int64)
    if new:
        before = len(memory["ids"]) if memory.columns else 0
        held, sizes, ids = lexicon.lookup([w.encode() for w in new])
        starts = np.cumsum(sizes) - sizes
        more: list = []
        for k in np.flatnonzero(~held).tolist():
            found = bpe.ids(new[k])
            starts[k], sizes[k] = len(ids) + len(more), len(found)
            more += found
        memory.add(start=starts + before, size=sizes, ids=np.concatenate([ids, np.array(more, np.int64)]))
    starts, sizes, ids = memory["start"], memory["size"], memory["ids"]
    np.add.at(per_text, np.repeat(np.arange(len(texts)), [len(s) for s in split]), sizes[code])
    return per_text, ids[ragged(starts[code], sizes[code])]


def _slices(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` (characters or ids) each; a longer row stays alone."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(column) if pa.types.is_string(column.type) else pc.list_value_length(column), 0).to_pylist()
    begin = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > size:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    for b in batches:
        for i, j in _slices(b.column(0), LOOSE):
            seen: Counter = Counter()
            for t in b.column(0).slice(i, j - i).to_pylist():
                seen.update(bpe.words(t))
            rows = [(w, n) for w, n in seen.items() if w[0] != " "]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])


def frequent_words(df: DataFrame, path: str, text: str = "text", words: int = WORDS) -> list[str]:
    """The most frequent words of all texts, at most ``words``: those above the least count (in
    steps of an eighth of a power of two) that no more than ``words`` words reach."""
    python_ready(df.sparkSession)
    counts = df.select(F.col(text).cast("string").alias("text")).mapInArrow(lambda it: _counted(it, path), "word string, n long")
    counts = written(counts.groupBy("word").agg(F.floor(8 * F.log2(F.sum("n"))).alias("step")).where(F.col("step") > 0), "lexicon-words")
    total, least = 0, None
    for r in counts.groupBy("step").count().orderBy(F.desc("step")).collect():     # at most 8 x 63 rows
        total += r["count"]
        if total > words:
            break
        least = r["step"]
    return [] if least is None else [r["word"] for r in counts.where(F.col("step") >= least).select("word").collect()]


def ship_lexicon(spark: SparkSession, flat: np.ndarray) -> str:
    """Store the automaton in the shared folder and hand it out; returns its Spark file name."""
    import io

    data = io.BytesIO()
    np.save(data, flat)
    name = f"lexicon-{uuid.uuid4().hex}.npy"
    where = f"{work_dir(spark, 'lexicon')}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(data.getvalue())
    finally:
        out.close()
    spark.sparkContext.addFile(where)
    return name


def compile_lexicon(df: DataFrame, path: str, text: str = "text", words: int = WORDS) -> str:
    """Count, merge and compile the frequent words of ``df``; returns the Spark file name."""
    bpe = load(path)
    return ship_lexicon(df.sparkSession, build({w.encode(): bpe.merge(w) for w in frequent_words(df, path, text, words)}))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, name: str) -> Iterator[pa.RecordBatch]:
    bpe, lexicon, memory = load(path), _mapped(name), _seen(path)
    for b in batches:
        for i, j in _slices(b.column(1), LOOSE):
            n, ids = encode_texts(bpe, lexicon, b.column(1).slice(i, j - i).to_pylist(), memory)
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), ids], ["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokens = load(path).by_id
    for b in batches:
        for i, j in _slices(b.column(1), LOOSE):
            own = b.column(1).slice(i, j - i)
            words = tokens[own.flatten().to_numpy(zero_copy_only=False)] if len(own.flatten()) else tokens[:0]
            sizes = own.value_lengths().to_pylist()
            ends = np.cumsum([n or 0 for n in sizes]).tolist()
            text = [None if n is None else " ".join(words[end - n:end].tolist()) for n, end in zip(sizes, ends)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), own, pa.array(text, pa.string())], ["doc_id", "ids", "decoded"])


def encode(df: DataFrame, path: str, lexicon: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids of every row; ``lexicon`` is a Spark file of ``compile_lexicon`` (by default that of ``df``)."""
    python_ready(df.sparkSession)
    name = lexicon or compile_lexicon(df, path, text)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _encoded(it, path, name), "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the decoded text of rows (doc_id, ids)."""
    python_ready(df.sparkSession)
    return df.select("doc_id", "ids").mapInArrow(lambda it: _decoded(it, path), "doc_id long, ids array<int>, decoded string")


def round_trip(df: DataFrame, path: str, lexicon: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``decode(encode(df))`` in one Python worker a task: doc_id, ids and the decoded text of every row."""
    python_ready(df.sparkSession)
    name = lexicon or compile_lexicon(df, path, text)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _decoded(_encoded(it, path, name), path), "doc_id long, ids array<int>, decoded string")


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    out = round_trip(table(spark, sf_dir, "documents"), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
