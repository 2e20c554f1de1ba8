"""Packing by power-of-two decomposition: no sequence crosses documents.

A document's ids (its tokens, then one end id) are cut into pieces of the context
length, then into pieces of the binary lengths of what is left, longest first.  Each
piece is a sequence of its own in the bucket of its length, a power of two, so
nothing is padded and batches take equal lengths from one bucket.  The cut needs the
document alone: no shuffle, and a long document makes many pieces, not a large group.

Ids are those of the ``tokenizers`` library, whatever the text (long runs of blanks
included).  Null text is empty: its only id is the end id.  Repeated rows are packed each for
itself; a null id stays null.  An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.llm import byte_bpe
from txnwatch.llm.common import BLANKS, Memory, give_back, one_thread, python_ready, stretches, table
from txnwatch.llm.lexicon import ragged
from txnwatch.llm.token_counts import runs
from txnwatch.llm.transducer import START, Lanes, cut_lanes

CONTEXT = 1024
END = 0
LONG = 4096                # characters of a stretch beyond which lanes would wait for it
TOGETHER = 1 << 20         # characters that are encoded together
LANE = 64                  # bytes of words that are encoded in turn
SEEN = 1 << 18             # stretches whose ids a worker remembers (about 200 bytes each)


class Encoder:
    """Ids of a byte-level file.  A text is cut into stretches from space to space, where its split pattern
    always cuts; a stretch is encoded when a worker first meets it, by the compiled merge rules
    (``byte_bpe``), or by the ``tokenizers`` library where it holds a special string or more than
    ``LONG`` characters (the library needs no lanes of equal length).  Both give the library's ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        one_thread()
        self.rules = byte_bpe.load(path)                 # raises unless the file is a plain byte-level BPE
        self.cuts = not any(set(t) & set(BLANKS) for t in self.rules.added)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.memory = Memory(SEEN)

    def _split(self, text: str | None) -> list[str]:
        if not text or not self.cuts:
            return [text] if text else []
        first, *rest = stretches(" " + text)
        return [first[1:], *rest] if len(first) > 1 else rest

    def _by_rules(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of every word, and the ids of all in turn."""
        machine = self.rules.machine
        machine.make_room()
        symbols, first = self.rules.symbols(words)
        states = np.zeros(len(symbols), np.int32)
        lanes = Lanes(symbols, *cut_lanes(symbols >= START, len(symbols), LANE))
        lanes.run(machine, states=states)
        at = np.flatnonzero(lanes.token_ends(machine, states))
        cut = np.searchsorted(at, np.r_[first, len(symbols)])
        return np.diff(cut), machine.last[states[at]]

    def _new(self, words: list[str]) -> None:
        """Encode words not met before."""
        odd = [k for k, w in enumerate(words) if len(w) > LONG or any(t in w for t in self.rules.added)]
        by_library = [np.array(e.ids, np.uint32) for e in self.library.encode_batch([words[k] for k in odd], add_special_tokens=False)]
        plain = np.ones(len(words), bool)
        plain[odd] = False
        sizes, starts, ids = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(0, np.uint32)
        if plain.any():
            sizes[plain], ids = self._by_rules([words[k] for k in np.flatnonzero(plain)])
        starts[plain] = np.cumsum(sizes[plain]) - sizes[plain]
        sizes[odd] = [len(x) for x in by_library]
        starts[odd] = len(ids) + np.cumsum(sizes[odd]) - sizes[odd]
        self.memory.add(size=sizes, ids=np.concatenate([ids.astype(np.uint32), *by_library])[ragged(starts, sizes)])

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of every text, and the ids of all texts in turn."""
        split = [self._split(t) for t in texts]
        code, new = self.memory.codes(split)
        if new:
            self._new(new)
        per_text = np.zeros(len(texts), np.int64)
        if not len(code):
            return per_text, np.zeros(0, np.uint32)
        sizes, flat = self.memory["size"], self.memory["ids"]
        np.add.at(per_text, np.repeat(np.arange(len(texts)), [len(s) for s in split]), sizes[code])
        return per_text, flat[ragged((np.cumsum(sizes) - sizes)[code], sizes[code])]


@functools.lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, context: int = CONTEXT) -> list[int]:
    """Lengths of the pieces of ``n`` ids."""
    rest = n % context
    return [context] * (n // context) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])


def _pieces(batches: Iterator[pa.RecordBatch], path: str, context: int, end: int) -> Iterator[pa.RecordBatch]:
    encoder = load(path)
    for b in batches:
        texts, docs = b.column("text"), b.column("doc_id")
        lengths = pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        for s in runs(lengths, TOGETHER):
            out: dict = {"doc_id": [], "start": [], "length": [], "ids": [], "doc_tokens": []}
            sizes, ids = encoder.encode(texts[s].to_pylist())
            ends = np.cumsum(sizes)
            for doc, own, last in zip(docs[s].to_pylist(), sizes.tolist(), ends.tolist()):
                data = np.append(ids[last - own:last], end).astype("<u4").tobytes()
                n, at = own + 1, 0
                for size in cut(n, context):
                    out["doc_id"].append(doc)
                    out["start"].append(at)
                    out["length"].append(size)
                    out["ids"].append(data[4 * at:4 * (at + size)])
                    out["doc_tokens"].append(n)
                    at += size
            yield pa.RecordBatch.from_pydict(out, _PIECES)
    b = texts = docs = None
    give_back()


def pack(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", context: int = CONTEXT,
         end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens,
    sequence_id and offset (always 0); ``length`` is the bucket.  ``context`` is a power of two."""
    if context & (context - 1) or context < 1:
        raise ValueError("context must be a power of two")
    python_ready(df.sparkSession)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = rows.mapInArrow(lambda it: _pieces(it, path, context, end),
                             "doc_id long, start long, length long, ids binary, doc_tokens long")
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences as Parquet, one folder per bucket of equal lengths."""
    packed.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)


def packed_digests(df: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(df, public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(table(spark, sf_dir, "documents"))
