"""Alignment of two tokenizers over the same text by the spans they report.

A byte-level tokenizer (A, ``tokenizers``) reports character offsets, a piece tokenizer
(B, ``sentencepiece``) spans of its result message.  Both are coarse: the tokens of a
split character all report that whole character, and byte-fallback pieces report an
empty span or the whole character.  A token that shares its span is therefore placed by
its own decoded bytes, counted on from the last token that ends alone; where spans
do not overlap they are the cut.  Places where tokens of both end cut the text into
groups, and tokens whose byte ranges overlap are linked.

A blank after a character that is no blank starts a new token in both files (checked
for B when the file is loaded; it is the split pattern of A), so a text is aligned in
stretches from blank to blank; a worker aligns a stretch when it first meets it.

Definitions: A reads a space and the text, B the text (it adds the space itself).
Null and empty texts, and texts for which the tokens' bytes of A or B are not the space
and the text, have no tokens.  Repeated rows are documents of their own; a null id
stays null.  An empty table gives no rows.

Counts: an id pair counts the documents that hold it linked.  Pairs found in most
documents would meet in a few tasks, so the ``HEAD`` most frequent pairs (a fixed bound)
are broadcast, and only the links of the others, each in few documents, are shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.llm.byte_bpe import _byte_of_char
from txnwatch.llm.common import Memory, free_name, one_thread, python_ready, stretches, table, written
from txnwatch.llm.lexicon import ragged

HEAD = 1 << 16            # id pairs that are broadcast
LOOSE = 1 << 20           # characters that are aligned together
SEEN = 1 << 18            # stretches whose alignment a worker remembers (about 300 bytes each)
MARK = "▁"


@dataclass
class Tokens:
    """Tokens of stretches in turn: ids, byte ends (from the stretch's start), and how many each stretch has."""

    ids: np.ndarray
    ends: np.ndarray
    sizes: np.ndarray


def refine(begin: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from coarse byte spans and decoded sizes.

    A span is a cut where the token begins at the end of the one before it and takes as many
    bytes as it decodes to; the others are counted on from the last cut by their bytes."""
    if not len(size):
        return size
    alone = (end - begin == size) & (begin == np.r_[0, end[:-1]])
    total = np.cumsum(size)
    anchor = np.maximum.accumulate(np.where(alone, np.arange(len(size)), -1))
    return np.where(anchor >= 0, end[anchor] + total - total[anchor], total)


class Pair:
    """The two tokenizers and the decoded bytes of their entries."""

    def __init__(self, path_a: str, path_b: str):
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = _byte_of_char()
        decoded = {i: bytes(byte[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in byte for c in t)}
        self.bytes_a = [decoded.get(i, b"") for i in range(max(decoded) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self._signed = [f"{i}{sign}" for side in (self.bytes_a, self.bytes_b) for i in range(len(side)) for sign in (",", "|", ";", "\n")]
        self.memory = Memory(SEEN)
        #: Whether a blank after a character that is none starts a token in both.
        self.cuts = (split["type"], split.get("use_regex", True), split["add_prefix_space"], spec["normalizer"]) == ("ByteLevel", True, False, None) \
            and not any(MARK in p.lstrip(MARK) for p in pieces)

    def group_texts(self, ids_a, ids_b, group_a, group_b, n_groups) -> list[str]:
        """The groups of every stretch as text: A ids, a bar, B ids; groups parted by semicolons."""
        order = np.argsort(np.r_[2 * group_a, 2 * group_b + 1], kind="stable")
        last_a = np.r_[group_a[1:] != group_a[:-1], True] if len(group_a) else np.zeros(0, bool)
        last_b = np.r_[group_b[1:] != group_b[:-1], True] if len(group_b) else np.zeros(0, bool)
        ends = np.zeros(int(n_groups.sum()) + 1, bool)
        ends[(np.cumsum(n_groups) - 1)[n_groups > 0]] = True             # a stretch's last group
        mark_b = np.where(last_b, np.where(ends[group_b], 3, 2), 0)
        # a token's text with the sign after it, by id and sign
        codes = np.r_[4 * ids_a + last_a, 4 * (ids_b + len(self.bytes_a)) + mark_b][order]
        parts = iter("".join(map(self._signed.__getitem__, codes.tolist())).split("\n"))
        return [next(parts) if k else "" for k in n_groups.tolist()]

    def stretches(self, text: str) -> list[str]:
        out = stretches(" " + text) if self.cuts else [" " + text]
        if len(out) > 1 and out[-1] == " ":          # B adds no space to nothing
            out[-2:] = [out[-2] + out[-1]]
        return out

    def tokens(self, stretches: list[str]) -> tuple[Tokens, Tokens]:
        """The tokens of both.  Stretches are encoded as one text where the next one begins at a cut; one that
        ends with a blank (the end of a text) is encoded by itself."""
        runs, run = [], []
        for k, s in enumerate(stretches):
            run.append(k)
            if s[-1].isspace() or not self.cuts:
                runs.append(run)
                run = []
        runs += [run] if run else []
        a = [self._tokens_a([stretches[k] for k in own]) for own in runs]
        b = [self._tokens_b([stretches[k] for k in own]) for own in runs]
        return tuple(Tokens(*(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*[(t.ids, t.ends, t.sizes) for t in side]))) if side
                     else Tokens(*[np.zeros(0, np.int64)] * 3) for side in (a, b))

    def _tokens_a(self, run: list[str]) -> Tokens:
        text = "".join(run)
        e = self.a.encode(text, add_special_tokens=False)
        ids = np.array(e.ids, np.int64)
        spans = np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
        data = np.frombuffer(text.encode(), np.uint8)
        place = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]        # of every character
        return self._placed(ids, place[spans[:, 0]], place[spans[:, 1]], self.size_a, run)

    def _tokens_b(self, run: list[str]) -> Tokens:
        flat: list = []
        for p in self.b.encode("".join(run)[1:], return_type="proto", num_threads=1).pieces:
            flat += p.id, p.begin, p.end
        ids, begin, end = np.array(flat, np.int64).reshape(-1, 3).T
        # spans count bytes of the text; the space that B adds stands before them
        begin, end = begin + 1, end + 1
        begin[:1] = 0
        return self._placed(ids, begin, end, self.size_b, run)

    def _placed(self, ids, begin, end, decoded, run) -> Tokens:
        """Tokens with byte ends counted from the start of their stretch."""
        ends = refine(begin, end, decoded[ids])
        stop = np.cumsum([len(s.encode()) for s in run])
        owner = np.minimum(np.searchsorted(stop, ends, side="left"), len(run) - 1)
        return Tokens(ids, ends - np.r_[0, stop[:-1]][owner], np.bincount(owner, minlength=len(run)).astype(np.int64))

    def says(self, tokens: Tokens, decoded: list, stretches: list[str]) -> np.ndarray:
        """Whether the joined token bytes are the stretch."""
        ids, sizes = tokens.ids.tolist(), tokens.sizes.tolist()
        if b"".join(map(decoded.__getitem__, ids)) == "".join(stretches).encode():
            return np.ones(len(stretches), bool)
        out, at = np.zeros(len(stretches), bool), 0
        for k, (s, n) in enumerate(zip(stretches, sizes)):
            out[k] = b"".join([decoded[i] for i in ids[at:at + n]]) == s.encode()
            at += n
        return out


@functools.lru_cache(maxsize=2)
def load(path_a: str, path_b: str) -> Pair:
    one_thread()
    return Pair(path_a, path_b)


class Stretches:
    """Distinct stretches, aligned: the counts, groups and links of each."""

    def __init__(self, pair: Pair, stretches: list[str]):
        n = len(stretches)
        # B writes its mark for a space: a text that holds it never decodes to itself
        plain = np.array([MARK not in s for s in stretches], bool)
        use = [s for s in stretches if MARK not in s]
        a, b = pair.tokens(use)
        good = pair.says(a, pair.bytes_a, use) & pair.says(b, pair.bytes_b, use)
        self.good = np.zeros(n, bool)
        self.good[plain] = good
        self.n_a, self.n_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.n_a[plain], self.n_b[plain] = a.sizes, b.sizes
        where = np.flatnonzero(plain)
        of_a, of_b = np.repeat(where, a.sizes), np.repeat(where, b.sizes)
        use_a, use_b = self.good[of_a], self.good[of_b]      # stretches whose bytes differ are left out
        ids_a, ids_b, of_a, of_b = a.ids[use_a], b.ids[use_b], of_a[use_a], of_b[use_b]
        length = np.array([len(s.encode()) for s in stretches], np.int64)
        base = np.cumsum(length) - length                    # ranges of all stretches side by side
        end_a, end_b = a.ends[use_a] + base[of_a], b.ends[use_b] + base[of_b]
        near = np.searchsorted(end_b, end_a)
        cut = end_b[near] == end_a if len(end_b) else np.zeros(0, bool)
        group_a = np.cumsum(cut) - cut                       # groups before the token's own
        group_b = np.searchsorted(end_a[cut], end_b)
        self.n_groups = np.bincount(of_a[cut], minlength=n)
        self.groups = pair.group_texts(ids_a, ids_b, group_a, group_b, self.n_groups)
        begin_a = np.r_[0, end_a[:-1]]
        fresh = np.r_[True, of_a[1:] != of_a[:-1]] if len(of_a) else np.zeros(0, bool)
        begin_a = np.where(fresh, base[of_a], begin_a) if len(of_a) else begin_a[:0]
        low = np.searchsorted(end_b, begin_a, side="right")  # B tokens that end after A's begin ...
        per = near - low + 1                                 # ... up to the one that reaches A's end
        k = np.repeat(np.arange(len(ids_a)), per)
        self.link_a, self.link_b = ids_a[k], ids_b[ragged(low, per)]
        self.n_links = np.bincount(of_a, weights=per, minlength=n).astype(np.int64)


_FIELDS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "link_a", "link_b", "link_n")
SCHEMA = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
          "link_a array<int>, link_b array<int>, link_n array<int>")


def align_texts(pair: Pair, texts: list) -> list[pa.Array]:
    """The columns of ``SCHEMA`` after doc_id; the links as distinct id pairs with their number."""
    split = [pair.stretches(t) if t else [] for t in texts]
    code, new = pair.memory.codes(split)
    if new:
        s = Stretches(pair, new)
        pair.memory.add(good=s.good, n_a=s.n_a, n_b=s.n_b, n_groups=s.n_groups, n_links=s.n_links, groups=s.groups, link_a=s.link_a.astype(np.int32), link_b=s.link_b.astype(np.int32))
    if not len(code):
        code, words, done = code, 0, {k: np.zeros(0, np.int64) for k in ("good", "n_a", "n_b", "n_groups", "n_links", "groups", "link_a", "link_b")}
    else:
        words, done = len(pair.memory.place), pair.memory
    n = np.array([len(s) for s in split], np.int64)
    owner = np.repeat(np.arange(len(texts)), n)
    bad = np.zeros(len(texts), bool)
    bad[owner[~done["good"][code].astype(bool)]] = True
    use = ~bad[owner]
    owner, code = owner[use], code[use]
    sums = [np.bincount(owner, weights=x[code], minlength=len(texts)).astype(np.int64) for x in (done["n_a"], done["n_b"], done["n_groups"], done["n_links"])]
    at = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    codes = code.tolist()
    own = done["groups"]
    groups = [";".join([own[c] for c in codes[at[k]:at[k + 1]]]) for k in range(len(texts))]
    # links: distinct (document, stretch) first, then distinct (document, pair)
    both, times = np.unique(owner * max(words, 1) + code, return_counts=True)
    owner, code = both // max(words, 1), both % max(words, 1)
    size = done["n_links"]
    index = ragged((np.cumsum(size) - size)[code], size[code])
    doc, times = np.repeat(owner, size[code]), np.repeat(times, size[code])
    key = done["link_a"][index].astype(np.int64) << 32 | done["link_b"][index]
    order = np.lexsort((key, doc))
    doc, key, times = doc[order], key[order], times[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]) if len(doc) else np.zeros(0, np.int64)
    total = np.add.reduceat(times, new) if len(new) else np.zeros(0, np.int64)
    doc, key = doc[new], key[new]
    offsets = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (key >> 32, key & 0xFFFFFFFF, total)]
    return [*(pa.array(x) for x in sums), pa.array(groups, pa.string()), *lists]


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    begin = total = 0
    for i, n in enumerate(column.to_pylist()):
        n = len(n or "")
        if total and total + n > LOOSE:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(column):
        yield begin, len(column)


def _aligned(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    pair = load(path_a, path_b)
    for b in batches:
        for i, j in _slices(b.column(1)):
            columns = align_texts(pair, b.column(1).slice(i, j - i).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *columns], list(_FIELDS))


def align(df: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2``) and the distinct linked id
    pairs (link_a, link_b) with how often each is linked (link_n), for every row."""
    python_ready(df.sparkSession)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _aligned(it, path_a, path_b), SCHEMA)


def _links(aligned: DataFrame, *names: str) -> DataFrame:
    zipped = F.arrays_zip("link_a", "link_b", "link_n")
    return aligned.select(*names, F.explode(zipped).alias("l")).select(*names, F.col("l.link_a").alias("a"), F.col("l.link_b").alias("b"), F.col("l.link_n").alias("times"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count (documents that hold the pair linked) and best (whether it is the highest of its a)."""
    counts = written(_links(aligned).groupBy("a", "b").agg(F.count(F.lit(1)).alias("count")), "align-counts")
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    return written(counts.join(top, "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best")), "align-pairs")


def with_scores(aligned: DataFrame, head: int = HEAD) -> DataFrame:
    """``aligned`` (stored) with n_best and count_sum: links whose count is their A id's highest, and the
    sum of the counts over all links."""
    row = free_name(aligned, "_doc")
    # stored with its key, so that every plan reads the same one
    aligned = written(aligned.withColumn(row, F.monotonically_increasing_id()), "align-rows")
    pairs = pair_counts(aligned)
    first = written(pairs.orderBy(F.desc("count"), "a", "b").limit(head), "align-head")
    others = pairs.join(F.broadcast(first.select("a", "b")), ["a", "b"], "left_anti")
    links = _links(aligned, row).join(F.broadcast(first), ["a", "b"], "left")
    n_best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")
    count_sum = F.sum(F.col("times") * F.col("count")).alias("count_sum")
    rare = links.where(F.col("count").isNull()).drop("count", "best").join(others, ["a", "b"])
    scored = links.where(F.col("count").isNotNull()).groupBy(row).agg(n_best, count_sum) \
        .unionByName(rare.groupBy(row).agg(n_best, count_sum))
    scored = scored.groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.join(scored, row, "left").drop(row).na.fill(0, ["n_best", "count_sum"])


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    aligned = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest: Column = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    out = with_scores(aligned.withColumn("groups_sha256", digest).drop("groups"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
