"""SentencePiece encoding and decoding by streaming Viterbi.

Encoding is a shortest-path problem over the positions of a text, with an edge for
every piece.  ``StreamingViterbi`` reads symbols one by one and keeps, for the last
``longest`` positions only, the best way to reach them and its backpointers.  A later
piece can start at none but these, so once the backpointer paths of all of them run
through one boundary, the ids before it are final: they are committed and dropped.

The best way to a position is the highest sum of scores for unigram models.  For BPE
models it is the merge-consistent one: the last piece must be compatible with the
piece before it (see ``transducer``); exactly one is, and the ids equal what merging
the whole text gives.  A character without a piece becomes its byte pieces, or the
unknown id.

Where no piece holds the blank mark after another character, all paths meet before
every blank mark whatever the text, so a batch commits there at once: its distinct
words are encoded once, BPE words in lockstep by the compiled transducer, words over
``LONG`` symbols by the streaming path.

Blanks are written as the mark U+2581, one more is put before a text that is not
empty, and decoding turns marks into spaces and drops the first.  Models that change
characters on input (a normaliser with a character map) are refused.  Null text is
the empty text: no ids.  An empty table gives no rows.
"""

from __future__ import annotations

import codecs
import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.llm.common import distinct, id_back, id_text, python_ready, table
from txnwatch.llm.token_counts import grouped
from txnwatch.llm.transducer import START, Lanes, ScoredMerges, Transducer, cut_lanes

MARK = "▁"
LONG = 2000
UNKNOWN_PENALTY = 10.0         # below the lowest score, as the library counts an unknown character


def _each_byte(e):
    return "�" * (e.end - e.start), e.end


codecs.register_error("each-byte", _each_byte)


class PieceModel:
    """A sentencepiece file: pieces, scores, special ids and the kind of model."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            data = f.read()
        spec = proto.ModelProto()
        spec.ParseFromString(data)
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces \
                or not spec.normalizer_spec.escape_whitespaces:
            raise ValueError(f"{path}: its normaliser changes characters")
        sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        kind = spec.trainer_spec.model_type
        if kind not in (spec.trainer_spec.UNIGRAM, spec.trainer_spec.BPE):
            raise ValueError(f"{path}: neither a unigram nor a BPE model")
        self._set(kind == spec.trainer_spec.BPE, spec.normalizer_spec.add_dummy_prefix, sp.unk_id(),
                  [sp.id_to_piece(i) for i in range(sp.get_piece_size())], [sp.get_score(i) for i in range(sp.get_piece_size())],
                  [sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) for i in range(sp.get_piece_size())],
                  [sp.is_byte(i) for i in range(sp.get_piece_size())])

    def _set(self, bpe, prefix, unk, pieces, scores, hidden, byte):
        self.bpe, self.prefix, self.unk = bpe, prefix, unk
        usable = [i for i in range(len(pieces)) if not hidden[i] and not byte[i]]
        self.ids = {pieces[i]: i for i in usable}
        self.scores = {pieces[i]: scores[i] for i in usable}
        self.longest = max(map(len, self.ids), default=1)
        self.lowest = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.bytes = {int(pieces[i][3:-1], 16): i for i in range(len(pieces)) if byte[i]}
        self.size = len(pieces)
        # what an id decodes to
        self.text = [b"" if h else p.encode() for p, h in zip(pieces, hidden)]
        for b, i in self.bytes.items():
            self.text[i] = bytes([b])
        if 0 <= unk < len(pieces):
            self.text[unk] = " ⁇ ".encode()
        # no piece holds a mark after another character: every path has a border before such a mark
        self.splits = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.machine = Transducer(ScoredMerges({tuple(map(ord, p)): i for p, i in self.ids.items()},
                                               {tuple(map(ord, p)): s for p, s in self.scores.items()}, self.size)) if bpe else None

    @classmethod
    def of(cls, pieces: list, scores: list, bpe: bool = False, prefix: bool = True) -> PieceModel:
        """A model from pieces (the first is the unknown one) without byte pieces."""
        self = cls.__new__(cls)
        self._set(bpe, prefix, 0, list(pieces), list(scores), [True] + [False] * (len(pieces) - 1), [False] * len(pieces))
        return self

    def symbols(self, text: str) -> str:
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def lone(self, char: str) -> list[int]:
        """Ids of a character without a piece."""
        data = char.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in data] if all(b in self.bytes for b in data) else [self.unk]

    def decode(self, ids) -> str:
        out = b"".join([self.text[i] for i in ids]).decode("utf-8", "each-byte").replace(MARK, " ")
        return out[1:] if self.prefix and out[:1] == " " else out


class StreamingViterbi:
    """Best path over an endless text: ``feed`` gives the ids that became final, ``finish`` the rest.

    ``window`` says how many positions are held: at most ``longest`` + ``every`` after the last
    border that all paths share."""

    def __init__(self, model: PieceModel, every: int = 64):
        self.model, self.every = model, every
        self.back = [0]                 # back[k]: symbols of the best last piece that ends at position k of the window
        self.piece = [-1]               # its id, or -1 - code point of a character without one
        self.score = [0.0]
        self.tail = ""                  # the last symbols, where a piece may still start
        self.state, self.since = 0, 0
        self.steps: dict = {}           # (state, symbol) -> state, of this stream
        self.most = 1

    def feed(self, symbols: str) -> list[int]:
        out: list[int] = []
        for c in symbols:
            (self._merge_step if self.model.bpe else self._score_step)(c)
            self.since += 1
            if self.since >= self.every:
                out += self._commit()
        return out

    def _merge_step(self, c: str) -> None:
        machine = self.model.machine
        at = self.state, c
        if at not in self.steps:
            self.steps[at] = machine.step(self.state, ord(c))[0]
        self.state = self.steps[at]
        last = int(machine.last[self.state])
        self.back.append(int(machine.length[self.state]))
        self.piece.append(last if last < self.model.size else -1 - (last - self.model.size))

    def _score_step(self, c: str) -> None:
        model = self.model
        tail = self.tail = (self.tail + c)[-model.longest:]
        n = len(self.score)
        best, size, piece = self.score[n - 1] + model.lowest, 1, -1 - ord(c)
        for k in range(1, min(len(tail), n) + 1):
            s = model.scores.get(tail[-k:])
            if s is not None and (self.score[n - k] + s > best or (k == 1 and piece < 0)):
                best, size, piece = self.score[n - k] + s, k, model.ids[tail[-k:]]
        self.back.append(size)
        self.piece.append(piece)
        self.score.append(best)

    def _ids(self, begin: int, end: int) -> list[int]:
        """Ids of the best path between two positions of the window."""
        path = []
        while end > begin:
            path.append(self.piece[end])
            end -= self.back[end]
        return [i for p in reversed(path) for i in ([p] if p >= 0 else self.model.lone(chr(-1 - p)))]

    def _commit(self) -> list[int]:
        """Commit up to the last border that the paths of all open positions share."""
        self.since = 0
        n = len(self.back)
        self.most = max(self.most, n)
        ends = set(range(max(0, n - self.model.longest), n))
        while len(ends) > 1:                              # follow the furthest one back
            k = max(ends)
            ends.discard(k)
            ends.add(k - self.back[k])
        at = ends.pop()
        out = self._ids(0, at)
        for name in ("back", "piece"):
            setattr(self, name, getattr(self, name)[at:])
        if not self.model.bpe:
            base = self.score[at]
            self.score = [s - base for s in self.score[at:]]
        return out

    def finish(self) -> list[int]:
        return self._ids(0, len(self.back) - 1)


def encode_word(model: PieceModel, word: str) -> list[int]:
    v = StreamingViterbi(model)
    return v.feed(word) + v.finish()


_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def encode_words(model: PieceModel, words: list[str]) -> list[list[int]]:
    """Ids of each word: in lockstep, long words and unigram models by streaming."""
    out: list = [None] * len(words)
    short = [i for i, w in enumerate(words) if model.bpe and len(w) <= LONG]
    if short:
        model.machine.make_room()
        symbols = np.frombuffer("".join([words[i] for i in short]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        ends = np.cumsum([len(words[i]) for i in short])
        starts = np.zeros(len(symbols), bool)
        starts[0] = True
        starts[ends[:-1]] = True
        symbols[starts] += START
        states = np.zeros(len(symbols), np.int32)
        lanes = Lanes(symbols, *cut_lanes(starts, len(symbols), 256))
        lanes.run(model.machine, states=states)
        at = np.flatnonzero(lanes.token_ends(model.machine, states))
        ids = model.machine.last[states[at]].tolist()
        cut = np.searchsorted(at, ends - 1, side="right").tolist()
        known = model.size
        begin = 0
        for i, end in zip(short, cut):
            own = ids[begin:end]
            out[i] = own if max(own) < known else [x for p in own for x in ([p] if p < known else model.lone(chr(p - known)))]
            begin = end
    for i, w in enumerate(words):
        if out[i] is None:
            out[i] = encode_word(model, w)
    return out


def encode_texts(model: PieceModel, texts: list) -> list[np.ndarray]:
    """Ids of every text."""
    split = [(_WORD.findall(s) if model.splits else [s] if s else []) for s in (model.symbols(t or "") for t in texts)]
    code, words = distinct(split)
    ids = encode_words(model, words)
    flat = np.array([x for w in ids for x in w], np.int32)
    size = np.array([len(w) for w in ids], np.int64)
    start = np.cumsum(size) - size
    out, at = [], 0
    for s in split:
        own = code[at:at + len(s)]
        at += len(s)
        n = size[own] if len(own) else np.zeros(0, np.int64)
        index = np.arange(n.sum()) + np.repeat(start[own] - (np.cumsum(n) - n), n) if len(own) else np.zeros(0, np.int64)
        out.append(flat[index])
    return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def _encoded(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    model = load(path)
    for b in batches:
        for s in grouped(b["text"]):
            ids = encode_texts(model, b["text"].iloc[s].tolist())
            yield b.iloc[s].drop(columns="text").assign(ids=[x.astype("<u4").tobytes() for x in ids])


def _decoded(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    model = load(path)
    for b in batches:
        step = 256
        for k in range(0, len(b), step):
            part = b.iloc[k:k + step]
            yield part.drop(columns="ids").assign(
                decoded=[None if x is None else model.decode(np.frombuffer(x, "<u4").tolist()) for x in part["ids"]])


def encode(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (little-endian uint32) of every row."""
    python_ready(df.sparkSession)
    rows = df.select(id_text(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return id_back(rows.mapInPandas(lambda it: _encoded(it, path), "doc_id string, ids binary"), "doc_id")


def decode(df: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded text of rows (doc_id, ids); null ids give null."""
    python_ready(df.sparkSession)
    rows = df.select(id_text("doc_id").alias("doc_id"), "ids")
    return id_back(rows.mapInPandas(lambda it: _decoded(it, path), "doc_id string, decoded string"), "doc_id")


def _checked(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    model = load(path)
    for b in batches:
        for s in grouped(b["text"]):
            part = b.iloc[s]
            texts = [t or "" for t in part["text"]]
            ids = encode_texts(model, texts)
            yield part.drop(columns="text").assign(
                ids=[x.astype("<u4").tobytes() for x in ids],
                round_trip=[model.decode(x.tolist()) == t.replace(MARK, " ") for x, t in zip(ids, texts)])


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document (count and CRC-32) and whether decoding them gives the text back."""
    import public_tokenizers

    python_ready(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select(id_text("doc_id").alias("doc_id"), "text")
    out = id_back(docs.mapInPandas(lambda it: _checked(it, path), "doc_id string, ids binary, round_trip boolean"), "doc_id")
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "round_trip")
