"""Language ID by segmentation-marginalised unigrams.

The pieces are a fixed public vocabulary (a sentencepiece file).  Each language has a
probability for every piece, learnt as expected counts: all segmentations of the
training words count, each by its probability under a uniform piece model (one
forward-backward pass), plus ``smoothing``.  A text is scored by the forward
algorithm, which sums the probabilities of *all* segmentations of its words; words
are independent because no piece spans a blank.  A character outside the vocabulary
has one fixed probability in every language.

A word is a run of non-blanks; distinct words of a batch are scored once.  The
forward pass goes through all words of a batch in step, one character at a time,
rescaling as it goes, so a word may be of any length.

Training: documents of ``train_rows`` per language at most (those with the smallest
id hashes, ``None``: all), a documented bound on rows that fit a classifier.

Prediction: the language with the highest posterior (log-likelihood a character,
sharpened by ``sharpness``, and the training shares as prior), ties by name; score is that
posterior.  Null text, text without a letter, or a model without languages: ``und``
with score 0.  An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.llm.common import BLANKS, distinct, free_name, give_back, python_ready, table
from txnwatch.llm.token_counts import grouped, runs

TRAIN_ROWS = 20_000
UNKNOWN = 1e-7               # probability of a character outside the vocabulary
SMOOTHING = 0.5
UNDETERMINED = "und"
WORDS_AT_ONCE = 16_384       # words whose prefixes are held at a time
_SPACE = "▁"
_SPLIT = str.maketrans({c: " " for c in BLANKS})
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SIEVE = np.uint64(44)


class PieceTable:
    """The vocabulary's pieces by (length, hash), looked up for arrays of substrings."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        usable = [i for i, p in enumerate(pieces) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.size, self.longest = len(pieces), max((len(pieces[i]) for i in usable), default=1)
        self.by_length = {}
        for n in range(1, self.longest + 1):
            ids = np.array([i for i in usable if len(pieces[i]) == n], np.int32)
            if len(ids):
                codes = np.array([[ord(c) for c in pieces[i]] for i in ids], np.uint64)
                h = np.zeros(len(ids), np.uint64)
                for k in range(n):
                    h = h * _MULT + codes[:, k]
                order = np.argsort(h)
                if len(np.unique(h)) != len(h):
                    raise ValueError("two pieces share a hash")
                sieve = np.zeros(1 << (64 - int(_SIEVE)), bool)          # most substrings stop here
                sieve[h >> _SIEVE] = True
                self.by_length[n] = (h[order], ids[order], codes[order], sieve)

    def find(self, codes: np.ndarray, at: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the substrings of length n that end at ``at`` are pieces (verified on their
        characters), and the piece ids; ``h`` are their hashes."""
        keys, ids, text, sieve = self.by_length[n]
        where = np.flatnonzero(sieve[h >> _SIEVE])
        k = np.minimum(np.searchsorted(keys, h[where]), len(keys) - 1)
        same = keys[k] == h[where]
        where, k = where[same], k[same]
        same = (text[k] == codes[at[where, None] - np.arange(n - 1, -1, -1)]).all(axis=1)
        return where[same], ids[k[same]]


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> PieceTable:
    return PieceTable(path)


class WordLattice:
    """All pieces in all places of some words: for each end position and length, the piece or -1."""

    def __init__(self, words: list[str], vocab: PieceTable):
        text = "".join(_SPACE + w for w in words)
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.array([len(w) + 1 for w in words], np.int64)
        order = np.argsort(-size, kind="stable")            # longest first: the live ones are a prefix
        self.order, self.size = order, size[order]
        self.start = (np.cumsum(size) - size)[order]
        self.vocab = vocab
        self.alive = np.searchsorted(-self.size, -np.arange(1, int(self.size.max(initial=0)) + 1), side="right")

    def pieces_ending(self, t: int):
        """(length, rows, piece ids) of the pieces that end after character t of their word."""
        k = int(self.alive[t])
        at = self.start[:k] + t
        h, power = np.zeros(k, np.uint64), np.uint64(1)
        out = []
        with np.errstate(over="ignore"):
            for n in range(1, min(self.vocab.longest, t + 1) + 1):
                h = h + self.codes[at - (n - 1)] * power
                power = power * _MULT
                if n in self.vocab.by_length:
                    rows, ids = self.vocab.find(self.codes, at, h, n)
                    if len(rows):
                        out.append((n, rows, ids))
        return k, out

    def lattice(self):
        return [self.pieces_ending(t) for t in range(len(self.alive))]

    def forward(self, probs: np.ndarray, steps=None) -> np.ndarray:
        """log of the summed segmentation probabilities of every word; ``probs`` is [piece, language]."""
        n, m, reach = len(self.size), probs.shape[1], self.vocab.longest
        ring = np.zeros((reach + 1, n, m))                   # the last ``reach`` prefixes, scaled
        ring[0] = 1.0
        scale = np.zeros((n, m))
        for t in range(len(self.alive)):
            k, found = steps[t] if steps is not None else self.pieces_ending(t)
            now = ring[t % (reach + 1), :k] * UNKNOWN
            covered = np.zeros(k, bool)
            for size, rows, ids in found:
                if size == 1:
                    covered[rows] = True
            now[covered] = 0.0
            for size, rows, ids in found:
                now[rows] += ring[(t + 1 - size) % (reach + 1), rows] * probs[ids]
            ring[(t + 1) % (reach + 1), :k] = now
            if t % 8 == 7:                                   # keep long words in range
                top = now.copy()
                top[top <= 0] = 1.0
                ring[:, :k] /= top
                scale[:k] += np.log(top)
        total = ring[self.size % (reach + 1), np.arange(n)]
        out = np.empty((n, m))
        out[self.order] = np.log(np.maximum(total, 1e-300)) + scale
        return out

    def expected_counts(self, weights: np.ndarray, uniform: float) -> np.ndarray:
        """Expected piece counts over all segmentations under a uniform model, weighted by word and
        summed: [piece, column of ``weights``]."""
        n, reach, steps = len(self.size), self.vocab.longest, self.lattice()
        weights = weights[self.order]
        out = np.zeros((self.vocab.size, weights.shape[1]))
        # log of the summed segmentations of each prefix
        alpha = [np.zeros(n)]
        for t, (k, found) in enumerate(steps):
            now = np.full(k, UNKNOWN)
            for size, rows, _ in found:
                if size == 1:
                    now[rows] = 0.0
            for size, rows, _ in found:
                now[rows] += uniform * np.exp(alpha[t + 1 - size][rows] - alpha[t][rows])
            alpha.append(alpha[t][:k] + np.log(now))
        # chance that a segmentation has a border after t characters; each edge gets its share of its end's
        border = [np.where(self.size[:len(x)] == t, 1.0, 0.0) for t, x in enumerate(alpha)]
        for t in range(len(steps) - 1, -1, -1):
            k, found = steps[t]
            alone = np.ones(k, bool)
            for size, rows, ids in found:
                back = t + 1 - size
                share = border[t + 1][rows] * uniform * np.exp(alpha[back][rows] - alpha[t + 1][rows])
                border[back][rows] += share
                if size == 1:
                    alone[rows] = False
                for c in range(weights.shape[1]):
                    out[:, c] += np.bincount(ids, share * weights[rows, c], minlength=len(out))
            rest = np.flatnonzero(alone)
            border[t][rest] += border[t + 1][rest] * UNKNOWN * np.exp(alpha[t][rest] - alpha[t + 1][rest])
        return out


def word_counts(texts: list) -> tuple[list, np.ndarray, np.ndarray]:
    """Distinct words, and for every word occurrence its text and its word."""
    split = [(t or "").translate(_SPLIT).split(" ") for t in texts]
    owner = np.repeat(np.arange(len(split)), [len(s) for s in split])
    code, words = distinct(split)
    empty = words.index("") if "" in words else -1
    keep = code != empty
    return words, owner[keep], code[keep]


def _slices(words: list) -> Iterator[np.ndarray]:
    """Places of at most ``WORDS_AT_ONCE`` words at a time, the longest words first."""
    order = np.argsort([-len(w) for w in words], kind="stable")
    for k in range(0, len(order), WORDS_AT_ONCE):
        yield order[k:k + WORDS_AT_ONCE]


@dataclass
class LanguageModel:
    languages: list
    prior: np.ndarray            # share of training documents
    probs: np.ndarray            # [piece, language]
    path: str
    sharpness: float = 20.0

    def classify(self, texts: list) -> tuple[list, np.ndarray]:
        best, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return best, score
        words, owner, code = word_counts(texts)
        logp = np.zeros((len(texts), len(self.languages)))
        chars = np.zeros(len(texts))
        if len(owner):
            per_word = np.empty((len(words), len(self.languages)))
            for at in _slices(words):
                per_word[at] = WordLattice([words[k] for k in at], pieces(self.path)).forward(self.probs)
            for c in range(logp.shape[1]):
                logp[:, c] = np.bincount(owner, per_word[code, c], minlength=len(texts))
            chars = np.bincount(owner, np.array([len(w) + 1 for w in words])[code], minlength=len(texts))
        z = logp * (np.minimum(1.0, self.sharpness / np.maximum(chars, 1)))[:, None] + np.log(self.prior)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        post = z / z.sum(axis=1, keepdims=True)
        top = post.argmax(axis=1)
        for i, t in enumerate(texts):
            if t and any(map(str.isalpha, t)):
                best[i], score[i] = self.languages[top[i]], post[i, top[i]]
        return best, score


def _expected(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    vocab = pieces(path)
    for b in batches:
        for s in grouped(b["text"]):
            part = b.iloc[s]
            langs = sorted(part["lang"].unique())
            words, owner, code = word_counts(part["text"].tolist())
            if not len(owner):
                continue
            of = part["lang"].map({g: i for i, g in enumerate(langs)}).to_numpy()[owner]
            weights = np.stack([np.bincount(code[of == i], minlength=len(words)) for i in range(len(langs))], axis=1).astype(float)
            counts = sum(WordLattice([words[k] for k in at], vocab).expected_counts(weights[at], 1.0 / vocab.size) for at in _slices(words))
            piece, lang = np.nonzero(counts > 0)
            yield pd.DataFrame({"lang": np.array(langs, dtype=object)[lang], "piece": piece.astype(np.int32),
                                "n": counts[piece, lang]})
            del part, words, owner, code, of, weights, counts
    b = None
    give_back()


def fit(df: DataFrame, path: str, text: str = "text", lang: str = "lang", order: str = "doc_id",
        train_rows: int | None = TRAIN_ROWS) -> LanguageModel:
    """Piece probabilities of every language of ``df`` (null languages and texts do not train)."""
    python_ready(df.sparkSession)
    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(order).alias("id")) \
        .where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    seen = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if train_rows is not None and seen:
        # a cut on the id's hash that keeps about ``train_rows`` rows of each language
        share = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 30)) / (1 << 30)
        keep = F.element_at(F.create_map(*[F.lit(x) for g, n in seen.items() for x in (g, min(1.0, train_rows / n))]), F.col("lang"))
        rows = rows.where(share < keep)
    counts = rows.select("lang", "text").mapInPandas(lambda it: _expected(it, path), "lang string, piece int, n double") \
        .groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()       # at most languages x pieces
    languages = sorted(counts["lang"].unique())
    vocab = pieces(path)
    table_ = np.full((vocab.size, len(languages)), SMOOTHING)
    for i, g in enumerate(languages):
        own = counts[counts["lang"] == g]
        table_[own["piece"].to_numpy(), i] += own["n"].to_numpy()
    total = sum(seen[g] for g in languages)
    return LanguageModel(languages, np.array([seen[g] / total for g in languages]), table_ / table_.sum(axis=0), path)


def predict(df: DataFrame, model: LanguageModel, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the predicted language and its posterior in two new columns (under longer names where
    ``df`` has those)."""
    python_ready(df.sparkSession)
    out = free_name(df, out)
    score = free_name(df.withColumn(out, F.lit("")), score)
    shared = df.sparkSession.sparkContext.broadcast(model)          # vocabulary x languages numbers
    schema = df.withColumn(out, F.lit("")).withColumn(score, F.lit(0.0)).schema
    return df.mapInArrow(lambda it: _arrow(it, shared, text, out, score), schema)


def _arrow(batches, shared, text: str, out: str, score: str):
    import pyarrow as pa
    import pyarrow.compute as pc

    model = shared.value
    for b in batches:
        texts = b.column(text)
        lengths = pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        got = [model.classify(texts[s].to_pylist()) for s in runs(lengths)]
        best = [x for g, _ in got for x in g]
        p = np.concatenate([x for _, x in got]) if got else np.zeros(0)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.string()), pa.array(p, pa.float64())],
                                         names=[*b.schema.names, out, score])
    b = texts = got = None
    give_back()


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def drop_undetermined(df: DataFrame, path: str | None = None, min_score: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose language is determined with a posterior of ``min_score`` or more;
    where no row tells a language, the rows with a letter."""
    import public_tokenizers

    model = fit(df, path or public_tokenizers.path("piece_bpe_32k.model"))
    if not model.languages:
        return df.where(F.col("text").rlike(r"\p{L}"))
    lang, score = free_name(df, "lang_pred"), free_name(df, "score")
    out = predict(df, model, out=lang, score=score)
    return out.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= min_score)).drop(lang, score)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = fit(docs.where(~held_out), public_tokenizers.path("piece_bpe_32k.model"))
    out = predict(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
