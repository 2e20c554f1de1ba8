"""Token counts by a compiled finite-state tokenizer.

The tokenizer is a transducer whose transitions carry emitted-token counts (see
``transducer``).  Texts are cut into chunks of ``width`` bytes anywhere, and a chunk
is a map from the state it is entered with to its exit state and count.  Past the
first word start inside it a chunk forgets its entry, so its map is (head, constant
tail); a chunk inside one long word has no constant part and is tabulated for the
entry states that the bytes before it allow.  All tails, then all heads, then all
tables run in lockstep.  The maps of a long word's chunks, exit state and tokens by
entry state, compose through a prefix scan, whose result are the counts; a state that a
map lacks is filled in where the scan meets it, so the counts are exact for any text.

Null text is empty: 0 bytes, 0 tokens.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.llm import byte_bpe
from txnwatch.llm.common import id_back, id_text, python_ready, table
from txnwatch.llm.transducer import START, Lanes, Transducer

WIDTH = 1024
GROUP = 1 << 22            # characters that run together
LIMIT = 512
NO = -1                    # no entry state known


class ChunkMaps:
    """State maps of chunks of one symbol array and their composition."""

    def __init__(self, machine: Transducer, symbols: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.machine, self.symbols, self.start, self.end = machine, symbols, start, end

    def _run(self, start, end, entry=None):
        return Lanes(self.symbols, start, end).run(self.machine, entry)

    def counts(self) -> np.ndarray:
        """Tokens that each chunk adds, entered as the chunks before it leave off."""
        start, end, machine = self.start, self.end, self.machine
        opens = np.flatnonzero(self.symbols >= START)
        at = np.searchsorted(opens, start)
        sync = np.r_[opens, len(self.symbols)][at]            # first word start in or after the chunk
        constant = sync < end
        sync = np.minimum(sync, end)
        leave = np.full(len(start), NO, np.int64)
        count = np.zeros(len(start), np.int64)
        k = np.flatnonzero(constant)
        leave[k], count[k] = self._run(sync[k], end[k])
        self._long_words(np.flatnonzero(~constant), leave, count)
        k = np.flatnonzero(constant & (sync > start))         # heads, entered with the exit before them
        _, extra = self._run(start[k], sync[k], leave[k - 1])
        count[k] += extra
        return count

    def _candidates(self, k: np.ndarray) -> dict:
        """Entry states that chunk k may have: from each of the places just before it, read as a word start."""
        back = 2 * self.machine.model.longest
        first = np.maximum(self.start[k] - back, self.start[k - 1])
        offsets = [(first + d) for d in range(self.machine.model.longest)]
        own = [np.flatnonzero(f < self.start[k]) for f in offsets]
        chunk = np.concatenate([k[o] for o in own])
        begin = np.concatenate([f[o] for f, o in zip(offsets, own)])
        state, _ = self._run(begin, self.start[chunk])
        out: dict = {int(c): set() for c in k}
        for c, s in zip(chunk.tolist(), state.tolist()):
            out[c].add(s)
        return out

    def _tabulate(self, tables: dict, wanted: list) -> None:
        """Add (chunk, entry) pairs to the tables by running the chunks from those states."""
        wanted = [(c, s) for c, s in dict.fromkeys(wanted) if s not in tables[c]]
        if wanted:
            c, s = (np.array(x) for x in zip(*wanted))
            leave, count = self._run(self.start[c], self.end[c], s)
            for (chunk, entry), x, n in zip(wanted, leave.tolist(), count.tolist()):
                tables[chunk][entry] = (x, n)

    def _long_words(self, chunks: np.ndarray, leave: np.ndarray, count: np.ndarray) -> None:
        if not len(chunks):
            return
        base: dict = {int(c): {} for c in chunks}
        self._tabulate(base, [(c, s) for c, states in self._candidates(chunks).items() for s in states])
        for run in np.split(chunks, np.flatnonzero(np.diff(chunks) > 1) + 1):
            entry = int(leave[run[0] - 1])
            self._tabulate(base, [(int(run[0]), entry)])
            scan = self._scan(base, run.tolist(), entry)
            leave[run] = [x for x, _ in scan]
            count[run] = np.diff([0, *(n for _, n in scan)])

    def _scan(self, base: dict, run: list, entry: int) -> list:
        """Prefix scan over a run of chunks: for each of them the state after it and the tokens of all chunks up
        to it, entered with ``entry``.

        ``maps[k][i]`` is the composed map {state: (exit, tokens)} of the up to 2^k chunks that end with the
        i-th; level k + 1 composes two neighbours of level k.  A state that a map lacks is filled in from the
        maps below it, and at the lowest level by running the chunk."""
        maps = [[base[c] for c in run]]

        def through(level: int, i: int, state: int):
            own = maps[level][i]
            if state not in own:
                half = i - (1 << (level - 1)) if level else 0
                if not level:
                    self._tabulate(base, [(run[i], state)])
                elif half < 0:
                    own[state] = through(level - 1, i, state)
                else:
                    x, n = through(level - 1, half, state)
                    y, m = through(level - 1, i, x)
                    own[state] = (y, n + m)
            return own[state]

        while 1 << (len(maps) - 1) < len(run):
            level, reach = len(maps), 1 << (len(maps) - 1)
            maps.append([{} for _ in run])
            for i in range(len(run)):
                for state in list(maps[level - 1][max(0, i - reach)]) if i >= reach else [entry]:
                    through(level, i, state)
        return [through(len(maps) - 1, i, entry) for i in range(len(run))]


def count_texts(texts: list, bpe: byte_bpe.ByteBpe, width: int = WIDTH) -> np.ndarray:
    """Tokens of each text."""
    out = np.zeros(len(texts), np.int64)
    doc, plain = [], []
    for i, t in enumerate(texts):
        cut = bpe.pieces(t) if t else []
        out[i] += len(cut) // 2
        for p in cut[::2]:
            if p:
                doc.append(i)
                plain.append(p)
    if plain:
        bpe.machine.make_room()
        symbols, first = bpe.symbols(plain)
        sizes = np.diff(np.r_[first, len(symbols)])
        chunks = -(-sizes // width)
        owner = np.repeat(np.arange(len(plain)), chunks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        start = first[owner] + nth * width
        end = np.minimum(start + width, first[owner] + sizes[owner])
        counts = ChunkMaps(bpe.machine, symbols, start, end).counts()
        np.add.at(out, np.array(doc)[owner], counts)
    return out


def grouped(texts: pd.Series, size: int = GROUP) -> Iterator[slice]:
    """Consecutive rows of about ``size`` characters together (a longer text stays alone)."""
    return runs(texts.str.len().fillna(0).to_numpy(np.int64), size)


def runs(lengths: np.ndarray, size: int = GROUP) -> Iterator[slice]:
    """``grouped`` for the texts' lengths."""
    begin, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > size:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield slice(begin, len(lengths))


def _counted(batches: Iterator[pd.DataFrame], path: str, width: int) -> Iterator[pd.DataFrame]:
    bpe = byte_bpe.load(path)
    for b in batches:
        n = [count_texts(b["text"].iloc[s].tolist(), bpe, width) for s in grouped(b["text"])]
        yield b.drop(columns="text").assign(n_tokens=np.concatenate(n) if n else np.zeros(0, np.int64))


def token_counts(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT,
                 width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    python_ready(df.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(id_text(doc_id).alias("doc_id"), F.octet_length(t).cast("long").alias("n_bytes"), t.alias("text"))
    out = rows.mapInPandas(lambda it: _counted(it, path, width), "doc_id string, n_bytes long, n_tokens long")
    return id_back(out, "doc_id").withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
