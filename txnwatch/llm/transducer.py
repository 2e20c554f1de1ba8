"""Merge-rule (BPE) tokenizers compiled to finite-state transducers.

BPE tokens of a text prefix follow from shorter prefixes: the encoding of u ends in
the one token t, a suffix of u, that is *compatible* with the last token of the rest
of u (merging both alone gives the same two tokens back).  So after each symbol it
suffices to know, for every position from which a token may still grow, the last
token there and how many tokens lie behind it: a finite state.  A transition reads
one symbol and carries the change of the token count (it can be 0 or negative, when
the symbol completes a longer token).  States and transitions are compiled when
first met, kept per worker process as packed bytes, and dropped together, with what the model
remembers of its tokens, when ``max_transitions`` is reached.

``Lanes`` runs many stretches of text in lockstep with numpy, one table lookup a
symbol.  A symbol of 2**``START_BIT`` and more opens a new word: the state before it
does not matter.
"""

from __future__ import annotations

from array import array

import numpy as np

START_BIT = 22                       # above every code point; set on the first symbol of a word
START = 1 << START_BIT
_KEY = START_BIT + 1
_BLANK = -2                          # a place where no token can start


class MergeModel:
    """Tokens as tuples of symbols, and the encoding of a short word by plain merging."""

    def __init__(self, tokens: dict, unknown_base: int):
        self.tokens = tokens                          # symbols -> id
        self.unknown_base = unknown_base              # a lone symbol without a token gets unknown_base + symbol
        self.longest = max((len(t) for t in tokens), default=1)
        self.proper = {t[:k] for t in tokens for k in range(1, len(t))}
        self.symbols_of = {i: t for t, i in tokens.items()}
        self.forget()

    def forget(self) -> None:
        """Drop what is remembered of tokens that were asked for."""
        self._compatible: dict = {}                   # a * 2**32 + b
        self._grown: dict = {}

    def rank(self, left: tuple, right: tuple):
        """Priority of merging two adjacent tokens (lower first), or None."""
        raise NotImplementedError

    def token_id(self, t: tuple):
        i = self.tokens.get(t)
        return i if i is not None or len(t) > 1 else self.unknown_base + t[0]

    def symbols(self, i: int) -> tuple:
        return self.symbols_of[i] if i < self.unknown_base else (i - self.unknown_base,)

    def merge(self, symbols: tuple, first: list | None = None, last: list | None = None) -> list:
        """Tokens (as symbol tuples) of a short word, leftmost lowest rank first; ``first`` and
        ``last`` receive what the outer parts were and the rank at which each was merged away."""
        parts = [(s,) for s in symbols]
        while len(parts) > 1:
            ranks = [(r, k) for k in range(len(parts) - 1) if (r := self.rank(parts[k], parts[k + 1])) is not None]
            if not ranks:
                break
            r, k = min(ranks)
            if first is not None and k == 0:
                first.append((parts[0], r))
            if last is not None and k == len(parts) - 2:
                last.append((parts[-1], r))
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _growth(self, i: int):
        """How a token's first and last part grew while it was merged, or None if its symbols do not give it back."""
        got = self._grown.get(i, 0)
        if got == 0:
            t, first, last = self.symbols(i), [], []
            got = None
            if self.merge(t, first, last) == [t]:
                ranks = [r for _, r in first], [r for _, r in last]
                never = float("inf")
                got = ([*first, (t, never)], [*last, (t, never)], all(x == sorted(x) for x in ranks))
            self._grown[i] = got
        return got

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b can follow token a; a is -1 before the first token of a word."""
        pair = (a << 32) + b
        got = self._compatible.get(pair)
        if got is None:
            got = self._compatible[pair] = self._fits(a, b)
        return got

    def _fits(self, a: int, b: int) -> bool:
        right = self._growth(b)
        if a < 0 or right is None:
            return right is not None
        left = self._growth(a)
        if left is None:
            return False
        if not (left[2] and right[2]):                 # merged out of rank order: do it
            s, t = self.symbols(a), self.symbols(b)
            return self.merge(s + t) == [s, t]
        # in rank order the parts at the border meet in turn; none of these pairs may merge before
        # one of the two is merged away (at equal ranks the merge further left comes first)
        i = j = 0
        while True:
            (x, x_gone), (y, y_gone) = left[1][i], right[0][j]
            r = self.rank(x, y)
            if r is not None and r < x_gone and r <= y_gone:
                return False
            if x_gone == y_gone == float("inf"):
                return True
            if x_gone <= y_gone:
                i += 1
            else:
                j += 1


class PairMerges(MergeModel):
    """Merges listed as pairs in order of priority (byte-level BPE files)."""

    def __init__(self, tokens: dict, merges: list, unknown_base: int):
        super().__init__(tokens, unknown_base)
        self.pairs = {p: r for r, p in enumerate(merges)}

    def rank(self, left, right):
        return self.pairs.get((left, right))


class ScoredMerges(MergeModel):
    """Any two neighbours that form a piece may merge, best score first (sentencepiece BPE)."""

    def __init__(self, tokens: dict, scores: dict, unknown_base: int):
        super().__init__(tokens, unknown_base)
        self.scores = scores

    def rank(self, left, right):
        s = self.scores.get(left + right)
        return None if s is None else -s


class Transducer:
    """The lazily compiled machine of a ``MergeModel``; state 0 is the start of a word.

    ``last[state]`` is the token that ends there, ``length[state]`` its symbols.
    """

    def __init__(self, model: MergeModel, max_transitions: int = 1_000_000):
        self.model, self.max_transitions = model, max_transitions
        self._reset()

    def _reset(self):
        self.model.forget()
        self.states: dict = {}
        self.info: list = []
        self.last = np.zeros(1 << 12, np.int32)
        self.length = np.zeros(1 << 12, np.int32)
        self._state((), (-1,), (0,))
        self.size = 1 << 14
        self.keys = np.full(self.size, -1, np.int64)
        self.next = np.zeros(self.size, np.int32)
        self.emit = np.zeros(self.size, np.int8)
        self.n = 0

    def _state(self, node, lasts, behind) -> int:
        key = array("i", (*node, *lasts, *behind)).tobytes()
        s = self.states.get(key)
        if s is None:
            s = self.states[key] = len(self.info)
            self.info.append(key)
            if s >= len(self.last):
                self.last = np.r_[self.last, np.zeros_like(self.last)]
                self.length = np.r_[self.length, np.zeros_like(self.length)]
            if lasts[0] >= 0:
                self.last[s], self.length[s] = lasts[0], len(self.model.symbols(lasts[0]))
        return s

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """Next state and change of the token count."""
        if symbol >= START:
            state, symbol = 0, symbol - START
        known = memoryview(self.info[state]).cast("i").tolist()
        depth = len(known) // 3                        # symbols of the node; lasts and behind have one more each
        node, lasts, behind = known[:depth], known[depth:2 * depth + 1], known[2 * depth + 1:]
        # lasts[k], behind[k]: last token and tokens since, k symbols back
        model = self.model
        grown = (*node, symbol)
        for size in range(len(grown), 0, -1):
            t = model.token_id(grown[len(grown) - size:])
            if t is not None and model.compatible(lasts[size - 1], t):
                break
        else:
            raise ValueError(f"no token fits after state {state}, symbol {symbol}")
        delta = 1 - behind[size - 1]
        depth = len(grown)
        while depth and grown[len(grown) - depth:] not in model.proper:
            depth -= 1
        node = grown[len(grown) - depth:]
        # positions 0 (here) to depth symbols back; those where no token can start any more are blank
        new_lasts, new_behind = [t], [0]
        for k in range(1, depth + 1):
            open_here = node[depth - k:] in model.proper
            new_lasts.append(lasts[k - 1] if open_here else _BLANK)
            new_behind.append(delta + behind[k - 1] if open_here else 0)
        return self._state(node, new_lasts, new_behind), delta

    # the transitions: an open-addressing table in numpy
    def _slot(self, key):
        return ((key * np.int64(-7046029254386353131)) >> np.int64(20)) & np.int64(self.size - 1)

    def _insert(self, keys, nxt, emit):
        if self.n + len(keys) > self.size // 2:
            while self.n + len(keys) > self.size // 2:
                self.size *= 2
            old = self.keys >= 0
            keys, nxt, emit = (np.r_[a[old], b] for a, b in ((self.keys, keys), (self.next, nxt), (self.emit, emit)))
            self.keys = np.full(self.size, -1, np.int64)
            self.next, self.emit, self.n = np.zeros(self.size, np.int32), np.zeros(self.size, np.int8), 0
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]         # of several for one slot the last one stays
            won = free[self.keys[slot[free]] == keys[free]]
            self.next[slot[won]], self.emit[slot[won]] = nxt[won], emit[won]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (self.size - 1)
        self.n += len(keys)

    def advance(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``step`` for arrays."""
        key = (np.where(symbol >= START, 0, state).astype(np.int64) << _KEY) | symbol
        slot = self._slot(key)
        found = self.keys[slot]
        off = np.flatnonzero(found != key)
        while len(off):
            empty = off[self.keys[slot[off]] < 0]
            if len(empty):
                new = np.unique(key[empty])
                made = [self.step(int(k >> _KEY), int(k & ((1 << _KEY) - 1))) for k in new]
                self._insert(new, np.array([m[0] for m in made], np.int32), np.array([m[1] for m in made], np.int8))
                slot = self._slot(key)                  # the table may have grown
                off = np.flatnonzero(self.keys[slot] != key)
                continue
            slot[off] = (slot[off] + 1) & (self.size - 1)
            off = off[self.keys[slot[off]] != key[off]]
        return self.next[slot], self.emit[slot]

    def make_room(self) -> None:
        """Between runs: drop everything compiled once there is too much of it."""
        if self.n > self.max_transitions:
            self._reset()


class Lanes:
    """Stretches ``[start, end)`` of one symbol array, run in lockstep, longest first."""

    def __init__(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray):
        order = np.argsort(start - end, kind="stable")
        self.order, self.start, self.size = order, start[order], (end - start)[order]
        self.symbols = symbols
        self.alive = [int(x) for x in np.searchsorted(-self.size, -np.arange(1, int(self.size.max(initial=0)) + 1), side="right")]

    def run(self, machine: Transducer, entry: np.ndarray | None = None, states: np.ndarray | None = None):
        """Exit state and token count of each stretch; ``states`` (like symbols) receives every state passed."""
        n = len(self.start)
        state = np.zeros(n, np.int32) if entry is None else entry[self.order].astype(np.int32)
        count = np.zeros(n, np.int64)
        for t, k in enumerate(self.alive):
            at = self.start[:k] + t
            nxt, emit = machine.advance(state[:k], self.symbols[at])
            state[:k] = nxt
            count[:k] += emit
            if states is not None:
                states[at] = nxt
        back = np.empty(n, np.int64)
        back[self.order] = np.arange(n)
        return state[back], count[back]

    def token_ends(self, machine: Transducer, states: np.ndarray) -> np.ndarray:
        """Marks the symbols where a token ends; each stretch must end with a word."""
        ends = np.zeros(len(self.symbols), bool)
        left = self.size.copy()                        # symbols of each lane before the next token end
        live = np.flatnonzero(left)
        while len(live):
            at = self.start[live] + left[live] - 1
            ends[at] = True
            left[live] -= machine.length[states[at]]
            live = live[left[live] > 0]
        return ends


def cut_lanes(word_start: np.ndarray, total: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of whole words, about ``width`` symbols each (a longer word stays whole)."""
    at = np.flatnonzero(word_start)
    if not total:
        return at[:0], at[:0]
    first = np.r_[True, (at[1:] // width) != (at[:-1] // width)]
    start = at[first]
    return start, np.r_[start[1:], total]
