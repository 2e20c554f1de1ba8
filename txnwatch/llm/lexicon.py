"""A minimal acyclic transducer over byte strings with id sequences as outputs.

``build`` reads the words in byte order and keeps one register of finished states: a
state whose word ends, transitions and outputs equal those of a registered one is that
one, so words share their suffixes as well as their prefixes.  Ids stand as early on a
path as the words below it agree on them.  The result is one flat int64 array, so that
a stored automaton can be mapped into memory and shared by all processes of a machine.

``Lexicon.lookup`` follows many words in lockstep with numpy.
"""

from __future__ import annotations

import numpy as np

_EMPTY = ()


def _common(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class _Open:
    """A state of the word being added: transitions by byte as [byte, target, output], and the output at its end."""

    __slots__ = ("moves", "final")

    def __init__(self):
        self.moves: list = []
        self.final = None                 # None: no word ends here

    def prepend(self, ids: tuple) -> None:
        for m in self.moves:
            m[2] = ids + m[2]
        if self.final is not None:
            self.final = ids + self.final

    def key(self) -> tuple:
        return self.final, tuple(map(tuple, self.moves))


def build(entries: dict) -> np.ndarray:
    """The automaton of ``entries`` (non-empty bytes -> tuple of ids)."""
    register: dict = {}

    def close(state: _Open) -> int:
        return register.setdefault(state.key(), len(register))

    path, last = [_Open()], b""
    for word in sorted(entries):
        rest, keep = tuple(entries[word]), _common(last, word)
        while len(path) - 1 > keep:
            done = close(path.pop())
            path[-1].moves[-1][1] = done
        for k in range(keep):
            move = path[k].moves[-1]
            n = _common(move[2], rest)
            if n < len(move[2]):
                path[k + 1].prepend(move[2][n:])
                move[2] = move[2][:n]
            rest = rest[n:]
        for b in word[keep:]:
            path[-1].moves.append([b, -1, rest])
            rest = _EMPTY
            path.append(_Open())
        path[-1].final = rest
        last = word
    while len(path) > 1:
        done = close(path.pop())
        path[-1].moves[-1][1] = done
    return _flat(register, close(path[0]))


def _flat(register: dict, root: int) -> np.ndarray:
    outputs: dict = {_EMPTY: 0}

    def number(ids):
        return outputs.setdefault(ids, len(outputs))

    final = np.full(len(register), -1, np.int64)
    edges = []
    for (end, moves), state in register.items():
        if end is not None:
            final[state] = number(end)
        edges += [(state << 8 | b, target, number(out)) for b, target, out in moves]
    edge = np.array(sorted(edges), np.int64).reshape(-1, 3)
    sizes = np.array([len(o) for o in outputs], np.int64)
    ids = np.array([i for o in outputs for i in o], np.int64)
    head = np.array([len(final), len(edge), len(sizes), len(ids), root], np.int64)
    return np.concatenate([head, final, edge.T.ravel(), np.cumsum(sizes) - sizes, sizes, ids])


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes of the slices ``[start, start + size)``, one slice after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Lexicon:
    def __init__(self, flat: np.ndarray):
        states, edges, outs, ids, self.root = (int(x) for x in flat[:5])
        sizes = [states, edges, edges, edges, outs, outs, ids]
        at = 5 + np.cumsum([0, *sizes])
        self.final, self.key, self.target, self.out, self.start, self.size, self.ids = (
            flat[a:a + n] for a, n in zip(at, sizes))

    def lookup(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is held, its number of ids (0 if not), and the ids of all held words in turn."""
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        first = np.cumsum(lengths) - lengths
        live = np.flatnonzero(lengths > 0)
        state = np.full(len(words), self.root, np.int64)
        emitted, step, last = [], 0, len(self.key) - 1
        held = np.zeros(len(words), bool)
        while len(live) and last >= 0:
            key = state[live] << 8 | data[first[live] + step]
            e = np.minimum(np.searchsorted(self.key, key), last)
            ok = self.key[e] == key
            live, e = live[ok], e[ok]
            state[live] = self.target[e]
            step += 1
            emitted.append((live, np.full(len(live), step), self.out[e]))
            ended = lengths[live] == step
            done = live[ended]
            out = self.final[state[done]]
            held[done[out >= 0]] = True
            emitted.append((done[out >= 0], np.full(int((out >= 0).sum()), step + 1), out[out >= 0]))
            live = live[~ended]
        if not emitted:
            return held, np.zeros(len(words), np.int64), np.zeros(0, np.int64)
        word, when, out = (np.concatenate(x) for x in zip(*emitted))
        keep = held[word] & (self.size[out] > 0)
        word, when, out = word[keep], when[keep], out[keep]
        order = np.lexsort((when, word))
        word, out = word[order], out[order]
        counts = np.zeros(len(words), np.int64)
        np.add.at(counts, word, self.size[out])
        return held, counts, self.ids[ragged(self.start[out], self.size[out])]
