"""Byte-level BPE files (``tokenizers`` JSON) for the transducer: word split and merge rules.

The split pattern is compiled to rules on runs of character classes (letters,
numbers, blanks, others, as the library itself classifies each character): a class
change opens a word; of a run of blanks before something else the last one stands
alone or, if it is a space, joins what follows; ``'s 't 'm 'd 're 've 'll`` at the
start of a word are words.  Added tokens cut the text before all this.
"""

from __future__ import annotations

import functools
import json
import re
import threading

import numpy as np

from txnwatch.llm.transducer import START, PairMerges, Transducer

LETTER, NUMBER, OTHER, BLANK, UNSEEN = 0, 1, 2, 3, 255
_APOSTROPHE, _SPACE = ord("'"), ord(" ")


def _byte_of_char() -> dict:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, model = spec["pre_tokenizer"], spec["model"]
        if (split["type"], model["type"], split.get("add_prefix_space"), spec["normalizer"], model.get("dropout")) != (
                "ByteLevel", "BPE", False, None, None) or not split.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens with options")
        byte = _byte_of_char()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {tuple(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = [tuple(tuple(byte[c] for c in side) for side in p) for p in pairs]
        self.machine = Transducer(PairMerges(tokens, merges, unknown_base=max(model["vocab"].values()) + 1))
        self.added = added
        self._added = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self._split = Tokenizer.from_file(path).pre_tokenizer
        self.classes = np.full(0x110000, UNSEEN, np.uint8)

    def pieces(self, text: str) -> list[str]:
        """The text cut at added tokens: ordinary text at even places, added tokens at odd ones."""
        return self._added.split(text) if self._added and any(t in text for t in self.added) else [text]

    def _class(self, c: str) -> int:
        for k, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(self._split.pre_tokenize_str(before + c)) == 1:
                return k
        return BLANK

    def _classify(self, cps: np.ndarray) -> np.ndarray:
        out = self.classes[cps]
        if (out == UNSEEN).any():
            for cp in np.unique(cps[out == UNSEEN]).tolist():
                self.classes[cp] = self._class(chr(cp))
            out = self.classes[cps]
        return out

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes as symbols, words opened with ``START``, and the first byte of each text."""
        joined = "".join(texts)
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(joined.encode("utf-8"), np.uint8)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        chars = np.cumsum([0, *map(len, texts)])
        n = len(cps)
        first = np.zeros(n + 1, bool)                  # first character of a text; the end counts too
        first[chars] = True
        cls = self._classify(cps)
        start = first[:n].copy()
        start[1:] |= cls[1:] != cls[:-1]
        # a blank run before something else gives up its last character
        b = np.flatnonzero(start & ~first[:n])
        b = b[cls[b - 1] == BLANK]
        start[b - 1] = True
        start[b[cps[b - 1] == _SPACE]] = False
        # contractions
        p = np.flatnonzero((cps == _APOSTROPHE) & start)
        p = p[~first[p + 1]]
        c1 = cps[p + 1]
        two = p[np.isin(c1, [ord(c) for c in "stmd"])]
        p, c1 = p[~first[np.minimum(p + 2, n)]], c1[~first[np.minimum(p + 2, n)]]
        c2 = cps[p + 2]
        three = p[((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))]
        for at, size in ((two, 2), (three, 3)):
            start[at + 1] = False
            after = at + size
            after = after[after < n]
            start[after[cls[after] == LETTER]] = True
        symbols = data.astype(np.int32)
        symbols[lead[start]] += START
        ends = np.r_[lead, len(data)]
        return symbols, ends[chars[:-1]]


_LOCK = threading.Lock()


@functools.lru_cache(maxsize=4)
def _loaded(path: str) -> ByteBpe:
    return ByteBpe(path)


def load(path: str) -> ByteBpe:
    """The compiled tokenizer of a file, once per process."""
    with _LOCK:
        return _loaded(path)
