"""Byte-level BPE pre-tokenisation of many texts at once, exactly as the tokenizer library does it for one.

The split is the published pattern  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+  worked out on arrays: runs of
one character class, a single space joined to the run after it, contractions cut off. The class of each character that occurs is asked of the
library itself, so its Unicode tables are the ones that count.
"""

from __future__ import annotations

import json

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from .textbytes import BASE, mix, prefix_sums, span_hash

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 1, 2, 3, 0, 255
#: Fixed by the pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

#: The byte alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}

_classes = np.full(0x110000, UNKNOWN, np.uint8)
_asked = pre_tokenizers.ByteLevel(add_prefix_space=False)


def _class(char: str) -> int:
    for before, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
        if len(_asked.pre_tokenize_str(before + char)) == 1:
            return kind
    return SPACE


def classes(points: np.ndarray) -> np.ndarray:
    out = _classes[points]
    if (out == UNKNOWN).any():
        for p in np.unique(points[out == UNKNOWN]).tolist():
            _classes[p] = _class(chr(p))
        out = _classes[points]
    return out


class ByteLevel:
    """A byte-level BPE tokenizer file: the library's tokenizer, its special strings, and its merges as ranks of byte-string pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        self.specials = {}
        for token in spec["added_tokens"]:
            if token["lstrip"] or token["rstrip"] or token["single_word"]:
                raise ValueError(f"{path} has an added token that takes in its surroundings")
            self.specials[token["content"].encode()] = token["id"]
        self.library = Tokenizer.from_file(path)
        self._merges = spec["model"]["merges"]

    def letters(self, word: bytes) -> str:
        """word in the byte alphabet that the library's model works on."""
        return word.decode("latin-1").translate(_ALPHABET)

    def ranks(self) -> dict[tuple[bytes, bytes], int]:
        back = {ord(c): b for b, c in _ALPHABET.items()}
        raw = lambda s: s.translate(back).encode("latin-1")
        pairs = (m if isinstance(m, list) else m.split(" ") for m in self._merges)
        return {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}

    def split(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts, byte ends, rows and special ids (-1: none) of the pre-tokens of the texts that lie in buf at off."""
        if not len(buf):
            return (np.empty(0, np.int64),) * 4
        at = np.flatnonzero((buf & 0xC0) != 0x80)  # first byte of each character
        raw = buf.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        n = len(points)
        kind = classes(points)
        cut = np.zeros(n + 1, bool)  # nothing crosses these
        cut[np.searchsorted(at, off)] = True
        marks = []
        for text, token in self.specials.items():
            p = raw.find(text)
            while p >= 0:
                row = int(np.searchsorted(off, p, "right")) - 1
                if p + len(text) <= off[row + 1]:
                    marks.append((p, p + len(text), token))
                    p = raw.find(text, p + len(text))
                else:
                    p = raw.find(text, p + 1)
        for s, e, _ in marks:
            cut[np.searchsorted(at, [s, e])] = True
        run = cut[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        begins = run.copy()
        space = kind == SPACE
        # white space before other text: all but its last character is one token; the last joins the text if it is 0x20
        follows = np.zeros(n, bool)
        follows[:-1] = space[:-1] & ~space[1:] & ~cut[1:n]
        begins[follows] = True
        glued = np.flatnonzero(follows & (points == 32)) + 1
        begins[glued] = False
        tick = np.flatnonzero(begins & run & (points == 39))
        tick = tick[tick + 1 < n]
        tick = tick[(kind[tick + 1] == LETTER) & ~cut[tick + 1]]
        for p in tick.tolist():
            for c in CONTRACTIONS:
                e = p + 1 + len(c)
                if e <= n and not cut[p + 1 : e].any() and all(points[p + 1 + i] == ord(x) for i, x in enumerate(c)):
                    begins[p + 1] = False
                    if e < n and kind[e] == LETTER and not cut[e]:
                        begins[e] = True
                    break
        special = np.full(n, -1, np.int64)
        for s, e, token in marks:
            a, b = np.searchsorted(at, [s, e])
            begins[a:b] = False
            begins[a] = True
            special[a] = token
        first = np.flatnonzero(begins)
        starts = at[first]
        ends = np.append(starts[1:], len(buf))
        return starts, ends, np.searchsorted(off, starts, "right") - 1, special[first]

    def words(self, buf: np.ndarray, off: np.ndarray):
        """(hashes of the distinct pre-tokens, an occurrence of each as (start, end), index of each token, its row, its special id)."""
        starts, ends, rows, special = self.split(buf, off)
        keys = span_hash(prefix_sums(buf, BASE), starts, ends, BASE)
        marked = special >= 0
        if marked.any():
            keys[marked] = mix(special[marked].astype(np.uint64) + np.uint64(1 << 60))
        unique, first, index = np.unique(keys, return_index=True, return_inverse=True)
        return unique, starts[first], ends[first], special[first], index, rows
