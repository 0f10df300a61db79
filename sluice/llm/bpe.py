"""Byte-level BPE of whole batches: words are found in numpy, each distinct word is encoded once a worker.

The library's BPE model encodes the words; only the split into words (the pattern of the
byte-level pre-tokenizer) is done here, on arrays.  Texts with characters whose class
could differ between Unicode versions, or with strings of added tokens, go to the
library whole, so the ids are always the library's.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

from .textbytes import hashes

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
MOST_WORDS = 1 << 20  # distinct words a worker remembers; then it starts anew


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point of the basic plane; 4: left to the library."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.full(65536, 4, np.uint8)
    for c in range(65536):
        cat = unicodedata.category(chr(c))
        if cat not in ("Cn", "Cs", "Co"):
            out[c] = kind.get(cat[0], OTHER)
    for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[c] = SPACE
    return out


@functools.cache
def _alphabet() -> dict[int, str]:
    """The printable stand-ins of the byte-level alphabet: printable bytes stay, the others follow from 256 on."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(stay)]
    return {b: chr(b) for b in stay} | {b: chr(256 + i) for i, b in enumerate(rest)}


def split(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``codes``; ``rows`` are the offsets of the texts, which words never cross."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[codes]
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    change = edge.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(change[:n])
    end = np.append(start[1:], n)
    white = kind[start] == SPACE
    closes = edge[end]
    # The last character of white space goes with what follows if it is a blank, else it stands alone.
    blank = (codes[end - 1] == 0x20) & white & ~closes
    s, e = start.copy(), end.copy()
    e[blank] -= 1
    s[1:][blank[:-1]] -= 1
    alone = white & ~closes & ~blank & (end - start > 1)
    # 's 't 'm 'd 're 've 'll after no blank, as one word; the rest of the letters starts anew.
    quote = np.flatnonzero((end - start == 1) & (codes[start] == 0x27) & (s == start) & ~closes)
    quote = quote[quote + 1 < len(start)]
    quote = quote[kind[start[quote + 1]] == LETTER]
    if len(quote):
        c1 = codes[start[quote + 1]]
        c2 = np.where(end[quote + 1] - start[quote + 1] > 1, codes[np.minimum(start[quote + 1] + 1, n - 1)], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
        k = np.where(one, 1, np.where(two, 2, 0))
        e[quote] += k
        s[quote + 1] += k
    extra = end[alone] - 1
    e[alone] -= 1
    if len(extra):
        at = np.flatnonzero(alone) + 1
        s, e = np.insert(s, at, extra), np.insert(e, at, extra + 1)
    full = e > s
    return (s, e) if full.all() else (s[full], e[full])


class Words:
    """Ids of words by hash, for one tokenizer in one worker.  The characters of each word are compared with those its ids are of."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.reset()

    def reset(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the words' characters in ``codes``
        self.codes = np.zeros(0, np.uint16)

    def learn(self, new: np.ndarray, texts: list[str]) -> None:
        alphabet = _alphabet()
        found = [[t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(alphabet))] for w in texts]
        count = np.array([len(x) for x in found], np.int64)
        start = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], np.uint32)])
        size = np.array([len(w) for w in texts], np.int64)
        first = len(self.codes) + np.cumsum(size) - size
        self.codes = np.concatenate([self.codes, np.frombuffer("".join(texts).encode("utf-16-le"), np.uint16)])
        known = np.concatenate([self.known, new])
        order = np.argsort(known, kind="stable")
        self.known, self.start, self.count = known[order], np.concatenate([self.start, start])[order], np.concatenate([self.count, count])[order]
        self.first, self.size = np.concatenate([self.first, first])[order], np.concatenate([self.size, size])[order]

    def encode(self, text: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of plain rows (offsets in code points into ``text``) and how many ids each row has; None if two words share a hash."""
        codes = np.frombuffer(text.encode("utf-16-le"), np.uint16)
        s, e = split(codes, rows)
        h = hashes(codes.view(np.uint8), 2 * s, 2 * e)
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != unique[inside]
        if new.any():
            if len(self.known) + int(new.sum()) > MOST_WORDS:
                self.reset()
                new[:] = True
            self.learn(unique[new], [text[a:b] for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.known, unique)
        at = at[inverse]
        n = e - s
        if (self.size[at] != n).any():
            return None
        cut = np.cumsum(n) - n
        there = np.arange(int(n.sum()))
        if (self.codes[there + np.repeat(self.first[at] - cut, n)] != codes[there + np.repeat(s - cut, n)]).any():
            return None
        count = self.count[at]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.start[at] - total[:-1], count) + np.arange(total[-1])]
        per_row = total[np.searchsorted(s, rows[1:])] - total[np.searchsorted(s, rows[:-1])]
        return ids, per_row

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        table = classes()
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if not t.isascii():
                codes = np.frombuffer(t.encode("utf-32-le"), np.uint32)
                odd = int(codes.max()) > 65535 or bool((table[codes] == 4).any())
            else:
                odd = False
            if odd or any(x in t for x in self.special):
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
            else:
                plain.append(i)
        if plain:
            rows = np.concatenate([[0], np.cumsum([len(texts[i]) for i in plain])])
            found = self.encode("".join(texts[i] for i in plain), rows)
            if found is None:  # two words share a hash: the library encodes these texts
                for i in plain:
                    out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
                return out  # type: ignore[return-value]
            ids, count = found
            at = np.concatenate([[0], np.cumsum(count)])
            for k, i in enumerate(plain):
                out[i] = ids[at[k] : at[k + 1]]
        return out  # type: ignore[return-value]


@functools.lru_cache(2)
def words_of(path: str) -> Words:
    return Words(path)
