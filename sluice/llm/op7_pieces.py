"""SentencePiece ids by forward filtering and backward sampling over the piece lattice; lossless decoding.

The lattice of a text has an edge for each vocabulary piece that matches.  Forward
filtering sums the weights of all segmentations up to each position; backward sampling
then draws one segmentation exactly in proportion to its weight.  No piece crosses from a
word into the next word's mark, so the lattice falls apart into words: each distinct word
of a batch is filtered once, and every occurrence is sampled with its own draws.  A draw
depends on the seed, the row's key and the position in the text alone, so segmentations
are the same on any cluster and in any order of rows.

The weight of a piece is ``(rank + 10) ** -alpha``: byte-pair models carry merge ranks
instead of probabilities, and ranks of words follow a power law.  Large ``alpha`` comes
near to the most likely segmentation, 0 makes all segmentations alike.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import hashes, lists, mix, pieces, powers

MARK, ODD = 0x2581, 0x10FFFF + 1  # the mark of a blank; stands for a mark in the text itself
_BITS = 19
BATCH = 1 << 19  # bytes of text that are segmented at once; arrays of some sixty times that size stand beside them
_SLOTS = 1 << _BITS
MOST_KNOWN = 500_000  # characters of words that a worker keeps; later words are filtered for their batch alone


class _Known:
    """Filtered words of one length that a worker has met; see ``Lattice._lines``."""

    def __init__(self, n: int, most: int):
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.prob = np.zeros((0, most), np.int16), np.zeros((0, most), np.float32)
        self.n = n

    def add(self, keys: np.ndarray, ids: np.ndarray, prob: np.ndarray) -> None:
        slot = len(self.ids) // self.n + np.arange(len(keys))
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.slot = keys[order], np.concatenate([self.slot, slot])[order]
        self.ids, self.prob = np.concatenate([self.ids, ids.astype(np.int16)]), np.concatenate([self.prob, prob])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots, -1 for words not known."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return np.where(self.keys[at] == keys, self.slot[at], -1) if len(self.keys) else np.full(len(keys), -1)


class Lattice:
    """The vocabulary by hash, and words met before.  ``salt`` changes all hashes, nothing else."""

    def __init__(self, model: str, alpha: float, salt: int = 0):
        import sentencepiece

        self.salt = salt

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.bytes_id = np.zeros(256, np.int32)
        self.content: list[bytes] = [b""] * n
        plain = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_id[int(p[3:5], 16)] = i
                self.content[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.content[i] = p.replace("▁", " ").encode()
                plain.append((i, p))
        if not all(self.content[i] for i in self.bytes_id):
            raise ValueError("the model has no byte pieces, so it cannot encode every text")
        first = plain[0][0]
        self.longest = max(len(p) for _, p in plain)
        codes = np.frombuffer("".join(p for _, p in plain).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) for _, p in plain])
        h = self._hash(codes, ends - [len(p) for _, p in plain], ends)
        ids = np.array([i for i, _ in plain], np.int32)
        weight = -alpha * np.log(ids - first + 10.0)
        self.unknown = float(-alpha * np.log(n + 10.0) * 2)
        order = np.lexsort((ids, self._slot(h)))
        h, ids, weight = h[order], ids[order], weight[order]
        # A slot holds one piece; those that share a slot with another go to a second and third table.
        self.tables = []
        while len(h):
            slot = self._slot(h)
            here = np.append(True, slot[1:] != slot[:-1])
            keys, values, weights = np.zeros(_SLOTS, np.uint64), np.full(_SLOTS, -1, np.int32), np.full(_SLOTS, -np.inf, np.float32)
            keys[slot[here]], values[slot[here]], weights[slot[here]] = h[here], ids[here], weight[here]
            self.tables.append((keys, values, weights))
            h, ids, weight = h[~here], ids[~here], weight[~here]
        self.shared = np.zeros(_SLOTS, bool)
        for keys, _, _ in self.tables[1:]:
            self.shared |= keys > 0
        self.known: dict[int, _Known] = {}
        self.size = np.array([len(c) for c in self.content], np.int64)
        self.flat = np.frombuffer(b"".join(self.content), np.uint8)
        self.at = np.cumsum(self.size) - self.size

    @staticmethod
    @functools.cache
    def _table(salt: int) -> np.ndarray:
        return np.random.default_rng(11 + salt).integers(1, 1 << 63, 1 << 21, dtype=np.uint64)

    def _prefix(self, codes: np.ndarray) -> np.ndarray:
        """Prefix sums for hashes of slices as short as a piece."""
        p = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(self._table(self.salt)[codes] * powers(len(codes) + 1)[0][: len(codes)], out=p[1:])
        return p

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)

    def _hash(self, codes: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return self._slices(self._prefix(codes), s, e)

    @staticmethod
    def _slices(p: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (p[e] - p[s]) * powers(len(p))[1][s] + (e - s).astype(np.uint64)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self._slot(h)
        ids, weights = np.full(h.shape, -1, np.int32), np.full(h.shape, -np.inf, np.float32)
        keys, values, w = self.tables[0]
        hit = np.nonzero(keys[slot] == h)
        ids[hit], weights[hit] = values[slot[hit]], w[slot[hit]]
        shared = np.nonzero(self.shared[slot])
        h, slot = h[shared], slot[shared]
        for keys, values, w in self.tables[1:]:
            hit = np.flatnonzero(keys[slot] == h)
            to = tuple(x[hit] for x in shared)
            ids[to], weights[to] = values[slot[hit]], w[slot[hit]]
        return ids, weights

    def _filter_equal(self, p: np.ndarray, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """``_filter`` for words of one length."""
        most = min(self.longest, n)
        around = s[:, None] + np.arange(n + 1)
        p, inverse = p[around], powers(len(p))[1][around[:, :n]]
        ids = np.full((len(s), n, most), -1, np.int32)
        score = np.full((len(s), n, most), -np.inf, np.float32)
        for k in range(most):
            h = (p[:, k + 1 :] - p[:, : n - k]) * inverse[:, : n - k] + np.uint64(k + 1)
            ids[:, k:, k], score[:, k:, k] = self._find(h)
        lone = ids[:, :, 0] < 0
        score[:, :, 0][lone] = self.unknown
        back = np.full((len(s), n + 1), 0, np.float32)  # column n - i: the sum up to the i-th character
        prob = np.ones((len(s), n, most), np.float32)
        for i in range(n):
            reach = min(i + 1, most)
            x = back[:, n - i : n - i + reach] + score[:, i, :reach]
            top = x.max(1, keepdims=True)
            c = np.cumsum(np.exp(x - top), 1)
            back[:, n - i - 1] = top[:, 0] + np.log(c[:, -1])
            prob[:, i, :reach] = c / c[:, -1:]
        return ids.reshape(-1, most), prob.reshape(-1, most)

    def _lines(self, p: np.ndarray, s: np.ndarray, n: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``_filter``, and at which line each word begins.  The first words a worker meets are kept for later batches."""
        if n[-1] > 32 or len(self.size) > 1 << 15:
            return *self._filter(p, s, n), np.cumsum(n) - n
        size = int(n[0])
        known = self.known.setdefault(size, _Known(size, min(self.longest, size)))
        slot = known.find(names)
        new = np.flatnonzero(slot < 0)
        if len(new):
            ids, prob = self._filter_equal(p, s[new], size)
            if sum(len(x.ids) for x in self.known.values()) < MOST_KNOWN:
                known.add(names[new], ids, prob)
                slot = known.find(names)
            else:
                old = np.flatnonzero(slot >= 0)
                lines = (slot[old][:, None] * size + np.arange(size)).ravel()
                ids, prob = np.concatenate([ids, known.ids[lines]]), np.concatenate([prob, known.prob[lines]])
                slot[new], slot[old] = np.arange(len(new)), len(new) + np.arange(len(old))
                return ids, prob, slot * size
        return known.ids, known.prob, slot * size

    def _filter(self, p: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the words at ``s`` of lengths ``n`` of the text with prefix hashes ``p``, laid one after another: ids of the piece of each length that ends at
        each position, and cumulated probabilities of these lengths."""
        if n[0] == n[-1] <= 32 and (n == n[0]).all():  # longer words always below, in double precision, whatever else is in their group
            return self._filter_equal(p, s, int(n[0]))
        base = np.cumsum(n) - n
        total, most = int(n.sum()), min(self.longest, int(n.max()))
        word = np.repeat(np.arange(len(n)), n)
        inside = np.arange(total) - base[word]  # position in the word
        spot = s[word] + inside
        ids = np.full((total, most), -1, np.int32)
        score = np.full((total, most), -np.inf, np.float32)
        for k in range(most):
            at = np.flatnonzero(inside >= k)
            ids[at, k], score[at, k] = self._find(self._slices(p, spot[at] - k, spot[at] + 1))
        lone = ids[:, 0] < 0
        score[lone, 0] = self.unknown
        # alpha of a word's start is 0; row i + 1 of a word is the end of its i-th character.
        alpha = np.zeros(total + len(n), np.float64)
        start = base + np.arange(len(n))
        order = np.argsort(-n, kind="stable")
        live = np.searchsorted(-n[order], -np.arange(1, int(n.max()) + 1), "right")
        prob = np.zeros((total, most), np.float32)
        for i in range(int(n.max())):
            w = order[: live[i]]
            reach = min(i + 1, most)
            x = alpha[start[w][:, None] + i - np.arange(reach)] + score[base[w] + i, :reach]
            top = x.max(1)
            e = np.exp(x - top[:, None])
            c = np.cumsum(e, 1)
            alpha[start[w] + i + 1] = top + np.log(c[:, -1])
            prob[base[w] + i, :reach] = c / c[:, -1:]
            prob[base[w] + i, reach:] = 1
        return ids, prob

    def sample(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Ids of each text; ``keys`` (uint64) seed the draws of each."""
        out = [np.zeros(0, np.int32) for _ in texts]
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return out
        joined = "".join(" " + texts[i] for i in full)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        rows = np.concatenate([[0], np.cumsum([len(texts[i]) + 1 for i in full])])
        codes[codes == MARK] = ODD
        codes[codes == 0x20] = MARK
        mark = codes == MARK
        first = mark.copy()
        first[1:] &= ~mark[:-1]
        first[rows[:-1]] = True
        s = np.flatnonzero(first)
        n = np.diff(np.append(s, len(codes)))
        p = self._prefix(codes)
        names = hashes((codes | self.salt << 21).astype(np.uint32).view(np.uint8), 4 * s, 4 * (s + n))
        names, one, inverse = np.unique(names, return_index=True, return_inverse=True)
        found = np.full(len(codes) + 1, -2, np.int32)
        row_of = np.searchsorted(rows, s, "right") - 1
        seed = keys[np.array(full)][row_of]
        # Words are filtered in groups of one length (long ones together) and of bounded size.
        by_length = np.argsort(n[one], kind="stable")
        names, one, rank = names[by_length], one[by_length], np.argsort(by_length)
        inverse = rank[inverse]
        base_all = np.cumsum(n[one]) - n[one]
        kind = np.minimum(n[one], 33) * len(codes) + base_all // (1 << 16)
        group = np.searchsorted(np.unique(kind), kind)
        # Each occurrence walks back from its end.
        occurrences = np.argsort(group[inverse], kind="stable")
        cuts = np.searchsorted(group[inverse][occurrences], np.arange(int(group.max()) + 2))
        for g in range(int(group.max()) + 1):
            words = np.flatnonzero(group == g)
            if not len(words):
                continue
            ids, prob, lines = self._lines(p, s[one[words]], n[one[words]], names[words])
            occ = occurrences[cuts[g] : cuts[g + 1]]
            at = lines[inverse[occ] - words[0]]
            left = n[occ].copy()
            while len(occ):
                end = s[occ] + left
                draw = mix(seed[occ] ^ ((end - rows[row_of[occ]]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
                u = (draw >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
                line = at + left - 1
                k = (prob[line] <= u[:, None]).sum(1)
                found[end] = ids[line, k]
                left = left - (k + 1)
                more = left > 0
                occ, at, left = occ[more], at[more], left[more]
        ends = np.flatnonzero(found > -2)
        ids = found[ends]
        count = np.diff(np.searchsorted(ends, rows, "right"))
        odd = np.flatnonzero(ids == -1)
        if len(odd):  # characters without a piece: the pieces of their bytes
            chars = [("▁" if c == ODD else chr(c)).encode() for c in codes[ends[odd] - 1]]
            size = np.ones(len(ids), np.int64)
            size[odd] = [len(c) for c in chars]
            count = np.add.reduceat(size, np.cumsum(count) - count)
            ids = np.repeat(ids, size)
            ids[ids == -1] = self.bytes_id[np.frombuffer(b"".join(chars), np.uint8)]
        for i, x in zip(full, np.split(ids, np.cumsum(count)[:-1]), strict=True):
            out[i] = x
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The texts of sequences of ids; exactly what was encoded."""
        if not ids:
            return []
        count = np.array([len(x) for x in ids])
        flat = np.concatenate(ids)
        size = self.size[flat]
        total = np.concatenate([[0], np.cumsum(size)])
        data = self.flat[np.repeat(self.at[flat] - total[:-1], size) + np.arange(total[-1])].tobytes()
        cut = total[np.concatenate([[0], np.cumsum(count)])]
        return [data[a + 1 : b].decode() if b > a else "" for a, b in zip(cut[:-1], cut[1:], strict=True)]


@functools.lru_cache(2)
def lattice(model: str, alpha: float, salt: int = 0) -> Lattice:
    return Lattice(model, alpha, salt)


def segmented(model: str, alpha: float, texts: list[str], keys: np.ndarray) -> tuple[list[np.ndarray], list[bool]]:
    """Sampled ids of each text, and whether they decode to it.  A text whose words or pieces share a hash with others is done again under other hashes."""
    lat = lattice(model, alpha)
    ids = lat.sample(texts, keys)
    same = [a == b for a, b in zip(texts, lat.decode(ids), strict=True)]
    for i in (k for k, ok in enumerate(same) if not ok):
        for salt in range(1, 8):
            other = lattice(model, alpha, salt)
            ids[i] = other.sample([texts[i]], keys[i : i + 1])[0]
            if other.decode([ids[i]])[0] == texts[i]:
                same[i] = True
                break
    return ids, same


def key_seeds(keys: pa.Array, seed: int) -> np.ndarray:
    """Seeds of integer row keys; null keys count as key 0."""
    values = np.asarray(keys.fill_null(0).cast(pa.int64())).astype(np.uint64)
    return mix(values * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & (1 << 63) - 1))


def encode(docs: DataFrame, model: str, alpha: float = 1.0, seed: int = 1) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and lossless (the ids decode to exactly the text).

    Null and empty texts have no ids.  Rows are independent: repeated rows give repeated,
    equal rows; null keys share one seed.  Columns other than doc_id and text are not read.
    Memory is bounded by batches of about 512 KB of text, or by the longest text.
    """

    def run(batches):
        for part in pieces(batches, BATCH):
            texts = ["" if x is None else x for x in part.column("text").to_pylist()]
            ids, same = segmented(model, alpha, texts, key_seeds(part.column("doc_id"), seed))
            count = np.array([len(x) for x in ids])
            flat = lists(np.concatenate(ids) if len(ids) else np.zeros(0, np.int32), count, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count, pa.int64()), flat, pa.array(same)], ["doc_id", "n_tokens", "ids", "lossless"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, lossless boolean")


def decode(tokens: DataFrame, model: str) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids give ''."""

    def run(batches):
        lat = lattice(model, 1.0)
        for batch in batches:
            ids = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lat.decode(ids), pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
