"""Benchmark decontamination by templates, which also finds re-parameterised questions.

Texts become sequences of tokens; numbers (1,500 and 3.5 are one), units after numbers (also
attached: 5kg), and names (capitalised within a sentence) become typed placeholders, and what
they stood for is kept as a slot.  A capitalised word that opens a sentence may be either, so
windows are looked up in both forms: as a word and as a name.
Windows of five template tokens, at least three of them words, are looked up in a hash
table of the benchmark's windows.  A document that holds at least 0.8 of an item's windows
is checked for slot consistency: equal values of the item must correspond to equal values
in the document, along one chain of windows that grows in both.  Such documents contain the item, with its own or with other values.

Items without such a window (short, or mainly numbers and names) are looked up by their whole
template: with three words or more the slots must agree exactly, with fewer the whole item
must stand in the document, but for case and space.

The benchmark is a stated query set: it is read in blocks of bounded size, each block is
sent to the executors and held against every whole text.  Nothing of the documents is
shuffled, so neither frequent passages nor large groups of copies matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import hashes, mix, pieces, powers, runs, slices, utf8

WINDOW, WORDS, SHARE = 5, 3, 0.8
DRIFT = 20  # tokens by which an occurrence may be stretched or shortened between two windows
BLOCK_BYTES = 32 << 20  # of benchmark text sent to the executors at once

NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons tonne tonnes oz lb lbs pound pounds ml cl l liter liters litre litres gallon gallons "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent cent cents dollar dollars usd eur euro euros gbp k m bn "
    "c f degree degrees mph kmh kb mb gb tb hz khz mhz ghz v w kw kwh j kj cal kcal pa kpa bar mol meter meters metre metres"
)
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:\n"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CASES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _cases(size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each code point of ``size`` bytes: the one in lower case (if that has as many bytes), and whether it is a capital."""
    if size not in _CASES:
        end = (0x800, 0x10000, 0x20000)[size - 2]
        chars = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(end)]
        low = [x.lower() if x.isupper() or x.istitle() else x for x in chars]
        _CASES[size] = (
            np.array([ord(y) if len(y) == 1 and len(y.encode()) == size else k for k, y in enumerate(low)], np.int64),
            np.array([x != y for x, y in zip(chars, low, strict=True)], bool),
        )
    return _CASES[size]


def _lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text in lower case, and a mark at the first byte of each capital."""
    low, upper = _LOWER[data], (data >= 65) & (data <= 90)
    for size, begin, end in ((2, 0xC3, 0xE0), (3, 0xE1, 0xF0), (4, 0xF0, 0xF1)):
        at = np.flatnonzero((data >= begin) & (data < end))
        if len(at):
            code = data[at].astype(np.int64) & (0xFF >> (size + 1))
            for k in range(1, size):
                code = code << 6 | (data[at + k] & 0x3F)
            lower, capital = _cases(size)
            known = code < len(lower)
            at, code = at[known], code[known]
            at, code = at[capital[code]], code[capital[code]]
            upper[at] = True
            code = lower[code]
            for k in range(size - 1, 0, -1):
                low[at + k] = 0x80 | code & 0x3F
                code = code >> 6
            low[at] = code | (0xF00 >> size) & 0xFF
    return low, upper


def _hashes(text: str) -> np.ndarray:
    data = [np.frombuffer(w.encode(), np.uint8) for w in dict.fromkeys(text.split())]
    return np.sort(np.array([hashes(d, np.array([0]), np.array([len(d)]))[0] for d in data], np.uint64))


_NUMBER_WORDS, _UNITS = _hashes(NUMBER_WORDS), _hashes(UNITS)
NUM, UNIT, NAME = (mix(np.array([k], np.uint64))[0] for k in (101, 102, 103))


@dataclass
class Templates:
    """Tokens of a batch: template and value hashes, row, whether a placeholder, whether a capital that opens a sentence.

    For each window of five tokens of a row: its first token, whether it has enough words, its hash, and that with opening capitals as names.
    """

    value: np.ndarray
    row: np.ndarray
    slot: np.ndarray
    opening: np.ndarray
    first: np.ndarray
    eligible: np.ndarray
    window: np.ndarray
    named: np.ndarray
    template: np.ndarray
    begin: np.ndarray  # of each token in the text without space, and its end
    end: np.ndarray
    packed: np.ndarray  # that text


def _is_in(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _windows(template: np.ndarray) -> np.ndarray:
    n = len(template) - WINDOW + 1
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h = mix(h ^ template[k : n + k])
    return h


def _forms(t: Templates) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums for ``slices`` over the tokens' values, and over their templates with opening capitals as names."""
    power, _ = powers(len(t.value) + 1)
    return tuple(np.append(np.uint64(0), np.cumsum(x * power[: len(x)])) for x in (t.value, np.where(t.opening, NAME, t.template)))


def templates(column) -> Templates:
    data, offsets = utf8(column)
    low, capital = _lowered(data)
    inside, digit = _INSIDE[data], _DIGIT[data]
    if len(data) > 2:  # a point or comma between digits of a row
        between = np.flatnonzero(digit[:-2] & digit[2:] & ((data[1:-1] == 44) | (data[1:-1] == 46))) + 1
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        between = between[~edge[between] & ~edge[between + 1]]
        inside[between] = digit[between] = True
    s, e, row = runs(inside, offsets)
    other = np.append(np.flatnonzero(~digit), len(data))
    to = other[np.searchsorted(other, s)] if len(s) else s
    cut = np.flatnonzero((to > s) & (to < e))
    cut = cut[_is_in(hashes(low, to[cut], e[cut]), _UNITS)] if len(cut) else cut
    if len(cut):  # a unit attached to its number is a token of its own
        s, e, row = np.insert(s, cut + 1, to[cut]), np.insert(e, cut, to[cut]), np.insert(row, cut + 1, row[cut])
    value = hashes(low, s, e)
    start = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
    stops, digits = np.append(0, np.cumsum(_STOP[data])), np.append(0, np.cumsum(digit))
    before = np.append(0, e[:-1]) if len(e) else e
    opens = start | (stops[s] > stops[before])
    number = (digits[e] - digits[s] == e - s) | _is_in(value, _NUMBER_WORDS) if len(s) else np.zeros(0, bool)
    unit = np.zeros(len(s), bool)
    if len(s) > 1:
        unit[1:] = number[:-1] & ~start[1:] & _is_in(value[1:], _UNITS)
    upper = capital[s] & ~number & ~unit if len(s) else np.zeros(0, bool)
    name, opening = upper & ~opens, upper & opens
    template = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, value)))
    slot = number | unit | name
    solid = ~_SPACE[data]
    places = np.append(0, np.cumsum(solid))
    packed = places[s], places[e], low[solid]
    n = len(s) - WINDOW + 1
    if n <= 0:
        none, no = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return Templates(value, row, slot, opening, none, none.astype(bool), no, no, template, *packed)
    count = np.append(0, np.cumsum(~slot))
    first = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    eligible = count[first + WINDOW] - count[first] >= WORDS
    return Templates(value, row, slot, opening, first, eligible, _windows(template)[first], _windows(np.where(opening, NAME, template))[first], template, *packed)


class Table:
    """The windows of a block of benchmark items, by hash."""

    def __init__(self, ids: list, column):
        t = templates(column)
        begins = np.searchsorted(t.row, np.arange(len(ids)))
        # The first token may have another case within a document, so windows that hold it do not count, if others remain.
        first, window, named = t.first[t.eligible], t.window[t.eligible], t.named[t.eligible]
        item = t.row[first] if len(first) else np.zeros(0, np.int64)
        inner = first > begins[item] if len(item) else np.zeros(0, bool)
        has = np.bincount(item[inner], minlength=len(ids)) > 0
        use = inner | ~has[item] if len(item) else inner
        self.total = np.bincount(item[use], minlength=len(ids))
        both = use & (named != window)
        self.hash, self.item, self.first = (np.concatenate([x[use], y[both]]) for x, y in ((window, named), (item, item), (first, first)))
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.first = self.hash[order], self.item[order], self.first[order]
        self.value, self.slot, self.opening, self.ids, self.template = t.value, t.slot, t.opening, ids, t.template
        # Items without a window, by number of tokens and form (values, or templates if they have words): sorted hashes, and the items.
        self.whole: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}
        self.begins, lengths = begins, np.bincount(t.row, minlength=len(ids)) if len(t.row) else np.zeros(len(ids), np.int64)
        words = np.bincount(t.row[~t.slot], minlength=len(ids)) if len(t.row) else lengths
        self.verbatim = words < WORDS
        short = np.flatnonzero((self.total == 0) & (lengths > 0))
        sums = _forms(t)
        self.text = np.zeros(len(ids), np.uint64)
        self.text[short] = hashes(t.packed, t.begin[begins[short]], t.end[begins[short] + lengths[short] - 1])
        for n in np.unique(lengths[short]).tolist():
            for form in (False, True):
                mine = short[(lengths[short] == n) & ~(form & self.verbatim[short])]
                h = slices(sums[form], begins[mine], begins[mine] + n)
                order = np.argsort(h, kind="stable")
                if len(mine):
                    self.whole[n, form] = h[order], mine[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hash & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def matches(self, column, share: float = SHARE) -> list[tuple]:
        """(row, item id, windows, matched, slots, changed slots) of the texts that contain an item consistently."""
        t = templates(column)
        return self._by_windows(t, share) + self._by_whole(t)

    def _by_whole(self, t: Templates) -> list[tuple]:
        """Items without a window: equal templates, then equal texts or slots that agree exactly."""
        best: dict[tuple, tuple] = {}
        sums = _forms(t) if self.whole else None
        for (n, form), (known, items) in self.whole.items():
            at = np.flatnonzero(t.row[: len(t.row) - n + 1] == t.row[n - 1 :]) if len(t.row) >= n else np.zeros(0, np.int64)
            if not len(at):
                continue
            h = slices(sums[form], at, at + n)
            near = _is_in(h, known)
            at, h = at[near], h[near]
            text = hashes(t.packed, t.begin[at], t.end[at + n - 1])
            for a, x, lo, hi in zip(at.tolist(), text.tolist(), np.searchsorted(known, h, "left").tolist(), np.searchsorted(known, h, "right").tolist(), strict=True):
                for item in items[lo:hi].tolist():
                    k = slice(self.begins[item], self.begins[item] + n)
                    slots = self.slot[k] | self.opening[k]
                    mine, yours = self.value[k][slots], t.value[a : a + n][slots]
                    words = ~slots & ~t.opening[a : a + n]
                    same = (self.template[k][words] == t.template[a : a + n][words]).all()
                    if int(self.text[item]) == x if self.verbatim[item] else same and self._consistent(mine, yours, 1.0):
                        key, changed = (int(t.row[a]), item), len(np.unique(mine[mine != yours]))
                        if key not in best or changed < best[key][5]:
                            best[key] = (key[0], self.ids[item], 1, 1, len(np.unique(self.value[k][self.slot[k]])), changed)
        return list(best.values())

    def _by_windows(self, t: Templates, share: float) -> list[tuple]:
        both = t.named != t.window
        window, first = np.append(t.window, t.named[both]), np.append(t.first, t.first[both])
        near = np.flatnonzero(self.seen[(window & np.uint64((1 << 20) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hash, window[near], "left"), np.searchsorted(self.hash, window[near], "right")
        count = hi - lo
        if not count.sum():
            return []
        which = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        there = np.repeat(first[near], count)
        pair = t.row[there] * len(self.ids) + self.item[which]
        shift = there - self.first[which]
        order = np.lexsort((there, shift, pair))
        pair, which, there, shift = pair[order], which[order], there[order], shift[order]
        once = np.append(True, (pair[1:] != pair[:-1]) | (shift[1:] != shift[:-1]) | (there[1:] != there[:-1]))  # one may agree in both forms
        pair, which, there, shift = pair[once], which[once], there[once], shift[once]
        # A run of windows at nearly the same distance holds one or more occurrences; each chain through it is checked on its own.
        new = np.append(True, (pair[1:] != pair[:-1]) | (shift[1:] - shift[:-1] > DRIFT))
        best: dict[int, tuple] = {}
        for a, b in zip(np.flatnonzero(new).tolist(), [*np.flatnonzero(new)[1:].tolist(), len(pair)], strict=True):
            row, item = divmod(int(pair[a]), len(self.ids))
            if len(np.unique(self.first[which[a:b]])) < share * self.total[item]:
                continue
            for chain in _chains(self.first[which[a:b]], there[a:b]):
                found = self._checked(which[a:b][chain], there[a:b][chain], t, item, share)
                if found and (pair[a] not in best or (found[0], -found[2]) > (best[pair[a]][3], -best[pair[a]][5])):
                    best[pair[a]] = (row, self.ids[item], int(self.total[item]), *found)
        return list(best.values())

    def _checked(self, which: np.ndarray, there: np.ndarray, t: Templates, item: int, share: float) -> tuple[int, int, int] | None:
        """matched, slots and changed slots of windows aligned one to one, if they are enough and consistent."""
        if len(which) < share * self.total[item]:
            return None
        k = np.arange(WINDOW)
        mine, yours = self.first[which][:, None] + k, there[:, None] + k
        slots, opening, mine, yours = self.slot[mine], self.opening[mine], self.value[mine], t.value[yours]
        if (mine != yours)[opening].any():
            # An opening word that differs counts as a name, where it has the usual partner of that name.
            keys, n = np.unique(np.stack([mine[slots | opening], yours[slots | opening]]), axis=1, return_counts=True)
            partner = dict(zip(*keys[:, np.argsort(n, kind="stable")].tolist(), strict=True))
            usual = np.array([[partner.get(x, x) for x in r] for r in mine.tolist()], np.uint64)
            stay = ~(opening & (yours != usual)).any(axis=1)
            if stay.sum() < share * self.total[item]:
                return None
            slots, mine, yours = (slots | opening & (usual != mine))[stay], mine[stay], yours[stay]
            which = which[stay]
        mine, yours = mine[slots], yours[slots]
        if not self._consistent(mine, yours, share):
            return None
        return len(which), len(np.unique(mine)), len(np.unique(mine[mine != yours]))

    @staticmethod
    def _consistent(mine: np.ndarray, yours: np.ndarray, share: float) -> bool:
        """Whether each value of the item has one partner, but for a share of its places, and the other way round."""
        for x, y in ((mine, yours), (yours, mine)):
            keys, n = np.unique(np.stack([x, y]), axis=1, return_counts=True) if len(x) else (np.zeros((2, 0)), np.zeros(0, int))
            total: dict = {}
            for v, c in zip(keys[0].tolist(), n.tolist(), strict=True):
                most, every = total.get(v, (0, 0))
                total[v] = (max(most, c), every + c)
            if any(most < share * every for most, every in total.values()):
                return False
        return True


def _chains(first: np.ndarray, there: np.ndarray):
    """Index arrays of matches that grow in item and text: each exact shift, and the best chain that ends at each shift.

    A chain may change its shift by ``DRIFT`` at once, for a quarter of a window.
    """
    shift = there - first
    values, state = np.unique(shift, return_inverse=True)
    for k in range(len(values)):
        yield np.flatnonzero(state == k)
    if len(values) == 1:
        return
    order = np.lexsort((there, first))
    ends = np.append(np.flatnonzero(np.diff(first[order])) + 1, len(order))
    score, last = np.full(len(values), -np.inf), np.full(len(values), -1)
    before, begin = np.full(len(first), -1), 0
    lo, hi = np.searchsorted(values, values - DRIFT), np.searchsorted(values, values + DRIFT, "right")
    for end in ends.tolist():
        group, begin = order[begin:end], end
        news = []
        for m in group.tolist():
            k = state[m]
            near = np.arange(lo[k], hi[k])
            gain = score[near] - 0.25 * (near != k)
            gain[(last[near] < 0) | (there[last[near]] >= there[m])] = 0
            j = int(np.argmax(gain))
            news.append((k, m, max(0.0, float(gain[j])) + 1, int(last[near[j]]) if gain[j] > 0 else -1))
        for k, m, gain, back in news:
            score[k], last[k], before[m] = gain, m, back
    for m in last[last >= 0].tolist():
        chain = []
        while m >= 0:
            chain.append(m)
            m = int(before[m])
        yield np.array(chain[::-1])


def _tables(benchmark: DataFrame):
    """The benchmark's blocks, each of about ``BLOCK_BYTES``, as broadcast tables."""
    rows = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for k in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        yield benchmark.sparkSession.sparkContext.broadcast(Table(got.column("item_id").to_pylist(), got.column("text")))


def find(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, coverage, n_slots, n_changed: a row for each item that a document contains.

    ``n_changed`` counts the item's slot values that differ in the document; over 0 means a
    re-parameterised question.  An item without a window (fewer than five tokens, or fewer than
    three words in each five) counts as one.  Null and empty texts, items without a token and empty
    tables give no rows.  Repeated documents and items are each reported.  Other columns are not read.
    """
    schema = "doc_id long, item_id long, n_windows long, n_matched long, coverage double, n_slots long, n_changed long"

    def over(table):
        def run(batches):
            for part in pieces(batches):
                ids = part.column("doc_id").to_pylist()
                found = [(ids[r], i, n, m, m / n, s, c) for r, i, n, m, s, c in table.value.matches(part.column("text"), share)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64() if k == 4 else pa.int64()) for k, x in enumerate(zip(*found, strict=True))], [f.split()[0] for f in schema.split(", ")])

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for table in _tables(benchmark):
        part = rows.mapInArrow(over(table), schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """``docs`` without the documents that contain an item; all columns stay."""
    at = docs.columns.index("text")

    def over(table):
        def run(batches):
            for part in pieces(_placed(batches, at), column="_text"):
                keep = np.ones(part.num_rows, bool)
                keep[[m[0] for m in table.value.matches(part.column("_text"), share)]] = False
                part = pa.RecordBatch.from_arrays(part.columns[:-1], part.schema.names[:-1])
                yield part.filter(pa.array(keep))

        return run

    for table in _tables(benchmark):
        docs = docs.mapInArrow(over(table), docs.schema)
    return docs


def _placed(batches, at: int):
    """Batches with the text once more as the last column, under a name of its own."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, b.column(at)], [*(f"c{i}" for i in range(b.num_columns)), "_text"])
