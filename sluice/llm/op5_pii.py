"""Personal data: high-recall candidates, boosted trees on format and context, calibrated thresholds.

Generators propose spans that may overlap: everything that looks roughly like an e-mail
address, an IP address, a card number or a phone number, in strict and loose spellings.
Boosted trees score each candidate from its format and the text around it, never from the
checks below; a threshold for each kind, calibrated on the documents that the trees did
not see, selects redactions.  Every document counts: two thirds, by hash of doc_id, in the
trees, the others in the thresholds.

Spans of the base formats that pass their checks (see ``base_spans``) are always selected.
Labels of the other candidates come from evidence that the trees do not see: a loose
spelling is positive if its normal form passes the check of its kind, and, where that is
weak (numbers without a plus sign, lists of small numbers), a cue word stands before it.
As loose spellings are rare in a corpus, all checked spans are also rewritten to
them in place; parts of these are negative.  Thresholds are calibrated on candidates that
are not base spans alone, so a kind whose candidates cannot be told apart adds nothing.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import training
from .shared import Scratch
from .textbytes import pieces
from .trees import boost, sums

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
LEVELS = 1 << 14  # steps of the thresholds

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match that fails at the first of several digits fails at all
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str):
    """Leftmost matches of the e-mail format: found from each @, so long runs of letters cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = after = m.end()
        at = text.find("@", after)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base formats that pass their checks, by kind and start; leftmost and not overlapping in a kind."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


# Loose spellings: spaces, brackets or words for the signs of an address, other separators between digits.
_AT, _DOT = r"(?:@| @ | ?\(at\) ?| ?\[at\] ?| ?\(@\) ?| ?\[@\] ?)", r"(?:\.| \. | ?\(dot\) ?| ?\[dot\] ?| ?\(\.\) ?| ?\[\.\] ?)"
_LOOSE = (
    ("email", re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,8}}")),
    ("ip", re.compile(rf"(?<![0-9.])[0-9]{{1,4}}(?:(?:,|{_DOT})[0-9]{{1,4}}){{3}}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[\x20._/-]?[0-9]){11,22}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:\+|00)?\(?[0-9]{1,4}[\x20()./-]{1,3}[0-9]{2,4}[\x20./-]{1,2}[0-9]{2,4}(?:[\x20./-]{1,2}[0-9]{2,4}){0,3}(?![0-9])")),
)
_NEEDS = {"email": re.compile(r"@|\(at\)|\[at\]"), "ip": _DIGIT, "card": _DIGIT, "phone": _DIGIT}
# Words that announce a span of a kind.
_CUES = {
    "email": re.compile(r"mail|contact|write|address|adresse|correo|courriel", re.I), "ip": re.compile(r"\bip\b|host|server|address|adresse|serveur|servidor", re.I),
    "card": re.compile(r"card|visa|master|amex|karte|carte|tarjeta|payment", re.I), "phone": re.compile(r"tel|phone|call|fax|mobil|anruf|appel|llam", re.I),
}
_BRACKETS = re.compile(r"[(\[](?:at|dot|@|\.)[)\]]")


def _normal(kind: str, part: str) -> str:
    """A loose spelling with the signs of the base format."""
    if kind == "email":
        return re.sub(_DOT, ".", re.sub(_AT, "@", part))
    if kind == "ip":
        return re.sub(_DOT, ".", part).replace(",", ".")
    if kind == "card":
        return re.sub(r"[._/]", "", part)
    return "+" + re.sub(r"^\+|^00", "", part).replace("/", "-")


def agrees(text: str, span: tuple[str, int, int]) -> bool:
    """The label of a candidate that is no base span: its normal form passes the check, with a cue word before it where numbers alone say little."""
    kind, s, e = span
    normal, before = _normal(kind, text[s:e]), text[max(0, s - 24) : s]
    if (kind, 0, len(normal)) not in base_spans(normal):
        return False
    if kind == "phone" and not text[s:e].startswith(("+", "00")) or kind == "ip" and "," in text[s:e]:
        return bool(_CUES[kind].search(before))
    return kind != "email" or text[s:e] != normal


def rewritten(kind: str, part: str, k: int) -> str:
    """A checked span in one of several loose spellings; ``k`` picks one."""
    if kind == "email":
        at, dot = ((" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), (" @ ", " . "), ("[@]", "[.]"))[k % 5]
        name, _, host = part.partition("@")
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return part.replace(".", ("[.]", "(.)", " . ", "[dot]")[k % 4])
    digits = re.sub(r"[^0-9]", "", part)
    if kind == "card":
        return ("._/"[k % 3]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    head, rest = digits[: max(1, len(digits) - 10)], digits[max(1, len(digits) - 10) :]
    return (f"00{head} {rest[:3]} {rest[3:6]} {rest[6:]}", f"00{head}-{rest[:3]}-{rest[3:6]}-{rest[6:]}", f"+{head} {rest[:3]}/{rest[3:6]}/{rest[6:]}", f"00{head}.{rest[:3]}.{rest[3:6]}.{rest[6:]}")[k % 4]


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """All proposed spans, base formats (checked or not) and loose ones; they may overlap."""
    found = dict.fromkeys(base)
    for kind, pattern in _LOOSE:
        if _NEEDS[kind].search(text):
            found |= dict.fromkeys((kind, *m.span()) for m in pattern.finditer(text))
    if _DIGIT.search(text):
        found |= dict.fromkeys(("ip", *m.span()) for m in _IP.finditer(text))
        found |= dict.fromkeys(("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12)
        found |= dict.fromkeys(("phone", *m.span()) for m in _PHONE.finditer(text))
    return list(found)


N_FEATURES = 24


def features(text: str, span: tuple[str, int, int]) -> list[float]:
    """Format and context of a candidate; nothing that repeats the checks of ``base_spans``."""
    kind, s, e = span
    part = text[s:e][:256]
    before, after = text[max(0, s - 24) : s], text[e : e + 24]
    groups = re.findall(r"[0-9]+", part)
    sizes = [len(g) for g in groups] or [0]
    digits = sum(sizes)
    return [
        float(KINDS.index(kind)), e - s, digits, len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], part.count(" "), part.count("-"), part.count("."),
        float("(" in part), float(part.startswith("+")), float(part[:1] in "456"), sum(c.isalpha() for c in part) / len(part),
        float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after), float(after[:1] in ".,;:)"),
        sum(c.isdigit() for c in before + after), float(bool(re.search(r"\.[A-Za-z]{2,6}$", part))),
        float("@" in part), len(_BRACKETS.findall(part)), float(bool(_CUES[kind].search(before))), float(part.startswith("00")) + part.count("/"),
    ]


class Selector:
    """Trees and a threshold for each kind; ``add`` gives the spans that the method adds to the base."""

    def __init__(self, start: float, trees: list, limits: dict[str, float]):
        self.start, self.trees, self.limits = start, trees, limits

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for t in self.trees:
            z += t.predict(x)
        return 1 / (1 + np.exp(-z))

    def add(self, texts: list[str], bases: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
        """For each text the added spans: above their kind's threshold, best first, none overlapping another selected one."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        rows, what = [], []
        for i, (text, base) in enumerate(zip(texts, bases, strict=True)):
            known = set(base)
            for c in candidates(text, base):
                if c not in known:
                    rows.append(features(text, c))
                    what.append((i, c))
        if not rows:
            return out
        score = self.scores(np.array(rows, float))
        for k in np.argsort(-score, kind="stable"):
            i, (kind, s, e) = what[k]
            if score[k] >= self.limits[kind] and not any(s < y and x < e for _, x, y in [*bases[i], *out[i]]):
                out[i].append((kind, s, e))
        return out


HELD, BASE, KIND = 1, 2, 4  # marks of a candidate: for the thresholds; a base span; steps of its kind


def fit(x: np.ndarray, y: np.ndarray, base: np.ndarray, precision: float = PRECISION) -> Selector:
    """``fit_rows`` on arrays; every third row is for the thresholds."""
    part = (np.arange(len(y)) % 3 == 2) * HELD + base.astype(bool) * BASE + x[:, 0].astype(np.int64) * KIND
    return fit_rows(training.of_arrays(x, y, part), precision)


def _levels(block: training.Block, start: float, trees: list) -> np.ndarray:
    """Of the candidates for the thresholds: how many, and how many with label 1, by kind and score."""
    on = block.part & (HELD | BASE) == HELD
    score = 1 / (1 + np.exp(-sums(block, start, trees)[on]))
    spot = (block.part[on] // KIND).astype(np.int64) * LEVELS + np.minimum((score * LEVELS).astype(np.int64), LEVELS - 1)
    return np.stack([np.bincount(spot, w, len(KINDS) * LEVELS) for w in (None, block.y[on])]).astype(np.int64).ravel()


def fit_rows(rows: training.Rows, precision: float = PRECISION) -> Selector:
    """Trees on the rows without the mark ``HELD``; on the others, without base spans, the lowest threshold of each kind whose candidates above it reach ``precision``.

    A kind without twenty such candidates there adds nothing.
    """
    start, trees = boost(rows, 40, 3, skip=HELD)
    model = Selector(start, trees, {})
    got = np.resize(rows.total(functools.partial(_levels, start=start, trees=trees)), 2 * len(KINDS) * LEVELS).reshape(2, len(KINDS), LEVELS)
    for k, kind in enumerate(KINDS):
        n, right = (np.cumsum(v[::-1])[::-1] for v in got[:, k])
        good = np.flatnonzero((n >= 20) & (right >= precision * n) & (got[0, k] > 0))
        model.limits[kind] = max(0.5, float(good[0] / LEVELS)) if len(good) else 2.0
    return model


def examples(text: str) -> list[tuple[bool, float, list[float]]]:
    """Candidates of a text and of its checked spans rewritten: whether a base span, label, features."""
    base = base_spans(text)
    known = set(base)
    out = [(c in known, float(c in known or agrees(text, c)), features(text, c)) for c in candidates(text, base)]
    for kind, s, e in base:
        k = zlib.crc32(text[s:e].encode()) + s
        for j in range(2):
            part = rewritten(kind, text[s:e], k + j)
            left = text[max(0, s - 80) : s]
            near = left + part + text[e : e + 80]
            whole = (kind, len(left), len(left) + len(part))
            if any(x == kind and a < whole[2] and whole[1] < z for x, a, z in base_spans(near)):
                continue  # still a base span, or one in part
            for c in dict.fromkeys([*candidates(near, []), whole]):
                if c[1] < whole[2] and whole[1] < c[2]:
                    out.append((False, float(c == whole), features(near, c)))
    return out


def train(docs: DataFrame, local: int = training.LOCAL) -> Selector:
    """Fit on the candidates of all documents; of up to ``local`` candidates the binned features come to the driver."""
    scratch = Scratch(docs.sparkSession, "spans")

    def run(batches):
        for part in pieces(batches):
            x, y, marks = [], [], []
            for held, text in zip(part.column("held").to_pylist(), part.column("text").to_pylist(), strict=True):
                for base, label, values in examples(text) if text else ():
                    x.append(values)
                    y.append(label)
                    marks.append(held * HELD + base * BASE + int(values[0]) * KIND)
                if len(y) >= training.BLOCK:
                    yield training.raw(np.array(x, float), np.array(y), np.array(marks))
                    x, y, marks = [], [], []
            if y:
                yield training.raw(np.array(x, float), np.array(y), np.array(marks))

    held = (F.pmod(F.xxhash64(F.lit("pii"), F.col("doc_id").cast("long")), F.lit(3)) == 2).cast("int")
    table = scratch.keep(docs.select(held.alias("held"), "text").mapInArrow(run, training.RAW), "candidates")
    model = fit_rows(training.of_table(table, N_FEATURES, scratch, local))
    scratch.clear()
    return model


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def find(docs: DataFrame, model: Selector | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each row, by whole texts.

    Null and empty texts have no spans.  Repeated rows give equal rows.  Columns other
    than doc_id and text are not read.  Offsets are code points, ends are exclusive.
    """
    model = model or train(docs)

    def run(batches):
        for part in pieces(batches):
            texts = ["" if x is None else x for x in part.column("text").to_pylist()]
            bases = [base_spans(t) for t in texts]
            added = model.add(texts, bases)
            counts = [pa.array([sum(x[0] == k for x in b) for b in bases], pa.int64()) for k in KINDS]
            sums = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in bases])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, sums, pa.array([_joined(b + a) for b, a in zip(bases, added, strict=True)], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Selector | None = None) -> DataFrame:
    """``docs`` with selected spans of ``text`` replaced; all columns stay, n_chars follows the text if there is one.

    A null text stays null.
    """
    model = model or train(docs)
    at, schema = docs.columns.index("text"), docs.schema
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for part in pieces(batches):
            texts = part.column(at).to_pylist()
            full = ["" if x is None else x for x in texts]
            bases = [base_spans(t) for t in full]
            new = [None if o is None else redact_text(t, b + a) if a or b else t for o, t, b, a in zip(texts, full, bases, model.add(full, bases), strict=True)]
            columns = list(part.columns)
            columns[at] = pa.array(new, columns[at].type)
            if chars is not None:
                columns[chars] = pa.array([None if t is None else len(t) for t in new], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(run, schema)
