"""Each operator against a brute-force version on small, awkward tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.llm import op1_templates, op2_vectors, op3_suffixes, op4_quality, op5_pii, op6_tokens, op7_pieces, op8_minhash, op9_urls, op10_html
from sluice.llm.queries import URL_RULES, _vocabulary
from sluice.llm.shared import Scratch

SCHEMA = "doc_id long, text string, lang string, key string, score double, id long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _texts():
    r = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(30, 120))) for _ in range(12)]
    out = [None, "", " \n\t ", "one", "One", "two words", "é ü 日本 😀 ▁x", "a" * 700, "ab " * 300, " ".join(r.choice(words) for _ in range(4000))]
    for b in base:
        out += [b, b]
        for _ in range(3):
            w = b.split()
            for _ in range(r.randint(1, 8)):
                w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w))
    shared = " ".join(r.choice(words) for _ in range(60))
    out += [f"{r.random()} {shared} {r.random()}" for _ in range(5)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "k", 0.5, 1) for i, t in enumerate(_texts())]
    rows += [rows[20], rows[1], (None, "no id here", "en", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def _components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("width", [2, 5])
def test_minhash(docs, empty, width):
    rows = sorted((r for r in _rows(docs) if r[0] is not None), key=lambda r: r[0])
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    same = lambda i, j: bool(sets[i] & sets[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    root = _components(len(rows), same)
    want = sorted((rows[i][0], len(sets[i]), rows[root[i]][0]) for i in range(len(rows)))
    got = op8_minhash.near_duplicates(docs, width).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == want
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert op8_minhash.near_duplicates(empty, width).count() == 0
    kept = op8_minhash.keep_one(docs, width)
    assert kept.columns == docs.columns


def test_frequent_keys_are_dealt(spark, docs, monkeypatch):
    """The same result if nearly every key counts as frequent and every bucket as large."""
    from sluice.llm import shared

    want = sorted(map(str, op8_minhash.near_duplicates(docs, 2).collect()))
    monkeypatch.setattr(shared, "PART", 1)
    monkeypatch.setattr(op8_minhash, "BLOCK", 2)
    assert sorted(map(str, op8_minhash.near_duplicates(docs, 2).collect())) == want
    monkeypatch.setattr(shared, "FEW", 1)
    left, right = spark.range(40).selectExpr("id % 3 as k", "id as v"), spark.range(3).selectExpr("id as k", "id * 2 as w")
    assert sorted(map(tuple, shared.join_split(left, right, "k", "v", 40).collect())) == sorted((i % 3, i, i % 3 * 2) for i in range(40))


def test_minhash_buckets_without_links(spark):
    r = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(60))
    d = spark.createDataFrame([(i, passage + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(18))) for i in range(300)], "doc_id long, text string")
    assert op8_minhash.near_duplicates(d, 2).where("kept").count() == 300


def _without_repeats(rows, length):
    seen: dict[bytes, int] = {}
    for _, b in rows:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for d, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "hot"), [(40, 4000), (200, 4000), (200, 3)])
def test_suffixes(docs, empty, length, hot, monkeypatch):
    monkeypatch.setattr(op3_suffixes, "HOT", hot)
    rows = [(d, (t or "").encode()) for d, t in _rows(docs)]
    assert sorted((tuple(r) for r in op3_suffixes.remove_repeats(docs, length).collect()), key=str) == _without_repeats(rows, length)
    assert op3_suffixes.remove_repeats(empty, length).count() == 0


def test_suffixes_of_a_frequent_line(spark, monkeypatch):
    """A line of 150 bytes among 400 surroundings, of which some repeat: its names are more frequent than a task takes."""
    monkeypatch.setattr(op3_suffixes, "HOT", 50)
    r = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz "
    some = ["".join(r.choice(letters) for _ in range(300)) for _ in range(30)]
    line = "".join(r.choice(letters) for _ in range(150))
    side = lambda: r.choice(some)[: r.randrange(60)] if r.random() < 0.3 else "".join(r.choice(letters) for _ in range(r.randrange(300)))
    texts = [(side()[::-1] if r.random() < 0.5 else side()) + line + side() for _ in range(400)]
    texts += ["".join(r.choice(letters) for _ in range(20)) + line + line + side() for _ in range(60)]
    got = op3_suffixes.remove_repeats(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)).collect()
    assert sorted((tuple(x) for x in got), key=str) == _without_repeats([(i, t.encode()) for i, t in enumerate(texts)], 200)


def test_repeats_equal_all_pairs():
    r = random.Random(1)
    for _ in range(150):
        left, length = r.choice([(5, 9), (0, 4), (12, 20)])
        n, base = r.randint(1, 40), [bytes(r.choice(b"ab") for _ in range(left + length)) for _ in range(3)]
        rows = []
        for _ in range(n):
            x, back, after = bytearray(r.choice(base)), r.randint(0, left), r.randint(1, length)
            for _ in range(r.randint(0, 3)):
                x[r.randrange(len(x))] = r.choice(b"ab\0")
            x[: left - back], x[left + after :] = bytes(left - back), bytes(length - after)
            rows.append((r.randint(0, 2), list(x), max(0, length - after), back, r.choice([1, 1, 1, 2])))
        rows.sort(key=lambda x: x[0])
        place, m, low, high, weight = (np.array(x) for x in zip(*rows, strict=True))
        got = op3_suffixes._repeats(np.unique(place, return_inverse=True)[1], m.astype(np.uint8), left, length, low, high, weight)
        for i in range(n):
            for d in range(left + 1):
                same = (j for j in range(n) if j != i and place[j] == place[i] and low[j] <= d <= high[j] and rows[j][1][left - d :][:length] == rows[i][1][left - d :][:length])
                assert got[i, d] == (low[i] <= d <= high[i] and (weight[i] == 2 or next(same, None) is not None))


def test_difference_cover():
    for length in (3, 20, 200, 500):
        v, d = op3_suffixes.cover(length)
        assert op3_suffixes._covers(d.tolist(), v) and v <= length


def test_vectors(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((60, 16))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(100 + i, (v + 0.1 * r.standard_normal(16)).tolist(), 1) for i, v in enumerate(np.repeat(x[:6], 5, 0))]
    rows += [(200, x[0].tolist(), 1), (201, (3 * x[1]).tolist(), 1), (202, None, 1), (203, [0.0] * 16, 1), (204, [float("nan")] * 16, 1), (205, [None, 1.0], 1), (206, [1.0, 0.0], 1), (207, [], 1), (208, [float("inf")] * 16, 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = [(i, np.array(v) / np.linalg.norm(v)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    linked = {(a, b) for a, u in good for b, w in good if a != b and len(u) == len(w) and u @ w >= 0.9}
    for block in (1500, 4):
        got = {q.vec_id: (q.n_links, q.component_id) for q in op2_vectors.near_duplicates(d, 0.9, block=block).collect()}
        assert len(got) == len(rows)
        ids = sorted(got)
        root = _components(len(ids), lambda i, j: (ids[i], ids[j]) in linked)  # noqa: B023
        assert got == {v: (sum(a == v for a, _ in linked), ids[root[k]]) for k, v in enumerate(ids)}
    assert op2_vectors.near_duplicates(d.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [2.0, 4.1]), (9, [0.0, 1e300]), (3, [0.0, 1e-300])], "vec_id long, embedding array<double>").withColumn("component_id", F.lit(1))
    got = sorted((q.vec_id is None, q.vec_id or 0, q.n_links, q.component_id, q.kept) for q in op2_vectors.near_duplicates(odd).collect())
    assert got == [(False, 3, 1, 3, True), (False, 7, 2, 7, True), (False, 7, 2, 7, True), (False, 8, 2, 7, False), (False, 9, 1, 3, False), (True, 0, 0, None, True)]


def test_vectors_near_the_threshold(spark):
    """Recall of pairs with a cosine of 0.90 to 0.92 among unrelated vectors."""
    r = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(r.standard_normal((1500, 64)))
    y = r.standard_normal((1500, 64))
    y = unit(y - (x * y).sum(1, keepdims=True) * x)
    c = r.uniform(0.9005, 0.92, (1500, 1))
    both = np.concatenate([x, c * x + np.sqrt(1 - c * c) * y])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    assert op2_vectors.near_duplicates(d).where("n_links > 0").count() >= 2 * 1500 * 0.999


def test_quality(spark, docs, empty):
    r = random.Random(3)
    good = [" ".join(r.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(50)) + "." for _ in range(80)]
    bad = [" ".join(f"{r.choice('abcdef')}{r.choice('$%&')}{r.choice('$%&')}" for _ in range(50)) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(160)] + [(5, None), (None, 1)], "doc_id long, quality int")
    got = {q.doc_id: q for q in op4_quality.classify(d, labels).collect()}
    for i in range(160):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].predicted == int(i < 80) == int(got[i].score >= 0.7)
    assert 0 <= got[900].score <= 1 and got[900].score == got[901].score
    assert op4_quality.classify(docs, labels.limit(0)).where("score != 0.5").count() == 0
    assert op4_quality.classify(empty, labels).count() == 0
    assert op4_quality.keep_good(d.withColumn("score", d.doc_id), labels).columns == ["doc_id", "text", "score"]
    odd = d.withColumns({"_q": F.lit(1), "_q_digits": F.lit("x"), "_Q_": F.lit(None)})
    kept = op4_quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and {q.doc_id for q in kept.collect()} >= set(range(80)) and not {q.doc_id for q in kept.collect()} & set(range(80, 160))
    assert op4_quality.classify(odd, labels, keep=("doc_id", "_q_digits")).count() == len(rows)
    both = op4_quality.classify(d.unionByName(spark.createDataFrame([(950, "x " * 200_000), (951, "y" * 300_000), (0, rows[0][1])], "doc_id long, text string")), labels.unionByName(spark.createDataFrame([(3, 0), (3, 1), (4, 7)], "doc_id long, quality int")))
    assert all(0 <= q.score <= 1 for q in both.collect()) and len({q.score for q in both.where("doc_id = 0").collect()}) == 1
    x = op4_quality.statistics(pa.array(good + bad))
    rules = op4_quality.fit(x, np.array([1.0] * 80 + [0.0] * 80))
    have = {q.doc_id: q.s for q in op4_quality.with_statistics(d, ["doc_id"]).select("doc_id", rules.column().alias("s")).collect()}
    assert np.allclose([have[i] for i in range(160)], rules.scores(x))


def test_pii_base_spans_equal_the_patterns():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def luhn(d):
        return sum(n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n) for i, n in enumerate(map(int, reversed(d)))) % 10 == 0

    def brute(t):
        out = [("email", *m.span()) for m in email.finditer(t)] + [("ip", *m.span()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        digits = lambda m: re.sub(r"\D", "", m[0])
        out += [("card", *m.span()) for m in card.finditer(t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
        return out + [("phone", *m.span()) for m in phone.finditer(t) if 8 <= len(digits(m)) <= 15]

    r = random.Random(3)
    parts = ["a", "b.", "@", "@", "1", "22", "255", ".", "-", " ", "+", "(", ")", "é", "4111 1111 1111 1111", "0", "%", "x@y.z", "+1 (2", "999"]
    for _ in range(5000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert op5_pii.base_spans(t) == brute(t)


def test_pii(spark, empty):
    d = spark.createDataFrame([(1, "mail a.b@c.org or +1 (415) 555-1234, card 4111 1111 1111 1111 at 10.0.0.1", 70), (2, None, None), (3, "", 0), (4, "plain words", 11)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in op5_pii.find(d).collect()}
    assert [got[1][k] for k in ("n_email", "n_ip", "n_card", "n_phone")] == [1, 1, 1, 1]
    assert got[1].spans == "email:5:14,ip:65:73,card:42:61,phone:18:35" and got[1].base_sha256 == hashlib.sha256(got[1].spans.encode()).hexdigest()
    assert got[2].spans == got[3].spans == got[4].spans == ""
    text = {r.doc_id: (r.text, r.n_chars) for r in op5_pii.redact(d).collect()}
    assert text[1][0] == "mail <email> or <phone>, card <card> at <ip>" and text[1][1] == len(text[1][0])
    assert text[2] == (None, None) and text[4] == ("plain words", 11)
    assert op5_pii.find(empty).count() == 0


def test_pii_thresholds_count_candidates_beyond_the_base():
    r = random.Random(4)
    texts = [f"card {r.randrange(10**15, 10**16)} x" for _ in range(900)]
    rows = [(op5_pii.features(t, c), float(k % 50 > 0)) for k, t in enumerate(texts) for c in op5_pii.candidates(t, []) if c[0] == "card"]
    x, y = np.array([x for x, _ in rows]), np.array([y for _, y in rows])
    model = op5_pii.fit(x, y, np.zeros(len(y), bool), precision=0.9)
    assert model.limits["card"] <= 1 and model.limits["email"] > 1
    assert model.add(["card 1234567890123456 x"], [[]]) == [[("card", 5, 21)]]
    assert min(op5_pii.fit(x, y, y > 0, precision=0.9).limits.values()) > 1


def test_pii_loose_spellings(spark):
    """What trees add on a table with planted spellings and with decoys, after fitting on that table."""
    r = random.Random(6)
    words = "the of and at in on home this line number list value mail call".split()
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def luhn(d):
        return next(d + c for c in "0123456789" if op5_pii._luhn(d + c))

    base = lambda: r.choice([f"{r.choice(words)}.{digits(2)}@mail{digits(1)}.example.com", ".".join(str(r.randrange(256)) for _ in range(4)), luhn("4" + digits(14)), f"+1 ({digits(3)}) 555-{digits(4)}"])
    texts = [f"{some(8)} {base()} {some(8)}" for _ in range(400)]
    planted = {}
    for _ in range(80):
        kind, part = r.choice([("email", f"{r.choice(words)}.{digits(2)} (at) mail (dot) org"), ("email", f"{r.choice(words)}{digits(2)}[at]mail{digits(1)}[dot]example[dot]com"), ("ip", "[.]".join(str(r.randrange(256)) for _ in range(4))), ("phone", f"001 {digits(3)} 555 {digits(4)}")])
        left = some(6) + " "
        planted[len(texts)] = f"{kind}:{len(left)}:{len(left) + len(part)}"
        texts.append(left + part + " " + some(6))
    some = lambda n: " ".join(r.choice(words[:-4]) for _ in range(n))  # noqa: E731  no cue word
    decoys = [f"{some(5)} {x} {some(5)}" for x in ["look @ this. And", "at home (at) noon", "1,2,3,4", "12 34 56 78", "4 of 5", "2024.01.02", "1-2-3", "version 1.2.3", "in 300.1.2.3 or", "1990 - 1995 - 2000"] for _ in range(8)]
    decoys += [f"{some(5)} {d} {some(5)}" for d in (digits(16) for _ in range(80)) if not op5_pii._luhn(d)]
    first = len(texts)
    texts += [*decoys, "9" * 200_000, "a@" * 20_000, texts[400]]
    planted[len(texts) - 1] = planted[400]
    d = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans int, n_email string").repartition(3)
    got = {x.doc_id: x for x in op5_pii.find(d).collect()}
    right = [i for i, span in planted.items() if got[i].spans == span]
    assert len(right) >= 0.9 * len(planted)
    assert not [got[i].spans for i in range(first, len(texts) - 1) if got[i].spans]
    for i, t in enumerate(texts):
        if i not in planted:
            assert [got[i][f"n_{k}"] for k in op5_pii.KINDS] == [sum(x[0] == k for x in op5_pii.base_spans(t)) for k in op5_pii.KINDS]
            assert got[i].spans == op5_pii._joined(op5_pii.base_spans(t))


def test_tokens(spark, docs, empty):
    from tokenizers import Tokenizer

    path = _vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(500, "<|endoftext|> don't we'll\r\n  x  "), (501, "  \u00a0\u2003 's 12ab½")], "doc_id long, text string")
    d = docs.select("doc_id", "text").unionByName(extra)
    scratch = Scratch(spark, "test")
    root = scratch.path("shards")
    manifest = scratch.keep(op6_tokens.write_ids(d, path, root), "manifest")
    got = op6_tokens.read_digests(spark, manifest, root).orderBy("start").collect()
    start, ids = 0, {}
    for r in got:
        assert r.start == start
        start += r.n_tokens
    want = []
    for k, x in _rows(d):
        ids[k] = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((k, len(ids[k]), zlib.crc32(ids[k].tobytes())))
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=str) == sorted(want, key=str)
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(r.doc_id for r in got if r.doc_id is not None)
    for r in manifest.collect():
        shard = op6_tokens.Shard(root, r.name)
        for k in set(shard.docs["doc_id"][shard.docs["null"] == 0].tolist()):
            assert all((x == ids[k]).all() for x in shard.of(k))
    none = scratch.keep(op6_tokens.write_ids(empty, path, scratch.path("none")), "manifest")
    assert op6_tokens.read_digests(spark, none, root).count() == 0


def test_shard_checksum(tmp_path):
    w = op6_tokens._Writer(f"file://{tmp_path}", 2)
    w.add(3, np.arange(50, dtype=np.uint32))
    w.close()
    raw = bytearray((tmp_path / w.name).read_bytes())
    shard = op6_tokens.Shard(f"file://{tmp_path}", w.name)
    assert shard.of(3)[0].tolist() == list(range(50)) and shard.of(4) == []
    raw[12] ^= 1
    (tmp_path / "bad.zst").write_bytes(raw)
    with pytest.raises(Exception):  # noqa: B017
        op6_tokens.Shard(f"file://{tmp_path}", "bad.zst").ids(0)


def test_pieces(docs, empty):
    model = _vocabulary("piece_bpe_32k.model")
    got = op7_pieces.encode(docs, model)
    rows = got.collect()
    assert all(r.lossless for r in rows) and len(rows) == docs.count()
    again = op7_pieces.encode(docs.repartition(5), model).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens, r.ids)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert any(a.ids != b.ids for a, b in zip(sorted(rows, key=key), sorted(op7_pieces.encode(docs, model, seed=2).collect(), key=key), strict=True))
    back = sorted([(r.doc_id, r.text) for r in op7_pieces.decode(got, model).collect()], key=str)
    assert back == sorted([(d, t or "") for d, t in _rows(docs)], key=str)
    assert op7_pieces.encode(empty, model).count() == 0


def test_pieces_of_long_words(spark):
    """One word of 120,000 letters, alone and beside others, has the same ids."""
    model, word = _vocabulary("piece_bpe_32k.model"), "abcdefghij" * 12_000
    alone = spark.createDataFrame([(5, word)], "doc_id long, text string")
    beside = alone.unionByName(spark.createDataFrame([(6, "x" * 40 + " " + "y" * 41), (7, word + "z")], "doc_id long, text string")).coalesce(1)
    one = op7_pieces.encode(alone, model).collect()[0]
    got = {r.doc_id: r for r in op7_pieces.encode(beside, model).collect()}
    assert one.lossless and got[5].ids == one.ids and all(r.lossless for r in got.values())


def test_pieces_are_drawn_in_proportion():
    import sentencepiece

    path = _vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = {sp.id_to_piece(i): i for i in range(259, sp.get_piece_size())}

    def ways(w):
        if not w:
            yield ()
        for k in range(1, len(w) + 1):
            if w[:k] in ids:
                yield from ((ids[w[:k]], *rest) for rest in ways(w[k:]))

    n = 20000
    drawn = [tuple(x) for x in op7_pieces.lattice(path, 0.5).sample(["them"] * n, op7_pieces.key_seeds(pa.array(range(n)), 9))]
    weight = {w: np.prod([(i - 259 + 10.0) ** -0.5 for i in w]) for w in ways("▁them")}
    total = sum(weight.values())
    for w, x in weight.items():
        assert abs(drawn.count(w) / n - x / total) < 0.015


def _thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_agree_in_polynomial_hashes(spark, n):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2**64, whatever the base."""
    from tokenizers import Tokenizer

    texts = [_thue_morse(n), _thue_morse(n, "b", "a")]
    d = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)
    path = _vocabulary("byte_bpe_50k.json")
    scratch = Scratch(spark, "test")
    root = scratch.path("shards")
    manifest = scratch.keep(op6_tokens.write_ids(d, path, root, n_shards=1), "manifest")
    tokenizer = Tokenizer.from_file(path)
    want = [zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for t in texts]
    assert [r.ids_crc32 for r in op6_tokens.read_digests(spark, manifest, root).orderBy("start").collect()] == want
    assert all(r.lossless for r in op7_pieces.encode(d, _vocabulary("piece_bpe_32k.model")).collect())
    assert op8_minhash.near_duplicates(d, 2).where("kept").count() == 2
    seen = {}
    for t in texts:
        for p in range(n - 199):
            seen[t[p : p + 200]] = seen.get(t[p : p + 200], 0) + 1
    gone = [len({q for p in range(n - 199) if seen[t[p : p + 200]] > 1 for q in range(p, p + 200)}) for t in texts]
    assert [r.n_removed for r in op3_suffixes.remove_repeats(d).orderBy("doc_id").collect()] == gone


def test_words_with_one_hash_are_told_apart(monkeypatch):
    """With a hash that tells nothing but lengths the ids are still the library's, and texts decode to themselves."""
    from tokenizers import Tokenizer

    from sluice.llm import bpe

    weak = lambda data, s, e: (e - s).astype(np.uint64)
    monkeypatch.setattr(bpe, "hashes", weak)
    path, texts = _vocabulary("byte_bpe_50k.json"), ["one two six", "red and blue", ""]
    assert [x.tolist() for x in bpe.Words(path).batch(texts)] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    real, calls = op7_pieces.hashes, []
    monkeypatch.setattr(op7_pieces, "hashes", lambda data, s, e: calls.append(1) or (weak if len(calls) == 1 else real)(data, s, e))
    op7_pieces.lattice.cache_clear()
    ids, same = op7_pieces.segmented(_vocabulary("piece_bpe_32k.model"), 1.0, texts, np.arange(3, dtype=np.uint64))
    op7_pieces.lattice.cache_clear()
    assert all(same) and len(calls) > 1 and op7_pieces.lattice(_vocabulary("piece_bpe_32k.model"), 1.0).decode(ids) == texts


def test_templates(spark, empty):
    q = "Alice bought 12 apples from the market near Paris. How many apples did Alice keep after giving 5 apples to Bob and losing 2 kg of them?"
    other = "Intro here. " + q.replace("Alice", "Carol").replace("12", "30").replace("Paris", "Rome").replace("5 ", "8 ").replace("Bob", "Dan") + " End."
    wrong = other.replace("giving 8 apples to Dan", "taking many pears off Dan").replace("market near", "shop by")
    bench = spark.createDataFrame([(1, q), (2, None), (3, "too short"), (1, q)], "item_id long, text string")
    d = spark.createDataFrame([(1, "x. " + q, 1), (2, other, 1), (3, wrong, 1), (4, None, 1), (5, "", 1), (2, other, 1)], "doc_id long, text string, item_id long")
    got = sorted({(r.doc_id, r.item_id, r.n_changed > 0) for r in op1_templates.find(d, bench).collect()})
    assert got == [(1, 1, False), (2, 1, True)]
    kept = op1_templates.decontaminate(d, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5] and kept.columns == d.columns
    assert op1_templates.find(empty, bench).count() == 0
    assert op1_templates.find(d, bench.limit(0)).count() == 0


def test_template_slots_must_agree():
    item = "we saw that Ann gave Bob a pear and then Ann told Bob to share it with Ann and Bob again today"
    bad = "we saw that Cid gave Dan a pear and then Eve told Fay to share it with Gil and Hal again today"
    table = op1_templates.Table([7], pa.array([item]))
    assert [m[1] for m in table.matches(pa.array([item.replace("Ann", "Cid")]))] == [7]
    assert table.matches(pa.array([bad])) == []


def test_templates_that_repeat():
    item = "Tom has 3 red apples and Jane has 5 red apples and Bob has 7 red apples"
    other = item.replace("Jane", "Eve").replace("3", "8").replace("5", "2").replace("7", "4")
    table = op1_templates.Table([7], pa.array([item]))
    found = table.matches(pa.array([item, other, f"{other} {item}"]))
    assert [(m[0], m[5] > 0) for m in found] == [(0, False), (1, True), (2, False)]
    long = " and ".join(f"w{i} x{i} Name{i} y{i}" for i in range(12))
    assert len(op1_templates.Table([7], pa.array([long])).matches(pa.array([long.replace("w6", "two more words w6")]))) == 1
    short = "we saw that Ann gave 3 pears to Bob and left"
    one, two = short.replace("Ann", "Cid").replace("3", "4"), short.replace("Ann", "Eve").replace("Bob", "Fay")
    assert len(op1_templates.Table([7], pa.array([short])).matches(pa.array([f"{one} {two} {one}"]))) == 1


def test_template_names_and_numbers_of_all_forms():
    def found(item, text):
        return [m[5] > 0 for m in op1_templates.Table([7], pa.array([item])).matches(pa.array([text]))]

    item = "Tom has 12 apples. Tom buys 5 more apples. Tom gives 3 apples to Bob. How many apples does Tom have now?"
    assert found(item, item) == [False] and found(item, item.lower().replace("tom", "Tom").replace("bob", "Bob")) == [False]
    assert found(item, item.replace("Tom", "Ann")) == found(item, "Now " + item.replace("Tom", "Šárka").replace("Bob", "Łucja")) == [True]
    assert found(item, item.replace("Tom", "Ольга").replace("Bob", "Ạnh")) == [True]
    assert found(item, item.replace("Tom", "Ann", 1).replace("Tom", "Eve", 1).replace("Tom", "Fay")) == []
    item = "the shop sold 3 of the 40 kg bags and then took 7 of them to the store with 2 kg of rice"
    assert found(item, item.replace("40 kg", "1,500kg").replace("7", "3.5").replace("2 kg", "2.25kg")) == [True]


def test_items_without_a_window():
    def found(item, text):
        return [m[5] > 0 for m in op1_templates.Table([7], pa.array([item])).matches(pa.array([text]))]

    for item in ("What is 12 * 7 + 5?", "Add 12, 7 and 30, 5.", "12 * 7 = 84", "Bob?"):
        assert found(item, f"Some text. {item} And more.") == found(item, f"so {item.lower().replace(' ', '  ')}") == [False]
    assert found("What is 12 * 7 + 5?", "What is 12 + 7 * 5?") == found("12 * 7 = 84", "13 * 7 = 91") == []
    item = "Add 12 and 7, then take 12 off"
    assert found(item, "So: Add 30 and 8, then take 30 off.") == [True] and found(item, "So: Add 30 and 8, then take 31 off.") == []
    assert found("what is this", "and what is this?") == [False] and found("...", "...") == []


def test_urls(spark):
    urls = [f"http://good{i % 7}.org/en/{i}" for i in range(300)] + [f"http://spam-win{i % 7}.example.com/de/{i}" for i in range(300)]
    urls += ["https://a.example.org/es/x?y", "http://EXAMPLE.org/en/12#z", "http://notexample.org/es/", "http://spam-win9.net/de/7", "http://good9.net/en/7", "no scheme", "", None, "http://org", "x://b.com/fr/?q", "http://com/fr/"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in op9_urls.url_filter(d, URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split(r"[/?#]", rest)[0].lower()
        path = re.split(r"[?#]", rest[len(host) :])[0]
        fits = [(len(r), r, v) for v, r in URL_RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rule, verdict = (max(fits)[1], max(fits)[2]) if fits else (None, None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or got[i].verdict) and got[i].verdict in ("allow", "block")
    assert got[603].verdict == "block" and got[604].verdict == "allow"
    assert op9_urls.url_filter(d.limit(0), URL_RULES).count() == 0
    assert {r.score for r in op9_urls.url_filter(d.where("page_id > 602"), URL_RULES[:1]).collect()}


def test_url_scores_are_exact(spark):
    """Against counts in dictionaries, with more distinct grams than the 32,768 entries of a hashed array."""
    import math
    from collections import Counter

    r = random.Random(3)
    urls = [f"http://{h}/" + "".join(chr(r.randrange(0x4E00, 0x4E40)) for _ in range(40)) for h in ("a.org", "b.com/de", "c.net") for _ in range(400)] + ["http://", None]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    text = ["\x02" * 3 + (u.split("://", 1)[1] if u else "") for u in urls]
    held = {x.page_id for x in d.where(F.pmod(F.xxhash64(F.lit("held"), op9_urls._padded(op9_urls.parts(F.col("url"))[2], 3)), F.lit(8)) == 0).collect()}
    counts = [Counter(), Counter()]
    for i in range(800):
        if i not in held:
            for k in range(3, len(text[i])):
                for j in range(4):
                    counts[i >= 400].update([(j, text[i][k - j : k + 1]), ("context", text[i][k - j : k])])
    assert len(counts[0] + counts[1]) > 1 << 15

    def p(c, t, k):
        out = 1 / 256
        for j in range(4):
            out = (c[j, t[k - j : k + 1]] + 2 * out) / (c["context", t[k - j : k]] + 2)
        return out

    got = {x.page_id: x for x in op9_urls.url_filter(d, [("allow", "org/"), ("block", "com/de/")]).collect()}
    assert len(got) == len(urls)
    for i, t in enumerate(text):
        want = [math.log(p(counts[0], t, k) / p(counts[1], t, k)) for k in range(3, len(t))] or [0.0]
        assert abs(got[i].score - sum(want) / len(want)) < 1e-9
    # The threshold, by trying all steps.
    steps = [(math.floor(got[i].score * 50), i < 400) for i in held if i < 800 and len(text[i]) > 3]
    kinds = [sum(a for _, a in steps), sum(not a for _, a in steps)]
    gain = lambda b: sum(a / kinds[0] if s >= b else 0 for s, a in steps if a) + sum(1 / kinds[1] for s, a in steps if not a and s < b)
    best = max(range(min(0, min(steps)[0]), max(0, max(steps)[0]) + 1), key=lambda b: (round(gain(b), 9), -abs(b), b)) / 50
    for i in range(800, len(text)):
        assert got[i].rule is None and got[i].verdict == ("allow" if got[i].score >= best else "block")


def test_urls_of_awkward_tables(spark):
    long = "http://a.org/" + "x%20y/" * 20_000
    rows = [(1, "http://a.org/b", "h"), (1, "http://a.org/b", "h"), (None, "http://b.com/de/c", None), (2, long, "v"), (3, long, "v"), (4, None, None), (5, "", ""), (6, "http://c.net/" + "é😀" * 50, "x")]
    d = spark.createDataFrame(rows, "page_id long, url string, verdict string").withColumns({"host": F.lit(1), "path": F.lit(2), "rule": F.lit(3), "score": F.lit(4), "text": F.lit(5)})
    got = op9_urls.url_filter(d, URL_RULES).collect()
    assert len(got) == len(rows) and sum(r.page_id == 1 for r in got) == 2 and [r.verdict for r in got if r.page_id is None] == ["block"]
    assert all(r.verdict == "allow" and r.host == "a.org" for r in got if r.page_id in (1, 2, 3)) and [(r.host, r.path) for r in got if r.page_id in (4, 5)] == [("", "")] * 2


def test_html(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=x>Menu</a></li></ul></nav><header>Top</header><div class='ad'>Buy</div>"
        "<article><h1>Title &amp; more</h1><p>First   para\n with <b>bold</b> text.<p>Second &eacute;.<aside>Side</aside><div class=comments>Reader</div></article><form>F</form><footer>&copy; x</footer></body></html>"
    )
    plain = "<body><div id=menu><a>a</a><a>b</a></div><div><p>" + "Long text of the page. " * 9 + "</p><p>Yes.</p></div><div><a>x</a> <a>y</a></div></body>"
    d = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "no tags at all"), (5, "u", plain), (6, "u", "<p>open <b"), (1, "u", page)], "page_id long, url string, html string")
    got = [(r.page_id, r.text, r.n_chars) for r in op10_html.extract(d).collect()]
    text = {p: t for p, t, _ in got}
    assert len(got) == 7 and all(n == len(t) for _, t, n in got)
    assert text[1] == "Title & more\nFirst para with bold text.\nSecond é."
    assert text[2] == text[3] == "" and text[4] == "no tags at all" and text[5].endswith("Yes.") and "x y" not in text[5]
    assert op10_html.extract(d.limit(0)).count() == 0


def test_html_article_is_only_a_prior():
    body = "".join(f"<div><p>{'A sentence of the main text. ' * 12}</p></div>" for _ in range(3))
    comment = f"<article class=comment><p>{'A reader says so. ' * 12}</p></article>"
    teaser = op10_html.main_text(f"<body><div>{body}</div><article><a href=x>Read</a> <a href=y>more</a></article></body>")
    assert teaser.count("main text") == 36
    for page in (f"<body><div>{body}</div>{comment}</body>", f"<body><main><div>{body}</div></main>{comment}</body>"):
        assert op10_html.main_text(page).count("main text") == 36 and "reader" not in op10_html.main_text(page)


def test_html_keeps_short_sections_and_wrappers():
    long, links = f"<p>{'A sentence of the main text. ' * 30}</p>", "<ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul>"
    for tag in ("section", "div"):
        parts = f"<{tag}>{long}</{tag}><{tag}><p>Short note.</p></{tag}><{tag}>{long}</{tag}><{tag}><p>Last words.</p></{tag}>"
        text = op10_html.main_text(f"<body><div>{links}</div><div>{parts}</div><div>{links}</div></body>")
        assert text.count("main text") == 60 and "Short note." in text and "Last words." in text and "Home" not in text
    for name in ("site no-sidebar", "has-sidebar", "content-with-sidebar"):
        text = op10_html.main_text(f"<body><div class='{name}'><div class=site-menu>{links}</div><article><h1 class=article-header>Title</h1>{long}</article></div></body>")
        assert text.startswith("Title\n") and text.count("main text") == 30 and "Home" not in text
    # A menu in the article under a longer name is still left out.
    assert "Home" not in op10_html.main_text(f"<body><article>{long}<div class=related-links>{links}</div></article></body>")


def test_html_clustering_decides():
    """The region of the ratio cluster is chosen, in an article too: with all lines in one cluster the result is another."""
    long = f"<div><p>{'A sentence of the main text. ' * 20}</p><p>{'More of it. ' * 20}</p></div>"
    bits = "<div>" + "".join(f"<div><b>x{i}</b> <i>y</i> <b>z</b></div>" for i in range(12)) + "</div>"
    page = f"<body><div>{bits}{long}</div></body>"
    assert op10_html.main_text(page).startswith("A sentence") and "x3" not in op10_html.main_text(page)
    content = op10_html._content
    try:
        op10_html._content = lambda blocks, sigma: (np.ones(len(blocks), bool),) * 2
        assert "x3" in op10_html.main_text(page)
    finally:
        op10_html._content = content


def test_html_names_do_not_delete_text():
    p = f"<p>{'A sentence of the main text. ' * 10}</p>"
    names = ("legal", "social", "share", "related", "copyright", "legal-case-summary", "social-history", "header", "disclaimer")
    page = "<article>" + p + "".join(f"<section class={n}><p>Part {n}.</p></section>" for n in names) + "</article>"
    text = op10_html.main_text(page)
    assert all(f"Part {n}." in text for n in names)
    for n in ("comments", "ad", "cookie", "sidebar", "notice", "menu"):
        assert "Part" not in op10_html.main_text(f"<article>{p}<div class={n}><p>Part of {n}.</p></div></article>")
    teasers = "".join(f"<article><h3><a href=x{i}>Other story {i}</a></h3></article>" for i in range(2))
    assert "Other" not in op10_html.main_text(f"<main><div>{p}{p}</div>{teasers}</main>")


def test_html_paragraphs_and_depth():
    assert op10_html.main_text("<p>one <b><i><u><s><em><a><q><small><big>deep<div>two</div>three") == "one deep\ntwo\nthree"
    assert op10_html.main_text("<table><tr><td><p>a<table><tr><td><div>b</div></table>c</table>") == "a\nb\nc"
    import time

    for page in ("<b>" * 100_000 + "text", "<b>" * 50_000 + "</i>" * 50_000 + "text", "<div>" * 50_000 + "</p>" * 50_000 + "text", "<p>" + "<b>" * 50_000 + "<div>x" * 2):
        began = time.perf_counter()
        assert op10_html.main_text(page)
        assert time.perf_counter() - began < 2


WORDS_OF = re.compile(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+|\w+", re.UNICODE)


def _windows(text, opening_as_names):
    """Template windows of five tokens, three words or more, by plain string work (for texts without units and attached numbers)."""
    out, end, start = [], 0, True
    for m in WORDS_OF.finditer(text):
        between = text[end : m.start()]
        opens = start or bool(set(".!?:\n") & set(between))
        w, start, end = m[0], False, m.end()
        low = w.lower()
        if w[0].isdigit() or low in op1_templates.NUMBER_WORDS.split():
            out.append(("", "NUM"))
        elif out and out[-1][1] == "NUM" and low in op1_templates.UNITS.split():
            out.append(("", "UNIT"))
        elif low[0] != w[0] and (not opens or opening_as_names):
            out.append(("", "NAME"))
        else:
            out.append(("w", low))
    rows = [tuple(out[i : i + 5]) for i in range(len(out) - 4)]
    return [tuple(x for _, x in r) for r in rows if sum(bool(k) for k, _ in r) >= 3]


def test_templates_on_whole_tables(spark):
    """Every document with an item's very words is found, and every one found holds 0.8 of its windows, by plain string work."""
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "benchmark"))
    texts, items = {r.doc_id: r.text or "" for r in docs.collect()}, {r.item_id: r.text for r in bench.collect() if r.text}
    got = {(r.doc_id, r.item_id) for r in op1_templates.find(docs, bench).collect()}
    plain = lambda s: " ".join(s.lower().split())
    flat = {d: plain(t) for d, t in texts.items()}
    verbatim = {(d, i) for i, q in items.items() for d, t in flat.items() if plain(q) in t}
    assert verbatim and verbatim <= got
    held = {d: {w for named in (False, True) for w in _windows(texts[d], named)} for d, _ in got}
    for d, i in got:
        some = [[w in held[d] for w in _windows(items[i], named)[1:]] for named in (False, True)]
        assert max(sum(x) / max(1, len(x)) for x in some) >= 0.75  # 0.8, but for windows whose opening word has both forms


def test_templates_of_awkward_tables(spark):
    item = "Alice bought 12 apples from the market near the old bridge and gave them to all of her friends"
    rows = [(None, item), (1, "word " * 300_000 + item), (2, None), (3, ""), (4, "A" * 400_000), (1, "word " * 300_000 + item)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit(1), "_text": F.lit("x"), "n_windows": F.lit(2)})
    bench = spark.createDataFrame([(7, item), (7, item), (None, item), (8, "")], "item_id long, text string").withColumn("doc_id", F.lit(3))
    got = [(r.doc_id, r.item_id) for r in op1_templates.find(d, bench).collect()]
    assert sorted(got, key=str) == sorted([(x, y) for x in (None, 1, 1) for y in (7, 7, None)], key=str)
    kept = op1_templates.decontaminate(d, bench)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf}/documents.parquet")
    docs, scratch = source, Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, sf), name)
        assert 0 < docs.count() <= before.count()
        if name != "pieces":
            assert docs.columns == source.columns
    assert docs.where("not lossless").count() == 0


def test_pipeline_stages_equal_brute_force(spark, monkeypatch):
    """Each stage after the first against plain Python, on a table with nulls, empty texts and columns of clashing names."""
    import corpus_pipeline

    r = random.Random(12)
    words = ["w%d" % i for i in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    item = "Alice bought 12 apples from the market near the old bridge and gave them to all of her friends"
    base = [text(60) for _ in range(8)]
    near = [" ".join(w if k % 40 else "changed" for k, w in enumerate(b.split())) for b in base]
    texts = [*base, *base[:3], *near, None, "", " ", item, f"{text(20)} {item} {text(9)}", f"{text(5)} mail a.b@c.org or 10.0.0.1 {text(5)}", "one two", text(3000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id long, _gone long, spans string, id long, ids string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "x", 3, "y") for i, t in enumerate(texts)], schema).repartition(2)
    stages, sf = dict(corpus_pipeline.STAGES), "/root/testdata/sf0.001"
    scored = {x.doc_id: x.score for x in op4_quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet").limit(0)).collect()}
    good = stages["quality"](spark, docs, sf)
    assert good.columns == docs.columns and len(scored) == len(texts)
    # near_dups
    sets = []
    for x in texts:
        w = WORD.findall((x or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = _components(len(texts), lambda i, j: bool(sets[i] & sets[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    kept = stages["near_dups"](spark, docs, sf)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == [i for i, x in enumerate(root) if i == x]
    # leaks
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = op1_templates.decontaminate(docs, bench)
    assert clean.columns == docs.columns and sorted(x.doc_id for x in clean.collect()) == [i for i, x in enumerate(texts) if item not in (x or "")]
    # pii
    masked = {x.doc_id: x for x in stages["pii"](spark, docs, sf).collect()}
    for i, x in enumerate(texts):
        want = None if x is None else x.replace("a.b@c.org", "<email>").replace("10.0.0.1", "<ip>")
        assert (masked[i].text, masked[i].n_chars, masked[i].spans) == (want, None if want is None else len(want), "x")
    # pieces
    ids = stages["pieces"](spark, docs, sf)
    back = {x.doc_id: x.text for x in op7_pieces.decode(ids, _vocabulary("piece_bpe_32k.model")).collect()}
    assert back == {i: x or "" for i, x in enumerate(texts)}


def test_quality_learns_from_every_labelled_row(spark):
    """What only rows beyond the 8,000 with the least hashes show."""
    r = random.Random(9)
    words = "alpha beta gamma delta epsilon zeta".split()
    ids = spark.range(11_600).where(~op4_quality.held_out(F.col("id"))).orderBy(F.xxhash64(F.lit("fit"), "id"), "id")
    ids = [x.id for x in ids.collect()]
    assert len(ids) > 8_300
    text = lambda n, k: " ".join(f"{r.choice(words)}{k}" for _ in range(n))
    rows = [(i, text(6, ""), 1) if k % 2 else (i, text(6, "77"), 0) for k, i in enumerate(ids[:8_000])] + [(i, text(6, " $% &#"), 0) for i in ids[8_000:]]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    rules = op4_quality.train(d, d)
    low = rules.scores(op4_quality.statistics(pa.array([text(6, " $% &#"), text(6, "77")])))
    assert low.max() < 0.5 < rules.scores(op4_quality.statistics(pa.array([text(6, "")])))[0]


def test_pii_learns_from_every_document(spark):
    """What only documents outside the old half by hash show; rows summed on the driver and in a stored table give one model."""
    odd = spark.range(6_000).select("id", (F.pmod(F.xxhash64(F.lit("pii"), "id"), F.lit(2)) == 0).alias("even")).collect()
    d = spark.createDataFrame([(x.id, "plain words" if x.even else f"mail to name{x.id}@mail{x.id % 7}.example.org today") for x in odd], "doc_id long, text string")
    model = op5_pii.train(d)
    assert model.limits["email"] <= 1 and model.limits["card"] > 1
    stored = op5_pii.train(d.repartition(3), local=0)
    assert (stored.start, stored.trees, stored.limits) == (model.start, model.trees, model.limits)


def test_training_sums_do_not_depend_on_the_cut(spark, monkeypatch):
    from sluice.llm import training, trees

    r = np.random.default_rng(2)
    x, y = r.standard_normal((20_000, 3)), r.integers(0, 2, 20_000)
    paths = [((0, True, 9),), ((1, False, 4), (2, True, 20))]
    rows = training.of_arrays(x, y, y * 0)
    a = np.asarray(rows.total(lambda b: trees._slopes(b, paths, np.array([0.1, 0.2, -0.3]), 1)))
    order = r.permutation(20_000)
    parts = [(x[k], y[k], y[k] * 0) for k in np.array_split(order, 90)]
    d = spark.createDataFrame([(len(v), p.tobytes(), v.astype(np.uint8).tobytes(), m.astype(np.uint8).tobytes()) for p, v, m in parts], training.RAW).repartition(90)
    monkeypatch.setattr(training, "FILE", 250)
    monkeypatch.setattr(training, "PARTS", 8)
    stored = training.of_table(d, 3, Scratch(spark, "test"), local=0)
    b = np.asarray(stored.total(lambda b: trees._slopes(b, paths, np.array([0.1, 0.2, -0.3]), 1)))
    assert stored.tasks == 80 and (a == b).all() and all((p == q).all() for p, q in zip(rows.cuts, stored.cuts, strict=True))


def test_pieces_in_bounded_memory(spark):
    import tracemalloc

    class Table:
        """Runs the worker's function here."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            r = random.Random(5)
            texts = ["".join(r.choice("abcdefghij klmnop") for _ in range(4_000)) for _ in range(512)]
            tracemalloc.start()
            n = sum(b.num_rows for b in run([pa.RecordBatch.from_arrays([pa.array(range(512)), pa.array(texts)], ["doc_id", "text"])]))
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            return n, peak

    n, peak = op7_pieces.encode(Table(), _vocabulary("piece_bpe_32k.model"))
    assert n == 512 and peak < 165 << 20
