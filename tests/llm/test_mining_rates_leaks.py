"""Hard negatives, target encoding and decontamination against brute force, on small and awkward tables."""

import datetime
import random
import re
import zlib

import numpy as np
import pytest

from skeinwork.llm import decontamination, hard_negatives, target_encoding

VECTORS = "vec_id long, embedding array<double>, label int, id string, q int, anchor boolean"


def mined(rows, anchor, positives=5, negatives=3):
    ids = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ids[i] = min(ids.get(i, (label, v)), (label, v))
    q = {i: (label, [int(np.floor(256 * x)) for x in v]) for i, (label, v) in ids.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for a in filter(anchor, q):
        others = [(dot(q[a][1], v), j, label) for j, (label, v) in q.items() if j != a and len(v) == len(q[a][1])]
        for p, i, _ in sorted((x for x in others if x[2] == q[a][0]), key=lambda x: (-x[0], x[1]))[:positives]:
            fit = sorted((x for x in others if x[2] != q[a][0] and 50 * p <= 100 * x[0] <= 95 * p), key=lambda x: (-x[0], x[1]))[:negatives]
            out += [(a, i, r + 1, j, p, s) for r, (s, j, _) in enumerate(fit)]
    return sorted(out)


def vectors(seed, n=300, d=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((9, d)) * np.linspace(2, 0.1, d)
    return [(i, [float(x) for x in centres[i % 9] + 0.4 * rng.standard_normal(d)], int(rng.integers(0, 4)), "x", 1, None) for i in range(n)]


@pytest.mark.parametrize("tiles", [(4096, 8192, 1 << 19), (5, 40, 64)])
def test_hard_negatives(spark, monkeypatch, tiles):
    for name, n in zip(("ANCHORS", "ROWS", "PAIRS"), tiles, strict=True):
        monkeypatch.setattr(hard_negatives, name, n)
    rows = vectors(3)
    rows += [(400 + i, rows[5][1], i % 2, "x", 1, None) for i in range(40)]  # ties
    rows += [(500, None, 1, "", 1, None), (501, [float("nan")] * 12, 1, "", 1, None), (502, [None] + [1.0] * 11, 1, "", 1, None), (503, rows[0][1], None, "", 1, None), (None, rows[0][1], 1, "", 1, None)]
    rows += [(510, [], 1, "", 1, None), (515, [], 1, "", 1, None), (511, [], 2, "", 1, None), (520, [1e8, 3.0], 1, "", 1, None), (521, [2e5, 1.0], 1, "", 1, None), (522, [1.1e5, 2.0], 2, "", 1, None)]
    rows += [rows[7], (7, [0.0] * 12, 0, "other", 2, True), (530, [1e308] * 12, 1, "", 1, None)]
    got = hard_negatives.mine(hard_negatives.whole_numbers(spark.createDataFrame(rows, VECTORS)), hard_negatives.F.col("id") % 5 == 0)
    want = mined([r for r in rows if r[0] != 530], lambda i: i % 5 == 0)
    assert len(want) > 300 and any(w[0] == 520 for w in want)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_no_vectors_no_negatives(spark):
    assert hard_negatives.mine(hard_negatives.whole_numbers(spark.createDataFrame([], VECTORS)), hard_negatives.F.col("id") % 5 == 0).count() == 0


def test_bounds_drop_pairs_and_lose_none():
    """With clustered vectors few pairs are left, and none that reaches the limit is lost."""
    rows = vectors(8, 800)
    q = np.floor(256 * np.array([r[1] for r in rows]))
    axes = np.ascontiguousarray(np.linalg.eigh(q.T @ q)[1][:, ::-1])
    a, b = hard_negatives.Vectors(np.arange(50), q[:50], axes), hard_negatives.Vectors(np.arange(800), q, axes)
    exact = q[:50] @ q.T
    low = np.sort(exact, axis=1)[:, -20]
    i, j, _, _ = hard_negatives.survivors(a, b, low, np.full(50, np.inf))
    there = {*zip(*np.nonzero(exact >= low[:, None]), strict=True)}
    assert there <= {*zip(i, j, strict=True)} and len(i) <= 1.05 * len(there)


LINES = "sale_id long, line_no int, item_id long, vendor_id long, flag string, t int, fold int"
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, n int"


def shop(seed, n_sales=300, per=4):
    rng = random.Random(seed)
    day = datetime.datetime(2024, 1, 1)
    sales = [(i, rng.choice([None, *range(7)]), None if rng.random() < 0.05 else day + datetime.timedelta(minutes=rng.randrange(4000)), 0) for i in range(n_sales)]
    lines = [(rng.choice([None, *range(n_sales + 5)]) if rng.random() < 0.7 else 3, 1, rng.choice([None, -1, 0, 0, 0, *range(6)]), rng.choice([None, *range(4)]), rng.choice(["returned", "kept", None]), 0, 0) for _ in range(n_sales * per)]
    items = [(i, f"k{i % 2}" if i else None) for i in range(4)] + [(None, "k1"), (2, "k0")]
    vendors = [(i, None if i == 2 else i % 2) for i in range(3)]
    clients = [(i, "s" if i % 3 else None) for i in range(5)]
    return lines, sales, items, vendors, clients


def rates(lines, sales, items, vendors, clients):
    first = lambda rows: {i: min((v for j, v in rows if j == i and v is not None), default=None) for i, _ in rows if i is not None}
    kind, nation, segment = first(items), first(vendors), first(clients)
    sold = {s: (-1 if c is None else c, t) for s, c, t, _ in sales if t is not None}
    rows = []
    for s, _, i, v, flag, *_ in lines:
        if s in sold:
            c, t = sold[s]
            i = -1 if i is None else i
            rows.append({"sale": s, "item": i, "vendor": v, "client": c, "t": t, "fold": zlib.crc32(str(s).encode()) % 5, "s": int(flag == "returned"), "kind": kind.get(i), "nation": nation.get(v), "segment": segment.get(c), "all": 0})

    def rate(r, column, prior):
        past = [x for x in rows if x["t"] < r["t"] and x["fold"] != r["fold"] and x[column] == r[column]]
        n, s = len(past), sum(x["s"] for x in past)
        return n, prior if n < 1 else (1000000 * s + 50 * prior) // (n + 50)

    out = {}
    for r in rows:
        key = (r["sale"], r["item"], r["vendor"])
        if key not in out:
            own = [x["s"] for x in rows if (x["sale"], x["item"], x["vendor"]) == key]
            whole = rate(r, "all", 500000)[1]
            out[key] = (len(own), sum(own), *(y for c, p in (("item", "kind"), ("vendor", "nation"), ("client", "segment")) for y in rate(r, c, rate(r, p, whole)[1])))
    return sorted((tuple(-5 if x is None else x for x in k) + v for k, v in out.items()))


def encoded(spark, data, **options):
    lines, sales, items, vendors, clients = data
    frames = [spark.createDataFrame(lines, LINES), spark.createDataFrame(sales, SALES), spark.createDataFrame(items, "item_id long, kind string"), spark.createDataFrame(vendors, "vendor_id long, nation_id int"), spark.createDataFrame(clients, "client_id long, segment string")]
    return sorted(tuple(-5 if x is None else x for x in r) for r in target_encoding.target_rates(*frames, **options).collect())


@pytest.mark.parametrize("hot", [target_encoding.HOT_ROWS, 15])
def test_rates(spark, hot):
    """With all keys whole, and with most of them cut into hours; one sale has many lines, several sales one time."""
    data = shop(2)
    want = rates(*data)
    assert len({r[3] for r in want}) > 2 and encoded(spark, data, hot_rows=hot) == want


def test_rates_of_nothing(spark):
    lines, sales, *rest = shop(3, 20)
    assert encoded(spark, ([], sales, *rest)) == [] == encoded(spark, (lines, [], *rest))
    assert encoded(spark, (lines, sales, [], [], [])) == rates(lines, sales, [], [], [])


DOCS = "doc_id long, text string, row int, hash string, items int, n_words int"
ITEMS = "item_id string, text string, gram int"


def leaks(docs, items, n=10):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    windows = {}
    for i, text, _ in items:
        w = words(text)
        m = min(n, len(w))
        for s in range(len(w) - m + 1) if m else []:
            windows.setdefault(tuple(w[s : s + m]), set()).add(i)
    out = []
    for i, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for s in range(len(w) - m + 1):
                if (at := windows.get(tuple(w[s : s + m]))) is not None:
                    hit |= {*range(s, s + m)}
                    found |= at
        out.append((i, len(w), len(hit), tuple(sorted(x for x in found if x is not None))))
    return sorted(out, key=str)


def test_leaks(spark):
    rng = random.Random(4)
    vocabulary = ["a", "b", "Cé", "d1", "日本", "e"]
    some = lambda k: rng.choice([" ", ", ", "-\n"]).join(rng.choices(vocabulary, k=k))
    items = [(f"i{k}", some(k), 0) for k in (3, 9, 10, 11, 25, 40)] + [("i9", some(14), 0), ("none", None, 0), ("marks", "--!", 0), (None, some(12), 0), ("one", "rare", 0), ("same", None, 0)]
    items[-1] = ("same", items[4][1], 0)
    full = [text for _, text, _ in items if text]
    docs = [(d, some(rng.randrange(0, 60)) + " " + rng.choice(full)[: rng.randrange(10, 200)] if d % 2 else some(rng.randrange(1, 80)), 0, "", 0, 0) for d in range(60)]
    docs += [(100, None, 0, "", 0, 0), (101, "", 0, "", 0, 0), (102, "RARE", 0, "", 0, 0), (None, items[5][1], 0, "", 0, 0), (103, (items[5][1] + " x ") * 300, 0, "", 0, 0), docs[1], docs[1], (1, "other rare text", 0, "", 0, 0)]
    got = decontamination.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got), key=str) == leaks(docs, items)
    for r in got:
        assert r.n_hit == sum(s.end - s.start for s in r.spans) and all(x.end < y.start for x, y in zip(r.spans, r.spans[1:], strict=False))


def test_leaks_past_a_full_bitmap(spark, monkeypatch):
    """A bitmap too small for the benchmark lets more through and changes nothing."""
    monkeypatch.setattr(decontamination, "LEAST_BITS", 64)
    monkeypatch.setattr(decontamination, "MOST_BITS", 64)
    rng = random.Random(5)
    items = [(f"i{k}", " ".join(rng.choices("abcdefghij", k=30)), 0) for k in range(40)]
    docs = [(d, " ".join(rng.choices("abcdefghij", k=20)) + " " + items[d % 40][1][7:51], 0, "", 0, 0) for d in range(50)]
    got = decontamination.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got), key=str) == leaks(docs, items)
    assert decontamination.clean(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).count() == 0


def test_leaks_of_nothing(spark):
    none = spark.createDataFrame([], ITEMS)
    docs = spark.createDataFrame([(1, "a b", 0, "", 0, 0)], DOCS)
    assert [tuple(r) for r in decontamination.contamination(docs, none).collect()] == [(1, 2, 0, [], [])]
    assert decontamination.contamination(docs.limit(0), none).count() == 0 and decontamination.clean(docs, none).columns == docs.columns


def test_every_long_shared_span_shares_a_fingerprint():
    rng = np.random.default_rng(1)
    for _ in range(50):
        words = rng.integers(0, 4, 60).astype(np.uint64)
        grams = decontamination.gram_hashes(words, 5)
        places = decontamination.winnow(grams, np.array([0, 30]), np.array([26, 56]), 6)
        for lo, hi in ((0, 30), (30, 60)):
            assert all(any(s <= p <= s + 5 for p in places) for s in range(lo, hi - 9)) and not any(26 <= p < 30 for p in places)
