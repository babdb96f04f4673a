"""Exact dedup, mixing, secret scans and sharding on small and awkward tables."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import pytest
import xxhash

from skeinwork.llm import common, exact_dedup, mixing, secrets, sharding

REAL_MD5 = exact_dedup.F.md5
DOCS = "doc_id long, text string, source string, kept string, size long"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


AWKWARD = [
    (3, "a  b", "s1", "x", 1), (1, "a\tb", "s2", "x", 1), (2, None, None, "x", 1), (4, "", "s1", "x", 1), (5, " \n", "s1", None, None), (6, "é" * 70000, "s1", "x", 1),
    (7, "c", "s2", "x", 1), (7, "c", "s2", "x", 1), (None, "c", "s2", "x", 1), (None, "c", None, "x", 1),
]


def test_exact_groups(spark):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_groups(docs(spark, AWKWARD)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[(3, sha("a b"))].keep_id == 1 and not got[(3, sha("a b"))].kept and got[(3, sha("a b"))].group_size == 2
    assert got[(2, sha(""))].group_size == 2 and got[(4, sha(""))].keep_id == 2 and got[(5, sha(" "))].group_size == 1
    assert got[(7, sha("c"))].kept and got[(7, sha("c"))].group_size == 2 and got[(None, sha("c"))].kept
    assert exact_dedup.exact_groups(docs(spark, AWKWARD)).count() == len(AWKWARD)


def test_drop_copies_keeps_columns(spark):
    d = docs(spark, AWKWARD)
    out = exact_dedup.drop_copies(d)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.where("doc_id is not null").collect()) == [1, 2, 5, 6, 7, 7]


def test_drop_copies_keeps_another_text_of_a_dropped_id(spark):
    d = docs(spark, [(1, "a", "s", "x", 1), (5, "a", "s", "x", 1), (5, "unique text", "s", "x", 1)])
    assert sorted((r.doc_id, r.text) for r in exact_dedup.drop_copies(d).collect()) == [(1, "a"), (5, "unique text")]


def test_texts_that_share_a_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: REAL_MD5(exact_dedup.F.length(c).cast("string")))
    d = docs(spark, [(4, "ab", "s", "x", 1), (2, "cd", "s", "x", 1), (3, "ab", "s", "x", 1), (9, "cd", "s", "x", 1), (1, "abc", "s", "x", 1), (None, "ab", "s", "x", 1)])
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(d).collect())
    assert got == [(0, None, 1), (1, 1, 1), (2, 2, 2), (3, 3, 2), (4, 3, 2), (9, 2, 2)]


@pytest.mark.parametrize("f", [exact_dedup.exact_groups, mixing.mix_plan, secrets.scan, sharding.shard])
def test_empty_table(spark, f):
    assert f(docs(spark, [])).count() == 0


def test_targets_fill_up_like_water(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 50)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    want, budget, left = {}, 1.5 * 1160, {"a": (5, 20), "b": (2, 200), "c": (1, 2000), None: (5, 100)}
    while True:
        level = budget / sum(w for w, _ in left.values())
        over = {k: c for k, (w, c) in left.items() if w * level > c}
        if not over:
            break
        for k, c in over.items():
            want[k] = c
            budget -= c
            del left[k]
    want |= {k: w * level for k, (w, _) in left.items()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(got) == 4


def test_mix_comes_near_its_targets_and_repeats(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 3}" if i % 11 else None, "x", 1) for i in range(3000)]
    plan = mixing.mix_plan(docs(spark, rows)).cache()
    assert plan.count() == 3000
    for r in plan.groupBy("source").agg({"taken": "sum", "target": "max", "source_size": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 14 and r["max(target)"] <= 2 * r["max(source_size)"]
    assert plan.where("taken > 2 * size").count() == 0
    assert sorted(plan.collect(), key=str) == sorted(mixing.mix_plan(docs(spark, rows).repartition(3)).collect(), key=str)
    mixed = mixing.mix(docs(spark, rows))
    assert mixed.columns == DOCS.replace(" long", "").replace(" string", "").split(", ") and mixed.count() == plan.agg({"copies": "sum"}).first()[0]


def test_mix_of_awkward_rows(spark):
    got = mixing.mix_plan(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD) and all(r.taken <= 2 * r.size for r in got)
    assert all(r.target == 0 for r in mixing.mix_plan(docs(spark, [(1, None, "a", "", 0), (2, " ", "b", "", 0)])).collect())


PATTERNS = [
    (re.compile(r"""(?:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
    (re.compile("AKIA[A-Z0-9]+"), 0, 20), (re.compile("[0-9a-f]+"), 0, 24),
]
TEXTS = [
    "", None, "token = abc", "Password: 'hunter22' and secret=tok token=\"abcdef\"", "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "ü" * 9 + "ab" * 12 + "é " + "0" * 24 + "g",
    "api_key==x api_key==xyzxyz APIKEY : abcdef0123", "token=ab token=abcdefgh", "x" * 40, "the_quick_brown_fox_jumps_over_2_dogs", "pre 9f8Kq2LmZ7xTa4Vn0RcW3bYs6Hd1PjGe post",
    " ".join("secret=abcdef%d" % i for i in range(700)),
]


def test_spans_agree_with_a_plain_scan(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(d).collect()}
    for i, text in enumerate(TEXTS):
        want = sorted((m.start(), k, m.end()) for k, (p, g, least) in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m[g]) >= least)
        assert [(s.s, s.k, s.e) for s in got[i].base] == want, i


def test_battery_finds_random_tokens_and_leaves_words(spark):
    words = [f"the_quick_brown_fox_number_{i}_of_many" for i in range(60)]
    keys = ["9f8Kq2LmZ7xTa4Vn0RcW3bYs6Hd1PjGe", "hT5sWq8ZrB2nK7vXc4Mj9LpD1gFy6RtA", "Zx3Qw9Er7Ty1Ui5Op8As2Df6Gh4Jk0Lm"]
    d = spark.createDataFrame(list(enumerate(words + keys)), "doc_id long, text string")
    found = {r.doc_id for r in secrets.scan(d).collect() if r.found}
    assert found == {60, 61, 62}


def tail(z):
    return max(1e-300, 0.5 * math.erfc(z / math.sqrt(2)))


def plain_model(texts):
    """The corpus's model from plain loops over its words."""
    words = Counter(w for t in texts for w in re.findall("[A-Za-z0-9]+", t or "") if len(w) < secrets.LONG)
    counts = Counter()
    for w, n in words.items():
        mixed = len(w) >= secrets.MIXED and bool(re.search("[0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][A-Z]", w))
        for a, b in zip(w, w[1:]):
            counts[mixed, a + b] += n
    model = secrets.model_of(counts)
    z = [plain_serial(w, model) for w in words if len(w) >= secrets.MIXED and w.isalpha()]
    n = len(z) + secrets.PRIOR_WORDS
    model["mean"] = sum(z) / n
    model["spread"] = max(1.0, math.sqrt((sum(v * v for v in z) + secrets.PRIOR_WORDS * secrets.SPREAD ** 2) / n - model["mean"] ** 2))
    return counts, model


def plain_serial(x, model):
    low = secrets.DIGITS + secrets.LOWER
    at = [low.index(a) * 36 + low.index(b) for a, b in zip(x.lower(), x.lower()[1:]) if a in low and b in low]
    var = sum(model["var"][i] for i in at)
    return sum(model["cost"][i] for i in at) / math.sqrt(var) if var else 0.0


def plain_battery(x, model):
    """-ln p of an ordinary token by Fisher's sum of three tests, and whether symbols may be random; one candidate at a time."""
    x = x.rstrip("=")
    at = next(i for i, (_, a, _) in enumerate(secrets.ENCODINGS) if set(x) <= set(a))
    _, alphabet, rule = secrets.ENCODINGS[at]
    n, size = len(x), len(alphabet)
    chi = size / n * sum(x.count(c) ** 2 for c in alphabet) - n
    df = size - 1
    z_chi = ((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    v = [alphabet.index(c) - df / 2 for c in x]
    z_place = sum(a * b for a, b in zip(v, v[1:])) / (n * (size * size - 1) / 12) * math.sqrt(n)
    known = set(secrets.SYMBOLS)
    changes = sum(secrets.changes_kind(rule, a, b) for a, b in zip(x, x[1:]) if a in known and b in known)
    w = model["rate"][at]
    z_runs = (model["side"][at] * (changes - (n - 1) * w) - 0.5) / math.sqrt((n - 1) * w * (1 - w))
    uneven = model["uneven"][at]
    z_even = (df + n * uneven - chi) / math.sqrt(2 * df + 4 * n * uneven)
    z_serial = (plain_serial(x, model) - model["mean"]) / model["spread"]
    y = -math.log(tail(z_even)) - math.log(tail(z_runs)) - math.log(tail(z_serial))
    return y - math.log(1 + y + y * y / 2), 2 * min(tail(z_chi), 2 * tail(abs(z_place))) >= secrets.ALPHA


def planted(rng):
    symbols = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["A1" + "".join(rng.choice(symbols) for _ in range(rng.choice([26, 34, 46, 70]))) for _ in range(120)]
    nouns = "user account river mill build report summer garden value index table folder server window letter".split()
    plain = ["_".join(rng.choice(nouns) for _ in range(5)) + str(rng.randrange(100)) for _ in range(500)]
    plain += ["".join(rng.choice(nouns).capitalize() for _ in range(5)) + "2" for _ in range(200)]
    plain += ["-".join(rng.choice(nouns).capitalize() for _ in range(4)) + "-v%d" % rng.randrange(9) for _ in range(300)]
    return plain, keys


def test_battery_agrees_with_a_plain_one(spark):
    plain, keys = planted(random.Random(7))
    d = spark.createDataFrame(list(enumerate(plain + keys)), "doc_id long, text string")
    counts, model = plain_model(plain + keys)
    fitted = secrets.fit(d.selectExpr("text AS t"))
    assert fitted["cost"] == model["cost"] and fitted["rate"] == model["rate"]
    assert abs(fitted["spread"] - model["spread"]) < 0.01 and abs(fitted["mean"] - model["mean"]) < 0.01
    scores = {x: plain_battery(x, model) for x in plain + keys}
    cls = lambda x: sum(len(x) >= lo for lo in secrets.LENGTH_CLASSES)
    want = set()
    for k in range(1, len(secrets.LENGTH_CLASSES) + 1):
        own = sorted((math.floor(scores[x][0] * secrets.STEPS) for x in plain + keys if cls(x) == k), reverse=True)
        limit = min((b for i, b in enumerate(own) if math.exp(-b / secrets.STEPS) <= secrets.Q * sum(o >= b for o in own) / len(own)), default=None)
        want |= {x for x in plain + keys if limit is not None and cls(x) == k and scores[x][1] and math.floor(scores[x][0] * secrets.STEPS) >= limit}
    got = {(plain + keys)[r.doc_id] for r in secrets.scan(d).collect() if r.found}
    assert len(got ^ want) <= 2  # the normal tail is an approximation, so a value can fall into the next bin
    assert len(got & set(keys)) >= 0.95 * len(keys) and len(got & set(plain)) <= 2 * secrets.Q * len(got), got & set(plain)


def test_keys_of_every_encoding_are_found_among_ordinary_texts(spark):
    """Keys of 24 characters and more; at least 0.9 of each encoding are found (digits and lower-case hexadecimal as base spans)."""
    rng = random.Random(11)
    texts = [r.text for r in common.read_table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()]
    keys = {name: {"".join(rng.choice(a) for _ in range(rng.choice([24, 28, 32, 40, 52]))) for _ in range(60)} for name, a, _ in secrets.ENCODINGS}
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1 - i, f"see {k} there") for i, k in enumerate(k for own in keys.values() for k in sorted(own))]
    got = spark.createDataFrame(rows, "doc_id long, text string")
    found = secrets.scan(got).select("doc_id", secrets.F.size("base").alias("b"), "found").collect()
    hit = Counter()
    by_id = {r.doc_id: r for r in found}
    for i, text in rows[len(texts):]:
        r = by_id[i]
        assert r.b or not r.found or text[r.found[0].s:r.found[0].e] == text.split()[1]
        hit[next(n for n, own in keys.items() if text.split()[1] in own)] += bool(r.found or r.b)
    wrong = sum(len(r.found) for r in found if r.doc_id >= 0)
    shares = {n: hit[n] / len(own) for n, own in keys.items()}
    assert all(s >= 0.9 for n, s in shares.items()), shares
    assert wrong <= 2 * secrets.Q * sum(hit.values()) + 1, (wrong, shares)


def test_secrets_of_awkward_rows(spark):
    d = docs(spark, [(None, "token=abcdefgh", "s", "x", 1), (1, "token=abcdefgh", "s", "x", 1), (1, "token=abcdefgh", "s", "x", 1), (2, None, "s", "x", 1), (3, "x1" * 50000, "s", "x", 1)])
    got = sorted((r.doc_id or 0, len(r.base), len(r.found)) for r in secrets.scan(d).collect())
    assert got == [(0, 1, 0), (1, 1, 0), (1, 1, 0), (2, 0, 0), (3, 0, 0)]


def test_shards_are_near_equal_and_keep_equal_texts(spark):
    rows = [(i, "t%d " % (i % 400) + "z" * (i % 90), "s", "x", 1) for i in range(4000)] + [(9000 + i, "copy " * 30, "s", "x", 1) for i in range(80)]
    got = sharding.shard(docs(spark, rows)).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and len(size) == 16 and size.max() / size.min() < 1.12
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert got.groupby("text_crc32").shard.nunique().max() == 1


def plain_shards(rows, shards):
    """The law `bytes` in one loop over all groups in key order; rows as (doc_id, text)."""
    full = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), hashlib.md5((t or "").encode()).hexdigest()) for i, t in rows]
    group = Counter()
    for _, n, _, key in full:
        group[key] += n
    per = sum(group.values()) / shards
    load, at, cut = [0.0] * shards, {}, set()
    for n, key in sorted(((n, k) for k, n in group.items() if n > per * sharding.LARGE), key=lambda x: (-x[0], x[1])):
        k = min(range(shards), key=lambda i: (load[i], i))
        if load[k] + n > per * 1.01:
            cut.add(key)
        else:
            load[k] += n
            at[key] = k
    room = [max(0.0, per - x) for x in load]
    bounds = [sum(room[:i + 1]) for i in range(shards - 1)]
    units = {}
    for r in full:
        m = sharding.PIECES if r[3] in cut else sharding.NUMBERED if r[3] in at else 1
        h = xxhash.xxh64_intdigest(struct.pack("<q", -1 if r[0] is None else r[0]), seed=42)
        units.setdefault((r[3], (h - (1 << 64) if h >> 63 else h) % m), []).append(r)
    laid, slots, out = 0, [0] * shards, []
    for (key, _), own in sorted(units.items()):
        n = sum(r[1] for r in own)
        k = at[key] if key in at else sum(b <= laid + n / 2 for b in bounds)
        laid += 0 if key in at else n
        for r in sorted(own, key=lambda r: (r[0] is not None, r[0] or 0)):
            out.append((r[0], r[1], r[2], k, slots[k]))
            slots[k] += 1
    return out


@pytest.mark.parametrize("shards", [3, 16])
def test_shards_and_slots_agree_with_a_plain_loop(spark, shards):
    rows = [(i, "t%d " % (i % 900) + "z" * (i % 90)) for i in range(3000)] + [(9000 + i, "copy " * 30) for i in range(800)] + [(5, None), (5, None), (None, "x"), (None, "é"), (6, "")]
    rows += [(20000 + i, "mid %d " % (i % 3) + "y" * 400) for i in range(90)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards)
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted((tuple(r) for r in got.select("doc_id", "size", "text_crc32", "shard", "slot").collect()), key=key) == sorted(plain_shards(rows, shards), key=key)


def test_a_group_larger_than_a_shard_is_cut(spark):
    rows = [(i, "hot text", "s", "x", 1) for i in range(3000)] + [(5000 + i, "doc %d" % i, "s", "x", 1) for i in range(3000)]
    got = sharding.shard(docs(spark, rows)).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 16 and size.max() / size.min() < 1.2 and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_shards_of_awkward_rows(spark):
    got = sharding.shard(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD) and {r["size"] for r in got if r.doc_id == 2} == {1}


def test_scratch_is_in_the_shared_folder_and_never_guessed_on_a_cluster(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    path = common.scratch(spark)
    assert path.startswith(shared) and Path(path).is_dir() and path != common.scratch(spark)
    nothing = SimpleNamespace(get=lambda *_: None)
    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(getConf=lambda: nothing, master="local-cluster[3,2,3000]", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(RuntimeError):
        common.scratch(SimpleNamespace(conf=nothing, sparkContext=context))


def test_mix_with_clashing_columns(spark):
    """Columns named as those that the mix works with come out as they went in."""
    rows = [(i, f"{'w ' * (i % 5)}", f"s{i % 3}", i, i + 1, i + 2) for i in range(40)] + [(None, "a b", None, 1, 2, 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int, copies int, number int")
    out = mixing.mix(d)
    assert out.columns == d.columns
    taken = {(r.doc_id, r.source): r.copies for r in mixing.mix_plan(d).collect()}
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=str) == sorted([r for r in rows for _ in range(taken[(r[0], r[2])])], key=str)


def test_mix_in_many_parts(spark):
    """The number of parts changes nothing."""
    d = docs(spark, [(i, "w " * (i * i % 17), f"s{i % 4}" if i % 9 else None, "", 0) for i in range(300)] + [(5, "w", "s1", "", 0), (5, "w w", "s1", "", 0)])
    plans = [sorted((tuple(r) for r in mixing.mix_plan(d, parts=p).collect()), key=str) for p in (1, 7, 5000)]
    assert plans[0] == plans[1] == plans[2] and sum(r[6] for r in plans[0]) > 0
