"""Quality, suffix dedup, near dedup, language model and BPE against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.llm import bpe, near_dedup, pitman_yor, quality, suffix_dedup

DOCS = "doc_id long, text string, score string, kept string, source string"
GOOD = "the river ran quietly past the old mill and nobody in the village knew why it had stopped that year".split()


def prose(rng, n):
    return " ".join(rng.choice(GOOD) + rng.choice(["", "s", "ed", "ly"]) for _ in range(n))


def corpus():
    rng = random.Random(4)
    passage = prose(rng, 60)
    base = prose(rng, 220)
    out = [prose(rng, rng.randint(3, 160)) for _ in range(120)]
    out += [prose(rng, 20) + " " + passage + " " + prose(rng, 15) for _ in range(70)]
    for _ in range(25):
        w = base.split()
        w[rng.randrange(len(w))] = "changed%d" % rng.randrange(1000)
        out.append(" ".join(w))
    out += [out[5], out[5], "", None, " \n ", "one", "One  two", "one two", "é" * 300, "ab" * 400, "ab" * 400 + "x" + "ab" * 70]
    return [(i * 3 % 1000 + 1000 * (i * 3 // 1000), x, "s", "k", None) for i, x in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_suffix_arrays_sort():
    rng = random.Random(1)
    strings = []
    for _ in range(60):
        s = [rng.randint(1, rng.choice([2, 3, 30])) for _ in range(rng.randint(1, 50))]
        strings.append((s * rng.choice([1, 1, 3])) + [0])
    ends = np.cumsum([len(s) for s in strings])
    begins = ends - [len(s) for s in strings]
    got = suffix_dedup.suffix_arrays(np.array(sum(strings, [])), begins, ends)
    for s, a, b in zip(strings, begins, ends):
        assert (got[a:b] - a).tolist() == sorted(range(len(s)), key=lambda p: s[p:])


def test_repeats_go_as_brute_force_says(docs, rows):
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, with_text=True).collect()}
    seen = set()
    for doc_id, text, *_ in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                cover[p] += 1
                cover[p + 100] -= 1
            seen.add(b[p : p + 100])
        keep = np.cumsum(cover[:-1]) == 0
        left = bytes(x for x, k in zip(b, keep) if k)
        r = got[doc_id]
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(b), int((~keep).sum()), hashlib.sha256(left).hexdigest()), doc_id
        assert bytes(r.kept) == left and r.n_spans == int((~keep & np.concatenate([[True], keep[:-1]])).sum())
    assert len(got) == len(rows)


def test_many_contexts_of_one_anchor(spark, tmp_path):
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(130))
    texts = ["".join(rng.choice("klmnopq") for _ in range(80)) + shared + "".join(rng.choice("rstuvw") for _ in range(80)) for _ in range(3 * suffix_dedup.PART)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(spark.read.parquet(str(tmp_path / "d"))).collect()}
    # a chance letter beside the passage may lengthen a match
    assert got[0] == 0 and all(130 <= got[i] <= 150 for i in range(1, len(texts)))


def test_near_groups_agree_with_brute_force(docs, rows):
    s = near_dedup.CONTRACT
    got = {r.doc_id: r for r in near_dedup.near_groups(docs, s).collect()}
    sets = {}
    for doc_id, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for i in ids:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), find(i), find(i) == i), i
    assert sum(not r.kept for r in got.values()) > 20


def brute_components(sets, num, den):
    """Smallest id reachable over links of whole sets, by comparing all pairs."""
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("tile, shingles", [(1024, 1 << 19), (7, 1 << 19), (1024, 500)])
def test_large_near_group_in_tiles(spark, tile, shingles):
    rng = random.Random(8)
    base = prose(rng, 100).split()
    rows = []
    for i in range(150):  # edits of one text, most pairs of them close to the threshold
        w = list(base)
        for k in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(6)
        rows.append((i, " ".join(w), "s", "k", None))
    rows += [(200, " ".join(base * 60), "s", "k", None), (201, " ".join(base * 61), "s", "k", None)]
    s = near_dedup.Settings(shingle=3, num=85, den=100, tile=tile, tile_shingles=shingles)
    sets = {i: {tuple(x.split()[k : k + 3]) for k in range(len(x.split()) - 2)} for i, x, *_ in rows}
    want = brute_components(sets, 85, 100)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame(rows, DOCS), s).collect()}
    assert got == want and 1 < len(set(want.values())) < 150


def test_one_id_with_several_texts_ties_their_classes(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "pq")
    d = spark.createDataFrame([(5, a, "", "", ""), (5, b, "", "", ""), (6, a + " x", "", "", ""), (7, b + " y", "", "", ""), (4, b, "", "", ""), (8, "alone", "", "", "")], DOCS)
    got = sorted((r.doc_id, r.component_id) for r in near_dedup.near_groups(d, near_dedup.CONTRACT).collect())
    assert got == [(4, 4), (5, 4), (5, 4), (6, 4), (7, 4), (8, 8)]


def test_drop_near_copies_keeps_columns(docs):
    out = near_dedup.drop_near_copies(docs, near_dedup.CONTRACT)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()


def test_null_and_repeated_ids(spark):
    t = " ".join(f"w{i}" for i in range(50))
    d = spark.createDataFrame([(1, t, "", "", ""), (1, t, "", "", ""), (None, t, "", "", ""), (2, t + " x", "", "", ""), (3, "other", "", "", "")], DOCS)
    got = near_dedup.near_groups(d, near_dedup.CONTRACT).collect()
    assert len(got) == 5 and sorted((r.doc_id or 0, r.kept) for r in got) == [(0, True), (1, True), (1, True), (2, False), (3, True)]


def test_classifier_learns_from_its_fold_only(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 60) if i % 4 else " ".join([rng.choice(GOOD).upper() + "!!"] * 40), "s", "k", None) for i in range(600)]
    d = spark.createDataFrame(rows, DOCS)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    labels = [(i, int(i % 4 > 0) if not held(i) else int(i % 4 == 0)) for i in range(600)]  # labels of the held-out fold are wrong on purpose
    model = quality.learn(d, spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, quality int"), sample_per_label=100)
    got = quality.score(d, model).collect()
    assert all((r["score"] >= 0.5) == (r.doc_id % 4 > 0) for r in got) and quality.score(d, model).columns == ["doc_id", "text", "kept", "source", "score"]
    awkward = spark.createDataFrame([(1, None, "", "", ""), (2, "", "", "", ""), (3, "x" * 300000, "", "", "")], DOCS)
    assert all(0 <= r["score"] <= 1 for r in quality.score(awkward, model).collect())


def test_classifier_agrees_with_plain_neighbours(spark):
    """The same votes from cosines with all sampled vectors, one document at a time."""
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(0, 40)) if i % 3 else prose(rng, 12).upper(), "s", "k", None) for i in range(200)] + [(7, "another text of seven", "s", "k", None), (3, None, "s", "k", None)]
    d = spark.createDataFrame(rows, DOCS)
    model = quality.learn(d, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, quality int"))
    assert len(model.vectors) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(200))
    got = quality.score(d, model).collect()
    for r in got:
        data = np.frombuffer((r.text or "").encode(), dtype=np.uint8)
        x = quality.features(data, np.array([0, len(data)]))[0]
        z = (x * model.weights) @ model.basis
        if not np.linalg.norm(z):
            assert r["score"] == model.prior
            continue
        cosine = sorted(((float(v @ (z / np.linalg.norm(z))), i) for i, v in enumerate(model.vectors)), reverse=True)[: quality.NEIGHBOURS]
        votes = [(max(c, 0) ** quality.SHARPNESS * model.votes[i], model.labels[i]) for c, i in cosine]
        assert abs(r["score"] - sum(w * y for w, y in votes) / sum(w for w, _ in votes)) < 0.02


def test_classifier_on_the_given_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op1_quality(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "predicted", "quality").collect()
    assert len(got) > 30 and sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)


def test_classifier_without_labels(spark, docs):
    model = quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(docs, model).collect()} == {1.0}


def test_language_model(docs, rows):
    got = {r.doc_id: r for r in pitman_yor.score(docs).collect()}
    tokens = {i: (x or "").encode().lower().split() + [b"\0end"] for i, x, *_ in rows}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0 and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def gibbs_by_customer(train, sweeps, rng):
    """Mean tables of each dish, reseating one customer after another; the parent has a table for each dish."""
    d, strength = pitman_yor.DISCOUNT, pitman_yor.STRENGTH
    dishes = {}
    for ws in train:
        for a, b in zip(["^", *ws], ws):
            dishes[a, b] = dishes.get((a, b), 0) + 1
    serving = Counter(b for _, b in dishes)
    base = {w: (n - pitman_yor.PARENT_DISCOUNT) / (pitman_yor.PARENT_STRENGTH + len(dishes)) for w, n in serving.items()}
    seats = {k: [1] * n for k, n in dishes.items()}
    total = Counter()
    for (a, _), t in seats.items():
        total[a] += len(t)
    sums = Counter()
    for sweep in range(2 * sweeps):
        for (a, b), t in seats.items():
            for _ in range(dishes[a, b]):
                i = rng.choices(range(len(t)), weights=t)[0]
                t[i] -= 1
                if not t[i]:
                    t.pop(i)
                    total[a] -= 1
                weights = [x - d for x in t] + [(strength + d * total[a]) * base[b]]
                i = rng.choices(range(len(weights)), weights=weights)[0]
                if i == len(t):
                    t.append(1)
                    total[a] += 1
                else:
                    t[i] += 1
            if sweep >= sweeps:
                sums[a, b] += len(t) / sweeps
    return dishes, sums


@pytest.mark.parametrize("hot_share, off", [(2.0, 0.012), (0.05, 0.04)])  # no restaurant is spread over buckets, or most are
def test_scores_agree_with_a_sampler_of_single_customers(spark, tmp_path, monkeypatch, hot_share, off):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("u v w x y".split()) + rng.choice(["", "", "1"]) for _ in range(rng.randint(0, 9))) for _ in range(120)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartitionByRange(2, "doc_id").write.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", 200)
    monkeypatch.setattr(pitman_yor, "HOT_SHARE", hot_share)
    got = pitman_yor.score(spark.read.parquet(str(tmp_path / "d")), burn_in=50, samples=400).collect()
    train = [x.split() + ["$"] for i, x in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    dishes, tables = gibbs_by_customer(train, 400, rng)
    d, strength, pd, ps = pitman_yor.DISCOUNT, pitman_yor.STRENGTH, pitman_yor.PARENT_DISCOUNT, pitman_yor.PARENT_STRENGTH
    customers, by_context, by_word = Counter(), Counter(), Counter()
    for (a, b), n in dishes.items():
        customers[a] += n
        by_context[a] += tables[a, b]
        by_word[b] += tables[a, b]
    served = sum(by_word.values())
    unknown = (ps + pd * len(by_word)) / (ps + served)
    parent = lambda w: (by_word[w] - pd) / (ps + served) if w in by_word else unknown
    chance = lambda a, w: (dishes.get((a, w), 0) - d * tables[a, w] + (strength + d * by_context[a]) * parent(w)) / (strength + customers[a])
    for a in ["^", "u", "w1", "never"]:  # probabilities of all words and of any unknown one sum to one
        assert math.isclose(sum(chance(a, w) for w in by_word) + chance(a, "never"), 1)
    for r in got:
        ws = texts[r.doc_id].split() + ["$"]
        want = sum(math.log10(chance(a, w)) for a, w in zip(["^", *ws], ws))
        assert abs(r.score - want) < off * len(ws), (r, want)


def test_seating_has_a_table_for_each_dish_at_least():
    rng = np.random.default_rng(0)
    count = rng.integers(1, 60, 300)
    group = np.sort(rng.integers(0, 20, 300))
    mean, total = pitman_yor._reseat(count, group, np.full(300, 0.01), np.ones(300), rng)
    assert (mean >= 1).all() and (mean <= count).all() and (mean[count == 1] == 1).all()
    assert np.allclose(np.bincount(group, weights=mean, minlength=20), total)


def partitions(n):
    """Table sizes of every seating of n customers."""
    if not n:
        yield []
        return
    for sizes in partitions(n - 1):
        for i in range(len(sizes)):
            yield sizes[:i] + [sizes[i] + 1] + sizes[i + 1 :]
        yield sizes + [1]


def test_ways_of_seating():
    d = pitman_yor.DISCOUNT
    want = np.zeros(7)
    for sizes in partitions(7):
        want[len(sizes) - 1] += math.prod(i - d for s in sizes for i in range(1, s))
    assert np.allclose(pitman_yor._log_ways(7), np.log(want))
    t = np.array([1, 2, 5, 40, 200, 400, 600, 900, 1500, 2500])
    assert np.allclose(pitman_yor._log_ways_at(np.full(len(t), 3000), t), pitman_yor._log_ways(3000)[t - 1], atol=0.03)


@pytest.mark.parametrize("count, base", [(3, 0.2), (2500, 1e-4), (2500, 0.3), (2500, 0.9)])
def test_all_customers_of_a_dish_are_reseated(count, base):
    t = np.arange(1, count + 1)
    log = pitman_yor._log_ways(count) + t * math.log(base) + np.cumsum(np.log(pitman_yor.STRENGTH + pitman_yor.DISCOUNT * (t - 1)))
    weight = np.exp(log - log.max())
    mean = (weight * t).sum() / weight.sum()
    spread = math.sqrt((weight * (t - mean) ** 2).sum() / weight.sum())
    n = 400
    got, _ = pitman_yor._reseat(np.full(n, count), np.arange(n), np.full(n, base), np.ones(n), np.random.default_rng(2))
    assert abs(got.mean() - mean) < 5 * spread / math.sqrt(n) + 0.01 * mean
    assert 0.5 * spread < got.std() < 1.2 * spread


VOCABULARY = bpe.default_vocabulary()


def test_bpe_agrees_with_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(3)
    bits = ["'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "a", "B", "é", "ß", "1", "²", "!", "#", "中", "😀", "\u0085", "<|endoftext|>", "the", "ing", "\r\n", "ſ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", None, "x" * 5000, " " * 3000, "don't we'll I'VE it's"]
    d = spark.createDataFrame([(i, x, "s", "k", None) for i, x in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in bpe.encode(d, VOCABULARY, keep=("doc_id", "score")).collect()}
    for i, x in enumerate(texts):
        ids = library.encode(x or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids), repr(x)
        back = library.decode(ids, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest() and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def self_similar():
    """Two different words of 1,024 letters that any polynomial hash modulo 2**64 takes for one."""
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_self_similar_words_stay_apart(spark, tmp_path):
    from tokenizers import Tokenizer

    a, b = self_similar()
    d = spark.createDataFrame([(i, x, "s", "k", None) for i, x in enumerate([a, b, a])], DOCS).coalesce(1)
    library = Tokenizer.from_file(VOCABULARY)
    assert [r.ids for r in bpe.encode(d, VOCABULARY).orderBy("doc_id").collect()] == [library.encode(x, add_special_tokens=False).ids for x in (a, b, a)]
    assert [r.component_id for r in near_dedup.near_groups(d, near_dedup.CONTRACT).orderBy("doc_id").collect()] == [0, 1, 0]
    d.write.parquet(str(tmp_path / "d"))
    got = pitman_yor.score(spark.read.parquet(str(tmp_path / "d"))).orderBy("doc_id").collect()
    train = Counter(w for i, x in enumerate([a, b, a]) if zlib.crc32(str(i).encode()) % 5 != 1 for w in (x, "$"))
    assert [r.n_known for r in got] == [(train[x] > 0) + (train["$"] > 0) for x in (a, b, a)]


def test_words_of_one_hash_are_told_apart_by_their_bytes(monkeypatch):
    from tokenizers import Tokenizer

    real = bpe.common.range_hashes
    monkeypatch.setattr(bpe.common, "range_hashes", lambda *x: real(*x) % np.uint64(5))
    text = "the river ran quietly past the old mill and nobody knew why"
    encoder = bpe.Bpe(open(VOCABULARY, encoding="utf-8").read())
    ids, _ = encoder.encode_block(np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text)]))
    assert ids.tolist() == Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids


def test_language_model_on_awkward_rows(spark, tmp_path):
    rows = [(None, "a b", "s", "k", None), (1, None, "s", "k", None), (1, None, "s", "k", None), (2, "", "s", "k", None), (2, "a b", "s", "k", None), (3, "x" * 200000, "s", "k", None)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "d"))
    got = sorted((r.doc_id or 0, r.n_tokens, r.held_out) for r in pitman_yor.score(spark.read.parquet(str(tmp_path / "d"))).collect())
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    assert got == [(0, 3, False), (1, 1, held(1)), (1, 1, held(1)), (2, 1, held(2)), (2, 3, held(2)), (3, 2, held(3))]


@pytest.mark.parametrize("f", [
    lambda d: suffix_dedup.remove_repeats(d), lambda d: near_dedup.near_groups(d), lambda d: pitman_yor.score(d), lambda d: bpe.encode(d, VOCABULARY),
    lambda d: quality.score(d, quality.learn(d, d.select("doc_id", F.lit(1).alias("quality")))),
])
def test_empty_table(spark, f):
    assert f(empty(spark)).count() == 0
