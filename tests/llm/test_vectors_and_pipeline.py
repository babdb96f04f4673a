import hashlib
import re

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from skeinwork.llm import bpe, embedding_dedup, mixing

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, least=0.93):
    fine = {}
    for i, v, label, _ in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float32).astype(float)
            fine[i] = (x / np.linalg.norm(x), label)
    links = {i: [j for j in fine if j != i and fine[i][1] == fine[j][1] and len(fine[i][0]) == len(fine[j][0]) and fine[i][0] @ fine[j][0] >= least] for i in fine}
    root = {r[0]: r[0] for r in rows if r[0] is not None}
    changed = True
    while changed:
        changed = False
        for i, js in links.items():
            low = min([root[i], *(root[j] for j in js)])
            for k in (i, *js):
                if root[k] != low:
                    root[k], changed = low, True
    return {i: (len(links.get(i, [])), r) for i, r in root.items()}


def vectors():
    rng = np.random.default_rng(1)
    rows = []
    for c in range(60):
        centre = rng.standard_normal(24)
        for _ in range(1 + c % 9):
            rows.append((len(rows), [float(x) for x in centre + 0.28 * rng.standard_normal(24)], c % 3, "x"))
    rows += [(len(rows) + i, rows[7][1], rows[7][2], "x") for i in range(60)]
    rows += [(900, None, 0, ""), (901, [0.0] * 24, 0, ""), (902, [float("nan")] + [1.0] * 23, 0, ""), (903, [float("inf")] * 24, 0, ""), (904, rows[0][1], None, ""), (905, [None] + [1.0] * 23, 0, ""), (906, [1.0, 0.0], 0, ""), (907, [2.0, 0.0], 0, ""), (908, [], 0, "")]
    return rows


def test_links_and_components(spark):
    rows = vectors()
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    found, there = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert found <= there and found >= 0.999 * there and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1] != want[i][1] for i in want) <= 1
    assert got[906] == (1, 906) and got[907] == (1, 906) and got[900] == (0, 900)


@pytest.mark.parametrize("most", [embedding_dedup.MOST_TABLES, 2])
def test_planted_partners_near_the_least_cosine(spark, monkeypatch, most):
    """Partners at 0.932 are found, with as many tables as they need or, where tables are too few, by comparing all."""
    monkeypatch.setattr(embedding_dedup, "MOST_TABLES", most)
    monkeypatch.setattr(embedding_dedup.fit, "__defaults__", (embedding_dedup.LEAST, 3, embedding_dedup.KEY_BITS, most))
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = 0.932 * x + (1 - 0.932**2) ** 0.5 * noise
    rows = [(i, [float(a) for a in v], 0, "x") for i, v in enumerate(np.concatenate([x, y]))] + [(3, [float(a) for a in x[3]], 0, "x"), (None, [1.0] * 32, 0, "x")]
    got = [(r.vec_id, r.n_links) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == 1202 and sum(n > 0 for i, n in got if i is not None) >= 1199


def test_keys_grow_with_the_largest_label():
    assert [embedding_dedup.key_bits(n) for n in (0, 100, 1 << 17, 1 << 30)] == [12, 12, 14, 24]


def test_an_id_with_two_vectors(spark):
    """Each row counts the links of its own vector; the id ties what it links with into one component."""
    rng = np.random.default_rng(2)
    rows = [(10 + i, [float(x) for x in rng.standard_normal(16)], 0, "x") for i in range(30)]
    a, b = rows[0][1], rows[1][1]
    near = lambda v: [x * 1.001 for x in v[:-1]] + [v[-1] + 0.01]
    rows += [(1, a, 0, "x"), (1, b, 0, "x"), (2, near(a), 0, "x"), (3, near(b), 0, "x"), (1, None, 0, "x")]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect() if r.vec_id < 12)
    assert got == [(1, 0, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (10, 2, 1, False), (11, 2, 1, False)]
    clash = spark.createDataFrame([(1, a, 0, 5, 6, 7), (2, a, 0, 5, 6, 7)], "vec_id long, embedding array<double>, label int, rep int, root int, v int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_vectors(clash).collect()) == [(1, 1, 1), (2, 1, 1)]


def test_no_vectors(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


AWKWARD = [(1, "the  same", "en", "a", 8, 0.5), (2, "the same", "en", "a", 8, 0.5), (2, "another text of that id", "en", None, 8, None), (3, None, None, None, None, None), (4, "", "en", "b", 0, 0.1), (None, "the same", "en", "b", 8, 0.2), (5, "long " * 100000, "en", "b", 8, 0.3)]


@pytest.mark.parametrize("rows", [[], AWKWARD])
def test_pipeline_stages_on_awkward_rows(spark, tmp_path, rows):
    """A score column of the documents stays as it is; a row goes only if its own text has an earlier copy."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, str(tmp_path)).cache()
        after[name] = d.collect()
    key = lambda r: (r[0] or 0, r[1] or "")
    assert [tuple(r) for r in sorted(after["quality"], key=key)] == sorted(rows, key=key)
    kept = sorted((r for r in rows if r[:2] not in ((2, "the same"), (4, ""))), key=key)
    assert [tuple(r) for r in sorted(after["exact_dedup"], key=key)] == kept == [tuple(r) for r in sorted(after["near_dedup"], key=key)]
    assert set(r[:2] for r in map(tuple, after["mixing"])) <= set(r[:2] for r in kept) and len(after["bpe"]) == len(after["mixing"])


def test_pipeline_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = d.columns, d.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, sf).cache()
        assert d.columns == columns and d.count() > 0
        if name in ("quality", "exact_dedup", "near_dedup"):
            assert d.count() <= n
            n = d.count()
    last = corpus_pipeline.STAGES[-1][1](spark, d, sf)
    assert last.count() == d.count() and {"ids", "n_tokens"} <= set(last.columns)


def plain_stages(docs, good):
    """Rows that the stages keep, from plain loops: docs as (doc_id, text), good the ids that the classifier keeps."""
    rows = sorted((i, t or "") for i, t in docs if i in good)
    first = {}
    for i, t in rows:
        first.setdefault(re.sub("[\\x20\\x09-\\x0D]+", " ", t), i)
    exact = [(i, t) for i, t in rows if first[re.sub("[\\x20\\x09-\\x0D]+", " ", t)] == i]
    sets = {}
    for i, t in exact:
        words = re.findall("[^\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and sets[a]]
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return exact, [(i, t) for i, t in exact if root[i] == i]


def test_pipeline_against_plain_stages(spark, tmp_path):
    """Every stage's rows on a whole table with planted copies: exact and near copies by plain loops, the mix by the SQL of its
    query, ids by the library; the classifier's rows by its own scores, which are tested against plain neighbours elsewhere."""
    sf = "/root/testdata/sf0.001"
    real = spark.read.parquet(f"{sf}/documents.parquet")
    long = [r for r in real.orderBy("doc_id").collect() if len(r.text.split()) > 60][:12]
    planted = [r.asDict() | {"doc_id": 10**6 + k, "text": r.text.replace(" ", "\t  ") if k % 2 else r.text + " tail"} for k, r in enumerate(long)]
    real.unionByName(spark.createDataFrame(planted, real.schema)).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    d, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    whole = {r.doc_id: r.text for r in d.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, d, str(tmp_path)).write.parquet(str(tmp_path / f"{k}.parquet"))
        d = spark.read.parquet(str(tmp_path / f"{k}.parquet"))
        kept[name] = d.collect()
    ids = {name: sorted(r.doc_id for r in rows) for name, rows in kept.items()}
    assert all(r.text == whole[r.doc_id] for r in kept["mixing"])
    exact, near = plain_stages(whole.items(), set(ids["quality"]))
    assert ids["exact_dedup"] == [i for i, _ in exact] and ids["near_dedup"] == [i for i, _ in near]
    assert len(ids["quality"]) > len(exact) > len(near)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/2.parquet/*.parquet'")
    cur = con.execute(mixing.OP7_SQL)
    at = {c[0]: k for k, c in enumerate(cur.description)}
    want = sorted(i for r in cur.fetchall() for i in [r[at["doc_id"]]] * (r[at["taken"]] // r[at["size"]] if r[at["size"]] else 0))
    assert [i for i in ids["mixing"] if whole[i] and whole[i].split()] == want
    tokenizer = Tokenizer.from_file(str(bpe.default_vocabulary()))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    assert ids["bpe"] == ids["mixing"]
    for r in kept["bpe"]:
        assert list(r.ids) == tokenizer.encode(whole[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
