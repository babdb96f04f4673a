import duckdb

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def rows(cells):
    out = []
    for r in cells:
        out.append(tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r))
    return sorted(out)


def test_oracles_on_the_smallest_tables(spark):
    from skeinwork.plans import registry

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    wrong = []
    for name in ("block_two_token", "block_rare_global", "review_top_k", "temporal_status_counts", "pair_features", "bm25_search", "normalized_recalls", "case_documents", "roc_auc", "ranked_candidates"):
        df = registry.queries()[name](spark, SF)
        cols = sorted(df.columns)
        want = con.execute(registry.oracle_sql()[name])
        names = [d[0] for d in want.description]
        order = [names.index(c) for c in cols]
        if rows(tuple(r) for r in df.select(cols).collect()) != rows(tuple(r[i] for i in order) for r in want.fetchall()):
            wrong.append(name)
    assert not wrong


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
