"""The registered corpus queries themselves, on the smallest tables."""

import os
import zlib

import duckdb
import numpy as np
import pytest

from tidemark.llm import queries, warc

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CONTRACT = {
    "op1_toxicity": "doc_id held_out score predicted",
    "op2_chat": "conv_id out_turn role text rendered",
    "op3_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4_html": "page_id url text n_chars",
    "op5_mixing": "doc_id tokens rate copies",
    "op6_pii": "doc_id text",
    "op8_near_dups": "doc_id class_id",
    "op12_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
}


def source(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_rows_and_columns(spark, name):
    out = queries.queries()[name](spark, SF).cache()
    assert set(CONTRACT[name].split()) <= set(out.columns)
    rows = {"op2_chat": "conversations", "op4_html": "pages"}.get(name, "documents")
    assert out.count() == source(spark, rows).count() if name != "op2_chat" else out.count() >= source(spark, rows).count()
    if name == "op1_toxicity":
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) for r in out.collect())
    if name == "op3_quality":
        assert out.where("kept and base_failed").count() == 0 and out.where("base_failed <> (n_words < 50 or 100 * n_repeat_words > 50 * n_words)").count() == 0
    if name == "op4_html":
        assert out.where("n_chars <> length(text) or text <> trim(text)").count() == 0
    if name == "op8_near_dups":
        assert out.where("class_id > doc_id").count() == 0


def test_packing(spark):
    p = queries.queries()["op9_packing"](spark, SF).toPandas()
    assert set(p.doc_id) == {r["doc_id"] for r in source(spark, "documents").collect()}
    assert p.groupby("doc_id").length.sum().eq(p.groupby("doc_id").doc_tokens.first()).all() and p.groupby("sequence_id").length.sum().le(2048).all()


def test_neighbours(spark):
    out = queries.queries()["op10_nearest"](spark, SF).toPandas()
    v = {r["vec_id"]: r["embedding"] for r in source(spark, "embeddings").collect()}
    score = lambda a, b: sum(float(x) * float(y) for x, y in zip(v[a], v[b], strict=True))
    found = total = 0
    for q, g in out.groupby("query_id"):
        best = sorted(((-score(q, c), c) for c in v if c != q))[:20]
        found += len({c for _, c in best} & set(g.vec_id))
        total += len(best)
        assert all(abs(score(q, r.vec_id) - r.score) < 1e-9 for r in g.itertuples())
    assert total == 20 * sum(i % 20 == 0 for i in v) and found / total >= 0.9


def test_archives_equal_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    want = c.sql(warc.OP7_SQL).df()
    got = queries.queries()["op7_warc"](spark, SF).toPandas()[list(want.columns)]
    plain = lambda df: sorted(df.astype(object).where(df.notna(), -1).astype(str).replace(r"\.0$", "", regex=True).itertuples(index=False, name=None))
    assert plain(got) == plain(want)


def test_collocations_equal_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = c.sql(queries.oracle_sql()["op13_collocations"]).df()
    got = queries.queries()["op13_collocations"](spark, SF).toPandas()
    rows = lambda df: sorted(df[["lang", "rank", "phrase", "a", "l", "r", "n", "score"]].itertuples(index=False, name=None))
    assert rows(got) == rows(want) and len(got)


def test_whitened_covariance_is_the_identity(spark):
    out = queries.queries()["op11_whitening"](spark, SF).toPandas()
    rows = source(spark, "embeddings").collect()
    assert len(out) == 16 * len(rows) and out.identity_error.max() < 1e-9
    y = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    distinct = np.unique(np.floor(64 * np.array([r["embedding"] for r in sorted(rows, key=lambda r: r["vec_id"])], dtype=float)), axis=0, return_index=True)[1]
    cov = np.cov(y[distinct].T, bias=True)
    assert np.abs(cov - np.eye(16)).max() < 1e-9 and out.n.eq(len(distinct)).all()
