import os

import corpus_pipeline
import pytest

from brightloom.llm import toxicity
from tests.llm import test_decontaminate, test_ngram_join, test_repeats


def test_stages_against_brute_force(spark, data_folder):
    """Each stage's result from what the one before kept; the learned scores are taken from their operator."""
    docs = spark.read.parquet(f"{data_folder}/documents.parquet")
    labels = spark.read.parquet(f"{data_folder}/labels.parquet")
    scores = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if scores[r["doc_id"]] < 0.5]
    kept = {c for _, n, c in test_ngram_join.brute(rows, 5, 80)}
    rows = [r for r in rows if r[0] in kept]
    gone = {i: n - removed for i, n, removed, *_ in test_repeats.brute(rows, 200)}

    stages, state, tables = dict(corpus_pipeline.STAGES), docs, {}
    for name, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, data_folder).cache()
        tables[name] = state
    assert list(stages) == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "bpe_encoding"]
    assert {r["doc_id"] for r in tables["ngram_jaccard_join"].collect()} == {i for i, _ in rows}
    cut = tables["suffix_array_dedup"].collect()
    assert {r["doc_id"] for r in cut} == {i for i, _ in rows}
    assert all(gone[r["doc_id"]] - 12 <= len(r["text"].encode()) <= gone[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in cut)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data_folder}/benchmark.parquet").collect()]
    clean = {r[0] for r in test_decontaminate.brute([(r["doc_id"], r["text"]) for r in cut], items) if not r[-1]}
    assert {r["doc_id"] for r in tables["benchmark_decontamination"].collect()} == clean
    last = tables["bpe_encoding"].collect()
    assert {r["doc_id"] for r in last} == clean
    for name in list(stages)[:-1]:
        assert tables[name].columns == docs.columns
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, data_folder).select("doc_id", "decoded").collect()) == sorted((r["doc_id"], r["decoded"]) for r in last)


@pytest.mark.parametrize("name", ["op8_prefix_decontamination", "op9_fixity_audit"])
def test_queries_against_sql(spark, data_folder, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry
    import check

    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(data_folder, t)}.parquet'")
    df = entry.queries()[name](spark, data_folder)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(names, cursor.fetchall())
