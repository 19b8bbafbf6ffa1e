import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tests.llm.conftest import EDGE_IDS, EDGE_TEXTS, prose

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.queries() if n.startswith("op") and n[2].isdigit())
COLUMNS = {
    "op1": {"page_id", "url", "text", "n_chars"}, "op2": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op3": {"doc_id", "n_shingles", "component_id"}, "op4": {"doc_id", "held_out", "score", "predicted"},
    "op6": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op7": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op8": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op10": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op11": {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"},
    "op12": {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"},
    "op13": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"}}
#: Table and rows for each of its rows; one row a document elsewhere.
ROWS = {"op1": ("pages", 1), "op11": ("embeddings", 32), "op12": ("embeddings", 1)}


@pytest.mark.parametrize("name", NAMES)
def test_queries_return_every_row(spark, name):
    df = entry.queries()[name](spark, SF)
    assert COLUMNS.get(name.split("_")[0], {"doc_id"}) <= set(df.columns)
    if name.startswith("op13_"):
        want = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count() + 1
    else:
        table, each = ROWS.get(name.split("_")[0], ("documents", 1))
        want = each * spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert df.count() == want


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry.oracle_sql()])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_all_operators_and_the_pipeline_are_registered():
    assert [n for k in range(1, 14) for n in NAMES if n.startswith(f"op{k}_")].__len__() == 13 == len(NAMES)
    assert "pipeline" in entry.queries()
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_passages", "personal_data", "token_ids"]


def test_stages(spark, make_docs, tmp_path):
    clean = [" ".join(prose(i, 120, 3000)) for i in range(6)]
    leak = " ".join(prose(77, 30, 3000))
    texts = clean + [clean[0] + " extra", f"{clean[1][:-400]} {leak} " + " ".join(prose(88, 200, 3000)),
                     " ".join(prose(99, 150, 3000)) + " card 7536784127813050", "junk " * 200, "short", None, ""]
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = make_docs(texts)
    seen = []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "token_ids":
            assert out.columns == docs.columns
            assert all(r.text is None or r.n_chars == len(r.text) for r in out.collect())
        seen.append({r.doc_id: r for r in out.collect()})
        docs = out
    assert set(seen[0]) == set(range(9))
    assert set(seen[1]) == set(range(9)) - {6}
    assert seen[2][0].text == clean[0] and leak not in seen[2][7].text and seen[2][7].text.split()[0] == texts[7].split()[0]
    assert "7536784127813050" not in seen[3][8].text and seen[3][2].text == clean[2]
    assert all(r.round_trip for r in seen[4].values()) and set(seen[4]) == set(seen[3])


def test_stages_on_edge_rows_and_empty_tables(spark, make_docs, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (make_docs(EDGE_TEXTS, EDGE_IDS), make_docs([])):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path)).collect()
            assert len(out) <= docs.count()


def test_run_writes_and_rereads(spark):
    assert pipeline.run(spark, SF).count() > 0
