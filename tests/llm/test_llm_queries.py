import pytest

import __spark_entry__ as entry
from papyrine.llm import registry

COLUMNS = {
    "p4_found": {"record_table", "document_id", "record_id"}, "p5_found": {"record_table", "document_id", "record_id", "segment_no"}, "p6_found": {"record_table", "document_id", "record_id"},
    "p7_found": {"record_table", "document_id", "record_id", "field", "char_end"}, "p8_ids": {"doc_id", "ids"}, "p10_found": {"doc_id"},
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_runs(spark, data, name):
    df = entry.queries()[name](spark, data).cache()
    assert df.count() > 0
    if name in COLUMNS:
        assert set(df.columns) == COLUMNS[name]
        if name != "p8_ids":
            assert df.count() == df.distinct().count()
        else:
            assert df.count() == spark.read.parquet(f"{data}/documents.parquet").count()


def test_clean_text_of_every_record(spark, tmp_path):
    graph = [("p", "b1", "pdf", "a **bold** b", "see [FORMULA_001]"), ("p", "b2", "pdf", "so **it** is", None), (None, "b3", "pdf", "plain", "<b>x</b> y"), ("p", "b4", "pdf", "z", "<b>z</b>")]
    plain = [("p", "b1", "tex_source", "\\emph{so} on"), ("p", "b2", "tex_source", "\\emph{it} is"), ("p", "b5", "tex_source", "")]
    docs = [(7, None, "web", "\\emph{one} only"), (8, "p", "web", "plain (text)")]
    spark.createDataFrame(graph + graph[:1], "document_id string, block_id string, text_source string, text string, text_with_tokens string").write.parquet(f"{tmp_path}/graph_text_blocks.parquet")
    spark.createDataFrame(plain, "document_id string, block_id string, text_source string, text string").write.parquet(f"{tmp_path}/text_blocks.parquet")
    spark.createDataFrame(docs, "doc_id long, paper_id string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = entry.queries()["p4_clean"](spark, str(tmp_path)).collect()
    assert {(r.record_table, r.document_id, r.record_id, r.field): r.clean_text for r in rows} == {
        ("graph_text_blocks", "p", "b1", "text"): "a bold b", ("graph_text_blocks", "p", "b1", "text_with_tokens"): "see [FORMULA_001]", ("graph_text_blocks", "p", "b2", "text"): "so it is", ("graph_text_blocks", "p", "b2", "text_with_tokens"): None,
        ("graph_text_blocks", None, "b3", "text"): "plain", ("graph_text_blocks", None, "b3", "text_with_tokens"): "x y", ("graph_text_blocks", "p", "b4", "text"): "z", ("graph_text_blocks", "p", "b4", "text_with_tokens"): "z",
        ("text_blocks", "p", "b1", "text"): "so on", ("text_blocks", "p", "b2", "text"): "it is", ("text_blocks", "p", "b5", "text"): "",
        ("documents", "", "7", "text"): "one only", ("documents", "p", "8", "text"): "plain (text)",
    }
    assert len(rows) == 13
