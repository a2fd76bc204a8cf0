"""Every registered query and the pipeline over odd rows and over empty tables."""

import pytest

import corpus_pipeline
from spanframe.llm import queries
from tests.llm.tables import texts, write_tables

PER_DOCUMENT = ("op1_", "op2_", "op4_", "op5_", "op6_", "op7_", "op10_", "op13_")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write_tables(spark, str(tmp_path_factory.mktemp("odd")))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write_tables(spark, str(tmp_path_factory.mktemp("empty")), rows=False)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows(spark, odd, name):
    rows = queries.QUERIES[name](spark, odd).collect()
    n = len(texts()) + 4
    if name.startswith(PER_DOCUMENT):
        assert len(rows) == n
    if name.startswith(("op1_", "op10_")):
        assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["held_out"] is not None for r in rows)
    if name.startswith("op2_"):
        by = {r["doc_id"]: r for r in rows}
        assert by[18]["n_words"] == 0 and by[18]["base_failed"] and not by[18]["kept"]
    if name.startswith("op3_"):
        assert {(r["doc_id"], r["item_id"]) for r in rows} >= {(0, 1), (1, 3)} and not any(r["doc_id"] == 18 for r in rows)
    if name.startswith("op4_"):
        assert sum(r["n_tokens"] for r in rows) == max(r["start"] + r["n_tokens"] for r in rows)
        assert next(r for r in rows if r["doc_id"] == 18)["n_tokens"] == 1
    if name.startswith("op5_"):
        by = {r["doc_id"]: r for r in rows}
        assert by[18]["lang_pred"] == by[19]["lang_pred"] == by[26]["lang_pred"] == "und"
    if name.startswith("op6_"):
        by = {r["doc_id"]: r for r in rows}
        assert by[18]["text"] is None and by[19]["text"] == "" and by[32]["n_entities"] == 2 and "anna.b" not in by[32]["text"]
    if name.startswith("op7_"):
        by = {r["doc_id"]: r for r in rows}
        assert by[18]["n_shingles"] == 0 and by[18]["component_id"] == 18 and by[36]["component_id"] == 0
        assert by[23]["component_id"] == 23 and by[24]["component_id"] == 23  # ONE two, one two
    if name.startswith("op8_"):
        total = {}
        for r in rows:
            total.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for places in total.values():
            assert sum(n for _, n in places) <= 1024
            assert all(sum(n for o2, n in places if o2 < o) == o for o, _ in places)
    if name.startswith("op9_"):
        assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in rows), key=str) == sorted(
            [(1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (None, "response", None), (None, "revisit", 2), (5, "response", None)], key=str
        )


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_pipeline_on_odd_rows(spark, odd):
    docs = corpus_pipeline.table(spark, odd, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns, name
        assert out.dtypes == docs.dtypes, name
        docs = corpus_pipeline.stored(out, name)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, odd).count() >= docs.count()


def test_pipeline_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
