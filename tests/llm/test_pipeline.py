"""The stages in turn, each against brute force on its own input."""

import os

import corpus_pipeline as P
import pytest
import test_near
import test_suffixes

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = [docs]
    for name, stage in P.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        found.append(docs)
    return found


def _rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_names_and_columns(outputs):
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "repeated_strings", "mixture", "tokens"]
    for out in outputs[1:-1]:
        assert out.columns == outputs[0].columns
    assert all(0 < out.count() for out in outputs)


def test_quality_stage_only_drops(outputs):
    before, after = set(_rows(outputs[0])), set(_rows(outputs[1]))
    assert after < before


def test_one_document_of_each_group_stays(outputs):
    rows = _rows(outputs[1])
    assert {r[0] for r in _rows(outputs[2])} == {name for _, size, name in test_near.brute(rows) if size} | {d for d, size, _ in test_near.brute(rows) if not size}


def test_repeated_strings_are_cut(outputs):
    rows = _rows(outputs[2])
    want = {r[0]: r[2] for r in test_suffixes.brute(rows)}
    for doc_id, text, _, _, n_chars in _rows(outputs[3]):
        was = next(r[1] for r in rows if r[0] == doc_id)
        assert n_chars == len(text) and len(was.encode()) - len(text.encode()) >= want[doc_id]
        assert (want[doc_id] > 0) == (text != was)


def test_mixture_repeats_documents(outputs):
    before, after = set(_rows(outputs[3])), _rows(outputs[4])
    assert set(after) <= before and len(after) > len(set(after))


def test_tokens_of_every_row(outputs):
    assert sorted(r["doc_id"] for r in outputs[5].collect()) == sorted(r[0] for r in _rows(outputs[4]))
    assert {"n_tokens", "ids_sha256", "decoded_sha256"} < set(outputs[5].columns)


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is P.run
    numbered = {n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op")}
    assert numbered == {f"op{k}" for k in range(1, 11)}
