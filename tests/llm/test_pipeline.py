"""The pipeline's stages, each on its own input."""

from __future__ import annotations

import corpus_pipeline
import pytest

from .test_operators import own

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not __import__("os").path.exists(SF), reason="no test data")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "mixing", "token_ids"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.count() > 0
        if name != "token_ids":
            assert out.columns == columns
            kept = {r.doc_id for r in out.select("doc_id").collect()}
            assert kept <= ids
            if name == "near_dedup":
                assert out.count() == len(kept)
            ids = kept
        else:
            assert {r.doc_id for r in out.collect()} == ids
        docs = out


DOCS = "doc_id long, text string, lang string, source string, n_chars long, doc string, size int, label int, node string"


def test_stages_on_awkward_rows(spark, tmp_path):
    rows = [(i, " ".join(f"word{(i * 7 + k) % 97}" for k in range(40)), "en", f"s{i % 3}", 1, "d", i, None, "n") for i in range(60)]
    rows += [(None, None, None, None, None, None, None, None, None)] * 2 + [(5, "", "en", "s1", 0, "d", 1, 1, "n")] * 3 + [(70, "x" * 100_000, "de", None, 1, None, 2, 2, None)]
    for k, given in enumerate((rows, rows[:0])):
        docs = spark.createDataFrame(given, DOCS)
        for name, table in (("labels", [(i, i % 2, 0) for i in range(60)] if k == 0 else []), ("benchmark", [(1, rows[3][1]), (2, None)] if k == 0 else [])):
            schema = "doc_id long, quality int, toxic int" if name == "labels" else "item_id long, text string"
            spark.createDataFrame(table, schema).write.parquet(str(tmp_path / str(k) / f"{name}.parquet"))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path / str(k)))
            assert out.columns == docs.columns
            kept = out.collect()
            if name == "mixing":
                assert {tuple(r) for r in kept} <= {tuple(r) for r in given}
            elif name == "near_dedup":
                assert len(kept) == len({r.text or "" for r in kept}) <= len(given)
            else:
                assert len(kept) <= len(given)
            if name == "decontamination" and k == 0:
                assert 3 not in {r.doc_id for r in kept} and len(kept) > len(given) - 10
        tokens = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path / str(k)))
        assert tokens.count() == len(given)


@pytest.mark.skipif(not __import__("os").path.exists(SF), reason="no test data")
def test_run_leaves_only_its_result(spark):
    from quillstone.llm import common

    common.release(spark)
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len(own(root)) == 1
    common.release(spark)
    assert not own(root)
