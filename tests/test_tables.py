"""Metrics, integrity, store, sources and streams over small tables."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import integrity, metrics, results, store
from quillstone.sources import files
from quillstone.streaming import jobs

PAIRS = [("hello", "hello", "ACCEPTED", 0.9), ("world", "wrld", "ACCEPTED", 0.95), ("foo", "bar", "REVIEW_REQUIRED", 0.4), ("baz", "[ILLEGIBLE]", "ILLEGIBLE", 0.1)]


def pairs(spark, rows=PAIRS):
    rows = [("c", i, *r) for i, r in enumerate(rows)]
    return metrics.judge(spark.createDataFrame(rows, "case string, place int, reference string, hypothesis string, decision_state string, confidence double"))


def test_counts(spark):
    r = metrics.summarise(pairs(spark), ["case"]).first()
    assert (r.fce_count, r.correct_accepted, r.incorrect_accepted, r.fve_count) == (1, 1, 1, 2)
    assert (r.coverage_accepted, r.accepted_accuracy) == (0.5, 0.5)
    r = metrics.summarise(pairs(spark, [("abc", "[ILLEGIBLE]", "ILLEGIBLE", 0.1)] * 8), ["case"]).first()
    assert (r.fce_count, r.coverage_accepted, r.abstention_rate) == (0, 0.0, 1.0)


def test_full_text_and_curve(spark):
    r = metrics.full_text_scores(pairs(spark), ["case"]).first()
    assert r.selective_risk == pytest.approx(1 / 11)
    curve = {x.coverage: x for x in metrics.risk_coverage(pairs(spark), ["case"], ["place"]).collect()}
    assert [curve[p].n for p in (0.25, 0.5, 0.75, 1.0)] == [1, 2, 3, 4]
    assert curve[0.25].fce == 1.0 and curve[1.0].accepted_accuracy == 0.25


def test_align_pads_both_sides(spark):
    refs = spark.createDataFrame([("c", 0, "a"), ("c", 1, "b"), ("d", 0, "x")], "case string, line_no int, reference string")
    words = spark.createDataFrame([("c", 5, "a", "ACCEPTED", 0.9), ("d", 1, "x", "ACCEPTED", 0.8), ("d", 2, "y", "ACCEPTED", 0.7)], "case string, reading_order int, hypothesis string, decision_state string, confidence double")
    got = sorted((r.case, r.place, r.reference, r.hypothesis, r.decision_state) for r in metrics.align(refs, words, ["case"]).collect())
    assert got == [("c", 0, "a", "a", "ACCEPTED"), ("c", 1, "b", "", "ILLEGIBLE"), ("d", 0, "x", "x", "ACCEPTED"), ("d", 1, "", "y", "ACCEPTED")]


def test_texts(spark):
    r = metrics.evaluate_texts(spark.createDataFrame([("a b", "a c", "a", 2, 1)], "ground_truth string, full_hypothesis string, accepted_hypothesis string, total_words int, accepted_words int")).first()
    assert (r.cer, r.wer, r.coverage_accepted, r.selective_risk) == (pytest.approx(1 / 3), 0.5, 0.5, pytest.approx(2 / 3))


def test_claims(spark):
    rows = [("print_only", 0.345, 0.455, 0.895, 0.0), ("fused", 0.358, 0.521, 0.721, 0.2), ("handwriting_lines", 0.895, 0.075, 0.075, 0.9)]
    got = integrity.claims(spark.createDataFrame(rows, "system string, mean_cer double, mean_fce_rate double, mean_coverage_accepted double, mean_abstention_rate double"), 5, 1, False).collect()
    text = " ".join(r.level + " " + r.claim for r in got)
    assert "NOT_PROVEN" in text and "essentially equal" in text and "not demonstrated" in text and "abstains" in text
    ladder = spark.createDataFrame([("NOT_READY_DATASET", True, 3, 0.9, 0.0, 0.0), ("QUALIFIED", False, 3, 0.9, 0.0, 0.0), ("QUALIFIED", True, 3, 0.3, 0.5, 0.0), ("QUALIFIED", True, 3, 0.9, 0.0, 0.5), ("QUALIFIED", True, 3, 0.9, 0.0, 0.0)], "d string, s boolean, n int, a double, f double, c double")
    got = [r.x for r in ladder.select(integrity.qualification(*map(F.col, "dsnafc")).alias("x")).collect()]
    assert got == ["NOT_READY_DATASET", "NOT_READY_EVALUATION", "NOT_READY_UNCERTAINTY", "NOT_READY_ACCURACY", "QUALIFIED_FOR_INTERNAL_EVALUATION"]


def test_manifests_to_gate(spark, tmp_path):
    root = tmp_path / "data"
    (root / "images").mkdir(parents=True)
    for i in range(20):
        (root / "images" / f"p{i}.png").write_bytes(b"image" + str(min(i, 17)).encode())
    cases = [{"id": f"c{i}", "image": f"p{i}.png", "ground_truth": f"text {i}", "source": "s", "is_synthetic": False, "script": "latin", "tags": ["extreme"]} for i in range(20)]
    (root / "manifest.json").write_text(json.dumps({"name": "q", "cases": cases}))
    (tmp_path / "bare.json").write_text(json.dumps(cases[:2]))
    assert files.manifest_cases(spark, str(tmp_path / "bare.json"), "dev").count() == 2
    loaded = files.manifest_cases(spark, str(root / "manifest.json"), "qualification")
    found = files.uploads(spark, str(root)).withColumn("path", F.regexp_replace("path", "^file:", ""))
    assert found.where("problem is not null").select("filename").first().filename == "manifest.json"
    resolved = files.resolve_images(loaded, found, str(root))
    assert resolved.where("image_sha256 = ''").count() == 0
    gate = integrity.gate(integrity.inspect(resolved)).first()
    assert (gate.eligible, gate.duplicates, gate.decision) == (20, 1, "NOT_READY_DATASET")
    assert files.select_cases(loaded, hard_only=True).count() == 20
    assert integrity.split_counts(integrity.inspect(resolved)).first().extreme == 20


def test_store(spark, tmp_path):
    store.create_tables(spark, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/word_evidence")).count() == 0
    base = spark.createDataFrame([(1, "a", "x", 0), (2, "b", "y", 0)], "id int, t string, s string, v int")
    changes = spark.createDataFrame([(1, "c", None, 1), (1, "d", None, 2), (3, "e", "z", 1)], "id int, t string, s string, v int")
    assert sorted(map(tuple, store.upsert(base, changes, ["id"], "v", ("s",)).collect())) == [(1, "d", "x", 2), (2, "b", "y", 0), (3, "e", "z", 1)]
    blobs = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"b"),)], "content binary")
    have = blobs.where("content = X'62'").select(F.sha2("content", 256).alias("sha256"))
    assert store.write_once(blobs, have).count() == 1
    arts = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, source_artifact_id string")
    assert sorted(map(tuple, store.lineage(arts).collect())) == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2)]


def test_corrections(spark):
    words = spark.createDataFrame([("w", "old", "REVIEW_REQUIRED"), ("v", "keep", "ACCEPTED")], "word_id string, text string, decision_state string")
    patches = spark.createDataFrame([("w", " new  text ", None, 1), ("w", None, "crossed_out", 2), ("v", None, "bogus", 3)], "word_id string, new_text string, new_state string, n int")
    now, log = store.correct(words, patches, ["n"])
    assert sorted(map(tuple, now.collect())) == [("v", "keep", "ACCEPTED"), ("w", "new text", "CROSSED_OUT")]
    assert [(r.previous_text, r.new_text, r.previous_state, r.new_state) for r in log.orderBy("n").collect()] == [("old", "new text", "REVIEW_REQUIRED", "ACCEPTED"), ("new text", "new text", "ACCEPTED", "CROSSED_OUT")]


def test_views(spark):
    pages = spark.createDataFrame([("p", 0), ("q", 1)], "id string, page_index int")
    lines = spark.createDataFrame([("l2", "p", 1, "x"), ("l1", "p", 0, "y")], "id string, page_id string, reading_order int, region_type string")
    hyps = spark.createDataFrame([("l1", 2, "b", 0.1, "m"), ("l1", 1, "a", 0.2, "m")], "line_id string, rank int, text string, visual_score double, model_name string")
    rows = {r.id: r for r in results.assemble(pages, lines, hyps).collect()}
    assert [line.id for line in rows["p"].lines] == ["l1", "l2"] and [h.text for h in rows["p"].lines[0].hypotheses] == ["a", "b"]
    assert rows["q"].lines is None
    j = spark.createDataFrame([("d", "1", 1, "queued"), ("d", "2", 2, "completed")], "document_id string, id string, created_at int, status string")
    assert results.job_status(j).first().status == "completed"
    as_json, as_md = files.report_text([{"system": "a", "cer": 0.5}], "Report", ["system", "cer"])
    assert json.loads(as_json)[0]["cer"] == 0.5 and "| a | 0.500 |" in as_md


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(400).cache()
    for i in range(3):
        events.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_events(spark, str(tmp_path / "in"))
    query = jobs.keep_jobs(jobs.deduplicated(stream, "100 days"), str(tmp_path / "jobs"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    last = max(tmp_path.joinpath("jobs").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    got = sorted((r.document_id, r.stage, r.event_id) for r in spark.read.parquet(str(last)).collect())
    assert got == sorted((r.document_id, r.stage, r.event_id) for r in jobs.current_jobs(events).collect())
    counted = jobs.stage_counts(jobs.read_events(spark, str(tmp_path / "in")), lateness="100 days").writeStream.format("memory").queryName("stages").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination(120)
    assert spark.sql("select sum(count) from stages").first()[0] == events.count()
    audit = jobs.append_stream(jobs.read_events(spark, str(tmp_path / "in")).select("event_id"), str(tmp_path / "audit"), str(tmp_path / "cp2"))
    audit.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "audit")).count() == events.count()


def test_smaller_views(spark):
    from quillstone.operators import providers

    old = [[[[0, 0], [1, 1]], ("a", 0.9)], [[[2, 2], [3, 3]], ("b", 0.8)]]
    new = [{"rec_polys": [[[0, 0], [1, 1]]], "rec_texts": ["a"], "rec_scores": [0.9]}]
    assert [(t, s) for _, t, s in providers.flatten_result([old])] == [("a", 0.9), ("b", 0.8)]
    assert providers.flatten_result(new) == [([[0, 0], [1, 1]], "a", 0.9)] and providers.flatten_result(None) == []
    assert providers.settings({})["verifier"] is None
    assert providers.settings({"QUILLSTONE_VERIFIER_ENABLED": "1", "QUILLSTONE_VERIFIER_ENDPOINT": "x"})["verifier"] == "x"
    item = "array<struct<text:string,category:string,confidence:double>>"
    rows = spark.createDataFrame([([("a", None, None)], [("w", "x", 1.0)]), ([], [("w", "x", 1.0)])], f"r {item}, w {item}")
    got = [[tuple(i) for i in x.i] for x in rows.select(results.line_items(F.col("r"), F.col("w")).alias("i")).collect()]
    assert got == [[("a", "other", 0.0)], [("w", "x", 1.0)]]
    pages = spark.createDataFrame([("d", 1, ["c"]), ("d", 0, ["a", "b"])], "doc string, page int, items array<string>")
    assert results.merge_pages(pages, ["doc"], "items", "page").first()["items"] == ["a", "b", "c"]
    assert results.lookup(pages, "page", 1).count() == 1
    kinds = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "s string, k string").groupBy("s").agg(metrics.kind_of_rows(F.col("k")).alias("k"))
    assert {r.s: r.k for r in kinds.collect()} == {"a": "mixed:x,y", "b": "x"}
    assert metrics.experiments(spark).count() == 6
    audit = spark.createDataFrame([("d", 3, "2024-01-01")], "d string, n int, t string").select(*results.audit_event(F.col("d"), "processing_complete", F.struct("n"), F.col("t"))).first()
    assert audit.payload == '{"n":3}' and len(audit.id) == 32
    with pytest.raises(RuntimeError):
        files.pdf_pages(b"%PDF")


def test_evidence_holds_every_line(spark, tmp_path):
    from quillstone.plans import catalog, evidence

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    long = "the sea takes stones " * 30
    many = " ".join(f"te{k}" for k in range(5600))
    texts = {1: "Élève très naïf\nab\n\n  padded line ", 2: long, 3: "größe des Straßennetzes\r\nplain line", 4: "", 5: "señal\n" + long + "ñ", 6: many}
    rows = [(d, t, "fr", "s", len(t)) for d, t in texts.items()] + [(7, None, "fr", "s", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    want = {(d, n): line for d, t in texts.items() for n, line in enumerate(t.split("\n"))}
    assert {(r.doc_id, r.line_no): r.ref for r in evidence.lines(spark, str(tmp_path)).collect()} == want
    words = {(r.doc_id, r.line_no): r.hypothesis for r in evidence.words(spark, str(tmp_path)).collect()}
    got = {(r.doc_id, r.line_no): r for r in catalog.QUERIES["cer_wer_lines"](spark, str(tmp_path)).collect()}
    assert got.keys() == words.keys() == want.keys()
    for k, ref in want.items():
        if k[0] != 6:
            assert got[k].cer == pytest.approx(edits(ref, words[k]) / len(ref) if ref else 0.0, abs=1e-8)
        assert got[k].wer == pytest.approx(edits(ref.split(), words[k].split()) / len(ref.split()) if ref.split() else 0.0, abs=1e-8) if k[0] != 6 else got[k].wer in (0.0, 1.0)
    assert {r.doc_id for r in catalog.QUERIES["accepted_text"](spark, str(tmp_path)).collect()} == set(texts)
    assert catalog.QUERIES["rerank_lines"](spark, str(tmp_path)).count() == len(want)
    assert catalog.QUERIES["systems_summary"](spark, str(tmp_path)).count() == 4


def test_pairs_and_systems_take_all_rows(spark, tmp_path):
    from quillstone.plans import catalog

    rows = [(d, "\n".join(f"line {n} of {d}" for n in range(16)), "en", "s", 1) for d in range(1, 8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    pairs = catalog.QUERIES["align_refs"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.place): r.reference for r in pairs} == {(d, n): f"line {n} of {d}" for d in range(1, 8) for n in range(16)}
    assert all(r.hypothesis for r in pairs)
    systems = catalog.QUERIES["derived_baselines"](spark, str(tmp_path)).collect()
    assert len(systems) == 2 * 7 * 16 and not [r for r in systems if r.hypothesis == "[ILLEGIBLE]"]


def test_baselines_without_hypotheses(spark):
    lines = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, line_no long")
    hyps = spark.createDataFrame([(1, 0, 0, "raw", "trocr-x", "a", 0.9)], "doc_id long, line_no long, ordinal int, variant string, model_name string, text string, visual_score double")
    got = {(r.line_no, r.system): (r.hypothesis, r.decision_state) for r in metrics.derived_baselines(lines, hyps).collect()}
    none = ("[ILLEGIBLE]", "ILLEGIBLE")
    assert got == {(0, "handwriting_lines"): ("a", "ACCEPTED"), (0, "print_only"): none, (1, "handwriting_lines"): none, (1, "print_only"): none}


def test_lineage_of_any_length(spark):
    rows = [(f"a{i}", f"a{i - 1}" if i else None) for i in range(21)] + [("b", "gone"), ("c", "b")]
    got = {r.id: (r.root, r.steps) for r in store.lineage(spark.createDataFrame(rows, "id string, source_artifact_id string")).collect()}
    assert got == {f"a{i}": ("a0", i) for i in range(21)} | {"b": ("b", 0), "c": ("b", 1)}
    for circle in ([("x", "y"), ("y", "x")], [("x", "y"), ("y", "z"), ("z", "x")], [("x", "x")]):
        with pytest.raises(ValueError):
            store.lineage(spark.createDataFrame(circle, "id string, source_artifact_id string")).collect()
    assert store.lineage(spark.createDataFrame([], "id string, source_artifact_id string")).count() == 0


@pytest.mark.parametrize("ranges", [4096, 3, 1])
def test_curve_by_force(spark, monkeypatch, ranges):
    monkeypatch.setattr(metrics, "RANGES", ranges)
    rng = random.Random(4)
    rows = [("k" if i % 3 else None, i, "abcd", rng.choice(["abcd", "abxx"]), "ACCEPTED", rng.choice([0.1, 0.5, 0.5, 0.7, rng.random()])) for i in range(90)] + [("one", 0, "ab", "ab", "ACCEPTED", 1.0)]
    judged = metrics.judge(spark.createDataFrame(rows, "case string, place int, reference string, hypothesis string, decision_state string, confidence double"))
    got = {(r.case, r.coverage): (r.n, round(r.fce, 9), r.edits, r.ref_chars) for r in metrics.risk_coverage(judged, ["case"], ["place"]).collect()}
    want = {}
    for case in ("k", None, "one"):
        own = sorted((r for r in rows if r[0] == case), key=lambda r: (-r[5], r[1]))
        for p in metrics.COVERAGE_POINTS:
            k = min(len(own), max(1, round(p * len(own))))
            wrong = sum(r[3] == "abxx" for r in own[:k])
            want[case, p] = (k, round(wrong / k, 9), 2 * wrong, sum(len(r[2]) for r in own[:k]))
    assert got == want


def test_report_works_scores_out_once(spark, tmp_path):
    from quillstone.operators import reports
    from quillstone.plans import catalog, more  # noqa: F401

    cols = ", ".join(f"{m} double" for m in reports.SHOWN)
    rows = [("fused", "x", 0.1, 0.0, 0.0, 0.5, 0.0, 0.0), ("fused", "y", 0.3, 0.0, 0.0, 0.0, 0.0, 0.0), ("other", "x", None, 0.0, 0.0, 1.0, 0.0, 1.0)]
    systems = {r.system: r for r in reports.by_system(spark.createDataFrame(rows, f"system string, baseline_kind string, {cols}")).collect()}
    assert (systems["fused"].n, systems["fused"].mean_cer, systems["fused"].kinds, systems["fused"].failing) == (2, pytest.approx(0.2), ["x", "y"], 1)
    assert systems["other"].mean_cer != systems["other"].mean_cer and systems["other"].failing == 0
    spark.createDataFrame([(d, f"line of {d}\nmore", "en", "s", 1) for d in range(1, 5)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    report = catalog.QUERIES["qualification_report"](spark, str(tmp_path))
    assert "visual_score" not in report._jdf.queryExecution().analyzed().toString()
    assert {r.section for r in report.collect()} == set(range(7))


def test_scores_join_texts_once_and_normalise_once(spark, tmp_path):
    from quillstone.plans import catalog

    spark.createDataFrame([(1, "A line\nmore", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    plan = catalog.QUERIES["claims"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("lower(reference") == 1
