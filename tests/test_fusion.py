"""Decisions from hypotheses."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import fusion, rerank, routing
from quillstone.schemas import HYPOTHESIS

HAND, PRINT = "trocr-base", "paddleocr-rec"


def hyp(text, visual, variant="raw", model=HAND, family=None, edit=False):
    return (text, " ".join(text.split()), float(visual), variant, model, family, edit)


def decide(spark, hyps, **args):
    frame = spark.createDataFrame([(hyps,)], f"hyps array<{HYPOTHESIS.simpleString()}>")
    for name, value in args.items():
        frame = frame.withColumn(name, F.lit(value))
    return fusion.fuse(frame).first()["decision"]


def four(text, scores):
    return [hyp(text, s, v) for s, v in zip(scores, ("raw", "clahe", "denoised", "adaptive_binarized"))]


def test_consensus_is_accepted(spark):
    d = decide(spark, four("hello", (0.9, 0.88, 0.87, 0.86)), image_quality_risk=0.1)
    assert (d.state, d.text) == ("ACCEPTED", "hello")
    assert d.scores.variant_agreement == 1.0 and d.scores.character_stability == 1.0


def test_conflict_is_not(spark):
    hyps = [hyp(t, s, v) for t, s, v in zip(("alpha", "beta", "gamma", "delta"), (0.4, 0.39, 0.38, 0.37), ("raw", "clahe", "denoised", "adaptive_binarized"))]
    assert decide(spark, hyps, image_quality_risk=0.6).state in ("ILLEGIBLE", "REVIEW_REQUIRED")


def test_print_engine_alone(spark):
    hyps = [hyp("hello", 0.95, "raw", PRINT), hyp("hello", 0.9, "clahe", PRINT)]
    assert decide(spark, hyps, image_quality_risk=0.2).state != "ACCEPTED"
    line = [hyp("Patient Name: Jordan Miles", 0.92, "raw", PRINT)]
    d = decide(spark, line, image_quality_risk=0.1, script_mode="print", region_type="printed_text")
    assert (d.state, d.is_high_risk) == ("ACCEPTED", True)


def test_cross_model_disagreement(spark):
    hyps = [hyp("amoxicillin", 0.9), hyp("amoxicillin", 0.88, "clahe"), hyp("completely other", 0.9, "raw", PRINT)]
    d = decide(spark, hyps, image_quality_risk=0.1)
    assert (d.state, d.text) == ("REVIEW_REQUIRED", "amoxicillin")


def test_early_ends(spark):
    assert decide(spark, [hyp("old dose", 0.7)], is_crossed_out=True).state == "CROSSED_OUT"
    d = decide(spark, [])
    assert (d.state, d.text, d.uncertainty) == ("ILLEGIBLE", "[ILLEGIBLE]", 1.0)
    assert decide(spark, [hyp("x y", 0.9)], htr_blocked=True).state == "ILLEGIBLE"
    d = decide(spark, [hyp("abc", 0.9), hyp("abd", 0.8)], verifier_reject_all=True)
    assert (d.state, d.text, list(d.alternatives)) == ("REVIEW_REQUIRED", "abc", ["abc", "abd"])


def test_verifier_choice(spark):
    hyps = [hyp("wrong", 0.8), hyp("correct", 0.7, "clahe"), hyp("other", 0.6, "denoised")]
    assert decide(spark, hyps, verifier_index=1).text in ("correct", "[ILLEGIBLE]")
    assert decide(spark, [hyp("only", 0.8)], verifier_index=99, image_quality_risk=0.1).text == "only"


def test_downgrades(spark):
    same = four("hello there friend", (0.95, 0.95, 0.95, 0.95))
    assert decide(spark, same, image_quality_risk=0.1).state == "ACCEPTED"
    d = decide(spark, same, image_quality_risk=0.1, strike_uncertain=True)
    assert d.state == "REVIEW_REQUIRED" and d.confidence <= 0.55
    assert decide(spark, four("hello? there", (0.95,) * 4), image_quality_risk=0.1).state == "REVIEW_REQUIRED"
    assert decide(spark, same, image_quality_risk=0.9).state == "REVIEW_REQUIRED"


def test_clusters_are_first_fit(spark):
    frame = spark.createDataFrame([([hyp("hello", 0.5), hyp("hallo", 0.5), hyp("world", 0.5), hyp("hullo", 0.5), hyp("worla", 0.5)],)], f"hyps array<{HYPOTHESIS.simpleString()}>")
    assert frame.withColumn("apart", fusion.distances(F.col("hyps"))).select(fusion.cluster_numbers(F.col("hyps"), F.col("apart")).alias("n")).first().n == [0, 0, 2, 0, 2]


def test_rerank_repairs_near_words(spark):
    frame = spark.createDataFrame([(1, [hyp("amoxicilin 500 mq", 0.6), hyp("amoxicilin 500 mq", 0.55, "clahe")])], f"k int, hyps array<{HYPOTHESIS.simpleString()}>")
    out = rerank.rank(rerank.with_repairs(frame, ["k"])).first()
    assert out.hyps[0].text == "amoxicillin 500 mg" and out.hyps[0].safe_edit
    assert out.context_score == pytest.approx(0.35 * min(1.0, 0.35 + 0.2 * 2) + 0.2)
    far = spark.createDataFrame([(1, [hyp("zebra crossing", 0.6)])], f"k int, hyps array<{HYPOTHESIS.simpleString()}>")
    assert [h.text for h in rerank.rank(rerank.with_repairs(far, ["k"])).first().hyps] == ["zebra crossing"]


def test_ensemble(spark):
    frame = spark.createDataFrame([("print", [hyp("abc", 0.9)], "abd", 0.7), ("handwriting", [hyp("abc", 0.9)], "abd", 0.7), ("handwriting", [hyp("abc", 0.9)], "abc", 0.7), ("print", [hyp("abc", 0.9)], "##", 0.9)], f"s string, h array<{HYPOTHESIS.simpleString()}>, p string, c double")
    rows = frame.select(routing.ensemble(F.col("s"), F.col("h"), F.col("p"), F.col("c"), F.lit("raw")).alias("x")).collect()
    got = [[(h.text, round(h.visual, 3)) for h in r.x] for r in rows]
    assert got == [[("abd", 0.7), ("abc", 0.45)], [("abc", 0.9), ("abd", 0.245)], [("abc", 0.9)], [("abc", 0.9)]]


def test_guard_and_second_pass(spark):
    rows = spark.createDataFrame([(None, None, False), (5, None, False), (0, "invented", False), (1, "b", False), (0, None, True)], "i int, t string, f boolean")
    got = [r.s for r in rows.select(routing.guard_reply(F.array(F.lit("a"), F.lit("b")), F.col("i"), F.col("t"), F.col("f")).alias("s")).collect()]
    assert got == ["illegible", "disagreement", "disagreement", "supported", "unavailable"]
    lines = spark.createDataFrame([(1,), (2,)], "k int")
    done = spark.createDataFrame([(1, "clahe")], "k int, variant string")
    assert routing.missing_variants(lines, done, ["k"]).count() == 7
    assert [d.count() for d in routing.split_blocked(spark.createDataFrame([(True,), (None,), (False,)], "htr_blocked boolean"))] == [1, 2]


def test_candidates_are_made_once(spark, tmp_path):
    from quillstone.plans import catalog, evidence

    spark.createDataFrame([(1, "a line", "en", "s", 6)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("cluster_fold", "stability_entropy", "fuse_states"):
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("replace(replace(ref") == 3, name
    assert [h.text for h in evidence.candidates(spark, str(tmp_path)).first().hyps] == ["a line", "o lino", "a line", "A LINE", "a line"]


def test_rerank_keeps_lines_in_their_rows(spark):
    hyps = [hyp("give amoxicilin 0ng daily " * 9, 0.6), hyp("give amoxicilin ong daily " * 9, 0.5, "clahe"), hyp("GIVE", 0.4, "denoised")]
    frame = spark.createDataFrame([(1, hyps), (1, hyps[:1]), (2, []), (3, None)], f"k int, hyps array<{HYPOTHESIS.simpleString()}>")
    rows = rerank.with_repairs(frame, ["k"])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    got = [None if r.pool is None else [h.text for h in r.pool] for r in rows.collect()]
    fixed = ("give amoxicillin 0 mg daily " * 9).strip()
    assert got == [[h[0] for h in hyps] + [fixed, ("give amoxicillin ong daily " * 9).strip()], [hyps[0][0], fixed], [], None]


def test_nearest_source_by_force():
    from quillstone.functions import text as T
    from tests.test_functions import _recount

    rng = random.Random(8)
    make = lambda: "".join(rng.choice("ab é") for _ in range(rng.randint(0, 30)))
    rows = [([make() for _ in range(3)], [make() for _ in range(rng.randint(1, 4))]) for _ in range(80)] + [(["a", None], ["b", "a"]), ([], ["a"]), None]
    want = [None if r is None else [None if t is None else min(_recount(t, s) / max(len(t), len(s), 1) for s in r[1]) for t in r[0]] for r in rows]
    assert T._nearest(rows) == want


def test_rerank_asks_one_worker(spark, tmp_path):
    from quillstone.plans import catalog

    spark.createDataFrame([(1, "a line", "en", "s", 6)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    plan = catalog.QUERIES["rerank_lines"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    # one for compositions, one for all else; each that keeps rows waiting fills memory, then disk
    assert (plan.count("ArrowEvalPython"), plan.count("MapInArrow")) == (1, 1)


def test_rerank_and_fusion_agree_with_counts_of_their_own(spark):
    rng = random.Random(3)
    bits = ["5", "12/3/2020", "7 ma", "9MQ", "Rai", "Px", "patlent", "amoxicilin", "AMOXICILIN", "dr", "mg", "fever", " ", " \t", "ﬁx", "½", "KG", "café", "stones " * 9, "?", ""]
    make = lambda: " ".join(rng.choice(bits) for _ in range(rng.randint(0, 4)))
    rows = []
    for k in range(60):
        texts = [make() for _ in range(rng.randint(0, 4))]
        rows.append((k, [hyp(rng.choice([t, texts[0]]), rng.randint(0, 100) / 100, v, rng.choice([HAND, PRINT])) for t, v in zip(texts, ("raw", "clahe", "denoised", "raw"))], rng.choice([None, 0, 1])))
    rows += [(60, None, None), (61, [(None, None, 0.5, "raw", HAND, None, False)], None)]
    lines = rerank.with_repairs(spark.createDataFrame(rows, f"k int, hyps array<{HYPOTHESIS.simpleString()}>, verifier_index int"), ["k"])
    known = ("usual", "nearest", "hyp_edits", "hyp_words")
    got, want = (fusion.fuse(rerank.rank(f)).select("k", "hyps", "context_score", "decision").orderBy("k").collect() for f in (lines, lines.drop(*known)))
    assert got == want and any(h.safe_edit for r in got for h in r.hyps or [])
