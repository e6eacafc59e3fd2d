"""Evaluation of recognised lines against references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T

COVERAGE_POINTS = (0.25, 0.5, 0.75, 1.0)
#: Ranges of confidence that are summed before any line is ranked.
RANGES = 4096


def align(references: DataFrame, words: DataFrame, case: list[str]) -> DataFrame:
    """Pair reference lines (``line_no``, ``reference``) with words (``reading_order``, ``hypothesis``,
    ``decision_state``, ``confidence``) by their place within a case.

    Words beyond the references get an empty one; references beyond the words
    get an illegible, empty hypothesis.
    """
    by_line = Window.partitionBy(*case).orderBy("line_no")
    by_order = Window.partitionBy(*case).orderBy("reading_order", "word_id") if "word_id" in words.columns else Window.partitionBy(*case).orderBy("reading_order")
    left = references.withColumn("place", F.row_number().over(by_line) - 1).select(*case, "place", "reference")
    right = words.withColumn("place", F.row_number().over(by_order) - 1).select(*case, "place", "hypothesis", "decision_state", "confidence")
    return left.join(right, [*case, "place"], "full_outer").select(
        *case,
        "place",
        F.coalesce("reference", F.lit("")).alias("reference"),
        F.coalesce("hypothesis", F.lit("")).alias("hypothesis"),
        F.coalesce("decision_state", F.lit(T.ILLEGIBLE)).alias("decision_state"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def judge(pairs: DataFrame, max_cer: float = T.MAX_LINE_CER) -> DataFrame:
    """Add ``correct``, ``fce`` (wrong though accepted) and ``fve`` (wrong and visible)."""
    state = F.upper(F.coalesce("decision_state", F.lit(T.REVIEW)))
    ref, hyp = F.coalesce("reference", F.lit("")), F.coalesce("hypothesis", F.lit(""))
    out = pairs.withColumns({"reference": ref, "hypothesis": hyp, "decision_state": state, "confidence": F.coalesce("confidence", F.lit(0.0))})
    out = out.withColumns({"_normal_ref": T.kept(T.normalize(F.col("reference"))), "_normal_hyp": T.kept(T.normalize(F.col("hypothesis")))})
    correct = T.line_correct(F.col("reference"), F.col("hypothesis"), max_cer, (F.col("_normal_ref"), F.col("_normal_hyp")))
    out = out.withColumn("correct", correct).drop("_normal_ref", "_normal_hyp")
    wrong = ~F.col("correct")
    return out.withColumns(
        {
            "fce": wrong & (F.col("decision_state") == T.ACCEPTED),
            "fve": wrong & T.is_visible(F.col("hypothesis"), F.col("decision_state")) & F.col("decision_state").isin(T.ACCEPTED, T.REVIEW),
        }
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / F.greatest(whole, F.lit(1)))


def summarise(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates per group; one shuffle with map-side sums."""
    state, correct = F.col("decision_state"), F.col("correct")
    truly_illegible = (T.strip(F.col("reference")) == "") | T.normalize(F.col("reference")).isin("[illegible]", "illegible")
    counts = judged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(state == T.ACCEPTED).alias("accepted"),
        F.count_if(state == T.REVIEW).alias("review"),
        F.count_if(state == T.ILLEGIBLE).alias("illegible"),
        F.count_if(state == T.CROSSED_OUT).alias("crossed_out"),
        F.count_if((state == T.ACCEPTED) & correct).alias("correct_accepted"),
        F.count_if((state == T.ACCEPTED) & ~correct).alias("incorrect_accepted"),
        F.count_if((state == T.REVIEW) & correct).alias("correct_review"),
        F.count_if((state == T.REVIEW) & ~correct).alias("incorrect_review"),
        F.count_if((state == T.ILLEGIBLE) & truly_illegible).alias("correct_illegible"),
        F.count_if((state == T.ILLEGIBLE) & ~truly_illegible).alias("incorrect_illegible"),
        F.count_if("fce").alias("fce_count"),
        F.count_if("fve").alias("fve_count"),
    )
    n = F.col("total_lines")
    return counts.withColumns(
        {
            "fce_rate": _share(F.col("fce_count"), n),
            "fce_rate_among_accepted": _share(F.col("incorrect_accepted"), F.col("accepted")),
            "fve_rate": _share(F.col("fve_count"), n),
            "review_rate": _share(F.col("review"), n),
            "abstention_rate": _share(F.col("illegible") + F.col("review"), n),
            "coverage_accepted": _share(F.col("accepted"), n),
            "accepted_accuracy": _share(F.col("correct_accepted"), F.col("accepted")),
        }
    )


def full_text_scores(judged: DataFrame, keys: list[str], order: str = "place") -> DataFrame:
    """Error rates of a case's whole text (without crossed-out lines), and of its accepted part (selective risk)."""
    at = F.col(order)
    shown = F.when(F.col("decision_state") != T.CROSSED_OUT, F.col("hypothesis"))
    ok = F.col("decision_state") == T.ACCEPTED
    # edit distances of whole texts cost far more than their bytes suggest: keep the tasks apart
    spread = int(judged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = judged.repartition(spread, *keys).groupBy(*keys).agg(
        T.joined(F.col("reference"), at).alias("ref_text"),
        F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct(at.alias("o"), shown.alias("v")))), lambda p: p["v"].isNotNull()), lambda p: p["v"]), "\n").alias("hyp_text"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct(at.alias("o"), F.col("reference").alias("v"))))), lambda p: p["v"]), "\n").alias("ref_accepted"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct(at.alias("o"), F.col("hypothesis").alias("v"))))), lambda p: p["v"]), "\n").alias("hyp_accepted"),
        F.count_if(ok).alias("n_accepted"),
    )
    ref, hyp = F.col("ref_text"), F.col("hyp_text")
    return texts.select(
        *keys,
        T.cer(ref, hyp).alias("cer"),
        T.wer(ref, hyp).alias("wer"),
        T.exact_match(ref, hyp).alias("exact_match"),
        F.when(F.col("n_accepted") == 0, 0.0).otherwise(T.cer(F.col("ref_accepted"), F.col("hyp_accepted"))).alias("selective_risk"),
        T.cer(ref, F.col("hyp_accepted")).alias("accepted_text_cer"),
    )


def risk_coverage(judged: DataFrame, keys: list[str], order: list[str], points: tuple[float, ...] = COVERAGE_POINTS) -> DataFrame:
    """Errors among the most confident share of each group's lines; ``order`` breaks ties.

    Lines are summed by ranges of confidence.  Whole ranges above a cut count by
    their sums; only the lines of the range in which a cut lies are ranked.
    """
    confidence = F.col("confidence")
    ranged = judged.withColumn("_range", F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)) * RANGES))
    sums = [
        F.count(F.lit(1)).alias("_n"),
        F.count_if(~F.col("correct")).alias("_wrong"),
        F.count_if("correct").alias("_right"),
        F.sum(T.edits(F.col("reference"), F.col("hypothesis"))).alias("edits"),
        F.sum(F.length("reference")).alias("ref_chars"),
    ]
    added = ["_n", "_wrong", "_right", "edits", "ref_chars"]
    down = Window.partitionBy(*keys).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, 0)
    of = F.sum("_n").over(Window.partitionBy(*keys))
    placed = ranged.groupBy(*keys, "_range").agg(*sums).withColumns({"_upto": F.sum("_n").over(down), "_of": of})
    at = placed.withColumn("coverage", F.explode(F.array(*[F.lit(float(p)) for p in points])))
    at = at.withColumn("_k", F.least(F.col("_of"), F.greatest(F.lit(1), F.bround(F.col("coverage") * F.col("_of")).cast("long"))))
    whole = at.where(F.col("_upto") <= F.col("_k")).select(*keys, "coverage", *added)
    cuts = at.where((F.col("_upto") > F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k")))
    cuts = cuts.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_range").alias("_c_range"), "coverage", (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_need"))
    same = F.col("_range") == F.col("_c_range")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    ranked = Window.partitionBy(*keys, "coverage").orderBy(confidence.desc(), *order)
    near = ranged.join(cuts, same).withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= F.col("_need"))
    taken = whole.unionByName(near.groupBy(*keys, "coverage").agg(*sums)).groupBy(*keys, "coverage").agg(*[F.sum(c).alias(c) for c in added])
    share = lambda part: F.col(part) / F.greatest(F.col("_n"), F.lit(1))
    return taken.select(*keys, "coverage", F.col("_n").alias("n"), share("_wrong").alias("fce"), share("_right").alias("accepted_accuracy"), "edits", "ref_chars")


def evaluate_texts(cases: DataFrame) -> DataFrame:
    """The plainer evaluation: whole reference against the whole and against the accepted text.

    Needs ``ground_truth``, ``full_hypothesis``, ``accepted_hypothesis``, ``total_words``, ``accepted_words``.
    """
    truth = F.col("ground_truth")
    return cases.withColumns(
        {
            "cer": T.cer(truth, F.col("full_hypothesis")),
            "wer": T.wer(truth, F.col("full_hypothesis")),
            "accepted_cer": T.cer(truth, F.col("accepted_hypothesis")),
            "accepted_wer": T.wer(truth, F.col("accepted_hypothesis")),
            "coverage_accepted": F.col("accepted_words") / F.greatest(F.col("total_words"), F.lit(1)),
            "selective_risk": T.cer(truth, F.col("accepted_hypothesis")),
        }
    )


def mean_by_system(rows: DataFrame, measures: list[str], keys: tuple[str, ...] = ("system",)) -> DataFrame:
    """Means per system over the cases that have a value; NaN where none has."""
    nan = F.lit(float("nan"))
    means = [F.coalesce(F.avg(m), nan).alias(f"mean_{m}") for m in measures]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *means)


def kind_of_rows(kind: Column) -> Column:
    """Aggregate: the common kind, or ``mixed:`` and all kinds."""
    kinds = F.array_sort(F.collect_set(kind))
    return F.when(F.size(kinds) > 1, F.concat(F.lit("mixed:"), F.array_join(kinds, ","))).otherwise(F.try_element_at(kinds, F.lit(1)))


def derived_baselines(words: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Per line the best hypothesis of each engine family, as two systems that share the detections.

    ``words``: doc_id, line_no, and columns to keep; ``hypotheses``: doc_id, line_no, text, visual_score, model_name, ordinal.
    """
    best = F.struct(F.col("visual_score").alias("s"), (-F.col("ordinal")).alias("o"), F.col("text").alias("t"))
    families = {"print_only": T.is_print_model(F.col("model_name")), "handwriting_lines": T.is_handwriting_model(F.col("model_name"))}
    found = hypotheses.groupBy("doc_id", "line_no").agg(*[F.max(F.when(c, best)).alias(k) for k, c in families.items()])
    joined = words.join(found, ["doc_id", "line_no"], "left")
    systems = F.explode(F.array(*[F.struct(F.lit(k).alias("system"), F.col(k)["t"].alias("t"), F.col(k)["s"].alias("s")) for k in families]))
    more = [c for c in words.columns if c not in ("doc_id", "line_no")]
    rows = joined.select("doc_id", "line_no", *more, systems.alias("x")).select("doc_id", "line_no", *more, "x.*")
    usable = F.coalesce(T.strip(F.col("t")) != "", F.lit(False))
    state = F.when(~usable, T.ILLEGIBLE).when(F.col("system") == "print_only", T.ACCEPTED).when(F.col("s") >= 0.72, T.ACCEPTED).otherwise(T.REVIEW)
    return rows.select(
        "doc_id", "line_no", "system",
        F.when(usable, F.col("t")).otherwise(T.ILLEGIBLE_TEXT).alias("hypothesis"),
        state.alias("decision_state"),
        F.when(usable, F.col("s")).otherwise(0.0).alias("confidence"),
        *more,
    )


def independent_state(system: str, score: Column, text: Column) -> Column:
    """States of the stand-alone baselines: print accepts all it reads, handwriting by score."""
    usable = T.strip(F.coalesce(text, F.lit(""))) != ""
    if system == "print_only":
        return F.when(usable, T.ACCEPTED).otherwise(T.ILLEGIBLE)
    return F.when(~usable, T.ILLEGIBLE).when(score >= 0.72, T.ACCEPTED).when(score >= 0.55, T.REVIEW).otherwise(T.ILLEGIBLE)


def configured(rows: DataFrame) -> DataFrame:
    """Rows of systems as rows of the configurations that use them (``config``)."""
    uses = F.create_map(*[F.lit(x) for pair in (("print_only", "A"), ("handwriting_lines", "B"), ("handwriting_forced", "C"), ("fused", "D,E,F")) for x in pair])
    return rows.withColumn("config", F.explode(F.split(F.try_element_at(uses, F.col("system")), ",")))


def ablation(scored: DataFrame) -> DataFrame:
    """Configurations A-F from scored systems (``system``, ``case_id``, ``baseline_kind``, measures).

    A is print only, B handwriting lines, C is B with every readable line
    accepted, D the fused system; E and F stand for runs of D with a verifier
    and with conservative limits and repeat its figures until they are measured.
    """
    rows = configured(scored)
    nan = F.lit(float("nan"))
    means = [F.coalesce(F.avg(m), nan).alias(m) for m in ("cer", "fce_rate", "review_rate", "coverage_accepted")]
    return rows.groupBy("config").agg(kind_of_rows(F.col("baseline_kind")).alias("baseline_kind"), *means, F.count(F.lit(1)).alias("n"))


def mean_risk_coverage(curves: DataFrame, keys: tuple[str, ...] = ("system",)) -> DataFrame:
    """Mean of the curves' points over cases."""
    return curves.groupBy(*keys, "coverage").agg(*[F.avg(m).alias(m) for m in ("fce", "accepted_accuracy")], F.count(F.lit(1)).alias("cases"))


def proxy_text(alternatives: Column, text: Column) -> Column:
    """What a plain engine would have read: the last alternative, else the text."""
    return F.coalesce(F.try_element_at(alternatives, F.lit(-1)), text)


def failure_cases(judged: DataFrame, order: list[str], worst: int = 20) -> DataFrame:
    """The most confident wrong lines, ties by ``order``: a report, so limited by design."""
    return judged.where("fce").orderBy(F.col("confidence").desc(), "reference", *order).limit(worst)


def extreme_cases(cases: DataFrame) -> DataFrame:
    return cases.where(F.exists(F.coalesce("tags", F.array()), lambda t: F.lower(t) == "extreme"))


#: What each configuration of the ablation uses.
EXPERIMENTS = (
    ("A", "print only", "independent", False, False),
    ("B", "handwriting lines", "derived", False, False),
    ("C", "handwriting lines, all accepted", "derived", False, False),
    ("D", "fused", "system_under_test", True, False),
    ("E", "fused with verifier", "system_under_test", True, True),
    ("F", "fused, conservative", "system_under_test", True, True),
)


def experiments(spark) -> DataFrame:
    return spark.createDataFrame(EXPERIMENTS, "config string, label string, declared_kind string, uses_fusion boolean, uses_verifier boolean")
