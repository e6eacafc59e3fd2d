"""Checks of evaluation data sets: duplicates, leaks, eligibility, and what may be claimed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T

MIN_REAL, TARGET_REAL = 15, 30


def truth_hash(truth: Column) -> Column:
    """SHA-256 of the reference in normal form; null for a blank one."""
    return F.when(T.strip(F.coalesce(truth, F.lit(""))) != "", F.sha2(T.normalize(truth), 256))


def inspect(cases: DataFrame) -> DataFrame:
    """Add ``issues``, ``gt_sha256`` to cases (split, id, image_name, image_sha256, ground_truth, is_synthetic, needs_gt_review, source, script, tags, notes)."""
    qual, synthetic = F.col("split") == "qualification", F.coalesce("is_synthetic", F.lit(False))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    placeholder = ~blank("image_sha256") & T.is_placeholder_name(F.col("image_name"), F.col("id"))
    rules = {
        "missing_source": qual & blank("source"),
        "missing_script": qual & F.col("script").isNull(),
        "missing_difficulty_or_tags": qual & (F.size(F.coalesce("tags", F.array())) == 0),
        "missing_is_synthetic": qual & F.col("is_synthetic").isNull(),
        "missing_image": blank("image_sha256"),
        "placeholder_name": placeholder,
        "placeholder_not_marked_synthetic": placeholder & ~synthetic,
        "missing_or_empty_ground_truth": T.strip(F.coalesce("ground_truth", F.lit(""))) == "",
        "needs_gt_review": F.coalesce("needs_gt_review", F.lit(False)),
        "synthetic_in_qualification": qual & synthetic,
        "gt_appears_ocr_generated": T.looks_like_ocr_truth(F.col("ground_truth"), F.col("notes")),
    }
    issues = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return cases.withColumns({"issues": issues, "gt_sha256": truth_hash(F.col("ground_truth"))})


def _label() -> Column:
    return F.concat_ws(":", "split", "id")


def duplicate_groups(cases: DataFrame, key: str, distinct_ids: bool = False) -> DataFrame:
    """Groups of cases with the same hash: ``key``, ``n``, ``cases`` (sorted). ``distinct_ids``: only groups of several ids."""
    groups = cases.where(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.array_sort(F.collect_list(_label())).alias("cases"))
    return groups.where((F.col("n") > 1) & ((F.col("ids") > 1) | F.lit(not distinct_ids))).drop("ids")


def split_leaks(cases: DataFrame, key: str = "image_sha256") -> DataFrame:
    """Hashes that several splits hold."""
    groups = cases.where(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("splits"), F.array_sort(F.collect_list(_label())).alias("cases"))
    return groups.where(F.size("splits") > 1)


def split_counts(cases: DataFrame) -> DataFrame:
    synthetic = F.coalesce("is_synthetic", F.lit(False))
    return cases.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~synthetic).alias("real"),
        F.count_if(synthetic).alias("synthetic"),
        F.count_if(T.strip(F.coalesce("ground_truth", F.lit(""))) != "").alias("with_gt"),
        F.count_if(F.exists(F.coalesce("tags", F.array()), lambda t: F.lower(t) == "extreme")).alias("extreme"),
        F.count_if(F.array_contains("issues", "placeholder_name")).alias("placeholder"),
    )


def gate(inspected: DataFrame) -> DataFrame:
    """One row: how many qualification cases are eligible, how many failures there are, and the decision."""
    bad = (F.size("issues") > 0) | F.coalesce("is_synthetic", F.lit(False)) | F.coalesce("needs_gt_review", F.lit(False))
    qual = inspected.where(F.col("split") == "qualification").agg(F.count_if(~bad).alias("eligible"), F.count_if(bad).alias("unfit"))
    twice = duplicate_groups(inspected, "image_sha256").where(F.exists("cases", lambda c: c.startswith("qualification:"))).agg(F.count(F.lit(1)).alias("duplicates"))
    leaks = split_leaks(inspected).where(F.array_contains("splits", "qualification")).agg(F.count(F.lit(1)).alias("leaks"))
    one = qual.withColumn("k", F.lit(1)).join(twice.withColumn("k", F.lit(1)), "k").join(leaks.withColumn("k", F.lit(1)), "k").drop("k")
    failures = F.col("unfit") + F.col("duplicates") + F.col("leaks") + F.when(F.col("eligible") < MIN_REAL, 1).otherwise(0)
    return one.withColumn("failures", failures.cast("long")).withColumn("decision", F.when(F.col("failures") == 0, "QUALIFIED_FOR_INTERNAL_EVALUATION").otherwise("NOT_READY_DATASET"))


def qualification(decision: Column, has_systems: Column, scored: Column, accuracy: Column, fce: Column, cer: Column) -> Column:
    """The decision ladder over the gate and the fused system's means. A mean error rate of 0 counts as 0."""
    return (
        F.when(decision == "NOT_READY_DATASET", "NOT_READY_DATASET")
        .when(~has_systems | (scored == 0), "NOT_READY_EVALUATION")
        .when((accuracy < 0.5) & (fce > 0.2), "NOT_READY_UNCERTAINTY")
        .when(cer > 0.25, "NOT_READY_ACCURACY")
        .otherwise("QUALIFIED_FOR_INTERNAL_EVALUATION")
    )


def claims(summary: DataFrame, n_cases: int, n_real: int, eligible: bool) -> DataFrame:
    """What the means of print-only, handwriting and fused systems support: rows (ordinal, level, claim).

    ``summary``: one row per system with mean_cer, mean_fce_rate, mean_coverage_accepted, mean_abstention_rate.
    """
    of = lambda system, m: F.max(F.when(F.col("system") == system, F.col(m)))
    names = {"p": "print_only", "s": "fused", "t": "handwriting_lines"}
    measures = {"cer": "mean_cer", "fce": "mean_fce_rate", "cov": "mean_coverage_accepted", "abs": "mean_abstention_rate"}
    one = summary.agg(*[of(system, column).alias(f"{k}_{m}") for k, system in names.items() for m, column in measures.items()])
    c = {x: F.coalesce(F.col(x), F.lit(float("nan"))) for x in one.columns}
    known = lambda *cols: ~(F.isnan(cols[0]) if len(cols) == 1 else F.isnan(cols[0]) | F.isnan(cols[1]))
    prelim = "SUPPORTED_BUT_PRELIMINARY"
    strong = prelim if n_cases < MIN_REAL else "PROVEN"
    show = lambda x: F.format_string("%.4f", x)

    def claim(when: Column, level: str, *parts) -> Column:
        return F.when(when, F.struct(F.lit(level).alias("level"), F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).alias("claim")))

    delta = F.abs(c["s_cer"] - c["p_cer"])
    both_cer, both_fce, both_cov = known(c["s_cer"], c["p_cer"]), known(c["s_fce"], c["p_fce"]), known(c["s_cov"], c["p_cov"])
    any_case = F.lit(n_cases >= 1)
    rows = F.array_compact(
        F.array(
            claim(F.lit(n_cases < MIN_REAL or n_real < MIN_REAL or not eligible), "NOT_PROVEN", f"Readiness is NOT_PROVEN: {n_cases} cases, {n_real} real; the data set gate is not passed."),
            claim(any_case & both_cer & (delta <= 0.05), strong, "The fused system's CER (", show(c["s_cer"]), ") is essentially equal to print-only CER (", show(c["p_cer"]), ")."),
            claim(any_case & both_cer & (delta > 0.05) & (c["s_cer"] < c["p_cer"]), strong, "The fused system's CER (", show(c["s_cer"]), ") is lower than print-only CER (", show(c["p_cer"]), ")."),
            claim(any_case & both_cer & (delta > 0.05) & (c["s_cer"] >= c["p_cer"]), strong, "The fused system's CER (", show(c["s_cer"]), ") is not better than print-only CER (", show(c["p_cer"]), ")."),
            claim(any_case & both_fce & (c["s_fce"] + 1e-9 < c["p_fce"]), strong, "False-confident errors fall from ", show(c["p_fce"]), " to ", show(c["s_fce"]), "."),
            claim(any_case & both_fce & ~(c["s_fce"] + 1e-9 < c["p_fce"]), prelim, "Fewer false-confident errors are not demonstrated (", show(c["s_fce"]), " against ", show(c["p_fce"]), ")."),
            claim(any_case & both_cov & (c["s_cov"] + 1e-9 < c["p_cov"]), prelim, "The fused system accepts less than print-only, as abstention does."),
            claim(any_case & known(c["t_fce"]) & (c["t_fce"] < 0.15) & ((c["t_cov"] < 0.25) | (c["t_abs"] > 0.7)), prelim, "Handwriting-only has few false-confident errors because it abstains."),
            claim(F.lit(n_real <= 1), "NOT_PROVEN", f"Only {n_real} real case(s) can be scored."),
            claim(F.lit(True), "NOT_PROVEN", "Significance of differences is NOT_PROVEN on so few cases."),
        )
    )
    return one.select(F.posexplode(rows).alias("ordinal", "x")).select("ordinal", "x.level", "x.claim")
