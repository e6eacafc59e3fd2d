"""Reports as rows of text: ``section``, ``ordinal``, ``line``. Their inputs are summaries, so they are small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import integrity, metrics

SHOWN = ("cer", "fce_rate", "review_rate", "coverage_accepted", "abstention_rate", "accepted_accuracy")


def choose_baselines(independent: DataFrame, derived: DataFrame) -> DataFrame:
    """Scored cases (``system``, ``case_id``, measures): the independent run's where it gave one without an ``error``, else the derived one's; ``baseline_kind`` tells which."""
    keys = ["system", "case_id"]
    good = independent.where(F.col("error").isNull()).drop("error").withColumn("baseline_kind", F.lit("independent"))
    rest = derived.join(good.select(*keys), keys, "left_anti").withColumn("baseline_kind", F.lit("derived"))
    return good.unionByName(rest)


def _facts(section: int, row: DataFrame, *lines) -> DataFrame:
    """Lines made of the columns of a single row."""
    made = F.array(*[x if isinstance(x, Column) else F.lit(x) for x in lines])
    return row.select(F.lit(section).alias("section"), F.posexplode(made).alias("ordinal", "line"))


def _table(section: int, rows: DataFrame, order: list, line: Column) -> DataFrame:
    """A line a row, in order, behind a section's other lines."""
    place = F.row_number().over(Window.orderBy(*order)) + 99
    return rows.select(F.lit(section).alias("section"), place.alias("ordinal"), line.alias("line"))


def _said(name: str, value) -> Column:
    return F.concat(F.lit(f"- {name}: "), (F.col(value) if isinstance(value, str) else value).cast("string"))


def _cells(*values) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *values), F.lit(" |"))


def _number(value: Column) -> Column:
    return F.format_string("%.3f", value)


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def composition(inspected: DataFrame) -> DataFrame:
    """One row: how many cases there are, of which kinds, and how many groups and leaks."""
    synthetic = F.coalesce("is_synthetic", F.lit(False))
    counts = inspected.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~synthetic).alias("real"), F.count_if(synthetic).alias("synthetic"),
        F.count_if(F.exists(F.coalesce("tags", F.array()), lambda t: F.lower(t) == "extreme")).alias("extreme"),
        F.count_if(T.strip(F.coalesce("ground_truth", F.lit(""))) == "").alias("missing_truth"), F.count_if(F.array_contains("issues", "placeholder_name")).alias("placeholder"),
    )
    groups = {"same_image": integrity.duplicate_groups(inspected, "image_sha256"), "same_truth": integrity.duplicate_groups(inspected, "gt_sha256", True), "leaks": integrity.split_leaks(inspected)}
    one = counts.withColumn("k", F.lit(1))
    for name, rows in groups.items():
        one = one.join(rows.agg(F.count(F.lit(1)).alias(name)).withColumn("k", F.lit(1)), "k")
    return one.drop("k")


def integrity_report(inspected: DataFrame) -> DataFrame:
    """What a data set holds, split by split, and which cases are in several splits."""
    leaks = integrity.split_leaks(inspected)
    return _together(
        [
            _facts(0, composition(inspected), "# Data set", _said("cases", "total"), _said("real", "real"), _said("synthetic", "synthetic"), _said("extreme", "extreme"), _said("without reference", "missing_truth"), _said("placeholder names", "placeholder"), _said("groups with one image", "same_image"), _said("groups with one reference", "same_truth"), _said("images in several splits", "leaks")),
            _facts(1, integrity.gate(inspected), _said("eligible", "eligible"), _said("failures", "failures"), _said("decision", "decision")),
            _table(2, integrity.split_counts(inspected), ["split"], F.concat(F.lit("- "), "split", F.lit(": "), F.col("n").cast("string"), F.lit(" cases, "), F.col("real").cast("string"), F.lit(" real, "), F.col("with_gt").cast("string"), F.lit(" with reference"))),
            _table(3, leaks, ["image_sha256"], F.concat(F.lit("- leak: "), F.array_join("cases", ", "))),
        ]
    )


def by_system(scored: DataFrame) -> DataFrame:
    """One row a system, worked out now: ``n``, the means of ``SHOWN``, ``kinds`` of its rows and how many are ``failing``, with accepted lines and none of them right.

    ``scored``: a row a case and system with ``SHOWN`` and ``baseline_kind``. All that a report says of scores follows from these few rows, so the scores are worked out once.
    """
    nan = F.lit(float("nan"))
    found = scored.groupBy("system").agg(
        F.count(F.lit(1)).alias("n"), *[F.coalesce(F.avg(m), nan).alias(f"mean_{m}") for m in SHOWN], F.array_sort(F.collect_set("baseline_kind")).alias("kinds"),
        F.count_if((F.col("accepted_accuracy") == 0) & (F.col("coverage_accepted") > 0)).alias("failing"),
    )
    return scored.sparkSession.createDataFrame(found.collect(), found.schema)


def qualification_report(inspected: DataFrame, systems: DataFrame, curves: DataFrame, claims: DataFrame) -> DataFrame:
    """The decision over a data set and its scores, with all that it rests on.

    ``systems``: rows of :func:`by_system`; ``curves``: coverage, n, fce,
    accepted_accuracy of the fused system; ``claims``: rows of
    :func:`integrity.claims`.
    """
    of = lambda m: F.max(F.when(F.col("system") == "fused", F.col(m)))
    fused = systems.agg(F.count(F.lit(1)).alias("systems"), *[of(f"mean_{m}").alias(m) for m in ("cer", "fce_rate", "accepted_accuracy")], of("n").alias("scored"))
    one = integrity.gate(inspected).withColumn("k", F.lit(1)).join(fused.withColumn("k", F.lit(1)), "k")
    decision = integrity.qualification(F.col("decision"), F.col("systems") > 0, F.coalesce("scored", F.lit(0)), F.col("accepted_accuracy"), F.col("fce_rate"), F.col("cer"))
    one = one.withColumn("final", decision)
    status = F.when(F.col("final").startswith("NOT_READY"), "preliminary, no evidence for qualification").otherwise(F.col("final"))
    failing = systems.agg(F.coalesce(of("failing"), F.lit(0)).alias("failing"))
    configs = metrics.configured(systems).withColumn("kind", F.when(F.size("kinds") > 1, F.concat(F.lit("mixed:"), F.array_join("kinds", ","))).otherwise(F.try_element_at("kinds", F.lit(1))))
    measured = [_number(F.col(f"mean_{m}")) for m in SHOWN]
    return _together(
        [
            _facts(0, one, "# Qualification", _said("decision", "final"), _said("evidence", status), _said("eligible cases", "eligible"), _said("required", F.lit(integrity.MIN_REAL))),
            _facts(1, composition(inspected), "## Cases", _said("all", "total"), _said("real", "real"), _said("extreme", "extreme")),
            _table(2, systems, ["system"], _cells("system", F.col("n").cast("string"), *measured)),
            _table(3, curves, ["coverage"], _cells(F.format_string("%.2f", F.col("coverage")), F.col("n").cast("string"), _number(F.col("fce")), _number(F.col("accepted_accuracy")))),
            _table(4, configs, ["config"], _cells("config", "kind", *[_number(F.col(f"mean_{m}")) for m in ("cer", "fce_rate", "coverage_accepted")])),
            _facts(5, failing, "## Failures", _said("cases with accepted lines, none of them right", "failing")),
            _table(6, claims, ["ordinal"], F.concat(F.lit("- "), "level", F.lit(": "), "claim")),
        ]
    )
