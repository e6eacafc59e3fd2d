"""Views of results: texts, Markdown, inventories, graphs, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T

LOW_CONFIDENCE, HIGH_UNCERTAINTY = 0.72, 0.28


def state_counts(words: DataFrame, keys: list[str]) -> DataFrame:
    s = F.col("decision_state")
    return words.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(s == v).alias(n) for n, v in (("accepted", T.ACCEPTED), ("review", T.REVIEW), ("illegible", T.ILLEGIBLE), ("crossed", T.CROSSED_OUT))])


def low_confidence(words: DataFrame) -> DataFrame:
    """What a reader should look at."""
    return words.where((F.col("decision_state") != T.ACCEPTED) | (F.col("uncertainty") > HIGH_UNCERTAINTY))


def low_confidence_items(items: DataFrame) -> DataFrame:
    return items.where(F.coalesce("confidence", F.lit(1.0)) < LOW_CONFIDENCE)


def active(words: DataFrame) -> DataFrame:
    return words.where(F.col("decision_state") != T.CROSSED_OUT)


def crossed_out(words: DataFrame) -> DataFrame:
    return words.where(F.col("decision_state") == T.CROSSED_OUT)


def accepted_text(words: DataFrame, keys: list[str], order: str = "reading_order") -> DataFrame:
    """The accepted and the active text of each document, in reading order."""
    at = F.col(order)

    def text(keep: Column) -> Column:
        parts = F.array_sort(F.collect_list(F.when(keep, F.struct(at.alias("o"), F.col("text").alias("t")))))
        return F.array_join(F.transform(parts, lambda p: p["t"]), "\n")

    state = F.col("decision_state")
    return words.groupBy(*keys).agg(text(state == T.ACCEPTED).alias("accepted_text"), text(state != T.CROSSED_OUT).alias("active_text"))


def markdown_line(state: Column, text: Column, region: Column, confidence: Column, uncertainty: Column) -> Column:
    shown = F.concat(F.when(region == "margin_note", "[margin] ").otherwise(""), text)
    unc, conf = F.format_string("%.2f", uncertainty), F.format_string("%.2f", confidence)
    return (
        F.when(state == T.CROSSED_OUT, F.concat(F.lit("~~"), shown, F.lit("~~ <!-- crossed-out uncertainty="), unc, F.lit(" -->")))
        .when(state == T.ILLEGIBLE, F.concat(F.lit("**[ILLEGIBLE]** <!-- uncertainty="), unc, F.lit(" region="), F.coalesce(region, F.lit("")), F.lit(" -->")))
        .when(state == T.REVIEW, F.concat(F.lit("=="), shown, F.lit("== <!-- review evidence_score="), conf, F.lit(" (uncalibrated) unc="), unc, F.lit(" -->")))
        .otherwise(shown)
    )


def panel_line(state: Column, text: Column) -> Column:
    """The short form a panel shows."""
    return F.when(state == T.CROSSED_OUT, F.concat(F.lit("~~"), text, F.lit("~~"))).when(state == T.ILLEGIBLE, "**[ILLEGIBLE]**").when(state == T.REVIEW, F.concat(F.lit("=="), text, F.lit("=="))).otherwise(text)


def markdown(words: DataFrame, keys: list[str], order: str = "reading_order", title: str = "Transcription") -> DataFrame:
    """One Markdown text a document: body, then margin notes."""
    line = markdown_line(F.col("decision_state"), F.col("text"), F.col("region_type"), F.col("confidence"), F.col("uncertainty"))
    margin = F.coalesce(F.col("region_type") == "margin_note", F.lit(False))

    def part(keep: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(keep, F.struct(F.col(order).alias("o"), F.col("_line").alias("l")))))
        return F.transform(rows, lambda r: r["l"])

    agg = words.withColumn("_line", line).groupBy(*keys).agg(part(~margin).alias("_body"), part(margin).alias("_margin"))
    head = F.array(F.lit(f"# {title}"), F.lit(""), F.lit("## Body"), F.lit(""))
    notes = F.when(F.size("_margin") > 0, F.concat(F.array(F.lit(""), F.lit("## Margin notes"), F.lit("")), F.col("_margin"))).otherwise(F.array().cast("array<string>"))
    return agg.select(*keys, F.array_join(F.concat(head, F.col("_body"), notes), "\n").alias("markdown"))


def inventory(words: DataFrame, keys: list[str], order: str = "reading_order") -> DataFrame:
    """Line items of a document from its active words."""
    item = F.struct(F.col(order).alias("ordinal"), F.col("text").alias("text"), F.col("confidence").alias("confidence"), F.coalesce("region_type", F.lit("unknown")).alias("region_type"))
    return active(words).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))


def merge_inventories(reader: Column, recognised: Column) -> Column:
    """Items that a page reader found, then recognised ones."""
    return F.concat(F.coalesce(reader, F.array()), F.coalesce(recognised, F.array()))


def assemble(pages: DataFrame, lines: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """A row per page with its lines, each with its hypotheses, all ordered."""
    per_line = hypotheses.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "visual_score", "model_name"))).alias("hypotheses"))
    full = lines.join(per_line, lines["id"] == per_line["line_id"], "left").drop("line_id")
    row = F.struct("reading_order", "id", "region_type", F.coalesce("hypotheses", F.array()).alias("hypotheses"))
    by_page = full.groupBy("page_id").agg(F.array_sort(F.collect_list(row)).alias("lines"))
    return pages.join(by_page, pages["id"] == by_page["page_id"], "left").drop("page_id")


def job_status(jobs: DataFrame) -> DataFrame:
    """The newest job of each document."""
    rest = [c for c in jobs.columns if c != "document_id"]
    return jobs.groupBy("document_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("j")).select("document_id", "j.*")


def export_outcome(status: Column, fmt: Column) -> Column:
    """The HTTP code of an export request: 404 unknown, 400 bad format, 409 not finished, 200."""
    return F.when(status.isNull(), 404).when(~fmt.isin("txt", "md", "json"), 400).when(status != "completed", 409).otherwise(200)


def completion(words: DataFrame, keys: list[str]) -> DataFrame:
    """The figures of a finished document's audit event."""
    return words.groupBy(*keys).agg(F.count(F.lit(1)).alias("word_count"), F.count_if(F.col("decision_state") == T.ACCEPTED).alias("accepted"), F.count_if(F.col("decision_state") != T.CROSSED_OUT).alias("items"))


def first_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


# --- smaller views ---------------------------------------------------------------


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The row with a key; the predicate reaches the scan."""
    return rows.where(F.col(key) == F.lit(value))


def listed(rows: DataFrame, key: str, value, order: list[str]) -> DataFrame:
    """The rows of a parent in their order, ties by id."""
    return lookup(rows, key, value).orderBy(*order, "id")


def print_ratio(lines: DataFrame, page: list[str]) -> DataFrame:
    """Share of a page's lines that are print, and how many lines it has."""
    return lines.groupBy(*page).agg((F.count_if(F.col("script_mode") == "print") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("print_ratio"), F.count(F.lit(1)).alias("lines"))


def line_items(reader_items: Column, words_items: Column) -> Column:
    """A document's line items: what a page reader named, with defaults; else its active words."""
    named = F.transform(
        reader_items,
        lambda i: F.struct(F.coalesce(i["text"], F.lit("")).alias("text"), F.coalesce(i["category"], F.lit("other")).alias("category"), F.coalesce(i["confidence"], F.lit(0.0)).alias("confidence")),
    )
    return F.when(F.size(F.coalesce(reader_items, F.array())) > 0, named).otherwise(words_items)


def layout_summary(hints: Column) -> Column:
    """``region: description`` of each hint."""
    return F.transform(hints, lambda h: F.concat_ws(": ", F.coalesce(h["region_type"], F.lit("unknown")), h["description"]))


def merge_pages(rows: DataFrame, keys: list[str], items: str, order: str) -> DataFrame:
    """The item lists of a document's pages as one, in page order."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(items).alias("i")))), lambda p: p["i"])
    return rows.groupBy(*keys).agg(F.flatten(lists).alias(items))


def artifact_headers(artifacts: DataFrame) -> DataFrame:
    """Provenance of each artifact as response headers."""
    return artifacts.select("id", F.create_map(F.lit("X-Artifact-Sha256"), "sha256", F.lit("X-Artifact-Transformation"), F.coalesce("transformation_name", F.lit("")), F.lit("X-Artifact-Source"), F.coalesce("source_artifact_id", F.lit(""))).alias("headers"))


def audit_event(document_id: Column, event_type: str, payload: Column, at: Column) -> list[Column]:
    """Columns of an audit row; the id follows from the content."""
    body = F.to_json(payload)
    return [F.substring(F.sha2(F.concat_ws("\x1f", document_id.cast("string"), F.lit(event_type), body, at.cast("string")), 256), 1, 32).alias("id"), document_id.alias("document_id"), F.lit(event_type).alias("event_type"), body.alias("payload"), at.alias("created_at")]
