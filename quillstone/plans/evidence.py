"""Evidence derived from the test tables, the same way in Spark and in DuckDB.

Lines of documents are references; fixed corruptions of them stand for what
recognition engines read; scores follow from ids.  Boxes, cases and jobs are
derived likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import geometry as G
from quillstone.functions import text as T
from quillstone.operators import integrity
from quillstone.streaming import jobs

HAND, PRINT = "trocr-base-handwritten", "paddleocr-rec"
VARIANTS = (("raw", HAND), ("clahe", HAND), ("denoised", HAND), ("adaptive_binarized", HAND), ("raw", PRINT))
PAGE_W, PAGE_H = 600, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every text."""
    docs = table(spark, sf_dir, "documents")
    # a table of few files is few tasks; what follows is work for all cores
    cores = spark.sparkContext.defaultParallelism
    docs = docs.repartition(cores) if len(docs.inputFiles()) < cores else docs
    docs = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "ref"))
    return docs.withColumn("line_no", F.col("line_no").cast("long"))


def corrupted(ordinal: int) -> Column:
    ref = F.col("ref")
    either = lambda x, y, to: F.replace(F.replace(ref, F.lit(x), F.lit(to)), F.lit(y), F.lit(to))
    return (ref, either("e", "a", "o"), either("s", "t", "f"), F.upper(ref), either("o", "u", "0"))[ordinal]


def visual(ordinal: Column | int) -> Column:
    return ((F.col("doc_id") * 31 + F.col("line_no") * 17 + ordinal * 7) % 101) / F.lit(100.0)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recognised word row a line: hypothesis, confidence, state."""
    kind = (F.col("doc_id") * 7 + F.col("line_no") * 3) % 4
    hyp = F.when(kind == 0, corrupted(0)).when(kind == 1, corrupted(1)).when(kind == 2, corrupted(2)).otherwise(corrupted(3))
    rows = lines(spark, sf_dir).withColumns({"kind": kind, "hypothesis": hyp}).withColumn("confidence", visual(F.col("kind")))
    c = F.col("confidence")
    state = F.when((F.col("doc_id") + F.col("line_no")) % 23 == 0, T.CROSSED_OUT).when(c >= 0.72, T.ACCEPTED).when(c >= 0.28, T.REVIEW).otherwise(T.ILLEGIBLE)
    region = F.when((F.col("doc_id") + F.col("line_no")) % 9 == 0, "margin_note").when(F.col("kind") == 0, "printed_text").otherwise("main_handwriting")
    return rows.withColumns({"decision_state": state, "uncertainty": F.lit(1.0) - c, "region_type": region, "word_id": F.concat_ws("-", "doc_id", "line_no"), "is_high_risk": T.is_high_risk(F.col("hypothesis"))})


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hypotheses a line, one a row."""
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(v).alias("variant"), F.lit(m).alias("model_name"), corrupted(i).alias("text"), visual(i).alias("visual_score")) for i, (v, m) in enumerate(VARIANTS)])
    return lines(spark, sf_dir).select("doc_id", "lang", "line_no", "ref", F.explode(rows).alias("h")).select("doc_id", "lang", "line_no", "ref", "h.*")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hypotheses as an array a line; ``composed`` has the Unicode compositions of their texts."""
    rows = lines(spark, sf_dir).select("*", *[T.kept(corrupted(i)).alias(f"_{i}") for i in range(len(VARIANTS))])
    rows = rows.withColumn("composed", T.kept(T.nfkc_all(F.array(*[F.col(f"_{i}") for i in range(len(VARIANTS))]))))
    hyp = [
        F.struct(F.col(f"_{i}").alias("text"), T.squeeze_blanks(F.get("composed", F.lit(i))).alias("normalized_text"), visual(i).alias("visual"), F.lit(v).alias("variant"), F.lit(m).alias("model"), F.lit(None).cast("string").alias("family"), F.lit(False).alias("safe_edit"))
        for i, (v, m) in enumerate(VARIANTS)
    ]
    rows = rows.withColumn("hyps", T.kept(F.array(*hyp))).drop(*[f"_{i}" for i in range(len(VARIANTS))])
    return rows.withColumn("script_mode", F.when(F.col("doc_id") % 5 == 0, "print").otherwise("handwriting"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each line on a page of its document."""
    d, n = F.col("doc_id"), F.col("line_no")
    b = G.box((d * 7 + n * 13) % 400, (n * 37 + d * 11) % 900, 40 + (n * 29) % 500, 6 + (d + n * 5) % 190)
    rows = lines(spark, sf_dir).select("doc_id", "line_no", b.alias("bbox"))
    region = G.region_type(F.col("bbox"), F.lit(PAGE_W), F.lit(PAGE_H), (d + n) % 31 == 0, F.when((d + n) % 3 == 0, "print").otherwise("handwriting"))
    return rows.withColumn("region_type", region)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as evaluation cases of three splits."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.when(d % 3 == 0, "dev").when(d % 3 == 1, "held_out").otherwise("qualification").alias("split"),
        F.concat(F.when(d % 13 == 0, "synthetic-").otherwise("case-"), d.cast("string")).alias("id"),
        F.concat(d.cast("string"), F.lit(".png")).alias("image_name"),
        F.when(d % 11 == 0, "").otherwise(integrity.truth_hash(F.col("text"))).alias("image_sha256"),
        F.col("text").alias("ground_truth"),
        F.when(d % 7 == 0, True).when(d % 7 < 6, False).alias("is_synthetic"),
        (d % 17 == 0).alias("needs_gt_review"),
        F.when(d % 19 == 0, "").otherwise(F.col("source")).alias("source"),
        F.when(d % 5 != 0, F.col("lang")).alias("script"),
        F.when(d % 4 == 0, F.array(F.lit("extreme"))).when(d % 4 == 1, F.array(F.lit("form"), F.lit("hard"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.when(d % 29 == 0, "Generated from OCR").when(d % 29 == 1, "auto-transcribed").otherwise("").alias("notes"),
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers' corrections, made of events: some change the text, some the state, some neither or wrongly."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        F.concat_ws("-", i % 200, i % 7).alias("word_id"),
        "ts",
        "event_id",
        F.when(i % 3 != 0, F.concat_ws(" ", F.lit("fixed "), "event_type", F.lit(" "))).alias("new_text"),
        F.when(i % 5 == 0, "accepted").when(i % 5 == 1, "ILLEGIBLE").when(i % 5 == 2, "nonsense").alias("new_state"),
    )


def jobs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.current_jobs(table(spark, sf_dir, "events"))


# --- the same for DuckDB -----------------------------------------------------

LINES = r"""lines AS (
  SELECT d.doc_id, d.lang, d.source, CAST(u.pos - 1 AS BIGINT) AS line_no, u.line AS ref
  FROM documents d, LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line, generate_subscripts(string_split(d.text, chr(10)), 1) AS pos) u)"""
# Spark's upper case follows the full case mapping, DuckDB's the simple one
_TEXTS = ("ref", "regexp_replace(ref, '[ea]', 'o', 'g')", "regexp_replace(ref, '[st]', 'f', 'g')", "upper(replace(ref, 'ß', 'SS'))", "regexp_replace(ref, '[ou]', '0', 'g')")
#: Characters of one byte that texts do not hold: they stand for those of more bytes where DuckDB counts edits.
_STAND_INS = "".join(map(chr, (*range(1, 9), 11, 12, *range(14, 32), 127)))


def sql_edits(a: str, b: str) -> str:
    """Edits in code points: DuckDB's own function counts bytes."""
    wide = f"array_to_string(list_distinct(regexp_extract_all({a} || {b}, '[^\\x00-\\x7F]')), '')"
    return f"levenshtein(translate({a}, {wide}, '{_STAND_INS}'), translate({b}, {wide}, '{_STAND_INS}'))"


def sql_scattered(t: str) -> str:
    """Three words of one or two letters in a short text; letters beyond ASCII are letters of words."""
    short = r"\b[a-z]{1,2}\b"
    return f"(regexp_matches(regexp_replace(lower({t}), '[^\\x00-\\x7F]', '_', 'g'), '{short}.*{short}.*{short}') AND length({t}) < 12)"


def sql_visual(ordinal: object) -> str:
    return f"(CAST((doc_id * 31 + line_no * 17 + ({ordinal}) * 7) % 101 AS DOUBLE) / 100)"


WORDS = f"""{LINES},
words0 AS (
  SELECT *, (doc_id * 7 + line_no * 3) % 4 AS kind,
    CASE (doc_id * 7 + line_no * 3) % 4 WHEN 0 THEN {_TEXTS[0]} WHEN 1 THEN {_TEXTS[1]} WHEN 2 THEN {_TEXTS[2]} ELSE {_TEXTS[3]} END AS hypothesis,
    {sql_visual("(doc_id * 7 + line_no * 3) % 4")} AS confidence
  FROM lines),
words AS (
  SELECT *, CASE WHEN (doc_id + line_no) % 23 = 0 THEN 'CROSSED_OUT' WHEN confidence >= 0.72 THEN 'ACCEPTED' WHEN confidence >= 0.28 THEN 'REVIEW_REQUIRED' ELSE 'ILLEGIBLE' END AS decision_state,
    1.0::DOUBLE - confidence AS uncertainty,
    CASE WHEN (doc_id + line_no) % 9 = 0 THEN 'margin_note' WHEN kind = 0 THEN 'printed_text' ELSE 'main_handwriting' END AS region_type,
    CAST(doc_id AS VARCHAR) || '-' || CAST(line_no AS VARCHAR) AS word_id,
    regexp_matches(hypothesis, '[0-9]|[A-Z][a-z]+|[A-Z0-9]{{4,}}') AS is_high_risk
  FROM words0)"""
HYPOTHESES = f"""{LINES},
hyps AS (
""" + "\n  UNION ALL\n".join(f"  SELECT doc_id, lang, line_no, ref, {i} AS ordinal, '{v}' AS variant, '{m}' AS model_name, {_TEXTS[i]} AS text, {sql_visual(i)} AS visual_score FROM lines" for i, (v, m) in enumerate(VARIANTS)) + ")"
CANDIDATES = f"""{LINES},
cand AS (SELECT doc_id, lang, line_no, ref, CASE WHEN doc_id % 5 = 0 THEN 'print' ELSE 'handwriting' END AS script_mode,
  {", ".join(f"trim(regexp_replace({t}, '[ ]+', ' ', 'g')) AS n{i}, {t} AS t{i}, {sql_visual(i)} AS v{i}" for i, t in enumerate(_TEXTS))}
  FROM lines)"""
BOXES = f"""{LINES},
boxes0 AS (
  SELECT doc_id, line_no, CAST((doc_id * 7 + line_no * 13) % 400 AS DOUBLE) AS x, CAST((line_no * 37 + doc_id * 11) % 900 AS DOUBLE) AS y,
    CAST(40 + (line_no * 29) % 500 AS DOUBLE) AS w, CAST(6 + (doc_id + line_no * 5) % 190 AS DOUBLE) AS h
  FROM lines),
boxes AS (
  SELECT *, CASE WHEN (doc_id + line_no) % 31 = 0 THEN 'crossed_out_candidate'
      WHEN (x < 0.12::DOUBLE * {PAGE_W} OR x + w > 0.88::DOUBLE * {PAGE_W}) AND w < 0.35::DOUBLE * {PAGE_W} THEN 'margin_note'
      WHEN y > 0.82::DOUBLE * {PAGE_H} AND h < 0.08::DOUBLE * {PAGE_H} THEN 'signature'
      WHEN (doc_id + line_no) % 3 = 0 THEN 'printed_text' ELSE 'main_handwriting' END AS region_type
  FROM boxes0)"""


def sql_norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"


def sql_cer(r: str, h: str) -> str:
    return f"(CASE WHEN length({r}) = 0 THEN CASE WHEN length({h}) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE CAST({sql_edits(r, h)} AS DOUBLE) / length({r}) END)"


def sql_correct(r: str, h: str) -> str:
    return f"(CASE WHEN {sql_norm(r)} = {sql_norm(h)} THEN true WHEN {sql_norm(r)} = '' THEN trim({h}) IN ('', '[ILLEGIBLE]', '[REVIEW REQUIRED]', '[ILLEGIBLE].') ELSE {sql_cer(sql_norm(r), sql_norm(h))} <= 0.15 END)"


def sql_dist(a: str, b: str) -> str:
    return f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 0.0::DOUBLE ELSE CAST({sql_edits(a, b)} AS DOUBLE) / greatest(length({a}), length({b})) END)"


CASES = """cases AS (
  SELECT CASE doc_id % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'held_out' ELSE 'qualification' END AS split,
    CASE WHEN doc_id % 13 = 0 THEN 'synthetic-' ELSE 'case-' END || CAST(doc_id AS VARCHAR) AS id,
    CAST(doc_id AS VARCHAR) || '.png' AS image_name,
    CASE WHEN doc_id % 11 = 0 THEN '' WHEN NOT regexp_matches(text, '\\S') THEN NULL ELSE sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) END AS image_sha256,
    text AS ground_truth,
    CASE WHEN doc_id % 7 = 0 THEN true WHEN doc_id % 7 < 6 THEN false END AS is_synthetic,
    doc_id % 17 = 0 AS needs_gt_review,
    CASE WHEN doc_id % 19 = 0 THEN '' ELSE source END AS source,
    CASE WHEN doc_id % 5 <> 0 THEN lang END AS script,
    CASE doc_id % 4 WHEN 0 THEN ['extreme'] WHEN 1 THEN ['form', 'hard'] ELSE [] END AS tags,
    CASE doc_id % 29 WHEN 0 THEN 'Generated from OCR' WHEN 1 THEN 'auto-transcribed' ELSE '' END AS notes
  FROM documents)"""
