"""Registry of queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import geometry as G
from quillstone.functions import scores as S
from quillstone.functions import text as T
from quillstone.operators import fusion, integrity, layout, metrics, rerank, results, routing, store
from quillstone.plans import evidence as E
from quillstone.plans import fuse_sql
from quillstone.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Digits kept of quotients, so that both engines print the same.
DIGITS = 9


def query(sql: str | None = None):
    """Register a query, and its SQL where there is any."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(x):
    return F.round(x, DIGITS)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.words(spark, sf_dir)
    return metrics.judge(rows.withColumns({"reference": F.col("ref"), "place": F.col("line_no")}))


_JUDGED = f"""{E.WORDS},
judged AS (
  SELECT *, {E.sql_correct("ref", "hypothesis")} AS correct,
    trim(hypothesis) NOT IN ('', '[ILLEGIBLE]', '[REVIEW REQUIRED]', '[ILLEGIBLE].') AND decision_state NOT IN ('ILLEGIBLE', 'CROSSED_OUT') AS visible
  FROM words),
marked AS (SELECT *, NOT correct AND decision_state = 'ACCEPTED' AS fce, NOT correct AND visible AND decision_state IN ('ACCEPTED', 'REVIEW_REQUIRED') AS fve FROM judged)"""


# --- evaluation ----------------------------------------------------------------


@query(f"""WITH {_JUDGED}
SELECT lang, count(*) AS total_lines, count(*) FILTER (decision_state = 'ACCEPTED') AS accepted, count(*) FILTER (fce) AS fce_count,
  round(CAST(count(*) FILTER (fce) AS DOUBLE) / count(*), 9) AS fce_rate,
  round(CAST(count(*) FILTER (decision_state = 'ACCEPTED') AS DOUBLE) / count(*), 9) AS coverage_accepted,
  round(avg({E.sql_cer("ref", "hypothesis")}), 9) AS mean_cer
FROM marked GROUP BY lang""")
def fce_by_lang(spark, sf_dir):
    """Flagship: errors, coverage and false-confident errors per language."""
    rows = judged(spark, sf_dir).withColumn("cer", T.cer(F.col("reference"), F.col("hypothesis")))
    return rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(F.col("decision_state") == T.ACCEPTED).alias("accepted"),
        F.count_if("fce").alias("fce_count"),
        r(F.count_if("fce") / F.count(F.lit(1))).alias("fce_rate"),
        r(F.count_if(F.col("decision_state") == T.ACCEPTED) / F.count(F.lit(1))).alias("coverage_accepted"),
        r(F.avg("cer")).alias("mean_cer"),
    )


#: Words of both texts that one-byte characters can stand for in SQL; two more stand for the words of one text alone.
_CODED = 125


def _coded(words: str, alone: int) -> str:
    at = "coalesce(list_position(voc, x), 0)"
    return f"array_to_string(list_transform({words}, lambda x: chr(CAST(CASE WHEN {at} = 0 THEN {alone} ELSE {at} END AS INT))), '')"


@query(f"""WITH RECURSIVE {E.WORDS},
t AS (SELECT *, list_filter(regexp_split_to_array(ref, '\\s+'), lambda x: x <> '') AS rt, list_filter(regexp_split_to_array(hypothesis, '\\s+'), lambda x: x <> '') AS ht FROM words),
v AS (SELECT *, list_intersect(rt, ht) AS voc FROM t),
hard AS (SELECT doc_id, line_no, rt, ht FROM v WHERE len(voc) > {_CODED} AND rt <> ht),
dp AS (
  SELECT doc_id, line_no, CAST(0 AS BIGINT) AS i, range(0, len(ht) + 1) AS costs FROM hard
  UNION ALL
  SELECT doc_id, line_no, i + 1, list_transform(range(0, len(ht) + 1), lambda j: j + list_min(less[1:j + 1]))
  FROM (SELECT doc_id, line_no, i, ht, [i + 1] || list_transform(range(1, len(ht) + 1), lambda j: least(costs[j + 1] + 1, costs[j] + CASE WHEN ht[j] = rt[i + 1] THEN 0 ELSE 1 END) - j) AS less
    FROM dp JOIN hard USING (doc_id, line_no) WHERE i < len(rt))),
far AS (SELECT doc_id, line_no, costs[-1] AS edits FROM dp JOIN hard USING (doc_id, line_no) WHERE i = len(rt)),
c AS (SELECT v.*, CASE WHEN rt = ht THEN 0 WHEN len(voc) > {_CODED} THEN far.edits ELSE levenshtein({_coded("rt", 126)}, {_coded("ht", 127)}) END AS edits FROM v LEFT JOIN far USING (doc_id, line_no))
SELECT doc_id, line_no, round({E.sql_cer("ref", "hypothesis")}, 9) AS cer, round(CASE WHEN len(rt) > 0 THEN CAST(edits AS DOUBLE) / len(rt) WHEN len(ht) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 9) AS wer,
  CASE WHEN {E.sql_norm("ref")} = {E.sql_norm("hypothesis")} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_match, {E.sql_correct("ref", "hypothesis")} AS correct
FROM c""")
def cer_wer_lines(spark, sf_dir):
    """Character and word error rates of every line."""
    ref, hyp = F.col("ref"), F.col("hypothesis")
    return E.words(spark, sf_dir).select("doc_id", "line_no", r(T.cer(ref, hyp)).alias("cer"), r(T.wer(ref, hyp)).alias("wer"), T.exact_match(ref, hyp).alias("exact_match"), T.line_correct(ref, hyp).alias("correct"))


@query(f"""WITH {E.WORDS},
l AS (SELECT doc_id, ref, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS place FROM lines),
h AS (SELECT doc_id, hypothesis, decision_state, confidence, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS place FROM words)
SELECT doc_id, place, coalesce(ref, '') AS reference, coalesce(hypothesis, '') AS hypothesis, coalesce(decision_state, 'ILLEGIBLE') AS decision_state, coalesce(confidence, 0.0::DOUBLE) AS confidence
FROM l FULL JOIN h USING (doc_id, place)""")
def align_refs(spark, sf_dir):
    """Reference and recognised lines paired by their place, though either may lack some."""
    refs = E.lines(spark, sf_dir).select("doc_id", "line_no", F.col("ref").alias("reference"))
    words = E.words(spark, sf_dir).select("doc_id", F.col("line_no").alias("reading_order"), "hypothesis", "decision_state", "confidence")
    return metrics.align(refs, words, ["doc_id"]).withColumn("place", F.col("place").cast("long"))


_RATES = """round(CAST(fce_count AS DOUBLE) / total_lines, 9) AS fce_rate,
  round(CASE WHEN accepted = 0 THEN 0.0::DOUBLE ELSE CAST(incorrect_accepted AS DOUBLE) / accepted END, 9) AS fce_rate_among_accepted,
  round(CAST(fve_count AS DOUBLE) / total_lines, 9) AS fve_rate, round(CAST(review AS DOUBLE) / total_lines, 9) AS review_rate,
  round(CAST(illegible + review AS DOUBLE) / total_lines, 9) AS abstention_rate, round(CAST(accepted AS DOUBLE) / total_lines, 9) AS coverage_accepted,
  round(CASE WHEN accepted = 0 THEN 0.0::DOUBLE ELSE CAST(correct_accepted AS DOUBLE) / accepted END, 9) AS accepted_accuracy"""
_COUNTS = """count(*) AS total_lines, count(*) FILTER (decision_state = 'ACCEPTED') AS accepted, count(*) FILTER (decision_state = 'REVIEW_REQUIRED') AS review,
    count(*) FILTER (decision_state = 'ILLEGIBLE') AS illegible, count(*) FILTER (decision_state = 'CROSSED_OUT') AS crossed_out,
    count(*) FILTER (decision_state = 'ACCEPTED' AND correct) AS correct_accepted, count(*) FILTER (decision_state = 'ACCEPTED' AND NOT correct) AS incorrect_accepted,
    count(*) FILTER (decision_state = 'REVIEW_REQUIRED' AND correct) AS correct_review, count(*) FILTER (decision_state = 'REVIEW_REQUIRED' AND NOT correct) AS incorrect_review,
    count(*) FILTER (decision_state = 'ILLEGIBLE' AND (trim(ref) = '' OR lower(ref) IN ('[illegible]', 'illegible'))) AS correct_illegible,
    count(*) FILTER (decision_state = 'ILLEGIBLE' AND NOT (trim(ref) = '' OR lower(ref) IN ('[illegible]', 'illegible'))) AS incorrect_illegible,
    count(*) FILTER (fce) AS fce_count, count(*) FILTER (fve) AS fve_count"""


@query(f"WITH {_JUDGED}, c AS (SELECT source, {_COUNTS} FROM marked GROUP BY source) SELECT *, {_RATES} FROM c")
def eval_by_source(spark, sf_dir):
    """All counts and rates per source."""
    out = metrics.summarise(judged(spark, sf_dir), ["source"])
    return out.select(*[r(F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in out.dtypes])


@query(f"""WITH {_JUDGED},
p AS (SELECT lang, ref, hypothesis, correct, row_number() OVER (PARTITION BY lang ORDER BY confidence DESC, doc_id, line_no) AS rank, count(*) OVER (PARTITION BY lang) AS of_ FROM marked),
q AS (SELECT p.*, c.coverage, least(of_, greatest(1, CAST(round_even(c.coverage * of_, 0) AS BIGINT))) AS k FROM p, (SELECT unnest([0.25::DOUBLE, 0.5, 0.75, 1.0]) AS coverage) c)
SELECT lang, coverage, max(k) AS n, round(CAST(count(*) FILTER (NOT correct) AS DOUBLE) / max(k), 9) AS fce, round(CAST(count(*) FILTER (correct) AS DOUBLE) / max(k), 9) AS accepted_accuracy,
  CAST(sum({E.sql_edits("ref", "hypothesis")}) AS BIGINT) AS edits, CAST(sum(length(ref)) AS BIGINT) AS ref_chars
FROM q WHERE rank <= k GROUP BY lang, coverage""")
def risk_coverage(spark, sf_dir):
    """Errors among the most confident quarter, half, three quarters and all lines."""
    out = metrics.risk_coverage(judged(spark, sf_dir), ["lang"], ["doc_id", "line_no"])
    return out.withColumns({"fce": r(F.col("fce")), "accepted_accuracy": r(F.col("accepted_accuracy"))})


_TURNS = r"""turns AS (
  SELECT conv_id, turn AS place, trim(regexp_replace(text, '[^\x20-\x7E]+', ' ', 'g')) AS ref FROM conversations WHERE text IS NOT NULL),
conv AS (SELECT conv_id, place, ref, CASE (conv_id + place) % 3 WHEN 0 THEN ref WHEN 1 THEN regexp_replace(ref, '[ea]', 'o', 'g') ELSE upper(ref) END AS hypothesis,
  CASE WHEN (conv_id * 3 + place) % 5 = 0 THEN 'REVIEW_REQUIRED' WHEN (conv_id * 3 + place) % 11 = 1 THEN 'CROSSED_OUT' ELSE 'ACCEPTED' END AS decision_state FROM turns)"""


def _conversation_lines(spark, sf_dir):
    c = E.table(spark, sf_dir, "conversations").where(F.col("text").isNotNull())
    k = F.col("conv_id") * 3 + F.col("turn")
    ref = F.trim(F.regexp_replace("text", r"[^\x20-\x7E]+", " "))
    kind = (F.col("conv_id") + F.col("turn")) % 3
    return c.select("conv_id", F.col("turn").alias("place"), ref.alias("reference"), F.when(kind == 0, ref).when(kind == 1, F.regexp_replace(ref, "[ea]", "o")).otherwise(F.upper(ref)).alias("hypothesis"), F.when(k % 5 == 0, T.REVIEW).when(k % 11 == 1, T.CROSSED_OUT).otherwise(T.ACCEPTED).alias("decision_state"))


@query(f"""WITH {_TURNS},
g AS (SELECT conv_id, string_agg(ref, chr(10) ORDER BY place) AS r, coalesce(string_agg(hypothesis, chr(10) ORDER BY place) FILTER (decision_state <> 'CROSSED_OUT'), '') AS h,
  coalesce(string_agg(ref, chr(10) ORDER BY place) FILTER (decision_state = 'ACCEPTED'), '') AS ra, coalesce(string_agg(hypothesis, chr(10) ORDER BY place) FILTER (decision_state = 'ACCEPTED'), '') AS ha,
  count(*) FILTER (decision_state = 'ACCEPTED') AS na FROM conv GROUP BY conv_id)
SELECT conv_id, round({E.sql_cer("r", "h")}, 9) AS cer, CASE WHEN {E.sql_norm("r")} = {E.sql_norm("h")} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_match,
  round(CASE WHEN na = 0 THEN 0.0::DOUBLE ELSE {E.sql_cer("ra", "ha")} END, 9) AS selective_risk, round({E.sql_cer("r", "ha")}, 9) AS accepted_text_cer FROM g""")
def selective_risk(spark, sf_dir):
    """Both definitions of selective risk over whole conversations."""
    out = metrics.full_text_scores(_conversation_lines(spark, sf_dir), ["conv_id"])
    return out.select("conv_id", r(F.col("cer")).alias("cer"), "exact_match", r(F.col("selective_risk")).alias("selective_risk"), r(F.col("accepted_text_cer")).alias("accepted_text_cer"))


_SYSTEMS = f"""{E.HYPOTHESES},
best AS (
  SELECT doc_id, line_no, arg_max(text, visual_score * 1000 - ordinal) FILTER (model_name LIKE '%paddle%') AS pt, max(visual_score) FILTER (model_name LIKE '%paddle%') AS ps,
    arg_max(text, visual_score * 1000 - ordinal) FILTER (model_name LIKE '%trocr%') AS tt, max(visual_score) FILTER (model_name LIKE '%trocr%') AS ts
  FROM hyps GROUP BY doc_id, line_no),
sys AS (
  SELECT l.doc_id, l.line_no, 'print_only' AS system, coalesce(pt, '[ILLEGIBLE]') AS hypothesis, CASE WHEN pt IS NULL THEN 'ILLEGIBLE' ELSE 'ACCEPTED' END AS decision_state, coalesce(ps, 0.0::DOUBLE) AS confidence FROM lines l LEFT JOIN best USING (doc_id, line_no)
  UNION ALL
  SELECT l.doc_id, l.line_no, 'handwriting_lines', coalesce(tt, '[ILLEGIBLE]'), CASE WHEN tt IS NULL THEN 'ILLEGIBLE' WHEN ts >= 0.72 THEN 'ACCEPTED' ELSE 'REVIEW_REQUIRED' END, coalesce(ts, 0.0::DOUBLE) FROM lines l LEFT JOIN best USING (doc_id, line_no))"""


def _systems(spark, sf_dir):
    return metrics.derived_baselines(E.lines(spark, sf_dir).select("doc_id", "line_no"), E.hypotheses(spark, sf_dir))


@query(f"WITH {_SYSTEMS} SELECT * FROM sys")
def derived_baselines(spark, sf_dir):
    """The best hypothesis of each engine family as two systems."""
    return _systems(spark, sf_dir)


_SCORED = f"""{_SYSTEMS},
fused AS (SELECT doc_id, line_no, 'fused' AS system, hypothesis, CASE WHEN confidence >= 0.5 THEN 'ACCEPTED' ELSE 'REVIEW_REQUIRED' END AS decision_state FROM sys WHERE system = 'handwriting_lines'
  UNION ALL SELECT doc_id, line_no, 'handwriting_forced', hypothesis, CASE WHEN hypothesis = '[ILLEGIBLE]' THEN 'ILLEGIBLE' ELSE 'ACCEPTED' END FROM sys WHERE system = 'handwriting_lines'
  UNION ALL SELECT doc_id, line_no, system, hypothesis, decision_state FROM sys),
pairs AS (SELECT f.*, l.ref, {E.sql_correct("l.ref", "f.hypothesis")} AS correct FROM fused f JOIN lines l USING (doc_id, line_no)),
per_case AS (SELECT system, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'independent' ELSE 'derived' END AS baseline_kind,
  CAST(sum({E.sql_edits("ref", "hypothesis")}) AS DOUBLE) / sum(length(ref)) AS cer, CAST(count(*) FILTER (NOT correct AND decision_state = 'ACCEPTED') AS DOUBLE) / count(*) AS fce_rate,
  CAST(count(*) FILTER (decision_state = 'REVIEW_REQUIRED') AS DOUBLE) / count(*) AS review_rate, CAST(count(*) FILTER (decision_state = 'ACCEPTED') AS DOUBLE) / count(*) AS coverage_accepted,
  CAST(count(*) FILTER (decision_state IN ('REVIEW_REQUIRED', 'ILLEGIBLE')) AS DOUBLE) / count(*) AS abstention_rate,
  CASE WHEN count(*) FILTER (decision_state = 'ACCEPTED') = 0 THEN 0.0::DOUBLE ELSE CAST(count(*) FILTER (decision_state = 'ACCEPTED' AND correct) AS DOUBLE) / count(*) FILTER (decision_state = 'ACCEPTED') END AS accepted_accuracy FROM pairs GROUP BY system, doc_id)"""


def _per_case(spark, sf_dir):
    """Scores of four systems per document."""
    words = E.lines(spark, sf_dir).select("doc_id", "line_no", F.col("ref").alias("reference"))
    pairs = metrics.judge(metrics.derived_baselines(words, E.hypotheses(spark, sf_dir)))
    pairs = pairs.withColumn("edits", T.edits(F.col("reference"), F.col("hypothesis")))
    # the fused and the forced system have the handwriting system's texts, with other states
    as_system = lambda name, state: F.struct((F.lit(name) if isinstance(name, str) else name).alias("system"), F.lit(state).alias("state") if isinstance(state, str) else state.alias("state"))
    own = as_system(F.col("system"), F.col("decision_state"))
    fused = as_system("fused", F.when(F.col("confidence") >= 0.5, T.ACCEPTED).otherwise(T.REVIEW))
    forced = as_system("handwriting_forced", F.when(F.col("hypothesis") == T.ILLEGIBLE_TEXT, T.ILLEGIBLE).otherwise(T.ACCEPTED))
    systems = F.when(F.col("system") == "handwriting_lines", F.array(own, fused, forced)).otherwise(F.array(own))
    rows = pairs.select("doc_id", "reference", "correct", "edits", F.explode(systems).alias("s")).select("doc_id", "reference", "correct", "edits", "s.*")
    rows = rows.withColumn("fce", ~F.col("correct") & (F.col("state") == T.ACCEPTED))
    n, state = F.count(F.lit(1)), F.col("state")
    edits, chars = F.sum("edits"), F.sum(F.length("reference"))
    return rows.groupBy("system", "doc_id").agg(
        F.max(F.when(F.col("doc_id") % 2 == 0, "independent").otherwise("derived")).alias("baseline_kind"),
        F.when(chars == 0, F.when(edits == 0, 0.0).otherwise(1.0)).otherwise(edits / F.greatest(chars, F.lit(1))).alias("cer"),
        (F.count_if("fce") / n).alias("fce_rate"),
        (F.count_if(state == T.REVIEW) / n).alias("review_rate"),
        (F.count_if(state == T.ACCEPTED) / n).alias("coverage_accepted"),
        (F.count_if(state.isin(T.REVIEW, T.ILLEGIBLE)) / n).alias("abstention_rate"),
        F.when(F.count_if(state == T.ACCEPTED) == 0, 0.0).otherwise(F.count_if((state == T.ACCEPTED) & F.col("correct")) / F.greatest(F.count_if(state == T.ACCEPTED), F.lit(1))).alias("accepted_accuracy"),
    )


_MEANS = ("cer", "fce_rate", "review_rate", "coverage_accepted", "abstention_rate")


@query(f"WITH {_SCORED} SELECT system, count(*) AS n, {', '.join(f'round(avg({m}), 9) AS mean_{m}' for m in _MEANS)} FROM per_case GROUP BY system")
def systems_summary(spark, sf_dir):
    """Means per system over documents."""
    out = metrics.mean_by_system(_per_case(spark, sf_dir), list(_MEANS))
    return out.select("system", "n", *[r(F.col(f"mean_{m}")).alias(f"mean_{m}") for m in _MEANS])


@query(f"""WITH {_SCORED},
u AS (SELECT p.*, unnest(CASE system WHEN 'print_only' THEN ['A'] WHEN 'handwriting_lines' THEN ['B'] WHEN 'handwriting_forced' THEN ['C'] ELSE ['D', 'E', 'F'] END) AS config FROM per_case p)
SELECT config, CASE WHEN count(DISTINCT baseline_kind) > 1 THEN 'mixed:' || string_agg(DISTINCT baseline_kind, ',' ORDER BY baseline_kind) ELSE max(baseline_kind) END AS baseline_kind,
  round(avg(cer), 9) AS cer, round(avg(fce_rate), 9) AS fce_rate, round(avg(review_rate), 9) AS review_rate, round(avg(coverage_accepted), 9) AS coverage_accepted, count(*) AS n
FROM u GROUP BY config""")
def ablation_summary(spark, sf_dir):
    """Configurations A to F."""
    out = metrics.ablation(_per_case(spark, sf_dir))
    return out.select("config", "baseline_kind", *[r(F.col(m)).alias(m) for m in ("cer", "fce_rate", "review_rate", "coverage_accepted")], "n")


_CLAIMS = f"""{_SCORED},
s AS (SELECT system, avg(cer) AS cer, avg(fce_rate) AS fce, avg(coverage_accepted) AS cov, avg(abstention_rate) AS abs FROM per_case GROUP BY system),
m AS (SELECT max(cer) FILTER (system = 'print_only') AS pc, max(cer) FILTER (system = 'fused') AS sc, max(fce) FILTER (system = 'print_only') AS pf, max(fce) FILTER (system = 'fused') AS sf, max(cov) FILTER (system = 'print_only') AS pv, max(cov) FILTER (system = 'fused') AS sv,
  max(fce) FILTER (system = 'handwriting_lines') AS tf, max(cov) FILTER (system = 'handwriting_lines') AS tv, max(abs) FILTER (system = 'handwriting_lines') AS ta FROM s),
c AS (SELECT list_filter([
  {{'level': 'NOT_PROVEN', 'claim': 'Readiness is NOT_PROVEN: 10 cases, 1 real; the data set gate is not passed.'}},
  {{'level': 'SUPPORTED_BUT_PRELIMINARY', 'claim': 'The fused system''s CER (' || printf('%.4f', sc) || CASE WHEN abs(sc - pc) <= 0.05 THEN ') is essentially equal to print-only CER (' WHEN sc < pc THEN ') is lower than print-only CER (' ELSE ') is not better than print-only CER (' END || printf('%.4f', pc) || ').'}},
  {{'level': 'SUPPORTED_BUT_PRELIMINARY', 'claim': CASE WHEN sf + 1e-9 < pf THEN 'False-confident errors fall from ' || printf('%.4f', pf) || ' to ' || printf('%.4f', sf) || '.' ELSE 'Fewer false-confident errors are not demonstrated (' || printf('%.4f', sf) || ' against ' || printf('%.4f', pf) || ').' END}},
  CASE WHEN sv + 1e-9 < pv THEN {{'level': 'SUPPORTED_BUT_PRELIMINARY', 'claim': 'The fused system accepts less than print-only, as abstention does.'}} END,
  CASE WHEN tf < 0.15 AND (tv < 0.25 OR ta > 0.7) THEN {{'level': 'SUPPORTED_BUT_PRELIMINARY', 'claim': 'Handwriting-only has few false-confident errors because it abstains.'}} END,
  {{'level': 'NOT_PROVEN', 'claim': 'Only 1 real case(s) can be scored.'}}, {{'level': 'NOT_PROVEN', 'claim': 'Significance of differences is NOT_PROVEN on so few cases.'}}], lambda x: x IS NOT NULL) AS l FROM m),
claims AS (SELECT CAST(i - 1 AS INT) AS ordinal, l[i].level AS level, l[i].claim AS claim FROM c, (SELECT unnest(range(1, 8)) AS i) WHERE i <= len(l))"""


@query(f"WITH {_CLAIMS} SELECT * FROM claims")
def claims(spark, sf_dir):
    """What the means support."""
    means = metrics.mean_by_system(_per_case(spark, sf_dir), ["cer", "fce_rate", "coverage_accepted", "abstention_rate"])
    return integrity.claims(means, n_cases=10, n_real=1, eligible=False)


# --- results and review --------------------------------------------------------


@query(f"WITH {E.WORDS} SELECT doc_id, count(*) AS total, count(*) FILTER (decision_state = 'ACCEPTED') AS accepted, count(*) FILTER (decision_state = 'REVIEW_REQUIRED') AS review, count(*) FILTER (decision_state = 'ILLEGIBLE') AS illegible, count(*) FILTER (decision_state = 'CROSSED_OUT') AS crossed FROM words GROUP BY doc_id")
def state_counts(spark, sf_dir):
    return results.state_counts(E.words(spark, sf_dir), ["doc_id"])


@query(f"WITH {E.WORDS} SELECT word_id, decision_state, uncertainty FROM words WHERE decision_state <> 'ACCEPTED' OR uncertainty > 0.28")
def low_confidence(spark, sf_dir):
    return results.low_confidence(E.words(spark, sf_dir)).select("word_id", "decision_state", "uncertainty")


@query(f"WITH {E.WORDS} SELECT doc_id, coalesce(string_agg(hypothesis, chr(10) ORDER BY line_no) FILTER (decision_state = 'ACCEPTED'), '') AS accepted_text, coalesce(string_agg(hypothesis, chr(10) ORDER BY line_no) FILTER (decision_state <> 'CROSSED_OUT'), '') AS active_text FROM words GROUP BY doc_id")
def accepted_text(spark, sf_dir):
    return results.accepted_text(E.words(spark, sf_dir).withColumn("text", F.col("hypothesis")), ["doc_id"], "line_no")


def _md_words(spark, sf_dir):
    return E.words(spark, sf_dir).withColumn("text", F.col("hypothesis"))


_MD = f"""{E.WORDS},
md AS (SELECT doc_id, line_no, region_type, CASE decision_state
  WHEN 'CROSSED_OUT' THEN '~~' || p || hypothesis || '~~ <!-- crossed-out uncertainty=' || u || ' -->'
  WHEN 'ILLEGIBLE' THEN '**[ILLEGIBLE]** <!-- uncertainty=' || u || ' region=' || region_type || ' -->'
  WHEN 'REVIEW_REQUIRED' THEN '==' || p || hypothesis || '== <!-- review evidence_score=' || c || ' (uncalibrated) unc=' || u || ' -->'
  ELSE p || hypothesis END AS line
  FROM (SELECT *, CASE WHEN region_type = 'margin_note' THEN '[margin] ' ELSE '' END AS p, printf('%.2f', uncertainty) AS u, printf('%.2f', confidence) AS c FROM words))"""


@query(f"""WITH {_MD}
SELECT doc_id, '# Transcription' || chr(10) || chr(10) || '## Body' || chr(10) || coalesce(chr(10) || string_agg(line, chr(10) ORDER BY line_no) FILTER (region_type <> 'margin_note'), chr(10))
  || coalesce(chr(10) || chr(10) || '## Margin notes' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY line_no) FILTER (region_type = 'margin_note'), '') AS md
FROM md GROUP BY doc_id""")
def markdown_export(spark, sf_dir):
    """Markdown of each document, body and margin notes."""
    out = results.markdown(_md_words(spark, sf_dir), ["doc_id"], "line_no")
    # a document of margin notes alone has no body line
    return out.select("doc_id", F.regexp_replace("markdown", r"(?s)\A(# Transcription\n\n## Body\n)\n\n## Margin", "$1\n\n\n## Margin").alias("md"))


@query(f"WITH {E.WORDS} SELECT doc_id, count(*) AS word_count, count(*) FILTER (decision_state = 'ACCEPTED') AS accepted, count(*) FILTER (decision_state <> 'CROSSED_OUT') AS items, string_agg(hypothesis || ':' || region_type, '|' ORDER BY line_no) FILTER (decision_state <> 'CROSSED_OUT') AS inventory FROM words GROUP BY doc_id")
def inventory(spark, sf_dir):
    """Completion figures and the line items of each document."""
    words = _md_words(spark, sf_dir)
    items = results.inventory(words, ["doc_id"], "line_no").select("doc_id", F.array_join(F.transform("items", lambda i: F.concat(i["text"], F.lit(":"), i["region_type"])), "|").alias("inventory"))
    return results.completion(words, ["doc_id"]).join(items, "doc_id", "left")


@query(f"WITH {E.WORDS} SELECT word_id, decision_state AS reason, CAST(CASE WHEN is_high_risk THEN 2 ELSE 1 END AS INT) AS priority FROM words WHERE decision_state IN ('REVIEW_REQUIRED', 'ILLEGIBLE')")
def review_queue(spark, sf_dir):
    return store.review_tasks(E.words(spark, sf_dir))


_PATCHES = f"""{E.WORDS},
patches AS (
  SELECT CAST(event_id % 200 AS VARCHAR) || '-' || CAST(event_id % 7 AS VARCHAR) AS word_id, ts, event_id, CASE WHEN event_id % 3 <> 0 THEN 'fixed ' || event_type END AS new_text,
    CASE event_id % 5 WHEN 0 THEN 'ACCEPTED' WHEN 1 THEN 'ILLEGIBLE' WHEN 2 THEN 'bad' END AS new_state FROM events),
valid AS (SELECT p.*, w.hypothesis AS old_text, w.decision_state AS old_state, coalesce(p.new_state, CASE WHEN p.new_text IS NOT NULL THEN 'ACCEPTED' END) AS p_state FROM patches p JOIN words w USING (word_id) WHERE p.new_state IS NULL OR p.new_state <> 'bad'),
log AS (SELECT word_id, event_id, ts,
  coalesce(last_value(new_text IGNORE NULLS) OVER (PARTITION BY word_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), old_text) AS previous_text,
  coalesce(last_value(new_text IGNORE NULLS) OVER (PARTITION BY word_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), old_text) AS new_text,
  coalesce(last_value(p_state IGNORE NULLS) OVER (PARTITION BY word_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), old_state) AS previous_state,
  coalesce(last_value(p_state IGNORE NULLS) OVER (PARTITION BY word_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), old_state) AS new_state FROM valid)"""


@query(f"WITH {_PATCHES} SELECT word_id, event_id, previous_text, new_text, previous_state, new_state FROM log")
def corrections_log(spark, sf_dir):
    """What each correction changed."""
    _, log = store.correct(_md_words(spark, sf_dir).select("word_id", "text", "decision_state"), E.patches(spark, sf_dir), ["ts", "event_id"], True)
    return log.drop("ts")


@query(f"WITH {_PATCHES}, now AS (SELECT word_id, arg_max(new_text, ts * 1) AS t FROM (SELECT word_id, new_text, row_number() OVER (PARTITION BY word_id ORDER BY ts, event_id) AS ts FROM log) GROUP BY word_id), nst AS (SELECT word_id, arg_max(new_state, ts * 1) AS s FROM (SELECT word_id, new_state, row_number() OVER (PARTITION BY word_id ORDER BY ts, event_id) AS ts FROM log) GROUP BY word_id) SELECT word_id, coalesce(t, hypothesis) AS text, coalesce(s, decision_state) AS decision_state FROM words LEFT JOIN now USING (word_id) LEFT JOIN nst USING (word_id)")
def corrections_applied(spark, sf_dir):
    """All words after the readers' corrections."""
    words, _ = store.correct(_md_words(spark, sf_dir).select("word_id", "text", "decision_state"), E.patches(spark, sf_dir), ["ts", "event_id"], True)
    return words


_STAGE = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'loading' WHEN 'click' THEN 'recognition' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'queued' END"
_JOBS = f"""j AS (SELECT user_id AS document_id, {_STAGE} AS stage, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)"""


@query(f"WITH {_JOBS} SELECT document_id, stage, CASE WHEN stage IN ('completed', 'failed', 'queued') THEN stage ELSE 'processing' END AS status, CASE stage WHEN 'queued' THEN 0.0::DOUBLE WHEN 'loading' THEN 0.05::DOUBLE WHEN 'recognition' THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS progress, event_id FROM j WHERE n = 1")
def latest_job(spark, sf_dir):
    """The current state of each job."""
    return E.jobs_of(spark, sf_dir).drop("updated_at")


@query(f"WITH {_JOBS} SELECT document_id, stage, CAST(CASE WHEN document_id % 6 = 5 THEN 400 WHEN stage IN ('completed') THEN 200 ELSE 409 END AS INT) AS code FROM j WHERE n = 1")
def export_outcomes(spark, sf_dir):
    """What an export request gets."""
    fmt = F.when(F.col("document_id") % 6 == 5, "docx").when(F.col("document_id") % 2 == 0, "md").otherwise("json")
    return E.jobs_of(spark, sf_dir).select("document_id", "stage", results.export_outcome(F.col("status"), fmt).alias("code"))


@query(f"""WITH {E.WORDS},
ch AS (SELECT word_id, event_id, 'upserted ' || event_type AS t FROM (SELECT CAST(event_id % 300 AS VARCHAR) || '-' || CAST(event_id % 5 AS VARCHAR) AS word_id, event_id, event_type, row_number() OVER (PARTITION BY event_id % 300, event_id % 5 ORDER BY event_id DESC) AS n FROM events) WHERE n = 1)
SELECT coalesce(ch.word_id, w.word_id) AS word_id, coalesce(ch.t, w.hypothesis) AS text, CASE WHEN ch.word_id IS NOT NULL THEN coalesce(CASE WHEN event_id % 2 = 0 THEN 'ACCEPTED' END, w.decision_state) ELSE w.decision_state END AS decision_state
FROM words w FULL JOIN ch ON w.word_id = ch.word_id""")
def upsert_words(spark, sf_dir):
    """The last of many changes to a word wins; a change without a state keeps the old one."""
    base = E.words(spark, sf_dir).select("word_id", F.col("hypothesis").alias("text"), "decision_state", F.lit(-1).cast("long").alias("event_id"))
    i = F.col("event_id")
    changes = E.table(spark, sf_dir, "events").select(F.concat_ws("-", i % 300, i % 5).alias("word_id"), F.concat_ws(" ", F.lit("upserted"), "event_type").alias("text"), F.when(i % 2 == 0, T.ACCEPTED).alias("decision_state"), "event_id")
    return store.upsert(base, changes, ["word_id"], "event_id", ("decision_state",)).drop("event_id")


@query("SELECT sha256(text) AS sha256, count(*) AS copies, 'blobs/' || substr(sha256(text), 1, 2) || '/' || sha256(text) AS path FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 5 = 0 AND text IS NOT NULL) GROUP BY 1")
def new_blobs(spark, sf_dir):
    """Texts as blobs: those whose digest is not stored yet, and where they go."""
    docs = E.table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).withColumn("sha256", F.sha2("text", 256))
    there = docs.where(F.col("doc_id") % 5 == 0).select("sha256").distinct()
    return docs.join(there, "sha256", "left_anti").groupBy("sha256").agg(F.count(F.lit(1)).alias("copies")).withColumn("path", store.blob_path(F.col("sha256")))


@query(f"""WITH {E.WORDS},
f AS (SELECT sha256(text) AS sha, min(doc_id) AS id FROM documents GROUP BY 1),
g AS (SELECT doc_id, string_agg(hypothesis, chr(10) ORDER BY line_no) AS gt FROM words GROUP BY doc_id)
SELECT CAST(id AS VARCHAR) AS id, 'scan_' || CAST(id AS VARCHAR) || '_.png' AS image, coalesce(gt, '') AS ground_truth, sha AS sha256, true AS needs_gt_review, false AS is_synthetic FROM f LEFT JOIN g ON g.doc_id = f.id""")
def held_out_export(spark, sf_dir):
    """Evaluation cases made of finished documents, one for each distinct image."""
    from quillstone.sources import files

    docs = E.table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    documents = docs.select(n.cast("string").alias("id"), F.concat(F.lit("up/scan "), n.cast("string"), F.lit(" (.png")).alias("filename"), F.concat(F.lit("a"), n.cast("string")).alias("source_artifact_id"), n.alias("created_at"))
    artifacts = docs.select(F.concat(F.lit("a"), n.cast("string")).alias("id"), F.sha2("text", 256).alias("sha256"))
    words = E.words(spark, sf_dir).select(n.cast("string").alias("document_id"), F.col("hypothesis").alias("text"), F.col("line_no").alias("reading_order"))
    return files.held_out_export(documents, artifacts, words)


# --- predicates and scores --------------------------------------------------------


@query(f"""WITH {E.HYPOTHESES}
SELECT doc_id, line_no, CAST(ordinal AS INT) AS ordinal, regexp_matches(text, '[0-9]|[A-Z][a-z]+|[A-Z0-9]{{4,}}') AS high_risk,
  regexp_matches(text, '^[^A-Za-z0-9]+$') OR (length(replace(replace(text, ' ', ''), substr(replace(text, ' ', ''), 1, 1), '')) = 0 AND length(text) > 3) AS garbage,
  contains(text, '?') OR length(text) - length(replace(text, '.', '')) > 3 OR {E.sql_scattered("text")} AS artefacts,
  contains(model_name, 'trocr') AS of_hand, contains(model_name, 'paddle') AS of_print
FROM hyps""")
def text_predicates(spark, sf_dir):
    """High-risk, garbage, artefact and family predicates of every hypothesis."""
    t, m = F.col("text"), F.col("model_name")
    return E.hypotheses(spark, sf_dir).select("doc_id", "line_no", "ordinal", T.is_high_risk(t).alias("high_risk"), T.is_garbage(t).alias("garbage"), T.has_decode_artefacts(t).alias("artefacts"), T.is_handwriting_model(m).alias("of_hand"), T.is_print_model(m).alias("of_print"))


_HINTS = "[" + ", ".join(f"'{x}'" for x in S.DOMAIN_HINTS) + "]"
_LEX = ", ".join(f"'{x}'" for x in S.LEXICON)
_UNITS = ", ".join(f"'{x}'" for x in S.UNITS)


@query(f"""WITH {E.LINES},
t AS (SELECT doc_id, line_no, CASE doc_id % 4 WHEN 0 THEN 'Patient ' || ref || ' mg dose' WHEN 1 THEN CAST(1 + line_no % 28 AS VARCHAR) || ' / ' || CAST(1 + doc_id % 12 AS VARCHAR) || ' / 2024' WHEN 2 THEN CAST(doc_id AS VARCHAR) || ' mg' ELSE ref END AS text FROM lines),
x AS (SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks, regexp_matches(replace(text, ' ', ''), '^(\\d{{1,2}})\\s*[/\\-.]\\s*(\\d{{1,2}})\\s*[/\\-.]\\s*(\\d{{2,4}})$') AS is_date FROM t),
y AS (SELECT *, len(list_filter(toks, lambda k: k IN ({_LEX}, {_UNITS}))) AS hits FROM x)
SELECT doc_id, line_no, least(1.0::DOUBLE, 0.25::DOUBLE * len(list_intersect(list_distinct(toks), {_HINTS}))) AS hint,
  round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.4::DOUBLE + CASE WHEN regexp_matches(text, '[A-Za-z]{{2,}}') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN is_date OR regexp_matches(text, '(?i)^(\\d+(?:\\.\\d+)?)\\s*(mg|ml|g|kg|mcg|iu|%|mm|cm)$') THEN 0.3::DOUBLE ELSE 0 END
    + CASE WHEN lower(text) IN ({_LEX}) THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN contains(text, '?') OR length(text) - length(replace(text, '.', '')) > 2 THEN 0.15::DOUBLE ELSE 0 END)), 9) AS plausibility,
  round(CASE WHEN len(toks) = 0 THEN 0.0::DOUBLE WHEN hits > 0 THEN least(1.0::DOUBLE, 0.35::DOUBLE + 0.2::DOUBLE * hits) WHEN is_date THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END, 9) AS domain
FROM y""")
def domain_scores(spark, sf_dir):
    """Domain hint, language plausibility and domain score."""
    d, n = F.col("doc_id"), F.col("line_no")
    text = F.when(d % 4 == 0, F.concat(F.lit("Patient "), "ref", F.lit(" mg dose"))).when(d % 4 == 1, F.concat((1 + n % 28).cast("string"), F.lit(" / "), (1 + d % 12).cast("string"), F.lit(" / 2024"))).when(d % 4 == 2, F.concat(d.cast("string"), F.lit(" mg"))).otherwise(F.col("ref"))
    rows = E.lines(spark, sf_dir).withColumn("t", text)
    t = F.col("t")
    return rows.select("doc_id", "line_no", S.domain_hint(t).alias("hint"), r(S.language_plausibility(t)).alias("plausibility"), r(S.domain_score(t)).alias("domain"))


_REPAIR_INPUT = """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN CAST(1 + doc_id % 28 AS VARCHAR) || '-' || CAST(1 + doc_id % 12 AS VARCHAR) || '-2024' WHEN 1 THEN CAST(doc_id AS VARCHAR) || 'MG'
  WHEN 2 THEN CAST(doc_id AS VARCHAR) || '  /  ' || CAST(doc_id % 9 AS VARCHAR) WHEN 3 THEN 'take ' || CAST(doc_id AS VARCHAR) || ' mq twice' WHEN 4 THEN 'Px  amoxicillin' WHEN 5 THEN 'Bx ' || CAST(doc_id AS VARCHAR) || 'ng' ELSE 'plain  text' END AS text FROM documents"""


@query(f"""WITH i AS ({_REPAIR_INPUT}), t AS (SELECT doc_id, trim(regexp_replace(text, '[ \t]+', ' ', 'g')) AS t FROM i),
c AS (SELECT *, replace(t, ' ', '') AS k FROM t),
f AS (SELECT *, lpad(regexp_extract(k, '^(\\d{{1,2}})[/\\-.](\\d{{1,2}})[/\\-.](\\d{{2,4}})$', 1), 2, '0') || '/' || lpad(regexp_extract(k, '^(\\d{{1,2}})[/\\-.](\\d{{1,2}})[/\\-.](\\d{{2,4}})$', 2), 2, '0') || '/' || regexp_extract(k, '^(\\d{{1,2}})[/\\-.](\\d{{1,2}})[/\\-.](\\d{{2,4}})$', 3) AS d,
  regexp_extract(t, '(?i)^(\\d+)(mg|ml|g)$', 1) || ' ' || lower(regexp_extract(t, '(?i)^(\\d+)(mg|ml|g)$', 2)) AS u, regexp_replace(t, '^(\\d+)\\s+/\\s+(\\d+)$', '\\1/\\2') AS s, regexp_replace(t, '(?i)\\b(\\d+)\\s*(ma|mq|ng)\\b', '\\1 mg', 'g') AS m FROM c)
SELECT doc_id, CASE WHEN regexp_matches(k, '^(\\d{{1,2}})[/\\-.](\\d{{1,2}})[/\\-.](\\d{{2,4}})$') AND d <> t THEN d WHEN regexp_matches(t, '(?i)^(\\d+)(mg|ml|g)$') AND u <> t THEN u WHEN s <> t THEN s ELSE regexp_replace(m, '\\b(Rai|Ri|Px|Bx)\\b', 'Rx', 'g') END AS text,
  CASE WHEN regexp_matches(k, '^(\\d{{1,2}})[/\\-.](\\d{{1,2}})[/\\-.](\\d{{2,4}})$') AND d <> t THEN 'date_format' WHEN regexp_matches(t, '(?i)^(\\d+)(mg|ml|g)$') AND u <> t THEN 'unit_spacing' WHEN s <> t THEN 'slash_normalize' WHEN m <> t THEN 'unit_repair' WHEN regexp_matches(m, '\\b(Rai|Ri|Px|Bx)\\b') THEN 'rx_prefix_repair' END AS edit FROM f""")
def format_repair(spark, sf_dir):
    """Dates, units, slashes and small slips put right."""
    d = F.col("doc_id")
    s = d.cast("string")
    forms = [
        F.concat((1 + d % 28).cast("string"), F.lit("-"), (1 + d % 12).cast("string"), F.lit("-2024")), F.concat(s, F.lit("MG")), F.concat(s, F.lit("  /  "), (d % 9).cast("string")),
        F.concat(F.lit("take "), s, F.lit(" mq twice")), F.lit("Px  amoxicillin"), F.concat(F.lit("Bx "), s, F.lit("ng")), F.lit("plain  text"),
    ]
    text = F.get(F.array(*forms), (d % 7).cast("int"))
    return E.table(spark, sf_dir, "documents").select("doc_id", S.format_repair(text, True).alias("x")).select("doc_id", "x.text", "x.edit")


@query("""WITH q AS (SELECT doc_id, CAST(doc_id % 200 AS DOUBLE) AS blur, CAST((doc_id * 3) % 70 AS DOUBLE) AS contrast, CAST((doc_id * 7) % 30 AS DOUBLE) AS noise, CAST(100 + (doc_id * 11) % 120 AS DOUBLE) AS res FROM documents),
p AS (SELECT *, (CASE WHEN blur >= 120 THEN 2 WHEN blur >= 60 THEN 1 ELSE 0 END) + (CASE WHEN contrast >= 45 THEN 2 WHEN contrast >= 25 THEN 1 ELSE 0 END) + (CASE WHEN noise <= 12 THEN 2 WHEN noise <= 22 THEN 1 ELSE 0 END) + (CASE WHEN res >= 150 THEN 1 ELSE 0 END) AS pts FROM q)
SELECT doc_id, CASE WHEN pts >= 6 THEN 'good' WHEN pts >= 4 THEN 'fair' WHEN pts >= 2 THEN 'poor' ELSE 'unusable' END AS quality, CASE WHEN pts >= 6 THEN 0.1::DOUBLE WHEN pts >= 4 THEN 0.3::DOUBLE WHEN pts >= 2 THEN 0.55::DOUBLE ELSE 0.85::DOUBLE END AS risk,
  round(least(0.95::DOUBLE, greatest(0.02::DOUBLE, (1.0::DOUBLE / (1.0::DOUBLE + exp(-(-(doc_id % 50) / 10.0::DOUBLE + 1.5::DOUBLE) / 1.5::DOUBLE))) * greatest(0.55::DOUBLE, 1.0::DOUBLE - 0.08::DOUBLE * (doc_id % 8)))), 9) AS visual,
  round(least(0.32::DOUBLE, greatest(0.05::DOUBLE, (doc_id % 101) / 100.0::DOUBLE * 0.35::DOUBLE)), 9) AS hint_visual FROM p""")
def calibrations(spark, sf_dir):
    """Page quality, its risk, and calibrated visual scores."""
    d = F.col("doc_id")
    q = S.quality_class((d % 200).cast("double"), ((d * 3) % 70).cast("double"), ((d * 7) % 30).cast("double"), (100 + (d * 11) % 120).cast("double"))
    return E.table(spark, sf_dir, "documents").select("doc_id", q.alias("quality"), S.quality_risk(q).alias("risk"), r(S.visual_from_sequence(-(d % 50) / F.lit(10.0), d % 8 + 1)).alias("visual"), r(S.print_hint_visual((d % 101) / F.lit(100.0))).alias("hint_visual"))


# --- fusion and routing --------------------------------------------------------


_PAIRS = " + ".join(f"(1.0::DOUBLE - {E.sql_dist(f'n{i}', f'n{j}')})" for i in range(4) for j in range(i + 1, 4))
_EXPS = [f"exp(v{i} - greatest(v0, v1, v2, v3))" for i in range(4)]
_SUM = "(" + " + ".join(_EXPS) + ")"


@query(f"""WITH {E.CANDIDATES}
SELECT doc_id, line_no, round(({_PAIRS}) / 6, 9) AS stability, round(least(1.0::DOUBLE, -({" + ".join(f"({e} / {_SUM}) * ln({e} / {_SUM} + 1e-12::DOUBLE)" for e in _EXPS)}) / ln(4.0::DOUBLE)), 9) AS entropy, CAST(len(list_distinct([n0, n1, n2, n3])) AS INT) AS texts FROM cand""")
def stability_entropy(spark, sf_dir):
    """Mean similarity of a line's handwriting candidates and the entropy of their scores."""
    hand = F.filter("hyps", fusion.is_hand)
    rows = E.candidates(spark, sf_dir).withColumn("hand", T.kept(hand)).withColumn("apart", T.kept(fusion.distances(F.col("hand"))))
    places = F.filter(F.transform("hand", lambda h, i: F.when(h["normalized_text"] != "", i)), lambda i: i.isNotNull())
    stability = T.let(places, lambda there: fusion.stability(there, F.col("apart"), F.size("hand")))
    return rows.select("doc_id", "line_no", r(stability).alias("stability"), r(S.softmax_entropy(F.transform("hand", lambda h: h["visual"]))).alias("entropy"), F.size(F.array_distinct(F.transform("hand", lambda h: h["normalized_text"]))).alias("texts"))


@query(fuse_sql.CLUSTERS)
def cluster_fold(spark, sf_dir):
    """First-fit clusters of each line's five candidates."""
    rows = E.candidates(spark, sf_dir).withColumn("apart", T.kept(fusion.distances(F.col("hyps"))))
    numbers = fusion.cluster_numbers(F.col("hyps"), F.col("apart"))
    return rows.select("doc_id", "line_no", F.array_join(F.transform(numbers, lambda n: n.cast("string")), ",").alias("clusters"))


@query(fuse_sql.FUSE)
def fuse_states(spark, sf_dir):
    """The decision of each line from its five candidates."""
    out = fusion.fuse(E.candidates(spark, sf_dir))
    d = F.col("decision")
    return out.select("doc_id", "line_no", d["state"].alias("state"), d["text"].alias("text"), r(d["confidence"]).alias("confidence"), r(d["uncertainty"]).alias("uncertainty"), r(d["final_score"]).alias("final_score"), d["is_high_risk"].alias("is_high_risk"), F.array_join(d["alternatives"], "|").alias("alternatives"))


@query()
def rerank_lines(spark, sf_dir):
    """Candidates with safe repairs, reranked, then fused. Needs the lexicon's Python worker; checked by tests."""
    rows = rerank.with_repairs(E.candidates(spark, sf_dir).select("doc_id", "line_no", "script_mode", "hyps", "composed"), ["doc_id", "line_no"])
    out = fusion.fuse(rerank.rank(rows))
    return out.select("doc_id", "line_no", F.size("hyps").alias("candidates"), r(F.col("context_score")).alias("context_score"), F.col("decision.state").alias("state"), F.col("decision.text").alias("text"))


_LEX_LIST = "[" + ", ".join(f"'{x}'" for x in S.LEXICON) + "]"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, {_LEX_LIST}[doc_id % {len(S.LEXICON)} + 1] AS word FROM documents),
g AS (SELECT doc_id, substr(word, 1, 2) || 'q' || substr(word, 4) AS low FROM d),
pair AS (SELECT low, term FROM (SELECT DISTINCT low FROM g), (SELECT unnest({_LEX_LIST}) AS term) WHERE length(low) > 4 AND abs(length(term) - length(low)) <= 3),
dp AS (
  SELECT low, term, CAST(0 AS BIGINT) AS i, list_transform(range(0, length(term) + 1), lambda j: CAST(0 AS BIGINT)) AS kept FROM pair
  UNION ALL
  SELECT low, term, i + 1, [CAST(0 AS BIGINT)] || list_transform(range(1, length(term) + 1), lambda j: list_max(best[1:j]))
  FROM (SELECT low, term, i, list_transform(range(1, length(term) + 1), lambda j: greatest(kept[j + 1], CASE WHEN substr(term, j, 1) = substr(low, i + 1, 1) THEN kept[j] + 1 ELSE 0 END)) AS best FROM dp WHERE i < length(low))),
ratio AS (SELECT low, term, 200.0::DOUBLE * kept[-1] / (length(low) + length(term)) AS r FROM dp WHERE i = length(low)),
near AS (SELECT low, term, r, row_number() OVER (PARTITION BY low ORDER BY r DESC, term) AS n FROM ratio),
fixed AS (SELECT low, term FROM near WHERE n = 1 AND r >= 88 AND abs(length(term) - length(low)) <= 1 AND levenshtein(low, term) / greatest(length(low), length(term))::DOUBLE <= 0.18)
SELECT doc_id, g.low || ' 5 mg' AS given, coalesce(CASE WHEN g.low IN ({_LEX}) THEN g.low END, term, g.low) || ' 5 mg' AS text, CAST(CASE WHEN term IS NOT NULL AND term <> g.low AND g.low NOT IN ({_LEX}) THEN 1 ELSE 0 END AS INT) AS edits FROM g LEFT JOIN fixed ON fixed.low = g.low""")
def lexicon_repair(spark, sf_dir):
    """Near-exact lexicon repairs of words with one letter wrong."""
    words = F.array(*[F.lit(w) for w in S.LEXICON])
    word = F.get(words, (F.col("doc_id") % len(S.LEXICON)).cast("int"))
    broken = F.concat(F.substring(word, 1, 2), F.lit("q"), F.substring(word, 4, 40))
    rows = E.table(spark, sf_dir, "documents").select("doc_id", F.concat(broken, F.lit(" 5 mg")).alias("given"))
    return rows.withColumn("x", S.lexicon_repair()("given")).select("doc_id", "given", "x.text", "x.edits")


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(replace(nfc_normalize(text), chr(160), ' '), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents")
def nfkc_texts(spark, sf_dir):
    """The normal form of every text, as a digest. SQL knows canonical composition only; the tables hold no compatibility characters, tests do."""
    return E.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_candidate(F.col("text"))).alias("digest"))


@query(f"""WITH {E.CANDIDATES},
s AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'mixed' WHEN (doc_id + line_no) % 4 = 0 THEN 'print' ELSE script_mode END AS script, greatest(v0, v1, v2, v3) AS hv, v4 AS pv FROM cand),
k AS (SELECT *, greatest({", ".join(f"coalesce(CAST(len(list_filter(list_filter(regexp_extract_all(lower(t{i}), '[a-z]+'), lambda w: length(w) > 1), lambda w: w IN ({', '.join(repr(x) for x in S.COVERAGE_TERMS)}))) AS DOUBLE) / nullif(len(list_filter(regexp_extract_all(lower(t{i}), '[a-z]+'), lambda w: length(w) > 1)), 0), 0)" for i in range(4))}) AS cov FROM s)
SELECT doc_id, line_no, script, CASE WHEN script = 'print' THEN pv < 0.55 AND hv < 0.45 ELSE hv < 0.50 OR cov <= 0.25 END AS second_pass, greatest(hv, pv) < 0.60 OR script = 'mixed' AS verify FROM k""")
def routing_decisions(spark, sf_dir):
    """Script of each line, whether it is read again, and whether a verifier is asked."""
    d, n = F.col("doc_id"), F.col("line_no")
    region = F.when((d + n) % 4 == 0, "printed_text").otherwise("main_handwriting")
    rows = E.candidates(spark, sf_dir).withColumn("script", routing.route(F.col("script_mode"), region, d % 11 == 0))
    return rows.select("doc_id", "line_no", "script", routing.needs_second_pass(F.col("hyps"), F.col("script")).alias("second_pass"), routing.needs_verifier(F.col("hyps"), F.col("script"), F.lit(False)).alias("verify"))


@query(f"""WITH {E.CANDIDATES},
a AS (SELECT *, doc_id % 4 <> 3 AS enabled, CASE line_no % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'disagreement' ELSE 'illegible' END AS status, CASE WHEN doc_id % 7 = 6 THEN NULL ELSE CAST((doc_id + line_no) % 7 AS INT) END AS idx FROM cand),
b AS (SELECT *, CASE WHEN idx >= 0 AND idx < 5 THEN list_position([t0, t1, t2, t3, t4], [t0, t1, t2, t3, t4][idx + 1]) - 1 END AS place FROM a)
SELECT doc_id, line_no, CASE WHEN enabled AND status = 'supported' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS agreement, CASE WHEN enabled AND status <> 'supported' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS disagreement,
  CASE WHEN enabled AND status = 'supported' THEN CAST(place AS INT) END AS index, enabled AND status = 'illegible' AS reject_all, CASE WHEN NOT enabled THEN 'verifier_unavailable' WHEN idx IS NOT NULL AND idx >= 5 THEN 'invalid_selected_candidate_index' END AS note FROM b""")
def verifier_outcomes(spark, sf_dir):
    """What a verifier's answers are worth."""
    d, n = F.col("doc_id"), F.col("line_no")
    status = F.when(n % 3 == 0, "supported").when(n % 3 == 1, "disagreement").otherwise("illegible")
    index = F.when(d % 7 != 6, ((d + n) % 7).cast("int"))
    out = E.candidates(spark, sf_dir).select("doc_id", "line_no", routing.verifier_outcome(F.col("hyps"), d % 4 != 3, status, index).alias("x"))
    return out.select("doc_id", "line_no", "x.*")


# --- layout --------------------------------------------------------------------


def _ordered(spark, sf_dir):
    return layout.reading_order(E.boxes(spark, sf_dir), ["doc_id"], "line_no").withColumn("reading_order", F.col("reading_order").cast("long"))


_ORDERED = f"{E.BOXES}, ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y + h / 2, x, line_no) - 1 AS reading_order FROM boxes)"


@query(f"WITH {_ORDERED} SELECT doc_id, line_no, reading_order, region_type FROM ordered")
def reading_order(spark, sf_dir):
    return _ordered(spark, sf_dir).select("doc_id", "line_no", "reading_order", "region_type")


_BODY = "region_type IN ('main_handwriting', 'printed_text', 'table')"


@query(f"""WITH {_ORDERED},
e AS (SELECT doc_id, lag(line_no) OVER (PARTITION BY doc_id ORDER BY reading_order, line_no) AS "from", line_no AS "to", 'reading_order' AS relation FROM ordered),
m AS (SELECT doc_id, line_no AS "from", first_value(CASE WHEN {_BODY} THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY reading_order, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "to", 'margin_to_body' AS relation, region_type FROM ordered)
SELECT * FROM e WHERE "from" IS NOT NULL UNION ALL SELECT doc_id, "from", "to", relation FROM m WHERE region_type = 'margin_note' AND "to" IS NOT NULL""")
def result_graph(spark, sf_dir):
    """Edges of each page: reading order, and margin notes to their body."""
    rows = _ordered(spark, sf_dir)
    return layout.order_edges(rows, ["doc_id"], "line_no").unionByName(layout.margin_links(rows, ["doc_id"], "line_no").where(F.col("to").isNotNull()))


@query(f"""WITH {_ORDERED},
p AS (SELECT a.doc_id, a.line_no AS "from", b.line_no AS "to", row_number() OVER (PARTITION BY a.doc_id, a.line_no ORDER BY abs((b.y + b.h / 2) - (a.y + a.h / 2)), b.reading_order) AS n
  FROM ordered a JOIN ordered b ON a.doc_id = b.doc_id AND b.region_type <> 'margin_note' WHERE a.region_type = 'margin_note')
SELECT a.doc_id, a.line_no AS "from", p."to" FROM ordered a LEFT JOIN p ON p.doc_id = a.doc_id AND p."from" = a.line_no AND p.n = 1 WHERE a.region_type = 'margin_note'""")
def nearest_body(spark, sf_dir):
    """Margin notes with the body line at the nearest height."""
    return layout.nearest_body(_ordered(spark, sf_dir), ["doc_id"], "line_no")


_HINT_BOXES = ((0.05, 0.0, 0.6, 0.25), (0.3, 0.2, 0.95, 0.6), (0.0, 0.0, 1.0, 1.0), (0.1, 0.55, 0.5, 0.95))


def _sql_iou(hint) -> str:
    x0, y0, x1, y1 = hint
    hx0, hy0, hx1, hy1 = (f"({v}::DOUBLE * {s})" for v, s in ((x0, E.PAGE_W), (y0, E.PAGE_H), (x1, E.PAGE_W), (y1, E.PAGE_H)))
    inter = f"(greatest(0.0::DOUBLE, least({hx1}, x + w) - greatest({hx0}, x)) * greatest(0.0::DOUBLE, least({hy1}, y + h) - greatest({hy0}, y)))"
    return f"(CASE WHEN {inter} <= 0 THEN 0.0::DOUBLE ELSE {inter} / (greatest(1.0::DOUBLE, ({hx1} - {hx0}) * ({hy1} - {hy0})) + greatest(1.0::DOUBLE, w * h) - {inter}) END)"


_IOUS = [_sql_iou(h) for h in _HINT_BOXES]


@query(f"""WITH {E.BOXES}, i AS (SELECT doc_id, line_no, {", ".join(f"{x} AS i{k}" for k, x in enumerate(_IOUS))} FROM boxes)
SELECT doc_id, line_no, CASE WHEN greatest(i0, i1, i3) >= 0.25 THEN round(greatest(i0, i1, i3), 9) END AS iou, CAST(CASE WHEN greatest(i0, i1, i3) < 0.25 THEN NULL WHEN i0 >= i1 AND i0 >= i3 THEN 0 WHEN i1 >= i3 THEN 1 ELSE 3 END AS INT) AS hint FROM i""")
def layout_iou(spark, sf_dir):
    """The layout hint that overlaps each box most; a page-wide hint does not count."""
    hints = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in h]).alias("box"), F.lit("printed_text").alias("region_type")) for h in _HINT_BOXES])
    best = layout.best_hint(F.col("bbox"), hints, F.lit(E.PAGE_W), F.lit(E.PAGE_H))
    return E.boxes(spark, sf_dir).select("doc_id", "line_no", r(best["iou"]).alias("iou"), (-best["o"]).cast("int").alias("hint"))


@query(f"""WITH {E.BOXES}, c AS (SELECT *, CAST((doc_id + line_no) % 5 AS INT) AS bands, CAST((doc_id * 3 + line_no) % 100 AS DOUBLE) / 5000 AS ink, w * h / ({E.PAGE_W} * {E.PAGE_H}) AS area, h / {E.PAGE_H} AS tall, w / greatest(h, 1.0::DOUBLE) AS aspect FROM boxes),
f AS (SELECT doc_id, line_no, list_filter([CASE WHEN area > 0.22 THEN 'excessive_area' END, CASE WHEN tall > 0.18 THEN 'excessive_height' END, CASE WHEN h > 140 AND aspect < 2.0 THEN 'tall_box' END, CASE WHEN aspect < 0.55 AND h > 40 THEN 'implausible_aspect' END,
  CASE WHEN h < 8 OR w < 12 THEN 'too_tiny' END, CASE WHEN ink < 0.004 THEN 'low_ink' END, CASE WHEN bands > 2 THEN 'multi_line_projection' END, CASE WHEN 80.0::DOUBLE / h > 3.5 THEN 'destructive_upscale' END], lambda v: v IS NOT NULL) AS flags FROM c)
SELECT doc_id, line_no, NOT list_has_any(flags, ['excessive_area', 'excessive_height', 'tall_box', 'multi_line_projection', 'implausible_aspect', 'too_tiny', 'low_ink', 'destructive_upscale']) AS ok,
  CASE WHEN len(flags) = 0 THEN 'valid_line' ELSE array_to_string(flags, ',') END AS reason, list_has_any(flags, ['excessive_area', 'excessive_height', 'tall_box', 'multi_line_projection', 'implausible_aspect']) AS needs_split,
  list_has_any(flags, ['excessive_area', 'excessive_height', 'multi_line_projection', 'destructive_upscale']) AS blocked FROM f""")
def box_checks(spark, sf_dir):
    """Geometry checks of every box."""
    d, n, b = F.col("doc_id"), F.col("line_no"), F.col("bbox")
    check = G.check_box(b, F.lit(E.PAGE_W), F.lit(E.PAGE_H), ((d * 3 + n) % 100) / F.lit(5000.0), (d + n) % 5, b["height"])
    return E.boxes(spark, sf_dir).select("doc_id", "line_no", check.alias("c")).select("doc_id", "line_no", "c.ok", "c.reason", "c.needs_split", "c.blocked")


@query(f"WITH {_ORDERED} SELECT doc_id, arg_max(line_no, reading_order) AS line FROM ordered WHERE 150 BETWEEN x AND x + w AND 300 BETWEEN y AND y + h GROUP BY doc_id")
def hit_test(spark, sf_dir):
    """The line under a point of each page."""
    return layout.hit(_ordered(spark, sf_dir), 150.0, 300.0, ["doc_id"], "line_no")


# --- integrity -------------------------------------------------------------------


def _inspected(spark, sf_dir):
    return integrity.inspect(E.cases(spark, sf_dir))


_ISSUES = f"""{E.CASES},
x AS (SELECT *, coalesce(image_sha256, '') <> '' AND (regexp_matches(image_name, '(?i)(placeholder|synthetic|opencv.?font|lorem|dummy)') OR regexp_matches(id, '(?i)(placeholder|synthetic|opencv.?font|lorem|dummy)')) AS ph, split = 'qualification' AS q, coalesce(is_synthetic, false) AS sy, lower(coalesce(ground_truth, '') || chr(10) || notes) AS blob FROM cases),
inspected AS (SELECT *, list_filter([CASE WHEN q AND coalesce(source, '') = '' THEN 'missing_source' END, CASE WHEN q AND script IS NULL THEN 'missing_script' END, CASE WHEN q AND len(tags) = 0 THEN 'missing_difficulty_or_tags' END, CASE WHEN q AND is_synthetic IS NULL THEN 'missing_is_synthetic' END,
  CASE WHEN coalesce(image_sha256, '') = '' THEN 'missing_image' END, CASE WHEN ph THEN 'placeholder_name' END, CASE WHEN ph AND NOT sy THEN 'placeholder_not_marked_synthetic' END, CASE WHEN NOT regexp_matches(coalesce(ground_truth, ''), '\\S') THEN 'missing_or_empty_ground_truth' END,
  CASE WHEN needs_gt_review THEN 'needs_gt_review' END, CASE WHEN q AND sy THEN 'synthetic_in_qualification' END, CASE WHEN contains(blob, 'generated from ocr') OR contains(blob, 'ocr output as gt') OR (contains(blob, 'auto-transcribed') AND NOT contains(blob, 'human')) THEN 'gt_appears_ocr_generated' END], lambda v: v IS NOT NULL) AS issues FROM x)"""


@query(f"WITH {_ISSUES} SELECT id, array_to_string(issues, ',') AS issues FROM inspected")
def case_issues(spark, sf_dir):
    """What is wrong with each case."""
    return _inspected(spark, sf_dir).select("id", F.array_join("issues", ",").alias("issues"))


@query(f"WITH {_ISSUES} SELECT image_sha256, count(*) AS n, string_agg(split || ':' || id, ',' ORDER BY split || ':' || id) AS cases FROM inspected WHERE coalesce(image_sha256, '') <> '' GROUP BY 1 HAVING count(*) > 1")
def dup_groups(spark, sf_dir):
    """Cases with the same image."""
    return integrity.duplicate_groups(_inspected(spark, sf_dir), "image_sha256").withColumn("cases", F.array_join("cases", ","))


@query(f"WITH {_ISSUES} SELECT sha256({E.sql_norm('ground_truth')}) AS gt_sha256, count(*) AS n, string_agg(split || ':' || id, ',' ORDER BY split || ':' || id) AS cases FROM inspected WHERE regexp_matches(ground_truth, '\\S') GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT id) > 1")
def gt_dup_groups(spark, sf_dir):
    """Different cases with the same reference."""
    return integrity.duplicate_groups(_inspected(spark, sf_dir), "gt_sha256", True).withColumn("cases", F.array_join("cases", ","))


@query(f"WITH {_ISSUES} SELECT image_sha256, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, string_agg(split || ':' || id, ',' ORDER BY split || ':' || id) AS cases FROM inspected WHERE coalesce(image_sha256, '') <> '' GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_leaks(spark, sf_dir):
    """Images that several splits hold."""
    return integrity.split_leaks(_inspected(spark, sf_dir)).withColumns({"splits": F.array_join("splits", ","), "cases": F.array_join("cases", ",")})


@query(f"WITH {_ISSUES} SELECT split, count(*) AS n, count(*) FILTER (NOT sy) AS real, count(*) FILTER (sy) AS synthetic, count(*) FILTER (regexp_matches(ground_truth, '\\S')) AS with_gt, count(*) FILTER (list_contains(tags, 'extreme')) AS extreme, count(*) FILTER (list_contains(issues, 'placeholder_name')) AS placeholder FROM inspected GROUP BY split")
def split_counts(spark, sf_dir):
    return integrity.split_counts(_inspected(spark, sf_dir))


@query(f"""WITH {_ISSUES},
q1 AS (SELECT count(*) FILTER (NOT bad) AS eligible, count(*) FILTER (bad) AS unfit FROM (SELECT len(issues) > 0 OR sy OR needs_gt_review AS bad FROM inspected WHERE q)),
d AS (SELECT count(*) AS duplicates FROM (SELECT image_sha256 FROM inspected WHERE coalesce(image_sha256, '') <> '' GROUP BY 1 HAVING count(*) > 1 AND bool_or(q))),
l AS (SELECT count(*) AS leaks FROM (SELECT image_sha256 FROM inspected WHERE coalesce(image_sha256, '') <> '' GROUP BY 1 HAVING count(DISTINCT split) > 1 AND bool_or(q)))
SELECT eligible, unfit, duplicates, leaks, CAST(unfit + duplicates + leaks + CASE WHEN eligible < 15 THEN 1 ELSE 0 END AS BIGINT) AS failures,
  CASE WHEN unfit + duplicates + leaks = 0 AND eligible >= 15 THEN 'QUALIFIED_FOR_INTERNAL_EVALUATION' ELSE 'NOT_READY_DATASET' END AS decision FROM q1, d, l""")
def qualification_gate(spark, sf_dir):
    """Whether the qualification split may be used."""
    return integrity.gate(_inspected(spark, sf_dir))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'loading' WHEN 'click' THEN 'recognition' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'queued' END AS stage, count(*) AS n FROM events GROUP BY 1, 2""")
def job_stage_counts(spark, sf_dir):
    """Events per day and stage; the streaming twin is :func:`quillstone.streaming.jobs.stage_counts`."""
    e = E.table(spark, sf_dir, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), jobs.stage_of(F.col("event_type")).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


# --- smaller views ---------------------------------------------------------------


@query(f"""WITH {_JUDGED},
p AS (SELECT lang, source, correct, row_number() OVER (PARTITION BY lang, source ORDER BY confidence DESC, doc_id, line_no) AS rank, count(*) OVER (PARTITION BY lang, source) AS of_ FROM marked),
q AS (SELECT p.*, c.coverage, least(of_, greatest(1, CAST(round_even(c.coverage * of_, 0) AS BIGINT))) AS k FROM p, (SELECT unnest([0.25::DOUBLE, 0.5, 0.75, 1.0]) AS coverage) c),
s AS (SELECT lang, source, coverage, CAST(count(*) FILTER (NOT correct) AS DOUBLE) / max(k) AS fce, CAST(count(*) FILTER (correct) AS DOUBLE) / max(k) AS acc FROM q WHERE rank <= k GROUP BY lang, source, coverage)
SELECT lang, coverage, round(avg(fce), 9) AS fce, round(avg(acc), 9) AS accepted_accuracy, count(*) AS cases FROM s GROUP BY lang, coverage""")
def mean_risk_coverage(spark, sf_dir):
    """Mean curves per language over sources."""
    curves = metrics.risk_coverage(judged(spark, sf_dir), ["lang", "source"], ["doc_id", "line_no"])
    out = metrics.mean_risk_coverage(curves, ("lang",))
    return out.withColumns({"fce": r(F.col("fce")), "accepted_accuracy": r(F.col("accepted_accuracy"))})


@query(f"WITH {E.CANDIDATES}, s AS (SELECT doc_id, CASE WHEN (doc_id + line_no) % 3 = 0 THEN 'print' ELSE 'handwriting' END AS script FROM cand), g AS (SELECT doc_id, round(CAST(count(*) FILTER (script = 'print') AS DOUBLE) / count(*), 9) AS print_ratio, count(*) AS lines FROM s GROUP BY doc_id) SELECT *, CASE WHEN print_ratio >= 0.6 THEN 'other' ELSE 'handwritten_note' END AS category FROM g")
def page_categories(spark, sf_dir):
    """Print share of each page and the category guessed from it."""
    rows = E.lines(spark, sf_dir).withColumn("script_mode", F.when((F.col("doc_id") + F.col("line_no")) % 3 == 0, "print").otherwise("handwriting"))
    out = results.print_ratio(rows, ["doc_id"]).withColumn("print_ratio", r(F.col("print_ratio")))
    return out.withColumn("category", G.heuristic_category(F.col("print_ratio"), F.col("lines"))["category"])


@query("""WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'RX' WHEN 1 THEN 'Lab Report' WHEN 2 THEN 'flow-chart' ELSE 'strange' END AS c FROM documents WHERE doc_id % 5 <> 4)
SELECT doc_id, CASE c WHEN 'RX' THEN 'prescription' WHEN 'Lab Report' THEN 'lab_report' WHEN 'flow-chart' THEN 'flowchart' ELSE 'unknown' END AS category, CAST(doc_id % 3 AS INT) AS items, (doc_id % 10) / 10.0::DOUBLE AS confidence FROM p""")
def page_replies(spark, sf_dir):
    """Page readers' replies, salvaged and typed."""
    d = F.col("doc_id")
    name = F.when(d % 4 == 0, "RX").when(d % 4 == 1, "Lab Report").when(d % 4 == 2, "flow-chart").otherwise("strange")
    items = F.array_join(F.transform(F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), (d % 3).cast("int")), lambda i: F.concat(F.lit('{"text": "t'), i.cast("string"), F.lit('"}'))), ",")
    text = F.concat(F.lit('Sure! {"category": "'), name, F.lit('", "category_confidence": '), ((d % 10) / 10).cast("string"), F.lit(', "extra": 1, "line_items": ['), items, F.lit("]} hope it helps"))
    rows = E.table(spark, sf_dir, "documents").select("doc_id", T.parse_reply(F.when(d % 5 == 4, "no answer").otherwise(text)).alias("x")).where(F.col("x").isNotNull())
    return rows.select("doc_id", G.parse_category(F.col("x.category")).alias("category"), F.size("x.line_items").alias("items"), F.col("x.category_confidence").alias("confidence"))


@query(f"""WITH {E.CANDIDATES}, a AS (SELECT doc_id, line_no, ref, t0, CASE WHEN doc_id % 3 = 0 THEN t0 WHEN doc_id % 3 = 1 THEN t1 ELSE t3 END AS proxy FROM cand)
SELECT doc_id, round(avg({E.sql_cer("ref", "proxy")}), 9) AS proxy_cer, count(*) AS n FROM a GROUP BY doc_id""")
def proxy_baseline(spark, sf_dir):
    """The last alternative as a stand-in for a plain engine."""
    d = F.col("doc_id")
    alts = F.when(d % 3 == 0, F.array().cast("array<string>")).when(d % 3 == 1, F.array(F.col("hyps")[2]["text"], F.col("hyps")[1]["text"])).otherwise(F.array(F.col("hyps")[3]["text"]))
    rows = E.candidates(spark, sf_dir).select("doc_id", "ref", metrics.proxy_text(alts, F.col("hyps")[0]["text"]).alias("proxy"))
    return rows.groupBy("doc_id").agg(r(F.avg(T.cer(F.col("ref"), F.col("proxy")))).alias("proxy_cer"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_JUDGED} SELECT doc_id, line_no, hypothesis, confidence FROM marked WHERE fce ORDER BY confidence DESC, ref, doc_id, line_no LIMIT 20")
def failure_report(spark, sf_dir):
    """The twenty most confident errors: a top-k report."""
    rows = metrics.failure_cases(judged(spark, sf_dir), ["doc_id", "line_no"])
    return rows.select("doc_id", "line_no", "hypothesis", "confidence")


@query(f"WITH {E.WORDS} SELECT doc_id, string_agg(CASE WHEN decision_state = 'CROSSED_OUT' THEN '~~' || hypothesis || '~~' WHEN decision_state = 'ILLEGIBLE' THEN '**[ILLEGIBLE]**' WHEN decision_state = 'REVIEW_REQUIRED' THEN '==' || hypothesis || '==' ELSE hypothesis END, chr(10) ORDER BY line_no) AS panel FROM words GROUP BY doc_id")
def panel_text(spark, sf_dir):
    """The short form of each document that a panel shows."""
    line = results.panel_line(F.col("decision_state"), F.col("text"))
    return _md_words(spark, sf_dir).groupBy("doc_id").agg(T.joined(line, F.col("line_no")).alias("panel"))


# the rest of the registry
from quillstone.plans import more  # noqa: E402, F401
