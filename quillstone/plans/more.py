"""Further queries of the registry: views, boundaries and pixels, each with its SQL.

Images are made in the queries from closed forms, so that SQL can work out
every pixel; models are small stand-ins with known answers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.config import DecisionThresholds
from quillstone.functions import geometry as G
from quillstone.functions import text as T
from quillstone.operators import imaging, integrity, layout, metrics, providers, reports, results, routing, store, understanding
from quillstone.plans import evidence as E
from quillstone.plans.catalog import _CLAIMS, _HINT_BOXES, _IOUS, _ISSUES, _JUDGED, _MEANS, _ORDERED, _SCORED, _inspected, _ordered, _per_case, judged, query, r
from quillstone.sources import files


def documents(spark, sf_dir):
    """Documents, over all cores: what follows is work for pixels."""
    docs = E.table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if len(docs.inputFiles()) < cores else docs


# --- views ---------------------------------------------------------------------


@query(f"WITH {E.WORDS} SELECT word_id AS id, line_no AS reading_order, hypothesis AS text FROM words WHERE doc_id = 3")
def listed_words(spark, sf_dir):
    """The words of one document in their order: a lookup by a parent's key."""
    words = E.words(spark, sf_dir).select(F.col("word_id").alias("id"), "doc_id", F.col("line_no").alias("reading_order"), F.col("hypothesis").alias("text"))
    return results.listed(words, "doc_id", 3, ["reading_order"]).drop("doc_id")


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id = 7")
def one_document(spark, sf_dir):
    """A document by its key."""
    return results.lookup(E.table(spark, sf_dir, "documents"), "doc_id", 7).select("doc_id", "source", "lang")


@query(f"WITH {E.WORDS} SELECT word_id, decision_state = 'CROSSED_OUT' AS struck, hypothesis AS text FROM words WHERE (doc_id + line_no) % 2 = 0")
def page_words(spark, sf_dir):
    """The words of every document's even page, active ones and crossed-out ones told apart."""
    rows = E.words(spark, sf_dir).withColumn("page", (F.col("doc_id") + F.col("line_no")) % 2)
    page = results.lookup(rows, "page", 0)
    cols = ["word_id", "struck", F.col("hypothesis").alias("text")]
    return results.active(page).withColumn("struck", F.lit(False)).select(*cols).unionByName(results.crossed_out(page).withColumn("struck", F.lit(True)).select(*cols))


@query(f"""WITH {_ORDERED},
h AS (SELECT doc_id, line_no, i AS rank, CASE i WHEN 1 THEN ref WHEN 2 THEN upper(replace(ref, 'ß', 'SS')) END AS text, {E.sql_visual('i - 1')} AS v FROM lines, (SELECT unnest([1, 2]) AS i) WHERE (doc_id + line_no) % 5 <> 0),
p AS (SELECT doc_id, line_no, string_agg(rank || '=' || text, ';' ORDER BY rank) AS hs FROM h GROUP BY doc_id, line_no),
l AS (SELECT o.doc_id, o.reading_order, o.reading_order || '/' || o.line_no || '/' || region_type || '/' || coalesce(hs, '') AS x FROM ordered o LEFT JOIN p ON p.doc_id = o.doc_id AND p.line_no = o.line_no)
SELECT d.doc_id, md5(coalesce(string_agg(x, chr(10) ORDER BY reading_order), '')) AS page, count(x) AS lines FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id GROUP BY d.doc_id""")
def assembled_pages(spark, sf_dir):
    """Pages with their lines, each with its region and hypotheses, as a digest."""
    key = F.concat_ws("-", "doc_id", "line_no")
    lines = _ordered(spark, sf_dir).select(key.alias("id"), F.col("doc_id").alias("page_id"), "reading_order", "region_type")
    d, n = F.col("doc_id"), F.col("line_no")
    ref = E.lines(spark, sf_dir).where((d + n) % 5 != 0)
    read = ref.select(key.alias("line_id"), F.explode(F.array(*[F.struct(F.lit(i + 1).alias("rank"), E.corrupted(k).alias("text"), E.visual(i).alias("visual_score"), F.lit(E.HAND).alias("model_name")) for i, k in enumerate((0, 3))])).alias("h")).select("line_id", "h.*")
    pages = E.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    out = results.assemble(pages, lines, read)
    shown = F.transform(F.coalesce("lines", F.array()), lambda x: F.concat_ws("/", x["reading_order"], F.element_at(F.split(x["id"], "-"), -1), x["region_type"], F.array_join(F.transform(x["hypotheses"], lambda h: F.concat_ws("=", h["rank"], h["text"])), ";")))
    return out.select(F.col("id").alias("doc_id"), F.md5(F.array_join(shown, "\n").cast("binary")).alias("page"), F.size(F.coalesce("lines", F.array())).cast("long").alias("lines"))


@query("""WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN [] WHEN 1 THEN [role || turn] ELSE [role || turn, 'x' || conv_id] END AS items FROM conversations),
m AS (SELECT conv_id, flatten(list(items ORDER BY turn)) AS items FROM t GROUP BY conv_id)
SELECT conv_id, array_to_string(items, ',') AS reader, array_to_string(list_concat(items, ['w' || conv_id]), ',') AS merged, CASE WHEN len(items) > 0 THEN array_to_string(list_transform(items, lambda i: i || ':other'), ',') ELSE 'w' || conv_id || ':main' END AS shown FROM m""")
def merged_items(spark, sf_dir):
    """Items of a document's pages as one list, with the recognised ones behind, and the list that is shown."""
    c = E.table(spark, sf_dir, "conversations")
    own, extra = F.concat(F.col("role"), F.col("turn").cast("string")), F.concat(F.lit("x"), F.col("conv_id").cast("string"))
    items = F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).when(F.col("turn") % 3 == 1, F.array(own)).otherwise(F.array(own, extra))
    rows = results.merge_pages(c.select("conv_id", "turn", items.alias("items")), ["conv_id"], "items", "turn")
    word = F.concat(F.lit("w"), F.col("conv_id").cast("string"))
    item = lambda text, category: F.struct(text.alias("text"), F.lit(category).cast("string").alias("category"), F.lit(0.5).alias("confidence"))
    shown = results.line_items(F.transform("items", lambda t: item(t, None)), F.array(item(word, "main")))
    return rows.select(
        "conv_id", F.array_join("items", ",").alias("reader"), F.array_join(results.merge_inventories(F.col("items"), F.array(word)), ",").alias("merged"),
        F.array_join(F.transform(shown, lambda i: F.concat_ws(":", i["text"], i["category"])), ",").alias("shown"),
    )


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'unknown: low' WHEN 1 THEN 'table: low|unknown: top' ELSE '' END AS summary FROM documents")
def layout_summaries(spark, sf_dir):
    """What a page reader says of a page's regions, in a line each."""
    hint = lambda region, text: F.struct(F.lit(region).cast("string").alias("region_type"), F.lit(text).alias("description"))
    d = F.col("doc_id")
    hints = F.when(d % 3 == 0, F.array(hint(None, "low"))).when(d % 3 == 1, F.array(hint("table", "low"), hint(None, "top"))).otherwise(F.slice(F.array(hint("table", "x")), 1, 0))
    return E.table(spark, sf_dir, "documents").select("doc_id", F.array_join(results.layout_summary(hints), "|").alias("summary"))


@query("SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY source, lang")
def first_documents(spark, sf_dir):
    """The first document of each source and language."""
    return results.first_of_each(E.table(spark, sf_dir, "documents"), ["source", "lang"], ["doc_id"]).select("source", "lang", "doc_id")


@query(f"""WITH {E.WORDS},
i AS (SELECT word_id || CASE WHEN line_no % 4 = 3 THEN '?' ELSE '' END AS id, 'item ' || word_id AS label, coalesce(CASE WHEN line_no % 5 <> 0 THEN (line_no % 10) / 10.0::DOUBLE END, 1.0::DOUBLE) < 0.72 AS low FROM words),
h AS (SELECT doc_id || '-' || line_no AS word_id, ref AS chosen FROM lines WHERE line_no % 2 = 0)
SELECT i.id, label, low, w.hypothesis AS text, h.chosen FROM i LEFT JOIN words w ON w.word_id = i.id LEFT JOIN h ON h.word_id = w.word_id""")
def item_words(spark, sf_dir):
    """Items with the word that they name and that word's selected hypothesis, and whether a reader should look at them."""
    words = E.words(spark, sf_dir)
    n = F.col("line_no")
    items = words.select(F.concat("word_id", F.when(n % 4 == 3, "?").otherwise("")).alias("id"), F.concat(F.lit("item "), "word_id").alias("label"), F.when(n % 5 != 0, (n % 10) / F.lit(10.0)).alias("confidence"))
    low = results.low_confidence_items(items).select(F.col("id").alias("low_id"))
    chosen = E.lines(spark, sf_dir).where(n % 2 == 0).select(F.concat_ws("-", "doc_id", "line_no").alias("h_id"), F.col("ref").alias("chosen"))
    rows = items.join(low, F.col("id") == F.col("low_id"), "left").join(words.select("word_id", F.col("hypothesis").alias("text")), F.col("id") == F.col("word_id"), "left")
    return rows.join(chosen, F.col("word_id") == F.col("h_id"), "left").select("id", "label", F.col("low_id").isNotNull().alias("low"), "text", "chosen")


@query(f"""WITH RECURSIVE a AS (SELECT doc_id AS id, CASE WHEN doc_id % 23 > 0 THEN doc_id - 1 WHEN doc_id % 2 = 1 THEN -5 END AS source FROM documents),
up AS (SELECT id, id AS root, 0::BIGINT AS steps FROM a UNION ALL SELECT up.id, p.id, steps + 1 FROM up JOIN a ON a.id = up.root JOIN a p ON p.id = a.source)
SELECT id, arg_max(root, steps) AS root, max(steps) AS steps FROM up GROUP BY id""")
def artifact_lineage(spark, sf_dir):
    """Each artifact with the one that it was made from in the first place."""
    d = F.col("doc_id")
    rows = E.table(spark, sf_dir, "documents").select(d.alias("id"), F.when(d % 23 > 0, d - 1).when(d % 2 == 1, F.lit(-5)).alias("source_artifact_id"))
    return store.lineage(rows)


@query("""SELECT doc_id, sha2 AS sha256, name, coalesce(source_id, '') AS source FROM (SELECT doc_id, sha256(coalesce(text, '')) AS sha2, CASE WHEN doc_id % 2 = 0 THEN 'clahe' ELSE '' END AS name, CASE WHEN doc_id % 3 = 0 THEN 'a' || doc_id END AS source_id FROM documents)""")
def artifact_provenance(spark, sf_dir):
    """The headers that an artifact is served with."""
    d = F.col("doc_id")
    rows = E.table(spark, sf_dir, "documents").select(d.alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.when(d % 2 == 0, "clahe").alias("transformation_name"), F.when(d % 3 == 0, F.concat(F.lit("a"), d.cast("string"))).alias("source_artifact_id"))
    h = F.col("headers")
    return results.artifact_headers(rows).select(F.col("id").alias("doc_id"), h["X-Artifact-Sha256"].alias("sha256"), h["X-Artifact-Transformation"].alias("name"), h["X-Artifact-Source"].alias("source"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, ts, '{"stage":"' || event_type || '","user":' || user_id || '}' AS payload FROM events)
SELECT event_id, user_id AS document_id, 'stage_changed' AS event_type, payload, substr(sha256(user_id || chr(31) || 'stage_changed' || chr(31) || payload || chr(31) || event_id), 1, 32) AS id FROM e""")
def audit_events(spark, sf_dir):
    """Audit rows of stage changes, with ids that a rerun gives again."""
    e = E.table(spark, sf_dir, "events")
    cols = results.audit_event(F.col("user_id"), "stage_changed", F.struct(F.col("event_type").alias("stage"), F.col("user_id").alias("user")), F.col("event_id"))
    return e.select("event_id", *cols).drop("created_at")


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'scan_1_.png' WHEN 1 THEN 'a.b.PDF' WHEN 2 THEN 'x.gif' WHEN 3 THEN 'photo' WHEN 4 THEN 'r_sum_.JPeG' ELSE 'c.jpg' END AS filename,
  CASE doc_id % 6 WHEN 0 THEN 'image' WHEN 1 THEN 'pdf' WHEN 2 THEN 'image' WHEN 3 THEN 'pdf' ELSE 'image' END AS kind,
  CASE WHEN doc_id % 6 = 2 THEN 'unsupported_media_type' WHEN doc_id % 7 = 0 THEN 'empty_file' END AS problem FROM documents""")
def upload_gate(spark, sf_dir):
    """Which uploads are taken, and whether they are read as a PDF or an image."""
    d = F.col("doc_id")
    names = ("up/scan 1 .png", "C:\\x\\a.b.PDF", "x.gif", "photo", "dir/r\u00e9sum\u00e9.JPeG", "c.jpg")
    media = (None, None, "image/gif", "application/pdf", None, "image/jpeg")
    pick = lambda values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (d % 6).cast("int"))
    rows = E.table(spark, sf_dir, "documents").select("doc_id", T.file_name(pick(names)).alias("filename"), pick(media).alias("media"), F.when(d % 7 == 0, F.lit(b"")).otherwise(F.lit(b"x")).alias("content"))
    return files.gate(rows, "media").select("doc_id", "filename", files.page_kind(F.coalesce("media", F.lit("")), F.col("filename")).alias("kind"), "problem")


_TAG = "CASE doc_id % 3 WHEN 0 THEN ['hard'] WHEN 1 THEN ['form'] ELSE [] END"


@query(f"""WITH c AS (SELECT doc_id, source, text, CASE WHEN doc_id % 4 = 0 THEN 'extreme' WHEN doc_id % 4 = 1 THEN 'hard' END AS level, {_TAG} AS tags, doc_id % 5 = 0 AS syn FROM documents),
t AS (SELECT *, CASE WHEN level IS NOT NULL AND NOT list_contains(tags, level) THEN list_concat(tags, [level]) ELSE tags END AS all_tags FROM c)
SELECT 'case-' || doc_id AS id, doc_id || '.png' AS image, 'dev' AS split, array_to_string(all_tags, ',') AS tags FROM t WHERE regexp_matches(coalesce(text, ''), '\\S') AND NOT syn AND (list_contains(all_tags, 'hard') OR list_contains(all_tags, 'extreme'))""")
def manifest_cases(spark, sf_dir):
    """Cases of manifests, one a source, as objects and as bare lists; those with a reference, hard and not synthetic."""
    d = F.col("doc_id")
    tags = F.when(d % 3 == 0, F.array(F.lit("hard"))).when(d % 3 == 1, F.array(F.lit("form"))).otherwise(F.array().cast("array<string>"))
    case = F.struct(
        F.concat(F.lit("case-"), d.cast("string")).alias("id"), F.concat(d.cast("string"), F.lit(".png")).alias("image_path"), F.col("text").alias("ground_truth"),
        F.when(d % 4 == 0, "extreme").when(d % 4 == 1, "hard").alias("difficulty"), tags.alias("difficulty_tags"), (d % 5 == 0).alias("is_synthetic"),
    )
    lists = E.table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_list(case).alias("cases"))
    texts = lists.select(F.when(F.ascii("source") % 2 == 0, F.to_json("cases")).otherwise(F.to_json(F.struct("cases"))).alias("value"))
    cases = files.select_cases(files.parse_manifests(texts, "dev"), hard_only=True, allow_synthetic=False)
    return cases.select("id", "image", "split", F.array_join("tags", ",").alias("tags"))


@query("""WITH c AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '/set/dev/in/' || doc_id || '.png' WHEN 1 THEN '/set/dev/images/' || doc_id || '.png' WHEN 2 THEN '/set/in/' || doc_id || '.png' WHEN 3 THEN 'in/' || doc_id || '.png' END AS path FROM documents)
SELECT 'case-' || doc_id AS id, coalesce(sha256(path), '') AS image_sha256, doc_id || '.png' AS image_name FROM c""")
def resolved_images(spark, sf_dir):
    """Cases with the digest of their image, wherever it lies."""
    d = F.col("doc_id")
    docs = E.table(spark, sf_dir, "documents")
    name = F.concat(d.cast("string"), F.lit(".png"))
    cases = docs.select(F.lit("dev").alias("split"), F.concat(F.lit("case-"), d.cast("string")).alias("id"), F.concat(F.lit("in/"), name).alias("image"))
    at = lambda place: F.concat(F.lit(place), name)
    path = F.when(d % 5 == 0, at("/set/dev/in/")).when(d % 5 == 1, at("/set/dev/images/")).when(d % 5 == 2, at("/set/in/")).when(d % 5 == 3, at("in/"))
    # a later place does not matter where an earlier one has a file
    listing = docs.select(path.alias("path")).where("path IS NOT NULL").unionByName(docs.where(d % 5 == 0).select(at("/set/in/").alias("path")))
    found = files.resolve_images(cases, listing.withColumn("sha256", F.sha2("path", 256)), "/set/dev")
    return found.select("id", "image_sha256", "image_name")


# --- evaluation ------------------------------------------------------------------


@query(f"WITH {_SCORED} SELECT system, count(*) AS n, {', '.join(f'round(avg({m}), 9) AS mean_{m}' for m in _MEANS)} FROM per_case WHERE doc_id % 7 <> 0 GROUP BY system")
def real_means(spark, sf_dir):
    """Means per system over the cases that are not synthetic."""
    rows = _per_case(spark, sf_dir).withColumn("is_synthetic", F.col("doc_id") % 7 == 0)
    out = metrics.mean_by_system(rows.where(~F.col("is_synthetic")), list(_MEANS))
    return out.select("system", "n", *[r(F.col(f"mean_{m}")).alias(f"mean_{m}") for m in _MEANS])


@query(f"""WITH {E.CANDIDATES}, s AS (SELECT *, CASE WHEN line_no % 6 = 5 THEN ' ' ELSE ref END AS txt FROM cand)
SELECT doc_id, line_no, CASE WHEN trim(txt) <> '' THEN 'ACCEPTED' ELSE 'ILLEGIBLE' END AS print_only, CASE WHEN trim(txt) = '' THEN 'ILLEGIBLE' WHEN v0 >= 0.72 THEN 'ACCEPTED' WHEN v0 >= 0.55 THEN 'REVIEW_REQUIRED' ELSE 'ILLEGIBLE' END AS handwriting_lines FROM s""")
def independent_states(spark, sf_dir):
    """The states that stand-alone baselines give."""
    rows = E.candidates(spark, sf_dir)
    text = F.when(F.col("line_no") % 6 == 5, " ").otherwise(F.col("ref"))
    score = F.col("hyps")[0]["visual"]
    return rows.select("doc_id", "line_no", *[metrics.independent_state(s, score, text).alias(s) for s in ("print_only", "handwriting_lines")])


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'NOT_READY_DATASET' WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 'NOT_READY_EVALUATION' WHEN (doc_id % 10) / 10.0::DOUBLE < 0.5 AND (doc_id % 7) / 10.0::DOUBLE > 0.2 THEN 'NOT_READY_UNCERTAINTY'
  WHEN (doc_id % 11) / 20.0::DOUBLE > 0.25 THEN 'NOT_READY_ACCURACY' ELSE 'QUALIFIED_FOR_INTERNAL_EVALUATION' END AS decision FROM documents""")
def qualification_ladder(spark, sf_dir):
    """The decision over a data set's gate and a system's means."""
    d = F.col("doc_id")
    decision = F.when(d % 4 == 0, "NOT_READY_DATASET").otherwise("QUALIFIED_FOR_INTERNAL_EVALUATION")
    out = integrity.qualification(decision, d % 5 != 0, d % 3, (d % 10) / F.lit(10.0), (d % 7) / F.lit(10.0), (d % 11) / F.lit(20.0))
    return E.table(spark, sf_dir, "documents").select("doc_id", out.alias("decision"))


@query("SELECT * FROM (VALUES ('A', 'independent', false, false), ('B', 'derived', false, false), ('C', 'derived', false, false), ('D', 'system_under_test', true, false), ('E', 'system_under_test', true, true), ('F', 'system_under_test', true, true)) t(config, declared_kind, uses_fusion, uses_verifier)")
def experiments(spark, sf_dir):
    """What each configuration of the ablation uses."""
    return metrics.experiments(spark).drop("label")


_LIMITS = DecisionThresholds().as_numbers()


@query("""SELECT * FROM (VALUES ('accepted_min_score', 0.72::DOUBLE), ('accepted_max_uncertainty', 0.28), ('review_max_uncertainty', 0.62), ('illegible_min_visual', 0.28), ('consensus_min_support', 1), ('high_risk_accepted_min_score', 0.82),
  ('high_risk_max_uncertainty', 0.22), ('max_ensemble_disagreement_accept', 0.4), ('max_cross_model_accept', 0.35), ('min_variant_agreement_accept', 0.5), ('crossed_out_threshold', 0.55), ('require_trocr_for_accepted', 1)) t(name, value)""")
def thresholds(spark, sf_dir):
    """The limits that a decision is recorded with."""
    return spark.createDataFrame(list(_LIMITS.items()), "name string, value double")


_COMPOSITION = """comp AS (SELECT count(*) AS total, count(*) FILTER (NOT sy) AS real, count(*) FILTER (sy) AS synthetic, count(*) FILTER (list_contains(tags, 'extreme')) AS extreme, count(*) FILTER (NOT regexp_matches(coalesce(ground_truth, ''), '\\S')) AS missing_truth,
  count(*) FILTER (list_contains(issues, 'placeholder_name')) AS placeholder FROM inspected),
img AS (SELECT image_sha256, string_agg(split || ':' || id, ', ' ORDER BY split || ':' || id) AS cases, count(DISTINCT split) AS splits, bool_or(q) AS any_q FROM inspected WHERE coalesce(image_sha256, '') <> '' GROUP BY 1 HAVING count(*) > 1),
gt AS (SELECT 1 FROM inspected WHERE regexp_matches(ground_truth, '\\S') GROUP BY sha256(trim(regexp_replace(lower(ground_truth), '\\s+', ' ', 'g'))) HAVING count(*) > 1 AND count(DISTINCT id) > 1),
groups AS (SELECT (SELECT count(*) FROM img) AS same_image, (SELECT count(*) FROM gt) AS same_truth, (SELECT count(*) FROM img WHERE splits > 1) AS leaks),
q1 AS (SELECT count(*) FILTER (NOT bad) AS eligible, count(*) FILTER (bad) AS unfit FROM (SELECT len(issues) > 0 OR sy OR needs_gt_review AS bad FROM inspected WHERE q)),
gate AS (SELECT eligible, unfit + (SELECT count(*) FROM img WHERE any_q) + (SELECT count(*) FROM img WHERE splits > 1 AND any_q) + CASE WHEN eligible < 15 THEN 1 ELSE 0 END AS failures FROM q1),
gated AS (SELECT *, CASE WHEN failures = 0 THEN 'QUALIFIED_FOR_INTERNAL_EVALUATION' ELSE 'NOT_READY_DATASET' END AS decision FROM gate)"""


def _sql_facts(section: int, source: str, *lines: str) -> str:
    return " UNION ALL ".join(f"SELECT {section}, {i}, {x} FROM {source}" for i, x in enumerate(lines))


@query(f"""WITH {_ISSUES}, {_COMPOSITION},
report(section, ordinal, line) AS ({_sql_facts(0, "comp, groups", "'# Data set'", "'- cases: ' || total", "'- real: ' || real", "'- synthetic: ' || synthetic", "'- extreme: ' || extreme", "'- without reference: ' || missing_truth", "'- placeholder names: ' || placeholder", "'- groups with one image: ' || same_image", "'- groups with one reference: ' || same_truth", "'- images in several splits: ' || leaks")}
  UNION ALL {_sql_facts(1, "gated", "'- eligible: ' || eligible", "'- failures: ' || failures", "'- decision: ' || decision")}
  UNION ALL SELECT 2, row_number() OVER (ORDER BY split) + 99, '- ' || split || ': ' || count(*) || ' cases, ' || count(*) FILTER (NOT sy) || ' real, ' || count(*) FILTER (regexp_matches(ground_truth, '\\S')) || ' with reference' FROM inspected GROUP BY split
  UNION ALL SELECT 3, row_number() OVER (ORDER BY image_sha256) + 99, '- leak: ' || cases FROM img WHERE splits > 1)
SELECT CAST(section AS INT) AS section, CAST(ordinal AS INT) AS ordinal, line FROM report""")
def integrity_report(spark, sf_dir):
    """The report on a data set, line by line."""
    return reports.integrity_report(_inspected(spark, sf_dir))


_SCORES_SQL = _CLAIMS.replace(f"{E.LINES},", "", 1)


@query(f"""WITH {_ISSUES}, {_COMPOSITION}, {_JUDGED}, {_SCORES_SQL},
p AS (SELECT correct, row_number() OVER (ORDER BY confidence DESC, doc_id, line_no) AS rank, count(*) OVER () AS of_ FROM marked),
k AS (SELECT coverage, least((SELECT count(*) FROM marked), greatest(1, CAST(round_even(coverage * (SELECT count(*) FROM marked), 0) AS BIGINT))) AS k FROM (SELECT unnest([0.25::DOUBLE, 0.5, 0.75, 1.0]) AS coverage)),
curve AS (SELECT coverage, k, CAST(count(*) FILTER (NOT correct) AS DOUBLE) / k AS fce, CAST(count(*) FILTER (correct) AS DOUBLE) / k AS acc FROM k JOIN p ON p.rank <= k GROUP BY coverage, k),
mean AS (SELECT system, count(*) AS n, {", ".join(f"avg({m}) AS {m}" for m in reports.SHOWN)} FROM per_case GROUP BY system),
abl AS (SELECT config, CASE WHEN count(DISTINCT baseline_kind) > 1 THEN 'mixed:' || string_agg(DISTINCT baseline_kind, ',' ORDER BY baseline_kind) ELSE max(baseline_kind) END AS kind, avg(cer) AS cer, avg(fce_rate) AS fce, avg(coverage_accepted) AS cov
  FROM (SELECT p.*, unnest(CASE system WHEN 'print_only' THEN ['A'] WHEN 'handwriting_lines' THEN ['B'] WHEN 'handwriting_forced' THEN ['C'] ELSE ['D', 'E', 'F'] END) AS config FROM per_case p) GROUP BY config),
final AS (SELECT g.*, CASE WHEN decision = 'NOT_READY_DATASET' THEN 'NOT_READY_DATASET' WHEN f.n = 0 THEN 'NOT_READY_EVALUATION' WHEN f.accepted_accuracy < 0.5 AND f.fce_rate > 0.2 THEN 'NOT_READY_UNCERTAINTY' WHEN f.cer > 0.25 THEN 'NOT_READY_ACCURACY' ELSE 'QUALIFIED_FOR_INTERNAL_EVALUATION' END AS final FROM gated g, (SELECT * FROM mean WHERE system = 'fused') f),
report(section, ordinal, line) AS ({_sql_facts(0, "final", "'# Qualification'", "'- decision: ' || final", "'- evidence: ' || CASE WHEN final LIKE 'NOT_READY%' THEN 'preliminary, no evidence for qualification' ELSE final END", "'- eligible cases: ' || eligible", "'- required: 15'")}
  UNION ALL {_sql_facts(1, "comp", "'## Cases'", "'- all: ' || total", "'- real: ' || real", "'- extreme: ' || extreme")}
  UNION ALL SELECT 2, row_number() OVER (ORDER BY system) + 99, '| ' || system || ' | ' || n || ' | ' || {" || ' | ' || ".join(f"printf('%.3f', {m})" for m in reports.SHOWN)} || ' |' FROM mean
  UNION ALL SELECT 3, row_number() OVER (ORDER BY coverage) + 99, '| ' || printf('%.2f', coverage) || ' | ' || k || ' | ' || printf('%.3f', fce) || ' | ' || printf('%.3f', acc) || ' |' FROM curve
  UNION ALL SELECT 4, row_number() OVER (ORDER BY config) + 99, '| ' || config || ' | ' || kind || ' | ' || printf('%.3f', cer) || ' | ' || printf('%.3f', fce) || ' | ' || printf('%.3f', cov) || ' |' FROM abl
  UNION ALL {_sql_facts(5, "(SELECT count(*) FILTER (system = 'fused' AND accepted_accuracy = 0 AND coverage_accepted > 0) AS failing FROM per_case)", "'## Failures'", "'- cases with accepted lines, none of them right: ' || failing")}
  UNION ALL SELECT 6, ordinal + 100, '- ' || level || ': ' || claim FROM claims)
SELECT CAST(section AS INT) AS section, CAST(ordinal AS INT) AS ordinal, line FROM report""")
def qualification_report(spark, sf_dir):
    """The report on which a system would be qualified, line by line."""
    curves = metrics.risk_coverage(judged(spark, sf_dir).withColumn("all", F.lit(1)), ["all"], ["doc_id", "line_no"])
    systems = reports.by_system(_per_case(spark, sf_dir))
    return reports.qualification_report(_inspected(spark, sf_dir), systems, curves, integrity.claims(systems, n_cases=10, n_real=1, eligible=False))


@query("""SELECT CASE doc_id % 2 WHEN 0 THEN 'print_only' ELSE 'handwriting_lines' END AS system, doc_id AS case_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN 0.1::DOUBLE ELSE 0.4::DOUBLE END AS cer, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN 'independent' ELSE 'derived' END AS baseline_kind FROM documents""")
def baseline_fallback(spark, sf_dir):
    """Scores of baselines: of an independent run where it worked, else derived ones."""
    d = F.col("doc_id")
    rows = E.table(spark, sf_dir, "documents").select(F.when(d % 2 == 0, "print_only").otherwise("handwriting_lines").alias("system"), d.alias("case_id"))
    own = rows.where(F.col("case_id") % 3 == 0).withColumns({"cer": F.lit(0.1), "error": F.when(F.col("case_id") % 5 == 0, "no output")})
    return reports.choose_baselines(own, rows.withColumn("cer", F.lit(0.4)))


# --- routing, layout ---------------------------------------------------------------


@query(f"""WITH {E.CANDIDATES},
s AS (SELECT *, CASE WHEN (doc_id + line_no) % 2 = 0 THEN 'print' ELSE 'handwriting' END AS script, t4 AS pt, n4 AS pn, ((doc_id + line_no) % 20) / 20.0::DOUBLE AS ps,
  [{{'t': t0, 'n': n0, 'v': v0, 'f': false}}, {{'t': t1, 'n': n1, 'v': v1, 'f': false}}, {{'t': t2, 'n': n2, 'v': v2, 'f': false}}, {{'t': t3, 'n': n3, 'v': v3, 'f': false}}] AS hand FROM cand),
u AS (SELECT *, NOT (trim(pt) = '' OR (length(trim(pt)) = 1 AND NOT regexp_matches(trim(pt), '[\\p{{L}}\\p{{N}}]')) OR regexp_matches(trim(pt), '^[^A-Za-z0-9]+$')
  OR (length(replace(replace(trim(pt), ' ', ''), substr(replace(trim(pt), ' ', ''), 1, 1), '')) = 0 AND length(trim(pt)) > 3)) AS usable FROM s),
c AS (SELECT *, CASE WHEN script = 'print' AND usable THEN CASE WHEN ps < 0.85 THEN list_concat([{{'t': pt, 'n': pn, 'v': least(0.95::DOUBLE, greatest(0.55::DOUBLE, ps)), 'f': true}}], list_transform(list_filter(hand, lambda h: h.t <> ''), lambda h: {{'t': h.t, 'n': h.n, 'v': least(h.v, 0.45::DOUBLE), 'f': false}}))
    ELSE [{{'t': pt, 'n': pn, 'v': least(0.95::DOUBLE, greatest(0.55::DOUBLE, ps)), 'f': true}}] END
  WHEN usable AND NOT list_contains(list_transform(hand, lambda h: h.n), pn) THEN list_concat(hand, [{{'t': pt, 'n': pn, 'v': least(0.32::DOUBLE, greatest(0.05::DOUBLE, ps * 0.35::DOUBLE)), 'f': false}}]) ELSE hand END AS chosen FROM u),
o AS (SELECT doc_id, line_no, list_sort(list_transform(chosen, lambda h, i: {{'v': -h.v, 'i': i, 't': h.t, 'f': h.f}})) AS l FROM c)
SELECT doc_id, line_no, md5(array_to_string(list_transform(l, lambda h: h.t), '|')) AS texts, round(-l[1].v, 9) AS best, l[1].f AS trusted, CAST(len(l) AS INT) AS n FROM o""")
def ensemble_order(spark, sf_dir):
    """A line's hypotheses of two readers, ranked anew."""
    d, n = F.col("doc_id"), F.col("line_no")
    rows = E.candidates(spark, sf_dir)
    script = F.when((d + n) % 2 == 0, "print").otherwise("handwriting")
    out = routing.ensemble(script, F.slice("hyps", 1, 4), F.col("hyps")[4]["text"], ((d + n) % 20) / F.lit(20.0), F.lit("raw"))
    rows = rows.select("doc_id", "line_no", out.alias("l"))
    first = F.get("l", F.lit(0))
    return rows.select("doc_id", "line_no", F.md5(F.array_join(F.transform("l", lambda h: h["text"]), "|").cast("binary")).alias("texts"), r(first["visual"]).alias("best"), first["family"].isNotNull().alias("trusted"), F.size("l").alias("n"))


_HINT_REGIONS = ("printed_text", "margin_note", "printed_text", "table")


@query(f"""WITH {E.BOXES},
a AS (SELECT *, {", ".join(f"{x} AS i{k}" for k, x in enumerate(_IOUS))}, CASE WHEN line_no % 2 = 0 THEN 'print' ELSE 'handwriting' END AS script, ((doc_id + line_no) % 10) / 20.0::DOUBLE AS irr, ((doc_id * 3 + line_no) % 20) / 20.0::DOUBLE + 0.05::DOUBLE AS ps,
  doc_id % 4 = 0 AS bare, CASE doc_id % 3 WHEN 0 THEN 'form' WHEN 1 THEN 'other' END AS category FROM boxes),
b AS (SELECT *, CASE WHEN bare OR greatest(i0, i1, i3) < 0.25 THEN NULL WHEN i0 >= i1 AND i0 >= i3 THEN 'printed_text' WHEN i1 >= i3 THEN 'margin_note' ELSE 'table' END AS hint, script = 'handwriting' AND (irr > 0.28 OR ps < 0.75) AS hand, script = 'print' AND ps >= 0.88 AND irr < 0.22 AS pr,
  coalesce(category = 'form', false) AS printish FROM a),
c AS (SELECT *, CASE WHEN bare THEN CASE WHEN printish AND ps >= 0.90 AND script = 'print' AND irr < 0.22 AND region_type IN ('main_handwriting', 'unknown') THEN 'category_advisory' WHEN printish AND script = 'handwriting' THEN 'category_ignored_handwriting' END
  WHEN region_type = 'crossed_out_candidate' THEN NULL WHEN hint IS NULL THEN 'none' WHEN hint = 'printed_text' AND hand THEN 'hint_conflict' WHEN hint IN ('table', 'printed_text') AND pr THEN 'hint_agree' WHEN hint = 'margin_note' THEN 'hint_geometry' ELSE 'hint_unused' END AS src FROM b),
d AS (SELECT *, coalesce(src = 'hint_conflict' OR (src = 'hint_unused' AND NOT hand AND NOT pr), false) AS unsure FROM c)
SELECT doc_id, line_no, src AS layout_source, unsure AS routing_uncertain, CASE WHEN unsure THEN 'mixed' ELSE script END AS script_mode, CASE WHEN src = 'category_advisory' THEN 'printed_text' WHEN src IN ('hint_agree', 'hint_geometry') THEN hint ELSE region_type END AS region_type FROM d""")
def layout_advice(spark, sf_dir):
    """Lines after a page reader's advice: taken where it does not contradict the pixels."""
    d, n = F.col("doc_id"), F.col("line_no")
    hints = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in box]).alias("box"), F.lit(region).alias("region_type")) for box, region in zip(_HINT_BOXES, _HINT_REGIONS)])
    rows = E.boxes(spark, sf_dir).withColumns(
        {
            "script_mode": F.when(n % 2 == 0, "print").otherwise("handwriting"), "irregularity": ((d + n) % 10) / F.lit(20.0), "print_score": ((d * 3 + n) % 20) / F.lit(20.0) + 0.05,
            "hints": F.when(d % 4 == 0, F.slice(hints, 1, 0)).otherwise(hints), "category": F.when(d % 3 == 0, "form").when(d % 3 == 1, "other"), "page_w": F.lit(E.PAGE_W), "page_h": F.lit(E.PAGE_H),
        }
    )
    return layout.apply_hints(rows).select("doc_id", "line_no", "layout_source", "routing_uncertain", "script_mode", "region_type")


@query(f"WITH {E.BOXES} SELECT doc_id, line_no, greatest(0.0::DOUBLE, x - 4) AS x, greatest(0.0::DOUBLE, y - 4) AS y, greatest(0.0::DOUBLE, least({E.PAGE_W}::DOUBLE, x + w + 4) - greatest(0.0::DOUBLE, x - 4)) AS width, greatest(0.0::DOUBLE, least({E.PAGE_H}::DOUBLE, y + h + 4) - greatest(0.0::DOUBLE, y - 4)) AS height FROM boxes")
def crop_boxes(spark, sf_dir):
    """The box of each line's crop: with a margin, inside the page."""
    return E.boxes(spark, sf_dir).select("doc_id", "line_no", G.crop(F.col("bbox"), F.lit(E.PAGE_W), F.lit(E.PAGE_H)).alias("c")).select("doc_id", "line_no", "c.*")


# --- pixels --------------------------------------------------------------------------


def image(width: int, height: int, value) -> Column:
    """PGM bytes whose grey levels are ``value(row, column)``."""
    level = lambda i: F.lpad(F.hex(value(F.floor(i / width), i % width).cast("long")), 2, "0")
    pixels = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), level), "")
    return F.concat(F.lit(b"P5 %d %d 255\n" % (width, height)), F.unhex(pixels))


_W, _H = 24, 16
_LEVEL = "((d * 7 + ({r}) * 13 + ({c}) * 29 + ((({r}) * ({c})) % 11) * 17) % 256)"


def _speckled(spark, sf_dir):
    d = F.col("doc_id")
    return documents(spark, sf_dir).select("doc_id", image(_W, _H, lambda y, x: (d * 7 + y * 13 + x * 29 + ((y * x) % 11) * 17) % 256).alias("image"))


def _clamped(x: str, n: int) -> str:
    return f"least(greatest({x}, 0), {n - 1})"


def _mirrored(x: str, n: int) -> str:
    return f"({n - 1} - abs({n - 1} - abs({x})))"


def _at(row: str, column: str) -> str:
    return _LEVEL.format(r=row, c=column)


_PIXELS = f"px AS (SELECT doc_id AS d, y, x FROM documents, range({_H}) a(y), range({_W}) b(x))"
_NEAR = " + ".join(_at(_clamped(f"y + {a}", _H), _clamped(f"x + {b}", _W)) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1)))
_SMOOTH = " + ".join(f"{ka * kb} * {_at(_mirrored(f'y + {a - 2}', _H), _mirrored(f'x + {b - 2}', _W))}" for a, ka in enumerate((1, 4, 6, 4, 1)) for b, kb in enumerate((1, 4, 6, 4, 1)))


@query(f"""WITH {_PIXELS},
v AS (SELECT d, y, x, {_at("y", "x")} AS v, {_NEAR} - 4 * {_at("y", "x")} AS lap, {_at("y", "x")} - ({_SMOOTH}) / 256.0::DOUBLE AS rest FROM px),
q AS (SELECT d, quantile_cont(v, 0.55) AS cut, var_pop(lap) AS blur, stddev_pop(v) AS contrast, stddev_pop(rest) AS noise, avg(CAST(v < 170 AS INT)) AS ink FROM v GROUP BY d),
s AS (SELECT v.d, y, CAST(count(*) FILTER (v < cut) AS DOUBLE) AS n FROM v JOIN q USING (d) GROUP BY v.d, y),
m AS (SELECT d, y, (coalesce(lag(n) OVER w, n) + n + coalesce(lead(n) OVER w, n)) / 3 AS n FROM s WINDOW w AS (PARTITION BY d ORDER BY y)),
o AS (SELECT d, y, n > 0.28::DOUBLE * max(n) OVER (PARTITION BY d) AS is_on FROM m),
e AS (SELECT d, is_on AND NOT coalesce(lag(is_on) OVER (PARTITION BY d ORDER BY y), false) AS up FROM o),
b AS (SELECT d, greatest(1, count(*) FILTER (up)) AS bands FROM e GROUP BY d),
k AS (SELECT d, x, CAST(count(*) FILTER (v < 170) AS DOUBLE) AS n FROM v GROUP BY d, x),
i AS (SELECT d, CASE WHEN count(*) FILTER (n > 0) < 5 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, stddev_pop(n) FILTER (n > 0) / (avg(n) FILTER (n > 0) + 1e-3) / 8) END AS irregularity FROM k GROUP BY d)
SELECT d AS doc_id, {_W}::INT AS width, {_H}::INT AS height, round(blur, 6) AS blur, round(contrast, 6) AS contrast, round(noise, 6) AS noise, round(ink, 6) AS ink, CAST(bands AS INT) AS bands, round(irregularity, 6) AS irregularity FROM q JOIN b USING (d) JOIN i USING (d)""")
def page_pixels(spark, sf_dir):
    """Size, blur, contrast, noise, ink, bands and irregularity of an image."""
    rows = _speckled(spark, sf_dir).select("doc_id", providers.page_measures(F.col("image")).alias("m")).select("doc_id", "m.*")
    return rows.select("doc_id", "width", "height", *[F.round(c, 6).alias(c) for c in ("blur", "contrast", "noise", "ink")], "bands", F.round("irregularity", 6).alias("irregularity"))


_AROUND = [_at(_clamped(f"y + {a}", _H), _clamped(f"x + {b}", _W)) for a in range(-2, 3) for b in range(-2, 3)]


@query(f"""WITH {_PIXELS},
v AS (SELECT d, {_at("y", "x")} AS v, ({" + ".join(_AROUND)}) / 25.0::DOUBLE AS mean, ({" + ".join(f"{a} * {a}" for a in _AROUND)}) / 25.0::DOUBLE AS squares FROM px)
SELECT d AS doc_id, round(avg(CAST(NOT v > mean * (1 + 0.2::DOUBLE * (sqrt(greatest(squares - mean * mean, 0)) / 128 - 1)) AS INT)), 6) AS black FROM v GROUP BY d""")
def binarised(spark, sf_dir):
    """The share of black after binarising by each pixel's neighbourhood."""
    made = _speckled(spark, sf_dir).select("doc_id", imaging.filtered(F.col("image"), "sauvola", window=5).alias("image"))
    return made.select("doc_id", F.round(providers.page_measures(F.col("image"))["ink"], 6).alias("black"))


_BW, _BH = 40, 64
_INK = "(CASE WHEN (y + d) % 16 < 9 AND x BETWEEN 3 AND 35 AND (y * 7 + x * 5 + d) % 3 = 0 THEN 0 ELSE 255 END)"


def _ruled(spark, sf_dir):
    d = F.col("doc_id")
    dark = lambda y, x: ((y + d) % 16 < 9) & x.between(3, 35) & ((y * 7 + x * 5 + d) % 3 == 0)
    return documents(spark, sf_dir).select("doc_id", image(_BW, _BH, lambda y, x: F.when(dark(y, x), 0).otherwise(255)).alias("image"))


_BANDS = f"""px AS (SELECT doc_id AS d, y, x FROM documents, range({_BH}) a(y), range({_BW}) b(x)),
v AS (SELECT d, y, x, {_INK} AS v FROM px),
s AS (SELECT d, y, count(*) FILTER (v < 170) AS n FROM v GROUP BY d, y),
o AS (SELECT d, y, n > 0.22::DOUBLE * max(n) OVER (PARTITION BY d) AS is_on FROM s),
g AS (SELECT d, y, y - row_number() OVER (PARTITION BY d ORDER BY y) AS g FROM o WHERE is_on),
bands AS (SELECT d, min(y) AS top, max(y) + 1 AS bottom FROM g GROUP BY d, g HAVING count(*) >= 6)"""


@query(f"""WITH {_BANDS},
c AS (SELECT bands.d, top, bottom, min(x) FILTER (v < 170) AS x0, max(x) FILTER (v < 170) AS x1, count(DISTINCT x) FILTER (v < 170) AS n FROM bands JOIN v ON v.d = bands.d AND v.y >= top AND v.y < bottom GROUP BY ALL),
l AS (SELECT d, top AS y, x0 AS x, x1 - x0 + 1 AS width, bottom - top AS height FROM c WHERE n >= 12)
SELECT l.d AS doc_id, CAST(l.x AS INT) AS x, CAST(l.y AS INT) AS y, CAST(width AS INT) AS width, CAST(height AS INT) AS height, false AS blocked, round(avg(CAST(v < 170 AS INT)), 9) AS ink
FROM l JOIN v ON v.d = l.d AND v.y >= l.y - 4 AND v.y < l.y + height + 4 AND v.x >= l.x - 4 AND v.x < l.x + width + 4 GROUP BY ALL""")
def line_boxes(spark, sf_dir):
    """Boxes of the lines of an image, and the ink in their crops."""
    rows = _ruled(spark, sf_dir).select("doc_id", F.explode(imaging.lines_of(F.col("image"))).alias("l")).select("doc_id", "l.*")
    return rows.select("doc_id", "x", "y", "width", "height", "blocked", r(F.col("ink")).alias("ink"))


@query(f"""WITH {_BANDS},
b AS (SELECT d AS doc_id, 0.0::DOUBLE AS x, CAST(top AS DOUBLE) AS y, {_BW}::DOUBLE AS width, CAST(bottom - top AS DOUBLE) AS height, '' AS text, 0.0::DOUBLE AS score, -1 AS source FROM bands WHERE d % 4 = 3)
SELECT doc_id, x, y, width, height, text, score, CAST(source AS INT) AS source FROM b UNION ALL
SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 1 ELSE 2 END, 3, 20, CASE WHEN doc_id % 4 = 2 THEN 4 ELSE 5 END, CASE doc_id % 4 WHEN 2 THEN 'second' ELSE 'first' END, CASE WHEN doc_id % 4 = 2 THEN 0.5 ELSE 0.9 END, CASE WHEN doc_id % 4 = 2 THEN 1 ELSE 0 END FROM documents WHERE doc_id % 4 <> 3""")
def detected_lines(spark, sf_dir):
    """Lines of the first engine that finds any: one that fails or finds nothing is passed over, bands of ink stand last."""
    marked = _ruled(spark, sf_dir).withColumn("image", F.concat("image", F.encode((F.col("doc_id") % 4).cast("string"), "UTF-8")))

    def first():
        box = [[2, 3], [22, 3], [22, 8], [2, 8]]
        answers = {b"0": [[box, ("first", 0.9)]], b"1": {"rec_polys": [box], "rec_texts": ["first"], "rec_scores": [0.9]}}

        def read(data):
            if data[-1:] == b"2":
                raise RuntimeError("no such model")
            return answers.get(data[-1:])

        return read

    def second():
        return lambda data: [[[[1, 3], [21, 7]], ("second", 0.5)]] if data[-1:] == b"2" else []

    found = marked.select("doc_id", F.explode(providers.detector([first, second])("image")).alias("l"))
    return found.select("doc_id", "l.*")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'read|spare' WHEN 1 THEN '' ELSE 'other' END AS texts, CASE WHEN doc_id % 3 = 1 THEN 'ValueError: damaged' END AS error,
  round(CASE doc_id % 3 WHEN 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (1.0::DOUBLE + exp(-((CASE WHEN doc_id % 3 = 0 THEN -0.5::DOUBLE ELSE -1.0::DOUBLE END) + 1.5::DOUBLE) / 1.5::DOUBLE)) END, 9) AS visual FROM documents""")
def recognised(spark, sf_dir):
    """Hypotheses of a reader with a fallback; a failure is kept as an error without visual evidence."""

    def reader():
        def read(data, options):
            if data == b"0":
                return [("read", -0.5), ("spare", -2.0)][: options["returned"]]
            if data == b"1":
                raise ValueError("damaged")
            return []

        return read

    def spare():
        def read(data, options):
            if data == b"1":
                raise ValueError("damaged")
            return [("other", -1.0)]

        return read

    image_ = F.encode((F.col("doc_id") % 3).cast("string"), "UTF-8")
    rows = documents(spark, sf_dir).select("doc_id", providers.recogniser(providers.with_fallback(reader, spare))(image_).alias("h"))
    first = F.get("h", F.lit(0))
    return rows.select("doc_id", F.array_join(F.transform("h", lambda h: h["text"]), "|").alias("texts"), first["error"].alias("error"), r(providers.visual(first)).alias("visual"))


@query("""SELECT doc_id, doc_id % 5 <> 4 AS enabled, CASE doc_id % 5 WHEN 0 THEN 'supported' WHEN 1 THEN 'illegible' WHEN 2 THEN 'disagreement' ELSE 'unavailable' END AS status, CASE WHEN doc_id % 5 = 0 THEN 1 END::INT AS index FROM documents""")
def verified_texts(spark, sf_dir):
    """A verifier's guarded answers: bound to what was offered, and off where there is none."""

    def make():
        def ask(data, texts):
            if data == b"3":
                raise TimeoutError
            return {b"0": {"index": 1, "text": texts[1]}, b"1": {"index": None}, b"2": {"index": 0, "text": "invented"}}[data]

        return ask

    rows = documents(spark, sf_dir).select("doc_id", F.encode((F.col("doc_id") % 5).cast("string"), "UTF-8").alias("image"), F.array(F.lit("a"), F.lit("b")).alias("texts"))
    on, off = rows.where(F.col("doc_id") % 5 != 4), rows.where(F.col("doc_id") % 5 == 4)
    out = on.select("doc_id", providers.verifier(make)("image", "texts").alias("v")).unionByName(off.select("doc_id", providers.verifier(None)("image", "texts").alias("v")))
    return out.select("doc_id", "v.enabled", "v.status", F.when(F.col("v.status") == "supported", F.col("v.index")).alias("index"))


@query("""WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE turn % 4 <> 2)
SELECT conv_id AS document_id, CAST(count(*) AS INT) AS pages, arg_min(CASE turn % 3 WHEN 0 THEN 'prescription' WHEN 1 THEN 'form' ELSE 'unknown' END, turn) AS category, round(arg_min(least(1.0::DOUBLE, turn / 10.0::DOUBLE), turn), 9) AS confidence,
  string_agg('item' || turn, ',' ORDER BY turn) AS items, string_agg(CASE WHEN turn % 2 = 0 THEN 'printed_text' ELSE 'unknown' END, ',' ORDER BY turn) AS regions FROM p GROUP BY conv_id""")
def understood_documents(spark, sf_dir):
    """What a page reader says of documents of several pages: the first page's category, all pages' items and regions."""
    n = F.col("turn")
    name = F.when(n % 3 == 0, "RX").when(n % 3 == 1, "form").otherwise("poem")
    reply = F.concat(
        F.lit('Here it is: {"category": "'), name, F.lit('", "category_confidence": '), (n / 10).cast("string"), F.lit(', "layout_regions": [{"type": "'), F.when(n % 2 == 0, "Printed").otherwise("blot"),
        F.lit('", "bbox": [0, 0, 1, 1]}, {"type": "table", "bbox": [1]}], "line_items": [{"text": "item'), n.cast("string"), F.lit('"}]}'),
    )
    pages = E.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), n.alias("page_index"), F.encode(F.when(n % 4 == 2, "").otherwise(reply), "UTF-8").alias("image"))

    def make():
        def read(data):
            if not data:
                raise OSError("no answer")
            return data.decode()

        return read

    views = understanding.page_views(pages.withColumn("reply", providers.page_reader(make)("image")))
    out = understanding.documents(views)
    return out.select("document_id", "pages", "category", r(F.col("confidence")).alias("confidence"), F.array_join(F.transform("items", lambda i: i["text"]), ",").alias("items"), F.array_join(F.transform("hints", lambda h: h["region_type"]), ",").alias("regions"))


@query("SELECT doc_id, 10 + doc_id % 5 AS x, 8 + doc_id % 3 AS y, 60 + doc_id % 7 AS right_, 40 + doc_id % 4 AS bottom, true AS upright FROM documents")
def page_outlines(spark, sf_dir):
    """The corners of a bright page on a dark ground, and that its rows are level."""
    d = F.col("doc_id")
    x0, y0, x1, y1 = 10 + d % 5, 8 + d % 3, 60 + d % 7, 40 + d % 4
    rows = documents(spark, sf_dir).select("doc_id", image(72, 50, lambda y, x: F.when((x >= x0) & (x <= x1) & (y >= y0) & (y <= y1), 240).otherwise(20)).alias("image"))
    f = F.col("f")
    out = rows.select("doc_id", imaging.page_facts(F.col("image")).alias("f"))
    corner = lambda i: F.get(f["corners"], F.lit(i)).cast("long")
    return out.select("doc_id", corner(0).alias("x"), corner(1).alias("y"), corner(4).alias("right_"), corner(5).alias("bottom"), (F.abs(f["skew"]) < 1.5).alias("upright"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'strike_through' WHEN 2 THEN 'underline' ELSE 'ruling' END AS kind, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE 80 + 16 END::INT AS height FROM documents")
def stroke_kinds(spark, sf_dir):
    """What a long stroke in a line's crop is, and how high the crop reaches a reader."""
    k = F.col("doc_id") % 4
    words = lambda y, x: (k != 3) & y.between(8, 31) & (x >= 10) & (x < 110) & ((x - 10) % 12 < 4)
    stroke = lambda y, x: ((k == 1) & y.between(19, 20) & x.between(5, 114)) | ((k == 2) & y.between(35, 36) & x.between(5, 114)) | ((k == 3) & (y == 20) & x.between(40, 99))
    rows = documents(spark, sf_dir).select("doc_id", image(120, 40, lambda y, x: F.when(words(y, x) | stroke(y, x), 0).otherwise(255)).alias("image"))
    out = rows.select("doc_id", imaging.crop_kind(F.col("image")).alias("c"))
    return out.select("doc_id", "c.kind", F.when(F.col("doc_id") % 4 != 3, F.col("c.height")).alias("height"))


@query(f"""WITH {_PIXELS}, v AS (SELECT d, stddev_pop(128 + (y * 7 + x * 5 + d * 3 + (x * y) % 5) % 9) AS contrast FROM px GROUP BY d)
SELECT d AS doc_id, 'raw<,normalized<raw,deskewed<normalized,clahe<deskewed,adaptive_binarized<deskewed,denoised<deskewed' AS made, {_W}::INT AS width, {_H}::INT AS height, round(contrast, 9) AS contrast FROM v""")
def page_variants(spark, sf_dir):
    """The six variants of a page with what each is made from; the first is the page as it came."""
    d = F.col("doc_id")
    grain = image(_W, _H, lambda y, x: 128 + (y * 7 + x * 5 + d * 3 + (x * y) % 5) % 9)
    rows = documents(spark, sf_dir).select("doc_id", imaging.variants_of(grain).alias("v"))
    rows = rows.withColumn("first", providers.page_measures(F.get("v", F.lit(0))["content"]))
    made = F.array_join(F.transform("v", lambda x: F.concat(x["name"], F.lit("<"), F.coalesce(x["made_from"], F.lit("")))), ",")
    return rows.select("doc_id", made.alias("made"), "first.width", "first.height", r(F.col("first.contrast")).alias("contrast"))
