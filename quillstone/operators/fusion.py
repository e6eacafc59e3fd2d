"""Fusion of competing hypotheses into one decision a line.

A line's hypotheses are an array of structs ``text, normalized_text, visual,
variant, model, family, safe_edit`` in rank order.  All steps are higher-order
functions over that array, without a shuffle.  Edits between all pairs of a
line's few candidates are counted once; those of long texts in a worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.config import DecisionThresholds
from quillstone.functions import scores as S
from quillstone.functions import text as T

#: Texts whose distance is at most this belong to one cluster.
CLUSTER_DISTANCE = 0.28
MAX_ALTERNATIVES = 5


def is_hand(h: Column) -> Column:
    return T.is_handwriting_model(h["model"], h["family"])


def is_print(h: Column) -> Column:
    return T.is_print_model(h["model"])


def first_max(items: Column, score) -> Column:
    """The item with the largest score, the first of equals; null for an empty array."""
    scored = F.transform(items, lambda x, i: F.struct(score(x).alias("s"), (-i).alias("o"), x.alias("x")))
    return F.array_max(scored)["x"]


def best_score(h: Column) -> Column:
    return h["visual"] + F.when(h["safe_edit"], 0.03).otherwise(0.0) + 0.04 * h["hint"]


def hinted(h: Column, words: Column | None = None) -> Column:
    """The hypothesis with the domain hint of its text, which is asked for often. ``words``: what is known of all hypotheses' words."""
    return h.withField("hint", S.domain_hint(h["text"], None if words is None else F.get(F.get(words, h["at"]), F.lit(2))))


def pick_best(cluster: Column) -> Column:
    hand = F.filter(cluster, is_hand)
    return F.when(F.size(hand) > 0, first_max(hand, best_score)).otherwise(first_max(cluster, best_score))


def distances(hyps: Column, edits: Column | None = None) -> Column:
    """Edits per character of the longer text between all pairs of ``hyps``, row by row in one array. ``edits``: those between all pairs, where they are known."""
    lengths = F.transform(hyps, lambda h: F.length(h["normalized_text"]))
    longer = T.let(lengths, lambda all_: F.flatten(F.transform(all_, lambda a: F.transform(all_, lambda b: F.greatest(a, b, F.lit(1))))))
    counted = T.pair_edits(F.transform(hyps, lambda h: h["normalized_text"])) if edits is None else edits
    return F.zip_with(counted, longer, lambda n, most: n / most)


def cluster_numbers(hyps: Column, apart: Column) -> Column:
    """For each hypothesis the place of the first cluster whose first member is near; clusters are numbered by that member's place.

    First-fit in rank order: the fold carries, for each place seen, the number
    of its cluster.  ``apart``: their :func:`distances`.
    """

    def step(numbers: Column, h: Column) -> Column:
        own = F.size(numbers)
        leads = F.filter(numbers, lambda n, i: (n == i) & (F.get(apart, own * F.size(hyps) + n) <= CLUSTER_DISTANCE))
        return F.concat(numbers, F.array(F.coalesce(F.get(leads, F.lit(0)), own)))

    return F.aggregate(hyps, F.array().cast("array<int>"), step)


def members(hyps: Column, numbers: Column, n: Column) -> Column:
    return F.filter(hyps, lambda h, i: F.get(numbers, i) == n)


def clusters(hyps: Column, numbers: Column) -> Column:
    """Clusters in order of preference: handwriting support, domain words, safe edits, best score, size, then first come."""
    groups = F.transform(F.array_distinct(numbers), lambda n: F.struct(n.alias("n"), members(hyps, numbers, n).alias("m")))

    def key(g: Column) -> Column:
        m = g["m"]
        return F.struct(
            (-F.size(F.filter(m, is_hand))).alias("hand"),
            (-F.array_max(F.transform(m, lambda h: h["hint"]))).alias("domain"),
            F.when(F.exists(m, lambda h: h["safe_edit"]), -1).otherwise(0).alias("edit"),
            (-F.array_max(F.transform(m, lambda h: h["visual"]))).alias("best"),
            (-F.size(m)).alias("many"),
            g["n"].alias("n"),
        )

    return F.transform(F.array_sort(F.transform(groups, lambda g: F.struct(key(g).alias("k"), g["m"].alias("m")))), lambda x: x["m"])


def stability(places: Column, apart: Column, many: Column) -> Column:
    """Mean similarity of all pairs of texts; 1 for one text, 0 for none.

    ``places``: where the texts stand among the ``many`` hypotheses of ``apart``, their :func:`distances`.
    """
    pairs = F.flatten(F.transform(places, lambda a, i: F.transform(F.slice(places, i + 2, F.size(places)), lambda b: 1.0 - F.get(apart, a * many + b))))
    mean = T.let(pairs, lambda all_: F.aggregate(all_, F.lit(0.0), lambda acc, x: acc + x) / F.greatest(F.size(all_), F.lit(1)))
    return F.when(F.size(places) == 0, 0.0).when(F.size(places) == 1, 1.0).otherwise(mean)


def _variants(items: Column) -> Column:
    return F.array_distinct(F.transform(items, lambda h: h["variant"]))


def _or_else(a: Column, b: Column) -> Column:
    return F.when(F.size(a) > 0, a).otherwise(b)


def fuse(lines: DataFrame, limits: DecisionThresholds | None = None) -> DataFrame:
    """Decide each line of ``lines``.

    Columns read: ``hyps`` and, where present, ``is_crossed_out``,
    ``image_quality_risk``, ``context_score``, ``verifier_agreement``,
    ``verifier_disagreement``, ``script_mode``, ``region_type``,
    ``verifier_index``, ``verifier_reject_all``, ``htr_blocked``,
    ``routing_uncertain``, ``strike_uncertain``, ``hyp_edits`` and ``hyp_words``
    (edits between all pairs of ``hyps`` and their words, which are counted
    otherwise).  Adds ``decision``: text,
    state, confidence, uncertainty, final_score, alternatives, reason,
    is_high_risk and the score breakdown.

    An index that is no candidate's is ignored altogether.
    """
    th = limits or DecisionThresholds()
    given = set(lines.columns)

    def arg(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in given else F.lit(default)

    own = [c for c in lines.columns]
    index = F.col("verifier_index") if "verifier_index" in given else F.lit(None).cast("int")
    hyps = F.coalesce(F.col("hyps"), F.filter(F.col("hyps"), lambda h: F.lit(False)))
    print_mode = (arg("script_mode", "handwriting") == "print") | arg("region_type", "").isin("printed_text", "table")
    mixed = (arg("script_mode", "handwriting") == "mixed") | arg("routing_uncertain", False)
    chosen = F.coalesce((index >= 0) & (index < F.size(hyps)) & (F.get(hyps, index)["text"] != ""), F.lit(False))
    told = F.col("hyp_words") if "hyp_words" in given else None
    if known := "hyp_edits" in given:
        hyps = F.transform(hyps, lambda h, i: h.withField("at", i))
    moved = F.when(chosen, F.concat(F.slice(hyps, index + 1, 1), F.filter(hyps, lambda h, i: i != index))).otherwise(hyps)

    a = lines.select(
        *own,
        print_mode.alias("_print"),
        mixed.alias("_mixed"),
        chosen.alias("_chosen"),
        moved.alias("_hyps"),
        T.kept(F.transform(F.filter(moved, lambda h: h["normalized_text"] != ""), lambda h, i: hinted(h, told).withField("place", i))).alias("_valid"),
        S.clip(arg("image_quality_risk", 0.3)).alias("_risk"),
        S.clip(arg("context_score", 0.0)).alias("_context"),
        S.clip(F.when(chosen, 1.0).otherwise(arg("verifier_agreement", 0.0))).alias("_agree"),
        S.clip(arg("verifier_disagreement", 0.0)).alias("_disagree"),
        arg("is_crossed_out", False).alias("_crossed"),
        arg("verifier_reject_all", False).alias("_reject"),
        arg("htr_blocked", False).alias("_blocked"),
        arg("strike_uncertain", False).alias("_strike"),
    )
    valid = F.col("_valid")
    places = F.transform(valid, lambda h: h["at"]) if known else None
    between = T.let(places, lambda all_: F.flatten(F.transform(all_, lambda x: F.transform(all_, lambda y: F.get("hyp_edits", x * F.size("hyps") + y))))) if known else None
    b = a.withColumn("_apart", T.kept(distances(valid, between)))
    apart, n_valid = F.col("_apart"), F.size(valid)
    b = b.withColumn("_numbers", cluster_numbers(valid, apart)).withColumns({"_hand": F.filter(valid, is_hand), "_printed": F.filter(valid, is_print)}).withColumn("_clusters", clusters(valid, F.col("_numbers")))
    cl, hand, printed = F.col("_clusters"), F.col("_hand"), F.col("_printed")
    visual = lambda h: h["visual"]
    pure_print = F.col("_print") & ~F.col("_mixed")
    with_print, with_hand = F.get(F.filter(cl, lambda c: F.exists(c, is_print)), F.lit(0)), F.get(F.filter(cl, lambda c: F.exists(c, is_hand)), F.lit(0))
    first = F.get(cl, F.lit(0))
    c = b.withColumn("_top0", F.when(pure_print, F.coalesce(with_print, first)).otherwise(F.coalesce(with_hand, first)))
    loudest = first_max(F.col("_top0"), visual)
    c = c.withColumn("_best0", F.when(pure_print, F.when((F.size(printed) > 0) & ~is_print(loudest), first_max(printed, visual)).otherwise(loudest)).otherwise(pick_best(F.col("_top0"))))
    # a chosen hypothesis is moved to the front; it may be without a normal form
    moved_first = F.get(F.col("_hyps"), F.lit(0))
    sel = F.when(moved_first["normalized_text"] != "", F.get(valid, F.lit(0))).otherwise(hinted(moved_first, told).withField("place", F.lit(-1)))
    near = F.filter(valid, lambda h, i: (sel["place"] == 0) & (F.get(apart, i) <= CLUSTER_DISTANCE))
    c = c.withColumns({"_best": F.when(F.col("_chosen"), sel).otherwise(F.col("_best0")), "_top": F.when(F.col("_chosen"), _or_else(near, F.array(sel))).otherwise(F.col("_top0"))})

    top = F.col("_top")
    hand_top, print_top = F.filter(top, is_hand), F.filter(top, is_print)
    pool = F.when(pure_print & (F.size(print_top) > 0), print_top).otherwise(_or_else(hand_top, top))
    c = c.withColumns({"_pool": pool, "_hand_n": F.size(hand_top)})
    family = F.when(F.col("_print"), printed).otherwise(hand)
    every = _or_else(_variants(family), _variants(valid))
    loud_hand, loud_print = first_max(hand, visual), first_max(printed, visual)
    cross = F.when((F.size(hand) > 0) & (F.size(printed) > 0), F.get(apart, loud_hand["place"] * n_valid + loud_print["place"])).otherwise(0.0)
    d = c.withColumns(
        {
            "_va": F.size(_variants(F.col("_pool"))) / F.greatest(F.size(every), F.lit(1)),
            "_st": T.let(F.transform(F.filter(F.col("_pool"), lambda h: h["place"] >= 0), lambda h: h["place"]), lambda there: stability(there, apart, n_valid)),
            "_vis": S.clip(F.coalesce(F.array_max(F.transform(F.col("_pool"), visual)), F.lit(0.0))),
            "_cross": cross,
            "_n": F.size(cl),
        }
    )

    def cluster_score(m: Column) -> Column:
        of_hand = F.coalesce(F.array_max(F.transform(F.filter(m, is_hand), visual)), F.lit(0.0))
        return F.when(of_hand != 0, of_hand).otherwise(F.array_max(F.transform(m, visual)))

    va, st, vis, x, many = F.col("_va"), F.col("_st"), F.col("_vis"), F.col("_cross"), F.col("_n") > 1
    d = d.withColumns(
        {
            "_ent": F.when(many, S.softmax_entropy(F.transform(cl, cluster_score))).otherwise(F.greatest(F.lit(0.0), 0.15 * (1.0 - vis))),
            "_dis": F.least(F.lit(1.0), F.when(many, F.greatest(1.0 - va, 0.35 * (1.0 - st), 0.4 * x)).otherwise(F.greatest(0.12 * (1 - st), 0.35 * x))),
        }
    )
    ent, dis = F.col("_ent"), F.col("_dis")
    d = d.withColumns(
        {
            "_final": 0.45 * vis + 0.20 * va + 0.15 * st + 0.10 * F.col("_context") + 0.10 * F.col("_agree"),
            "_unc": 0.35 * ent + 0.35 * dis + 0.20 * F.col("_risk") + 0.10 * F.col("_disagree"),
            "_text": F.col("_best")["text"],
            "_alts": F.slice(F.array_distinct(F.filter(F.transform(cl, lambda m: pick_best(m)["text"]), lambda t: t != "")), 1, MAX_ALTERNATIVES),
        }
    )
    final, unc, text = F.col("_final"), F.col("_unc"), F.col("_text")
    high = T.is_high_risk(text)
    min_score = F.when(high, th.high_risk_accepted_min_score).otherwise(th.accepted_min_score)
    max_unc = F.when(high, th.high_risk_max_uncertainty).otherwise(th.accepted_max_uncertainty)
    # the last trigger that holds names the reason
    abstain = (
        F.when(F.col("_disagree") >= 1.0, "Verifier disagreement")
        .when(F.col("_mixed") & (x > 0.4), "Uncertain print/handwriting routing")
        .when((ent > 0.85) & (vis < 0.55), "High decoder entropy")
        .when((dis > 0.65) & (final < 0.55), "Heavy candidate disagreement")
        .when(F.col("_risk") >= 0.8, "Poor image quality")
    )
    d = d.withColumns({"_high": high, "_abstain": abstain, "_min": min_score, "_max": max_unc})
    halt, best = F.col("_abstain").isNotNull(), F.col("_best")
    no_hand_text = F.size(F.filter(hand, lambda h: h["text"] != "")) == 0
    accepts_print = pure_print & is_print(best) & (vis >= F.greatest(F.lit(0.60), F.col("_min") - 0.08)) & ~halt
    accepts_hand = (
        ~F.col("_print") & ~halt & (final >= F.col("_min")) & (unc <= F.col("_max")) & (F.col("_hand_n") >= max(1, th.consensus_min_support)) & is_hand(best)
        & (dis <= th.max_ensemble_disagreement_accept) & (x <= th.max_cross_model_accept) & (va >= th.min_variant_agreement_accept)
    )
    ladder = (
        F.when((vis < th.illegible_min_visual) | (many & (dis > 0.7) & (final < 0.5)), T.ILLEGIBLE)
        .when(accepts_print, F.when(unc <= F.col("_max") + 0.08, T.ACCEPTED).otherwise(T.REVIEW))
        .when(accepts_hand, T.ACCEPTED)
        .when(halt | ((unc <= th.review_max_uncertainty) & (text != "")), T.REVIEW)
        .otherwise(T.ILLEGIBLE)
    )
    d = d.withColumn("_ladder", ladder)
    got = F.col("_ladder") == T.ACCEPTED
    downgrade = (
        F.when(got & F.col("_strike"), "Possible strike-through; recognition evidence is kept for review.")
        .when(got & F.col("_high") & (unc > th.high_risk_max_uncertainty), "High-risk text (number, date, name or code) is not certain enough.")
        .when(got & ~F.col("_print") & (x > 0.45), "Handwriting and print recognition differ too much.")
        .when(got & T.has_decode_artefacts(text), "Signs of a decoding fault.")
    )
    d = d.withColumn("_downgrade", downgrade).withColumn("_state", F.when(F.col("_downgrade").isNotNull(), T.REVIEW).otherwise(F.col("_ladder")))
    state = F.col("_state")
    all_texts = F.slice(F.col("_hyps"), 1, MAX_ALTERNATIVES)
    raw_alts = F.filter(F.transform(all_texts, lambda h: h["text"]), lambda t: t != "")
    struck = first_max(F.col("_hyps"), visual)

    zero = F.lit(0.0)
    empty_scores = F.struct(*[zero.alias(n) for n in BREAKDOWN])
    scores_ = F.struct(
        vis.alias("model_score"), (0.5 * va + 0.5 * st).alias("agreement_score"), va.alias("variant_agreement"), st.alias("character_stability"),
        F.col("_context").alias("context_score"), F.col("_agree").alias("verifier_agreement"), ent.alias("decoder_entropy"), dis.alias("ensemble_disagreement"),
        F.col("_risk").alias("image_quality_risk"), F.col("_disagree").alias("verifier_disagreement"), final.alias("final_score"), unc.alias("uncertainty"),
    )

    def row(text_: Column, state_: Column | str, conf, unc_, final_, alts, reason, high_, scores__) -> Column:
        def lit(v):
            return v if isinstance(v, Column) else F.lit(v)

        return F.struct(
            lit(text_).alias("text"), lit(state_).alias("state"), lit(conf).cast("double").alias("confidence"), lit(unc_).cast("double").alias("uncertainty"),
            lit(final_).cast("double").alias("final_score"), lit(alts).alias("alternatives"), lit(reason).alias("reason"), lit(high_).alias("is_high_risk"), scores__.alias("scores"),
        )

    none = F.array().cast("array<string>")
    rejected_text = F.coalesce(F.get(raw_alts, F.lit(0)), F.lit(T.ILLEGIBLE_TEXT))
    has_alts = F.size(raw_alts) > 0
    shown = F.when(state == T.REVIEW, F.least(final, F.lit(0.55))).when(state == T.ILLEGIBLE, F.least(final, F.lit(0.2))).otherwise(final)
    why = F.coalesce(
        F.col("_downgrade"),
        F.when(state == T.ACCEPTED, F.when(F.col("_print"), "Print recognition is sure enough.").otherwise("Handwriting candidates agree."))
        .when((state == T.REVIEW) & halt, F.concat(F.lit("Abstained: "), F.col("_abstain"), F.lit(".")))
        .when(state == T.REVIEW, "Not certain enough; for review.")
        .otherwise("Evidence is too weak or contradictory."),
    )
    decision = (
        F.when(F.col("_blocked") & ~F.col("_print"), row(T.ILLEGIBLE_TEXT, T.ILLEGIBLE, 0.0, 1.0, 0.0, raw_alts, "The crop is no single line; recognition was not run.", False, empty_scores))
        .when(F.col("_reject"), row(rejected_text, F.when(has_alts, T.REVIEW).otherwise(T.ILLEGIBLE), 0.15, 0.9, 0.15, raw_alts, "The verifier rejected all candidates.", has_alts & T.is_high_risk(rejected_text), empty_scores))
        .when(
            F.col("_crossed"),
            row(F.coalesce(struck["text"], F.lit("")), T.CROSSED_OUT, F.coalesce(struck["visual"], zero), 0.5, F.coalesce(struck["visual"], zero), raw_alts, "Crossed out; kept apart from the text.", T.is_high_risk(F.coalesce(struck["text"], F.lit(""))), empty_scores),
        )
        .when(F.size(valid) == 0, row(T.ILLEGIBLE_TEXT, T.ILLEGIBLE, 0.0, 1.0, 0.0, none, "No candidate is readable.", False, empty_scores))
        .when(
            ~F.col("_print") & (F.size(hand) == 0),
            row(T.ILLEGIBLE_TEXT, T.ILLEGIBLE, F.least(final, F.lit(0.35)), F.greatest(unc, F.lit(0.75)), final, F.col("_alts"), "Only print recognition read this handwriting.", F.col("_high"), scores_),
        )
        .when(
            ~F.col("_print") & no_hand_text & (F.size(printed) > 0),
            row(T.ILLEGIBLE_TEXT, T.ILLEGIBLE, F.least(final, F.lit(0.35)), F.greatest(unc, F.lit(0.75)), final, F.col("_alts"), "Only print recognition read this handwriting.", F.col("_high"), scores_),
        )
        .when(halt & (vis < th.illegible_min_visual), row(T.ILLEGIBLE_TEXT, T.ILLEGIBLE, 0.1, 0.95, final, F.col("_alts"), F.concat(F.lit("Abstained: "), F.col("_abstain"), F.lit("; too little visual evidence.")), F.col("_high"), scores_))
        .otherwise(row(F.when(state == T.ILLEGIBLE, T.ILLEGIBLE_TEXT).otherwise(text), state, shown, unc, final, F.col("_alts"), why, F.col("_high"), scores_))
    )
    return d.select(*own, decision.alias("decision"))


BREAKDOWN = (
    "model_score", "agreement_score", "variant_agreement", "character_stability", "context_score", "verifier_agreement", "decoder_entropy",
    "ensemble_disagreement", "image_quality_risk", "verifier_disagreement", "final_score", "uncertainty",
)
