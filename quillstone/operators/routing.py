"""Which recognition a line gets, when it is read again, and what a verifier's answer is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import scores as S
from quillstone.functions import text as T
from quillstone.operators.fusion import is_hand, is_print

VARIANTS = ("raw", "clahe", "denoised", "adaptive_binarized")
VERIFY_BELOW = 0.60
VERIFIED_TEXTS = 5


def route(script: Column, region: Column, uncertain: Column) -> Column:
    """``print``, ``handwriting`` or ``mixed``; a region of print counts only where routing is certain."""
    own = F.lower(F.coalesce(script, F.lit("handwriting")))
    return F.when((own == "mixed") | F.coalesce(uncertain, F.lit(False)), "mixed").when(region.isin("printed_text", "table"), "print").otherwise(own)


def needs_second_pass(hyps: Column, script: Column) -> Column:
    """Weak or unfamiliar handwriting, or print that neither engine reads well."""
    readable = F.filter(hyps, lambda h: h["text"] != "")
    hand, printed = F.filter(readable, is_hand), F.filter(readable, is_print)
    top = lambda a: F.coalesce(F.array_max(F.transform(a, lambda h: h["visual"])), F.lit(0.0))
    known = F.coalesce(F.array_max(F.transform(hand, lambda h: S.coverage(h["text"]))), F.lit(0.0))
    return F.when(script == "print", (top(printed) < 0.55) & (top(hand) < 0.45)).otherwise((top(hand) < 0.50) | (known <= 0.25))


def missing_variants(lines: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """(line, variant) pairs of a second pass that were not read in the first."""
    asked = lines.select(*key, F.explode(F.array(*[F.lit(v) for v in VARIANTS])).alias("variant"))
    return asked.join(done.select(*key, "variant"), [*key, "variant"], "left_anti")


def needs_verifier(hyps: Column, script: Column, uncertain: Column) -> Column:
    top = F.coalesce(F.array_max(F.transform(hyps, lambda h: h["visual"])), F.lit(0.0))
    return (F.size(hyps) > 0) & ((top < VERIFY_BELOW) | (script == "mixed") | F.coalesce(uncertain, F.lit(False)))


def verifier_outcome(hyps: Column, enabled: Column, status: Column, index: Column) -> Column:
    """Struct (agreement, disagreement, index, reject_all, note) of an answer ``status``/``index`` about the first texts.

    The answer is bound to the candidates: an index outside them is void, and
    the chosen text is looked up in the ranked hypotheses, first match.
    """
    shown = F.filter(F.transform(F.slice(hyps, 1, VERIFIED_TEXTS), lambda h: h["text"]), lambda t: t != "")
    inside = F.coalesce((index >= 0) & (index < F.size(shown)), F.lit(False))
    place = F.array_position(F.transform(hyps, lambda h: h["text"]), F.get(shown, F.when(inside, index))) - 1
    supported = enabled & (status == "supported")
    against = enabled & status.isin("illegible", "disagreement")
    note = F.when(~enabled, "verifier_unavailable").when(index.isNotNull() & ~inside, "invalid_selected_candidate_index")
    return F.struct(
        F.when(supported, 1.0).otherwise(0.0).alias("agreement"),
        F.when(against, 1.0).otherwise(0.0).alias("disagreement"),
        F.when(supported & inside, place.cast("int")).alias("index"),
        (enabled & (status == "illegible")).alias("reject_all"),
        note.alias("note"),
    )


def guard_reply(texts: Column, index: Column, chosen_text: Column, failed: Column) -> Column:
    """The status of a model's raw reply: null index: illegible; out of range or a text that was not offered: disagreement."""
    return (
        F.when(failed, "unavailable")
        .when(index.isNull(), "illegible")
        .when((index < 0) | (index >= F.size(texts)), "disagreement")
        .when(chosen_text.isNotNull() & ~F.array_contains(texts, chosen_text), "disagreement")
        .otherwise("supported")
    )


def split_blocked(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines whose crop is no line (never recognised), and the rest."""
    blocked = F.coalesce(F.col("htr_blocked"), F.lit(False))
    return lines.where(blocked), lines.where(~blocked)


def ensemble(script: Column, hand: Column, print_text: Column, print_score: Column, variant: Column) -> Column:
    """One line's hypotheses from a handwriting reader's array and a print reader's text.

    Print: the print reader leads; handwriting joins, capped, where print is
    middling.  Handwriting: the print reader is a weak hint if it says something new.
    """
    usable = ~T.is_garbage(print_text)

    def made(visual: Column, trusted: bool) -> Column:
        return F.struct(print_text.alias("text"), T.squeeze_blanks(print_text).alias("normalized_text"), visual.alias("visual"), variant.alias("variant"), F.lit("paddleocr-rec").alias("model"), F.lit("paddle" if trusted else None).cast("string").alias("family"), F.lit(False).alias("safe_edit"))

    capped = F.transform(F.filter(hand, lambda h: h["text"] != ""), lambda h: h.withField("visual", F.least(h["visual"], F.lit(0.45))))
    lead = F.array(made(S.print_visual(print_score), True))
    printed = F.when(print_score < 0.85, F.concat(lead, capped)).otherwise(lead)
    new = usable & ~F.array_contains(F.transform(hand, lambda h: h["normalized_text"]), T.squeeze_blanks(print_text))
    written = F.when(new, F.concat(hand, F.array(made(S.print_hint_visual(print_score), False)))).otherwise(hand)
    chosen = F.when((script == "print") & usable, printed).otherwise(written)
    order = F.array_sort(F.transform(chosen, lambda h, i: F.struct((-h["visual"]).alias("v"), i.alias("i"), h.alias("h"))))
    return F.transform(order, lambda x: x["h"])
