"""Scores, calibrations and repairs as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.config import RerankSettings
from quillstone.functions import text as T

# Words that hint at the domain of clinical notes.
DOMAIN_HINTS = ("patient", "allergy", "nkda", "amoxicillin", "rx", "mg", "notes", "date", "follow", "fever", "tid", "bid", "dose")
# Words by which the need for a second recognition pass is judged.
COVERAGE_TERMS = ("patient", "allergy", "nkda", "amoxicillin", "rx", "mg", "notes", "date", "follow", "fever", "tid", "bid", "dose", "days", "take", "food", "jordan", "miles")
# The lexicon of repairs.
LEXICON = (
    "patient", "allergy", "allergies", "nkda", "notes", "note", "follow", "fever", "persists", "amoxicillin", "ibuprofen", "acetaminophen",
    "metformin", "lisinopril", "atorvastatin", "prescription", "rx", "dose", "dosage", "tablet", "tablets", "capsule", "capsules", "daily",
    "twice", "tid", "bid", "qid", "prn", "food", "with", "take", "days", "weeks", "date", "doctor", "diagnosis", "history", "blood",
    "pressure", "mg", "ml", "jordan", "miles",
)
# Abbreviations, units, and the forms of dates, quantities and slips.
ABBREVIATIONS = {"dr": "Dr", "mr": "Mr", "mrs": "Mrs", "rx": "Rx", "nkda": "NKDA", "tid": "tid", "bid": "bid", "qid": "qid", "prn": "prn"}
UNITS = ("mg", "ml", "g", "kg", "mcg", "iu", "mm", "cm", "%")
DATE_PATTERN = r"^(\d{1,2})\s*[/\-.]\s*(\d{1,2})\s*[/\-.]\s*(\d{2,4})$"
SLIP_PATTERN = r"(?i)\b(\d+(?:\.\d+)?)\s*(ma|mq|ng)\b"
PREFIX_PATTERN = r"\b(Rai|Ri|Px|Bx)\b"
QUANTITY_PATTERN = r"(?i)^(\d+(?:\.\d+)?)\s*(mg|ml|g|kg|mcg|iu|%|mm|cm)$"


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def words_of(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def domain_hint(text: Column, hints: Column | None = None) -> Column:
    """A quarter for each distinct hint word, at most 1. ``hints``: how many they are, where that is known."""
    if hints is not None:
        return F.least(F.lit(1.0), 0.25 * hints)
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0))
    return F.least(F.lit(1.0), 0.25 * F.size(F.array_intersect(found, words_of(DOMAIN_HINTS))))


def coverage(text: Column) -> Column:
    """Share of the words of two letters or more that are domain terms."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), 0), F.lower), lambda t: F.length(t) > 1)
    hits = F.size(F.filter(found, lambda t: t.isin(*COVERAGE_TERMS)))
    return F.when(F.size(found) == 0, 0.0).otherwise(hits / F.greatest(F.size(found), F.lit(1)))


def softmax_entropy(scores: Column) -> Column:
    """Entropy of the scores' softmax over its largest value; 1 without scores."""
    weights = T.let(F.array_max(scores), lambda top: F.transform(scores, lambda s: F.exp(s - top)))
    total = lambda all_: F.aggregate(all_, F.lit(0.0), lambda a, x: a + x)
    entropy_of = lambda w, all_: F.aggregate(w, F.lit(0.0), lambda a, x: a - (x / all_) * F.ln(x / all_ + 1e-12))
    entropy = T.let(weights, lambda w: T.let(total(w), lambda all_: entropy_of(w, all_)))
    most = F.when(F.size(scores) > 1, F.ln(F.size(scores).cast("double"))).otherwise(1.0)
    return F.when(F.size(scores) == 0, 1.0).otherwise(F.least(F.lit(1.0), entropy / most))


def visual_from_sequence(score: Column, rank: Column) -> Column:
    """A cautious visual score from a decoder's log probability and rank."""
    return clip((1.0 / (1.0 + F.exp(-(score + 1.5) / 1.5))) * F.greatest(F.lit(0.55), 1.0 - 0.08 * (rank - 1)), 0.02, 0.95)


def print_visual(score: Column) -> Column:
    return clip(score, 0.55, 0.95)


def print_hint_visual(score: Column) -> Column:
    """A print engine's word on handwriting counts little."""
    return F.least(F.lit(0.32), F.greatest(F.lit(0.05), score * 0.35))


def log_score(visual: Column) -> Column:
    return F.ln(F.greatest(visual, F.lit(1e-3)))


def quality_class(blur: Column, contrast: Column, noise: Column, resolution: Column) -> Column:
    points = (
        F.when(blur >= 120, 2).when(blur >= 60, 1).otherwise(0)
        + F.when(contrast >= 45, 2).when(contrast >= 25, 1).otherwise(0)
        + F.when(noise <= 12, 2).when(noise <= 22, 1).otherwise(0)
        + F.when(resolution >= 150, 1).otherwise(0)
    )
    return F.when(points >= 6, "good").when(points >= 4, "fair").when(points >= 2, "poor").otherwise("unusable")


def quality_risk(quality: Column) -> Column:
    return F.when(quality == "good", 0.1).when(quality == "fair", 0.3).when(quality == "poor", 0.55).when(quality == "unusable", 0.85).otherwise(0.3)


def begins_with_digit(text: Column) -> Column:
    """One of 0 to 9 comes first: without it, no pattern that begins with a digit need be tried."""
    return F.substring(text, 1, 1).between("0", "9")


def is_date(text: Column) -> Column:
    return begins_with_digit(F.ltrim(text)) & F.replace(text, F.lit(" "), F.lit("")).rlike(DATE_PATTERN)


def language_plausibility(text: Column, terms: tuple[str, ...] = LEXICON) -> Column:
    score = (
        F.lit(0.4)
        + F.when(text.rlike("[A-Za-z]{2,}"), 0.2).otherwise(0.0)
        + F.when(is_date(text) | (begins_with_digit(text) & text.rlike(QUANTITY_PATTERN)), 0.3).otherwise(0.0)
        + F.when((F.length(text) <= max(map(len, terms), default=0)) & F.lower(text).isin(*terms), 0.2).otherwise(0.0)
        - F.when(text.contains("?") | (F.substring_index(text, ".", 3) != text), 0.15).otherwise(0.0)
    )
    score = F.when(text.startswith("ink@"), 0.1).otherwise(score)
    return F.when((text == "") | (text == T.ILLEGIBLE_TEXT), 0.0).otherwise(clip(score))


def domain_score(text: Column, terms: tuple[str, ...] = LEXICON, found: Column | None = None) -> Column:
    """A score for the text's terms and units. ``found``: how many words and how many of these it has, where that is known."""
    counts = lambda found: F.array(F.size(found), F.size(F.filter(found, lambda t: t.isin(*terms, *UNITS))))

    def score(n: Column) -> Column:
        words, hits = n[0], n[1]
        return F.when(words == 0, 0.0).when(hits > 0, F.least(F.lit(1.0), 0.35 + 0.2 * hits)).when(is_date(text), 0.7).otherwise(0.0)

    return T.let(T.let(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), counts) if found is None else found, score)


def format_repair(text: Column, ascii_only: bool = False) -> Column:
    """Struct (text, edit): dates, units and slashes in their usual form; small slips of units and of the Rx sign mended."""
    return T.let(T.normalize_candidate(text, ascii_only), _formatted)


def _formatted(t: Column) -> Column:
    compact = F.replace(t, F.lit(" "), F.lit(""))
    date = F.concat_ws("/", F.lpad(F.regexp_extract(compact, DATE_PATTERN, 1), 2, "0"), F.lpad(F.regexp_extract(compact, DATE_PATTERN, 2), 2, "0"), F.regexp_extract(compact, DATE_PATTERN, 3))
    unit_pattern = r"(?i)^(\d+(?:\.\d+)?)(mg|ml|g|kg|mcg|iu|mm|cm)$"
    unit = F.concat_ws(" ", F.regexp_extract(t, unit_pattern, 1), F.lower(F.regexp_extract(t, unit_pattern, 2)))
    slash_pattern = r"^(\d+(?:\.\d+)?)\s+/\s+(\d+(?:\.\d+)?)$"
    slash = F.concat_ws("/", F.regexp_extract(t, slash_pattern, 1), F.regexp_extract(t, slash_pattern, 2))
    slip = SLIP_PATTERN
    number, some_number = begins_with_digit(t), t.rlike("[0-9]")
    slipped = some_number & t.rlike(slip)
    plain = ~t.rlike("[0-9RPB]")
    prefixed = lambda u: (u.contains("Rai") | u.contains("Ri") | u.contains("Px") | u.contains("Bx")) & u.rlike(PREFIX_PATTERN)
    units = F.when(slipped, F.regexp_replace(t, slip, "$1 mg")).otherwise(t)
    mended = lambda u: result(F.regexp_replace(u, PREFIX_PATTERN, "Rx"), F.when(slipped, "unit_repair").otherwise("rx_prefix_repair"))
    unprefixed = lambda u: F.when(prefixed(u), mended(u)).otherwise(result(u, F.when(slipped, "unit_repair")))

    def result(value: Column, name: Column) -> Column:
        return F.struct(value.alias("text"), name.cast("string").alias("edit"))

    return (
        F.when(plain, result(t, F.lit(None)))
        .when(number & compact.rlike(DATE_PATTERN) & (date != t), result(date, F.lit("date_format")))
        .when(number & t.rlike(unit_pattern) & (unit != t), result(unit, F.lit("unit_spacing")))
        .when(number & t.rlike(slash_pattern) & (slash != t), result(slash, F.lit("slash_normalize")))
        .otherwise(T.let(units, unprefixed))
    )


def indel_ratio(a: str, b: str) -> float:
    """Similarity in per cent: what two texts keep when only insertions and deletions count."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], (last + 1 if x == y else max(row[j], row[j - 1]))
    return 200.0 * row[-1] / (len(a) + len(b))


@lru_cache(maxsize=10_000)
def _kinds(text: str) -> frozenset[str]:
    return frozenset(text)


def _may_reach(low: str, own: frozenset[str], term: str, least: float) -> bool:
    """Whether :func:`indel_ratio` may be ``least``: characters that the other text lacks are not kept."""
    other = _kinds(term)
    kept = min(len(low) - len(own - other), len(term) - len(other - own))
    return 200.0 * kept >= least * (len(low) + len(term)) - 1e-6


def repair_word(word: str, lexicon: Sequence[str], settings: RerankSettings) -> tuple[str, str | None]:
    """The word, or its near-exact lexicon entry in the word's case; and the kind of edit."""
    low = word.lower()
    if low in ABBREVIATIONS:
        to = ABBREVIATIONS[low]
        return to, "abbrev" if to != word else None
    if low in lexicon or len(low) <= 4:
        return word, None
    own = _kinds(low)
    near = [(indel_ratio(low, term), -i, term) for i, term in enumerate(lexicon) if abs(len(term) - len(low)) <= 3 and _may_reach(low, own, term, settings.min_fuzz_score)]
    best = max(near, default=(0.0, 0, ""))
    term = best[2]
    if best[0] < settings.min_fuzz_score or abs(len(term) - len(low)) > 1:
        return word, None
    edits = _edits(low, term) / max(len(low), len(term))
    if edits > settings.max_token_distance:
        return word, None
    to = term.upper() if word.isupper() else term.capitalize() if word[0].isupper() else term
    return to, "lexicon_near_exact" if to != word else None


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def lexicon_repair(terms: tuple[str, ...] = LEXICON, settings: RerankSettings | None = None):
    """Pandas UDF: struct (text, edits) with near-exact lexicon words put right."""
    chosen = settings or RerankSettings()

    @F.pandas_udf("text string, edits int")
    def repair(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            yield pd.DataFrame(_mend(list(series), terms, chosen), columns=["text", "edits"])

    return repair


_PARTS, _WORDS = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]+").findall, re.compile("[A-Za-z0-9]+").findall


def _letters(words: list[str]) -> np.ndarray:
    """A bit for each letter from a to z of the words, all in lower case and none of them empty."""
    sizes = np.array([len(w) for w in words])
    places = np.frombuffer("".join(words).encode("ascii", "replace"), dtype=np.uint8).astype(np.int32) - ord("a")
    bits = np.where((places >= 0) & (places < 26), np.left_shift(1, places & 31), 0).astype(np.uint32)
    return np.bitwise_or.reduceat(bits, np.cumsum(sizes) - sizes)


def _maybe_near(words: list[str], lexicon: list[str], least: float) -> np.ndarray:
    """Whether :func:`indel_ratio` may reach ``least`` for some term: letters that the other text lacks are not kept."""
    sizes, own = np.array([len(w) for w in words]), _letters(words)
    near = np.zeros(len(words), dtype=bool)
    for term, letters in zip(lexicon, _letters(lexicon)):
        kept = np.minimum(sizes - np.bitwise_count(own & ~letters), len(term) - np.bitwise_count(letters & ~own).astype(np.int64))
        near |= 200.0 * kept >= least * (sizes + len(term)) - 1e-6
    return near


#: Words whose repairs a worker remembers.
WORDS_KEPT = 200_000


@lru_cache(maxsize=4)
def _repairs_kept(lexicon: tuple[str, ...], chosen: RerankSettings) -> tuple[set[str], dict[str, tuple[str, str | None]]]:
    """The words that were weighed in this worker, and repairs of those that have one."""
    return set(), {}


def _wrong(words: set[str], terms: tuple[str, ...], chosen: RerankSettings) -> dict[str, tuple[str, str | None]]:
    """Repairs of the words that have one. Words are weighed once, those that no term is near all together."""
    lexicon = tuple(sorted({t.lower() for t in terms if t}))
    weighed, wrong = _repairs_kept(lexicon, chosen)
    if len(weighed) > WORDS_KEPT:
        weighed.clear(), wrong.clear()
    new = words - weighed
    long = [w for w in new if len(w) > 4 and w.isalpha()]
    asked = [w for w in new if len(w) <= 4 and w.lower() in ABBREVIATIONS]
    if long and lexicon:
        asked += [w for w, near in zip(long, _maybe_near([w.lower() for w in long], lexicon, chosen.min_fuzz_score)) if near or w.lower() in ABBREVIATIONS]
    wrong |= {w: to for w in asked if (to := repair_word(w, lexicon, chosen)) != (w, None)}
    weighed |= new
    return {w: wrong[w] for w in words & wrong.keys()}


def _mend(texts: list[str | None], terms: tuple[str, ...], chosen: RerankSettings, words: list[list[str]] | None = None) -> list[tuple[str, int]]:
    """Texts with near-exact lexicon words put right, and the numbers of edits. ``words``: theirs, where they are at hand."""
    if not chosen.lexicon_enabled:
        return [(t or "", 0) for t in texts]
    words = [_WORDS(t or "") for t in texts] if words is None else words
    wrong, out = _wrong(set().union(*words), terms, chosen), []
    for t, own in zip(texts, words):
        if not wrong or wrong.keys().isdisjoint(own):
            out.append((t or "", 0))
            continue
        parts = [wrong.get(part, (part, None)) for part in _PARTS(t)]
        out.append(("".join(p for p, _ in parts), sum(kind is not None for _, kind in parts)))
    return out


_TERMS, _HINTS = frozenset((*LEXICON, *UNITS)), frozenset(DOMAIN_HINTS)
_COUNT = _TERMS | _HINTS
@lru_cache(maxsize=1)
def _telling_kept() -> tuple[set[str], set[str]]:
    """The words that were looked up in this worker, and those of them that are terms, units or hints."""
    return set(), set()


def _telling(words: set[str]) -> set[str]:
    seen, telling = _telling_kept()
    if len(seen) > WORDS_KEPT:
        seen.clear(), telling.clear()
    new = words - seen
    telling |= {w for w in new if w.lower() in _COUNT}
    seen |= new
    return words & telling


def _domain_words(texts: list[str | None], words: list[list[str]]) -> list[list[int]]:
    """What :func:`domain_score` and :func:`domain_hint` ask of texts: numbers of words, of terms and units, and of different hints. ``words``: those of letters and digits."""
    # two characters beyond ASCII become letters from a to z
    words = [re.findall("[a-z0-9]+", t.lower()) if t and ("\u212a" in t or "\u0130" in t) else own for t, own in zip(texts, words)]
    telling, out = _telling(set().union(*words)), []
    for own in words:
        low = [] if telling.isdisjoint(own) else [w.lower() for w in own if w in telling]
        out.append([len(own), sum(w in _TERMS for w in low), len(_HINTS.intersection(low))])
    return out


def tags_of(filename: Column, states: Column, regions: Column) -> Column:
    """Difficulty tags guessed from a file's name and what was found on it."""
    name = F.lower(filename)
    form = name.contains("script") | name.contains("example")
    hand = F.array_contains(regions, "main_handwriting")
    parts = [
        F.when(name.contains("whatsapp"), "phone_capture"),
        F.when(form, "annotations"),
        F.when(form | F.array_contains(regions, "table"), "form"),
        F.when(F.array_contains(states, T.CROSSED_OUT), "crossed_out"),
        F.when(F.array_contains(regions, "margin_note"), "margin_notes"),
        F.when(F.array_contains(regions, "printed_text") & hand, "mixed_print_hw"),
        F.when(hand, "extreme"),
        F.when(hand, "cursive"),
    ]
    found = F.array_sort(F.array_compact(F.array(*parts)))
    return F.when(F.size(found) == 0, F.array(F.lit("medical"))).otherwise(found)


def greatest_of(columns: list[Column]) -> Column:
    return reduce(F.greatest, columns) if len(columns) > 1 else columns[0]
