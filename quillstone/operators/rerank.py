"""Safe reranking of a line's hypotheses: known candidates and near-exact repairs of them, nothing invented."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from quillstone.config import RerankSettings
from quillstone.functions import scores as S
from quillstone.functions import text as T
from quillstone.operators.fusion import is_hand

MAX_INVENTION = 0.22


def _formats(h: Column, f: Column) -> Column:
    """Whether ``f``, the usual form of a hypothesis's text, is to stand for it."""
    return F.coalesce(f["edit"].isNotNull() & (f["text"] != h["text"]), F.lit(False))


def _clone(h: Column, text: Column, boost: Column, ascii_only: bool) -> Column:
    return F.struct(
        text.alias("text"), T.squeeze_blanks(text).alias("normalized_text"), F.least(F.lit(0.95), h["visual"] + boost).alias("visual"),
        h["variant"].alias("variant"), h["model"].alias("model"), h["family"].alias("family"), F.lit(True).alias("safe_edit"),
    )


def _looked_at(chosen: RerankSettings):
    """What the worker adds to a batch of lines; its texts are those of :func:`with_repairs`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, T.ROWS_AT_ONCE):
                some = batch.slice(first, T.ROWS_AT_ONCE)
                fields = some.column("hyps").flatten()
                sizes = some.column("hyps").value_lengths().to_pylist()
                parts = [fields.field("text"), fields.field("normalized_text"), *(some.column(c).flatten() for c in ("_formatted", "usual", "_hand"))]
                texts, normal, formatted, usual, hand = (p.to_numpy(zero_copy_only=False).tolist() for p in parts)
                made = _pools(sizes, texts, normal, [t if f is None else f for t, f in zip(texts, formatted)], usual, hand, chosen)
                kept = {n: some.column(n) for n in batch.schema.names if n not in ("_formatted", "_hand")}
                yield pa.RecordBatch.from_arrays([*kept.values(), *(pa.array(x, kind) for x, kind in zip(zip(*made), _MADE.values()))], names=[*kept, *_MADE])

    return work


_MADE = {
    "_fixed": pa.list_(pa.struct([("place", pa.int32()), ("text", pa.string()), ("edits", pa.int32())])), "nearest": pa.list_(pa.float64()), "hyp_edits": pa.list_(pa.int32()), "hyp_words": pa.list_(pa.list_(pa.int32())),
}


def _pools(sizes: list, texts: list, normal: list, formatted: list, usual: list, hand: list, chosen: RerankSettings) -> list[tuple]:
    """For each line: repairs that stay near their source with their places; how far each text of the pool is from the nearest of those recognised; all edits between texts of those that are ranked, and their words.

    Lines have ``sizes`` texts. A repair is in its usual form already: words put
    right make no date, quantity or slip, so that the pool needs no second look.
    """
    words = [S._WORDS(f or "") for f in formatted]
    mended, begins = S._mend(formatted, S.LEXICON, chosen, words), [0, *accumulate(n or 0 for n in sizes)]
    changed = [bool(h) and t is not None and t != "" and m != t for h, t, (m, _) in zip(hand, texts, mended)]
    asked = list({(m, n): 0 for c, (m, _), n in zip(changed, mended, normal) if c and n is not None and m != n})
    known = {(a, b): n / max(len(a), len(b)) for (a, b), n in zip(asked, T._edit_counts(asked))}
    good = [c and n is not None and known.get((m, n), 0.0) <= chosen.max_token_distance + 0.05 for c, (m, _), n in zip(changed, mended, normal)]
    shown, works = ([b if u is None else u for u, b in zip(usual, own)] for own in (texts, normal))
    fixed_words = dict(zip(fixed := list({m for g, (m, _) in zip(good, mended) if g}), S._domain_words(fixed, [S._WORDS(m) for m in fixed])))
    shown_words = S._domain_words(shown, [w if t == f else S._WORDS(t or "") for t, f, w in zip(shown, formatted, words)])
    own_words = S._domain_words(texts, [w if t == f else S._WORDS(t or "") for t, f, w in zip(texts, formatted, words)]) if shown != texts else shown_words
    out, pools = [], []
    for size, a, b in zip(sizes, begins, begins[1:]):
        fixed = [{"place": i - a, "text": mended[i][0], "edits": mended[i][1]} for i in range(a, b) if good[i]]
        out.append(fixed)
        pools.append(None if size is None else ([*works[a:b], *(f["text"] for f in fixed)], ["" if t is None else t for t in normal[a:b]]))
    nearest = T._nearest(pools)
    ranked = [p is not None and any(x is not None and x <= MAX_INVENTION for x in near) for p, near in zip(pools, nearest)]
    edits = T._square([None if p is None else p[0] if r else p[1] for p, r in zip(pools, ranked)])
    told = [[*shown_words[a:b], *(fixed_words[f["text"]] for f in fixed)] if r else own_words[a:b] for a, b, fixed, r in zip(begins, begins[1:], out, ranked)]
    return [(None, None, None, None) if size is None else row for size, *row in zip(sizes, out, nearest, edits, told)]


def with_repairs(lines: DataFrame, key: list[str], settings: RerankSettings | None = None, ascii_only: bool = False, use_lexicon: bool = True) -> DataFrame:
    """Append to ``hyps`` the repaired forms of handwriting candidates that stay near their source.

    The lexicon needs a Python worker: only when ``use_lexicon`` is set, texts of
    all candidates go through it, a line's as one array, and come back with all
    distances and words that ranking and fusion ask for, ``nearest``,
    ``hyp_edits`` and ``hyp_words``;
    ``usual`` has the texts whose usual form is another one in that form. One
    worker does it all, and rows go through it: rows that wait for workers fill
    memory, then disk. ``key`` names a line; no line leaves its row.
    ``composed``, where present, are the Unicode compositions of the texts.
    """
    chosen = settings or RerankSettings()
    if use_lexicon and chosen.lexicon_enabled:
        texts = F.transform("hyps", lambda h: h["text"])
        given = F.col("composed") if "composed" in lines.columns else T.nfkc_all(texts)
        composed = lines.withColumn("_composed", T.kept(texts if ascii_only else given)).drop("composed")
        own = F.transform("hyps", lambda h: S.format_repair(h["text"], True))
        there = composed.withColumn("_own", T.kept(own))
        # of texts that are like others only one is sent
        formatted = F.zip_with(F.zip_with("_composed", "_own", lambda t, o: F.struct(t.alias("t"), o["text"].alias("o"))), "hyps", lambda x, h: T.let(F.when(x["t"] == h["text"], x["o"]).otherwise(S.format_repair(x["t"], True)["text"]), lambda f: F.when(f != h["text"], f)))
        usual = F.zip_with("hyps", "_own", lambda h, o: F.when(_formats(h, o), o["text"]))
        sent = there.withColumns({"usual": usual, "_formatted": formatted, "_hand": F.transform("hyps", is_hand)}).drop("_composed", "_own")
        kinds = [f for f in lines.schema.fields if f.name != "composed"]
        schema = StructType([*kinds, StructField("usual", ArrayType(StringType())), *(StructField(n, from_arrow_type(k)) for n, k in _MADE.items())]).toNullable()
        back = sent.mapInArrow(_looked_at(chosen), schema)
        clone = lambda f: T.let(F.get("hyps", f["place"]), lambda h: _clone(h, f["text"], F.when(f["edits"] > 0, 0.02).otherwise(0.01), ascii_only))
        return back.withColumn("pool", T.kept(F.concat("hyps", F.transform("_fixed", clone)))).drop("_fixed")
    fixed = F.transform("hyps", lambda h: F.struct(h.alias("h"), S.format_repair(h["text"], True)["text"].alias("fixed")))
    good = F.filter(fixed, lambda x: is_hand(x["h"]) & (x["h"]["text"] != "") & (x["fixed"] != x["h"]["text"]) & (T.lambda_distance(x["fixed"], x["h"]["normalized_text"]) <= chosen.max_token_distance + 0.05))
    return lines.withColumn("pool", F.concat("hyps", F.transform(good, lambda x: _clone(x["h"], x["fixed"], F.lit(0.01), True))))


def rank(lines: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Order ``pool`` by score and put it into ``hyps``; add ``context_score``.

    ``usual``, ``nearest``, ``hyp_edits`` and ``hyp_words`` are used where :func:`with_repairs` left them.
    Candidates too far from everything that was recognised are dropped; if none is left the given order stays.
    """

    known = "nearest" in lines.columns

    def in_form(h: Column, t: Column) -> Column:
        return F.struct(t.alias("text"), t.alias("normalized_text"), h["visual"].alias("visual"), h["variant"].alias("variant"), h["model"].alias("model"), h["family"].alias("family"), F.lit(True).alias("safe_edit"))

    def formatted(h: Column, i: Column) -> Column:
        if known:  # repairs, which come after the hypotheses, are in their usual form
            return T.let(F.get("usual", i), lambda t: F.when(t.isNotNull(), in_form(h, t)).otherwise(h))
        return T.let(S.format_repair(h["text"], True), lambda f: F.when(_formats(h, f), in_form(h, f["text"])).otherwise(h))

    works = lines.withColumns({"_works": T.kept(F.transform("pool", formatted)), "_sources": T.kept(F.transform("hyps", lambda h: F.coalesce(h["normalized_text"], F.lit(""))))})
    if not known:
        # texts of known distance 0 need no count of edits
        strange = F.array_distinct(F.filter(F.transform("_works", lambda h: h["normalized_text"]), lambda t: ~F.array_contains("_sources", t)))
        works = works.withColumn("_strange", T.kept(strange))
        asked = F.size("_strange") > 0
        works = works.withColumn("_nearest", T.kept(T.nearest_distances(F.when(asked, F.col("_strange")), F.when(asked, F.col("_sources")))))
    crowded = F.when(F.size(F.array_distinct(F.filter(F.transform("hyps", lambda h: h["normalized_text"]), lambda t: t != ""))) > 3, 0.15).otherwise(0.0)
    works = works.withColumn("_crowded", T.kept(crowded))

    def scored(h: Column, i: Column) -> Column:
        away = F.get("nearest", i) if known else F.when(F.array_contains("_sources", h["normalized_text"]), 0.0).otherwise(F.get("_nearest", F.array_position("_strange", h["normalized_text"]).cast("int") - 1))
        score = h["visual"] + 0.12 * S.language_plausibility(h["text"]) + 0.08 * S.domain_score(h["text"], found=F.get("hyp_words", i) if known else None) + F.when(is_hand(h), 0.08).otherwise(-0.2) - 0.45 * away - F.col("_crowded")
        return F.struct((-score).alias("s"), i.alias("i"), away.alias("away"), h.alias("h"))

    out = works.withColumn("_kept", T.kept(F.array_sort(F.filter(F.transform("_works", scored), lambda x: x["away"] <= MAX_INVENTION))))
    ranked = F.transform("_kept", lambda x: x["h"])
    out = out.withColumn("_ranked", T.kept(F.when(F.size("_kept") > 0, ranked).otherwise(F.col("hyps"))))
    found = F.get("hyp_words", F.get("_kept", F.lit(0))["i"]) if known else None
    context = F.when(F.size("_kept") > 0, S.clip(0.35 * S.domain_score(F.get("_ranked", F.lit(0))["text"], found=found) + 0.2)).otherwise(0.0)
    new = {"context_score": context, "hyps": F.col("_ranked")}
    if known:
        places, many = F.transform("_kept", lambda x: x["i"]), F.size("_works")
        new["hyp_edits"] = F.when(F.size("_kept") > 0, T.let(places, lambda all_: F.flatten(F.transform(all_, lambda a: F.transform(all_, lambda b: F.get("hyp_edits", a * many + b)))))).otherwise(F.col("hyp_edits"))
        new["hyp_words"] = F.when(F.size("_kept") > 0, F.transform(places, lambda a: F.get("hyp_words", a))).otherwise(F.col("hyp_words"))
    return out.withColumns(new).drop("_kept", "_ranked", "pool", "usual", "nearest", "_works", "_sources", "_strange", "_nearest", "_crowded")
