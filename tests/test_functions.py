"""Text, scores, geometry and layout."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.config import BoxThresholds, DecisionThresholds, RerankSettings, from_env
from quillstone.functions import geometry as G
from quillstone.functions import scores as S
from quillstone.functions import text as T
from quillstone.operators import layout, providers


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates(spark):
    pairs = [("abc", "abd"), ("", "x"), ("", ""), ("hello", "hallo"), ("été", "ete")]
    got = one(spark, pairs, "r string, h string", T.cer(F.col("r"), F.col("h")))
    assert [x for (x,) in got] == pytest.approx([1 / 3, 1, 0, 0.2, 2 / 3])
    rng = random.Random(1)
    words = [" ".join(rng.choice("a b c d e ff gg".split()) for _ in range(rng.randint(0, 9))) for _ in range(120)]
    pairs = list(zip(words[:60], words[60:])) + [("a b c", "a x c")]
    got = one(spark, pairs, "r string, h string", T.wer(F.col("r"), F.col("h")))
    for (r, h), (x,) in zip(pairs, got):
        want = edits(r.split(), h.split()) / len(r.split()) if r.split() else float(bool(h.split()))
        assert x == pytest.approx(want)


def test_lines_and_predicates(spark):
    rows = [("Hello  World", "hello world"), ("", "[ILLEGIBLE]"), ("", "x"), ("abcdefghij", "abcdefghix"), ("abcdefghij", "abcdefghxx")]
    assert [x for (x,) in one(spark, rows, "r string, h string", T.line_correct(F.col("r"), F.col("h")))] == [True, True, False, True, False]
    texts = [("",), ("-",), ("...",), ("aaaa",), ("a a a",), ("ok",), (None,), ("é",)]
    assert [x for (x,) in one(spark, texts, "t string", T.is_garbage(F.col("t")))] == [True, True, True, True, True, False, True, True]
    assert [x for (x,) in one(spark, [("abc",), ("a1",), ("Jordan",), ("ABCD",), ("ABC",), ("٣",)], "t string", T.is_high_risk(F.col("t")))] == [False, True, True, True, False, True]
    assert one(spark, [("ﬁx  it ",)], "t string", T.normalize_candidate(F.col("t"))) == [("fix it",)]
    assert one(spark, [("accepted",), ("no",)], "t string", T.parse_state(F.col("t"))) == [("ACCEPTED",), (None,)]
    assert one(spark, [('x {"a": {"b": 1}} y',), ("none",)], "t string", T.json_salvage(F.col("t"))) == [('{"a": {"b": 1}}',), (None,)]


def test_repairs(spark):
    given = ["1-2-2024", "500MG", "3  /  4", "take 500 mq", "Rai 5", "plain  x"]
    got = one(spark, [(g,) for g in given], "t string", S.format_repair(F.col("t"))["text"], S.format_repair(F.col("t"))["edit"])
    assert got == [("01/02/2024", "date_format"), ("500 mg", "unit_spacing"), ("3/4", "slash_normalize"), ("take 500 mg", "unit_repair"), ("Rx 5", "rx_prefix_repair"), ("plain x", None)]
    words = ["amoxicilin", "Amoxicilin", "AMOXICILIN", "dr", "bird", "zebra", "patient", "dosa"]
    got = one(spark, [(w,) for w in words], "t string", S.lexicon_repair()("t")["text"])
    assert [x for (x,) in got] == ["amoxicillin", "Amoxicillin", "AMOXICILLIN", "Dr", "bird", "zebra", "patient", "dosa"]
    assert S.indel_ratio("abcd", "abxd") == pytest.approx(75.0) and S.indel_ratio("", "") == 100.0


def test_scores(spark):
    assert one(spark, [([0.5, 0.5],), ([],), ([3.0],)], "s array<double>", S.softmax_entropy(F.col("s")))[0][0] == pytest.approx(1.0)
    got = one(spark, [(130.0, 50.0, 10.0, 160.0), (0.0, 0.0, 99.0, 10.0)], "a double, b double, c double, d double", S.quality_class(*map(F.col, "abcd")))
    assert got == [("good",), ("unusable",)]
    tags = one(spark, [("WhatsApp example.png", ["CROSSED_OUT"], ["main_handwriting", "printed_text"]), ("x.png", [], [])], "f string, s array<string>, r array<string>", S.tags_of(F.col("f"), F.col("s"), F.col("r")))
    assert tags == [(["annotations", "crossed_out", "cursive", "extreme", "form", "mixed_print_hw", "phone_capture"],), (["medical"],)]


def test_boxes(spark):
    frame = spark.createDataFrame([(10, 10, 580, 780, 1), (20, 95, 400, 40, 1), (20, 95, 400, 40, 5), (5, 5, 8, 6, 1)], "x int, y int, w int, h int, n int")
    b = G.box(*map(F.col, "xywh"))
    got = frame.select(G.check_box(b, F.lit(600), F.lit(800), F.lit(0.1), F.col("n"), F.lit(None).cast("int")).alias("c")).collect()
    assert [(r.c.ok, r.c.needs_split, r.c.blocked) for r in got] == [(False, True, True), (True, False, False), (False, True, True), (False, False, False)]
    assert got[0].c.flags[0] == "excessive_area" and got[3].c.reason == "too_tiny"
    poly = spark.createDataFrame([([[1.0, 2.0], [4.0, 8.0], [3.0, 3.0]],)], "p array<array<double>>").select(G.box_of_polygon(F.col("p")).alias("b")).first().b
    assert tuple(poly) == (1.0, 2.0, 3.0, 6.0)
    crop = frame.limit(1).select(G.crop(b, F.lit(600), F.lit(800)).alias("c")).first().c
    assert tuple(crop) == (6.0, 6.0, 588.0, 788.0)
    assert one(spark, [("Print",), ("margin-note",), ("sketch",), (None,)], "t string", G.parse_region(F.col("t"))) == [("printed_text",), ("margin_note",), ("unknown",), ("unknown",)]
    assert one(spark, [("RX",), ("Lab Report",), ("?",)], "t string", G.parse_category(F.col("t"))) == [("prescription",), ("lab_report",), ("unknown",)]


def test_layout_conflict_keeps_handwriting(spark):
    row = ((10.0, 10.0, 100.0, 30.0), "main_handwriting", "handwriting", 0.5, 0.5, [([0.0, 0.0, 0.3, 0.1], "printed_text")], "other", 400, 400)
    schema = "bbox struct<x:double,y:double,width:double,height:double>, region_type string, script_mode string, irregularity double, print_score double, hints array<struct<box:array<double>,region_type:string>>, category string, page_w int, page_h int"
    out = layout.apply_hints(spark.createDataFrame([row], schema)).first()
    assert out.region_type == "main_handwriting"
    none = row[:5] + ([],) + ("form", 400, 400)
    out = layout.apply_hints(spark.createDataFrame([none], schema)).first()
    assert (out.layout_source, out.region_type) == ("category_ignored_handwriting", "main_handwriting")
    sure = (row[0], "main_handwriting", "print", 0.1, 0.95, [], "form", 400, 400)
    assert layout.apply_hints(spark.createDataFrame([sure], schema)).first().region_type == "printed_text"


def test_pixels(spark):
    import numpy as np

    page = np.full((60, 80), 255, dtype=np.uint8)
    page[10:18, 5:75] = 0
    page[35:43, 5:75] = 0
    data = providers.encode_pgm(page)
    assert (providers.decode_image(data) == page).all()
    assert providers.line_bands(page) == 2 and providers.split_bands(page) == [(10, 18), (35, 43)]
    row = spark.createDataFrame([(bytearray(data),), (bytearray(b"junk"),)], "image binary").select(providers.page_measures("image").alias("m")).collect()
    assert (row[0].m.width, row[0].m.bands) == (80, 2) and row[1].m.width is None
    read = providers.recogniser(providers.with_fallback(providers.mock_recogniser, lambda: lambda image, options: [("text", -1.0)]))
    assert spark.createDataFrame([(bytearray(data),)], "image binary").select(read("image").alias("h")).first().h[0].text == "text"
    off = providers.verifier(None)
    assert spark.createDataFrame([(bytearray(data), ["a"])], "i binary, t array<string>").select(off("i", "t").alias("v")).first().v.status == "unavailable"
    on = providers.verifier(lambda: lambda image, texts: {"index": 7})
    assert spark.createDataFrame([(bytearray(data), ["a"])], "i binary, t array<string>").select(on("i", "t").alias("v")).first().v.status == "disagreement"


def test_settings(monkeypatch):
    monkeypatch.setenv("QUILLSTONE_ACCEPTED_MIN_SCORE", "0.9")
    assert from_env(DecisionThresholds).accepted_min_score == 0.9
    assert from_env(BoxThresholds).max_projected_lines == 2
    assert DecisionThresholds().as_numbers()["consensus_min_support"] == 1.0


def _recount(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits_of_long_texts(spark):
    rng = random.Random(11)
    rows = [("".join(rng.choice("aé b\U0001f600") for _ in range(n)), "".join(rng.choice("aé bc") for _ in range(m))) for n, m in ((0, 0), (0, 300), (300, 0), (150, 199), (201, 40), (400, 390), (64, 201), (260, 260))]
    rows += [(rows[5][0], rows[5][0]), (None, "a"), (None, "b" * 300)]
    got = [r.n for r in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(T.edits(F.col("a"), F.col("b")).alias("n")).collect()]
    assert got == [None if a is None else _recount(a, b) for a, b in rows]
    array = [["abc" * 100, "abd" * 100, "", "x"], ["ab", "b", "ab"], [], None]
    got = [r.n for r in spark.createDataFrame([(a,) for a in array], "a array<string>").coalesce(1).select(T.pair_edits(F.col("a")).alias("n")).collect()]
    assert got[:3] == [[_recount(a, b) for a in row for b in row] for row in array[:3]]


def test_word_error_rate_of_many_words(spark):
    left = [f"w{i}" for i in range(40_000)]
    right = left[:100] + ["new"] + left[102:] + ["more"]
    few = ["a b b c", "b b a c d"]
    rows = [(" ".join(left), " ".join(right)), tuple(few), ("", "x"), (" ", ""), ("a", "a")]
    got = one(spark, rows, "r string, h string", T.wer(F.col("r"), F.col("h")))
    assert [g[0] for g in got] == [3 / 40_000, _recount(few[0].split(), few[1].split()) / 4, 1.0, 0.0, 0.0]
    words = [random.Random(k).choices("abcdefgh", k=250 + k) for k in (1, 2)]
    got = one(spark, [(" ".join(words[0]), " ".join(words[1]))], "r string, h string", T.wer(F.col("r"), F.col("h")))
    assert got[0][0] == _recount(*words) / 251


def test_recogniser_keeps_errors(spark):
    def broken():
        def read(image, options):
            raise ValueError(f"beams {options['beams']}")

        return read

    rows = spark.createDataFrame([(b"x",), (None,)], "image binary").coalesce(1)
    got = [r.h for r in rows.select(providers.recogniser(broken, providers.FULL)("image").alias("h")).collect()]
    assert [(h.text, h.error) for h in got[0]] == [("", "ValueError: beams 8")] and got[1] == []
    assert rows.select(providers.visual(F.get(providers.recogniser(broken)("image"), F.lit(0))).alias("v")).first().v == 0.0


def test_sticky_fallback():
    calls = []

    def first():
        def read(image, options):
            calls.append(image)
            if image == 1:
                raise OSError
            return [("first", 0.0)]

        return read

    second = lambda: lambda image, options: [("second", 0.0)]
    for sticky, want in ((False, ["first", "second", "first"]), (True, ["first", "second", "second"])):
        calls.clear()
        read = providers.with_fallback(first, second, sticky)()
        assert [read(i, {})[0][0] for i in range(3)] == want and len(calls) == (2 if sticky else 3)


def test_readiness(spark):
    def missing():
        raise ImportError("no weights")

    got = {r.provider: (r.ready, r.problem) for r in providers.readiness(spark, {"mock": providers.mock_recogniser, "big": missing}).collect()}
    assert got == {"mock": (True, None), "big": (False, "ImportError: no weights")}


def test_png():
    rng = np.random.default_rng(2)
    for shape in ((1, 1), (7, 5), (4, 6, 3)):
        pixels = rng.integers(0, 256, shape).astype(np.uint8)
        data = providers.encode_png(pixels)
        assert (providers.decode_png(data) == pixels).all() and providers.decode_image(data).shape == shape[:2]
    # every way in which a row may be written
    rows = rng.integers(0, 256, (5, 6)).astype(np.int64)
    body = b""
    for how, row in enumerate(rows):
        above = rows[how - 1] if how else np.zeros(6, np.int64)
        left, corner = np.append(0, row[:-1]), np.append(0, above[:-1])
        paeth = [min((a, b, c), key=lambda v: abs(a + b - c - v)) for a, b, c in zip(left, above, corner)]
        body += bytes([how]) + ((row - [0 * row, left, above, (left + above) // 2, np.array(paeth)][how]) & 255).astype(np.uint8).tobytes()
    plain = providers.encode_png(rows)
    at = plain.index(b"IDAT") - 4
    data = zlib.compress(body)
    made = plain[:at] + struct.pack(">I", len(data)) + b"IDAT" + data + struct.pack(">I", zlib.crc32(b"IDAT" + data)) + plain[plain.index(b"IEND") - 4 :]
    assert (providers.decode_png(made) == rows).all()


def test_understanding(spark):
    from quillstone.operators import understanding

    rows = [("d", 1, '{"category": "poem", "line_items": [{"text": "b"}]}'), ("d", 0, "none"), ("d", 2, '{"category": "rx", "category_confidence": 7, "layout_regions": [{"type": "margin", "bbox": [0, 0, 1, 1]}]}'), ("e", 0, None)]
    views = understanding.page_views(spark.createDataFrame(rows, "document_id string, page_index int, reply string"))
    got = understanding.documents(views).collect()
    assert [(r.document_id, r.pages, r.category, r.confidence, [i.text for i in r["items"]], [h.region_type for h in r.hints]) for r in got] == [("d", 2, "unknown", 0.0, ["b"], ["margin_note"])]


def test_decode_artefacts_beyond_ascii(spark):
    got = one(spark, [("a b c",), ("pé bé cé",), ("é a b",)], "t string", T.has_decode_artefacts(F.col("t")))
    assert [g[0] for g in got] == [True, False, False]


def test_edits_side_by_side():
    rng = random.Random(19)
    make = lambda n: "".join(rng.choice("abé \U0001f600") for _ in range(n))
    pairs = [(make(rng.randint(0, 210)), make(rng.randint(0, 210))) for _ in range(250)]
    pairs += [(make(64), make(64)) for _ in range(20)] + [(make(63), make(65)) for _ in range(20)] + [(make(128), make(129)) for _ in range(20)] + [(make(2300), make(2200)), ("", ""), ("a", ""), ("b" * 70, "b" * 70)]
    for a, b in pairs[:60]:
        at = rng.randrange(len(a) + 1)
        pairs.append((a, a[:at] + b[:3] + a[at + 2 :]))
    assert T._edit_counts(pairs) == [_recount(a, b) for a, b in pairs]


def test_edits_whose_bounds_meet():
    rng = random.Random(23)
    pairs = []
    for k in range(60):
        a = "".join(rng.choice("aeßst ou中" if k % 2 else "aesß tou") for _ in range(rng.randint(1, 90)))
        pairs += [(a, a.replace("e", "o")), (a, a.upper()), (a.replace("s", "f"), a.upper()), (a, a[::-1]), (a, "".join(chr(0x4E00 + 256 * (ord(c) % 64)) for c in a))]
    many_kinds = ["".join(chr(0x4E00 + rng.randrange(900)) for _ in range(400)) for _ in range(4)]
    pairs += [(many_kinds[k], many_kinds[k - 1]) for k in range(4)]
    pairs = [(a, b) for a, b in pairs if a != b]
    got = T._by_bounds(pairs)
    assert all(n in (-1, _recount(a, b)) for n, (a, b) in zip(got, pairs))
    # long texts of which single characters were replaced, words grew, or all letters are others, need no table of edits
    long = "die große Straße, näher am Fluß als gedacht; " * 400
    many = [(long, long.upper()), (long, long.replace("e", "o")), (long.replace("s", "f"), long.replace("a", "0")), ("", long)]
    assert T._by_bounds(many) == [sum(c.islower() for c in long) + long.count("ß"), long.count("e"), long.count("s") + long.count("a"), -1]
    assert T._by_bounds([]) == []


def test_softmax_entropy_of_no_scores(spark):
    got = one(spark, [([],), ([0.5],), ([0.2, 0.9],)], "s array<double>", S.softmax_entropy(F.col("s")))
    assert got[0][0] == 1.0 and got[1][0] == pytest.approx(0.0, abs=1e-9) and 0.9 < got[2][0] < 1.0


def test_composition_leaves_ascii_texts(spark):
    got = one(spark, [("abc",), ("ﬁn",), (None,), ("",), ("é",)], "t string", T.nfkc(F.col("t")))
    assert [g[0] for g in got] == ["abc", "fin", None, "", "é"]


def test_lexicon_by_force():
    rng = random.Random(6)
    settings, words = RerankSettings(), []
    for _ in range(400):
        w = list(rng.choice(S.LEXICON))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [w[k], rng.choice("aeilnrst")], [rng.choice("aeilnrst")]])
        words.append(rng.choice([str.lower, str.upper, str.capitalize])("".join(w) or "x"))
    words += ["dr", "NKDA", "4mg", "zzzzzzzz", None, ""]
    lexicon = sorted(S.LEXICON)
    want = [("", 0) if not w else (w, 0) if not w.isalpha() else (lambda to, kind: (to, int(kind is not None)))(*S.repair_word(w, lexicon, settings)) for w in words]
    assert S._mend(words, S.LEXICON, settings) == want
    assert S._mend([" ".join(filter(None, words))], S.LEXICON, settings) == [(" ".join(t for t, _ in want if t), sum(n for _, n in want))]
