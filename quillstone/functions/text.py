"""Text measures and predicates as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import combinations
from operator import ne

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers that stand for missing text, and the states of a decision.
ILLEGIBLE_TEXT = "[ILLEGIBLE]"
PLACEHOLDERS = ("", "[ILLEGIBLE]", "[REVIEW REQUIRED]", "[ILLEGIBLE].")
ACCEPTED, REVIEW, ILLEGIBLE, CROSSED_OUT = "ACCEPTED", "REVIEW_REQUIRED", "ILLEGIBLE", "CROSSED_OUT"
STATES = (ACCEPTED, REVIEW, ILLEGIBLE, CROSSED_OUT)
MAX_LINE_CER = 0.15
#: Characters or words from which a bit-parallel count of edits is faster than Spark's.
LONG = 48
#: Machine words of the shorter text up to which pairs are counted side by side; how many at once, and with how many words together.
MOST_WORDS, AT_ONCE, WORDS_AT_ONCE = 32, 4096, 1 << 16
#: Characters of texts whose bounds are taken together.
CHARACTERS_AT_ONCE = 1 << 19
#: Rows of arrays that a worker looks at together.
ROWS_AT_ONCE = 500
# What makes a text high-risk (digit, date, capitalised word, code).
HIGH_RISK_PATTERN = r"(?U)\d|[A-Z][a-z]+|[A-Z0-9]{4,}"
PLACEHOLDER_NAME_PATTERN = r"(?i)(placeholder|synthetic|opencv.?font|lorem|dummy)"

_BLANKS = r"(?U)\s+"
_STRIP = r"(?U)^\s+|\s+$"
#: First code point of the alphabet that stands for words in :func:`token_distance`.
_WORD_BASE = 0x4E00


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _STRIP, "")


@lru_cache(maxsize=1)
def _nfkc_udf():
    # not over batches of an iterator: Spark makes one pass for several columns then
    @F.pandas_udf("string")
    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))

    return compose


def _is_composed(text: Column) -> Column:
    """Texts of ASCII and of U+00C0 to U+00FF are their own compositions; others may be."""
    return (F.octet_length(text) == F.length(text)) | text.rlike(r"^[\x00-\x7F\u00C0-\u00FF]*$")


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition; no built-in does it. Only texts beyond ASCII and the letters of Latin-1 go to the worker."""
    composed = _is_composed(text)
    return F.when(composed, text).otherwise(_nfkc_udf()(F.when(~composed, text)))


@lru_cache(maxsize=1)
def _nfkc_all_udf():
    @F.pandas_udf("array<string>")
    def compose(rows: pd.Series) -> pd.Series:
        return rows.map(lambda row: row if row is None else [t if t is None else unicodedata.normalize("NFKC", t) for t in row])

    return compose


def nfkc_all(texts: Column) -> Column:
    """:func:`nfkc` of an array's texts."""
    beyond = F.coalesce(F.exists(texts, lambda t: ~_is_composed(t)), F.lit(True))
    return F.when(~beyond, texts).otherwise(_nfkc_all_udf()(F.when(beyond, texts)))


def kept(value: Column) -> Column:
    """``value``, worked out once in a step of its own: Spark does not copy what it takes for nondeterministic into the expressions that read it."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def squeeze_blanks(text: Column) -> Column:
    """No-break blanks as blanks, runs of blanks and tabs as one, ends stripped."""

    def squeezed(t: Column) -> Column:
        # most texts have nothing to squeeze, which takes less than a pattern to see
        ends = F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1))
        odd = t.contains("\u00a0") | t.contains("\t") | t.contains("  ") | ends.rlike(r"(?U)\s")
        return F.when(odd, strip(F.regexp_replace(F.regexp_replace(t, " ", " "), "[ \t]+", " "))).otherwise(t)

    return let(text, squeezed)


def normalize_candidate(text: Column, ascii_only: bool = False) -> Column:
    """A hypothesis's normal form. ``ascii_only`` keeps the plan free of Python where input is known to be ASCII."""
    return squeeze_blanks(text if ascii_only else nfkc(text))


def normalize(text: Column) -> Column:
    """Lower case, white space as single blanks, ends stripped."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _BLANKS, " "))


def _bits(places: list[int], size: int) -> int:
    if len(places) <= 4:
        return sum(1 << i for i in places)
    there = np.zeros(size, dtype=bool)
    there[places] = True
    return int.from_bytes(np.packbits(there, bitorder="little").tobytes(), "little")


def _edit_count(a: Sequence, b: Sequence) -> int:
    """Edits between two texts, or lists of words, bit-parallel: one step an item of the longer one, on numbers of as many bits as the shorter one has items."""
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if not m:
        return len(b)
    places: dict = {x: [] for x in set(a).intersection(b)}
    for i, x in enumerate(a):
        if x in places:
            places[x].append(i)
    # items that stand in a few places only are worked out when they come up, so that many different words need little memory
    at = {x: _bits(p, m) for x, p in places.items() if len(p) > 4}
    every, last = (1 << m) - 1, 1 << (m - 1)
    up, down, cost = every, 0, m
    for x in b:
        same = at[x] if x in at else _bits(places[x], m) if x in places else 0
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        right = down | (every & ~(horizontal | up))
        left = up & horizontal
        if right & last:
            cost += 1
        elif left & last:
            cost -= 1
        right = (right << 1) | 1
        up = ((left << 1) | ~(vertical | right)) & every
        down = right & vertical & every
    return cost


def _edit_counts(pairs: list[tuple[Sequence, Sequence]]) -> list[int]:
    """Edits of many pairs: of texts by :func:`_by_bounds` where that tells them; else texts of like length go side by side through :func:`_side_by_side`, the rest one by one."""
    pairs, out = list(pairs), [0] * len(pairs)
    different = [i for i, (a, b) in enumerate(pairs) if a != b]
    texts = [i for i in different if isinstance(pairs[i][0], str)]
    for i, n in zip(texts, _by_bounds([pairs[i] for i in texts])):
        out[i] = n
    like: dict[int, list[int]] = {}
    for i in different:
        a, b = pairs[i]
        if isinstance(a, str):
            if out[i] >= 0:
                continue
            pairs[i] = a, b = _middles(a, b)
        least = min(len(a), len(b))
        words = (least + 63) // 64
        if isinstance(a, str) and 0 < words <= MOST_WORDS:
            like.setdefault(words, []).append(i)
        else:
            out[i] = _edit_count(a, b)
    for words, group in like.items():
        group.sort(key=lambda i: max(map(len, pairs[i])))
        at_once = min(AT_ONCE, WORDS_AT_ONCE // words)
        for first in range(0, len(group), at_once):
            some = group[first : first + at_once]
            counts = _side_by_side([pairs[i] for i in some], words) if len(some) >= 16 else [_edit_count(*pairs[i]) for i in some]
            for i, n in zip(some, counts):
                out[i] = int(n)
    return out


def _by_bounds(pairs: list[tuple[str, str]]) -> list[int]:
    """Edits of pairs of different texts whose bounds meet, -1 for the others; time in proportion to the texts.

    Below: characters that one text has more of than the other.  Above:
    places that differ in texts of one length, else edits word by word.
    """
    out, first = [], 0
    while first < len(pairs):
        last, size = first, 0
        while last < len(pairs) and (last == first or size < CHARACTERS_AT_ONCE):
            size += len(pairs[last][0]) + len(pairs[last][1])
            last += 1
        some = pairs[first:last]
        least, most = _bounds(some)
        for (a, b), low, high in zip(some, least.tolist(), most.tolist()):
            out.append(low if low == high or low == _edits_by_words(a, b) else -1)
        first = last
    return out


def _least(pairs: list[tuple[str, str]]) -> list[int]:
    """Edits that pairs of different texts need at least."""
    return [n for first in range(0, len(pairs), 1000) for n in _bounds(pairs[first : first + 1000])[0].tolist()]


def _middles(a: str, b: str) -> tuple[str, str]:
    """Two texts without what they begin and end with alike."""

    def alike(most: int, same) -> int:
        low = 0
        while low < most:
            mid = (low + most + 1) // 2
            low, most = (mid, most) if same(low, mid) else (low, mid - 1)
        return low

    n = alike(min(len(a), len(b)), lambda low, mid: a[low:mid] == b[low:mid])
    a, b = a[n:], b[n:]
    n = alike(min(len(a), len(b)), lambda low, mid: a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low])
    return a[: len(a) - n], b[: len(b) - n]


def _bounds(pairs: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """The bounds of :func:`_by_bounds` from characters; above -1 for texts of two lengths."""
    place: dict[str, int] = {}
    left, right = (np.array([place.setdefault(p[k], len(place)) for p in pairs]) for k in (0, 1))
    sizes = np.array([len(t) for t in place])
    points = _points("".join(place))
    # more kinds of characters share a count, which keeps the bound below
    there = np.zeros(int(points.max()) + 1, dtype=bool)
    there[points] = True
    kinds = min(256, int(np.count_nonzero(there)))
    kind = ((np.cumsum(there) - 1) % kinds).astype(np.int32)[points]
    counts = np.bincount(np.repeat(np.arange(len(sizes), dtype=np.int32) * np.int32(kinds), sizes) + kind, minlength=len(sizes) * kinds).reshape(len(sizes), kinds)
    more = counts[left] - counts[right]
    over = np.maximum(more, 0).sum(axis=1)
    least = np.maximum(over, over - more.sum(axis=1))
    most = np.full(len(pairs), -1)
    alike = np.flatnonzero(sizes[left] == sizes[right])
    if alike.size:
        differ = _points("".join(pairs[i][0] for i in alike)) != _points("".join(pairs[i][1] for i in alike))
        long = sizes[left[alike]]
        most[alike] = np.add.reduceat(differ, np.cumsum(long) - long, dtype=np.int64)
    return least, most


def _points(text: str) -> np.ndarray:
    """Code points."""
    try:
        return np.frombuffer(text.encode("latin-1"), dtype=np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _edits_by_words(a: str, b: str) -> int:
    """Edits that turn each word into the one at its place; -1 if there are not as many words in both, or long ones."""
    left, right = a.split(" "), b.split(" ")
    if len(left) != len(right):
        return -1
    total = 0
    for x, y in zip(left, right):
        if x != y:
            if len(x) == len(y):
                total += sum(map(ne, x, y))
            elif max(len(x), len(y)) <= LONG:
                total += _word_edits(x, y)
            else:
                return -1
    return total


@lru_cache(maxsize=100_000)
def _word_edits(a: str, b: str) -> int:
    return _edit_count(a, b)


def _side_by_side(pairs: list[tuple[str, str]], words: int) -> np.ndarray:
    """The steps of :func:`_edit_count` for many pairs at once, on numbers of ``words`` machine words of 64 bits."""
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    n = len(pairs)
    sizes, longer = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    points = np.frombuffer("".join(a + b for a, b in pairs).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = (np.unique(points, return_inverse=True)[1] + 1).astype(np.int64)  # 0 stands for nothing
    begins = np.concatenate([[0], np.cumsum(sizes + longer)])
    short, long = np.zeros((64 * words, n), dtype=np.int64), np.zeros((int(longer.max()), n), dtype=np.int64)
    for k in range(n):
        at = begins[k]
        short[: sizes[k], k] = codes[at : at + sizes[k]]
        long[: longer[k], k] = codes[at + sizes[k] : begins[k + 1]]
    every = np.arange(n)
    same = np.zeros((words, int(codes.max()) + 1, n), dtype=np.uint64)
    for row in range(int(sizes.max())):
        same[row >> 6, short[row], every] |= np.uint64(1 << (row & 63))
    same[:, 0] = 0
    same = same.reshape(words, -1)
    one, top = np.uint64(1), np.uint64(63)
    last = ((sizes - 1) & 63).astype(np.uint64)
    up, down = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), dtype=np.uint64)
    cost = sizes.copy()
    for j, row in enumerate(long):
        at = row * n + every
        plus, minus = np.ones(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
        for w in range(words):
            equal, u, d = same[w].take(at), up[w], down[w]
            vertical = equal | d
            equal |= minus
            horizontal = (((equal & u) + u) ^ u) | equal
            right = d | ~(horizontal | u)
            left = u & horizontal
            if w == words - 1:
                cost += ((right >> last) & one).astype(np.int64) * (j < longer) - ((left >> last) & one).astype(np.int64) * (j < longer)
            carry_plus, carry_minus = right >> top, left >> top
            right = (right << one) | plus
            np.bitwise_or((left << one) | minus, ~(vertical | right), out=u)
            np.bitwise_and(right, vertical, out=d)
            plus, minus = carry_plus, carry_minus
    return cost


@lru_cache(maxsize=1)
def _edits_udf():
    @F.pandas_udf("int")
    def count(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in pairs:
            out = pd.Series([None] * len(left), dtype="Int32")
            there = [i for i, (a, b) in enumerate(zip(left, right)) if a is not None and b is not None]
            if there:
                out.iloc[there] = _edit_counts([(_plain(left.iloc[i]), _plain(right.iloc[i])) for i in there])
            yield out

    return count


def _plain(value):
    return value if isinstance(value, str) else list(value)


def edits(left: Column, right: Column) -> Column:
    """Edits between two texts. Short pairs stay in the JVM; longer ones go to a worker that works on 64 characters at a time and on many pairs at once."""
    long = (left != right) & (F.greatest(F.length(left), F.length(right)) > LONG)
    return F.when(left == right, 0).when(~long, F.levenshtein(left, right)).otherwise(_edits_udf()(F.when(long, left), F.when(long, right)))


def _few(*columns: pd.Series) -> Iterator[list]:
    """A batch's rows some at a time, so that what is made of them stays small; arrays as lists, of several columns as tuples of lists."""
    for first in range(0, len(columns[0]), ROWS_AT_ONCE):
        some = [[None if row is None else list(row) for row in c.iloc[first : first + ROWS_AT_ONCE]] for c in columns]
        yield some[0] if len(some) == 1 else [None if None in row else row for row in zip(*some)]


def _all_pairs(rows: list) -> list:
    asked = list({(a, b) if a < b else (b, a): 0 for row in rows if row for a, b in combinations(dict.fromkeys(row), 2)})
    known = dict(zip(asked, _edit_counts(asked)))
    return [None if row is None else [0 if a == b else known[(a, b) if a < b else (b, a)] for a in row for b in row] for row in rows]


@lru_cache(maxsize=1)
def _pair_edits_udf():
    @F.pandas_udf("array<int>")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series([n for rows in _few(series) for n in _all_pairs(rows)], dtype=object)

    return count


def pair_edits(texts: Column) -> Column:
    """Edits between all pairs of a few texts, row by row in one array; long texts as in :func:`edits`."""
    long = F.coalesce(F.array_max(F.transform(texts, F.length)), F.lit(0)) > LONG
    short = let(texts, lambda all_: F.flatten(F.transform(all_, lambda a: F.transform(all_, lambda b: F.when(a == b, 0).otherwise(F.levenshtein(a, b))))))
    return F.when(~long, short).otherwise(_pair_edits_udf()(F.when(long, texts)))


def _nearest(rows: list) -> list:
    """For each of a row's texts the distance to the nearest of its sources: first to the one that bounds from below put nearest, then to those that may be nearer still."""
    asked = list({(t, s): 0 for row in rows if row for t in row[0] if t is not None and t not in row[1] for s in row[1]})
    least = dict(zip(asked, _least(asked)))
    share = lambda n, t, s: n / max(len(t), len(s))
    wanted = {t: s for row in rows if row for t in row[0] if t is not None and t not in row[1] and row[1] for s in [min(row[1], key=lambda s: share(least[t, s], t, s))] for t, s in [((t, tuple(row[1])), s)]}
    known = dict(zip(wanted, _edit_counts([(t, s) for (t, _), s in wanted.items()])))
    best = {k: share(known[k], k[0], s) for k, s in wanted.items()}
    more = [(k, s) for k in wanted for s in k[1] if s != wanted[k] and share(least[k[0], s], k[0], s) < best[k]]
    for (k, s), n in zip(more, _edit_counts([(k[0], s) for k, s in more])):
        best[k] = min(best[k], share(n, k[0], s))
    return [None if row is None else [None if t is None else 0.0 if t in row[1] else best.get((t, tuple(row[1]))) for t in row[0]] for row in rows]


def _square(rows: list) -> list:
    """Edits between all pairs of each row's texts; a null text counts as an empty one."""
    return _all_pairs([None if row is None else ["" if t is None else t for t in row] for row in rows])


@lru_cache(maxsize=1)
def _nearest_udf():
    @F.pandas_udf("array<double>")
    def nearest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, sources in batches:
            yield pd.Series([x for rows in _few(texts, sources) for x in _nearest(rows)], dtype=object)

    return nearest


def nearest_distances(texts: Column, sources: Column) -> Column:
    """For each of an array's texts the :func:`normalized_distance` to the nearest of ``sources``; null where either array or the text is."""
    return _nearest_udf()(texts, sources)


def cer(reference: Column, hypothesis: Column) -> Column:
    """Edits per reference character; without a reference 0 or 1."""
    empty = F.length(reference) == 0
    return F.when(empty, F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(edits(reference, hypothesis) / F.greatest(F.length(reference), F.lit(1)))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, _BLANKS), lambda t: t != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_distance(left: Column, right: Column) -> Column:
    """Edits between two arrays of words.

    In the JVM each word of both sides becomes one character, and one stands
    for all words of a side alone; long arrays go to the worker of :func:`edits`.
    """
    long = F.greatest(F.size(left), F.size(right)) > LONG

    def coded(side: Column, words: Column, alone: str) -> Column:
        at = F.transform(side, lambda t: F.array_position(words, t))
        return F.array_join(F.transform(at, lambda n: F.when(n == 0, alone).otherwise(F.decode(F.unhex(F.lpad(F.hex(n + _WORD_BASE), 4, "0")), "UTF-16BE"))), "")

    short = let(F.struct(left.alias("l"), right.alias("r"), F.array_intersect(left, right).alias("w")), lambda p: F.levenshtein(coded(p["l"], p["w"], "<"), coded(p["r"], p["w"], ">")))
    return F.when(left == right, 0).when(~long, short).otherwise(_edits_udf()(F.when(long & (left != right), left), F.when(long & (left != right), right)))


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word edits per reference word; without reference words 0 or 1."""
    ref, hyp = tokens(reference), tokens(hypothesis)
    return F.when(F.size(ref) == 0, F.when(F.size(hyp) == 0, 0.0).otherwise(1.0)).otherwise(token_distance(ref, hyp) / F.greatest(F.size(ref), F.lit(1)))


def exact_match(reference: Column, hypothesis: Column) -> Column:
    return F.when(normalize(reference) == normalize(hypothesis), 1.0).otherwise(0.0)


def line_correct(reference: Column, hypothesis: Column, max_cer: float = MAX_LINE_CER, normal: tuple[Column, Column] | None = None) -> Column:
    """Equal in normal form, or both blank, or few enough edits. ``normal``: the two normal forms, where they are at hand."""
    ref, hyp = normal or (normalize(reference), normalize(hypothesis))
    blank = strip(F.coalesce(hypothesis, F.lit(""))).isin(*PLACEHOLDERS)
    return F.when(ref == hyp, True).when(ref == "", blank).otherwise(cer(ref, hyp) <= max_cer)


def is_visible(hypothesis: Column, state: Column) -> Column:
    """Whether a reader sees the text as text."""
    return ~strip(hypothesis).isin(*PLACEHOLDERS) & ~state.isin(ILLEGIBLE, CROSSED_OUT)


def normalized_distance(left: Column, right: Column) -> Column:
    """Edits per character of the longer text; 0 for two empty ones."""
    longer = F.greatest(F.length(left), F.length(right))
    return F.when(longer == 0, 0.0).otherwise(edits(left, right) / F.greatest(longer, F.lit(1)))


def lambda_distance(left: Column, right: Column) -> Column:
    """:func:`normalized_distance` where no worker can be asked: inside functions over arrays."""
    longer = F.greatest(F.length(left), F.length(right))
    return F.when(left == right, 0.0).otherwise(F.levenshtein(left, right) / F.greatest(longer, F.lit(1)))


def is_high_risk(text: Column) -> Column:
    return F.coalesce(text.rlike(HIGH_RISK_PATTERN), F.lit(False))


def is_garbage(text: Column) -> Column:
    """Nothing readable: empty, no ASCII letter or digit, or one character over and over."""
    t = strip(F.coalesce(text, F.lit("")))
    bare = F.replace(t, F.lit(" "), F.lit(""))
    alike = (F.length(F.replace(bare, F.substring(bare, 1, 1), F.lit(""))) == 0) & (F.length(t) > 3)
    one = (F.length(t) == 1) & ~t.rlike(r"[\p{L}\p{N}]")
    return (t == "") | one | t.rlike(r"^[^A-Za-z0-9]+$") | alike


def has_decode_artefacts(text: Column) -> Column:
    """Question marks, many full stops, or a short text of scattered one- and two-letter words."""
    scattered = F.lower(text).rlike(r"(?U)\b[a-z]{1,2}\b.*\b[a-z]{1,2}\b.*\b[a-z]{1,2}\b") & (F.length(text) < 12)
    return text.contains("?") | (F.regexp_count(text, F.lit(r"\.")) > 3) | scattered


def is_handwriting_model(model_name: Column, family: Column | None = None) -> Column:
    name = F.lower(F.coalesce(model_name, F.lit("")))
    found = name.contains("trocr") | name.contains("microsoft")
    return found if family is None else found | F.coalesce(family == "trocr", F.lit(False))


def is_print_model(model_name: Column) -> Column:
    return F.lower(F.coalesce(model_name, F.lit(""))).contains("paddle")


def looks_like_ocr_truth(truth: Column, notes: Column) -> Column:
    """A reference that was made by recognition rather than by people."""
    blob = F.lower(F.concat_ws("\n", F.coalesce(truth, F.lit("")), F.coalesce(notes, F.lit(""))))
    return blob.contains("generated from ocr") | blob.contains("ocr output as gt") | (blob.contains("auto-transcribed") & ~blob.contains("human"))


def is_placeholder_name(name: Column, case_id: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike(PLACEHOLDER_NAME_PATTERN) | F.coalesce(case_id, F.lit("")).rlike(PLACEHOLDER_NAME_PATTERN)


def joined(values: Column, order: Column, separator: str = "\n") -> Column:
    """Aggregate: ``values`` in the given order with a separator between them."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), separator)


def parse_state(raw: Column) -> Column:
    """A known state in upper case, else null: the row belongs into quarantine."""
    up = F.upper(F.trim(raw))
    return F.when(up.isin(*STATES), up)


def json_salvage(reply: Column) -> Column:
    """From the first opening to the last closing brace."""
    return F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))


def file_name(raw: Column) -> Column:
    """The name with all but word characters, dots and hyphens replaced."""
    return F.regexp_replace(F.regexp_replace(raw, r"^.*[/\\]", ""), r"[^A-Za-z0-9._-]+", "_")


def extension(raw: Column) -> Column:
    return F.lower(F.regexp_extract(raw, r"\.([A-Za-z0-9]+)$", 1))


#: What a page reader's reply may hold.
REPLY = "category string, category_confidence double, summary string, layout_regions array<struct<type:string,bbox:array<double>,description:string>>, line_items array<struct<text:string,category:string,confidence:double>>"


def parse_reply(reply: Column) -> Column:
    """A page reader's reply as a struct; null where there is no JSON in it. Unknown fields are dropped, wrong types become null."""
    return F.from_json(json_salvage(reply), REPLY, {"mode": "PERMISSIVE"})
