"""Main text of web pages by equivalence-class template deduction.

Method: every page is a sequence of tokens: opened and closed elements, told
apart by their path, and blocks of text at their path.  Tokens of a host with
the same occurrence vector over the host's pages form an equivalence class.
Classes that are frequent and large are candidates.  Tokens that on some page
break their class's order, round by round, leave it.  A class is valid if it
nests: a round lies in one gap of the class around it, always in the same gap.
The valid classes, nested, are the host's template; the gaps between a class's
tokens are its slots.  Slots in elements that by their name are menus,
notices, adverts, comments and the like hold no content; of what the others
hold, the content element is the template element that holds most, where an
element named as content needs less.  The text is what the slots of the content
element hold.  ``article`` and ``main`` are tokens like others, with a name.

Text inside the content element that the host repeats is kept.  Only where the
element is not named as content do repeated blocks after the last slot's text
go, and only if they are the lesser part.

Pages of hosts with too few pages use the template of all pages together.  A
page that no template fits is read alone: by an element named as content, else
by names and shares of links.

At scale: pages are parsed once into short token streams, which are written;
what follows reads these.  Occurrence vectors are never gathered.  Two sums of
``count x random number of the page`` are equal for equal vectors (and, but
for a chance of 2**-60, only for those), and sums are made map-side first, so a
host with a third of all pages costs no more in any one task.  Order and
nesting are checked page by page.  A host's template is bounded by what its
pages have in common (``SUPPORT`` of them).

Defined results: a null or empty page, or one without content, has the empty
text; a null address is the host ``''``; damaged and cut-off markup is read as
far as it goes; repeated rows each give a row; an empty table gives no rows;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import begin, materialise, pieces, settle

#: A template token is on this share of the host's pages, and on so many pages.
SUPPORT, LEAST_PAGES = 0.8, 5
#: Tokens that a valid class has at least.
CLASS_SIZE = 3
#: Share of a host's slot text that its content element holds; of one that is named as content.
MASS, NAMED_MASS = 0.6, 0.3
#: Share of a block's characters in links from which it is a menu.
LINKS = 0.8
#: Rounds in which tokens out of order and classes that do not nest are taken out; hosts where more is wrong then have no template.
ROUNDS = 6
#: The host of all pages together, and how many hosts' templates a worker keeps.
POOL, KEPT = "*", 2000
#: Template tokens, of 8 bytes, that all hosts may have together to be broadcast; else pages are joined with templates by a shuffle.
BROADCAST_TOKENS = 2_000_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|<[!?/a-zA-Z][^>]*\Z", re.S)
_NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS = re.compile(r"\d+")
_PIECES = re.compile(r"[-_]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg xmp".split())
#: Of these only the start tag goes where no end tag follows.
SKIPPED = frozenset("noscript template svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that are no content.
NO_CONTENT = frozenset("nav header footer aside form select option button menu dialog head object".split())
#: Words of names that mark what is no content: on any element; on containers only; without meaning of their own.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent newsletter subscribe breadcrumb breadcrumbs"
    " comments commentlist disqus respond sidebar nav navbar navigation menu footer masthead pagination pager popup modal".split()
)
WEAK = frozenset("banner promotion header aside notice notices alert comment replies share sharing related recommended popular signup login widget widgets toolbar".split())
NEUTRAL = frozenset("site page top bottom left right box list area block bar wrapper wrap container section inner outer buttons button links link item items social search form reply post posts main global primary secondary the of".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog".split())
CONTENT = frozenset(("article", "main"))
#: Elements whose weak names say nothing, and which are no content element.
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody thead tfoot figure figcaption caption address summary".split())
_NEVER_OUT = frozenset(("html", "body", "article", "main"))
_RAW_END = {name: re.compile(f"</{name}", re.I) for name in RAW}
_ends_paragraph = frozenset("p div ul ol li dl table section article main nav header footer aside form h1 h2 h3 h4 h5 h6 pre blockquote figure hr".split())

# low bits of a token
OPEN, CLOSE, TEXT = 0, 1, 2
_KIND, _NAMED, _CONTAINER, _OUT = 3, 4, 8, 4
_MASK = (1 << 59) - 1


def marks_no_content(name: str, words: frozenset) -> bool:
    """Whether a class name or id is made of such words: a whole name, or pieces that all belong."""
    if name in words:
        return True
    pieces = _PIECES.split(name)
    return len(pieces) > 1 and any(p in words for p in pieces) and all(p in STRONG or p in WEAK or p in NEUTRAL for p in pieces)


class Element:
    """An open element: name, hash and flags of its path, whether it is no content, content, the hash of the nearest path without inline elements."""

    __slots__ = ("name", "path", "out", "named", "block", "inline")

    def __init__(self, name: str, path: int, out: bool, named: bool, block: int, inline: bool) -> None:
        self.name, self.path, self.out, self.named, self.block, self.inline = name, path, out, named, block, inline


class Block:
    """A block's text, its token, whether it is no content or inside an element named as content, its link characters, the place of its token."""

    __slots__ = ("text", "token", "out", "inside", "link", "at")

    def __init__(self, text: str, token: int, out: bool, inside: bool, link: int, at: int) -> None:
        self.text, self.token, self.out, self.inside, self.link, self.at = text, token, out, inside, link, at


def _hash(parent: int, text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    mixed = (parent * 0x9E3779B97F4A7C15 + (zlib.crc32(data) << 32) + zlib.crc32(b"q" + data[::-1]) + len(data)) & 0xFFFFFFFFFFFFFFFF
    mixed = ((mixed ^ (mixed >> 29)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    return (mixed ^ (mixed >> 32)) & _MASK


def parse(page: str | None) -> tuple[list[Block], list[int]]:
    """Blocks in page order, and the page's tokens."""
    blocks: list[Block] = []
    tokens: list[int] = []
    if not page:
        return blocks, tokens
    root = Element("", 0, False, False, 0, False)
    stack: list[Element] = [root]
    opened: dict[str, int] = {}
    n_out = n_named = link = 0
    held: list[str] = []
    endless: set[str] = set()

    def flush() -> None:
        nonlocal held, link
        if held:
            text = " ".join("".join(held).split())
            if text:
                token = _hash(stack[-1].block, "\n" + text) << 4 | TEXT | (_OUT if n_out else 0)
                blocks.append(Block(text, token, n_out > 0, n_named > 0, link, len(tokens)))
                tokens.append(token)
            held, link = [], 0

    def close() -> None:
        nonlocal n_out, n_named
        e = stack.pop()
        opened[e.name] -= 1
        n_out -= e.out
        n_named -= e.named
        if not e.inline:
            tokens.append(e.path & ~_KIND | CLOSE)

    at, n = 0, len(page)
    for m in iter(lambda: _TAG.search(page, at), None):
        if m.start() > at:
            piece = html.unescape(page[at : m.start()])
            held.append(piece)
            if opened.get("a"):
                link += len(piece.strip())
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if name not in INLINE:
                flush()
            if opened.get(name):
                while stack[-1].name != name:
                    if not stack[-1].inline:
                        flush()
                    close()
                close()
        elif name in RAW:
            if name == "title":
                flush()
            if name == "svg" and m.group(3).endswith("/"):
                continue
            end = None if name in endless else _RAW_END[name].search(page, at)
            if end is None and name in SKIPPED:
                endless.add(name)
                continue
            gt = page.find(">", end.end()) if end else -1
            at = gt + 1 if gt >= 0 else n
        else:
            inline = name in INLINE
            if not inline:
                flush()
            if name in VOID:
                continue
            if name in _ends_paragraph and (opened.get("p") or name == "li" and opened.get("li")):
                # of the open elements, those up to the nearest that is not inline
                last = len(stack) - 1
                while last and stack[last].inline:
                    last -= 1
                if stack[last].name == "p" or (name == "li" and stack[last].name == "li"):
                    while len(stack) > last:
                        close()
            label, out, named = name, name in NO_CONTENT, name in CONTENT
            attributes = m.group(3)
            if attributes and "=" in attributes:
                found = [(kind.lower(), (a or b or c).lower()) for kind, a, b, c in _NAMES.findall(attributes)]
                if found:
                    label = f"{name}.{_DIGITS.sub('0', ' '.join(v for _, v in found))}"
                    for kind, value in found:
                        for word in value.split():
                            if kind == "role":
                                out, named = out or word in ROLES, named or word == "main"
                            elif kind == "itemprop":
                                named = named or word == "articlebody"
                            else:
                                named = named or word == "main"
                                out = out or marks_no_content(word, STRONG) or (not inline and name not in _TEXTUAL and marks_no_content(word, WEAK) and not (n_named and word.endswith("header")))
            if name == "header" and n_named:  # a heading inside the article
                out = False
            if name in _NEVER_OUT:
                out = False
            own = _hash(stack[-1].path >> 4, label) << 4 | OPEN | (_NAMED if named else 0) | (0 if inline or name in _TEXTUAL else _CONTAINER)
            stack.append(Element(name, own, out, named, stack[-1].block if inline else own >> 4, inline))
            opened[name] = opened.get(name, 0) + 1
            n_out += out
            n_named += named
            if not inline:
                tokens.append(own)
            if m.group(3).endswith("/") and not inline and name not in ("p", "div"):
                close()
    if at < n:
        held.append(html.unescape(page[at:]))
    flush()
    while len(stack) > 1:
        close()
    return blocks, tokens


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]*)", 1), F.lit("")))


class Template:
    """A host's classes, each a list of tokens in order; and its content element (0: none)."""

    def __init__(self, classes: list[list[int]], content: int = 0) -> None:
        self.classes, self.content = classes, content
        self.place = {token: (k, i) for k, tokens in enumerate(classes) for i, token in enumerate(tokens)}

    def disordered(self, tokens: list[int]) -> set[tuple[int, int]]:
        """Class and place of the tokens outside a longest run that keeps their class's order."""
        seen: dict[int, int] = {}
        expected: dict[int, list[tuple[int, int]]] = {}
        for token in tokens:
            if (found := self.place.get(token)) is not None:
                k, i = found
                nth = seen[token] = seen.get(token, -1) + 1
                expected.setdefault(k, []).append((nth * len(self.classes[k]) + i, i))
        out = set()
        for k, places in expected.items():
            if all(x[0] < y[0] for x, y in zip(places, places[1:])):
                continue
            ends: list[int] = []  # least last place of a run of each length, and where it is
            at: list[int] = []
            before = [-1] * len(places)
            for j, (place, _) in enumerate(places):
                n = bisect_left(ends, place)
                before[j] = at[n - 1] if n else -1
                if n == len(ends):
                    ends.append(place)
                    at.append(j)
                else:
                    ends[n], at[n] = place, j
            kept, j = set(), at[-1]
            while j >= 0:
                kept.add(j)
                j = before[j]
            out.update((k, i) for j, (_, i) in enumerate(places) if j not in kept)
        return out

    def walk(self, tokens: list[int]) -> tuple[list[tuple[int, int] | None], set[int], dict[int, tuple[int, int]]]:
        """Per token the slot (class, gap) that it lies in, None for the template's own; classes that do not nest; per class the slot around it.

        An open round of a class must be ended before the one around it goes
        on.  Of two classes that cross, the one with fewer tokens is at fault.
        """
        slots: list[tuple[int, int] | None] = []
        wrong: set[int] = set()
        around: dict[int, tuple[int, int]] = {}
        rounds: list[list[int]] = []  # class and the place of its last token
        is_open: set[int] = set()
        for token in tokens:
            found = self.place.get(token)
            if found is None or found[0] in wrong:
                slots.append((rounds[-1][0], rounds[-1][1]) if rounds else (-1, 0))
                continue
            k, i = found
            slots.append(None)
            while k in is_open and rounds[-1][0] != k:  # a round inside is not ended yet
                other = rounds[-1][0]
                fault = other if len(self.classes[other]) <= len(self.classes[k]) else k
                wrong.add(fault)
                is_open.discard(fault)
                rounds = [r for r in rounds if r[0] != fault]
            if k in wrong:
                continue
            if k in is_open:
                if rounds[-1][1] != i - 1:
                    wrong.add(k)
                    is_open.discard(k)
                    rounds.pop()
                    continue
                rounds[-1][1] = i
            elif i:
                wrong.add(k)
                continue
            else:
                parent = (rounds[-1][0], rounds[-1][1]) if rounds else (-1, 0)
                if around.setdefault(k, parent) != parent:
                    wrong.add(k)
                    continue
                is_open.add(k)
                rounds.append([k, 0])
            if i == len(self.classes[k]) - 1:
                is_open.discard(k)
                rounds.pop()
        wrong.update(is_open)
        return slots, wrong, around


def streams(pages: DataFrame) -> DataFrame:
    """``host``, ``key`` (random, of the page), ``tokens``, ``chars`` (of each token) of every page."""

    def run(batches):
        for batch in pieces(batches):
            tokens, chars = [], []
            for page in batch.column(2).to_pylist():
                blocks, own = parse(page)
                size = np.zeros(len(own), dtype="<i4")
                for b in blocks:
                    size[b.at] = len(b.text)
                tokens.append(np.array(own, dtype="<i8").tobytes())
                chars.append(size.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.binary()), pa.array(chars, pa.binary())], names=["host", "key", "tokens", "chars"])

    keyed = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64(F.col("page_id"), F.col("url")).alias("key"), "html")
    return materialise(keyed.mapInArrow(run, "host string, key long, tokens binary, chars binary"), "html-streams")


def statistics(found: DataFrame) -> DataFrame:
    """Per ``host`` (and all pages as one, without texts) and ``token``: ``pages``, two fingerprint sums, ``first`` (sum of first places); token -1 counts pages."""

    def run(batches):
        for batch in pieces(batches):
            sums: dict[tuple[str, int], list[int]] = {}
            for host, key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                one, two = key & 0x3FFFFFFF, (key >> 31) & 0x3FFFFFFF
                token, first, count = np.unique(np.frombuffer(blob, "<i8"), return_index=True, return_counts=True)
                rows = [*zip(token.tolist(), first.tolist(), count.tolist()), (-1, 0, 1)]
                for name in (host, POOL):
                    for t, f, c in rows:
                        if name == POOL and t >= 0 and t & _KIND == TEXT:
                            continue
                        row = sums.setdefault((name, t), [0, 0, 0, 0])
                        row[0] += 1
                        row[1] += c * one
                        row[2] += c * two
                        row[3] += f
            keys, values = list(sums), list(sums.values())
            cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64())]
            cols += [pa.array([v[i] for v in values], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(cols, names=["host", "token", "pages", "f1", "f2", "first"])

    rows = found.mapInArrow(run, "host string, token long, pages long, f1 long, f2 long, first long")
    return rows.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "f1", "f2", "first")])


def candidates(found: DataFrame) -> DataFrame:
    """Per ``host`` its ``classes``: frequent tokens with the same occurrence vector, in the order of their mean first places."""
    stats = materialise(statistics(found).where(F.col("pages") >= LEAST_PAGES), "html-tokens")
    hosts = stats.where(F.col("token") == -1).select("host", F.col("pages").alias("of"))
    frequent = stats.where(F.col("token") >= 0).join(hosts, "host").where(F.col("pages") >= SUPPORT * F.col("of"))
    classes = frequent.groupBy("host", "pages", "f1", "f2").agg(F.array_sort(F.collect_list(F.struct("first", "token"))).alias("tokens")).where(F.size("tokens") >= CLASS_SIZE)
    own = F.struct((-F.col("pages")).alias("pages"), F.get("tokens", F.lit(0))["first"].alias("first"), F.transform("tokens", lambda t: t["token"]).alias("tokens"))
    return classes.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(own)), lambda c: c["tokens"]).alias("classes"))


def _with(pages: DataFrame, learned: DataFrame) -> tuple[DataFrame, dict]:
    """``pages`` with the columns of their host's row in ``learned`` (null: none); and the row of all pages, of the size of one page at most."""
    pool = learned.where(F.col("host") == POOL).drop("host").first()
    own = learned.where(F.col("host") != POOL).withColumn("owner", F.col("host"))
    tokens = own.agg(F.sum(F.aggregate("classes", F.lit(0).cast("long"), lambda n, c: n + F.size(c)))).first()[0] or 0
    own = F.broadcast(own) if tokens <= BROADCAST_TOKENS else own
    return pages.join(own, "host", "left"), pool.asDict() if pool else {}


def check(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Sums over the pages of each ``host`` that ``classes`` has: what holds for a class, a slot or an element.

    ``kind`` 0: token ``b`` of class ``a`` is out of order on ``n`` pages; 1: class
    ``a`` lies in the slots from ``low`` to ``high``; 2: ``n`` characters of slot
    ``b`` of class ``a``; 3: ``n`` characters in slots of element ``a`` at depth
    ``b``; 4: ``n`` characters in all slots; 5: class ``a`` does not nest on ``n`` pages.
    """

    rows, pool = _with(found.select("host", "tokens", "chars"), classes)
    shared = found.sparkSession.sparkContext.broadcast(pool)

    def run(batches):
        known = {POOL: Template(shared.value["classes"])} if shared.value else {}
        for batch in pieces(batches):
            sums: dict[tuple[str, int, int, int], list[int]] = {}

            def add(host: str, kind: int, a: int, b: int, n: int, low: int = 0) -> None:
                row = sums.setdefault((host, kind, a, b), [0, low, low])
                row[0] += n
                row[1], row[2] = min(row[1], low), max(row[2], low)

            for i, (blob, sizes, owner) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                owner = owner or POOL
                if owner not in known:
                    if owner == POOL:
                        continue
                    if len(known) > KEPT:
                        known = {k: v for k, v in known.items() if k == POOL}
                    known[owner] = Template(batch.column(3)[i].as_py())
                template, tokens = known[owner], np.frombuffer(blob, "<i8").tolist()
                slots, wrong, around = template.walk(tokens)
                for k, place in template.disordered(tokens):
                    add(owner, 0, k, place, 1)
                for k in wrong:
                    add(owner, 5, k, 0, 1)
                for k, (a, b) in around.items():
                    add(owner, 1, k, 0, 1, (a + 1 << 32) + b)
                held = [0]
                for token, slot, chars in zip(tokens, slots, np.frombuffer(sizes, "<i4").tolist()):
                    kind = token & _KIND
                    if kind == TEXT:
                        if slot is not None and not token & _OUT:
                            add(owner, 2, *slot, chars)
                            held[-1] += chars
                    elif kind == OPEN:
                        held.append(0)
                    else:
                        chars = held.pop()
                        held[-1] += chars
                        if chars and token & _CONTAINER and (opened := token & ~_KIND) in template.place and template.place[opened][0] not in wrong:
                            add(owner, 3, opened, len(held), chars)
                add(owner, 4, 0, 0, held[0])
            keys, values = list(sums), list(sums.values())
            cols = [pa.array([k[0] for k in keys], pa.string())] + [pa.array([k[i] for k in keys], pa.int64()) for i in (1, 2, 3)] + [pa.array([v[i] for v in values], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(cols, names=["host", "kind", "a", "b", "n", "low", "high"])

    rows = rows.select("tokens", "chars", "owner", "classes").mapInArrow(run, "host string, kind long, a long, b long, n long, low long, high long")
    return rows.groupBy("host", "kind", "a", "b").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def templates(found: DataFrame) -> DataFrame:
    """Per ``host`` its valid ``classes`` and the token of its ``content`` element (0: none)."""
    learned = materialise(candidates(found), "html-classes")
    for _ in range(ROUNDS):
        sums = materialise(check(found, learned), "html-checked")
        # while tokens are out of order, what crosses tells nothing
        crossing = (F.col("kind") == 5) | ((F.col("kind") == 1) & (F.col("low") != F.col("high")))
        broken = sums.where(crossing | (F.col("kind") == 0)).groupBy("host").agg(F.collect_set(F.when(F.col("kind") == 0, F.struct("a", "b"))).alias("tokens"), F.collect_set(F.when(crossing, F.col("a"))).alias("crossing"))
        broken = materialise(broken.select("host", "tokens", F.when(F.size("tokens") == 0, F.col("crossing")).otherwise(F.array().cast("array<long>")).alias("crossing")), "html-broken")
        if broken.isEmpty():
            break
        fits = lambda k: lambda _, i: ~F.array_contains("tokens", F.struct(k.cast("long").alias("a"), i.cast("long").alias("b")))
        left = F.filter(F.transform("classes", lambda c, k: F.filter(c, fits(k))), lambda c, k: (F.size(c) >= CLASS_SIZE) & ~F.array_contains("crossing", k.cast("long")))
        learned = learned.join(broken, "host", "left").select("host", F.when(F.col("tokens").isNull(), F.col("classes")).otherwise(left).alias("classes"))
        learned = materialise(learned.where(F.size("classes") > 0), "html-classes")
    else:
        learned = materialise(learned.join(broken, "host", "left_anti"), "html-classes")
    total = sums.where(F.col("kind") == 4).select("host", F.col("n").alias("total"))
    element = sums.where(F.col("kind") == 3).groupBy("host", "a").agg(F.min("b").alias("depth"), F.sum("n").alias("n")).join(total, "host")
    named = F.col("a").bitwiseAND(_NAMED) != 0
    outer = F.when(named & (F.col("n") >= NAMED_MASS * F.col("total")), F.struct((-F.col("depth")).alias("depth"), "n", "a"))
    inner = F.when(F.col("n") >= MASS * F.col("total"), F.struct("depth", "n", "a"))
    content = element.groupBy("host").agg(F.coalesce(F.max(outer)["a"], F.max(inner)["a"]).alias("content"))
    return materialise(learned.join(content, "host", "left").select("host", "classes", F.coalesce("content", F.lit(0).cast("long")).alias("content")), "html-templates")


def alone(blocks: list[Block]) -> str:
    """The text of a page that no template fits."""
    kept = [b for b in blocks if not b.out]
    inside = [b for b in kept if b.inside]
    return " ".join(b.text for b in inside or [b for b in kept if b.link < LINKS * len(b.text)])


def main_text(page: str | None, template: Template | None = None) -> str:
    """The text of a page, given its host's template. The empty template has one slot, the page."""
    blocks, tokens = parse(page)
    if template is None or not blocks:
        return alone(blocks)
    if not template.classes:
        return " ".join(b.text for b in blocks)
    slots, _, _ = template.walk(tokens)
    begin, end = template.content, template.content & ~_KIND | CLOSE
    if not begin or begin not in template.place:
        return alone(blocks)
    inside, open_, ends = [], 0, [i for i, t in enumerate(tokens) if t == begin or t == end]
    spans = []
    for i in ends:  # the element may stand several times, and within itself only under another path
        if tokens[i] == begin:
            open_ = i
        else:
            spans.append((open_, i))
    at = 0
    for b in blocks:
        while at < len(spans) and spans[at][1] < b.at:
            at += 1
        if at < len(spans) and spans[at][0] < b.at and not b.out:
            inside.append(b)
    if not spans:
        return alone(blocks)
    if not template.content & _NAMED:
        inside = [b for b in inside if b.link < LINKS * len(b.text)]
        own = [i for i, b in enumerate(inside) if slots[b.at] is not None]
        if own and sum(len(inside[i].text) for i in own) >= MASS * sum(len(b.text) for b in inside):
            inside = inside[: own[-1] + 1]
    return " ".join(b.text for b in inside)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of each page."""
    mark = begin()
    learned = templates(streams(pages))
    settle(pages.sparkSession, mark, learned)
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    joined, pool = _with(keyed, learned)
    joined = joined.select("page_id", "url", "html", "owner", "classes", "content")
    shared = pages.sparkSession.sparkContext.broadcast(pool)

    def run(batches):
        known = {None: Template(**shared.value) if shared.value else None}
        for batch in pieces(batches):
            got = []
            for i, (page, owner) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if owner not in known:
                    if len(known) > KEPT:
                        known = {None: known[None]}
                    known[owner] = Template(batch.column(4)[i].as_py(), batch.column(5)[i].as_py())
                got.append(main_text(page, known[owner]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.string()), pa.array(list(map(len, got)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    out = materialise(joined.mapInArrow(run, "page_id long, url string, text string, n_chars long"), "html-texts")
    settle(pages.sparkSession, mark, out)
    return out
