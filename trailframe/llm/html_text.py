"""Main text of web pages: site templates go by subtree hashes counted per host, before any rule by name.

1. A page is parsed into elements; unclosed and stray tags are repaired as browsers do in the cases that matter here.
   What is no text (scripts, styles, the head, hidden elements and the like) is left out.
2. Every element subtree is hashed bottom-up, in one pass, in two ways: its content (names and all text), and its shape
   (tag, words of class and id, and the set of its children's shapes, whatever text or number they have). Both are
   counted per host over distinct pages.
   - Slots: a block that is no paragraph, by its shape and the path that leads to it. One on SLOT_SHARE of a host's pages
     is template, where it stands outside of the host's text: each page votes for the deepest block that holds over half
     of its text, links aside, and blocks with TEXT_SHARE of a host's votes hold the host's text, with what surrounds
     them. So menus, adverts and footers go that differ on every page and carry no telling name.
   - Contents: a subtree on TEMPLATE_SHARE of a host's pages is template wherever it stands, if it is no paragraph-like
     element of an <article> or <main>. A block (a child of the main element or of its div and section wrappers) needs no
     such share, but LOW_SHARE or MANY_PAGES, as its place and neighbours tell it from a quoted passage: it is template
     where PLACED of its pages have it at the same place, counted from the first or the last sibling, and the text around
     it has OTHERS as many MinHash values as it has pages. A passage that many articles quote stands at many places or on
     many hosts (ON_HOST of the block's pages anywhere must be this host's, so a block that sister hosts share stays), and
     an article in many copies has the same text around each of its blocks. A placed block is deleted at that place only,
     a heading only with the block after it, an h1 never.
   TEMPLATE_PAGES is the least number of pages for each.
3. Rules by tag and name back this up, on hosts with too few pages and for what recurs too seldom: menus, forms, footers,
   asides and, by a whole class, id or role, menus, sidebars, adverts, notices, reader comments and the like: every word of
   it must be such a name or a part of a page ("site-footer", "ad-7"), so "related-work" and "form-validation" stay.
   Headings and inline elements do not go by name, and neither does what surrounds all of the page's <article> and <main>.
   The main element is the page's <article>, <main>, an element marked as main content, or else the body.
4. Text is what is left: character references decoded, white space inside a block one space, blocks joined by one.

`template_chars` and `rule_chars` tell how many characters of each page steps 2 and 3 removed.

Counting is an aggregation on (host, hash) that sums up map-side, so a host with a third of all pages is no hot key;
places and neighbours are counted for hashes on TEMPLATE_PAGES pages or more only.
Templates are handed to the second parse by broadcast while they are at most BROADCAST_TEMPLATES rows, and by a join on
the page beyond that.

Null html counts as empty and gives the empty text, and so does a page without text. A null url, or one without a host,
belongs to the host "". Repeated rows are extracted one by one. No pages give no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import few, written

TEMPLATE_SHARE, TEMPLATE_PAGES = 0.6, 10
#: For blocks at the same place: the least share of a host's pages or else number of them; the share of a block's pages that have it there, that are the host's, and of different texts around it.
LOW_SHARE, MANY_PAGES, PLACED, ON_HOST, OTHERS = 0.01, 1000, 0.8, 0.8, 0.5
#: The least share of a host's pages that have a slot; of its votes that go to a block with its text.
SLOT_SHARE, TEXT_SHARE = 0.05, 0.2
BROADCAST_TEMPLATES = 200_000
#: Pages that a Python worker reads at once, and their bytes.
AT_ONCE, AT_ONCE_BYTES = 500, 4 << 20

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)([^<>"']*(?:"[^"<]*"[^<>"']*|'[^'<]*'[^<>"']*)*)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noframes template".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rb rt rp".split())
_PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th tr tbody thead ul ol dl table figure figcaption caption address hr".split()) | _INLINE
_NO_TEXT = frozenset("head script style noscript template title select textarea iframe svg canvas object embed option datalist map audio video".split())
_DROPPED = frozenset("head script style noscript template title nav footer aside form button select textarea input iframe svg canvas object embed menu dialog option datalist map audio video".split())
#: Words of class, id or role that name what is no article.
_NAMES = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar sidenav aside complementary contentinfo widget widgets ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search form share sharing social related recommended recommendations comment comments commentlist respond disqus replies pagination pager toolbar skip banner masthead hidden dialog".split())
#: Words that stand beside such a name in a class, id or role.
_PARTS = frozenset("site page main left right top bottom primary secondary global local mobile desktop header list area box block container wrapper wrap slot unit bar section group button buttons link links post posts article articles entry story stories item items inner outer row column col panel zone holder body content text title label icon icons js wp".split())
_ASIDES = frozenset("comment comments reply ad advert promo related".split())
_HEADERS = frozenset("header masthead topbar banner".split())
_MAIN = frozenset("article articlebody post entry story content main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WRAPPERS = frozenset("html body main article div section center".split())
_CONTAINERS = frozenset("html body main article".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_P_ENDERS = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_BARRIER = frozenset("html body article section div main table ul ol dl td th nav aside footer header form".split())


class Element:
    """An element: where its pieces begin and end, and what its attributes say."""

    __slots__ = ("tag", "parent", "start", "end", "names", "tokens", "hidden", "dropped", "inner", "silent")

    def __init__(self, tag: str, parent: int, start: int, attributes: str):
        self.tag, self.parent, self.start, self.end = tag, parent, start, -1
        self.tokens, self.hidden = _tokens(attributes) if attributes and not attributes.isspace() else ((), False)
        self.names = tuple(itertools.chain.from_iterable(self.tokens))
        self.dropped = self.inner = self.silent = False


def _tokens(attributes: str) -> tuple[tuple[tuple[str, ...], ...], bool]:
    """Words of each class, of the id and of each role and itemprop, in lower case; whether the element is hidden."""
    tokens: list[tuple[str, ...]] = []
    hidden = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or ""
        value = value[1:-1] if value[:1] in ("'", '"') else value
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hidden = True
        elif name in ("class", "id", "role", "itemprop"):
            for token in value.split():
                token = re.sub(r"\b(?:no|with|has|without|non)[-_]\w+", " ", re.sub(r"([a-z])([A-Z])", r"\1-\2", token)) if name != "itemprop" else token
                words = tuple(re.findall(r"[a-z0-9]+", token.lower()))
                if words:
                    tokens.append(words)
    return tuple(tokens), hidden


def _named(e: Element, names: frozenset[str]) -> bool:
    """Whether a whole class, id or role is one of the names, parts of a page beside it aside."""
    return any(any(w in names for w in t) and all(w in names or w in _NAMES or w in _PARTS or w.isdigit() for w in t) for t in e.tokens)


def parse(page: str) -> tuple[list[Element], list[tuple[int, str]]]:
    """(elements, pieces): pieces in page order are (element, text), or (element, "\\0") where a block begins or ends."""
    elements = [Element("", -1, 0, "")]
    pieces: list[tuple[int, str]] = []
    stack = [0]
    open_at: dict[str, list[int]] = {}  # where in the stack the open elements of each tag are
    barriers: list[int] = []  # where those are that stray tags do not reach past
    at, size = 0, len(page)

    def close(upto: int) -> None:
        while len(stack) > upto:
            e = stack.pop()
            tag = elements[e].tag
            open_at[tag].pop()
            if tag in _BARRIER:
                barriers.pop()
            if tag not in _INLINE:
                pieces.append((elements[e].parent, "\0"))
            elements[e].end = len(pieces)

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            pieces.append((stack[-1], page[at:]))
            break
        if m.start() > at:
            pieces.append((stack[-1], page[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag
            places = open_at.get(tag)
            if places and not (barriers and barriers[-1] > places[-1] and (tag in _INLINE or tag in ("p", "li", "dt", "dd"))):
                close(places[-1])
            continue
        if tag in _P_ENDERS or tag in _CLOSES:
            closing = _CLOSES.get(tag, set()) | ({"p"} if tag in _P_ENDERS else set())
            while True:
                k = max((open_at[t][-1] for t in closing if open_at.get(t)), default=0)
                if not k or (barriers and barriers[-1] > k):
                    break
                close(k)
                if tag != "tr":
                    break
        attributes = m[3] if m[2] else m[6]
        if tag == "br":
            pieces.append((stack[-1], " "))
        if tag in _VOID:
            continue
        elements.append(Element(tag, stack[-1], len(pieces), attributes or ""))
        if tag not in _INLINE:
            pieces.append((stack[-1], "\0"))
        open_at.setdefault(tag, []).append(len(stack))
        if tag in _BARRIER:
            barriers.append(len(stack))
        stack.append(len(elements) - 1)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            upto = end.start() if end else size
            if upto > at:
                pieces.append((stack[-1], page[at:upto]))
            at = upto
    close(1)
    elements[0].end = len(pieces)
    return elements, pieces


def _is_dropped(e: Element, in_article: bool) -> bool:
    """Whether an element goes by its tag or as it is hidden."""
    return e.tag in _DROPPED or e.hidden or (e.tag == "header" and not in_article)


def _is_named(e: Element, in_article: bool) -> bool:
    """Whether an element goes by its class, id or role."""
    if not e.tokens or e.tag in _HEADINGS or e.tag in _INLINE:
        return False
    if e.tag == "article":
        return _named(e, _ASIDES)
    if e.tag == "header" or e.tag in _CONTAINERS:
        return False
    if _named(e, _HEADERS):
        return not in_article
    return _named(e, _NAMES)


def _around(elements: list[Element], pieces: list[tuple[int, str]]) -> set[int]:
    """Elements that hold all of a page's articles, or that are marked as main content and hold over half of its text."""
    mains = [e for e in elements[1:] if e.tag in ("article", "main") and not e.dropped and not (e.tag == "article" and _named(e, _ASIDES))]
    first, last = min((m.start for m in mains), default=0), max((m.end for m in mains), default=0)
    sums = [0, *itertools.accumulate(0 if elements[p].dropped else len(t.strip("\0").strip()) for p, t in pieces)]
    around = set()
    for i, e in enumerate(elements[1:], 1):
        if e.dropped or e.tag in ("article", "main"):
            continue
        if (mains and e.start <= first and last <= e.end) or (any(n in _MAIN for n in e.names) and 2 * (sums[e.end] - sums[e.start]) > sums[-1]):
            around.add(i)
    return around


def marked(elements: list[Element], pieces: list[tuple[int, str]]) -> list[int]:
    """Mark what rules drop, and what the main elements hold; gives the main elements."""
    inside = [False] * len(elements)

    def drop(named) -> bool:
        """Mark; whether any element went by name."""
        any_named = False
        for i, e in enumerate(elements[1:], 1):
            p = elements[e.parent]
            inside[i] = inside[e.parent] or e.tag in ("article", "main")
            e.dropped = p.dropped or _is_dropped(e, inside[e.parent])
            if not e.dropped and named(i, e):
                e.dropped = any_named = True
        return any_named

    any_named = drop(lambda i, e: _is_named(e, inside[e.parent]))

    def top(test) -> list[int]:
        found: list[int] = []
        for i, e in enumerate(elements[1:], 1):
            if not e.dropped and test(e) and not (found and e.start < elements[found[-1]].end):
                found.append(i)
        return found

    def semantic_roots() -> list[int]:
        articles = top(lambda e: e.tag == "article")
        mains = top(lambda e: e.tag == "main" or ("main" in e.names and e.tag not in _HEADINGS and e.tag not in _INLINE))
        roots = articles if len(articles) == 1 else mains if len(mains) == 1 else articles or mains
        return roots or top(lambda e: e.tag in ("div", "section", "td") and any(n in _MAIN for n in e.names))

    roots = semantic_roots()
    if any_named and not roots:  # a name such as "sidebar-left" may tell the layout of what surrounds the article
        drop(lambda i, e: False)
        around = _around(elements, pieces)
        drop(lambda i, e: i not in around and _is_named(e, inside[e.parent]))
        roots = semantic_roots()
    return roots or top(lambda e: e.tag == "body") or [0]


def read(page: str) -> tuple[list[Element], list[tuple[int, str]]]:
    """`parse`, with what is no text marked silent and elements that may be template anywhere marked inner."""
    elements, pieces = parse(page)
    article = [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        e.silent = elements[e.parent].silent or e.tag in _NO_TEXT or e.hidden
        article[i] = article[e.parent] or e.tag in ("article", "main")
        e.inner = not e.silent and not (e.tag in _PARAGRAPH and article[i]) and e.tag not in _CONTAINERS
    return elements, pieces


class Hashes:
    """Of every element: hash of its content, of its shape and of the path to it, and prefix sums of text by pieces."""

    def __init__(self, elements: list[Element], pieces: list[tuple[int, str]]):
        n = len(elements)
        parts: list[list[str | int]] = [[] for _ in range(n)]
        linked = [False] * n
        following = 1
        self.chars, self.plain = [0], [0]  # characters that are not white space; those outside links
        for i, e in enumerate(elements[1:], 1):
            linked[i] = linked[e.parent] or e.tag == "a"
        for k, (owner, text) in enumerate(pieces):
            while following < n and elements[following].start <= k:
                parts[elements[following].parent].append(following)
                following += 1
            text = "" if text == "\0" else " ".join(text.split())
            if text:
                parts[owner].append(text)
            size = 0 if elements[owner].silent else len(text)
            self.chars.append(self.chars[-1] + size)
            self.plain.append(self.plain[-1] + (0 if linked[owner] else size))
        for i in range(following, n):
            parts[elements[i].parent].append(i)
        own = [zlib.crc32(" ".join([e.tag, *sorted({w for w in e.names if not w.isdigit()})]).encode()) for e in elements]
        self.content, self.shape, self.path = [b""] * n, [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            told = b"\x1f".join(self.content[x] if isinstance(x, int) else x.encode("utf-8", "surrogatepass") for x in parts[i])
            self.content[i] = hashlib.blake2b(elements[i].tag.encode() + b"\x1d" + told, digest_size=8).digest()
            # hashes of numbers are the same in every process
            self.shape[i] = hash((own[i], *sorted({self.shape[x] for x in parts[i] if isinstance(x, int) and elements[x].tag not in _INLINE})))
        for i, e in enumerate(elements[1:], 1):
            self.path[i] = hash((self.path[e.parent], own[i]))
        self.elements = elements

    def of(self, i: int) -> int:
        """Hash of an element's content, as a number."""
        return int.from_bytes(self.content[i], "little", signed=True)

    def text_in(self, i: int, plain: bool = False) -> int:
        sums = self.plain if plain else self.chars
        return sums[self.elements[i].end] - sums[self.elements[i].start]

    def slots(self) -> dict[int, int]:
        """Element to slot, of the blocks that are no paragraph and hold text."""
        return {i: hash((1, self.path[i], self.shape[i])) for i, e in enumerate(self.elements) if i and not e.silent and e.tag not in _PARAGRAPH and e.tag not in ("html", "body") and self.text_in(i)}

    def texts(self) -> dict[int, int]:
        """Element to what a vote for it says."""
        return {i: hash((2, self.path[i])) for i, e in enumerate(self.elements) if i and not e.silent and e.tag not in _PARAGRAPH and e.tag not in ("html", "body")}

    def vote(self) -> int | None:
        """The page's vote: the deepest block, no paragraph, with over half of the page's text outside links."""
        found = [i for i in self.texts() if 2 * self.text_in(i, True) > self.plain[-1]]
        return hash((2, self.path[found[-1]])) if found else None


def blocks(elements: list[Element], roots: list[int]) -> list[tuple[int, int, int, int]]:
    """(element, its place from the first sibling, from the last, next sibling or -1) of the blocks of the main elements."""
    paths: dict[int, int] = dict.fromkeys(roots, 0)
    children: dict[int, list[int]] = {r: [] for r in roots}
    for i, e in enumerate(elements):
        if e.parent in children and not e.dropped and e.tag not in _INLINE and i not in paths:
            children[e.parent].append(i)
            if e.tag in _WRAPPERS:
                paths[i], children[i] = zlib.crc32(f"{paths[e.parent]}/{e.tag}".encode()), []
    found = []
    for p, own in children.items():
        for k, i in enumerate(own):
            first, last = (zlib.crc32(f"{paths[p]}{side}{n}".encode()) for side, n in ((">", k), ("<", len(own) - k)))
            found.append((i, first, last, own[k + 1] if k + 1 < len(own) else -1))
    return sorted(found)


def _shingle(text: str) -> int:
    """The least hash of a text's three-word runs."""
    words = text.split()
    return min(zlib.crc32(f"{a} {b} {c}".encode("utf-8", "surrogatepass")) for a, b, c in zip(words, words[1:], words[2:])) if len(words) > 2 else zlib.crc32(" ".join(words).encode("utf-8", "surrogatepass")) if words else _EMPTY


_EMPTY = 1 << 32


def candidates(page: str | None) -> tuple[list[tuple[int, int, int, bool]], list[int], int | None]:
    """((hash, id, rest, first of its hash) of contents that could be template, slots, vote) of a page.

    The id is the hash itself for elements that may be template anywhere, and else the hash at a place; rest is the
    MinHash value of the main text around it.
    """
    if not page:
        return [], [], None
    elements, pieces = read(page)
    hashes = Hashes(elements, pieces)
    roots = marked(elements, pieces)
    placed = {i: (first, last) for i, first, last, _ in blocks(elements, roots)}
    before, after = [_EMPTY] * (len(pieces) + 1), [_EMPTY] * (len(pieces) + 1)
    for r in roots:
        for k in range(elements[r].start, elements[r].end):
            owner, text = pieces[k]
            before[k + 1] = _EMPTY if text == "\0" or elements[owner].dropped else _shingle(text)
    own = before[1:]
    for k, x in enumerate(own):
        before[k + 1] = min(before[k], x)
    for k in range(len(own) - 1, -1, -1):
        after[k] = min(after[k + 1], own[k])
    rows: dict[tuple[int, int], tuple[int, int, int, bool]] = {}
    seen: set[int] = set()
    for i, e in enumerate(elements):
        if e.silent or not (e.inner or i in placed) or not hashes.text_in(i):
            continue
        x = hashes.of(i)
        rest = min(before[e.start], after[e.end])
        for at in (*((x,) if e.inner else ()), *(hash((x, place)) for place in placed.get(i, ()))):
            if (x, at) not in rows:
                rows[x, at] = (x, at, rest, x not in seen)
                seen.add(x)
    return list(rows.values()), sorted(set(hashes.slots().values())), hashes.vote()


def ids(page: str | None) -> list[int]:
    """All ids of a page that templates may name."""
    if not page:
        return []
    found, slots, _ = candidates(page)
    elements, pieces = read(page)
    return sorted({c[1] for c in found} | set(slots) | set(Hashes(elements, pieces).texts().values()))


def _template(elements: list[Element], hashes: Hashes, roots: list[int], templates: frozenset[int] | set[int]) -> list[bool]:
    """Which elements are template, by themselves or with what holds them."""
    dead = [False] * len(elements)
    # the host's text, with what surrounds it
    holders = [i for i, x in hashes.texts().items() if x in templates]
    if holders:
        holds = set(holders)
        inside = [False] * len(elements)
        safe = set()
        for i, e in enumerate(elements[1:], 1):
            inside[i] = inside[e.parent] or i in holds
            if i in holds or (e.tag in ("article", "main") and not _named(e, _ASIDES)):
                while i not in safe:
                    safe.add(i)
                    i = max(elements[i].parent, 0)
        for i, x in hashes.slots().items():
            dead[i] = x in templates and not inside[i] and i not in safe
    for i, first, last, following in reversed(blocks(elements, roots)):
        x = hashes.of(i)
        gone = (elements[i].inner and x in templates) or hash((x, first)) in templates or hash((x, last)) in templates
        # headings that articles share, such as "References", are the articles' own
        dead[i] = dead[i] or (gone and (elements[i].tag not in _HEADINGS or (elements[i].inner and x in templates) or (elements[i].tag != "h1" and following >= 0 and dead[following])))
    for i, e in enumerate(elements[1:], 1):
        dead[i] = dead[i] or dead[e.parent] or (e.inner and hashes.of(i) in templates)
    return dead


def extracted(page: str | None, templates: frozenset[int] | set[int] = frozenset()) -> tuple[str, int, int]:
    """(main text, characters that templates removed, characters that rules removed after them); white space not counted."""
    if not page:
        return "", 0, 0
    elements, pieces = read(page)
    roots = marked(elements, pieces)
    dead = [False] * len(elements)
    if templates:
        dead = _template(elements, Hashes(elements, pieces), roots, templates)
    by_template = by_rule = 0
    kept = bytearray(len(pieces))
    for r in roots:
        kept[elements[r].start : elements[r].end] = b"\1" * (elements[r].end - elements[r].start)
    out: list[str] = []
    for k, (p, t) in enumerate(pieces):
        if t == "\0":
            out.append("\0")
        elif elements[p].silent:
            continue
        elif dead[p]:
            by_template += len("".join(t.split()))
        elif not kept[k] or elements[p].dropped:
            by_rule += len("".join(t.split()))
        else:
            out.append(entities.unescape(t) if "&" in t else t)
    return " ".join("".join(out).replace("\0", " ").split()), by_template, by_rule


def main_text(page: str | None, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's main text without templates and what rules drop."""
    return extracted(page, templates)[0]


def host(url: Column) -> Column:
    """The host of a URL in lower case, "" if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame, share: float = TEMPLATE_SHARE, least: int = TEMPLATE_PAGES, most_broadcast: int = BROADCAST_TEMPLATES) -> DataFrame:
    """(host, hash) of the contents and slots that are template and of the blocks that hold a host's text; pages with the
    same html count once."""
    kind = pa.struct([("hash", pa.int64()), ("id", pa.int64()), ("rest", pa.int64()), ("lead", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in few(batch, 2, AT_ONCE, AT_ONCE_BYTES):
                found, slots, votes = zip(*map(candidates, part.column(2).to_pylist()), strict=True)
                ends = [0, *itertools.accumulate(map(len, found))]
                columns = list(zip(*itertools.chain.from_iterable(found), strict=True)) or [()] * 4
                flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(slots, pa.list_(pa.int64())), pa.array(votes, pa.int64())], ["host", "page", "found", "slots", "vote"])

    seen = pages.select(host(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), F.col("html").cast("string").alias("html")).mapInArrow(run, "host string, page long, found array<struct<hash: long, id: long, rest: long, lead: boolean>>, slots array<long>, vote long")
    seen = written(seen.dropDuplicates(["host", "page"]), "subtrees")
    sizes = seen.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    flat = seen.select("host", F.inline("found"))
    often = written(flat.where("lead").groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n_all")).where(F.col("n_all") >= least), "repeated")
    everywhere = flat.where("lead").groupBy("hash").agg(F.count(F.lit(1)).alias("n_everywhere")).where(F.col("n_everywhere") >= least)
    near = F.broadcast(often) if often.count() <= most_broadcast else often
    counts = flat.join(near, ["host", "hash"]).groupBy("host", "hash", "id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rest").alias("rests"), F.first("n_all").alias("n_all"))
    n, whole = F.col("n"), F.col("n_pages")
    anywhere = (F.col("id") == F.col("hash")) & (n >= whole * share)
    placed = (F.col("id") != F.col("hash")) & ((n >= whole * LOW_SHARE) | (n >= MANY_PAGES)) & (n >= F.col("n_all") * PLACED) & (F.col("rests") >= n * OTHERS)
    contents = counts.where(n >= least).join(everywhere, "hash").join(sizes, "host").where(anywhere | (placed & (F.col("n_all") >= F.col("n_everywhere") * ON_HOST))).select("host", F.col("id").alias("hash"))
    slots = seen.select("host", F.explode("slots").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(n >= least)
    votes = seen.where("vote IS NOT NULL").groupBy("host", F.col("vote").alias("hash")).agg(F.count(F.lit(1)).alias("n")).where(n >= least)
    voters = seen.groupBy("host").agg(F.count("vote").alias("n_voters"))
    texts = votes.join(voters, "host").where(n >= F.col("n_voters") * TEXT_SHARE).select("host", "hash")
    return contents.unionByName(slots.join(sizes, "host").where(n >= whole * SLOT_SHARE).select("host", "hash")).unionByName(texts)


def extract(pages: DataFrame, most_broadcast: int = BROADCAST_TEMPLATES) -> DataFrame:
    """page_id, url, text, n_chars, template_chars, rule_chars of every page."""
    spark = pages.sparkSession
    found = written(templates(pages, most_broadcast=most_broadcast), "templates")
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    if found.count() <= most_broadcast:
        by_host: dict[str, set[int]] = {}
        for h, x in found.collect():  # at most `most_broadcast` rows
            by_host.setdefault(h, set()).add(x)
        told = spark.sparkContext.broadcast(by_host)
        rows = rows.withColumn("hashes", F.lit(None).cast("array<long>"))
    else:
        told = None
        # (page, hash) pairs meet (host, hash); a page gathers no more than its own elements
        rows = rows.withColumn("page", F.xxhash64("url", "html"))
        own = rows.dropDuplicates(["page"]).select("page", "host", "html")

        def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([ids(x) for x in batch.column(2).to_pylist()], pa.list_(pa.int64()))], ["page", "host", "hashes"])

        pairs = own.mapInArrow(listed, "page long, host string, hashes array<long>").select("page", "host", F.explode("hashes").alias("hash"))
        gone = pairs.join(found, ["host", "hash"]).groupBy("page").agg(F.collect_set("hash").alias("hashes"))
        rows = rows.join(gone, "page", "left").select("page_id", "url", "host", "html", "hashes")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in few(batch, 3, AT_ONCE, AT_ONCE_BYTES):
                hosts = part.column(2).to_pylist()
                gone = [told.value.get(h, ()) for h in hosts] if told is not None else [set(x or ()) for x in part.column(4).to_pylist()]
                texts, by_template, by_rule = zip(*(extracted(x, g) for x, g in zip(part.column(3).to_pylist(), gone, strict=True)), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in (list(map(len, texts)), by_template, by_rule))], ["page_id", "url", "text", "n_chars", "template_chars", "rule_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, template_chars long, rule_chars long")
