"""Static page locators: expressions of a small grammar are parsed, never evaluated, and looked up in the page's element tree.

    document.querySelector(S).P    document.querySelectorAll(S)[n].P    document.getElementById(I).P
    [...document.querySelectorAll(S)].map(x => x.P).join(T)

P is textContent, innerText or outerText (white space as one blank, as there is no layout), value, href, src, id, className,
title or getAttribute(A). A selector S is a list of chains of tags, #id, .class, [attribute] with =, ~=, ^=, $= or *=,
:first-child, :last-child, :nth-child(n) and :nth-of-type(n), joined by a blank or >. An empty locator is the whole page.
Whatever else a locator is, func: programs too, it comes back unresolved with a reason.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.functions.url import post_url

_QUOTED = r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`\\]*`)"""
_PROPERTY = rf"\??\.(?:(?P<name>[A-Za-z]+)|getAttribute\((?P<attribute>{_QUOTED})\))"
_FORMS = (
    re.compile(rf"document\.querySelector\((?P<selector>{_QUOTED})\){_PROPERTY};?"),
    re.compile(rf"document\.querySelectorAll\((?P<selector>{_QUOTED})\)\[(?P<index>\d+)\]{_PROPERTY};?"),
    re.compile(rf"document\.getElementById\((?P<ident>{_QUOTED})\){_PROPERTY};?"),
    re.compile(rf"\[\.\.\.document\.querySelectorAll\((?P<selector>{_QUOTED})\)\]\.map\(\(?(?P<var>\w+)\)?\s*=>\s*(?P=var){_PROPERTY}\)\.join\((?P<join>{_QUOTED})\);?"),
)
_TEXTS, _ATTRIBUTES = ("textContent", "innerText", "outerText"), {"value": "value", "href": "href", "src": "src", "id": "id", "className": "class", "title": "title"}
#: Fixed by the HTML standard: elements without content, and what an opening tag closes.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_SCOPES = frozenset("ul ol table div section article body select dl tbody thead".split())
_SIMPLE = re.compile(rf"""\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*]?=)\s*(?P<val>{_QUOTED}|[\w-]+)\s*)?\]|:(?P<pos>first-child|last-child)|:(?P<nth>nth-child|nth-of-type)\(\s*(?P<n>\d+)\s*\)""")
_TAG = re.compile(r"\*|[A-Za-z][\w-]*")


class Unresolved(ValueError):
    """A locator outside the grammar; the message is the reason."""


class Locator(NamedTuple):
    """Which elements, which property of them, and how many: the index-th, or all of them joined."""

    selectors: tuple | None
    ident: str | None
    name: str
    index: int
    join: str | None


def _unquoted(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text[1:-1])


@functools.lru_cache(10_000)
def parse_locator(text: str) -> Locator:
    """The parts of a locator; Unresolved if the grammar has none."""
    text = text.strip()
    if text.startswith("func:"):
        raise Unresolved("function " + re.match(r"func:\s*([\w.]*)", text)[1])
    for form in _FORMS:
        m = form.fullmatch(text)
        if m is None:
            continue
        held = m.groupdict()
        name = f"@{_unquoted(held['attribute'])}" if held.get("attribute") else held["name"]
        if not name.startswith("@"):
            if name not in _TEXTS and name not in _ATTRIBUTES:
                raise Unresolved(f"property {name}")
            name = f"@{_ATTRIBUTES[name]}" if name in _ATTRIBUTES else name
        chosen = parse_selectors(_unquoted(held["selector"])) if held.get("selector") else None
        return Locator(chosen, _unquoted(held["ident"]) if held.get("ident") else None, name, int(held.get("index") or 0), _unquoted(held["join"]) if held.get("join") else None)
    raise Unresolved("form")


def parse_selectors(text: str) -> tuple:
    """A tuple of chains; a chain is ((combinator, tag, tests), ...) from its last element to its first."""
    chains, chain, combinator, at = [], [], "", 0
    text = text.strip()
    while at < len(text):
        start, tag, tests = at, "*", []
        if m := _TAG.match(text, at):
            tag, at = m[0].lower(), m.end()
        while m := _SIMPLE.match(text, at):
            tests.append(tuple(sorted((k, v) for k, v in m.groupdict().items() if v is not None)))
            at = m.end()
        if at == start:
            raise Unresolved(f"selector at {text[at : at + 20]}")
        chain.append((combinator, tag, tuple(dict(t) for t in tests)))
        m = re.compile(r"\s*([>,])\s*|\s+").match(text, at)
        if m is None and at < len(text):
            raise Unresolved(f"selector at {text[at : at + 20]}")
        at = m.end() if m else at
        combinator = (m[1] or " ") if m else ""
        if combinator == ",":
            chains.append(tuple(reversed(chain)))
            chain, combinator = [], ""
    if not chain or combinator:
        raise Unresolved("selector ends early")
    return (*chains, tuple(reversed(chain)))


class Element:
    """An element, its attributes, and its texts and elements in turn."""

    __slots__ = ("attrs", "held", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.held = tag, attrs, parent, []

    def elements(self) -> Iterator[Element]:
        """All elements below, in the order of the page; without recursion, as pages may nest deeply."""
        stack = [x for x in reversed(self.held) if isinstance(x, Element)]
        while stack:
            e = stack.pop()
            yield e
            stack += [x for x in reversed(e.held) if isinstance(x, Element)]

    def text(self) -> str:
        out, stack = [], list(reversed(self.held))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack += reversed(x.held)
        return "".join(out)

    def siblings(self, of_type: bool) -> list[Element]:
        return [x for x in self.parent.held if isinstance(x, Element) and (not of_type or x.tag == self.tag)] if self.parent else [self]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closes, e = _CLOSES.get(tag, ()), self.at
        while closes and e.parent is not None and e.tag not in _SCOPES:
            if e.tag in closes:
                self.at = e.parent
            e = e.parent
        made = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.held.append(made)
        if tag not in _VOID:
            self.at = made

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        e = self.at
        while e.parent is not None and e.tag != tag:
            e = e.parent
        if e.parent is not None:
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        self.at.held.append(data)


def build(page: str) -> Element:
    """The element tree of a page."""
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


def _fits(e: Element, tag: str, tests: tuple[dict, ...]) -> bool:
    if tag not in ("*", e.tag):
        return False
    for t in tests:
        if "id" in t:
            fine = e.attrs.get("id") == t["id"]
        elif "cls" in t:
            fine = t["cls"] in e.attrs.get("class", "").split()
        elif "attr" in t:
            has, op = e.attrs.get(t["attr"].lower()), t.get("op")
            want = (_unquoted(t["val"]) if t["val"][0] in "\"'`" else t["val"]) if op else ""
            fine = has is not None and (op is None or {"=": has == want, "~=": want in has.split(), "^=": bool(want) and has.startswith(want), "$=": bool(want) and has.endswith(want), "*=": bool(want) and want in has}[op])
        else:
            kin = e.siblings(t.get("nth") == "nth-of-type")
            fine = kin[0] is e if t.get("pos") == "first-child" else kin[-1] is e if t.get("pos") else len(kin) >= int(t["n"]) > 0 and kin[int(t["n"]) - 1] is e
        if not fine:
            return False
    return True


def matches(e: Element, chain: tuple) -> bool:
    """Whether an element ends a chain: after each step, the elements that may stand for it, nearest first."""
    if not _fits(e, *chain[0][1:]):
        return False
    alive = [e]
    for (combinator, *_), (_, tag, tests) in zip(chain, chain[1:]):
        found: dict[int, Element] = {}
        for x in alive:
            up = x.parent
            while up is not None and up.parent is not None:
                if id(up) in found:
                    break
                if _fits(up, tag, tests):
                    found[id(up)] = up
                if combinator == ">":
                    break
                up = up.parent
        alive = list(found.values())
    return bool(alive)


def select(page: str, locator: str) -> str:
    """The text that a locator selects; empty if nothing matches, as on a wrong page. Unresolved outside the grammar."""
    if not locator.strip():
        return page
    found = parse_locator(locator)
    root = build(page)
    if found.ident is not None:
        hits = [e for e in root.elements() if e.attrs.get("id") == found.ident]
    else:
        hits = [e for e in root.elements() if any(matches(e, c) for c in found.selectors)]
    told = [e.attrs.get(found.name[1:], "") if found.name[0] == "@" else e.text() if found.name == "textContent" else " ".join(e.text().split()) for e in hits]
    return found.join.join(told) if found.join is not None else told[found.index] if found.index < len(told) else ""


def located(df: DataFrame, page: str, locator: str, into: str = "selected") -> DataFrame:
    """`df` with struct(text, reason): what a column's locators select in pages; the text is null, and a reason there, if a locator is
    outside the grammar. Null pages are empty, null locators the whole page."""
    schema = df.schema.simpleString()[len("struct<") : -1]

    def one(html: str | None, how: str | None) -> dict:
        try:
            return {"text": select(html or "", how or ""), "reason": None}
        except Unresolved as e:
            return {"text": None, "reason": str(e)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in (page, locator)), strict=True)
            told = pa.array([one(*p) for p in pairs], pa.struct([("text", pa.string()), ("reason", pa.string())]))
            yield pa.RecordBatch.from_arrays([*b.columns, told], [*b.schema.names, into])

    return df.mapInArrow(run, f"{schema},{into}:struct<text:string,reason:string>")


#: Fixed value: the one helper that reference URLs may name, over the page that was left last.
_HELPER = r"^func:\s*reddit_get_post_url\(\s*['\"]([^'\"]*)['\"]\s*\)$"


def reference(url: Column, last_url: Column) -> Column:
    """struct(url, reason) of a reference URL: plain ones as they are; the helper for forum posts resolved, with __last_url__ filled in;
    other func: programs unresolved, with their name as reason."""
    argument = F.replace(F.regexp_extract(url, _HELPER, 1), F.lit("__last_url__"), last_url)
    func = F.startswith(url, F.lit("func:"))
    told = F.when(~func, url).when(url.rlike(_HELPER), post_url(argument))
    return F.struct(told.alias("url"), F.when(func & ~url.rlike(_HELPER), F.concat(F.lit("function "), F.regexp_extract(url, r"^func:\s*([\w.]*)", 1))).alias("reason"))
