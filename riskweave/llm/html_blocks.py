"""Leaf blocks of web pages and their features, without building a tree.

A block is the text between two block-level tags; inline tags do not end it. White space inside a
block becomes one space and character references are decoded. Comments, declarations, scripts,
styles, templates (which can be nested) and the head are no blocks. The head ends where its end tag stands or, as that may be left
out, before the first tag or text that cannot be in it.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

# Tags, comments and elements without page text. Quoted attribute values may contain '>'.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<svg(?=[\s/])(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+(?<=/)>"  # closed by itself, empty
    r"|<(?P<raw>script|style|title|textarea|svg|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*>|<[!?][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLANK = re.compile(r"[\s\x00]+")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp "
    "small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Start tags that may stand in the head; any other one, or text, ends it.
_HEAD = frozenset("html head base basefont bgsound link meta title script style template noscript "
                  "noframes".split())
# A start tag of the left kind ends an open element of the right kinds.
_CLOSES = {t: ("p",) for t in (
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hr main menu nav ol p pre section table ul").split()}
_CLOSES |= {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"),
            "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"), "th": ("p", "td", "th"),
            "option": ("option",), "body": ("head",)}
_SCOPES = frozenset("ul ol dl table article section div nav aside main form".split())

_TAGS = ("article main section nav header footer aside form table ul ol dl figure figcaption "
         "blockquote pre button label select noscript dialog menu address fieldset details").split()
_OWN = "p li h1 h2 h3 h4 h5 h6 td th div dd dt article section body pre blockquote span".split()
# Words in class, id and role that hint at the part of a page (own choice, in natural order).
_CUES = {
    "content": r"content|article|post|entry|story|main|body|text|prose",
    "nav": r"nav|menu|breadcrumb|pagination|pager|tabs|toc",
    "head": r"header|masthead|topbar|branding|logo|site-title",
    "foot": r"foot|copyright|legal|imprint|colophon",
    "side": r"sidebar|side|aside|widget|related|recommend|trending|popular|rail",
    "ad": r"ad|ads|advert\w*|advertisement|sponsor\w*|promo\w*|banner|outbrain|taboola",
    "notice": r"cookie\w*|consent|notice|alert|gdpr|newsletter|subscribe|popup|modal|paywall"
              r"|warning|message|toast|overlay",
    "comment": r"comment\w*|reply|replies|disqus|discussion|respond|feedback|reviews?",
    "share": r"share|sharing|social|follow",
    "form": r"form|search|login|signup|register|poll|survey",
}
_CUE = {k: re.compile(rf"(?:^|[\s_-])(?:{v})(?=$|[\s_-])", re.I) for k, v in _CUES.items()}
_DIGITS = re.compile(r"\d")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = {
    "w_cookie": re.compile(r"cookie|consent|privacy policy|gdpr", re.I),
    "w_sign": re.compile(r"subscribe|sign up|log ?in|newsletter|password|e-?mail", re.I),
    "w_legal": re.compile(r"©|copyright|all rights reserved|terms of", re.I),
    "w_more": re.compile(r"read more|related|click here|share this|advertis|sponsored", re.I),
    "w_reply": re.compile(r"\breply\b|\bcomments?\b|posted by|wrote:", re.I),
}

FEATURES = (
    ["bias", "first", "linked_all", "linked_most", "linked_some", "len1", "len2", "len3", "len4",
     "ends_stop", "comma", "capital", "digits", "hidden", "in_link_list", "plain", "after_h1",
     "clean_article", "clean_main", "clean_content"]
    + [f"in_{t}" for t in _TAGS] + [f"own_{t}" for t in _OWN] + [f"cue_{c}" for c in _CUES]
    + list(_WORDS))
INDEX = {name: i for i, name in enumerate(FEATURES)}
_BAD_TAGS = frozenset(INDEX[f"in_{t}"] for t in
                      "nav footer aside form button label select noscript dialog menu".split())
_BAD_CUES = frozenset(INDEX[f"cue_{c}"] for c in _CUES if c != "content")


class Element:
    """An open element: its tag, the features that it hands down and its training mark."""
    __slots__ = ("tag", "marks", "main")

    def __init__(self, tag: str, marks: frozenset, main: bool | None):
        self.tag, self.marks, self.main = tag, marks, main


def _marks_of(tag: str, rest: str) -> tuple[frozenset, bool | None]:
    marks = set()
    if f"in_{tag}" in INDEX:
        marks.add(INDEX[f"in_{tag}"])
    main = None
    if "=" in rest or "hidden" in rest:
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)}
        names = " ".join(found.get(k, "") for k in ("class", "id", "role", "aria-label"))
        if names.strip():
            marks.update(INDEX[f"cue_{k}"] for k, cue in _CUE.items() if cue.search(names))
        if "hidden" in found or found.get("aria-hidden") == "true" \
                or _HIDDEN.search(found.get("style", "")):
            marks.add(INDEX["hidden"])
        if "data-main" in found:
            main = found["data-main"] == "1"
    return frozenset(marks), main


_MARKS: dict[tuple[str, str], tuple[frozenset, bool | None]] = {}


def _known_marks(tag: str, rest: str) -> tuple[frozenset, bool | None]:
    if len(rest) > 200:
        return _marks_of(tag, rest)
    if (tag, rest) not in _MARKS:
        if len(_MARKS) > 20_000:
            _MARKS.clear()
        _MARKS[tag, rest] = _marks_of(tag, rest)
    return _MARKS[tag, rest]


def blocks(html: str) -> list[tuple[str, list[int], bool]]:
    """(text, feature numbers, training mark) of the leaf blocks in page order."""
    out: list[tuple[str, list[int], bool]] = []
    stack = [Element("body", frozenset(), False)]
    parts: list[str] = []
    state = {"linked": 0, "links": 0, "h1": False}
    opened: Counter[str] = Counter()  # open elements by tag

    def close(k: int):
        opened.subtract(e.tag for e in stack[k:])
        del stack[k:]

    def flush():
        if parts:
            value = _BLANK.sub(" ", unescape("".join(parts))).strip()
            if value:
                top = next((e for e in reversed(stack) if e.tag not in INLINE), stack[0])
                out.append((value, _features(value, top, state, not out), bool(stack[-1].main)))
                state["h1"] |= top.tag == "h1"
            parts.clear()
        state["linked"] = 0

    at, head, templates = 0, 0, 0
    for found in _TOKEN.finditer(html):
        if templates or (found["tag"] or "").lower() == "template":
            if not templates and not head and found.start() > at:
                parts.append(html[at:found.start()])
            if (found["tag"] or "").lower() == "template":
                templates = max(0, templates + (-1 if found["end"] else 1))
            at = found.end()
            continue
        if head and _BLANK.sub("", html[at:found.start()]):
            head = 0
        if found.start() > at and not head:
            parts.append(html[at:found.start()])
            if state["links"]:
                state["linked"] += found.start() - at
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if found["end"]:
            if tag == "head":
                head = 0
                continue
            if tag not in INLINE:
                flush()
            elif tag == "a":
                state["links"] = 0
            if opened[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag == "head":
            head = 1
            continue
        if tag not in _HEAD:
            head = 0
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            state["links"] = 0
            for closed in _CLOSES.get(tag, ()):
                for k in range(len(stack) - 1, 0, -1):
                    if not opened[closed]:
                        break
                    if stack[k].tag == closed:
                        close(k)
                        break
                    if stack[k].tag in _SCOPES:
                        break
        if tag in _VOID or found["rest"].endswith("/"):
            continue
        if tag == "a":
            state["links"] = 1
        marks, main = _known_marks(tag, found["rest"])
        parent = stack[-1]
        opened[tag] += 1
        stack.append(Element(tag, parent.marks | marks if marks else parent.marks,
                             parent.main if main is None else main))
    if not templates and (not head or _BLANK.sub("", html[at:])):
        parts.append(html[at:])
        if state["links"]:
            state["linked"] += len(html) - at
    flush()
    return out


def _features(value: str, top: Element, state: dict, first: bool) -> list[int]:
    found = set(top.marks)
    add = lambda name: found.add(INDEX[name])
    add("bias")
    if first:
        add("first")
    share = state["linked"] / len(value)
    if share > 0:
        add("linked_all" if share >= 0.8 else "linked_most" if share >= 0.4 else "linked_some")
        if share >= 0.4 and top.tag == "li":
            add("in_link_list")
    words = value.count(" ") + 1
    add("len1" if words < 4 else "len2" if words < 10 else "len3" if words < 25 else "len4")
    if value[-1] in ".!?…\"”»":
        add("ends_stop")
    if "," in value:
        add("comma")
    if value[0].isupper():
        add("capital")
    if len(_DIGITS.findall(value, 0, 200)) * 5 > min(len(value), 200):
        add("digits")
    if state["h1"]:
        add("after_h1")
    if f"own_{top.tag}" in INDEX:
        add(f"own_{top.tag}")
    bad = not (_BAD_TAGS.isdisjoint(found) and _BAD_CUES.isdisjoint(found))
    if not bad:
        add("plain")
        for name in ("in_article", "in_main", "cue_content"):
            if INDEX[name] in found:
                add({"in_article": "clean_article", "in_main": "clean_main",
                     "cue_content": "clean_content"}[name])
    if words < 40:
        for name, cue in _WORDS.items():
            if cue.search(value):
                add(name)
    return sorted(found)
