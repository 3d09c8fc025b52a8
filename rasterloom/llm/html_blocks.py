"""Web pages as sequences of leaf blocks, and random labelled pages to learn from."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from html import unescape

#: Elements of which nothing is text (nor of option, whose end tag may be left out), those that begin and end blocks, and those without an end tag.
SILENT = "script|style|noscript|template|textarea|select|button|svg|iframe|object|title"
BLOCK = frozenset("html head body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag closes, and what stops it.
CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"datalist", "optgroup"}), "optgroup": ("option", {"datalist"})}
_ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<svg(?=[\s/>]){_ATTRIBUTES}(?<=/)>|<({SILENT})(?=[\s/>])[^>]*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRIBUTES})>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>|<[!?][^>]*+>", re.S | re.I)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[a-z]+|[0-9]+")


@dataclass
class Block:
    text: str
    #: Names of the elements it stands in, their classes, ids and roles, its own element, and how much of it is links.
    path: frozenset[str]


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page in order: text between the starts and ends of block elements, references decoded, white space as one space."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    pieces: list[str] = []
    where: tuple[frozenset[str], str] | None = None
    linked = 0
    options = False

    def flush() -> None:
        nonlocal where, linked
        text = " ".join("".join(pieces).split())
        if text and where is not None:
            share = "all" if linked >= 0.8 * len(text) else "some" if linked else "none"
            out.append(Block(text, where[0] | {f"leaf {where[1]}", f"links {share}", f"words {min(6, text.count(' ').bit_length())}"}))
        pieces.clear()
        where, linked = None, 0

    def data(raw: str) -> None:
        nonlocal where, linked
        if raw and not (options and any(t == "option" for t, _ in stack)):
            text = unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if where is None and not text.isspace():
                names: set[str] = set()
                for _, n in stack:
                    names |= n
                where = frozenset(names), next((t for t, _ in reversed(stack) if t in BLOCK), "")
            if any(t == "a" for t, _ in stack[-4:]):
                linked += len(text)

    def close(tags: str, stop: set[str]) -> None:
        wanted = tags.split()
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in wanted:
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    at = 0
    html = html or ""
    for m in TOKEN.finditer(html):
        data(html[at : m.start()])
        at = m.end()
        end, tag, rest = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        elif tag == "br":
            pieces.append(" ")
        if end:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID and not rest.endswith("/"):
            if tag in BLOCK:
                close("p", {"table", "button"})
            if tag in CLOSES:
                close(*CLOSES[tag])
            options |= tag == "option"
            own = {tag}
            for found in NAMES.findall(rest) if rest else ():
                own.update(f".{w}" for w in WORDS.findall("".join(found).lower()))
            stack.append((tag, frozenset(own)))
    data(html[at:])
    flush()
    return out


# Pages to learn from. What a region is called, and what is said there; everything else is random.
_MAIN = "article post content entry main story text body single blog news page".split()
_AWAY = {
    "menu": "nav navbar menu navigation topnav breadcrumb breadcrumbs links toolbar",
    "head": "header masthead top site logo branding",
    "foot": "footer bottom copyright colophon legal",
    "side": "sidebar side aside widget widgets related recommended trending popular tags archive",
    "advert": "ad ads advert advertisement promo sponsored sponsor banner adslot",
    "notice": "notice cookie cookies consent gdpr alert popup modal warning newsletter subscribe",
    "form": "form search login signup contact",
    "comments": "comments comment replies reply discussion respond disqus",
    "share": "share social sharing follow",
}
_TAGS = {"menu": "nav div ul", "head": "header div", "foot": "footer div", "side": "aside div section", "advert": "div aside section", "notice": "div section", "form": "form", "comments": "section div ol", "share": "div ul"}
_SAID = {
    "menu": "home about contact news products services blog sitemap login register",
    "head": "welcome site official online menu search",
    "foot": "copyright rights reserved privacy policy terms imprint © · ® contact",
    "side": "related popular recent posts categories tags archive more read trending",
    "advert": "advertisement sponsored buy now sale offer discount free shop deal",
    "notice": "cookies accept agree consent privacy we use this site subscribe newsletter email",
    "form": "name email password submit search send message required",
    "comments": "reply comment said says ago posted user thanks great agree",
    "share": "share tweet facebook twitter linkedin email print whatsapp",
}


def _words(r: random.Random, n: int, said: str = "", share: float = 0.0) -> str:
    cue = said.split()
    letters = r.choice(("aeioubcdfghlmnprst", "aeiouäöüßbcdeghnrstz", "éèêaeiouçlmnprst", "ñáéíóaeioclmnrs", "абвгдежзиклмнопрст"))
    make = lambda: r.choice(cue) if cue and r.random() < share else "".join(r.choice(letters) for _ in range(r.randint(1, 10)))
    return " ".join(make() for _ in range(n)).capitalize() + r.choice((".", ".", "", "!", "?", ":", " &amp;"))


def _leaf(r: random.Random, tag: str, text: str, linked: bool) -> str:
    if linked:
        text = f'<a href="/{r.random()}">{text}</a>'
    elif r.random() < 0.3:
        k = r.choice(("b", "i", "em", "strong", "span", "a href='#'", "code"))
        w = text.split(" ")
        i, j = sorted((r.randint(0, len(w) - 1), r.randint(1, len(w)))) if r.random() < 0.6 else (0, len(w))
        text = " ".join((*w[:i], f"<{k}>" + " ".join(w[i:j]) + (f"</{k.split()[0]}>" if r.random() < 0.7 or k[0] == "a" else "<br>"), *w[j:]))
    return f"<{tag}>{text}" + (f"</{tag}>" if tag not in ("p", "li") or r.random() < 0.8 else "")


def _away(r: random.Random, kind: str) -> tuple[str, list[bool]]:
    tag = r.choice(_TAGS[kind].split())
    named = tag in ("div", "section", "ul", "ol") or r.random() < 0.4
    attr = f' {r.choice(("class", "class", "id"))}="{r.choice(_AWAY[kind].split())}{r.choice(("", "-" + r.choice("abcxyz"), " " + r.choice(("wide", "box", "col", "left"))))}"' if named else ""
    items = r.randint(1, 9) if kind in ("menu", "side", "comments", "share", "form") else r.randint(1, 3)
    inner = []
    for _ in range(items):
        long = kind in ("comments", "advert", "notice", "foot") and r.random() < 0.7
        linked = kind in ("menu", "share", "side") and r.random() < 0.85
        leaf = "li" if tag in ("ul", "ol") else r.choice({"menu": ("li", "div", "p"), "form": ("label", "p", "div"), "head": ("h1", "h2", "p", "div"), "side": ("li", "p", "h3", "div")}.get(kind, ("p", "div", "p", "li")))
        leaf = "div" if leaf == "label" else leaf
        inner.append(_leaf(r, leaf, _words(r, r.randint(5, 40) if long else r.randint(1, 6), _SAID[kind], r.choice((0.0, 0.0, 0.4, 0.8))), linked))
    if items == 1 and tag not in ("ul", "ol") and r.random() < 0.5:  # the text right in the region
        inner = [_words(r, r.randint(2, 20), _SAID[kind], 0.4)]
    body = "".join(inner)
    if tag == "nav" and r.random() < 0.7:
        body = f"<ul>{body}</ul>"
    return f"<{tag}{attr}>{body}</{tag}>", [False] * items


def random_page(r: random.Random) -> tuple[str, list[bool]]:
    """A page and, for each of its blocks, whether it belongs to the main text."""
    parts: list[tuple[str, list[bool]]] = []
    if r.random() < 0.75:
        parts.append((_leaf(r, r.choice(("h1", "h1", "h2")), _words(r, r.randint(1, 14)), False), [True]))
    between = r.choice((0.0, 0.1, 0.4))
    for _ in range(r.choice((1, 2, 4, 8, 16, 25))):
        tag = r.choice(("p",) * 8 + ("li", "h2", "h3", "blockquote", "pre", "td", "div", "dd"))
        text = _leaf(r, tag, _words(r, r.choice((1, 2, 4, 10, 25, 60, 120))), r.random() < 0.06)
        text = {"li": f"<ul>{text}</ul>", "td": f"<table><tr>{text}</tr></table>", "dd": f"<dl>{text}</dl>"}.get(tag, text)
        parts.append((text, [True]))
        if r.random() < between:
            parts.append(_away(r, r.choice(("advert", "share", "form", "side", "notice", "comments"))))
    if r.random() < 0.3:
        parts.append(_away(r, r.choice(("share", "comments", "foot", "side"))))
    tag = r.choice(("article", "article", "article", "main", "div", "div", "section"))
    named = f' {r.choice(("class", "id"))}="{r.choice(_MAIN)}"' if tag in ("div", "section") or r.random() < 0.4 else ""
    core = f"<{tag}{named}>" + "".join(p for p, _ in parts) + f"</{tag}>", [x for _, own in parts for x in own]
    for _ in range(r.choice((0, 0, 1, 2))):
        core = f'<{r.choice(("div", "main", "section"))} class="{r.choice((*_MAIN, "wrap", "container", "row", "col", "inner"))}">{core[0]}</div>', core[1]
    before = [_away(r, k) for k in r.sample(("menu", "head", "notice", "advert", "side", "form", "share"), r.randint(0, 4))]
    after = [_away(r, k) for k in r.sample(("comments", "foot", "advert", "side", "form", "menu", "notice", "share"), r.randint(0, 4))]
    all_ = [*before, core, *after]
    head = f"<!DOCTYPE html><html><head><title>{_words(r, 4)}</title><style>p{{}}</style></head><body><script>x('</p>')</script>"
    return head + "<!-- x -->".join(p for p, _ in all_) + "</body></html>", [x for _, own in all_ for x in own]
