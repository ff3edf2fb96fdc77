"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A page is read into its leaf blocks: runs of text between the starts and ends of block elements. Scripts, drawings, formulas,
controls and unknown elements inside a run don't cut it, whether their content is shown or not. Each block has features of the
elements around it (tags, words of class, id and role) and of its text (length, links, punctuation, neighbours).
The field scores each block's features and each pair of labels in a row; Viterbi picks the best labels of a page, and the
blocks labelled as main text are joined.

It is trained by stochastic gradient ascent on the likelihood of labelled pages. The pages table has no labels, so the
labelled pages are composed here: articles with menus, headers, footers, sidebars, notices, adverts, forms and comments
around and inside them, in many layouts, from a seed.

Defined results: null and empty pages, and pages without main text, give the empty text; broken markup is read as
browsers do (unclosed elements end with their parent, or where the next of their kind starts; a tag goes on to its >, and one that has none ends the
page; comments end at --> or --!>), but that an attribute's quote that is never closed ends with its tag; very long pages take time in
proportion to their length, whatever is left open in them; a label's ties go to the furniture; rows that repeat are
extracted alike; an empty table gives an empty one; other columns are left out, whatever they are called.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are never shown as text.
HIDDEN = frozenset("script style template head title svg iframe object noembed noframes".split())
#: Elements that begin and end a block, and whose start ends a paragraph. All others, unknown ones too, are part of the text around them.
BLOCK = frozenset(
    "html head body frameset address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li listing "
    "main menu nav ol p plaintext pre search section summary table caption colgroup col tbody thead tfoot tr td th ul xmp".split()
)
#: Elements that a start inside them does not end a paragraph beyond.
SCOPE = frozenset("button td th table caption body object template svg foreignobject desc mi mo mn ms mtext annotation-xml".split())
#: Elements whose start ends a drawing that was left open, as that of any block does.
BREAKS_OUT = frozenset("b big br code em embed i img nobr ruby s small span strong strike sub sup tt u var".split())
#: What the start of an element ends, up to the element that holds it: (those that start, those that end, those that hold).
ENDS = (
    (frozenset({"li"}), frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    (frozenset({"dt", "dd"}), frozenset({"dt", "dd"}), frozenset({"dl"})),
    (frozenset({"tr"}), frozenset({"tr", "td", "th"}), frozenset({"table"})),
    (frozenset({"td", "th"}), frozenset({"td", "th"}), frozenset({"tr", "table"})),
    (frozenset({"option"}), frozenset({"option"}), frozenset({"select"})),
    (frozenset({"body"}), frozenset({"head"}), frozenset({"html"})),
)
_STARTS = {tag: nth for nth, (start, _, _) in enumerate(ENDS) for tag in start}
_TOUCHES = frozenset().union(*(same | holds for _, same, holds in ENDS)) | HIDDEN
#: A comment, whole or to the page's end; a declaration or an end tag without a name, as browsers skip them.
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</>|</[^a-zA-Z>][^>]*>?", re.S)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(\s*=\s*)?")
_UNQUOTED = re.compile(r"[^\s>]*")
_GAP = re.compile(r"[\s/]*")
_WORD = re.compile(r"[a-zA-Z]+")
_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}


@dataclass
class Block:
    text: str
    #: kinds of the open elements, and the innermost two, outermost first
    kinds: frozenset[str]
    tags: tuple[str, ...]
    #: words of their class, id and role
    names: frozenset[str]
    #: characters in links
    linked: int
    #: label of composed pages
    main: bool = False


@dataclass(frozen=True, slots=True)
class _Element:
    """An open element and all that is asked of those around it, so that no question walks over them."""

    tag: str
    kinds: frozenset[str] = frozenset()
    tags: tuple[str, ...] = ()
    names: frozenset[str] = frozenset()
    main: bool = False
    in_link: bool = False
    in_math: bool = False
    #: inside a part of a drawing that holds blocks
    foreign: bool = False
    #: place of the open paragraph that a block ends, -1 for none
    paragraph: int = -1
    #: for each of ENDS, place of the outermost element that its start ends, -1 for none
    ends: tuple[int, ...] = (-1,) * len(ENDS)

    def inside(self, tag: str, place: int, names: frozenset[str], main: bool | None) -> _Element:
        """An element in this one, at a place of the stack."""
        kinds, tags = self.kinds, self.tags
        if tag in BLOCK or tag == "a":
            kinds, tags = kinds if tag in kinds else kinds | {tag}, (*tags[-1:], tag)
        ends = self.ends
        if tag in _TOUCHES:
            ends = tuple((place if at < 0 else at) if tag in same else -1 if tag in holds or tag in HIDDEN else at for at, (_, same, holds) in zip(ends, ENDS, strict=True))
        return _Element(
            tag,
            kinds,
            tags,
            self.names if names <= self.names else self.names | names,
            self.main if main is None else main,
            self.in_link or tag == "a",
            self.in_math or tag == "math",
            self.foreign or tag in ("foreignobject", "desc"),
            place if tag == "p" else -1 if tag in SCOPE else self.paragraph,
            ends,
        )


class _Tags:
    """Reads the tags of a page. What was looked for once and not found is not looked for again."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, text: str, at: int) -> int:
        if text in self.missing:
            return -1
        if (found := self.page.find(text, at)) < 0:
            self.missing.add(text)
        return found

    def attributes(self, at: int) -> tuple[dict[str, str], bool, int] | None:
        """Attributes of the tag whose name ends at a place, whether it closes itself, and where it ends; None if it has no end."""
        page, found = self.page, {}
        while True:
            m = _ATTRIBUTE.match(page, at)
            if not m:
                end = _GAP.match(page, at).end()
                return (found, page[end - 1] == "/" and end > at, end + 1) if end < len(page) else None
            at = m.end()
            value = ""
            if m[2]:
                quote = page[at : at + 1]
                if quote in ("'", '"'):
                    end = self.find(quote, at + 1)
                    if end < 0:  # never closed: the tag ends at its >
                        end = self.find(">", at)
                        if end < 0:
                            return None
                        found.setdefault(m[1].lower(), page[at + 1 : end])
                        return found, False, end + 1
                    value, at = page[at + 1 : end], end + 1
                elif quote != ">":
                    end = _UNQUOTED.match(page, at).end()
                    value, at = page[at:end], end
            found.setdefault(m[1].lower(), value)


def blocks(page: str | None, wanted: frozenset[str] | None = None) -> list[Block]:
    """The leaf blocks of a page that hold text. Of the words of class, id and role, those in `wanted` are kept, or all."""
    page, out, stack = page or "", [], [_Element("")]
    tags = _Tags(page)
    parts: list[str] = []
    linked = 0
    hidden: int | None = None  # place of the outermost hidden element; what is in it neither adds text nor ends a block
    still_open: list[Counter[str]] = [Counter()]  # elements by tag, since the last open template and with it

    def flush() -> None:
        nonlocal linked
        if hidden is not None:
            return
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            top = stack[-1]
            out.append(Block(text, top.kinds, top.tags, top.names, min(linked, len(text)), top.main))
        linked = 0

    def close(at: int) -> None:
        nonlocal hidden
        ends_block = any(stack[k].tag in BLOCK for k in range(at, len(stack) if hidden is None else hidden))
        if hidden is not None and at <= hidden:
            pop(hidden)
            hidden = None
        if ends_block:
            flush()
        pop(at)

    def pop(at: int) -> None:
        for e in reversed(stack[at:]):
            if e.tag == "template":
                still_open.pop()
            else:
                still_open[-1][e.tag] -= 1
        del stack[at:]

    at, n = 0, len(page)
    while at < n:
        start = tags.find("<", at)
        start = n if start < 0 else start
        name = _NAME.match(page, start + 1 + page.startswith("/", start + 1)) if start == at else None
        if name is None:
            if start == at and (comment := _COMMENT.match(page, at)):
                at = comment.end()
                continue
            # text up to the next <, or a < that starts nothing
            end = start if start > at else at + 1
            if hidden is None:
                parts.append(html.unescape(page[at:end]))
                if stack[-1].in_link:
                    linked += len(parts[-1].strip())
            at = end
            continue
        is_end, tag = page[at + 1] == "/", name[0].lower()
        read = tags.attributes(name.end())
        if read is None:  # the page ends in a tag
            break
        attributes, closes_itself, at = read
        if is_end:
            if still_open[-1][tag] > 0:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag))
            elif tag in BLOCK and stack[-1].tag != "template":
                flush()
            continue
        if hidden is not None and stack[hidden].tag == "svg" and (tag in BLOCK or tag in BREAKS_OUT) and not stack[-1].foreign:
            # this is no part of a drawing: it ends one that was left open
            close(hidden)
        if tag in BLOCK:
            flush()
            # a paragraph ends where a block starts, unless the block is in an element inside it
            while (k := stack[-1].paragraph) >= 0:
                close(k)
        elif tag in ("br", "option", "optgroup") and hidden is None:
            parts.append(" ")
        if tag in _STARTS and (k := stack[-1].ends[_STARTS[tag]]) >= 0:
            close(k)
        if tag in VOID or closes_itself and tag not in RAW and (hidden is not None or tag in HIDDEN or tag == "math" or stack[-1].in_math):
            continue
        words = frozenset(w for k in ("class", "id", "role") for w in _WORD.findall(attributes.get(k, "").lower()) if wanted is None or w in wanted)
        stack.append(stack[-1].inside(tag, len(stack), words, attributes["data-y"] == "1" if "data-y" in attributes else None))
        if tag == "template":
            still_open.append(Counter())
        still_open[-1][tag] += 1
        if hidden is None and tag in HIDDEN:
            hidden = len(stack) - 1
        if tag in RAW:
            end = _END[tag].search(page, at)
            if hidden is None and tag in ("textarea", "xmp"):
                typed = page[at : end.start() if end else n]
                parts.append(html.unescape(typed) if tag == "textarea" else typed)
            at = end.end() if end else n
            close(len(stack) - 1)
    if hidden is not None:
        close(hidden)
    flush()
    return out


def _bucket(x: float) -> int:
    return int(2 * math.log2(x + 1))


def features(found: list[Block]) -> list[list[str]]:
    """Names of the features of each block."""
    out = []
    for b in found:
        n = len(b.text)
        words = b.text.split()
        stops = sum(w[-1] in ".!?…:;" for w in words)
        own = [f"in {t}" for t in b.kinds]
        own += [f"name {w}" for w in b.names]
        own += [f"tag {b.tags[-1] if b.tags else '-'}", f"above {' '.join(b.tags)}", f"length {_bucket(len(words))}", f"links {round(4 * b.linked / n)}"]
        own += [f"stops {min(4, stops)}", f"last {b.text[-1] in '.!?…:;»”'}", f"first {b.text[0].isupper()}"]
        if any(c in b.text for c in "©®|·»›"):
            own.append("marks")
        out.append(own)
    total = max(1, len(found))
    for k, own in enumerate(out):
        own.append(f"place {int(4 * k / total)}")
        for step in (-1, 1):
            if 0 <= k + step < len(found):
                other = found[k + step]
                own.append(f"next {step} {other.tags[-1] if other.tags else '-'} {_bucket(len(other.text)) // 3}")
            else:
                own.append(f"next {step} none")
    return out


@dataclass
class Field:
    """Weights for the label 1 (main text) over 0, and for pairs of labels in a row."""

    weights: dict[str, float] = field(default_factory=dict)
    pairs: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])

    def names(self) -> frozenset[str]:
        """Words of class, id and role that have a weight; no other makes a difference."""
        return frozenset(x.removeprefix("name ") for x in self.weights if x.startswith("name "))

    def scores(self, found: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum(get(x, 0.0) for x in own) for own in found]

    def best(self, found: list[list[str]]) -> list[int]:
        """The labels of the greatest score, by Viterbi."""
        scores = self.scores(found)
        if not scores:
            return []
        value, came = [0.0, scores[0]], []
        for s in scores[1:]:
            step = [max((0, 1), key=lambda a, b=b: value[a] + self.pairs[a][b]) for b in (0, 1)]
            value = [value[step[b]] + self.pairs[step[b]][b] + (s if b else 0.0) for b in (0, 1)]
            came.append(step)
        labels = [int(value[1] > value[0])]
        for step in reversed(came):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def marginals(self, scores: list[float]) -> tuple[list[float], list[list[float]]]:
        """Probability of label 1 of each block, and the expected number of each pair in a row."""

        def both(a: float, b: float) -> float:
            top = max(a, b)
            return top + math.log(math.exp(a - top) + math.exp(b - top))

        n, w = len(scores), self.pairs
        ahead, back = [[0.0, scores[0]]], [[0.0, 0.0]]
        for s in scores[1:]:
            f = ahead[-1]
            ahead.append([both(f[0] + w[0][0], f[1] + w[1][0]), both(f[0] + w[0][1], f[1] + w[1][1]) + s])
        for s in reversed(scores[1:]):
            g = back[-1]
            back.append([both(w[a][0] + g[0], w[a][1] + s + g[1]) for a in (0, 1)])
        back.reverse()
        total = both(*ahead[-1])
        ones = [math.exp(ahead[k][1] + back[k][1] - total) for k in range(n)]
        expected = [[sum(math.exp(ahead[k][a] + w[a][b] + (scores[k + 1] if b else 0.0) + back[k + 1][b] - total) for k in range(n - 1)) for b in (0, 1)] for a in (0, 1)]
        return ones, expected


def learn(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 12, rate: float = 0.2, decay: float = 1e-4, seed: int = 3) -> Field:
    """A field fitted to pages of (features, labels)."""
    crf, rng = Field(), random.Random(seed)
    pages = [p for p in pages if p[0]]
    for epoch in range(epochs):
        step = rate / (1 + 0.3 * epoch)
        rng.shuffle(pages)
        for found, labels in pages:
            ones, expected = crf.marginals(crf.scores(found))
            for own, y, p in zip(found, labels, ones, strict=True):
                for x in own:
                    crf.weights[x] = crf.weights.get(x, 0.0) * (1 - decay) + step * (y - p)
            for a, b in zip(labels, labels[1:]):
                crf.pairs[a][b] += 0.2 * step
            for a in (0, 1):
                for b in (0, 1):
                    crf.pairs[a][b] -= 0.2 * step * expected[a][b]
    return crf


#: Layouts of composed pages: tags and names of the parts of a page.
PARTS = {
    "menu": ["nav", "ul class=menu", "div class=navbar", "div id=topnav", "div role=navigation", "div class=breadcrumbs", "ul", "ol class=nav-list"],
    "header": ["header", "div class=header", "div id=masthead", "div class=site-title", "div class=banner", "div role=banner"],
    "footer": ["footer", "div class=footer", "div id=foot", "div class=copyright", "section class=site-footer", "div role=contentinfo", "small"],
    "sidebar": ["aside", "div class=sidebar", "div id=rail", "div class=widget", "section class=related", "div role=complementary", "div class=recommended"],
    "notice": ["div class=cookie-notice", "div class=notice", "div role=alert", "div id=gdpr", "section class=consent", "div class=alert banner", "dialog"],
    "advert": ["div class=ad", "div class=advert", "div class=ads", "ins class=adsense", "div class=sponsored", "section class=promo", "div id=ad-top", "aside class=promotion"],
    "form": ["form", "form class=search", "form id=newsletter", "div class=subscribe", "form class=login"],
    "comments": ["section class=comments", "div id=comments", "ol class=commentlist", "div class=comment", "section id=discussion class=replies", "ul class=responses comments"],
}
BODIES = ["article", "main", "div class=content", "div id=content", "div class=post", "div class=entry-content", "section class=story", "div class=article-body", "div", "section", "td", "main class=page", "div role=main"]


class Composer:
    """Composes labelled pages: whatever stands in an element with data-y="1", and in none with "0" inside it, is main text."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.words = ["".join(self.rng.choice(["ta", "re", "on", "li", "ster", "ing", "ke", "mo", "en", "al", "é", "und", "ci"]) for _ in range(self.rng.randint(1, 4))) for _ in range(3000)]

    def sentence(self, low: int = 3, high: int = 25) -> str:
        words = self.rng.choices(self.words, k=self.rng.randint(low, high))
        if len(words) > 8 and self.rng.random() < 0.5:
            words[len(words) // 2] += ","
        return " ".join(words).capitalize() + self.rng.choice(["."] * 8 + ["?", "!"])

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, most)))

    def short(self) -> str:
        return " ".join(self.rng.choices(self.words, k=self.rng.randint(1, 3))).capitalize()

    def link(self, text: str) -> str:
        return f'<a href="/{self.short()}">{text}</a>'

    def element(self, kind: str, inside: str, label: str = "") -> str:
        tag, *names = kind.split(" ")
        pairs = re.findall(r"(\w+)=([^=]+?)(?= \w+=|$)", " ".join(names))
        end = "" if tag == "p" and self.rng.random() < 0.1 else f"</{tag}>"
        return f"<{tag}{''.join(f' {k}={chr(34)}{v}{chr(34)}' for k, v in pairs)}{label}>{inside}{end}"

    def paragraph(self) -> str:
        text = self.prose(self.rng.choice([1, 1, 3, 9]))
        if self.rng.random() < 0.2:
            text = self.sentence(1, 4)
        if self.rng.random() < 0.3:
            text = f"<{(t := self.rng.choice(['b', 'i', 'em', 'strong', 'span']))}>{text}" + (f"</{t}>" if self.rng.random() < 0.7 else "<br>")
        if self.rng.random() < 0.2:
            text += " " + self.link(self.short()) + " " + self.sentence()
        if self.rng.random() < 0.2:
            text += " " + self.inside() + self.rng.choice([" ", " " + self.sentence()])
        return self.element("p", text)

    def formula(self) -> str:
        parts = [self.rng.choice(["<mi>x</mi>", "<mn>2</mn>", "<msup><mi>y</mi><mn>3</mn></msup>", "<mfrac><mn>1</mn><mi>z</mi></mfrac>", "<mspace/>"]) for _ in range(self.rng.randint(1, 9))]
        return f"<mrow>{'<mo>+</mo>'.join(parts)}</mrow>"

    def inside(self) -> str:
        """An element that stands within a paragraph without cutting it."""
        kinds = [
            '<script>var b="<p>";</script>', "<style>b{}</style>", f'<svg viewBox="0 0 9 9"><title>{self.short()}</title><path d="M0 0"/><text>{self.short()}</text></svg>', f"<template><p>{self.short()}</p></template>",
            f"<math>{self.formula()}</math>", f"<math>{self.formula()}</math>", f"<button>{self.short()}</button>", f"<select><option>{self.short()}<option>{self.short()}</select>", '<picture><source srcset="a"><img src="b"></picture>',
            f"<noscript>{self.short()}</noscript>", "<canvas></canvas>", "<audio src=a></audio>", '<video src="c"></video>', f"<x-note>{self.short()}</x-note>",
        ]
        return self.rng.choice(kinds)

    def body(self) -> str:
        r = self.rng
        parts = [self.element(r.choice(["h1", "h1", "h2", "h1 class=title"]), self.prose(1)[: r.randint(20, 70)])] if r.random() < 0.9 else []
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.78:
                parts.append(self.paragraph())
            elif kind < 0.84:
                parts.append(self.element(r.choice(["h2", "h3", "h4"]), self.short() + " " + self.short()))
            elif kind < 0.89:
                parts.append(self.element(r.choice(["ul", "ol"]), "".join(self.element("li", self.sentence(2, 12)) for _ in range(r.randint(2, 5)))))
            elif kind < 0.92:
                parts.append(self.element("blockquote", self.paragraph()))
            elif kind < 0.93:
                parts.append(self.element("pre", self.prose(2)))
            elif kind < 0.94:
                parts.append(self.rng.choice(['<math display="block">', "<p><math>"]) + self.formula() + "</math>")
            elif kind < 0.96:
                parts.append(self.element("table", "".join(f"<tr><td>{self.short()}<td>{self.sentence(2, 6)}</tr>" for _ in range(3))))
            else:
                parts.append(self.part(r.choice(["advert", "advert", "sidebar", "form", "menu"]), True))
        return "".join(parts)

    def part(self, kind: str, inside: bool = False) -> str:
        r = self.rng
        of = r.choice(PARTS[kind])
        if inside and "=" not in of and of in ("ul", "small"):
            of = "div class=ad"
        if kind == "menu":
            items = [self.link(self.short()) for _ in range(r.randint(3, 9))]
            text = "".join(f"<li>{x}</li>" for x in items)
            text = text if of.split()[0] in ("ul", "ol") else f"<ul>{text}</ul>" if r.random() < 0.7 else r.choice([" | ", " &middot; ", " "]).join(items)
        elif kind == "header":
            text = r.choice([self.link(self.short()), f"<h2>{self.short()}</h2><p>{self.sentence(2, 8)}</p>", self.short()])
        elif kind == "footer":
            text = r.choice(["&copy; ", "© ", "&copy; 2020 "]) + self.short() + r.choice([" &middot; ", " | ", ". "]) + r.choice([self.sentence(), self.prose(2), self.link(self.short())])
        elif kind == "sidebar":
            text = f"<h3>{self.short()}</h3>" + r.choice([self.element("p", self.prose(2)), "<ul>" + "".join(f"<li>{self.link(self.sentence(2, 8))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"])
        elif kind == "notice":
            text = r.choice([self.prose(2), f"<p>{self.prose(2)}</p>"]) + r.choice(["", " <button>Ok</button>", " " + self.link(self.short())])
        elif kind == "advert":
            text = r.choice([self.sentence(), self.prose(2), self.short(), self.link(self.sentence()), f"<p>{self.sentence()}</p>"])
        elif kind == "form":
            text = f"<label>{self.short()}</label> <input name=q> <button>{self.short()}</button>" + r.choice(["", f"<p>{self.sentence()}</p>", f"<select><option>{self.short()}<option>{self.short()}</select>", f"<textarea>{self.short()}</textarea>"])
        else:
            tag = "li" if of.split()[0] in ("ul", "ol") else r.choice(["div class=comment", "article class=comment", "p"])
            text = r.choice(["", f"<h3>{self.short()}</h3>"]) + "".join(self.element(tag, r.choice(["", f"<b>{self.short()}</b> "]) + self.prose(3)) for _ in range(r.randint(1, 5)))
        return self.element(of, text, ' data-y="0"')

    def page(self) -> str:
        r = self.rng
        before = [self.part(k) for k, p in (("notice", 0.25), ("header", 0.5), ("menu", 0.85), ("advert", 0.5), ("form", 0.25)) if r.random() < p]
        after = [self.part(k) for k, p in (("advert", 0.2), ("comments", 0.35), ("sidebar", 0.45), ("form", 0.15), ("menu", 0.2), ("footer", 0.9), ("notice", 0.15)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
        if r.random() < 0.15:
            before.append(self.part("sidebar"))
        body = self.element(r.choice(BODIES), self.body(), ' data-y="1"')
        if r.random() < 0.3:
            body = self.element(r.choice(["div class=wrap", "div id=page", "div", "main", "table"]), body)
        if r.random() < 0.05:
            body = ""
        ends = "</body></html>" if r.random() < 0.8 else ""
        return f"<!DOCTYPE html><html><head><title>{self.short()}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>{''.join(before)}<!-- {self.short()} -->{body}{''.join(after)}{ends}"


def labelled(n: int, seed: int) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of composed pages."""
    composer = Composer(seed)
    pages = [blocks(composer.page()) for _ in range(n)]
    return [(features(p), [int(b.main) for b in p]) for p in pages]


TRAINING_PAGES, TRAINING_SEED = 500, 11


def trained() -> Field:
    return learn(labelled(TRAINING_PAGES, TRAINING_SEED))


def main_text(page: str | None, crf: Field, wanted: frozenset[str] | None = None) -> str:
    """Blocks of main text in page order, joined by an empty line. `wanted` is crf.names()."""
    found = blocks(page, crf.names() if wanted is None else wanted)
    return "\n\n".join(b.text for b, y in zip(found, crf.best(features(found)), strict=True) if y)


def extracted(pages: DataFrame, crf: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    # some thousand weights, whatever the input
    shared = pages.sparkSession.sparkContext.broadcast(crf or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf, wanted = shared.value, shared.value.names()
        for batch in batches:
            text = [main_text(p, crf, wanted) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
