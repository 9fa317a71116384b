"""Main text of HTML pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. A word's score is a sum of learned weights: one
for being a word, and one for each telling element it stands in (links, lists, headings,
nav, footer, ... or a class, id or role such as "ad"); tags score negative. All weights are
learned from labelled pages, by default pages written by rule whose article is known: a
logistic model for the words, log odds for the tags. Words of a block (a stretch of text
between block elements) count together. A block under boilerplate costs no more than its
own log odds of standing in the middle of an article, so an advert there doesn't end it.
One linear scan finds the contiguous region of the largest sum, and blocks inside it whose
own words sum to less than nothing are left out. Nothing else is dropped.

A class, id or role tells by the first or last word of a token ("cookie-notice", "site-footer",
not "has-sidebar"), and tells something else when its element wraps an article, main or h1 or, on
pages without these, half of the words that stand outside elements named as boilerplate.

Two features need no list of names. A block outside headings is linked when four fifths of its
words are links. On pages without article and main, boxes (div, list or table, each with a class
or id) stand apart from the one that holds the article: that of the first h1 if it holds a quarter
as many words as the fullest, else the fullest. Boxes around it, those that share parent, element
and class with it, and those whose name tells content do not stand apart; and nothing does where
what stands apart would be more than the rest (a long comment thread of unknown name stays then).

Defined cases: null or empty html, and pages without words that score positive, give the
empty text. Unclosed, truncated and overlapping tags are read as far as they go; an
unclosed script, style or comment reaches to the end of the page. Repeated rows are all
returned; other columns of pages are not looked at. Time is linear in the page.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Elements whose content is raw text and never shown as text, and others that show no text of the page.
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
SILENT = frozenset("select datalist svg object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements and class words whose weights are learned: those that stand for boilerplate, and neutral ones.
NAMED = tuple("nav aside footer header form button dialog menu".split())
NEUTRAL = tuple("a li p h1 h2 h3 td blockquote pre article main".split())
CLASSES = tuple(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related replies reply share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Also: under a class word that wraps the article; outside the page's article and main; above its
#: first h1 where it has neither; in a box apart from the article's; mostly links.
FEATURES = (*NAMED, *NEUTRAL, *(f".{c}" for c in CLASSES), ".wrap", ".outside", ".above", ".apart", ".linked")
#: Words that make a token of a class tell nothing, elements that are boxes, and words that tell content.
NEGATING = frozenset("has no not is with without free section table".split())
BOXES = frozenset("div ul ol dl table".split())
CONTENT = frozenset("article body caption chapter code content entry figure highlight intro lead main math page paragraph post quote row section story summary table text".split())
_BIT = {f: 1 << k for k, f in enumerate(FEATURES)}
_NAMED = sum(_BIT[n] for n in NAMED)
#: Where these change, a block ends.
_MARKS = _NAMED | sum(_BIT[f".{c}"] for c in CLASSES) | _BIT[".apart"]
_HEADINGS = _BIT["h1"] | _BIT["h2"] | _BIT["h3"]
_CLASS_WORDS = frozenset(CLASSES)
#: Elements closed by the start of another block.
_SELF_CLOSING = {"li": ("li",), "dt": ("dd", "dt"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9]*)")
_SPACE = re.compile(r"\s+")
_QUOTED_END = re.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*+>""")


class Block(NamedTuple):
    """Text between block boundaries, and how many of its words stand under which features (a bit each)."""

    text: str
    words: tuple[tuple[int, int], ...]

    @property
    def marked(self) -> bool:
        return bool(self.words[0][0] & (_MARKS | _BIT[".linked"]))


class Weights(NamedTuple):
    """A word's own weight, the features' (by FEATURES), the tags' ("<p", "</p"; "<" for others) and the least of a block under boilerplate."""

    word: float
    features: tuple[float, ...]
    tags: dict[str, float]
    gap: float


def class_word(attributes: str) -> str | None:
    """The telling word of the first token of class, id or role that begins or ends with one."""
    for token in _tokens(attributes):
        words = re.findall("[a-z]+", token)
        if words and NEGATING.isdisjoint(words):
            for word in (words[0], words[-1]):
                if word in _CLASS_WORDS:
                    return word
    return None


def _tokens(attributes: str) -> list[str]:
    return [t for m in _ATTRIBUTE.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").lower().split()] if attributes else []


def _box(name: str, attributes: str) -> tuple[str, bool] | None:
    """What a box is called, by element and class without digits, and whether that tells content."""
    tokens = _tokens(attributes) if name in BOXES else ()
    if not tokens:
        return None
    words = sorted({w for t in tokens for w in re.findall("[a-z]+", t)})
    return f"{name} {' '.join(words)}", not CONTENT.isdisjoint(words)


def _implied_end(stack: list[str], opened: Counter, name: str) -> int | None:
    """Where the stack is cut by the start of an element whose predecessor needs no end tag."""
    ends = _SELF_CLOSING.get(name)
    if ends is None and name in INLINE:
        return None
    if any(opened[e] for e in ends or ("p",)):
        for at in range(len(stack) - 1, -1, -1):
            top = stack[at]
            if top in (ends or ("p",)):
                return at
            if name in ("tr", "td", "th"):
                over = top != "table" and (top != "tr" or name == "tr")
            else:
                over = top in INLINE or bool(ends) and top in ("p", "div", "address")
            if not over:
                break
    return len(stack) - 1 if stack and stack[-1] == "p" and ends else None


def steps(page: str) -> list[tuple[str, str, int]]:
    """The page as (kind, text, features): kind "text", a tag ("<p", "</p"), or "gap" where something silent stood."""
    out: list[tuple[str, str, int]] = []
    stack: list[str] = []
    opened: Counter = Counter()  # names in the stack
    mask = silent = 0  # features of the names in the stack; depth at which silence began, plus one
    spans: list[list] = []  # [first step, last + 1, class word] of elements with one
    boxes: list[list] = []  # [first step, last + 1, (called, tells content)]
    open_spans: list[tuple[int, list]] = []

    def cut(depth: int) -> None:
        nonlocal mask, silent
        while len(stack) > depth:
            name = stack.pop()
            opened[name] -= 1
            if not opened[name] and name in _BIT:
                mask &= ~_BIT[name]
        if silent and len(stack) < silent:
            silent = 0
            out.append(("gap", "", mask))
        while open_spans and len(stack) < open_spans[-1][0]:
            open_spans.pop()[1][1] = len(out)

    pos, n = 0, len(page)
    while pos < n:
        lt = page.find("<", pos)
        lt = n if lt < 0 else lt
        if lt > pos and not silent:
            out.append(("text", page[pos:lt], mask))
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            pos = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            pos = n if end < 0 else end + 1
            continue
        m = _NAME.match(page, lt + 1)
        if not m:
            if not silent:
                out.append(("text", "<", mask))
            pos = lt + 1
            continue
        q = _QUOTED_END.match(page, m.end())
        end = q.end() if q else page.find(">", m.end()) + 1
        if not end:
            break  # a tag cut off at the end of the page
        name, closing, attributes = m[1].lower(), page[lt + 1] == "/", page[m.end() : end - 1]
        pos = end
        if closing:
            if opened[name]:
                at = len(stack) - 1
                while stack[at] != name:
                    at -= 1
                cut(at)
            if not silent:
                out.append(("</" + name, "", mask))
            continue
        if name in RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{name}\s*>", re.I).search(page, end)
            pos = close.end() if close else n
            if not silent:
                out.append(("gap", "", mask))
            continue
        at = 0 if name == "body" else _implied_end(stack, opened, name)
        if at is not None:
            cut(at)
        if not silent:
            out.append(("<" + name, "", mask))
        if name not in VOID and not attributes.endswith("/"):
            stack.append(name)
            opened[name] += 1
            if name in _BIT:
                mask |= _BIT[name]
            if not silent and name in SILENT:
                silent = len(stack)
            if name not in ("html", "body", "article", "main") and (word := class_word(attributes)):
                spans.append([len(out) - 1, n, word])
                open_spans.append((len(stack), spans[-1]))
            elif not silent and (box := _box(name, attributes)):
                boxes.append([len(out) - 1, n, box])
                open_spans.append((len(stack), boxes[-1]))
    for _, span in open_spans:
        span[1] = len(out)
    return _with_boxes(_with_place(_with_classes(out, spans) if spans else out), boxes)


def _with_place(out: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """The steps with the features of standing outside the article, or above the heading."""
    inside = _BIT["article"] | _BIT["main"]
    if any(mask & inside for _, _, mask in out):
        return [(kind, s, mask if mask & inside else mask | _BIT[".outside"]) for kind, s, mask in out]
    first = next((i for i, (kind, _, mask) in enumerate(out) if kind == "<h1" and not mask & _MARKS), 0)
    return [(kind, s, mask | _BIT[".above"]) for kind, s, mask in out[:first]] + out[first:]


def _with_boxes(out: list[tuple[str, str, int]], boxes: list[list]) -> list[tuple[str, str, int]]:
    """The steps with the feature of boxes apart from the article's; boxes of one parent and name are one."""
    inside = _BIT["article"] | _BIT["main"]
    if not boxes or any(mask & inside for _, _, mask in out):
        return out
    kinds: dict[tuple[int, str], int] = {}
    parent, content = [-1], [True]  # of each kind of box; the page itself is the first
    place, held = [], []
    words: Counter = Counter()
    title, k, at = None, 0, 0
    for i, (kind, s, mask) in enumerate(out):
        while held and held[-1][0] <= i:
            at = held.pop()[1]
        while k < len(boxes) and boxes[k][0] <= i:
            _, end, (called, tells) = boxes[k]
            held.append((end, at))
            if (at, called) not in kinds:
                kinds[at, called] = len(parent)
                parent.append(at)
                content.append(tells)
            at = kinds[at, called]
            k += 1
        place.append(at)
        if not mask & _MARKS:
            if kind == "text" and not mask & (_HEADINGS | _BIT["a"]):
                words[at] += len(s.split())
            if kind == "<h1" and title is None:
                title = at
    most = max(words, key=lambda b: (words[b], -b), default=0)
    best = title if title is not None and 4 * words[title] >= max(1, words[most]) else most
    apart = [False]
    around = {0}
    while best > 0:
        around.add(best)
        best = parent[best]
    for b in range(1, len(parent)):  # a parent comes before its boxes
        apart.append(apart[parent[b]] or b not in around and not content[b])
    if 2 * sum(n for b, n in words.items() if apart[b]) > sum(words.values()):
        return out
    bit = _BIT[".apart"]
    return [(kind, s, mask | bit if apart[b] else mask) for (kind, s, mask), b in zip(out, place)]


def _with_classes(out: list[tuple[str, str, int]], spans: list[list]) -> list[tuple[str, str, int]]:
    """The steps with the features of class words over their spans."""
    words, marks = [0], [0]
    for kind, s, mask in out:
        words.append(words[-1] + (len(s.split()) if kind == "text" and not mask & _NAMED else 0))
        marks.append(marks[-1] + (kind in ("<article", "<main", "<h1")))
    events: list[tuple[int, int, str]] = []
    for a, b, word in spans:
        wraps = marks[b] > marks[a] or not marks[-1] and 2 * (words[b] - words[a]) >= max(1, words[-1])
        events += [(a, 1, ".wrap" if wraps else f".{word}"), (b, -1, ".wrap" if wraps else f".{word}")]
    events.sort()
    held: Counter = Counter()
    new, more, k = [], 0, 0
    for i, (kind, s, mask) in enumerate(out):
        while k < len(events) and events[k][0] <= i:
            _, by, f = events[k]
            held[f] += by
            more = more | _BIT[f] if held[f] else more & ~_BIT[f]
            k += 1
        new.append((kind, s, mask | more))
    return new


def blocks_and_tags(page: str) -> list[Block | str]:
    """The page's blocks, each between the tags (or gaps) around it."""
    out: list[Block | str] = []
    held: list[str] = []
    counts: dict[int, int] = {}
    inner: list[str] = []  # inline tags of the block
    state = 0

    def close() -> None:
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            if text:
                linked = sum(n for mask, n in counts.items() if mask & _BIT["a"] and not mask & _HEADINGS)
                more = _BIT[".linked"] if linked and 5 * linked >= 4 * sum(counts.values()) else 0
                out.append(Block(text, tuple((mask | more, n) for mask, n in counts.items())))
            held.clear()
            counts.clear()
        out.extend(inner)
        inner.clear()

    for kind, s, mask in steps(page):
        if kind == "text":
            if mask & _MARKS != state:
                close()
                state = mask & _MARKS
            held.append(s)
            # Text between two inline tags may be less than a word; it still weighs something.
            counts[mask] = counts.get(mask, 0) + (len(s.split()) or 0)
        elif kind == "gap":
            close()
        elif kind == "<br":
            held.append(" ")
        elif kind.strip("</") in INLINE:
            inner.append(kind)
        else:
            close()
            if not mask & _MARKS:
                out.append(kind)
    close()
    return out


def labelled_pages(count: int = 600, seed: int = 11) -> list[tuple[str, str]]:
    """The default labelled pages: html and its main text, written by rule."""
    r = random.Random(seed)
    said = lambda a, b: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(r.randint(a, b)))
    links = lambda a, b: "".join(f'<li><a href="/{k}">{said(1, 3)}</a></li>' for k in range(r.randint(a, b)))

    def boilerplate(inside_article: bool = False) -> str:
        """Something that no article has: named, called so by a class, a list or table of links, or outside it and called anything."""
        inside = r.choice([f"<ul>{links(2, 9)}</ul>", f"<p>{said(4, 30)}</p>", said(3, 25), f"<p>{said(2, 9)} <a href=x>{said(1, 4)}</a></p>", f"<h2>{said(1, 3)}</h2><ul>{links(2, 6)}</ul>", f"<h3>{said(1, 3)}</h3><p>{said(5, 20)}</p>"])
        kind = r.random()
        if kind < 0.35:
            name = r.choice(NAMED)
            title = f"<h1>{said(1, 4)}</h1>" if name == "header" and r.random() < 0.3 else ""
            return f"<{name}>{title}{inside}</{name}>"
        if kind < 0.7:
            return f'<{(t := r.choice(["div", "div", "section", "ul", "p"]))} {r.choice(["class", "class", "id"])}="{r.choice(CLASSES)}">{said(3, 25) if t in ("p", "ul") else inside}</{t}>'
        if kind < 0.8:
            return f"<div><ul>{links(3, 12)}</ul></div>"
        if kind < 0.9 or inside_article:
            return f"<table>{''.join(f'<tr><td><a href=/{k}>{said(1, 3)}</a></td></tr>' for k in range(r.randint(2, 8)))}</table>"
        return f'<div {r.choice(["class", "id"])}="{said(1, 1)}-{said(1, 1)}">{inside}</div>'

    out = []
    for _ in range(count):
        lines: list[str] = []

        def block(tag: str, a: int, b: int) -> str:
            text = said(a, b)
            lines.append(text)
            if r.random() < 0.2:
                first, _, rest = text.partition(" ")
                text = f"<a href=x>{first}</a> {rest}" if rest else f"<b>{first}</b>"
            return f"<{tag}>{text}</{tag}>"

        body = block("h1", 2, 9) if r.random() < 0.85 else ""
        for _ in range(r.randint(1, 8)):
            kind = r.random()
            if kind < 0.65:
                body += block("p", 1, 90)
            elif kind < 0.72:
                body += block(r.choice(["h2", "h3"]), 1, 6)
            elif kind < 0.8:
                body += "<ul>" + "".join(block("li", 3, 20) for _ in range(r.randint(2, 5))) + "</ul>"
            elif kind < 0.86:
                body += block(r.choice(["blockquote", "pre", "div"]), 3, 40)
            elif kind < 0.9:
                body += "<table><tr>" + block("td", 1, 9) + block("td", 1, 9) + "</tr></table>"
            else:
                body += boilerplate(True)
        tag = r.choice(["article", "article", "main", "div", "section", f'div class="{r.choice(CLASSES)}"' if "<h1>" in body else "div"])
        # What stands outside an article, or above its heading, needs no telling name.
        stray = lambda odds: f"<{(t := r.choice(['p', 'div', 'h2']))}>{said(2, 25)}</{t}>" if r.random() < odds else ""
        named = tag in ("article", "main")
        before, after = (stray(odds) + "".join(boilerplate() for _ in range(r.randint(1, 3))) + stray(odds) for odds in (0.3 if named or body.startswith("<h1>") else 0, 0.3 if named else 0))
        out.append((f"<html><head><title>{said(3, 8)}</title></head><body>{before}<{tag}>{body}</{tag.split()[0]}>{after}</body></html>", "\n".join(lines)))
    return out


def learn_weights(pages: list[tuple[str, str]] | None = None, rounds: int = 25, ridge: float = 0.05) -> Weights:
    """Weights from labelled pages (html, main text): blocks that are lines of the text are inside.

    A word counts as a sample of its block's features; Newton's method fits the logistic
    model. Tags between the first and the last inside block are inside.
    """
    samples: Counter = Counter()
    tags = {True: Counter(), False: Counter()}
    gaps = {True: 1, False: 1}
    for page, text in labelled_pages() if pages is None else pages:
        lines = set(text.split("\n"))
        found = blocks_and_tags(page)
        inside = [k for k, x in enumerate(found) if isinstance(x, Block) and x.text in lines]
        for k, x in enumerate(found):
            if isinstance(x, Block):
                if x.marked and x.text not in lines:
                    gaps[bool(inside) and inside[0] < k < inside[-1]] += 1
                for mask, n in x.words:
                    # Long blocks say no more about their features than others of twenty words.
                    samples[mask, x.text in lines] += min(n, 20)
            else:
                tags[bool(inside) and inside[0] <= k <= inside[-1]][x] += 1
    keys = sorted(samples)
    x = np.array([[1.0, *(float(mask >> k & 1) for k in range(len(FEATURES)))] for mask, _ in keys]).reshape(len(keys), len(FEATURES) + 1)
    y, n = np.array([float(z) for _, z in keys]), np.array([float(samples[k]) for k in keys])
    w = np.zeros(len(FEATURES) + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.clip(np.linalg.solve(hess, x.T @ (n * (y - p)) - ridge * w), -2, 2)
    total = {k: sum(c.values()) + 1 for k, c in tags.items()}
    odds = {t: math.log((tags[True][t] + 0.5) / total[True]) - math.log((tags[False][t] + 0.5) / total[False]) for t in tags[True] | tags[False]}
    # A word by itself scores positive, and a tag negative but less than a word.
    word = max(0.5, float(w[0]))
    return Weights(word, tuple(w[1:].tolist()), {t: min(-0.001, max(-0.1, v / 10)) for t, v in odds.items()} | {"<": -0.01}, min(-0.001, math.log(gaps[True] / gaps[False])))


def score(x: Block | str, weights: Weights, known: dict[int, float]) -> float:
    """A block's sum over its words, never below the gap's under boilerplate, or a tag's weight; known keeps sums by features."""
    if isinstance(x, str):
        return weights.tags.get(x, weights.tags["<"])
    total = 0.0
    for mask, n in x.words:
        each = known.get(mask)
        if each is None:
            each = known[mask] = weights.word + sum(v for k, v in enumerate(weights.features) if mask >> k & 1)
        total += n * each
    return max(total, weights.gap) if total < 0 and x.marked else total


def region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the largest total score; the first of equals."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, at = total, (start, i + 1)
    return at


def main_text(page: str, weights: Weights, known: dict[int, float] | None = None) -> str:
    found = blocks_and_tags(page)
    known = {} if known is None else known
    scores = [score(x, weights, known) for x in found]
    a, b = region(scores)
    return "\n".join(x.text for x, s in zip(found[a:b], scores[a:b]) if isinstance(x, Block) and s > 0)


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text) of every page."""
    weights = learn_weights() if weights is None else weights

    def run(chunks):
        known: dict[int, float] = {}
        for chunk in chunks:
            for page_id, url, page in chunk:
                yield page_id, None if url is None else url.decode(), main_text((page or b"").decode(), weights, known)

    return map_rows(pages, ["page_id", "url", "html"], "page_id long, url string, text string", run)


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))
