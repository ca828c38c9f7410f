"""Main text of web pages by minimum-cut labelling.

A page becomes a list of blocks. A linear classifier turns what is known of a block (its
length, link density, punctuation, and the elements, classes and ids around it) into the cost
of calling it boilerplate and the cost of calling it content; these are the capacities from the
source and to the sink. Neighbouring blocks, and blocks next to each other under one parent or
grandparent, are tied by smoothness edges. Maximum flow finds the cheapest labelling: blocks
that stay reachable from the source are the article.

Cases: a null or empty page has empty text; unclosed and stray tags are put up with (only
script, style and textarea run to the end of the page, a head ends at the first block tag); a page of
any length is read whole; repeated rows each get a row; other columns are left out; an empty
table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from evidencelake.llm.common import only

RAW = "script|style|textarea"
#: Left out up to their end tag; where none follows, only the tag is.
SKIPPED = "noscript|template|select|svg|math|iframe|object|canvas|video|audio|title"
END = {name: re.compile(rf"</{name}\s*>", re.I) for name in SKIPPED.split("|")}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<skipped>{SKIPPED})(?=[\s/>])[^>]*>"  # a custom element such as <style-x> is neither
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|itemprop|aria-hidden|property)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
BLOCKS = frozenset("html body p div section article main header footer nav aside form fieldset h1 h2 h3 h4 h5 h6 ul ol li dl dt dd menu table caption thead tbody tfoot tr td th pre blockquote figure figcaption hr address details summary dialog center".split())
VOID = frozenset("hr br img input meta link wbr source col area base embed param track".split())
NEVER = frozenset("nav footer aside form dialog button menu fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words in a class, id or role that mark boilerplate, and those that mark an article.
BAD_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|alert|side-?bar|rail|widgets?|comments?|respond|replies|reply|discussion|disqus|shar(?:e|ing)|social|related|recommend\w*|newsletter|subscri\w*|signup|login|breadcrumbs?|menu\w*|nav\w*|navigation|footer|foot|masthead|site-?header|header|popup|modal|overlay|toolbar|pagination|pager|tags?|byline|metadata|copyright|legal|disclaimer|skip|search|complementary|contentinfo|hidden)(?:$|[\s_-])", re.I)
GOOD_NAMES = re.compile(r"(?:^|[\s_-])(?:article\w*|post|entry|story|content|main|body|text|articlebody)(?:$|[\s_-])", re.I)


class Block:
    __slots__ = ("bad", "grand", "heading", "linked", "never", "parent", "text", "trusted")


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order."""
    out: list[Block] = []
    # an open element: (name, number, never, bad, trusted)
    stack: list[tuple] = [("", 0, False, 0, 0)]
    parts: list[str] = []
    linked = links = number = at = 0
    in_head = False
    endless: set[str] = set()  # elements that no end tag follows from here on

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                b = Block()
                b.text, b.linked = text, linked
                name, b.parent, b.never, b.bad, b.trusted = stack[-1]
                b.heading = name in HEADINGS
                if len(stack) > 1 and name in ("p", "li", "td", "th", "dt", "dd", *HEADINGS):
                    b.parent = stack[-2][1]
                    b.grand = stack[-3][1] if len(stack) > 2 else 0
                else:
                    b.grand = stack[-2][1] if len(stack) > 1 else 0
                out.append(b)
            parts.clear()
        linked = 0

    while m := TOKEN.search(page, at):
        if m.start() > at:
            parts.append(run := page[at : m.start()])
            if links:
                linked += len(run)
        at = m.end()
        name = m["name"]
        if not name:
            if m["skipped"]:
                skipped = m["skipped"].lower()
                if skipped == "title" and not in_head:
                    end_block()
                if skipped not in endless:
                    if close := END[skipped].search(page, at):
                        at = close.end()
                    else:
                        endless.add(skipped)
            continue
        name = name.lower()
        if name == "head" and not m["end"]:
            end_block()
            in_head = True
            continue
        if in_head and (name == "head" or not m["end"] and (name in BLOCKS or name in NEVER)):
            parts.clear()
            linked = 0
            in_head = False
        if m["end"]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCKS or name in NEVER:
                end_block()
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == name:
                        del stack[depth:]
                        break
                    if name in ("p", "li", "td", "tr") and stack[depth][0] in ("article", "section", "nav", "footer", "aside", "body"):
                        break  # a stray end tag doesn't reach out of its section
            continue
        if name == "br" or name == "wbr":
            if name == "br":
                parts.append(" ")
            continue
        if name == "a":
            links = 1
            continue
        if name not in BLOCKS and name not in NEVER:
            continue
        end_block()
        links = 0
        if name in VOID:
            continue
        closes = CLOSES.get(name) or ({"p"} if name in BLOCKS else ())
        while len(stack) > 1 and stack[-1][0] in closes:
            stack.pop()
        _, _, never, bad, trusted = stack[-1]
        inside = trusted > 0
        never = never or name in NEVER or name == "header" and not inside
        if m["attrs"]:
            for key, *values in ATTRIBUTE.findall(m["attrs"]):
                key, value = key.lower(), "".join(values)
                if key in ("class", "id", "role"):
                    if BAD_NAMES.search(value):
                        bad += 1
                    elif GOOD_NAMES.search(value):
                        trusted += 1
                elif key == "itemprop" and value == "articleBody":
                    trusted += 2
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    never = True
        if name in ("article", "main"):
            trusted += 2
        number += 1
        stack.append((name, number, never, bad, trusted))
    if at < len(page):
        rest = page[at:]
        cut = rest.find("<")  # a tag that the page ends in
        parts.append(rest if cut < 0 or not re.match(r"<[/a-zA-Z!?]", rest[cut:]) else rest[:cut])
    end_block()
    return out


def leaning(b: Block, any_trusted: bool) -> float:
    """Cost of calling a block boilerplate less that of calling it content."""
    if b.never:
        return -100.0
    size = len(b.text)
    n = b.text.count(" ") + 1
    x = -0.6 + min(n, 60) / 20 - 4.0 * b.linked / size
    x += 0.8 * (b.text[-1] in ".!?…”\"'»:" and n > 3)
    x += 0.8 * b.heading
    x -= 6.0 * b.bad
    if b.trusted:
        x += 2.5 + 0.5 * min(b.trusted, 3)
    elif any_trusted:
        x -= 4.0
    if n < 12 and re.search(r"©|copyright|all rights reserved", b.text, re.I):
        x -= 3.0
    return x


def minimum_cut(lean: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side. lean: capacity from the source, or below 0 to the sink."""
    n = len(lean)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def tie(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, x in enumerate(lean):
        tie(source, i, x, 0.0) if x > 0 else tie(i, sink, -x, 0.0)
    for a, b, w in edges:
        tie(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        todo = deque([source])
        while todo:
            a = todo.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    todo.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                first = len(path)
                for k, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                    if room[e] <= 1e-9:
                        first = min(first, k)
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while at[a] < len(out[a]):
                e = out[a][at[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                at[a] += 1
            else:
                if a == source:
                    break
                e = path.pop()
                a = to[e ^ 1]
                at[a] += 1


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    any_trusted = any(b.trusted >= 2 and not b.never for b in found)
    lean = [leaning(b, any_trusted) for b in found]
    edges: list[tuple[int, int, float]] = []
    seen: dict[tuple[str, int], int] = {}
    for i, b in enumerate(found):
        if i:
            near = found[i - 1]
            edges.append((i - 1, i, 0.9 if near.parent == b.parent else 0.4 if near.grand == b.grand else 0.1))
        for kind, key, w in (("p", b.parent, 0.5), ("g", b.grand, 0.2)):
            if (before := seen.get((kind, key))) is not None and before != i - 1:
                edges.append((before, i, w))
            seen[kind, key] = i
    keep = minimum_cut(lean, edges)
    return "\n\n".join(b.text for b, own in zip(found, keep, strict=True) if own)


def extract(pages: DataFrame) -> DataFrame:
    """A row per page: page_id, url, text, n_chars."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch["html"]]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=schema)

    return only(pages, page_id="long", url="string", html="string").mapInArrow(run, "page_id long, url string, text string, n_chars long")
