"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A logistic regression gives each block the cost of being content
and of being boilerplate; these are the capacities of its edges to source and sink. Neighbouring
blocks, and successive blocks of one parent, are joined by edges whose capacity grows with the depth of
the DOM they share. The maximum flow's cut separates content from boilerplate at the least total cost.
Elements that say what they are (article, nav, footer, class names such as ad or cookie) add to the
costs. Class names and ids weigh less than elements, so that a block's costs and its neighbours may
outvote them, and ids that may be anchors weigh least. Names of comments, and articles below a
heading of comments in one element, are boilerplate wherever they stand. What a wrapper's class, id or form says ends at
a main in it, and at an article unless the page has one that no such wrapper holds.

The regression learns from pages whose elements say what they are, on at most `max_pages` pages
chosen by a hash of their html; every page is extracted whole. Without such pages only the elements
count. Null and empty html give an empty text; markup that is cut off is left out. Scripts, styles,
frames and text areas end at their own end tag only. Drawings, controls, templates and what is shown
in place of an object, canvas or script are left out; one without an end tag of its own ends with the
element around it, or at the next block in it. Formulas are text.
"""

import html
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallyline.llm.common import filled, ship_package

MAX_PAGES = 2000
FEATURES = 9
SAID, NEAR, SAME_PARENT = 6.0, 0.4, 0.8  # weights of named elements, of neighbours and of siblings
NAMED, ANCHOR = 3.2 / SAID, 2.0 / SAID  # parts of SAID that class names and ids say, and other ids inside content

#: Element and class names of the HTML standard and of common usage.
RAW = {"script", "style", "iframe", "textarea"}  # hold no markup
DROPPED = {"noscript", "template", "svg", "object", "canvas", "select", "button", "annotation", "annotation-xml"}
SKIPPED = RAW | {"head"}
FOREIGN, BACK = {"svg", "math"}, {"foreignobject", "desc", "title", "annotation-xml", "mtext"}  # HTML begins again in BACK
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var", "wbr", "br",
    "math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot",
    "mover", "munder", "munderover", "mstyle", "merror", "mpadded", "mphantom", "mfenced", "menclose", "mmultiscripts",
    "mprescripts", "none", "mtable", "mtr", "mlabeledtr", "mtd", "maction",
}
#: Start tags that end an element of DROPPED or FOREIGN without an end tag of its own.
BREAKOUT = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "div", "dl", "dt", "fieldset", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "tbody",
    "td", "th", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu"}
BOILERPLATE_OUTSIDE = {"header", "dialog", "fieldset", "address"}  # inside content they are a part of it
CONTENT = {"article", "main"}
CONTENT_NAMES = {"article", "content", "entry", "main", "post", "story"}
BOILERPLATE_NAMES = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "footer", "form", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "pagination", "popup", "promo", "promotion", "related", "search", "share", "sharing", "sidebar", "signup", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
COMMENT_NAMES = {
    "comment", "comments", "commentlist", "commentarea", "commentbody", "commentsection", "commentthread", "commentwrapper",
    "disqus", "replies", "reply", "respond", "responses",
}
#: Class names with one of these words tell what an element is not, or what is in it.
MODIFIERS = {"has", "have", "hide", "no", "non", "not", "overflow", "with", "without"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
WRAPPERS = {"form", "fieldset"}  # may hold a whole page
BOILERPLATE_ROLES = {"alert", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "navigation", "search"}

COMMENTS = re.compile(r"(?:\d+ |all |reader |readers' |user )?(?:comments?|replies|responses)(?: ?\(?\d+\)?)?|leave a (?:comment|reply)", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
STATING = {"class", "id", "role", "hidden", "aria-hidden"}
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _says(tag, attributes, inside_content):
    """What an element says of itself, from 1 for content to -1 for boilerplate, and whether a wrapper may say it.

    A name that stands alone outranks names that are parts of a longer one, and an article or main is what
    its element says, whatever its own names are, unless they are those of comments.
    """
    if tag in BOILERPLATE or tag in BOILERPLATE_OUTSIDE and not inside_content:
        return -1.0, tag in WRAPPERS
    alone, parts, anchored = set(), set(), False
    if attributes and tag not in ("html", "body"):
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name not in STATING:
                continue
            value = a or b or c
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return -1.0, False
            if name == "role":
                if value.lower() in BOILERPLATE_ROLES:
                    return -1.0, value.lower() in WRAPPERS
                continue
            for one in value.split():
                words = set(SPLIT.split(CAMEL.sub(" ", one).lower()))
                if words & MODIFIERS or name == "id" and tag in HEADINGS:
                    continue
                if words & COMMENT_NAMES and tag != "main":
                    return -1.0, False
                if name == "id" and tag == "section" and inside_content:  # an anchor made of a heading's words
                    continue
                bad, good = bool(words & BOILERPLATE_NAMES), bool(words & CONTENT_NAMES)
                if name == "id" and bad:
                    anchored = True
                else:
                    (alone if len(words) == 1 else parts).update([-1] * bad + [1] * good)
    if tag in CONTENT:
        return 1.0, False
    named = alone or parts
    if 1 in named:  # names of both kinds are no statement
        return (0.0 if -1 in named or anchored else NAMED), False
    if -1 in named or anchored:
        return (-NAMED if -1 in named or not inside_content else -ANCHOR), True
    return 0.0, False


class Place:
    """A block element of the DOM: its parent, and how deep it lies."""

    __slots__ = ("parent", "depth", "comments")

    def __init__(self, parent):
        self.parent, self.depth = parent, parent.depth + 1 if parent else 0
        self.comments = None  # the block of a heading of comments in it


def shared_depth(a, b):
    """How many elements two places have in common."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a.depth


class Block:
    __slots__ = ("text", "place", "tag", "said", "linked", "wrapped")

    def __init__(self, text, place, tag, said, linked, wrapped):
        self.text, self.place, self.tag, self.said, self.linked, self.wrapped = text, place, tag, said, linked, wrapped


def _tokens(page):
    """Text and tags of a page as (text, "", "", False) or (None, tag, attributes, ends), without comments and SKIPPED elements."""
    out, at, size = [], 0, len(page)
    while at < size:
        token = TOKEN.search(page, at)
        if token is None:
            out.append((page[at:], "", "", False))
            break
        if token.start() > at:
            out.append((page[at:token.start()], "", "", False))
        at = token.end()
        tag = (token[2] or token[5] or "").lower()
        if not tag:
            continue
        ends = bool(token[1] or token[4])
        if not ends and tag in SKIPPED:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            if stop:
                at = stop.end()
            elif tag != "head":
                break
            continue
        out.append((None, tag, token[3] or token[6] or "", ends))
    return out


def _closed(tokens):
    """The place of the end tag of each DROPPED element that has its own, by the place of its start tag."""
    found, stack, opened = {}, [], Counter()  # stack: (tag, place)
    for at, (part, tag, attributes, ends) in enumerate(tokens):
        if part is not None or tag in VOID:
            continue
        if ends:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None) if opened[tag] else None
            if depth is None or tag in INLINE and any(s[0] not in INLINE for s in stack[depth:]):
                continue
            if tag in DROPPED:
                found[stack[depth][1]] = at
            opened.subtract(s[0] for s in stack[depth:])
            del stack[depth:]
            continue
        if tag in BREAKOUT and any(opened[t] for t in FOREIGN):
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in FOREIGN or stack[i][0] in BACK), None)
            if depth is not None and stack[depth][0] in FOREIGN:
                opened.subtract(s[0] for s in stack[depth:])
                del stack[depth:]
        if not attributes.endswith("/") or tag not in DROPPED and tag not in FOREIGN and not any(opened[t] for t in FOREIGN):
            stack.append((tag, at))
            opened[tag] += 1
    return found


def _shown(page):
    """The tokens of a page without DROPPED elements."""
    tokens = _tokens(page)
    if not any(tag in DROPPED or tag in FOREIGN for _, tag, _, _ in tokens):
        return tokens
    out, at, within, closed = [], 0, None, _closed(tokens)
    while at < len(tokens):
        part, tag, attributes, ends = tokens[at]
        if part is None and not ends and (tag in DROPPED or tag in FOREIGN):
            if attributes.endswith("/"):
                at += 1
                continue
            if tag in DROPPED:
                if at in closed:
                    at = closed[at]
                elif within is None:
                    within = []  # what was opened in an element that is not closed
                at += 1
                continue
        if within is not None and part is None:
            if ends and tag in within:
                del within[len(within) - 1 - within[::-1].index(tag):]
            elif ends and tag not in DROPPED or not ends and tag in BREAKOUT:
                within = None
            elif not ends and tag not in VOID and not attributes.endswith("/"):
                within.append(tag)
        if within is None and not (ends and tag in DROPPED):
            out.append(tokens[at])
        at += 1
    return out


def blocks_of(page):
    """The text blocks of a page in order."""
    out, held, linked = [], [], 0
    # (tag, block element around, what the nearest named element says, whether a wrapper says it, what a wrapper says of the article, its tag)
    stack, opened = [], Counter()
    root, links = Place(None), 0

    def close():
        nonlocal held, linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                place, said, wrapped, tag = (*stack[-1][1:3], *stack[-1][4:]) if stack else (root, 0.0, 0.0, "")
                out.append(Block(text, place, tag, said, min(1.0, linked / len(text)), wrapped))
                if tag in HEADINGS and COMMENTS.fullmatch(text):
                    place.parent.comments = out[-1]
        held, linked = [], 0

    def add(part):
        nonlocal linked
        held.append(part)
        if links:
            linked += len(part)

    for part, tag, attributes, ends in _shown(page):
        if part is not None:
            add(part)
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag not in INLINE:
            close()
        if ends:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None) if opened[tag] else None
            if depth is not None and not (tag in INLINE and any(s[0] not in INLINE for s in stack[depth:])):
                links -= sum(s[0] == "a" for s in stack[depth:])
                opened.subtract(s[0] for s in stack[depth:])
                del stack[depth:]
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:  # a new block ends open paragraphs, items and inline elements
            ended = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
            while stack and (stack[-1][0] in INLINE or stack[-1][0] == "p" or stack[-1][0] in ended.get(tag, ())):
                opened[stack[-1][0]] -= 1
                links -= stack.pop()[0] == "a"
        place, above, by_wrapper, wrapped, around = stack[-1][1:] if stack else (root, 0.0, False, 0.0, "")
        said, wrapper = _says(tag, attributes, above > 0) if tag not in INLINE else (0.0, False)
        if tag == "article" and place.comments:
            said = place.comments.said = -1.0
        if said == 0 or above < 0 and not (by_wrapper and said == 1.0) and not (by_wrapper and said <= above):
            said, wrapper = above, by_wrapper
        elif above < 0 and said > 0:
            wrapped = 0.0 if tag == "main" else above
        elif said < 0:
            wrapped = 0.0
        if tag not in INLINE:
            place, around = Place(place), tag
        stack.append((tag, place, said, wrapper, wrapped, around))
        opened[tag] += 1
        links += tag == "a"
    close()
    if any(b.said == 1.0 and not b.wrapped for b in out):
        for block in out:
            block.said = block.wrapped or block.said
    return out


def block_features(blocks):
    """A row of numbers for each block, none of which depends on what elements say."""
    rows = np.zeros((len(blocks), FEATURES))
    for i, block in enumerate(blocks):
        words = block.text.count(" ") + 1
        stops = sum(map(block.text.count, ".,;!?"))
        rows[i] = (
            1, np.log1p(words), block.linked, block.tag in ("li", "td", "dd", "dt"), block.tag in ("p", ""),
            block.tag in ("h1", "h2", "h3", "h4"), min(1.0, 5 * stops / words), words < 4, "©" in block.text,
        )
    return rows


def fit_costs(rows, labels, counts, rounds=200, rate=0.5, decay=1e-3):
    """Logistic regression by gradient descent; both kinds count alike."""
    weights = np.zeros(FEATURES)
    kinds = [counts[labels == k].sum() for k in (0, 1)]
    if not all(kinds):
        return weights
    each = counts * np.where(labels == 1, 0.5 / kinds[1], 0.5 / kinds[0])
    for _ in range(rounds):
        slope = (1 / (1 + np.exp(-rows @ weights)) - labels) * each
        weights -= rate * (rows.T @ slope + decay * weights)
    return weights


def minimum_cut(costs, edges):
    """Which nodes stay with the source: costs > 0 are capacities from it, < 0 to the sink.

    Each round pushes flow along all shortest paths from nodes that have some to nodes that take it,
    by the nodes' distances; no arc that leads nowhere is tried twice in a round.
    """
    size, least = len(costs), 1e-9
    left, arcs, to, spare = [float(c) for c in costs], [[] for _ in range(size)], [], []
    for a, b, capacity in edges:
        for x, y in ((a, b), (b, a)):  # an arc and its reverse are neighbours: e and e ^ 1
            arcs[x].append(len(to))
            to.append(y)
            spare.append(capacity)
    while True:
        front = [i for i in range(size) if left[i] > least]
        begun, distance, met = front, [-1] * size, False
        for i in front:
            distance[i] = 0
        while front and not met:
            following = []
            for a in front:
                for e in arcs[a]:
                    b = to[e]
                    if distance[b] < 0 and spare[e] > least:
                        distance[b] = distance[a] + 1
                        met = met or left[b] < -least
                        following.append(b)
            front = following
        if not met:
            return [d >= 0 for d in distance]
        tried = [0] * size
        for start in begun:
            node, path = start, []
            while left[start] > least:
                if left[node] < -least:
                    flow = min([left[start], -left[node], *(spare[e] for e in path)])
                    left[start] -= flow
                    left[node] += flow
                    for e in path:
                        spare[e] -= flow
                        spare[e ^ 1] += flow
                    node, path = start, []
                    continue
                way = next((
                    k for k in range(tried[node], len(arcs[node]))
                    if spare[arcs[node][k]] > least and distance[to[arcs[node][k]]] == distance[node] + 1
                ), None)
                if way is not None:
                    tried[node] = way
                    path.append(arcs[node][way])
                    node = to[path[-1]]
                elif path:
                    tried[node] = len(arcs[node])
                    node = to[path.pop() ^ 1]
                    tried[node] += 1
                else:
                    break


def _edges(blocks):
    last = {}
    for i, block in enumerate(blocks):
        if i:
            before = blocks[i - 1].place
            deepest = max(before.depth, block.place.depth, 1)
            yield i - 1, i, NEAR * shared_depth(before, block.place) / deepest
        parent = id(block.place.parent)
        if parent in last:
            yield last[parent], i, SAME_PARENT
        last[parent] = i


def main_text(page, weights):
    """The main text of a page: its content blocks, a line each."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    costs = np.clip(block_features(blocks) @ weights, -4, 4) + SAID * np.array([b.said for b in blocks])
    kept = minimum_cut(costs, _edges(blocks))
    return "\n".join(b.text for b, keep in zip(blocks, kept) if keep)


def fit(pages, html_col="html", max_pages=MAX_PAGES):
    """Weights of block features, from pages whose elements say what they are."""
    ship_package(pages.sparkSession)

    def said(batches):
        for batch in batches:
            for page in batch["page"]:
                blocks = [b for b in blocks_of(page) if b.said]
                if blocks:
                    rows = block_features(blocks).round(1)  # so that few kinds of blocks reach the driver
                    yield pd.DataFrame({"features": list(rows), "label": [float(b.said > 0) for b in blocks]})

    page = filled(html_col)
    marked = pages.select(page.alias("page"), F.xxhash64(page).alias("mark"))
    chosen = marked.select("mark").distinct().orderBy("mark").limit(max_pages)
    sample = marked.join(F.broadcast(chosen), "mark", "left_semi").dropDuplicates(["mark"])
    rows = sample.mapInPandas(said, "features array<double>, label double").groupBy("features", "label").count()
    frame = rows.orderBy("label", "features").toPandas()
    if not len(frame):
        return np.zeros(FEATURES)
    return fit_costs(np.array(frame["features"].tolist()), frame["label"].to_numpy(), frame["count"].to_numpy())


def extracted(pages, id_col="page_id", url_col="url", html_col="html", max_pages=MAX_PAGES):
    """A row for each row of `pages`: id_col, url_col, text, n_chars."""
    weights = fit(pages, html_col, max_pages)

    @F.pandas_udf("string")
    def text(batch: pd.Series) -> pd.Series:
        return batch.map(lambda page: main_text(page, weights))

    return pages.select(id_col, url_col, text(filled(html_col)).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
