"""Main text of HTML pages by minimum-cut labelling.

A page becomes blocks of text. A linear classifier over a block's tags, class words, links, words and place gives the cost
of calling it content or boilerplate: the capacities of its edges to source and sink. Blocks that follow each other, or
share a parent in the document tree, are tied by smoothness edges. The maximum flow leaves the cheapest labelling: blocks
on the source side are content.
"""

import html as entities
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyseries.llm.frames import by_bytes

# Fixed names of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN_TAGS = frozenset("script style template noscript iframe object svg math canvas audio video head title textarea xmp noembed noframes".split())
FRAME_TAGS = frozenset("nav footer aside button select menu dialog option".split())
FORM_TAGS = frozenset("form fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# These close an open element of their own kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_FRAME_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|"
    r"sidebar|side-?bar|rail|widgets?|menu|nav|navbar|navigation|breadcrumbs?|pager|pagination|footer|masthead|topbar|toolbar|"
    r"comments?|commentlist|respond|disqus|replies|reply|share|sharing|social|related|recommended|login|signup|search|copyright|disclaimer|skip)(?=$|[\s_-])",
    re.IGNORECASE,
)
_COMMENT_WORDS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|disqus|replies|reply)(?=$|[\s_-])", re.IGNORECASE)
# Class words that say what a page has or lacks, not what the element is.
_LAYOUT_WORDS = re.compile(r"(?:^|(?<=[\s_-]))(?:no|without|has|with)[_-][a-z]+", re.IGNORECASE)
_MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text)(?=$|[\s_-])", re.IGNORECASE)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
# Between attributes, the name of one, what stands between name and value, and a value without quotes.
_GAP, _NAME, _EQUALS, _BARE = (re.compile(x) for x in (r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
_WORD = re.compile(r"\w+")

#: Weights of the classifier: positive speaks for content.
WEIGHTS = {
    "offset": -0.6, "in_article": 4.0, "in_main": 3.6, "main_words": 3.4, "frame_tag": -14.0, "page_header": -10.0,
    "heading": 0.6, "paragraph": 0.8, "list_item": -0.3, "linked": -4.0, "linked_inside": 1.6, "per_word": 0.04, "sentence": 0.5,
}
#: What speaks for plain text on a page on which nothing stands out.
PLAIN = 2.5
#: Words that count at most, so that one long block does not outvote its ancestors.
WORDS_COUNTED = 40
#: Smoothness: of blocks that follow each other, divided by their distance in the tree; of blocks with one parent.
ADJACENT, SIBLING = 1.5, 0.5
#: A frame word on a class weighs in full down to this depth below its element, then less by ``FADE`` a level, never below ``FAINT``.
NEAR, FADE, FAINT = 2, 1 / 6, 1 / 3
_SENTENCE_ENDS = ".!?…\"”»。！？"
_UNITS = 1000


class _Element:
    __slots__ = (
        "tag", "parent", "depth", "hidden", "mark", "shut", "said", "own", "heads", "holds", "fixed", "form", "word", "frame", "article", "main", "main_words",
        "header", "linked",
    )

    def __init__(self, tag: str, given: dict[str, str], parent: "_Element | None"):
        self.tag, self.parent = tag, parent
        named = " ".join(v for k, v in given.items() if k in ("class", "id", "role"))
        self.mark = "tag" if tag in FRAME_TAGS else None
        if not self.mark and named and tag not in ("body", "html", "article", "main") and _FRAME_WORDS.search(named):
            own = _LAYOUT_WORDS.sub(" ", named)
            self.mark = "comments" if _COMMENT_WORDS.search(own) else "words" if _FRAME_WORDS.search(own) else None
        if not self.mark and tag in FORM_TAGS:
            self.mark = "form"
        up = parent
        self.depth = up.depth + 1 if up else 0
        hidden = tag in HIDDEN_TAGS or "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true"
        self.hidden = hidden or bool(up and up.hidden)
        # Set by _weigh_frames: what is said in sentences below, which marks hold here, and how much they weigh.
        self.shut = tag != "main" and (self.mark in ("tag", "comments") or bool(up and up.shut))
        self.said = self.own = self.heads = 0
        self.holds = self.fixed = self.form = False
        self.word, self.frame = None, 0.0
        self.article = tag == "article" or bool(up and up.article)
        self.main = tag == "main" or bool(up and up.main)
        self.main_words = bool(named and _MAIN_WORDS.search(named)) or bool(up and up.main_words)
        self.header = tag == "header" and not self.article or bool(up and up.header)
        self.linked = tag == "a" or bool(up and up.linked)


class _Block:
    __slots__ = ("element", "parts", "linked", "size")

    def __init__(self, element):
        self.element, self.parts, self.linked, self.size = element, [], 0, 0


class _Tags:
    """The tags of a page, read in one pass: a place that has been seen to lead to no ``>`` is not tried again."""

    def __init__(self, page: str):
        self.page, self.dead = page, set()
        self.quotes = {q: page.rfind(q) for q in "\"'"}
        self.last = page.rfind(">")

    def attributes(self, at: int) -> tuple[dict[str, str], int] | None:
        """The attributes of a tag from behind its name on, and where the tag ends; None if it does not."""
        page, seen, given = self.page, [], {}
        while True:
            at = _GAP.match(page, at).end()
            if at > self.last or at in self.dead:
                self.dead.update(seen)
                return None
            if page[at] == ">":
                return given, at + 1
            seen.append(at)
            name = _NAME.match(page, at)
            at, value = name.end(), ""
            equals = _EQUALS.match(page, at)
            if equals:
                at = equals.end()
                quote = page[at: at + 1]
                if self.quotes.get(quote, -1) > at:
                    end = page.find(quote, at + 1)
                    value, at = page[at + 1: end], end + 1
                else:
                    bare = _BARE.match(page, at)
                    value, at = bare[0], bare.end()
            # Of attributes with one name the first counts.
            given.setdefault(name[0].lower(), value)

    def token(self, at: int):
        """(end, text, closing, tag, attributes) of what stands at a place; text is None for tags, tag for anything else."""
        page = self.page
        if page[at] != "<":
            end = page.find("<", at)
            end = len(page) if end < 0 else end
            return end, page[at:end], False, None, None
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return len(page) if end < 0 else end + 3, None, False, None, None
        found = _TAG.match(page, at)
        if found:
            inside = self.attributes(found.end())
            if inside:
                return inside[1], None, bool(found[1]), found[2].lower(), inside[0]
        elif page[at + 1: at + 2] in ("!", "?") and at < self.last:
            return page.find(">", at) + 1, None, False, None, None
        return at + 1, "<", False, None, None


def blocks(page: str) -> list[tuple[str, _Element, float]]:
    """(text, innermost block element, share of linked characters) in page order; empty blocks are left out."""
    root, tags = _Element("", {}, None), _Tags(page)
    top, at, out, current, elements = root, 0, [], None, []

    def close():
        nonlocal current
        if current is not None:
            text = " ".join("".join(current.parts).split())
            if text:
                out.append((text, current.element, current.linked / max(1, current.size)))
            current = None

    while at < len(page):
        at, part, closing, tag, given = tags.token(at)
        if tag is None:
            if part is not None and not top.hidden:
                if current is None:
                    if part.isspace():
                        continue
                    home = top
                    while home.parent and home.tag not in BLOCK_TAGS:
                        home = home.parent
                    current = _Block(home)
                text = entities.unescape(part)
                current.parts.append(text)
                visible = len(text) - text.count(" ")
                current.size += visible
                current.linked += visible if top.linked else 0
            continue
        if closing:
            if tag in BLOCK_TAGS:
                close()
            node = top
            while node.parent and node.tag != tag:
                # An inline end tag does not reach beyond its block.
                if node.tag in BLOCK_TAGS and tag not in BLOCK_TAGS:
                    node = root
                    break
                node = node.parent
            if node.parent:
                top = node.parent
            continue
        if tag in VOID_TAGS:
            if tag == "hr":
                close()
            elif tag == "br" and current is not None:
                current.parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            close()
            node = top
            while node.parent and node.tag not in BLOCK_TAGS:
                node = node.parent
            if node.tag in ("p", *HEADINGS):
                # A block element ends an open paragraph, with the inline elements inside it.
                top = node.parent
            if tag in CLOSES:
                node = top
                while node.parent and node.tag not in ("ul", "ol", "dl", "table", "select", "div"):
                    if node.tag in CLOSES[tag]:
                        top = node.parent
                    node = node.parent
        if page[at - 2] == "/" and tag in ("svg", "path", "use", "circle", "rect", "g"):
            continue
        if tag in RAW_TAGS:
            end = re.compile(f"</{tag}", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
            if end:
                at = page.find(">", at) + 1 or len(page)
            continue
        top = _Element(tag, given, top)
        elements.append(top)
    close()
    _weigh_frames(elements, out)
    return out


def _weigh_frames(elements: list[_Element], found: list[tuple[str, _Element, float]]) -> None:
    """How much the frame marks above each element weigh, 0 to 1. ``elements`` come in page order.

    Frame tags and comment sections hold for all below them but a main element. A class word or a form is no mark on what
    contains the page's article: the article or main element that says most or, without one, all that is said outside
    other marks. It ends at an inner article that says as much as all unmarked articles.
    """
    if not any(e.mark for e in elements):
        return
    for text, element, _ in found:
        if not element.shut:
            if text[-1] in _SENTENCE_ENDS:
                element.own += len(text)
                element.said += len(text)
            element.heads += element.tag in ("h1", "h2")
    for e in reversed(elements):
        e.parent.said += e.said
        e.parent.heads += e.heads
    best = max((e for e in elements if e.tag in ("article", "main") and not e.shut and e.said), key=lambda e: e.said, default=None)
    if best is not None:
        while best.parent:
            best.holds, best = True, best.parent
    else:
        _hold_what_is_said(elements)
    marked = {}
    for e in elements:
        marked[id(e)] = e.tag != "main" and (_is_mark(e) or marked.get(id(e.parent), False))
    free = 0
    for text, element, _ in found:
        if text[-1] in _SENTENCE_ENDS and (element.article or element.main) and not element.shut and not marked.get(id(element), False):
            free += len(text)
    for e in elements:
        up = e.parent
        if e.tag != "main":
            e.fixed, e.form, e.word = up.fixed, up.form, up.word
            if e.tag == "article" and e.said and e.said >= free:
                e.form, e.word = False, None
        if _is_mark(e):
            e.fixed, e.form = e.fixed or e.mark in ("tag", "comments"), e.form or e.mark == "form"
            e.word = e.depth if e.mark == "words" else e.word
        if e.fixed or e.form:
            e.frame = 1.0
        elif e.word is not None:
            e.frame = max(FAINT, 1 - FADE * max(0, e.depth - e.word - NEAR))


def _hold_what_is_said(elements: list[_Element]) -> None:
    """On a page without article and main: an element with a mark holds the text if nothing is said outside all marks, or
    if it has the page's headings and most of what is said.
    """
    root = elements[0]
    while root.parent:
        root = root.parent
    inside, plain = {id(root): False}, root.own
    for e in elements:
        inside[id(e)] = inside[id(e.parent)] or e.mark is not None
        if not inside[id(e)]:
            plain += e.own
    for e in elements:
        if e.mark in ("words", "form") and not inside[id(e.parent)] and 2 * e.said > root.said:
            e.holds = not plain or bool(e.heads) and e.heads == root.heads
            # Marks further inside hold the same text as long as nothing else is said beside them.
            if e.holds:
                for x in elements:
                    up = x.parent
                    x.holds = x.holds or x.mark in ("words", "form") and up.holds and x.said == up.said
                    if x.mark is None and up.holds and x.said == up.said:
                        x.holds = True


def _is_mark(e: _Element) -> bool:
    return e.mark in ("tag", "comments") or e.mark is not None and not e.holds


def cost(text: str, element: _Element, linked: float) -> float:
    """What calling the block boilerplate costs more than calling it content."""
    words = len(_WORD.findall(text))
    inside = element.article or element.main or element.main_words
    has = {
        "offset": 1, "in_article": element.article, "in_main": element.main, "main_words": element.main_words, "frame_tag": element.frame,
        "page_header": element.header, "heading": element.tag in HEADINGS, "paragraph": element.tag in ("p", "blockquote", "pre"),
        "list_item": element.tag == "li", "linked": linked, "linked_inside": linked * inside, "per_word": min(words, WORDS_COUNTED), "sentence": text[-1] in ".!?…\"”»",
    }
    return sum(WEIGHTS[k] * v for k, v in has.items())


def _distance(a: _Element, b: _Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def minimum_cut(terminal: list[int], ties: list[tuple[int, int, int]]) -> list[bool]:
    """For each node: does it stay on the source side of a minimum cut?

    ``terminal[i]`` is the capacity from the source if positive, to the sink if negative; ``ties`` are (i, j, capacity) in
    both directions. Maximum flow by shortest augmenting phases with iterative searches.
    """
    count, source, sink = len(terminal), len(terminal), len(terminal) + 1
    to, room, edges = [], [], [[] for _ in range(count + 2)]

    def edge(a, b, forth, back):
        edges[a].append(len(to))
        to.append(b)
        room.append(forth)
        edges[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, c in enumerate(terminal):
        if c > 0:
            edge(source, i, c, 0)
        elif c < 0:
            edge(i, sink, -c, 0)
    for i, j, c in ties:
        edge(i, j, c, c)
    while True:
        level = [-1] * (count + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in edges[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(count)]
        turn, path, node = [0] * (count + 2), [], source
        while True:
            if node == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                # Back to before the first edge that is full.
                full = next(k for k, e in enumerate(path) if not room[e])
                node = to[path[full] ^ 1]
                del path[full:]
                continue
            while turn[node] < len(edges[node]):
                e = edges[node][turn[node]]
                if room[e] and level[to[e]] == level[node] + 1:
                    break
                turn[node] += 1
            if turn[node] < len(edges[node]):
                path.append(e)
                node = to[e]
            elif path:
                turn[to[path[-1] ^ 1]] += 1
                node = to[path.pop() ^ 1]
            else:
                break


def main_text(page: str) -> str:
    """The blocks of the page that the cut leaves as content, joined by an empty line."""
    found = blocks(page)
    if not found:
        return ""
    costs = [cost(*b) for b in found]
    if not any(c > 0 for c in costs):
        # Nothing stands out: words that are no link and in no frame are the text.
        plain = [not (e.frame or e.header) and linked < 0.5 and _WORD.search(text) is not None for text, e, linked in found]
        costs = [c + PLAIN if own else c for c, own in zip(costs, plain)]
    terminal = [round(_UNITS * c) or -1 for c in costs]
    if min(terminal) > 0 or max(terminal) < 0:
        keep = [c > 0 for c in terminal]
    else:
        ties, last = [], {}
        for i, (_, element, _) in enumerate(found):
            if i:
                ties.append((i - 1, i, round(_UNITS * ADJACENT / (1 + _distance(found[i - 1][1], element)))))
            parent = id(element.parent)
            if last.get(parent, i - 1) != i - 1:
                ties.append((last[parent], i, round(_UNITS * SIBLING)))
            last[parent] = i
        keep = minimum_cut(terminal, ties)
    return "\n\n".join(b[0] for b, k in zip(found, keep) if k)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; text is empty where a page has no content.

    Null and empty pages have no content; character references are decoded; white space inside a block is one space.
    Rows are independent, repeated or not. No shuffle; a task holds about a megabyte of pages, or its longest page.
    """

    def extract(batches):
        for batch in by_bytes(batches, html_col):
            texts = [main_text(p or "") for p in batch.column(2).to_pylist()]
            # Lone surrogates from character references cannot be stored.
            texts = [t.encode("utf-8", "replace").decode() if not t.isascii() else t for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("bigint").alias(id_col), F.col(url_col).cast("string").alias(url_col), html_col)
    return rows.mapInArrow(extract, f"`{id_col}` bigint, `{url_col}` string, text string, n_chars bigint")
