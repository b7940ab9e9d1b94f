"""Main text of web pages by the container path most pages of a host agree on."""

from __future__ import annotations

import heapq
import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechframe.llm.common import cut, small

#: Fixed values of HTML: elements without content, with raw content, and in block layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main "
    "menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul xmp".split()
)
#: An open element of the first set ends where one of its second set begins.
CLOSED_BY = {
    "p": BLOCK - {"body", "html", "head", "title"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr"}),
    "td": frozenset({"td", "th", "tr"}),
    "th": frozenset({"td", "th", "tr"}),
    "option": frozenset({"option"}),
}
#: Where the search for an open li, td, ... stops.
SCOPE = frozenset("ul ol menu dl table div article section main aside body html".split())
#: Elements that never hold main text.
DROPPED = RAW | frozenset(
    "nav footer aside button select option head svg canvas object audio video dialog menu".split()
)
#: Elements that a visitor fills in if they hold controls; servers also wrap whole pages into one.
FORMS = frozenset("form fieldset".split())
CONTROLS = frozenset("input select textarea button".split())
#: Words of class, id and role that mark what isn't the article. A name marks it if all its parts are
#: among these or the FILLERS ("cookie-notice", "site-footer"); parts with another meaning ("no-comments",
#: "with-sidebar", "related-work", "share-price") make it another name.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disclaimer disqus footer gdpr hidden masthead menu modal nav navbar "
    "navigation newsletter notice overlay pagination pager popup promo promoted recommended related "
    "replies reply share sharing sidebar signup social sponsor sponsored subscribe subscription "
    "toolbar widget".split()
)
#: Of them, what readers wrote: often longer than the article.
READERS = frozenset("comment comments disqus replies reply".split())
FILLERS = frozenset(
    "site page main top bottom left right primary secondary global list section area container "
    "wrapper wrap box block bar button buttons link links inner outer slot unit form posts articles "
    "stories items post entry icon icons thread module".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CONTAINERS = frozenset("article main section div td body".split())
#: Weight of a container's tag in its page's score.
WEIGHT = {"article": 1.5, "main": 1.25}
#: Below this share of a page's text, the path of its host isn't taken.
MINOR = 1 / 3

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_COMMENT_END = re.compile(r"--!?>")
#: One attribute: a quote opens a value only behind its sign.
_ATTRIBUTE = re.compile(
    r"""[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)|(["'])|))?"""
)
_TAG_END = re.compile(r"[\s/]*>")
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_PARTS = re.compile(r"[-_]+")
_DIGITS = re.compile(r"\d+")


class Tag(NamedTuple):
    name: str
    closing: bool
    attributes: dict[str, str]
    own: bool  # written with a slash at its end


class Scanner:
    """Text and tags of a page, each character looked at a bounded number of times: where a search has found
    nothing ahead, it isn't made again."""

    def __init__(self, page: str):
        self.page, self.none = page, set()

    def _find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none.add(what)
        return found

    def _tag(self, at: int) -> tuple[Tag | None, int]:
        """The tag whose ``<`` is at a place, and where it ends; none if it never does."""
        page = self.page
        closing = page.startswith("/", at + 1)
        name = _NAME.match(page, at + 1 + closing)
        if self._find(">", name.end()) < 0:
            return None, len(page)
        attributes: dict[str, str] = {}
        place = name.end()
        while True:
            end = _TAG_END.match(page, place)
            if end:
                own = page[place : end.end()].rstrip(">").endswith("/")
                return Tag(name[0].lower(), closing, attributes, own), end.end()
            if page.find(">", place, place + 1) < 0 and self._find(">", place) < 0:
                return None, len(page)
            m = _ATTRIBUTE.match(page, place)
            if m is None:
                return None, len(page)
            if m[5]:  # a value that is never closed ends with its tag
                stop = self._find(">", m.end())
                if stop < 0:
                    return None, len(page)
                return Tag(name[0].lower(), closing, attributes, False), stop + 1
            value = m[2] or m[3] or m[4] or ""
            # Of repeated attributes the first counts.
            attributes.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
            place = m.end()

    def raw_end(self, name: str, at: int) -> tuple[int, int]:
        """Where the content of an element without markup inside ends, and where what follows begins."""
        key = f"</{name}"
        if key not in self.none:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(self.page, at)
            if end:
                return end.start(), end.end()
            self.none.add(key)
        return len(self.page), len(self.page)

    def tokens(self) -> Iterator[str | tuple[Tag, int]]:
        """Texts, and tags with where they end. The consumer may send where to go on."""
        page, at, begin = self.page, 0, 0
        while True:
            sign = self._find("<", at)
            if sign < 0:
                yield page[begin:]
                return
            following = page[sign + 1 : sign + 3]
            if following[:1] in ("!", "?"):
                yield page[begin:sign]
                if page.startswith("<!--", sign):
                    end = None if "-->" in self.none else _COMMENT_END.search(page, sign + 4)
                    if end is None:
                        self.none.add("-->")
                    at = end.end() if end else len(page)
                else:
                    stop = self._find(">", sign)
                    at = stop + 1 if stop >= 0 else len(page)
                begin = at
            elif _NAME.match(page, sign + 1 + following.startswith("/")):
                yield page[begin:sign]
                tag, at = self._tag(sign)
                begin = at
                if tag is not None:
                    moved = yield tag, at
                    if moved is not None:
                        at = begin = moved
                        yield ""
            else:
                at = sign + 1


def boilerplate_words(names: str) -> set[str]:
    """The words by which names mark what isn't the article; none if no name does."""
    words: set[str] = set()
    for name in names.lower().split():
        parts = {x for x in _PARTS.split(name) if x and not x.isdigit()}
        if parts <= BOILERPLATE | FILLERS:
            words |= parts & BOILERPLATE
    return words


class Element:
    __slots__ = (
        "tag", "step", "depth", "below", "dropped", "named", "readers", "parent", "box", "up", "closer", "off",
        "kids", "own", "semantic", "size", "links", "score", "linked", "article", "controls",
    )

    def __init__(self, tag: str, step: str, dropped: bool, words: set[str], below: Element | None):
        self.tag, self.step, self.dropped, self.below = tag, step, dropped, below
        self.depth = 0 if below is None else below.depth + 1  # its place in the stack
        self.named = bool(words)  # by its names it isn't the article
        self.readers = bool(words & READERS)
        self.controls = False
        self.parent = None if below is None else below.box  # the container around it
        self.box = self if tag in CONTAINERS else self.parent
        # The innermost open element that a later one may close.
        if tag in CLOSED_BY:
            self.closer = self
        else:
            self.closer = None if tag in SCOPE or below is None else below.closer
        self.up = None  # the container or named element around it
        self.off = False  # it or one around it is named
        self.kids: list[Element] = []
        self.semantic = False  # it is an article or main, or inside one
        self.own = self.size = self.links = 0  # characters: of its own blocks, of all inside, of them in links
        self.score = 0.0  # characters of text that count for it
        self.linked = 0.0  # of them, inside links
        self.article = 0  # characters of the largest article or main in it

    @property
    def path(self) -> str:
        steps, e = [], self if self.tag in CONTAINERS else self.parent
        while e is not None:
            steps.append(e.step)
            e = e.parent
        return "".join(f">{x}" for x in reversed(steps))


class Block:
    __slots__ = ("text", "linked", "inner")

    def __init__(self, text: str, linked: int, inner: Element | None):
        # inner: the innermost container or named element around it.
        self.text, self.linked, self.inner = text, linked, inner


def page_blocks(page: str) -> tuple[list[Block], list[Element]]:
    """The page's blocks of text outside dropped and named elements, and all its containers, in page
    order. Unclosed, misnested and cut-off markup is accepted. Takes time in proportion to the page."""
    blocks: list[Block] = []
    elements: list[Element] = []
    stack: list[Element] = []
    text: list[str] = []
    open_tags: Counter[str] = Counter()
    inline: list[Counter[str]] = [Counter()]  # tags open since each open block element
    linked = 0

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            # Its elements are told apart once it is known which of them count.
            blocks.append(Block(joined, min(linked, len(joined)), stack[-1] if stack else None))
        linked = 0

    def pop_to(depth: int) -> None:
        if any(e.tag in BLOCK for e in stack[depth:]):
            flush()
        for e in reversed(stack[depth:]):
            open_tags[e.tag] -= 1
            if e.tag in BLOCK:
                inline.pop()
            else:
                inline[-1][e.tag] -= 1
        del stack[depth:]

    def add(raw: str, plain: bool = False) -> None:
        nonlocal linked
        if not raw or (stack and stack[-1].dropped):
            return
        seen = html.unescape(raw) if "&" in raw and not plain else raw
        if open_tags["a"]:
            linked += len(seen.strip())
        text.append(seen)

    scanner = Scanner(page)
    tokens = scanner.tokens()
    for token in tokens:
        if isinstance(token, str):
            add(token)
            continue
        found, at = token
        tag, attributes = found.name, found.attributes
        if found.closing:
            if tag == "br":
                flush()
            elif tag in BLOCK:
                if open_tags[tag]:
                    depth = len(stack) - 1
                    while stack[depth].tag != tag:
                        depth -= 1
                    pop_to(depth)
            elif inline[-1][tag]:  # an inline end tag doesn't end blocks
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                pop_to(depth)
            continue
        if tag in CONTROLS and not (tag == "input" and attributes.get("type", "").strip().lower() == "hidden"):
            if stack:
                stack[-1].controls = True
        if tag in ("br", "hr"):
            flush()
        if tag in VOID:
            continue
        if tag in BLOCK:
            closer = stack[-1].closer if stack else None
            while closer is not None:
                if tag in CLOSED_BY[closer.tag]:
                    pop_to(closer.depth)
                    break
                below = closer.below
                closer = None if closer.tag in SCOPE or below is None else below.closer
            flush()
        below = stack[-1] if stack else None
        if tag == "xmp":
            end, after = scanner.raw_end(tag, at)
            add(page[at:end], plain=True)
            flush()
            tokens.send(after)
            continue
        page_wide = tag in ("html", "body")
        words: set[str] = set()
        if attributes and tag in BLOCK and not page_wide:
            names = [attributes.get("class", ""), attributes.get("role", "")]
            if tag not in HEADINGS:  # the ids of headings say what they are about
                names.append(attributes.get("id", ""))
            words = boilerplate_words(" ".join(names))
        hidden = bool(attributes) and not page_wide and (
            "hidden" in attributes
            or attributes.get("aria-hidden", "").strip().lower() == "true"
            or _NONE.search(attributes.get("style", "")) is not None
        )
        inside = open_tags["article"] or open_tags["main"]
        dropped = (
            (below is not None and below.dropped) or tag in DROPPED or hidden or (tag == "header" and not inside)
        )
        if tag in RAW:
            tokens.send(scanner.raw_end(tag, at)[1])
            continue
        if found.own and tag not in BLOCK:
            continue
        step = tag
        if "class" in attributes:
            # Numbers in classes differ from page to page.
            classes = _DIGITS.sub("#", attributes["class"].lower()).replace(">", " ")
            step = ".".join([tag, *sorted(classes.split())])
        element = Element(tag, step, dropped, words, below)
        stack.append(element)
        elements.append(element)
        open_tags[tag] += 1
        if tag in BLOCK:
            inline.append(Counter())
        else:
            inline[-1][tag] += 1
    flush()
    return arrange(blocks, elements)


def arrange(blocks: list[Block], elements: list[Element]) -> tuple[list[Block], list[Element]]:
    """What is kept of the blocks and containers, with sums over the tree of containers and named elements. Elements
    come before those inside them, so one pass down and one up do it."""
    for e in reversed(elements):  # controls count for all forms around them
        if e.controls and e.below is not None:
            e.below.controls = True
        if e.controls and e.tag in FORMS:
            e.named = True
    counts = {}
    for e in elements:
        below = e.below
        around = None if below is None else counts[below]
        e.up = around
        counts[e] = e if e.tag in CONTAINERS or e.named else around
        if around is not None and counts[e] is e:
            around.kids.append(e)
    marked = [e for e in elements if counts[e] is e]
    for e in marked:
        e.semantic = e.tag in ("article", "main") or (e.up is not None and e.up.semantic)
    for b in blocks:
        b.inner = None if b.inner is None else counts[b.inner]
        if b.inner is not None:
            b.inner.own += len(b.text)
    for e in reversed(marked):
        e.size += e.own
        if e.tag in ("article", "main"):
            e.article = e.size
        if e.up is not None:
            e.up.size += e.size
            e.up.article = max(e.up.article, e.article)
    unname_wrappers(blocks, marked)
    for e in marked:
        e.off = e.named or (e.up is not None and e.up.off)
        e.size = e.links = 0
    kept = [b for b in blocks if b.inner is None or not b.inner.off]
    containers = [e for e in marked if e.tag in CONTAINERS and not e.dropped]
    sum_up(kept, marked)
    for b in kept:
        box = b.inner if b.inner is None or b.inner.tag in CONTAINERS else b.inner.parent
        if box is not None:
            box.score += len(b.text)
            box.linked += b.linked
    for e in reversed(marked):
        if e.tag in CONTAINERS and e.parent is not None:
            # A text counts half for each container further out.
            e.parent.score += 0.5 * e.score
            e.parent.linked += 0.5 * e.linked
    return kept, containers


def sum_up(blocks: Iterable[Block], marked: list[Element]) -> None:
    """``size`` and ``links`` of all elements over these blocks."""
    for e in marked:
        e.size = e.links = 0
    for b in blocks:
        if b.inner is not None:
            b.inner.size += len(b.text)
            b.inner.links += b.linked
    for e in reversed(marked):
        if e.up is not None:
            e.up.size += e.size
            e.up.links += e.links


def unname_wrappers(blocks: list[Block], marked: list[Element]) -> None:
    """Names of layouts ("sidebar") also stand on elements around the article or nearly all text, which
    are no boilerplate then. Readers' words are, unless there is nothing else.

    The outermost named elements are looked at from the one with most text down; what is outside them only grows,
    so an element that is no wrapper stays none, and each is looked at once."""
    outside = inside = 0  # characters outside named elements; of them, in article or main
    frontier: list[tuple[int, int, Element]] = []
    order = 0

    def open_up(elements: list[Element]) -> None:
        """Count what is outside now, down to the next named elements."""
        nonlocal outside, inside, order
        while elements:
            e = elements.pop()
            outside += e.own
            inside += e.own * e.semantic
            for kid in e.kids:
                if not kid.named:
                    elements.append(kid)
                elif kid.size:
                    order += 1
                    heapq.heappush(frontier, (-kid.size, order, kid))

    outside += sum(len(b.text) for b in blocks if b.inner is None)
    for e in marked:
        if e.up is None:
            if not e.named:
                open_up([e])
            elif e.size:
                order += 1
                heapq.heappush(frontier, (-e.size, order, e))
    seen = 0  # named elements that stay so
    while frontier:
        _, _, e = heapq.heappop(frontier)
        if e.readers:
            wraps = not outside and not frontier and not seen
        elif e.article:
            wraps = e.article > outside
        else:
            wraps = e.size > (9 if inside else 3) * outside
        if not wraps:
            seen += 1
            continue
        e.named = False
        open_up([e])


def container_score(element: Element) -> float:
    if not element.score:
        return 0.0
    return element.score * (1 - element.linked / element.score) * WEIGHT.get(element.tag, 1.0)


def best_path(page: str | None) -> tuple[str | None, float]:
    """The generalised path of the page's best container, and its score. NULL if it has no text."""
    if not page:
        return None, 0.0
    _, containers = page_blocks(page)
    # Of equal scores the outermost comes first.
    best = max(containers, key=container_score, default=None)
    score = container_score(best) if best else 0.0
    return (best.path, score) if score > 0 else (None, 0.0)


def widened(element: Element, size: int, links: int) -> Element:
    """The container of the whole article around one of ``size`` characters: an article, a main if
    most of what it adds isn't links, or else the outermost one that adds no more text than there is and
    not mostly links."""
    around = [element]
    while around[-1].parent is not None:
        around.append(around[-1].parent)
    article = next((e for e in reversed(around) if e.tag == "article"), None)
    if article is not None:
        return article
    main = next((e for e in reversed(around) if e.tag == "main"), None)
    if main is not None and 2 * (main.links - links) <= main.size - size:
        return main
    best = element
    for e in around[1 : around.index(main) if main else None]:
        if e.size <= size:
            continue
        if e.size - size > size or 2 * (e.links - links) > e.size - size:
            break
        if e.size > best.size:
            best = e
    return best


def at_path(containers: list[Element], path: str) -> list[Element]:
    """The containers with this path."""
    steps = path.split(">")[1:]
    matched: dict[Element, int] = {}
    for e in containers:
        before = 0 if e.parent is None else matched.get(e.parent, -1)
        if 0 <= before < len(steps) and steps[before] == e.step:
            matched[e] = before + 1
    return [e for e, n in matched.items() if n == len(steps)]


def extract(page: str | None, path: str | None) -> str:
    """Text of the containers at ``path``, widened to the whole article; of the page's own best container
    if there is none at ``path``, or if a minor share of the page's text is."""
    if not page:
        return ""
    blocks, containers = page_blocks(page)
    marked = marked_of(blocks, containers)

    def within(chosen: set[Element]) -> list[Block]:
        """The blocks inside these elements."""
        inside: dict[Element, bool] = {}
        for e in marked:
            inside[e] = e in chosen or (e.up is not None and inside[e.up])
        return [b for b in blocks if b.inner is not None and inside[b.inner]]

    def roots(found: list[Element]) -> set[Element]:
        """Whole articles. Neighbours at one path are seen together."""
        several = len(found) > 1
        covered = within(set(found))
        sum_up(covered, marked)
        together = {}
        for e in found:
            if e.size:
                above = e.parent if several and e.parent is not None else e
                together[e] = (above, above.size, above.links)
        sum_up(blocks, marked)
        out, known = set(), {}
        for e, (above, size, links) in together.items():
            # Neighbours at one path have the same containers around them.
            if above is e or above not in known:
                known[above] = widened(e, size, links)
            grown = known[above]
            out.add(e if above is not e and grown.tag == e.tag and grown.parent is above else grown)
        return out

    best = max(containers, key=container_score, default=None)
    own = roots([best]) if best is not None and container_score(best) > 0 else set()
    voted = roots(at_path(containers, path)) if path else set()
    if voted:
        found = within(voted)
        # Long talk below a short article doesn't outvote the article.
        loose = not any(e.tag in ("article", "main") for e in voted) or any(e.tag == "article" for e in own)
        share = sum(len(b.text) for b in found) / sum(len(b.text) for b in blocks)
        if not own or share >= MINOR or not loose:
            return "\n".join(b.text for b in found)
    return "\n".join(b.text for b in (within(own) if own else blocks))


def marked_of(blocks: list[Block], containers: list[Element]) -> list[Element]:
    """All containers and named elements, each before those inside it."""
    seen: dict[Element, None] = {}
    for start in [*containers, *(b.inner for b in blocks if b.inner is not None)]:
        chain, e = [], start
        while e is not None and e not in seen:
            chain.append(e)
            e = e.up
        seen.update(dict.fromkeys(reversed(chain)))
    return list(seen)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, votes, score): the path that most pages of a host have as their best; of equally
    many the one with the higher total score, then the first in order. Votes are counted before
    they are shuffled, so a host with most of the pages is no hot key. Pages without a host don't
    vote."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [best_path(page) for page in batch["html"]]
            yield pd.DataFrame(
                {"host": batch["host"], "path": [x[0] for x in found], "score": [x[1] for x in found]}
            )

    named = pages.select(host_of(F.col("url")).alias("host"), "html").filter(F.col("host") != "")
    votes = named.mapInPandas(vote, "host string, path string, score double")
    counted = votes.filter(F.col("path").isNotNull()).groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("votes"), F.sum("score").cast("decimal(38,3)").alias("score")
    )
    best = F.struct("votes", "score", "path")
    return counted.groupBy("host").agg(F.max(best).alias("b")).select("host", "b.path", "b.votes", "b.score")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, path) for every row (page_id, url, html).

    First pass: every page votes for its best container's path; second pass: every page is read
    again at its host's winning path, or at its own best if it has none there (or no host). Blocks
    in page order, white space collapsed, joined by line ends. NULL and empty pages, and pages
    without text, give an empty text. Other columns are left out; repeated rows stay repeated.
    """
    winners = cut(host_paths(pages).select("host", "path"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract(p, w) for p, w in zip(batch["html"], batch["path"])]
            yield pd.DataFrame(
                {
                    "page_id": batch["page_id"].astype("Int64"),
                    "url": batch["url"],
                    "text": texts,
                    "n_chars": [len(t) for t in texts],
                    "path": batch["path"],
                }
            )

    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    joined = rows.join(small(winners), "host", "left").select("page_id", "url", "html", "path")
    return joined.mapInPandas(read, "page_id long, url string, text string, n_chars long, path string")
