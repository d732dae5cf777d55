"""Main text of web pages by minimum cuts.

A page is read into blocks, the texts between tags that break a line, each with the
elements around it. A logistic model scores each block by features of its shape and place and by what its elements say (an article, a menu, a class
named like an advert). It is fitted around a prior, on blocks that elements label clearly, each of them taken twice:
with what its elements say and without, so that shape alone can tell where elements say nothing. Its log odds are the terminal capacities:
odds for the text from the source, odds against it to the sink. Neighbouring blocks, and the
nearest blocks of a common parent, are joined by edges that cost something to cut. The minimum
cut, found by augmenting paths, leaves on the source's side the blocks to keep.

A block whose odds outweigh all of its edges is on the side of its odds in any
minimum cut; such blocks are settled first, and few graphs are left to search.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import arrow_rows

#: Pages the model is fitted on at most: those whose hashes come first.
SAMPLE_PAGES, SAMPLE_BLOCKS = 2_000, 2_000
BESIDE, BESIDE_KIN, KIN = 0.5, 1.0, 0.6

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<""", re.S)
_NAMED = re.compile(r"""([^\s"'<>/=]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_WORDS = re.compile(r"[a-z]+")
#: Only these reach to the end of the page if their end tag is missing.
_RAW = frozenset("script style iframe noembed noframes xmp textarea title".split())
#: What these hold isn't text of the page, but that of math and object may be.
_EMBEDDED = frozenset("noscript template svg math object canvas audio video select".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BREAKS = frozenset(
    "address article aside blockquote body br button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {"p": frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())}
_AGAINST = frozenset("nav footer aside button dialog menu fieldset legend option label".split())
#: A page may stand in a form as a whole; what a form holds of its own is no text.
_PARTLY = frozenset(["form"])
_FOR = frozenset("article main".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_BAD_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo promoted promotion related reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Of these some name a subject as well: prose of an article that they stand around is left to the model.
_DOUBTFUL = frozenset("banner header menu navigation notice pagination promoted related reply respond share sharing social subscription toolbar".split())
_GOOD_WORDS = frozenset("article content entry main post story".split())
#: Of an article these are its title and byline, elsewhere the site's.
_HEAD_WORDS = frozenset("header masthead".split())
#: Names that say what stands beside or inside an element, not what it is.
_ELSEWHERE = re.compile(r"(?<![\w-])(?:has|with|without|no)[-_][\w-]*")
HARD, WORD, SOFT = 9.0, 6.0, 3.0
#: Features of shape and place, how far their odds go, and the weights that fitting starts from and is drawn to.
SHAPES, BOUND = 8, 5.0
PRIOR = np.array([0.0] * SHAPES + [HARD, -HARD])


@dataclass(slots=True)
class Block:
    text: str
    evidence: float
    parent: int
    links: int
    heading: bool

    @property
    def prose(self) -> bool:
        """Whether it reads like a sentence or more, and isn't made of links."""
        return self.text.count(" ") >= 7 and self.text[-1] in ".!?…:" and 4 * self.links < len(self.text)


def _evidence(tag: str, attributes: str, within: float) -> tuple[float, int, bool]:
    """What an element says of its text: within its parents' evidence, the strongest objection counts.

    A bad word in its class or id counts apart, since it may name only a part: second is whether there is one, 1 if all are doubtful, else 2. So does a form.
    Third is whether the element is an article that lifts the words around it; one named like a comment isn't.
    """
    named, plain = 2 * (tag in _PARTLY), True
    say = -HARD if tag in _AGAINST else HARD / 2 if tag in _FOR else 0.0
    if tag == "object" and within <= 0:
        say = -SOFT
    if tag == "header" and within <= 0:  # an article's own has its title
        say = -HARD
    if attributes:
        for name, value in _NAMED.findall(attributes):
            name = name.lower()
            if name in ("class", "id", "role", "itemprop", "style", "aria-hidden"):
                value = value.strip("\"'").lower()
                if name == "role":
                    say = min(say, -HARD) if value in _ROLES else max(say, HARD / 2) if value in ("main", "article") else say
                elif name in ("class", "id"):
                    words = set(_WORDS.findall(_ELSEWHERE.sub(" ", value)))
                    if bad := words & _BAD_WORDS - (_HEAD_WORDS if within > 0 else frozenset()):
                        plain = plain and bool(words & _GOOD_WORDS)
                    if bad and tag not in ("html", "body", "article", "main"):
                        named = max(named, 1 if bad <= _DOUBTFUL else 2)
                    elif words & _GOOD_WORDS and say == 0:
                        say = SOFT
                elif name == "itemprop":
                    say = HARD / 2 if value == "articlebody" else say
                elif name == "style" and "display:none" in value.replace(" ", "") or name == "aria-hidden" and value == "true":
                    say = -HARD
            elif name == "hidden":
                say = -HARD
    total = min(say, within) if say < 0 else max(say, within) if within >= 0 else within
    return total, named, say >= HARD / 2 and total > 0 and plain and not named


def _weigh(blocks: list[Block], named: list[int], outer: list[int], sure: list[bool]) -> None:
    """Takes the cost of the named elements around each block off its evidence; of several the highest counts.

    ``named`` has the innermost one of each block (0: none), ``outer`` of each named element the next one around it, ``sure`` whether its words leave no doubt.
    The cost is ``WORD``, except where no unnamed text, headings aside, is known to be the article's: then an element
    with over half of the page's text costs less the more it has, and nothing if it has all. Prose of an article within doubtful names costs
    no more than its evidence, so that the model decides. Sizes go up the elements once, and costs down.
    """
    sizes = [0] * len(outer)
    total = 0
    for b, e in zip(blocks, named, strict=True):
        if b.evidence > -HARD:
            sizes[e] += len(b.text)
            total += len(b.text)
    for e in range(len(outer) - 1, 0, -1):  # what is around an element has a smaller number
        if outer[e]:
            sizes[outer[e]] += sizes[e]
    known = any(b.evidence > 0 and not b.heading and not e for b, e in zip(blocks, named, strict=True))
    share, doubt = [0.0] * len(outer), [True] * len(outer)
    for e in range(1, len(outer)):
        own = 1.0 if known or not total else min(1.0, 2 - 2 * sizes[e] / total)
        share[e], doubt[e] = max(share[outer[e]], own), doubt[outer[e]] and not sure[e]
    for b, e in zip(blocks, named, strict=True):
        if e and b.evidence > -WORD:
            cost = share[e] * (b.evidence + WORD)
            b.evidence -= min(cost, b.evidence) if doubt[e] and b.evidence > 0 and b.prose else cost


def _ends(page: str) -> dict[int, int]:
    """Of embedded elements with an end tag of their own, by where they start, where they end."""
    out: dict[int, int] = {}
    begun: dict[str, list[int]] = {}
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if m[1] or m[4]:
            if begun.get(tag):
                out[begun[tag].pop()] = at
        elif (m[3] or m[6] or "").endswith("/"):
            continue
        elif tag in _RAW and not (tag == "title" and begun.get("svg")):
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else size
        elif tag == "select":
            begun[tag] = [m.start()]
        elif tag in _EMBEDDED:
            begun.setdefault(tag, []).append(m.start())
        elif tag in _CLOSES["p"] and tag not in ("div", "hr"):
            # No select holds these.
            begun.pop("select", None)
    return out


def blocks_of(html: str | None) -> list[Block]:
    """The blocks of a page in its order, white space inside each being one space."""
    out: list[Block] = []
    # Open elements: tag, evidence, parent for neighbourhood, innermost named element, whether an article is around.
    stack: list[tuple[str, float, int, int, bool]] = [("", 0.0, 0, 0, False)]
    opened: dict[str, list[int]] = {}  # where each tag stands on the stack
    named, outer, sure = [], [0], [False]
    text: list[str] = []
    links = serial = 0
    in_link = 0
    page = html or ""
    at, size = 0, len(page)
    ends: dict[int, int] | None = None

    def end() -> None:
        nonlocal links
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                _, say, parent, name, _ = stack[-1]
                named.append(name)
                out.append(Block(joined, say, parent, links, any(x[0] in ("h1", "h2", "h3") for x in stack[-3:])))
            text.clear()
        links = 0

    def push(*element) -> None:
        opened.setdefault(element[0], []).append(len(stack))
        stack.append(element)

    def cut(k: int) -> None:
        while len(stack) > k:
            opened[stack.pop()[0]].pop()

    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if page[m.start()] != "<" or m.end() == m.start() + 1:
                text.append(m[0])
                if in_link:
                    links += len(m[0])
            continue
        tag = tag.lower()
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in _RAW and not closing and not attributes.endswith("/"):
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if tag in _EMBEDDED and not closing and not attributes.endswith("/"):
            ends = _ends(page) if ends is None else ends
            if tag not in ("math", "object"):
                if m.start() in ends:
                    at = ends[m.start()]
                    continue
                # Without an end tag it lasts until an element it can't hold.
                end()
                push("<", -HARD, *stack[-1][2:])
                continue
            if m.start() not in ends:
                continue
        loose = opened.get("<")
        if tag in _BREAKS or loose or tag == "object" and stack[-1][1] <= 0:
            end()
        if loose and not closing and tag in _BREAKS and tag != "option":
            cut(loose[0])
        if closing:
            if opened.get(tag):
                cut(opened[tag][-1])
            if tag == "a":
                in_link = max(0, in_link - 1)
            continue
        if tag == "a":
            in_link = 1
        if tag in _VOID or attributes.endswith("/"):
            continue
        if stack[-1][0] not in ("", "html", "body"):
            if tag in _CLOSES["p"]:
                for k in range(len(stack) - 1, max(0, len(stack) - 8), -1):
                    if stack[k][0] == "p":
                        cut(k)
                        break
                    if stack[k][0] in _BREAKS:
                        break
            elif tag == "li" and stack[-1][0] == "li":
                cut(len(stack) - 1)
        _, within, parent, name, inside = stack[-1]
        if tag in _BREAKS or attributes or tag == "object":
            serial += 1
            say, bad, lifts = _evidence(tag, attributes, within)
            if bad:
                outer.append(name)
                sure.append(bad > 1)
                name = len(outer) - 1
            elif lifts and not inside:
                name = 0
            push(tag, say, serial if tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "tr") else parent, name, inside or tag == "article")
        else:
            push(tag, within, parent, name, inside)
    end()
    _weigh(out, named, outer, sure)
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """One row of numbers for each block: its shape and place, then what its elements say for it and against it."""
    n = len(blocks)
    out = np.empty((n, SHAPES + 2))
    for i, b in enumerate(blocks):
        size, words = len(b.text), b.text.count(" ") + 1
        shape = (1.0, np.log1p(size) / 5, min(b.links / size, 1.0), words > 8, b.text[-1] in ".!?…", min(b.text.count(",") / words, 0.5), b.heading, abs(2 * i - n + 1) / n)
        out[i] = (*shape, max(b.evidence, 0.0) / HARD, max(-b.evidence, 0.0) / HARD)
    return out


def fit(pages: Iterable[str | None], rounds: int = 300) -> np.ndarray:
    """Weights of the logistic model, from the blocks whose elements are clear about them; at most ``SAMPLE_BLOCKS`` blocks of a page count."""
    rows, labels = [], []
    for page in pages:
        blocks = blocks_of(page)[:SAMPLE_BLOCKS]
        sure = [i for i, b in enumerate(blocks) if b.evidence <= -WORD or b.evidence >= HARD / 2]
        if sure:
            rows.append(features(blocks)[sure].astype(np.float32))
            labels += [blocks[i].evidence > 0 for i in sure]
    weights = PRIOR.copy()
    if labels and 0 < sum(labels) < len(labels):
        said, y = np.concatenate(rows).astype(float), np.array(labels, float)
        silent = said.copy()
        silent[:, SHAPES:] = 0.0
        share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
        for _ in range(rounds):
            step = 1e-3 * (weights - PRIOR)
            for x in (said, silent):
                step += x.T @ (share * (1 / (1 + np.exp(-x @ weights)) - y)) / 2
            weights -= 2.0 * step
    return weights


def odds(blocks: list[Block], weights: np.ndarray) -> list[float]:
    """Log odds that each block is text; those of its shape and place are bounded."""
    x = features(blocks)
    return (np.clip(x[:, :SHAPES] @ weights[:SHAPES], -BOUND, BOUND) + x[:, SHAPES:] @ weights[SHAPES:]).tolist()


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in the minimum cut that keeps most of them there."""
    n = len(source)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    pull = [s - t for s, t in zip(source, sink, strict=True)]
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        v = todo.popleft()
        if side[v] is None and abs(pull[v]) > sum(near[v].values()):
            side[v] = pull[v] > 0
            for u, c in near[v].items():
                del near[u][v]
                if side[u] is None:
                    pull[u] += c if side[v] else -c
                    todo.append(u)
            near[v] = {}
    rest = [v for v in range(n) if side[v] is None]
    if rest:
        s, t = n, n + 1
        left: dict[int, dict[int, float]] = {v: dict(near[v]) for v in rest} | {s: {}, t: {}}
        for v in rest:
            if pull[v] > 0:
                left[s][v], left[v][s] = pull[v], 0.0
            else:
                left[v][t], left[t][v] = -pull[v], 0.0

        def reached(start: int, forward: bool) -> dict[int, int]:
            came, queue = {start: start}, deque([start])
            while queue and (t not in came or not forward):
                a = queue.popleft()
                for b in left[a]:
                    if b not in came and (left[a][b] if forward else left[b][a]) > 1e-9:
                        came[b] = a
                        queue.append(b)
            return came

        while t in (came := reached(s, True)):
            path, v = [], t
            while v != s:
                path.append((came[v], v))
                v = came[v]
            flow = min(left[a][b] for a, b in path)
            for a, b in path:
                left[a][b] -= flow
                left[b][a] = left[b].get(a, 0.0) + flow
        lost = reached(t, False)
        for v in rest:
            side[v] = v not in lost
    return [bool(x) for x in side]


def label(blocks: list[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks are main text."""
    if not blocks:
        return []
    scores = odds(blocks, weights)
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, BESIDE_KIN if blocks[i - 1].parent == b.parent else BESIDE))
        if (j := last.get(b.parent, i - 1)) < i - 1:
            edges.append((j, i, KIN))
        last[b.parent] = i
    return minimum_cut([max(0.0, x) for x in scores], [max(0.0, -x) for x in scores], edges)


def main_text(html: str | None, weights: np.ndarray) -> str:
    blocks = blocks_of(html)
    return " ".join(b.text for b, keep in zip(blocks, label(blocks, weights), strict=True) if keep)


def fit_on(pages: DataFrame, key_col: str = "page_id", html_col: str = "html", most: int = SAMPLE_PAGES) -> np.ndarray:
    """Fits the model on one page of each of the ``most`` keys whose hashes are least.

    The hashes are ordered without the pages, so a task passes on ``most`` numbers at most; the pages of
    the keys found are then read, and the least of each key is taken, in each task before the shuffle.
    """
    hashed = pages.select(F.xxhash64(F.col(key_col)).alias("h"), F.col(html_col).alias("html"))
    last = hashed.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    some = hashed.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.min("html").alias("html")).orderBy("h")
    return fit(r.html for r in some.toLocalIterator()) if last is not None else fit([])


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row; a null or empty page has an empty text. Other columns are left behind."""
    weights = fit_on(pages) if weights is None else weights

    def run(ids: list, urls: list, pages: list) -> dict[str, list]:
        texts = [main_text(p, weights) for p in pages]
        return {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

    kinds = dict(pages.select("page_id", "url").dtypes)
    return arrow_rows(pages.select("page_id", "url", "html"), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint", rows=256)
