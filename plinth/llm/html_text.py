"""Main text of HTML pages by composite text density.

Every node of the page's tree gets its characters and tags, and those in links.
Its composite density is characters per tag, adjusted by a logarithm that falls
as links take a larger part. The sum of its children's densities is its density
sum, and the node with the largest sum holds the main text. The least density on
the path from it up to the body is the threshold for what stands beside the
path: a branch joins if it is as dense, mostly outside links, and has a fair
part of the target's own density sum; so do headings before and all that stands
between two branches that joined.

Element, class, id and role names correct what density cannot know: notices,
adverts and reader comments are prose too. Named branches are left out as long
as prose stands elsewhere, however large they are. Where none does, and for
forms, density decides: what holds the node with the largest density sum wraps
the page and stays, the other ones go.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import python_workers

_TAG = re.compile(r"""<(?:!--(?:.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))""", re.S)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Content that is no markup; it ends at its own end tag.
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Content that is never prose, and elements whose prose is not the article's.
CUT = frozenset("button select option script style noscript template svg canvas iframe object head title textarea audio video map".split())
ASIDE = frozenset("nav header footer aside form menu dialog".split())
#: Those of ASIDE that may also wrap a whole page.
WRAPS = frozenset(("form",))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Part of the target's density sum that a branch beside the path must have.
FAIR = 0.25
#: Characters of one block's own text, outside links, that make a page's prose, and those that do below a heading.
PROSE, HEADED = 80, 25
#: Class, id and role names that mark what is not the article.
CUT_NAMES = frozenset("ad ads advert advertisement adverts adsense banner breadcrumb breadcrumbs combx comment comments consent contentinfo cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice outbrain pager pagination popup promo promoted promotion recommended related replies reply respond response responses search share sharing sidebar signup social sponsor sponsored subscribe taboola toolbar widget".split())
#: Words that add nothing to a name of CUT_NAMES, and words of comments, notices and adverts, which count in any name.
FILLERS = frozenset("area articles block box container content footer global group holder inner items list main outer page panel posts row section site slot stories thread top user wrap wrapper zone".split())
PROSE_NAMES = frozenset("ad ads advert advertisement adverts adsense combx comment comments consent cookie cookies disqus newsletter notice outbrain popup promoted promotion replies responses sponsor sponsored taboola".split())
#: Start tag -> open elements that it ends, looked for up to the nearest of SCOPE.
BLOCKS = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr"}, "tfoot": {"tbody", "tr"}}
SCOPE = frozenset("article aside blockquote body button details div fieldset figure footer form header main menu nav ol section table td th ul".split())
MAIN = frozenset(("article", "main"))


#: What is known of a node: nothing, that density decides, that it is left out where prose stands elsewhere, that it is left out.
FREE, OPEN, DOUBTED, SURE = range(4)


def _named(name: str) -> int:
    """DOUBTED for a class, id or role name of CUT_NAMES, with FILLERS or without, and one with a part of PROSE_NAMES; else FREE."""
    parts = {x for x in re.split(r"[^a-z]+", name) if x}
    whole = not parts.isdisjoint(CUT_NAMES) and parts <= CUT_NAMES | FILLERS
    return DOUBTED if whole or not parts.isdisjoint(PROSE_NAMES & CUT_NAMES) else FREE


class Tree:
    """Nodes in page order; a node's subtree is the range from it to its end. Items are (place of node, text).

    cut has the branches that are left out for sure; doubt has OPEN or DOUBTED
    for those of which Page decides.
    """

    def __init__(self, page: str) -> None:
        self.tag, self.up, self.cut, self.doubt = ["#"], [-1], [False], [FREE]
        self.items: list[tuple[int, str | None]] = []
        open_: list[int] = [0]
        #: How many elements of a name are open.
        self.open: Counter[str] = Counter()
        at, n = 0, len(page)
        body = False
        while at < n:
            m = _TAG.search(page, at)
            if m is None:
                self.items.append((open_[-1], page[at:]))
                break
            if m.start() > at:
                self.items.append((open_[-1], page[at : m.start()]))
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                self._end(open_, name)
                continue
            self._imply(open_, name)
            if name not in INLINE:
                self.items.append((open_[-1], None))
            if name in VOID:
                continue
            if name in ("html", "body") and body and self.open[name]:
                continue
            names = [x for g in _NAMES.findall(m[3] or m[6] or "") for x in "".join(g).lower().split()]
            self.tag.append(name)
            self.up.append(open_[-1])
            top = name in ("html", "body") or name in MAIN
            said = FREE if top else max((OPEN if name in WRAPS else SURE if name in ASIDE else FREE, *map(_named, names)))
            self.cut.append(self.cut[open_[-1]] or name in CUT or said == SURE)
            self.doubt.append(FREE if said == SURE else said)
            body = body or name == "body"
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = end.start() if end else n
            open_.append(len(self.tag) - 1)
            self.open[name] += 1

    def _imply(self, open_: list[int], name: str) -> None:
        """End what the start tag `name` ends by itself."""
        ends = ENDS.get(name) or ({"p"} if name in BLOCKS else ())
        if not any(self.open[t] for t in ends):
            return
        last = None
        for k in range(len(open_) - 1, 0, -1):
            if (t := self.tag[open_[k]]) in ends:
                last = k
            elif t in SCOPE and not (name in ENDS and t not in ("ul", "ol", "table", "body", "dl")):
                break
        if last is not None:
            self.items.append((open_[-1], None))
            self._close(open_, last)

    def _end(self, open_: list[int], name: str) -> None:
        if name not in INLINE:
            self.items.append((open_[-1], None))
        if not self.open[name]:
            return
        for k in range(len(open_) - 1, 0, -1):
            t = self.tag[open_[k]]
            if t == name:
                self._close(open_, k)
                return
            if name in INLINE and t in SCOPE:
                return

    def _close(self, open_: list[int], first: int) -> None:
        for i in open_[first:]:
            self.open[self.tag[i]] -= 1
        del open_[first:]


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    """Composite text density of a node; body_share is the part of links among the body's characters."""
    if not chars:
        return 0.0
    t, lc, lt, rest = tags or 1, link_chars or 1, link_tags or 1, (chars - link_chars) or 1
    base = math.log(chars / rest * link_chars + body_share * chars + math.e)
    return chars / t * math.log(max(chars / lc * t / lt, 1.0)) / math.log(base) if base > 1 + 1e-9 else chars / t * math.log(max(chars / lc * t / lt, 1.0))


class Page:
    """The measures of a page's nodes: characters, tags, densities and density sums."""

    def __init__(self, page: str) -> None:
        tree = self.tree = Tree(page)
        up, tag, n = tree.up, tree.tag, len(tree.tag)
        link = self.link = [False] * n
        for i in range(1, n):
            link[i] = link[up[i]] or tag[i] == "a"
        self.items = [(i, None if t is None else html.unescape(t)) for i, t in tree.items if not tree.cut[i]]
        #: Characters of a node's own text.
        self.written = [0] * n
        for i, text in self.items:
            if text:
                self.written[i] += sum(map(len, text.split()))
        self._settle()
        self.items = [x for x in self.items if not self.cut[x[0]]]

    def _settle(self) -> None:
        """Measure the page with its doubted branches left out or not."""
        tree, n = self.tree, len(self.tree.tag)
        doubt = tree.doubt
        if not any(doubt):
            self._measure(tree.cut)
            return
        within = [FREE] * n
        for i in range(1, n):
            within[i] = max(within[tree.up[i]], doubt[i])
        if any(tree.tag[i] in MAIN and not within[i] and self._prose(i, within) for i in range(1, n)):
            self._measure([c or w > FREE for c, w in zip(tree.cut, within)])
            return
        self._measure([c or w == DOUBTED for c, w in zip(tree.cut, within)])
        if DOUBTED in doubt and not self._prose(self.body, within):
            self._measure(tree.cut)
        kept, i = set(), self.target()
        while i > 0:
            kept.add(i)
            i = tree.up[i]
        cut = tree.cut[:]
        for i in range(1, n):
            cut[i] = cut[i] or cut[tree.up[i]] or doubt[i] > FREE and i not in kept
        self._measure(cut)

    def _prose(self, top: int, within: list[int]) -> bool:
        """Whether prose stands below a node and in no DOUBTED branch: a long block, or any block after a heading."""
        up, tag, headed = self.tree.up, self.tree.tag, False
        below = {top}
        for i in range(top, len(tag)):
            if i != top and up[i] not in below:
                if i > top and top:
                    break
                continue
            below.add(i)
            if within[i] == DOUBTED or self.tree.cut[i] or self.link[i]:
                continue
            if tag[i] in HEADINGS:
                headed = headed or self.written[i] > 0
            elif self.written[i] >= (HEADED if headed else PROSE):
                return True
        return False

    def _measure(self, cut: list[bool]) -> None:
        """Characters, tags, densities and sums of the nodes that are not cut."""
        tree, link = self.tree, self.link
        up, tag, n = tree.up, tree.tag, len(tree.tag)
        self.cut = cut
        own = self.own = [0 if c else w for c, w in zip(cut, self.written)]
        chars, tags, in_link, link_tags = own[:], [0] * n, [own[i] if link[i] else 0 for i in range(n)], [0] * n
        for i in range(n - 1, 0, -1):
            if not cut[i]:
                p = up[i]
                chars[p] += chars[i]
                in_link[p] += in_link[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (tag[i] == "a")
        self.chars, self.in_link, self.tags, self.link_tags = chars, in_link, tags, link_tags
        self.body = next((i for i in range(n) if tag[i] == "body" and chars[i]), 0)
        share = in_link[self.body] / chars[self.body] if chars[self.body] else 0.0
        self.dense = [0.0 if cut[i] else density(chars[i], tags[i], in_link[i], link_tags[i], share) for i in range(n)]
        #: The density of a node's own text, as if it were a child.
        self.alone = [density(own[i], 0, own[i] if link[i] else 0, 0, share) if own[i] else 0.0 for i in range(n)]
        self.total = self.alone[:]
        for i in range(1, n):
            self.total[up[i]] += self.dense[i]
        self.under = [False] * n
        self.under[self.body] = True
        for i in range(self.body + 1, n):
            self.under[i] = self.under[up[i]] and not cut[i]

    def target(self) -> int:
        """The node of the body with the largest density sum, the first of equals."""
        return max((i for i, under in enumerate(self.under) if under), key=lambda i: (self.total[i], -i))

    def chosen(self) -> list[bool]:
        """Which nodes' own text belongs to the main text."""
        up, n = self.tree.up, len(self.tree.tag)
        under, target = self.under, self.target()
        path = [target]
        while path[-1] != self.body:
            path.append(up[path[-1]])
        least = min(self.dense[i] for i in path)
        taken, roots = [False] * n, {target}
        above = set(path[1:])
        beside: dict[int, list[int]] = {i: [] for i in above}
        for i in range(self.body + 1, n):
            if up[i] in above and under[i]:
                beside[up[i]].append(i)
        for i, child in zip(path[1:], path):
            roots.update(self._joining(beside[i], child, target, least))
            taken[i] = self.alone[i] >= max(least, FAIR * self.total[target])
        for i in range(self.body, n):
            taken[i] = taken[i] or i in roots or (under[i] and i > self.body and taken[up[i]] and up[i] not in above)
        return taken

    def _joining(self, children: list[int], child: int, target: int, least: float) -> list[int]:
        """Children of a node on the path that join its child on the path."""
        fair = FAIR * self.total[target]
        prose = [2 * self.in_link[i] <= self.chars[i] for i in children]
        joins = [k for k, i in enumerate(children) if i == child or prose[k] and self.dense[i] >= least and self.total[i] >= fair]
        first, last = joins[0], joins[-1]
        while first and self.tree.tag[children[first - 1]] in HEADINGS:
            first -= 1
        return [i for k, i in enumerate(children[first : last + 1], first) if i != child and prose[k]]


def main_text(page: str | None) -> str:
    """The page's article as one line; empty where there is none."""
    if not page:
        return ""
    read = Page(page)
    if not read.chars[read.body]:
        return ""
    taken = read.chosen()
    blocks, part = [], []
    for i, text in read.items:
        if text is None:
            blocks.append("".join(part))
            part = []
        elif taken[i]:
            part.append(text)
    blocks.append("".join(part))
    return " ".join(w for b in blocks for w in b.split())


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text and n_chars.

    A null or empty page has an empty text. Pages of any length and depth are
    read whole; broken markup is read as far as it goes. Repeated rows come back
    as often as they came; an empty table gives an empty result; other columns
    are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    python_workers(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
