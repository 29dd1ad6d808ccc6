"""Main text of web pages by composite text density.

For each node of the page's tree the density is its characters per tag, scaled
down by the share of its text that stands in links. Inline markup is no node of
its own: its characters and its links count for the element around it. The
density sum of a node adds the densities of its children. The subtree of largest
sum is content; the smallest density on the path from it up to the body is the
threshold from which other nodes may add theirs.

Elements that are furniture by their tag (menus, scripts, footers and the like)
are left out of the tree before. Names in class, id and role only hint, in two
ways. A name that says nothing but furniture (``sidebar``, ``cookie-notice``), or
a form, is left out unless it holds the article: an article or main element, or
more than ``WRAPS`` of the page's text outside links, where names of comments and
notices wrap only if nothing would be left. A name that has such a word as a
part (``has-sidebar``, ``post-header``) is left to density: it goes if it doesn't
hold the densest subtree, and within that if it is mostly links or below the
threshold and has no headline. Comments are often denser than an article, so a
name with a word for them as a part (``user-comments``) goes unless it holds the
article, a headline or nearly all text.

The densest subtree may be a body without its headline, lead or last paragraph.
Outside of article and main elements its siblings join it that are neither
furniture nor have links: headings, those that stand between parts of the
content, and those that end as a sentence does.

Defined results: a null or empty page, or one without main text, has the empty
text; of two subtrees with equal sums the first counts; unclosed and truncated
markup is read as browsers read it; pages of any length and depth are read whole,
in time that grows with their length; repeated rows are read one by one; null
ids and urls are passed through; an empty table gives an empty result; columns
other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# Elements by their meaning in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
FURNITURE = frozenset(
    "head script style noscript template nav footer aside button select option textarea input iframe object embed svg canvas "
    "audio video dialog menu fieldset title meta link".split()
)
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section div body html main td th blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HINTS = (
    "ads? advert advertisement adverts advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup login sidebar menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "footer header masthead topbar comment comments disqus reply replies respond share sharing social related recommended widget toolbar search"
).split()

NEVER = frozenset("ad ads advert advertisement adverts advertising cookie cookies consent gdpr comment comments disqus reply replies respond newsletter".split())
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
WRAPS = 0.6  # of a page's characters outside links
NEARLY_ALL = 0.95

_HINT = re.compile("(?:" + "|".join(HINTS) + ")")
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.IGNORECASE)


_STOPS = frozenset(".!?:;\u2026\u3002\"'\u201d\u00bb)")


NONE, PART, PART_COMMENTS, WHOLE, NEVER_WRAPS, ALWAYS = range(6)


def _hint(tag: str, attributes: str, inside_article: bool) -> int:
    """What tag and attributes say: ALWAYS furniture, furniture by a WHOLE name, by PART of one (of comments or not), or NONE."""
    if tag in FURNITURE or tag == "header" and not inside_article:
        return ALWAYS
    found = WHOLE if tag == "form" else NONE
    if not attributes or tag in ("html", "body", "article", "main"):
        return found
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return ALWAYS
        if name == "role" and value in ROLES:
            found = max(found, WHOLE)
        elif name in ("class", "id"):
            for token in value.split():
                words = [w for w in re.split("[_-]+", token) if w]
                hints = [bool(_HINT.fullmatch(w)) for w in words]
                if hints and all(hints):
                    found = max(found, WHOLE if NEVER.isdisjoint(words) else NEVER_WRAPS)
                elif any(hints):
                    found = max(found, PART if COMMENTS.isdisjoint(words) else PART_COMMENTS)
    return found


class _Tree:
    """Nodes in page order with what is counted in each, and the text events."""

    def __init__(self) -> None:
        self.tags, self.parents, self.last, self.hints = ["#root"], [-1], [0], [NONE]
        self.chars, self.link_chars, self.link_tags = [0], [0], [0]
        self.events: list[tuple[int, str | None]] = []  # (node, text), or (node, None) at a block's edge


def _parse(page: str) -> _Tree:
    tree, at = _Tree(), 0
    stack: list[tuple[str, int]] = [("#root", 0)]  # node -1: furniture
    articles = links = hidden = 0
    open_tags: Counter = Counter()

    def close() -> None:
        nonlocal articles, links, hidden
        tag, node = stack.pop()
        open_tags[tag] -= 1
        articles -= tag in ("article", "main")
        links -= tag == "a"
        hidden -= node < 0
        if node >= 0 and tag in BLOCK:
            tree.events.append((node, None))

    def words(text: str) -> None:
        if hidden or not text:
            return
        node, text = stack[-1][1], entities.unescape(text)
        if n := len("".join(text.split())):
            tree.chars[node] += n
            tree.link_chars[node] += n if links else 0
        tree.events.append((node, text))

    while True:
        m = _TAG.search(page, at)
        words(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        shut, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if shut:
            if open_tags[tag]:
                while stack[-1][0] != tag:
                    close()
                close()
            continue
        if open_tags["p"] and tag in BLOCK and tag not in ("html", "body"):  # a block ends an open paragraph
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    while len(stack) > depth:
                        close()
                    break
                if stack[depth][0] in SCOPES:
                    break
        if any(open_tags[t] for t in CLOSED_BY_SAME.get(tag, ())):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in CLOSED_BY_SAME[tag]:
                    while len(stack) > depth:
                        close()
                    break
                if stack[depth][0] in SCOPES - CLOSED_BY_SAME[tag]:
                    break
        if tag in ("html", "body") and open_tags[tag]:
            continue
        hint = ALWAYS if hidden else _hint(tag, attributes, articles > 0)
        # an inline element that is furniture by its name is left out, as it is no node
        out = hint == ALWAYS or tag in INLINE and hint >= WHOLE
        node = stack[-1][1]
        if not out and tag in INLINE:
            tree.link_tags[node] += tag == "a"
            if tag == "br":
                tree.events.append((node, " "))
        elif not out:
            tree.tags.append(tag)
            tree.parents.append(node)
            tree.last.append(0)
            tree.hints.append(hint)
            for counted in (tree.chars, tree.link_chars, tree.link_tags):
                counted.append(0)
            node = len(tree.tags) - 1
            if tag in BLOCK:
                tree.events.append((node, None))
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        articles += tag in ("article", "main")
        links += tag == "a"
        hidden += bool(out)
        open_tags[tag] += 1
        stack.append((tag, -1 if out else node))
    while len(stack) > 1:
        close()
    return tree


class _Sums:
    """Counts, densities and density sums of the nodes that aren't ``gone``."""

    def __init__(self, tree: _Tree, gone: list[bool]):
        n, parents = len(tree.tags), tree.parents
        self.gone = list(gone)
        for i in range(1, n):
            self.gone[i] |= self.gone[parents[i]]
        here = lambda counted: [0 if g else c for c, g in zip(counted, self.gone)]
        self.chars, self.link_chars, self.link_tags = here(tree.chars), here(tree.link_chars), here(tree.link_tags)
        self.tags, self.heads = list(self.link_tags), [int(t == "h1" and not g) for t, g in zip(tree.tags, self.gone)]
        self.articles = [int(t in ("article", "main") and not g) for t, g in zip(tree.tags, self.gone)]
        for i in range(n - 1, 0, -1):
            p = parents[i]
            self.tags[p] += 0 if self.gone[i] else self.tags[i] + 1
            for counted in (self.chars, self.link_chars, self.link_tags, self.heads, self.articles):
                counted[p] += counted[i]
        self.body = next((i for i, t in enumerate(tree.tags) if t == "body"), 0)
        share = self.link_chars[self.body] / self.chars[self.body] if self.chars[self.body] else 0.0
        self.density, below = [0.0] * n, [0.0] * n
        leaf = [True] * n
        for i in range(n - 1, -1, -1):
            c, t = self.chars[i], max(1, self.tags[i])
            if c:
                self.density[i] = c / t
                if share:
                    base = math.log(c / max(1, c - self.link_chars[i]) * self.link_chars[i] + share * c + math.e)
                    ratio = math.log(c / max(1, self.link_chars[i]) * t / max(1, self.link_tags[i]))
                    self.density[i] *= max(0.0, ratio) / math.log(base)
            if i and not self.gone[i]:
                below[parents[i]] += self.density[i]
                leaf[parents[i]] = False
        self.sums = [self.density[i] if leaf[i] else below[i] for i in range(n)]
        self.top = list(range(n))  # node of the largest sum in each subtree, the first of equals
        for i in range(n - 1, 0, -1):
            p, mine = parents[i], self.top[i]
            if not self.gone[i] and (self.sums[mine], -mine) > (self.sums[self.top[p]], -self.top[p]):
                self.top[p] = mine

    def threshold(self, tree: _Tree) -> float:
        """The smallest density from the densest subtree up to the body."""
        i = self.top[self.body]
        least = self.density[i]
        while i >= 0:
            least = min(least, self.density[i])
            i = -1 if i == self.body else tree.parents[i]
        return least


def _without_furniture(tree: _Tree) -> _Sums:
    n, last, parents = len(tree.tags), list(range(len(tree.tags))), tree.parents
    for i in range(n - 1, 0, -1):
        last[parents[i]] = max(last[parents[i]], last[i])
    tree.last = last
    all_of = _Sums(tree, [False] * n)
    if not any(tree.hints):
        return all_of
    prose = all_of.chars[all_of.body] - all_of.link_chars[all_of.body]
    wraps = lambda i: all_of.articles[i] > 0 or tree.hints[i] == WHOLE and all_of.chars[i] - all_of.link_chars[i] > WRAPS * prose
    share = lambda i: (all_of.chars[i] - all_of.link_chars[i]) / max(1, prose)
    holds = lambda i: all_of.articles[i] > 0 or all_of.heads[i] > 0 or share(i) > NEARLY_ALL
    gone = [h >= WHOLE and not wraps(i) or h == PART_COMMENTS and not holds(i) for i, h in enumerate(tree.hints)]
    some = _Sums(tree, gone)
    if not some.chars[some.body] - some.link_chars[some.body]:  # nothing else is left
        gone = [g and not (h == NEVER_WRAPS and share(i) > WRAPS) for i, (g, h) in enumerate(zip(gone, tree.hints))]
        some = _Sums(tree, gone)
    best, threshold = some.top[some.body], some.threshold(tree)
    for i, h in enumerate(tree.hints):
        if h not in (PART, PART_COMMENTS) or some.gone[i] or i <= best <= last[i]:
            continue
        mostly_links = 2 * some.link_chars[i] > some.chars[i]
        inside = best < i <= last[best]
        gone[i] = mostly_links or not inside or some.density[i] < threshold and not some.heads[i]
    return _Sums(tree, gone)


def _join_siblings(tree: _Tree, of: _Sums, content: list[bool]) -> None:
    """Add to the content the siblings of the densest subtree that belong to it, unless an article or main element holds it."""
    best, i = of.top[of.body], of.top[of.body]
    while i > of.body and tree.tags[i] not in ("article", "main"):
        i = tree.parents[i]
    if best <= of.body or i > of.body or tree.tags[i] in ("article", "main"):
        return
    parent, siblings, i = tree.parents[best], [], tree.parents[best] + 1
    while i <= tree.last[parent]:
        siblings.append(i)
        i = tree.last[i] + 1
    held = [i for i in siblings if content[i] or any(content[i : tree.last[i] + 1])]
    known = set(held)
    told: dict[int, list[str]] = {i: [] for i in siblings if not of.gone[i] and i not in known and of.chars[i] and not of.link_chars[i] and tree.hints[i] == NONE}
    for node, text in tree.events if told else ():
        at = bisect_right(siblings, node) - 1
        if text and at >= 0 and node <= tree.last[siblings[at]] and siblings[at] in told:
            told[siblings[at]].append(text)
    for i, texts in told.items():
        text = "".join(texts).strip()
        heading = tree.tags[i] in HEADINGS or of.heads[i]
        between = held and held[0] < i < held[-1]
        if heading or between or text[-1:] in _STOPS and "\u00a9" not in text:
            content[i : tree.last[i] + 1] = [True] * (tree.last[i] + 1 - i)


def main_text(page: str | None) -> str:
    """Main text of a page, its blocks joined by empty lines."""
    if not page:
        return ""
    tree = _parse(page)
    of = _without_furniture(tree)
    threshold, content, i = of.threshold(tree), [False] * len(tree.tags), of.body
    while i <= tree.last[of.body]:
        if not content[i] and not of.gone[i] and of.density[i] > 0 and of.density[i] >= threshold:
            top = of.top[i]
            content[top : tree.last[top] + 1] = [True] * (tree.last[top] + 1 - top)
        i = tree.last[i] + 1 if content[i] else i + 1
    _join_siblings(tree, of, content)
    blocks, words = [], []
    for node, text in [*tree.events, (0, None)]:
        if text is None:
            if block := " ".join("".join(words).split()):
                blocks.append(block)
            words = []
        elif content[node] and not of.gone[node]:
            words.append(text)
    return "\n\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    found = map_rows(pages.select("page_id", "url", "html"), "page_id bigint, url string, text string", lambda: lambda rows: [(i, u, main_text(h)) for i, u, h in rows], rows=64)
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
