"""Main text of web pages by composite text density.

Every element gets its characters per tag, adjusted for the characters and tags of links in it and in the whole body.
The block whose children's densities have the largest sum holds the article; the least density on its path up to the
body is the threshold by which further blocks are taken, each again by its largest sum inside.

Where an article element (or else a main element) outside a named block has text, the article is in it, and nothing else
on the page competes, however many dense blocks there are; of several, those count that have a fair share of the longest's
text. A section under a heading of comments or related pages is boilerplate. Boilerplate names in class or id, and forms,
only lower a claim: a named block wins only if it holds the block that is densest even so and the best block without a
name has next to no text beside it.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phmspark.llm.batches import with_text_columns
from phmspark.llm.common import spread, table

# HTML's elements without content, and those that begin a block of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base link meta title style script noscript template".split())
# Elements an implied end of p or li does not reach across.
SCOPE = frozenset("html body table td th caption button div article section main aside header footer nav form blockquote figure fieldset ul ol dl".split())
NOISE_TAGS = frozenset(
    "head title script style noscript template nav footer aside button select option textarea input dialog iframe object "
    "embed svg canvas audio video annotation annotation-xml menu".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs masthead footer sidebar aside widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended comment comments disqus replies respond pagination "
    "pager toolbar copyright banner".split()
)
# What a form asks for, beside its controls; the form itself is only a bad name, as some pages are one form.
FORM_PARTS = frozenset(("label", "legend"))
# Elements that no name speaks against; and those whose id is a slug of their heading.
UNNAMED = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
SLUGGED = frozenset("section h1 h2 h3 h4 h5 h6".split())
NAMED_CLAIM = 0.25  # what the density of a block in an element of such a name counts
NEXT_TO_NONE = 20  # a named block wins only over an unnamed one of so many times fewer characters
FAIR_SHARE = 0.25  # of the longest article's characters, that another article of the page needs to count as one
# Headings of sections that are no part of an article, without numbers and punctuation
BESIDE = frozenset(
    "comments|comment|reader comments|user comments|leave a comment|post a comment|leave a reply|replies|related|related articles|"
    "related posts|related stories|related content|more stories|more articles|you may also like|you might also like|read next|recommended|recommended for you".split("|")
)
_NAME = re.compile(r"[a-z0-9]+")
_MODIFIER = re.compile(r"(?:has|have|no|not|with|without)[-_]")


class _Tree(HTMLParser):
    """Elements in page order: parent, tag, noise, own boilerplate name; and the texts with the element each is in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.noise, self.named = [-1], ["html"], [False], [False]
        self.stack = [0]
        self.open: dict[str, list[int]] = {}  # places in the stack of each tag's open elements
        self.texts: list[tuple[int, str]] = []  # element, text; None marks a line break

    def _in_article(self) -> bool:
        return bool(self.open.get("article") or self.open.get("main"))

    def _is_noise(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in NOISE_TAGS or (tag in FORM_PARTS and self.open.get("form")):
            return True
        if tag == "header":
            return not self._in_article()
        if tag in ("html", "body"):
            return False
        for k, v in attrs:
            v = (v or "").lower()
            if k == "hidden" or (k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v)) or (k == "role" and v.strip() in NOISE_ROLES):
                return True
        return False

    def _is_named(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in UNNAMED:
            return False
        if tag == "form":
            return True
        for k, v in attrs:
            if k == "class" or (k == "id" and tag not in SLUGGED):
                names = [n for x in (v or "").lower().split() if not _MODIFIER.match(x) for n in _NAME.findall(x)]
                if not NOISE_NAMES.isdisjoint(names) or ("header" in names and not self._in_article()):
                    return True
        return False

    def _close(self, tags: tuple[str, ...], stop: frozenset) -> None:
        """End the nearest open element of ``tags`` that no element of ``stop`` shields, and all inside it."""
        at = max((places[-1] for t in tags if (places := self.open.get(t))), default=0)
        if not at or (at < len(self.stack) - 1 and any(places[-1] > at for t in stop if (places := self.open.get(t)))):
            return
        for k in self.stack[at:]:
            self.open[self.tag[k]].pop()
        del self.stack[at:]

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)  # as browsers do, whatever stands in it

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html" or (tag == "body" and self.open.get("body")):
            return
        if tag == "body" or tag not in IN_HEAD:
            self._close(("head",), frozenset())
        if tag in BLOCK:
            self._close(("p",), SCOPE)
        if tag == "li":
            self._close(("li",), frozenset(("ul", "ol", "menu")))
        elif tag in ("dt", "dd"):
            self._close(("dt", "dd"), frozenset(("dl",)))
        elif tag in ("td", "th"):
            self._close(("td", "th"), frozenset(("tr", "table")))
        elif tag == "tr":
            self._close(("tr",), frozenset(("table",)))
        up = self.stack[-1]
        self.parent.append(up)
        self.tag.append(tag)
        self.noise.append(self.noise[up] or self._is_noise(tag, attrs))
        self.named.append(self._is_named(tag, attrs))
        if tag in ("br", "hr"):
            self.texts.append((up, " "))
        if tag not in VOID:
            self.open.setdefault(tag, []).append(len(self.stack))
            self.stack.append(len(self.tag) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # "/" means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag not in ("html", "body"):  # what follows them still belongs to the body
            self._close((tag,), frozenset() if tag in BLOCK or tag == "head" else BLOCK)

    def handle_data(self, data: str) -> None:
        if self.tag[self.stack[-1]] == "head" and data.strip():
            self._close(("head",), frozenset())
        self.texts.append((self.stack[-1], data))


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_chars: int, body_link_chars: int) -> float:
    """Composite text density; counts of zero that divide count as one."""
    if not chars:
        return 0.0
    tags, lc, lt = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * lc + max(body_link_chars, 1) / max(body_chars, 1) * chars + math.e)
    return chars / tags * max(0.0, math.log(max(1.0, chars / lc * (tags / lt)))) / math.log(base)


def _weigh(tree: _Tree, noise: list[bool], claim: list[float]) -> tuple[list[int], list[float], list[int]]:
    """Of each element: characters, density times claim, and the block in it of the largest sum of those."""
    n, parent, tag = len(tree.tag), tree.parent, tree.tag
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link, in_math = [False] * n, [False] * n
    for k in range(1, n):
        in_link[k] = tag[k] == "a" or in_link[parent[k]]
        in_math[k] = tag[k] == "math" or in_math[parent[k]]
    for k, text in tree.texts:
        if not noise[k]:
            c = len("".join(text.split()))
            chars[k] += c
            if in_link[k]:
                link_chars[k] += c
    for k in range(n - 1, 0, -1):  # children come after their parents
        p = parent[k]
        chars[p] += chars[k]
        link_chars[p] += link_chars[k]
        if not noise[k]:
            tags[p] += tags[k] + (not in_math[k])  # a formula's elements are its letters
            link_tags[p] += link_tags[k] + (tag[k] == "a")
    body = tag.index("body") if "body" in tag else 0
    dens = [density(chars[k], tags[k], link_chars[k], link_tags[k], chars[body], link_chars[body]) * claim[k] for k in range(n)]
    total = [0.0] * n
    for k in range(1, n):
        total[parent[k]] += dens[k]
    # A block's candidates are itself and the blocks in it; a block without element children stands by its own density.
    leaf = [True] * n
    for k in range(1, n):
        if tag[k] in BLOCK and not noise[k]:
            leaf[parent[k]] = False
    worth = [(dens[k] if leaf[k] else total[k]) if tag[k] in BLOCK and not noise[k] else -1.0 for k in range(n)]
    best = list(range(n))
    for k in range(n - 1, 0, -1):
        p = parent[k]
        if worth[best[k]] > worth[best[p]]:
            best[p] = best[k]
    return chars, dens, best


def _beside(tree: _Tree) -> list[bool]:
    """Of each element: whether it is a block that begins with a heading of comments or related pages."""
    n, parent, tag = len(tree.tag), tree.parent, tree.tag
    heading: dict[int, list[str]] = {}
    first: dict[int, int] = {}  # block: the heading it begins with; -1: something else
    of = list(range(n))
    for k in range(1, n):
        if tag[k] not in HEADINGS:
            of[k] = of[parent[k]] if tag[of[parent[k]]] in HEADINGS else k
    for k, text in tree.texts:
        if tree.noise[k] or not text.strip():
            continue
        h = of[k] if tag[of[k]] in HEADINGS else -1
        if h >= 0:
            heading.setdefault(h, []).append(text)
        up = parent[h] if h >= 0 else k
        while up >= 0 and up not in first:
            first[up] = h
            up = parent[up]
    out = [False] * n
    for k, h in first.items():
        if h >= 0 and tag[k] in ("section", "div", "ul", "ol"):
            out[k] = " ".join(re.findall(r"[a-z]+", "".join(heading[h]).lower())) in BESIDE
    return out


def _inside(parent: list[int], marks: set[int]) -> list[bool]:
    out = [k in marks for k in range(len(parent))]
    for k in range(1, len(parent)):
        out[k] = out[k] or out[parent[k]]
    return out


def _articles(tree: _Tree, noise: list[bool]) -> set[int]:
    """Outermost article elements (or else main elements) that are in no named block and have a fair share of text."""
    n, parent, tag = len(tree.tag), tree.parent, tree.tag
    named = _inside(parent, {k for k in range(n) if tree.named[k]})
    chars = [0] * n
    for k, text in tree.texts:
        if not noise[k]:
            chars[k] += len("".join(text.split()))
    for k in range(n - 1, 0, -1):
        chars[parent[k]] += chars[k]
    for name in ("article", "main"):
        all_of = {k for k in range(n) if tag[k] == name}
        found = [k for k in all_of if chars[k] and not noise[k] and not named[k] and not _inside_any(parent, k, all_of)]
        if found:
            most = max(chars[k] for k in found)
            return {k for k in found if chars[k] >= FAIR_SHARE * most}
    return set()


def _inside_any(parent: list[int], k: int, some: set[int]) -> bool:
    k = parent[k]
    while k >= 0:
        if k in some:
            return True
        k = parent[k]
    return False


def main_text(html: str | None) -> str:
    """Blocks of the article, each with single spaces, in page order, joined by line ends; '' if there are none."""
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    parent, tag = tree.parent, tree.tag
    n = len(tag)
    body = tag.index("body") if "body" in tag else 0
    beside = _beside(tree)
    noise = [a or b for a, b in zip(tree.noise, _inside(parent, {k for k in range(n) if beside[k]}), strict=True)]
    articles = _articles(tree, noise)
    if not articles:  # a page may be one such section: then its heading only speaks against it
        noise, tree.named = tree.noise, [a or b for a, b in zip(tree.named, beside, strict=True)]
        articles = _articles(tree, noise)
    open_to_all = noise
    if articles:
        noise = [a or not b for a, b in zip(noise, _inside(parent, articles), strict=True)]
    if any(tree.named):
        claim = [1.0] * n
        for k in range(1, n):
            claim[k] = claim[parent[k]] * (NAMED_CLAIM if tree.named[k] else 1.0)
        weighed = _weigh(tree, noise, claim)
        winner = weighed[2][body]
        plain = [a or b for a, b in zip(noise, _inside(parent, {k for k in range(n) if tree.named[k]}), strict=True)]
        other = _weigh(tree, plain, [1.0] * n)
        kept, k = set(), winner
        while k >= 0:
            kept.add(k)
            k = parent[k]
        if other[0][other[2][body]] * NEXT_TO_NONE >= weighed[0][winner]:
            kept = set()
        noise = noise[:]
        for k in range(1, n):
            noise[k] = noise[k] or (tree.named[k] and k not in kept)
        noise = [a or b for a, b in zip(noise, _inside(parent, {k for k in range(n) if tree.named[k] and k not in kept}), strict=True)]
    chars, dens, best = _weigh(tree, noise, [1.0] * n)
    top = best[body]
    threshold, k = dens[top], top
    while k not in (body, -1):
        k = parent[k]
        threshold = min(threshold, dens[k]) if k >= 0 else threshold
    taken = [False] * n
    taken[top] = chars[top] > 0
    for k in range(1, n):  # page order: a taken element's inside is taken with it
        if taken[parent[k]]:
            taken[k] = True
        elif not noise[k] and chars[k] and tag[k] in BLOCK and dens[k] >= threshold and not taken[k]:
            taken[best[k]] = True
    if articles:  # headings above the article, such as its title
        begin = taken.index(True) if True in taken else 0
        noise = [a and not (k < begin and tag[k] in HEADINGS and not open_to_all[k]) for k, a in enumerate(noise)]
    holds = taken[:]  # has taken elements inside: its own headings belong to them
    for k in range(n - 1, 0, -1):
        holds[parent[k]] |= holds[k]
    for k in range(1, n):
        if tag[k] in HEADINGS and holds[parent[k]] or taken[parent[k]]:
            taken[k] = True
    block = list(range(n))
    for k in range(1, n):
        if tag[k] not in BLOCK:
            block[k] = block[parent[k]]
    out: list[str] = []
    now, last = [], -1
    for k, text in tree.texts:
        if noise[k] or not taken[k]:
            continue
        if block[k] != last:
            out.append(" ".join("".join(now).split()))
            now, last = [], block[k]
        now.append(text)
    out.append(" ".join("".join(now).split()))
    return "\n".join(x for x in out if x)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with main_text, read from the whole html. Null, empty and article-less pages have the empty text;
    repeated rows each keep a row; a column named main_text is replaced. Elements are walked in page order without
    recursion or searches of the open elements, so depth is no limit; malformed declarations are comments."""
    return with_text_columns(pages, html_col, lambda: lambda htmls: {"main_text": [main_text(h) for h in htmls]}, "main_text string")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; null and empty pages have the empty text."""
    found = extract(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
