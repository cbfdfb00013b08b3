"""Main text of web pages: a style tree per site tells which branches of its pages are noise."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtide.llm.ranks import column, stored, unused

#: Branches of a site below this importance are removed; on fewer pages their importance is shrunk towards 1.
MIN_IMPORTANCE = 0.35
MIN_PAGES = 8
#: Inside article and main, which name the text, this many times as many pages are asked for.
INSIDE_PAGES = 2

# Element names of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
HIDDEN = frozenset(
    "head script style noscript template iframe object svg math canvas audio video select textarea button input "
    "datalist form nav footer aside menu dialog title xmp noembed noframes fieldset".split()
)
CLOSES_P = BLOCKS - frozenset("html body caption legend option optgroup summary tbody td tfoot th thead tr title".split())
CLOSED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"),
}
SCOPES = {
    "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",),
    "option": ("select",), "tbody": ("table",), "tfoot": ("table",), "p": ("td", "th", "table", "li", "blockquote", "div", "article", "section"),
}
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner banners sponsor sponsored promo promos promotion "
    "sidebar sidebars side rail menu menus nav navbar navigation breadcrumb breadcrumbs topbar masthead header footer foot bottom "
    "cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup overlay modal toolbar "
    "share sharing social related recommended recommendations trending comment comments commentlist respond reply replies disqus "
    "discussion login form search widget widgets pagination pager copyright skip".split()
)
#: Names of the parts of an article that aren't its text, and of those that are never taken for it.
COMMENTS = frozenset("comment comments commentlist respond reply replies disqus discussion ad ads advert advertisement sponsored".split())
NOT_ARTICLE = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related".split())
#: Words that only say what kind of part a name means. A name means noise if it has a word of noise and no others but these.
PART_NAMES = frozenset(
    "area bar block body bottom box btn button buttons card center col column container content cta desktop dropdown fixed "
    "global group icon icons inner item items left link links list lists main mini mobile outer page panel post posts "
    "primary right row secondary section site slot small sticky text title toggle top unit wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:\"[^\"]*+\"|'[^']*+'|[^>\"']++)*+)>"
    r"|<[!?/][^>]*+>|(?P<text>[^<]++|<)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([a-zA-Z][-a-zA-Z0-9_:]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[a-z]+")
BLANK = re.compile(r"\s+")


#: Clean text; text in parts whose names say noise; text in elements that never hold main text, in comments and adverts.
CLEAN, NAMED, NEVER = 0, 1, 2
MASK = (1 << 64) - 1


def _mix(h: int, x: int) -> int:
    h = ((h ^ x) * 0x9E3779B97F4A7C15) & MASK
    return h ^ (h >> 29)


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big")


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class Element:
    """An open element: its name, its place in the page's tree, how far it is noise, the place it stands in."""

    __slots__ = ("name", "node", "noise", "kind", "block")

    def __init__(self, name: str, node: int, noise: int, kind: str, block: bool) -> None:
        self.name, self.node, self.noise, self.kind, self.block = name, node, noise, kind, block


@dataclass
class Block:
    """A text block: its node, how far it is noise, ``article``, ``main`` or empty, and the text with white space joined."""

    node: int
    noise: int
    kind: str
    text: str


@dataclass
class Page:
    """A page's tree of block elements and its text blocks, in order.

    Of each node: its parent, its branch (a hash of the names on the path to it), a hash of its own name, and whether it
    lies below an article or main element. A node comes after its parent.
    """

    parent: list[int] = field(default_factory=lambda: [-1])
    branch: list[int] = field(default_factory=lambda: [1])
    label: list[int] = field(default_factory=lambda: [0])
    inner: list[bool] = field(default_factory=lambda: [False])
    blocks: list[Block] = field(default_factory=list)

    def add(self, parent: int, label: str, inner: bool) -> int:
        h = _digest(label)
        self.parent.append(parent)
        self.branch.append(_mix(self.branch[parent], h))
        self.label.append(h)
        self.inner.append(inner)
        return len(self.parent) - 1


def _named_noise(name: str, names: list[str], in_article: bool) -> int:
    """Whether class or id name a part that isn't main text. Of articles only some names count, of the page none."""
    if name in ("html", "body", "main"):
        return CLEAN
    noise = NOT_ARTICLE if name == "article" else NOISE_NAMES - {"header"} if in_article else NOISE_NAMES
    found = CLEAN
    for token in names:
        parts = NAME_PART.findall(token)
        if not noise.isdisjoint(parts) and all(p in NOISE_NAMES or p in PART_NAMES for p in parts):
            found = max(found, NAMED if COMMENTS.isdisjoint(parts) else NEVER)
    return found


def _signature(name: str, rest: str, in_article: bool) -> tuple[str, int]:
    """Name with class and id (without digits), and how far these, the role or a hidden mark say noise."""
    if "=" not in rest and "hidden" not in rest:
        return name, CLEAN
    of = {k.lower(): (a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(rest)}
    names = of.get("class", "").lower().split()
    anchor = of.get("id", "").lower().split()
    # a heading's id says what its text is about
    noise = CLEAN if name in HEADINGS else _named_noise(name, names + anchor, in_article)
    if (
        of.get("role", "").lower() in NOISE_ROLES or "hidden" in of or of.get("aria-hidden", "").lower() == "true"
        or "display:none" in of.get("style", "").replace(" ", "").lower()
    ):
        noise = NEVER
    label = " ".join(sorted({re.sub(r"[0-9]+", "", n) for n in names + anchor}))
    return (f"{name}.{label}" if label else name), noise


def parsed(page: str | None) -> Page:
    """The tree and the text blocks of a page. Unclosed and wrongly nested elements are closed as browsers do it.

    Work and memory grow with the length of the page, however deep its elements are nested.
    """
    out = Page()
    stack = [Element("", 0, CLEAN, "", False)]
    opened: dict[str, int] = {}
    text: list[str] = []

    def flush() -> None:
        if text:
            joined = BLANK.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if joined:
                top = stack[-1]
                out.blocks.append(Block(top.node, top.noise, top.kind, joined))

    def close_to(depth: int) -> None:
        if any(stack[i].block for i in range(depth, len(stack))):
            flush()
        for e in stack[depth:]:
            opened[e.name] -= 1
        del stack[depth:]

    def close(names: tuple[str, ...], stop: tuple[str, ...]) -> None:
        if not any(opened.get(n) for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                close_to(i)
                return
            if stack[i].name in stop:
                return

    at, page = 0, page or ""
    while (token := TOKEN.match(page, at)) is not None or at < len(page):
        if token is None:  # a tag that is never closed
            break
        at = token.end()
        if token["text"] is not None:
            text.append(token["text"])
            continue
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if token["end"]:
            if opened.get(name):
                close((name,), ())
            continue
        if name in CLOSES_P:
            close(("p",), SCOPES["p"])
        if name in CLOSED_BY:
            close(CLOSED_BY[name], SCOPES[name])
        if name in VOID:
            if name == "br":
                text.append("\n")
            elif name in BLOCKS:
                flush()
            continue
        block = name in BLOCKS
        if block:
            flush()
        if name in RAW:  # its content is no markup
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        top = stack[-1]
        label, noise = _signature(name, token["rest"], top.kind == "article")
        if name in HIDDEN or (name == "header" and not top.kind):
            noise = NEVER
        kind = top.kind
        if name == "article" or kind != "article" and (name == "main" or 'role="main"' in token["rest"]):
            kind = "article" if name == "article" else "main"
        node = out.add(top.node, label, kind != "" and kind == top.kind) if block else top.node
        stack.append(Element(name, node, max(top.noise, noise), kind, block))
        opened[name] = opened.get(name, 0) + 1
    flush()
    return out


def place(kind: str, branch: int) -> int:
    """A branch below an article or main element as one of that kind's tree."""
    return _mix(branch, _digest(kind)) if kind else branch


def leaf_of(page: Page, block: Block) -> int:
    """A block of an article or main element as a branch of its own, by its path and text."""
    return _mix(place(block.kind, page.branch[block.node]), _digest(block.text))


def chosen(page: Page) -> list[Block]:
    """The blocks that aren't noise, of the article if there is one, else of main, else of the page.

    A page of which nothing would be left keeps the parts that are noise by their names only.
    """
    for worst in (CLEAN, NAMED):
        found = [b for b in page.blocks if b.noise <= worst]
        for kind in ("article", "main"):
            if any(b.kind == kind for b in found):
                return [b for b in found if b.kind == kind]
        if found:
            return found
    return []


def main_text(page: Page, low: frozenset[int]) -> str:
    """The chosen blocks that aren't in ``low`` branches; all of them if they all are."""
    own = chosen(page)
    if not low or not own:
        return "\n\n".join(b.text for b in own)
    kind = own[0].kind
    inside = [False] * len(page.parent)
    for node, parent in enumerate(page.parent):
        judged = not kind or page.inner[node]
        inside[node] = parent >= 0 and (inside[parent] or judged and _signed(place(kind, page.branch[node])) in low)
    kept = [b for b in own if not inside[b.node] and not (kind and _signed(leaf_of(page, b)) in low)]
    return "\n\n".join(b.text for b in kept or own)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][-+.a-zA-Z0-9]*://([^/?#\s]*)", 1), F.lit("")))


OBSERVED = "host string, branch long, inner boolean, kind string, value long, copy long"


def branch_hashes(page: Page, blocks: list[Block], kind: str) -> dict[int, tuple[int, int]]:
    """Of every branch that holds some of the blocks: a hash of its style (the order of its parts, repeats left out) and
    of its content.

    Hashes are put together from the leaves to the root, so a block is looked at once, however deep it stands. A branch
    may have several elements in a page, which are joined in order. With a kind, only branches below its element count.
    """
    # parts of each node in page order: (place in that order, style, content)
    parts: dict[int, list[tuple[int, int, int]]] = {}
    for i, b in enumerate(blocks):
        parts.setdefault(b.node, []).append((i, 1, _digest(b.text)))
    found: dict[int, list[tuple[int, int]]] = {}
    for node in range(len(page.parent) - 1, 0, -1):
        own = parts.pop(node, None)
        if own is None:
            continue
        own.sort()
        style, content = 2, 2
        for x in dict.fromkeys(s for _, s, _ in own):
            style = _mix(style, x)
        for _, _, x in own:
            content = _mix(content, x)
        if not kind or page.inner[node]:
            found.setdefault(place(kind, page.branch[node]), []).append((style, content))
        parts.setdefault(page.parent[node], []).append((own[0][0], _mix(page.label[node], style), content))
    out = {}
    for branch, elements in found.items():
        style, content = 3, 3
        for x in dict.fromkeys(s for s, _ in reversed(elements)):
            style = _mix(style, x)
        for _, x in reversed(elements):
            content = _mix(content, x)
        out[branch] = style, content
    return out


def observed(page: Page) -> list[tuple[int, bool, str, int, int]]:
    """(branch, inner, kind, value, copy) of a page: of each branch its style and its content.

    Branches of the page around articles hold all text but that of articles. Those below an article or main element
    leave noise out, and have the texts of their single blocks as well. ``copy`` is a digest of the page's main text.
    """
    copy = _signed(_digest(main_text(page, frozenset())))
    rows = []
    for kind in ("", "main", "article"):
        own = [b for b in page.blocks if (b.kind == kind and b.noise == CLEAN if kind else b.kind != "article")]
        found = branch_hashes(page, own, kind)
        for branch, (style, content) in found.items():
            rows.append((_signed(branch), kind != "", "style", _signed(style), copy))
            rows.append((_signed(branch), kind != "", "content", _signed(content), copy))
        if kind:
            texts = {(place(kind, page.branch[b.node]), leaf_of(page, b)) for b in own}
            rows += [(_signed(branch), True, "text", _signed(leaf), copy) for branch, leaf in texts]
            # a path that has blocks of its own is counted even if it is the article's, for its blocks to be compared with
            rows += [(_signed(branch), True, "page", 0, copy) for branch in {b for b, _ in texts} - found.keys()]
    return rows


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_count: int = 2) -> DataFrame:
    """The style trees of all sites, a row per branch: host, branch, inner, n_pages, presentation, content, importance.

    The pages of a host are merged by the paths of their elements (names with class and id), which ``branch`` is a hash
    of. ``presentation`` is the entropy of the styles in which a branch is laid out, ``content`` that of what stands in
    it, both over the pages that have the branch and as a share of the most possible: 0 if all pages agree, 1 if no two
    do. ``importance`` is the larger of them: text that the site repeats in one layout is noise. Pages of one main text
    count once: a site that shows a text at several addresses doesn't repeat its parts.

    Branches below an article or main element (``inner``) are apart from those of the page. There, a block that stands
    beside others of its path is a branch as well if ``min_count`` pages hold it; its ``content`` is the share of the
    pages with the path that don't, its ``presentation`` null. Counts are combined before they are moved, so a large host
    is no hot key.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(host, *row) for host, page in zip(batch["host"], batch["html"]) for row in observed(parsed(page))]
            yield pd.DataFrame(rows, columns=["host", "branch", "inner", "kind", "value", "copy"])

    seen = pages.select(host_of(column(url_col)).alias("host"), column(html_col).alias("html")).mapInPandas(look, OBSERVED)
    of = ["host", "branch", "inner"]
    once = seen.groupBy(*of, "kind", "value", "copy").agg(F.lit(1).alias("one"))
    counts = stored(once.groupBy(*of, "kind", "value").agg(F.count("one").alias("count")), "style-counts")
    n = F.col("count").cast("double")
    per = counts.filter(F.col("kind") != "text").groupBy(*of, "kind").agg(F.sum(n).alias("pages"), F.sum(n * F.log2(n)).alias("terms"))
    entropy = F.when(F.col("pages") <= 1, 1.0).otherwise((F.log2("pages") - F.col("terms") / F.col("pages")) / F.log2("pages"))
    branches = per.groupBy(*of).agg(
        F.max("pages").cast("long").alias("n_pages"),
        F.max(F.when(F.col("kind") == "style", entropy)).alias("presentation"),
        F.max(F.when(F.col("kind") == "content", entropy)).alias("content"),
    )
    texts = counts.filter((F.col("kind") == "text") & (F.col("count") >= min_count)).select(*of, "value", "count")
    leaves = texts.join(branches.select(*of, "n_pages"), of).select(
        "host", F.col("value").alias("branch"), "inner", "n_pages",
        F.lit(None).cast("double").alias("presentation"), (1 - F.col("count") / F.col("n_pages")).alias("content"),
    )
    every = branches.filter(F.col("content").isNotNull()).unionByName(leaves)
    return every.withColumn("importance", F.greatest("presentation", "content"))


def extract(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", min_importance: float = MIN_IMPORTANCE, min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``pages`` with ``main_text``: the article without menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles, comments and the site's repeated branches.

    Blocks have their character references decoded and white space joined; they stand in page order, an empty line
    between them. If a page has articles (or else a main element) outside of noise, its text is theirs; otherwise all
    that isn't noise. In each case the branches are left out whose importance in the style tree of the host is below
    ``min_importance``. On fewer than ``min_pages`` pages, inside article and main ``INSIDE_PAGES`` times as many, half
    of the missing pages are taken to agree with no other, so that few pages have to agree more. These branches are a
    small written table per host; Spark joins it by its size.

    A page keeps its text where all of it would go; names of classes and ids (whole words of them, of headings none) only
    decide while something else is left. Null and empty pages have an empty text. Pages without a host share one tree.
    Pages with one main text count once, repeated rows too. An empty table gives an empty one. Other columns are kept;
    ``main_text`` is replaced. Time and memory of a page grow with its length, however deep its elements are nested.
    """
    asked = F.when(F.col("inner"), INSIDE_PAGES * min_pages).otherwise(min_pages)
    unseen = F.greatest(asked - F.col("n_pages"), F.lit(0)) / 2
    judged = (F.col("n_pages") * F.col("importance") + unseen) / (F.col("n_pages") + unseen)
    tree = style_tree(pages, url_col, html_col).filter(judged < min_importance)
    host, branches = unused(pages, "_host", "_low")
    low = stored(tree.groupBy(F.col("host").alias(host)).agg(F.sort_array(F.collect_list("branch")).alias(branches)), "style-tree")

    @F.pandas_udf("string")
    def text_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for page, paths in batches:
            yield pd.Series(
                [main_text(parsed(p), frozenset(x.tolist()) if x is not None else frozenset()) for p, x in zip(page, paths)], dtype=object
            )

    keep = [column(c) for c in pages.columns if c != "main_text"]
    joined = pages.join(low, host_of(column(url_col)) == F.col(host), "left")
    return joined.select(*keep, text_of(column(html_col), F.col(branches)).alias("main_text"))
