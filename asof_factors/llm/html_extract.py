"""HTML extraction by tag-path ratios.

Each page becomes a sequence of text nodes with their root-to-leaf tag paths.
Text length and punctuation are summed per path and divided by the path's
number of nodes; both ratios are smoothed over the page with a Gaussian and
fused by their geometric mean.  What the markup says about a path is a feature of its
score, not a rule: outside of main text, the share of its text that is linked
lowers it, and
elements that name main text or boilerplate (by tag, role, class or id)
weight it.  The paths whose score reaches a share of the score of the page's
mean character are content nodes, and the blocks that hold any of them are the
main text, wherever they stand.

Defined results: null and empty pages have no text; unclosed tags and comments
end with the page; repeated rows give repeated results; a page without any
text node that scores gives an empty text.  An empty table gives an empty
result.  Other columns play no part.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import table

SIGMA, RADIUS = 1.0, 2
#: Threshold, as a share of the score of the page's mean character.
LAMBDA = 0.005
#: Weights of paths through elements that name main text, or boilerplate.
MAIN, BOILER = 30.0, 1e-5
#: Least weight of a path whose text is linked.
LINKED = 1e-3

# Fixed values of the markup language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title svg iframe select option math object".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "head"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "main", "td"}

# What is never main text.
BOILER_TAGS = set("nav footer aside form button input dialog menu head".split())
BOILER_ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar".split())
BOILER_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar footer header masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus reply replies widget toolbar pagination pager".split()
)
HEADERS = {"header", "masthead", "banner"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe|select|math|object)\b[^>]*+(?:>.*?(?:</(?P=raw)\b[^>]*+(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?>[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[A-Za-z/!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-label)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPACES = re.compile(r"\s+")
PUNCT = re.compile(r"[.,;:!?…。，、；：！？¿¡]")


def _boiler(tag: str, attrs: str, inside: bool) -> bool:
    """inside: of an article or main element, whose own header is content."""
    if tag in BOILER_TAGS or tag == "header" and not inside:
        return True
    if tag in ("body", "html", "article", "main") or not attrs:
        return False
    for m in ATTR.finditer(attrs):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind == "hidden" or kind == "role" and value in BOILER_ROLES:
            return True
        if kind in ("class", "id"):
            names = set(re.split(r"[^a-z0-9]+", value)) & BOILER_NAMES
            if names - HEADERS if inside else names:
                return True
    return False


class Page:
    """Text nodes of a page: path, block, text, whether it is linked; and for
    each path whether it runs through boilerplate or main elements."""

    def __init__(self, source: str):
        self.tags, self.boiler = ["#root"], [False]
        self.path_of: dict[tuple[int, str, bool, bool], int] = {}
        self.nodes: list[tuple[int, int, str, bool]] = []
        stack, paths = [0], [0]
        open_: dict[str, int] = {}
        block = main = links = at = 0

        def pop() -> None:
            nonlocal main, links
            tag = self.tags[stack.pop()]
            paths.pop()
            open_[tag] -= 1
            main -= tag in ("article", "main")
            links -= tag == "a"

        def text(raw: str) -> None:
            if raw:
                self.nodes.append((paths[-1], block, raw, links > 0))

        for m in TOKEN.finditer(source):
            text(source[at : m.start()])
            at = m.end()
            tag = (m["tag"] or "").lower()
            if not tag:
                continue
            if tag in BLOCK:
                block += 1
            if tag == "br":
                text(" ")
            if tag in VOID:
                continue
            if m["close"]:
                if open_.get(tag):
                    while self.tags[stack[-1]] != tag:
                        pop()
                    pop()
                continue
            if tag in CLOSES_P and open_.get("p"):
                while self.tags[stack[-1]] != "p":
                    pop()
                pop()
            for other in SAME.get(tag, ()):
                if open_.get(other):
                    k = len(stack) - 1
                    while k and self.tags[stack[k]] != other and self.tags[stack[k]] not in SCOPE:
                        k -= 1
                    if self.tags[stack[k]] == other:
                        while len(stack) > k:
                            pop()
            self.tags.append(tag)
            self.boiler.append(self.boiler[stack[-1]] or _boiler(tag, m["attrs"], main > 0))
            main += tag in ("article", "main")
            paths.append(self.path_of.setdefault((paths[-1], tag, self.boiler[-1], main > 0), len(self.path_of) + 1))
            stack.append(len(self.tags) - 1)
            open_[tag] = open_.get(tag, 0) + 1
            links += tag == "a"
        text(source[at:])


def path_scores(page: Page) -> tuple[np.ndarray, float]:
    """Weighted, smoothed and fused ratio of each node, and the threshold."""
    path = np.array([n[0] for n in page.nodes], dtype=np.int64)
    length = np.array([len(n[2].strip()) for n in page.nodes], dtype=float)
    punct = np.array([len(PUNCT.findall(n[2])) for n in page.nodes], dtype=float)
    linked = np.array([n[3] for n in page.nodes])
    weight = np.array([1.0, *((BOILER if boiler else MAIN if main else 1.0) for _, _, boiler, main in page.path_of)])
    n_paths = len(weight)
    total = np.bincount(path, length, n_paths)
    prose = 1 - np.bincount(path, length * linked, n_paths) / np.maximum(total, 1)
    weight = weight * np.where(weight < MAIN, np.maximum(prose, LINKED), 1.0)  # main text may be linked
    count = np.maximum(np.bincount(path, length > 0, n_paths), 1)
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    smooth = lambda x: np.convolve(np.pad(x, RADIUS), kernel / kernel.sum(), "valid")
    text_ratio, punct_ratio = smooth((total / count)[path]), smooth((np.bincount(path, punct, n_paths) / count)[path])
    fused = np.where(length > 0, np.sqrt(text_ratio * (1 + punct_ratio)) * weight[path], 0.0)
    return fused, LAMBDA * float((fused * length).sum() / max(1.0, length.sum()))


def extract(source: str | None) -> str:
    """The main text of a page, blocks joined by a line feed."""
    if not source:
        return ""
    page = Page(source)
    if not page.nodes:
        return ""
    fused, least = path_scores(page)
    scores: dict[int, float] = {}
    for n, s in zip(page.nodes, fused.tolist()):
        scores[n[0]] = max(s, scores.get(n[0], 0.0))
    content = {p for p, s in scores.items() if s > 0 and s >= least}
    blocks: dict[int, list[tuple[int, str]]] = {}
    for path, block, text, _ in page.nodes:
        blocks.setdefault(block, []).append((path, text))
    out = []
    for parts in blocks.values():
        if any(p in content and t.strip() for p, t in parts):
            if text := SPACES.sub(" ", html_lib.unescape("".join(t for _, t in parts))).strip():
                out.append(text)
    return "\n".join(out)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of each row of ``pages``."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": [extract(x) for x in b["html"]]})

    given = pages.selectExpr(f"`{id_col}` AS page_id", f"`{url_col}` AS url", f"`{html_col}` AS html")
    kind = given.schema["page_id"].dataType.simpleString()
    return given.mapInPandas(work, f"page_id {kind}, url string, text string")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).selectExpr("page_id", "url", "text", "CAST(char_length(text) AS bigint) AS n_chars")
