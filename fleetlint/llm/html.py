"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags
negative; the contiguous run with the largest sum, found in one linear scan,
is the content region. The weights come from labelled pages: pages whose only
``article`` (or else ``main``) element marks the content. They give the
log-odds of standing inside for every kind of tag, and of holding content for
every kind of container; containers that hold none (menus, footers, adverts
and the like) score nothing for their words, which are left out of the region
too. Kinds never seen in a labelled page fall back on what their names say.

Defined cases: null or empty html, and pages without content words, give an
empty text; unclosed and misnested tags end where an outer element ends; an
unclosed script or style runs to the end of the page; character references are
decoded once; repeated rows are extracted alike; an empty table gives an empty
result, and without labelled pages only names speak.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlint.llm.common import annotate, column
from fleetlint.session import tune

#: Most labelled pages that the weights are taken from, and most kinds that get a weight of their own.
SAMPLE, KINDS = 2_000, 4_096

#: Score of a tag inside a container of content.
INNER_TAG = -0.001

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style)(?=[\s/>]).*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[/!?a-z](?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^<>])*+>?"
    r"|[^<]+|<", re.I | re.S)
_NAME = re.compile(r"</?([a-z][a-z0-9-]*)", re.I)
_MARK = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_MARK_WORD = re.compile(r"[\w-]+")
_PARTS = re.compile(r"[a-z]+")

# Elements of HTML by what they do: fixed values.
INLINE = set("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main"
    " menu nav ol p pre section table ul".split())
# Elements whose end tag may be left out, and the start tags that end them.
ENDED_BY = {
    "p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
# Elements whose content is no text of the page; one that is never closed hides nothing.
HIDDEN = {
    name: re.compile(rf"</{name}(?=[\s/>])[^<>]*>", re.I)
    for name in "noscript template textarea select iframe svg title".split()}
CONTAINERS = set(
    "article aside body button dialog div fieldset figure footer form head header hgroup main menu nav ol section table td ul".split())
# Parts of element names, classes, ids and roles that mark what is not content.
NO_CONTENT = set(
    "ad ads adsbygoogle advert adverts advertisement alert aside banner breadcrumb breadcrumbs button comment comments consent contentinfo cookie"
    " cookies dialog disqus fieldset footer form head header login masthead menu modal nav navbar navigation newsletter notice"
    " notices pagination popup promo related reply replies search share sharing sidebar signup social sponsor sponsored"
    " subscribe toolbar widget".split())
CONTENT = set("article main story entry post".split())


def kind_of(tag: str) -> tuple[str, str, bool]:
    """Element name, kind (name with the class, id or role that says most) and whether the tag closes."""
    name = _NAME.match(tag)
    if not name:
        return "", "!", False
    element = name.group(1).lower()
    if tag[1] == "/":
        return element, "/" + element, True
    if "=" not in tag:
        return element, element, False
    words = [w.lower() for found in _MARK.findall(tag) for w in _MARK_WORD.findall("".join(found))]
    if not words:
        return element, element, False
    mark = min(words, key=named) if len(words) > 1 else words[0]
    if len(words) > 1 and named(mark) == 0:
        mark = next((w for w in words if named(w)), words[0])
    return element, f"{element}.{mark}" if element not in INLINE or named(mark) < 0 else element, False


@lru_cache(maxsize=65_536)
def named(kind: str) -> float:
    """What the name of a container says: 1 content, -1 none, 0 nothing."""
    parts = set(_PARTS.findall(kind))
    return -1.0 if parts & NO_CONTENT else 1.0 if parts & CONTENT else 0.0


class Open:
    """An open container with those around it; pages may nest as deep as they like."""

    __slots__ = ("kind", "outer", "content", "mark", "score")

    def __init__(self, kind: str, outer: "Open | None"):
        lean = named(kind)
        self.kind, self.outer = kind, outer
        self.content = lean > 0 or outer is not None and outer.content  # inside a container of content
        # The innermost one whose name says something, if any.
        self.mark: str | None = kind if lean or "." in kind else outer.mark if outer else None
        self.score: float | None = None  # see Weights.word


class Items:
    """Words and tags of a page, in order: ``(kind of tag or "", text, innermost open container)``."""

    def __init__(self, page: str):
        self.items: list[tuple[str, str, Open | None]] = []
        stack: list[tuple[str, Open]] = []
        opened: Counter = Counter()
        open_now: Open | None = None
        unended: set[str] = set()
        at = 0
        while found := _TOKEN.match(page, at):
            at, token = found.end(), found.group()
            if token[0] != "<" or len(token) == 1:
                self.items.append(("", token, open_now))
                continue
            if found.group("raw"):
                self.items.append((found.group("raw").lower(), "", open_now))
                continue
            element, kind, closes = kind_of(token)
            if element in HIDDEN and not closes and element not in unended:
                end = None if element == "svg" and token.endswith("/>") else HIDDEN[element].search(page, at)
                if end:
                    at = end.end()
                elif not token.endswith("/>"):
                    unended.add(element)
                if end or token.endswith("/>"):
                    self.items.append((element, "", open_now))
                    continue
            if closes:
                if element in BLOCKS and not opened[element]:
                    while stack and stack[-1][0] in INLINE:
                        opened[stack.pop()[0]] -= 1
                while opened[element]:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == element:
                        break
            else:
                while stack and element in ENDED_BY.get(stack[-1][0], ()):
                    opened[stack.pop()[0]] -= 1
                whole = element in CONTAINERS
                # Any element may be a container by its name; those of its own name in it have to be told from its end.
                if whole or element not in VOID and not token.endswith("/>") and (named(kind) or opened[element]):
                    stack.append((element, Open(kind, stack[-1][1] if stack else None)))
                    opened[element] += 1
            open_now = stack[-1][1] if stack else None
            self.items.append((kind, "", open_now))


def _content_span(items: list[tuple[str, str, Open | None]]) -> tuple[int, int] | None:
    """Where the only article (or else the only main element) of a page stands, without its tags."""
    for element in ("article", "main"):
        opens = [k for k, i in enumerate(items) if i[0].split(".")[0] == element]
        closes = [k for k, i in enumerate(items) if i[0] == "/" + element]
        if len(opens) == 1 and len(closes) == 1 and opens[0] < closes[0]:
            return opens[0] + 1, closes[0]
    return None


def count_kinds(page: str, inside: Counter, outside: Counter) -> None:
    """Add a labelled page's tags (``t``) and words by innermost container (``w``) to the counts."""
    items = Items(page).items
    span = _content_span(items)
    if span is None:
        return
    for k, (kind, text, stack) in enumerate(items):
        within = span[0] <= k < span[1]
        if text:
            n = len(text.split())
            if n and stack:
                inner = stack.mark or stack.kind
                (inside if within and named(inner) >= 0 else outside)["w" + inner] += n
        elif kind:
            (inside if within else outside)["t" + kind] += 1


class Weights:
    """Log-odds of tags and containers, with what names say as prior counts."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        self.counts = counts
        self.tags: dict[str, float] = {}
        self.words: dict[str, float] = {}

    def tag(self, kind: str) -> float:
        """Negative: from -4 for tags that only stand outside the content to -0.05."""
        got = self.tags.get(kind)
        if got is None:
            a, b = self.counts.get("t" + kind, (0, 0))
            lean = named(kind)
            a, b = a + 1 + (kind in INLINE or kind in ("p", "/p", "br")), b + 1 + 2 * (lean < 0)
            got = self.tags[kind] = max(-4.0, min(-0.05, math.log(a / b) / 2 - 0.05))
        return got

    def container(self, kind: str) -> float:
        """Score of a word in a container: positive, or zero where there is no content."""
        got = self.words.get(kind)
        if got is None:
            a, b = self.counts.get("w" + kind, (0, 0))
            lean = named(kind)
            a, b = a + 1 + 20 * (lean > 0), b + 0.5 + 20 * (lean < 0)
            got = self.words[kind] = max(0.0, min(1.0, math.log(a / b)))
        return got

    def word(self, stack: Open | None) -> float:
        """The least score from the innermost article inwards, or of all open containers but the body."""
        unknown = []
        while stack is not None and stack.score is None:
            unknown.append(stack)
            stack = stack.outer
        score = stack.score if stack else math.inf
        for c in reversed(unknown):
            if named(c.kind) > 0:
                score = self.container(c.kind)
            elif (c.content or c.kind != "body") and (named(c.kind) or "w" + c.kind in self.counts):
                score = min(score, self.container(c.kind))
            c.score = score
        return score if score < math.inf else 0.5


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest positive sum; the first of equal ones."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, span = total, (start, k + 1)
    return span


def extract(page: str, weights: Weights) -> str:
    """The main text of a page."""
    items = Items(page).items
    values, scores = [], []
    for kind, text, stack in items:
        if text:
            value = weights.word(stack)
            values.append(value)
            scores.append(value * len(text.split()))
        else:
            # Inside a container of content a tag is no border, whatever else it stands in.
            values.append(0.0)
            scores.append(INNER_TAG if stack and stack.content else weights.tag(kind))
    start, end = best_run(scores)
    parts = []
    for (kind, text, _), value in zip(items[start:end], values[start:end]):
        if text:
            if value > 0:
                parts.append(entities.unescape(text) if "&" in text else text)
        elif kind.lstrip("/").split(".")[0] not in INLINE:
            parts.append(" ")
    return " ".join("".join(parts).split())


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Weights:
    """Weights from a bounded sample of the pages, those with the smallest hash of their id."""
    tune(pages.sparkSession)
    ids = pages.select(column(id_col).alias("sampled_id")).where("sampled_id IS NOT NULL").distinct()
    ids = ids.orderBy(F.xxhash64("sampled_id"), "sampled_id").limit(sample)
    chosen = pages.select(column(id_col).alias("sampled_id"), column(html_col).cast("binary").alias("html")).join(
        F.broadcast(ids), "sampled_id")
    schema = T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("inside", T.LongType()), T.StructField("outside", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside: Counter = Counter()
        outside: Counter = Counter()
        for batch in batches:
            for raw in batch.column("html").to_pylist():
                if raw:
                    count_kinds(raw.decode("utf-8", "replace"), inside, outside)
        kinds = sorted(inside.keys() | outside.keys())
        yield pa.RecordBatch.from_arrays([
            pa.array(kinds, pa.string()), pa.array([inside[k] for k in kinds], pa.int64()),
            pa.array([outside[k] for k in kinds], pa.int64()),
        ], names=schema.names)

    rows = chosen.mapInArrow(run, schema).groupBy("kind").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
    top = rows.orderBy(F.desc(F.col("i") + F.col("o")), "kind").limit(KINDS).collect()
    return Weights({r["kind"]: (r["i"], r["o"]) for r in top})


def extracted(pages: DataFrame, weights: Weights, carry: list[str], html_col: str = "html") -> DataFrame:
    """``row`` and the main ``text`` of every page."""

    def make():
        def run(raws: list[bytes]) -> list[pa.Array]:
            return [pa.array([extract(raw.decode("utf-8", "replace"), weights) for raw in raws], pa.string())]

        return run

    return annotate(pages, carry, html_col, make, [T.StructField("text", T.StringType(), False)])


def main_text(pages: DataFrame) -> DataFrame:
    """The contract's columns for every page."""
    found = extracted(pages, learn(pages), ["page_id", "url"])
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
