"""Main text of web pages by the consensus of their hosts.

1. Each page's containers are scored. A page is read into blocks of text, each within nested elements; a block in a menu, header, footer, sidebar,
   notice, advert, form or among comments counts nothing, a block that is mostly links counts against its containers, other text counts by its length.
   A container's score is that of its own blocks and ``FADE`` times that of the containers in it, so the closest around most of the text wins; an ``article`` or
   ``main`` around it, or in it with half of its score, is preferred.
2. In Spark, the pages of a host vote: each for the generalised path of its best container (tags with their sorted classes and id, digits as one sign), so
   that numbered elements of different pages are one path.
3. A page's text is taken from all elements of the path, among its own containers' paths, that most pages of its host voted for (ties: its own higher score, then the path).
   The first reading takes the text of the page's own best path along; pages whose path the votes change are read again.

Pages are never grouped: votes are counted by (host, path), which combines before the shuffle. Most pages' best path is their host's first; only of the others
are containers laid out as rows and joined to the votes, and only pages whose path changes are joined back to the pages, by key. Pages without a host vote for nobody and keep their best.

Text: character references are decoded, white space in a block becomes one space, blocks are trimmed and joined by an empty line. ``br`` and table cells are
white space within a block; unclosed and misplaced tags are read as browsers do (``p``, ``li``, cells and rows end by themselves, end tags close what is open within).

Defined results: null or empty html, and a page without text, give an empty text; a null or relative url is no host; repeated rows vote as often as they occur and
are each answered; tags of any length are read in linear time; more than ``MOST_OPEN`` nested elements are flattened, and lose no text; an empty table stays empty; other columns are carried along under their names. A page costs
some ten times its size while it is read, and batches are cut to slices of pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.shared import materialise
from emberlog.llm.url_filter import host_of
from emberlog.llm.words import slices

FADE = 0.75
#: Elements open at a time. Deeper ones are read as if they were not there (as browsers do), so that no page takes quadratic time.
MOST_OPEN = 512

# Elements of HTML by what they do to blocks and containers.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
#: What can hold a page's text. Blocks in other elements (paragraphs, lists, tables, quotes) belong to the nearest of these.
CONTAINERS = frozenset("html body div article main section center details fieldset form header".split())
#: Elements that authors mark as main text.
MARKED = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset(("td", "th"))
VOID = frozenset("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
IN_HEAD = frozenset("html head title meta link style script base noscript template bgsound".split())
ENDS_P = BLOCKS - {"body", "caption", "frameset", "head", "html", "legend", "optgroup", "option", "tbody", "tfoot", "thead", "tr"}
#: An element that ends open ones of these by itself, up to the nearest of those that hold them.
ENDS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "table tr"), "th": ("td th", "table tr"),
    "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"), "option": ("option", "select")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
#: Never main text, with all that is in them.
NEVER = frozenset("head nav footer aside script style noscript template iframe object svg canvas audio video button select textarea title dialog menu search map noembed noframes xmp".split())
#: Words of classes, ids and roles of boilerplate.
LABELS = frozenset(
    "ad ads adsense adslot advert adverts advertisement advertising adv banner breadcrumb breadcrumbs colophon comment commentlist comments complementary consent contentinfo cookie "
    "cookies copyright discussion disqus footer form gdpr login masthead menu menubar menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popular popup "
    "promo promos promoted promotion promotions rail recommendations recommended related replies reply respond search searchbox share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription tags toolbar topbar trending widget widgets aside dialog alertdialog".split()
)
HEADER = frozenset(("header",))

_RAW_ELEMENTS = "|".join(rf"(?i:{t})(?=[\s/>])[^>]*+>(?:(?s:.*?)</(?i:{t})(?=[\s/>])[^>]*+>|(?s:.*))" for t in sorted(RAW))
#: Comments, declarations, elements whose content is no markup, and tags. Quotes hide a ``>``, unless they do not end.
_TOKEN = re.compile(
    r"(<!--(?:-?>|(?s:.*?)--!?>|(?s:.*))|<!\[CDATA\[(?:(?s:.*?)\]\]>|(?s:.*))|<[!?][^>]*+>|<(?:" + _RAW_ELEMENTS + r""")|</?[a-zA-Z](?>[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[a-zA-Z][^>]*+>|</[^>a-zA-Z][^>]*+>)"""
)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_DIGITS = re.compile(r"\d+")

_CUT_OFF = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_HEAD_ONLY, _P_ONLY, _P_WALLS = frozenset(("head",)), frozenset(("p",)), frozenset(("table", "button")) | CELLS

PLAIN, LABELLED, HEAD, GONE = range(4)


@lru_cache(4096)
def _attributes(tag: str, text: str) -> tuple[str, int]:
    """The step of an element in a generalised path, and what its attributes say it is."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "").lower()):
        return tag, GONE
    named = [*found.get("class", "").split(), *found.get("id", "").split()]
    step = ".".join([tag, *sorted({_DIGITS.sub("0", x.lower()) for x in found.get("class", "").split()})])
    if found.get("id"):
        step += "#" + _DIGITS.sub("0", found["id"].lower())
    said = {w.lower() for x in [*named, found.get("role", "")] for w in _WORD.findall(x)}
    return step, LABELLED if said & LABELS else HEAD if said & HEADER and tag not in HEADINGS else PLAIN


class Tag(NamedTuple):
    """What a tag does, worked out once for tags written alike."""

    closing: bool
    name: str
    block: bool
    heading: bool
    ends_p: bool
    in_head: bool
    pushed: bool
    step: str = ""
    kind: int = PLAIN


@lru_cache(16384)
def _tag(token: str) -> Tag | None:
    found = _NAME.match(token)
    if not found:
        return None
    tag = found[2].lower()
    block, heading = tag in BLOCKS, tag in HEADINGS
    if found[1]:
        return Tag(True, tag, block, heading, tag in ENDS_P, tag in IN_HEAD, False)
    attributes = token[found.end() : -1]
    step, kind = _attributes(tag, attributes) if attributes and tag not in RAW and tag not in VOID else (tag, PLAIN)
    if tag in NEVER:
        kind = GONE
    elif kind == PLAIN and tag == "form":
        kind = LABELLED
    elif kind == PLAIN and tag == "header":
        kind = HEAD
    empty = tag in VOID or tag in RAW or attributes.endswith("/") and not block
    return Tag(False, tag, block, heading, tag in ENDS_P, tag in IN_HEAD, not empty and (block or tag in CELLS or kind != PLAIN), step, kind)


def _open_ended(token: str) -> bool:
    """Does a comment, or an element whose content is no markup, go on to the page's end?"""
    if token.startswith("<!--"):
        return not token.endswith(("-->", "--!>")) and token not in ("<!-->", "<!--->")
    if token.startswith("<![CDATA["):
        return not token.endswith("]]>")
    name = _NAME.match(token)
    return bool(name) and not name[1] and name[2].lower() in RAW and not re.search(rf"(?i)</{name[2]}(?=[\s/>])[^>]*>$", token)


class Page:
    """A page's elements that hold blocks, in order of their start, and its blocks of text."""

    def __init__(self, source: str):
        self.tags, self.steps, self.parents, self.kinds = ["#"], [""], [-1], [PLAIN]
        #: element, text, characters within links, is it a heading
        self.blocks: list[tuple[int, str, int, bool]] = []
        self._stack: list[int] = [0]
        self._parts: list[str] = []
        self._linked = self._gone = self._headings = self._paragraphs = 0
        self._in_link = False
        self._read(source)
        self._exempt()

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.blocks.append((self._stack[-1], text, self._linked, self._headings > 0))
            self._parts.clear()
        self._linked = 0
        self._in_link = False

    def _pop_to(self, depth: int) -> None:
        """Close the elements from this depth of the stack on."""
        stack, tags = self._stack, self.tags
        for e in stack[depth:]:
            if tags[e] in BLOCKS:
                self._flush()
                break
        for e in stack[depth:]:
            self._gone -= self.kinds[e] == GONE
            self._headings -= tags[e] in HEADINGS
            self._paragraphs -= tags[e] == "p"
        del stack[depth:]

    def _close(self, wanted: frozenset[str], walls: frozenset[str]) -> None:
        """End the open elements of these kinds, as far as one of the others."""
        stack, tags, first = self._stack, self.tags, 0
        for depth in range(len(stack) - 1, 0, -1):
            tag = tags[stack[depth]]
            if tag in walls:
                break
            if tag in wanted:
                first = depth
        if first:
            self._pop_to(first)

    def _end(self, tag: Tag) -> None:
        stack, tags, name = self._stack, self.tags, tag.name
        if name == "a":
            self._in_link = False
        elif name in CELLS or name == "br":
            self._parts.append(" ")
        for depth in range(len(stack) - 1, 0, -1):
            open_tag = tags[stack[depth]]
            if open_tag == name or tag.heading and open_tag in HEADINGS:
                return self._pop_to(depth)
            if not tag.block and name not in CELLS and open_tag in BLOCKS:
                return None  # what is within a block does not end it
        return None

    def _start(self, tag: Tag) -> None:
        stack, tags, name = self._stack, self.tags, tag.name
        if name == "body" or not tag.in_head:
            if self._gone and any(tags[e] == "head" for e in stack):
                self._close(_HEAD_ONLY, frozenset())
        if (name == "html" or name == "body") and any(tags[e] == name for e in stack):
            return
        if tag.ends_p and tags[stack[-1]] == "p":
            self._pop_to(len(stack) - 1)
        elif tag.ends_p and self._paragraphs:
            self._close(_P_ONLY, _P_WALLS)
        if name in ENDS:
            self._close(*ENDS[name])
        if tag.heading and tags[stack[-1]] in HEADINGS:
            self._pop_to(len(stack) - 1)
        if tag.block:
            self._flush()
        elif name == "br" or name in CELLS:
            self._parts.append(" ")
        elif name == "a":
            self._in_link = True
        if tag.pushed and len(stack) < MOST_OPEN:
            self.parents.append(stack[-1])
            stack.append(len(tags))
            tags.append(name)
            self.steps.append(tag.step)
            self.kinds.append(tag.kind)
            self._gone += tag.kind == GONE
            self._headings += tag.heading
            self._paragraphs += name == "p"

    def _read(self, source: str) -> None:
        # behind the last ">" there is no tag, but maybe one that the page's end cuts off
        last = source.rfind(">") + 1
        cut = _CUT_OFF.search(source, last)
        tokens = _TOKEN.split(source[:last])
        if tokens[-1] or len(tokens) == 1 or not _open_ended(tokens[-2]):
            tokens[-1] += source[last : cut.start() if cut else len(source)]
        for i, token in enumerate(tokens):
            if i & 1:
                tag = _tag(token)
                if tag is not None:
                    (self._end if tag.closing else self._start)(tag)
            elif token and not self._gone:
                self._parts.append(html.unescape(token) if "&" in token else token)
                if self._in_link:
                    self._linked += len(token.strip())
        self._flush()

    def _exempt(self) -> None:
        """A label on an element around the page's heading or article is about its layout; and if labels leave no text, none of them counts."""
        holds = [False] * len(self.tags)
        for e in range(len(self.tags) - 1, 0, -1):
            up = self.parents[e]
            own = self.tags[e] in ("h1", "main") or self.tags[e] == "article" and self.kinds[e] == PLAIN
            if (own or holds[e]) and self.kinds[e] not in (GONE, HEAD):
                holds[up] = True
        for e, held in enumerate(holds):
            if self.kinds[e] == LABELLED and (held or self.tags[e] in ("html", "body", "main")):
                self.kinds[e] = PLAIN
        self._spread()
        if self.blocks and not any(self.counts(b) for b in self.blocks):
            self.kinds = [PLAIN if k == LABELLED else k for k in self.kinds]
            self._spread()

    def _spread(self) -> None:
        """What an element is within: the strongest kind from the top."""
        self.within = list(self.kinds)
        for e in range(1, len(self.tags)):
            above = self.within[self.parents[e]]
            kind = self.kinds[e]
            self.within[e] = GONE if GONE in (above, kind) else LABELLED if LABELLED in (above, kind) else HEAD if HEAD in (above, kind) else PLAIN

    def counts(self, block: tuple[int, str, int, bool]) -> bool:
        return self.within[block[0]] == PLAIN

    def scores(self) -> list[float]:
        holder = [0] * len(self.tags)
        for e in range(1, len(self.tags)):
            holder[e] = e if self.tags[e] in CONTAINERS else holder[self.parents[e]]
        score = [0.0] * len(self.tags)
        for element, text, linked, _ in self.blocks:
            if self.within[element] == PLAIN:
                score[holder[element]] += -len(text) if 2 * linked > len(text) else len(text)
        for e in range(len(score) - 1, 0, -1):
            if holder[e] == e:
                score[holder[self.parents[e]]] += FADE * score[e]
        return score

    def paths(self) -> list[str]:
        """Each element's path, named by a hash of the name of its parent's path and its own step."""
        out = [""]
        for e in range(1, len(self.tags)):
            out.append(xxhash.xxh3_128_hexdigest(f"{out[self.parents[e]]}/{self.steps[e]}".encode("utf-8", "surrogatepass")))
        return out

    def candidates(self) -> tuple[str | None, dict[str, float]]:
        """The path of the best container, and each container's path with its best score."""
        score, path = self.scores(), self.paths()
        best = max((e for e in range(len(score)) if score[e] > 0), key=lambda e: (score[e], e), default=None)
        if best is None:
            return None, {}
        marked = [e for e in range(1, len(score)) if self.tags[e] in MARKED and self.within[e] == PLAIN]
        around, e = [], best
        while e > 0:
            around += [e] if self.tags[e] in MARKED else []
            e = self.parents[e]
        around = [e for e in around if self.tags[e] == "article"][-1:] or around[:1]
        inside = [e for e in marked if 2 * score[e] >= score[best]]
        chosen = around[0] if around else max(inside, key=lambda e: (score[e], -e), default=best)
        found: dict[str, float] = {}
        for e, s in enumerate(score):
            if s > 0:
                found[path[e]] = max(s, found.get(path[e], 0.0))
        found.setdefault(path[chosen], score[chosen])
        return path[chosen], found

    def text(self, wanted: str) -> str:
        """The text of all elements of a path."""
        path, inside = self.paths(), [False] * len(self.tags)
        whole_page = self.tags[path.index(wanted)] in ("#", "html", "body") if wanted in path else True
        out = []
        for e in range(len(path)):
            inside[e] = path[e] == wanted or (e > 0 and inside[self.parents[e]])
        for element, text, _, heading in self.blocks:
            kind = self.within[element]
            if inside[element] and (kind == PLAIN or kind == HEAD and heading and not whole_page):
                out.append(text)
        return "\n\n".join(out)


def main_text(source: str | None, path: str | None = None) -> str:
    """The text of a page's elements of a path; without one, of its best container."""
    if not source:
        return ""
    page = Page(source)
    path = page.candidates()[0] if path is None else path
    return "" if path is None else page.text(path)


# Votes of hosts in Spark

CANDIDATES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("score", T.DoubleType())]))
_ARROW_CANDIDATES = pa.list_(pa.struct([("path", pa.string()), ("score", pa.float64())]))


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows with, instead of the last column, html: best path, its text, and all candidates."""
    for batch in batches:
        for part in slices(batch, batch.num_columns - 1):
            best, texts, listed = [], [], []
            for source in part.column(batch.num_columns - 1).to_pylist():
                page = Page(source or "")
                path, found = page.candidates()
                best.append(path)
                texts.append("" if path is None else page.text(path))
                listed.append([{"path": p, "score": s} for p, s in sorted(found.items())])
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(best, pa.string()), pa.array(texts, pa.string()), pa.array(listed, _ARROW_CANDIDATES)], names=[*part.schema.names[:-1], "best", "text", "candidates"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, tie, path, html`` to ``id, tie, text``."""
    for batch in batches:
        for part in slices(batch, 3):
            texts = [main_text(source, path) for path, source in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(texts, pa.string())], names=["id", "tie", "text"])


def dissenting(surveyed: DataFrame) -> DataFrame:
    """Of pages surveyed (``id, tie, host, best, candidates``) those whose host's votes choose another of their paths: ``id, tie, path``."""
    voting = surveyed.filter("host <> '' AND best IS NOT NULL")
    votes = materialise(voting.groupBy("host", F.col("best").alias("path")).agg(F.count("*").alias("votes")), "votes")
    most = votes.groupBy("host", "votes").agg(F.count("*").alias("ties"), F.min("path").alias("first")).groupBy("host").agg(F.max(F.struct("votes", "ties", "first")).alias("most"))
    others = voting.join(most, "host").filter("best <> most.first OR most.ties > 1").drop("most")
    rows = others.select("id", "tie", "host", "best", F.explode("candidates").alias("c")).select("id", "tie", "host", "best", "c.path", "c.score")
    rows = rows.join(votes, ["host", "path"])
    chosen = rows.groupBy("id", "tie", "host", "best").agg(F.min_by("path", F.struct(-F.col("votes"), -F.col("score"), "path")).alias("path"))
    return chosen.filter("path <> best").select("id", "tie", "path").distinct()


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", source: str = "html", name: str = "main_text") -> DataFrame:
    """The pages with their columns, but for the html, and with their main text under ``name``."""
    keep = F.struct(*(F.col(c) for c in pages.columns if c != source))
    keyed = pages.select(keep.alias("row"), F.col(page_id).alias("id"), F.xxhash64(url, source).alias("tie"), host_of(F.col(url)).alias("host"), F.col(source).alias("html"))
    text = T.StructField("text", T.StringType())
    read = T.StructType([*keyed.schema.fields[:-1], T.StructField("best", T.StringType()), text, T.StructField("candidates", CANDIDATES)])
    surveyed = materialise(keyed.mapInArrow(_survey, read), "surveyed")
    other = materialise(dissenting(surveyed), "dissenting")
    again = keyed.select("id", "tie", "html").join(other.select(F.col("id").alias("_id"), F.col("tie").alias("_tie"), "path"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")))
    again = again.select("id", "tie", "path", "html").mapInArrow(_extract, T.StructType([keyed.schema["id"], T.StructField("tie", T.LongType()), text]))
    again = materialise(again.dropDuplicates(["id", "tie"]).select(F.col("id").alias("_id"), F.col("tie").alias("_tie"), F.col("text").alias("_text")), "again")
    rows = surveyed.join(again, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left")
    texts = F.when(F.col("_tie").isNotNull(), F.col("_text")).otherwise(F.col("text"))
    return rows.select(*(F.col("row")[c].alias(c) for c in pages.columns if c != source), texts.alias(name))
