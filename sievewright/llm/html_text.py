"""HTML main text by the maximum-scoring subsequence.

A page becomes a sequence of words and tags. Words score positive and tags negative; one linear scan finds
the contiguous region with the highest sum. The weights come from labelled pages: those that mark their
content with one <article> or <main> element label themselves. The weight of a word is the log odds of its
context, the innermost element that names a page part or carries a class (or a link), and the weight of a tag the log
odds of its name with its class, both between the inside and the outside of the content, with a prior for
what training did not see; a word that training found outside scores next to nothing. Each page is learnt from
twice, as it is and with its content element taken for no element at all: the second weights serve pages that mark
no content.

Inside the region, parts that no article text belongs to are left out again: by element, by ARIA role and schema.org
type, by nesting (an article in an article is a comment or a teaser), and by class and id. The words of classes
and ids have log odds of their own from the labelled pages, with a prior against the few nouns that name such parts;
their sum decides. Boxes that are little but links go too, unless they hold a good share of the page's words. Parts
score nothing where their host has words both before and after them, so that they split no article; the host is
the outermost <article> or <main> around it, or without one the box that it stands in, if that is not the body.

A raw element ends at its end tag; without one, or if its tag closes itself, only the tag is skipped, with the
code or title up to the next tag for scripts, styles and titles. A head ends at its end tag or at the first text or
tag that no head holds. A quote inside an unquoted attribute quotes nothing.

Text is decoded, blanks inside a block become one space, blocks are trimmed and joined by a line end; a line
break ends a block. Scripts, styles, templates and comments are no text.

Weights are fitted on up to SAMPLE pages chosen by hash (documented bound); every page is extracted whole.

Defined cases: NULL and empty pages, and pages without words, give an empty text; unclosed and stray tags
are tolerated; repeated rows each get a row; an empty table stays empty; further columns are ignored by the query and
kept by ``extract_pages``, which replaces ``text``.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 4000
#: Contexts and tags seen on fewer sampled pages get the prior alone.
MIN_PAGES = 3
PRIOR_WORDS = 20.0

#: Elements whose content is never article text.
PARTS = frozenset("nav header footer aside form menu dialog button select option textarea label fieldset iframe svg".split())
#: fixed values: ARIA roles and schema.org types of such parts
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
TYPES = frozenset("sitenavigationelement wpheader wpfooter wpsidebar wpadblock comment usercomments".split())
#: Nouns of classes and ids that training must speak for before they are content.
NOUNS = frozenset("ad ads advert adverts advertisement nav navigation menu header footer sidebar notice comment comments".split())
#: Sum of the log odds of a box's names below which it is a part; share of links that makes a box one, and share of
#: the page's words outside links that it must not hold.
PART_ODDS, LINK_SHARE, KEEP_SHARE = -1.0, 0.8, 0.1
#: Elements whose text is no text.
RAW = ("script", "style", "noscript", "template", "title", "textarea", "iframe", "svg")
#: Elements that a head may hold; any other start tag, or text, ends it.
HEAD = frozenset("html head base basefont bgsound link meta title script style noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that open a context of their own; others are read as text layout.
BOXES = frozenset("article main section div nav header footer aside form menu dialog button select fieldset label ul ol dl table body blockquote figure td".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|=\s*[^\s>\"'][^\s>]*|[^>=]+|=)*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemtype|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}
_RAW_NEXT = {name: re.compile(rf"<(/?){name}(?=[\s/>]|\Z)", re.I) for name in RAW}
#: A slash that is no part of an attribute's value.
_EMPTY = re.compile(r"(?:^|[\s\"'])/\s*\Z")

@dataclass(slots=True)
class Item:
    """A text run (kind "w") or a tag (kind "t", payload is its key) with what it stands in."""

    kind: str
    payload: str
    context: str
    part: bool
    host: int
    box: int
    names: tuple[str, ...]


def _names(attributes: str) -> tuple[list[str], bool]:
    """Words of class and id, and whether a role or type says that the element is a part."""
    found, part = [], False
    for m in _NAMES.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        kind = m[1].lower()
        if kind in ("class", "id"):
            found += re.split(r"[\s_-]+", value)
        elif kind == "role":
            part |= not ROLES.isdisjoint(value.split())
        else:
            part |= any(x.rsplit("/", 1)[-1] in TYPES for x in value.split())
    return [x for x in found if x], part


def _raw_end(page: str, pos: int, name: str, attributes: str, endless: set[str]) -> int:
    """Where a raw element ends whose start tag ends at ``pos``. ``endless`` gathers names without a further end tag."""
    empty = bool(_EMPTY.search(attributes))
    if empty and (name == "svg" or name in endless):
        return pos
    if empty or name == "noscript" and name not in endless:
        # browsers ignore the slash: an end tag that comes next is this element's, whereas one that starts before it
        # shows that this one is empty, or for a noscript, which can't be nested, that its end tag is missing
        follows = _RAW_NEXT[name].search(page, pos)
        if empty and not follows or follows and not follows[1]:
            return pos
    end = _RAW_END[name].search(page, pos) if name not in endless else None
    if end:
        return end.end()
    endless.add(name)
    if name in ("script", "style", "title"):
        following = _TAG.search(page, pos)
        return following.start() if following else len(page)
    return pos


@dataclass(slots=True)
class _Open:
    """An open box."""

    name: str
    context: str
    part: bool
    host: int
    box: int
    names: tuple[str, ...]


def items(page: str, odds: Callable[[str], float] = lambda name: 0.0, hide: bool = False) -> Iterator[Item]:
    """Text runs and tags in page order. Each has its context, whether it lies in a part without article text, the
    number of the host that it belongs to (0 for none), that of its box, and the names of all boxes around it.

    ``odds`` are the log odds of a name; ``hide`` takes elements that mark the content for none.
    """
    stack = [_Open("", "body", False, 0, 0, ())]
    content: set[int] = set()
    boxes = 0
    links = 0
    endless: set[str] = set()
    in_head = False
    pos, size = 0, len(page)

    def item(kind: str, payload: str, of: _Open | None = None) -> Item:
        of = of or stack[-1]
        return Item(kind, payload, "@a" if links and kind == "w" else of.context, of.part, of.host, of.box, of.names)

    while pos < size:
        m = _TAG.search(page, pos)
        at = m.start() if m else size
        if in_head and at > pos:
            in_head = page[pos:at].isspace()
        if at > pos and not in_head:
            yield item("w", page[pos:at])
        if not m:
            return
        pos = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if in_head:
            if closing and name not in ("body", "html"):
                in_head = name != "head"
                continue
            in_head = not closing and name in HEAD
        marks = name in ("article", "main")
        if closing:
            if name == "a":
                links = max(0, links - 1)
            if name in BOXES and not (marks and hide):
                links = 0
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].name == name:
                        closed = stack[depth]
                        del stack[depth:]
                        yield item("t", f"/{closed.context}", closed)
                        break
                else:
                    yield item("t", f"/{name}")
            else:
                yield item("t", f"/{name}")
            continue
        if name in RAW:
            pos = _raw_end(page, pos, name, m[3], endless)
            if not in_head:
                yield item("t", name)
            continue
        if name == "head":
            in_head = True
        elif in_head:
            continue
        if name == "a":
            links = 1  # links don't nest
        if name in BOXES and not (marks and hide):
            links = 0
            names, part = _names(m[3])
            key = f"{name}.{'.'.join(sorted(set(names))[:4])}" if names else name
            inside = stack[-1].host in content
            if marks:
                part |= name == "article" and any(s.name == "article" for s in stack)
            else:
                # a header of the article itself holds its title
                part |= name in PARTS and not (name == "header" and inside)
                part |= sum(odds(x) for x in set(names) if not (x == "header" and inside)) < PART_ODDS
            part |= stack[-1].part
            boxes += 1
            host = stack[-1].host
            if not part and host not in content:
                host = 0 if name == "body" else boxes
                if marks:
                    content.add(host)
            stack.append(_Open(name, key, part, host, boxes, tuple({*stack[-1].names, *names})))
        yield item("t", stack[-1].context if name in BOXES and not (marks and hide) else name)


def _inside(key: str) -> bool:
    return key.split(".")[0] in ("article", "main")


def label_page(page: str) -> tuple[Counter, Counter] | None:
    """Counts of words by context and by name and of tags, inside and outside the one content element; None without
    one. Keys that begin with "h" are of the page whose content element is hidden."""
    inside, outside, depth, elements = Counter(), Counter(), 0, 0
    for i in items(page):
        if i.kind == "t":
            if _inside(i.payload):
                elements += 1
                depth += 1
                outside[f"t:{i.payload}"] += 1
                continue
            if i.payload[0] == "/" and _inside(i.payload[1:]):
                depth -= 1
                outside[f"t:{i.payload}"] += 1
                continue
            (inside if depth > 0 else outside)[f"t:{i.payload}"] += 1
        elif n := len(i.payload.split()):
            side = inside if depth > 0 else outside
            (outside if i.part else side)[f"w:{i.context}"] += n
            for name in i.names:
                side[f"n:{name}"] += n
    if elements != 1:
        return None
    depth = 0
    for i in items(page, hide=True):
        if i.kind == "t" and _inside(i.payload.lstrip("/")):
            depth += -1 if i.payload[0] == "/" else 1
        elif i.kind == "t":
            (inside if depth > 0 else outside)[f"ht:{i.payload}"] += 1
        elif n := len(i.payload.split()):
            (inside if depth > 0 and not i.part else outside)[f"hw:{i.context}"] += n
    return inside, outside


class Weights:
    """Log odds of contexts, tags and names, with priors."""

    #: What a word scores at least.
    LEAST = 1e-6

    def __init__(self, counts: dict[str, tuple[float, float, int]]):
        self.of: dict[str, float] = {}
        nouns = {f"n:{x}": (0, 0, MIN_PAGES) for x in NOUNS}
        for k, (inner, outer, pages) in (nouns | counts).items():
            if pages < MIN_PAGES and k not in nouns:
                continue
            # the prior counts are split as the part suggests: words are content, tags are not
            kind, _, name = k.partition(":")
            good = {"w": 0.8, "t": 0.3, "n": 0.1 if name in NOUNS else 0.5}[kind[-1]]
            odds = math.log((inner + PRIOR_WORDS * good) / (outer + PRIOR_WORDS * (1 - good)))
            self.of[k] = max(-4.0, min(4.0, odds))

    def name(self, name: str) -> float:
        return self.of.get(f"n:{name}", 0.0)

    def word(self, context: str, hide: bool = False) -> float:
        return max(self.LEAST, self.of.get(f"{'h' * hide}w:{context}", 1.0))

    def tag(self, key: str, part: bool, hide: bool = False) -> float:
        # tags are negative whatever training says; those that paragraphs are made of only slightly
        w = self.of.get(f"{'h' * hide}t:{key}")
        name = key.lstrip("/").split(".")[0]
        least = -0.05 if name in INLINE or name in ("p", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote") and not part else -0.5
        return least if w is None else min(least, w / 2)


def best_region(gains: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the highest sum; of equals the first, empty if none is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, g in enumerate(gains):
        if total <= 0:
            total, start = 0.0, i
        total += g
        if total > best:
            best, span = total, (start, i + 1)
    return span


def _linked(sequence: list[Item]) -> set[int]:
    """Numbers of the boxes that are little but links."""
    words, linked, parents = Counter(), Counter(), {}
    path: list[int] = [0]
    total = 0
    for i in sequence:
        if i.kind == "t" and i.box not in parents and i.box:
            while path[-1] >= i.box:
                path.pop()
            parents[i.box] = path[-1]
            path.append(i.box)
        elif i.kind == "t" and i.payload[0] == "/" and i.box in path:
            del path[path.index(i.box) + (i.box == 0) :]
        if i.kind == "w" and not i.part and (n := len(i.payload.split())):
            words[i.box] += n
            linked[i.box] += n * (i.context == "@a")
            total += n * (i.context != "@a")
    for box in sorted(parents, reverse=True):  # a box has a larger number than the one around it
        words[parents[box]] += words[box]
        linked[parents[box]] += linked[box]
    found = {b for b in parents if linked[b] > LINK_SHARE * words[b] and words[b] - linked[b] <= KEEP_SHARE * total and linked[b] < words[0]}
    for b in sorted(parents):
        if parents[b] in found:
            found.add(b)
    return found


def extract(page: str | None, weights: Weights, hide: bool = False) -> str:
    """The main text. ``hide`` takes elements that mark the content for none, as weights are tested."""
    if not page:
        return ""
    sequence = list(items(page, weights.name, hide))
    hidden = hide or not any(i.kind == "t" and _inside(i.payload) for i in sequence)
    if linked := _linked(sequence):
        for i in sequence:
            i.part |= i.box in linked
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    for k, i in enumerate(sequence):
        if i.kind == "w" and i.host and not i.part and not i.payload.isspace():
            first.setdefault(i.host, k)
            last[i.host] = k
    gains = []
    for k, i in enumerate(sequence):
        if i.part and (i.kind == "w" or first.get(i.host, k) < k < last.get(i.host, k)):
            gains.append(0.0)
        else:
            gains.append(weights.tag(i.payload, i.part, hidden) if i.kind == "t" else len(i.payload.split()) * weights.word(i.context, hidden))
    start, end = best_region(gains)
    blocks: list[str] = []
    now: list[str] = []
    for i in sequence[start:end]:
        if i.kind == "w":
            if not i.part:
                now.append(i.payload)
        elif i.payload.lstrip("/").split(".")[0] not in INLINE:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    lines = (" ".join((html.unescape(b) if "&" in b else b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def train(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights from up to ``sample`` pages that label themselves."""
    chosen = pages.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample).distinct()
    rows = pages.select("page_id", "html").join(F.broadcast(chosen), "page_id").select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, outer, seen = Counter(), Counter(), Counter()
        for b in batches:
            for i in range(b.num_rows):
                got = label_page(b.column(0)[i].as_py() or "")
                if got:
                    inner.update(got[0])
                    outer.update(got[1])
                    seen.update(got[0].keys() | got[1].keys())
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([inner[k] for k in keys], pa.int64()), pa.array([outer[k] for k in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64())], names=["k", "inner", "outer", "pages"])

    found = rows.mapInArrow(count, "k string, inner long, outer long, pages long").groupBy("k").agg(F.sum("inner"), F.sum("outer"), F.sum("pages")).where(F.col("sum(pages)") >= MIN_PAGES)
    return Weights({k: (a, b, n) for k, a, b, n in found.collect()})


def extract_pages(pages: DataFrame, weights: Weights) -> DataFrame:
    """``pages`` with text; a column of that name is replaced."""
    rest = pages.drop("text")
    schema = T.StructType([*rest.schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("html")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([extract(col[i].as_py(), weights) for i in range(b.num_rows)], pa.string())], names=schema.names)

    return rest.mapInArrow(run, schema)


def op3(pages: DataFrame) -> DataFrame:
    done = extract_pages(pages.select("page_id", "url", "html"), train(pages))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
