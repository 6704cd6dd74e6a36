"""Main text of HTML pages: structure first, a host's suffix array for what structure doesn't tell.

Method. A tolerant tokenizer cuts a page into blocks and tells each block's zone from the elements around it: *out* (nav, header, footer, aside,
forms, scripts, elements whose class, id or role says advert, notice, comments and the like), *main* (article, main or an element
named so), or *open*. A page with main blocks has its text in them, in page order.

Pages without any are judged by their host: the open blocks of all its pages are token streams, and what stands in a long substring
that recurs on distinct pages is boilerplate. A host's suffix array finds such substrings as runs of neighbours whose common
prefix has `depth` tokens or more. Cut at that depth the array needs no order inside a run: suffixes are dealt by host and by
their first `depth` tokens, a run is one key, and pages are counted per key, pre-aggregated. A run on `min_pages` or more distinct
pages covers its tokens on each of them; covered tokens go and the unique runs of each block stay. A host of any size is spread over all
workers, since its suffixes are dealt by what they start with.

Copies are no distinct pages: for a run, a page is told by its longest block but for the one that the run's middle stands in (by its whole
text, if no other has `MARGIN` tokens), and never by its URL. So an article under many URLs, or with small differences in shorter blocks, doesn't
cover itself. A covered part with `MARGIN` or more uncovered tokens before and after it in its block is a passage quoted in prose, and
stays; so does one of `PROSE` tokens or more inside a block that is more than half of its page, a copy with other short blocks.
Not told from boilerplate: passages that fill or border a block on `min_pages` different pages. Not told from own text: what stands on
fewer pages, recurring blocks of fewer than `depth` tokens between blocks that don't recur, and two recurring blocks on pages without a
longer one of their own.

Text: character references are decoded, white space (any that Unicode knows) becomes one space inside a block, ends are trimmed, blocks
are joined by one line break in page order.

Cases: null or empty html gives an empty text; pages without markup are one open block; unclosed and stray tags are tolerated: a head needs no
end; noscript, svg, select and the like, title, textarea and iframe without an end stop at the next structural tag, script and style at the next section;
copies are counted as one page and extracted each; a null url is the empty host; further columns are ignored.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.common import Scratch, ship, utf8

DEPTH, MIN_PAGES, MARGIN, PROSE = 8, 3, 8, 50

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
_SKIPPED = frozenset("noscript template svg object select canvas audio video datalist".split())
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in "script style textarea title iframe".split()}
_SECTIONS = "html head body article main section header footer nav aside".split()
_STRUCTURAL = frozenset([*_SECTIONS, *"div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th form fieldset blockquote pre figure details address center hr".split()])
_SECTION_TAG = re.compile(rf"</?(?:{'|'.join(_SECTIONS)})(?=[\s/>])", re.I)  # code may hold others in its strings
_ANY_TAG = re.compile(rf"</?(?:{'|'.join(sorted(_STRUCTURAL))}|script|style|meta|link|base|title|noscript|template)(?=[\s/>])", re.I)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|\Z))""", re.I)
_INLINE = frozenset("a abbr math mi mn mo mrow ms mspace mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle semantics acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LOOSE = frozenset("p li dt dd tr td th option".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
_OUT = frozenset("nav header footer aside form menu dialog button fieldset script style noscript".split())
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|nav|navbar|navigation|menus?|topbar|header|masthead|footer|sidebar|widgets?|share|sharing|social|related|recommended"
    r"|comments?|commentlist|reply|replies|respond|disqus|breadcrumbs?|pagination|pager|popup|modal|overlay|newsletter|subscribe|signup|login|toolbar|copyright|search|tablist|contentinfo|complementary)(?=$|[\s_-])",
    re.I,
)
#: Names that tell of a part around the text where they stand alone, but are given to articles and to parts of them too.
_WEAK = re.compile(r"(?:^|[\s_-])(?:header|masthead|search|share|sharing|social|related|recommended|alert|notices?|widgets?|banner|promo\w*|login|signup)(?=$|[\s_-])", re.I)
#: Heads of articles, as class names have them.
_HEAD = re.compile(r"(?:^|\s)(?:entry|post|article|page|content|story|section)[_-]+header(?=$|\s)", re.I)
_ADVERT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|comments?|share|sharing|social)(?=$|[\s_-])", re.I)
_MAIN = re.compile(r"(?:^|\s)(?:article|articlebody|article-body|article-content|main|main-content|content|post|post-content|post-body|entry|entry-content|story|story-body)(?=$|\s)", re.I)


def _named(value: str, element: str, inside: set[str]) -> bool:
    """Does a class, id or role say that an element is none of the text?"""
    if element in _INLINE:  # parts of sentences: only what was put in between
        return bool(_ADVERT.search(value))
    value = _HEAD.sub(" ", value)
    if element in ("article", "main") or _MAIN.search(value):
        value = _WEAK.sub(" ", value)
    elif inside & {"article", "main"}:
        value = re.sub(r"(?:^|[\s_-])header(?=$|[\s_-])", " ", value, flags=re.I)
    return bool(_NAMED.search(value))


def tokens(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, element, is it an end tag, attributes) of a page's tags, without those in raw text and in skipped elements, which are one token each
    without an element; a skipped element that isn't closed comes as its start tag."""
    found: list[tuple[int, int, str, bool, str]] = []
    unclosed: set[str] = set()
    at = 0
    while m := _TOKEN.search(page, at):
        at, name = m.end(), (m[2] or m[5] or "").lower()
        closing = bool(m[1] or m[4])
        if name in _RAW:
            if not closing:
                end = None if name in unclosed else _RAW[name].search(page, at)
                if not end:
                    unclosed.add(name)
                    end = (_SECTION_TAG if name in ("script", "style") else _ANY_TAG).search(page, at)
                    at = end.start() if end else len(page)
                else:
                    at = end.end()
            name = ""
        found.append((m.start(), at, name, closing, m[3] or m[6] or ""))
    opened: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    for k, (_, _, name, closing, attributes) in enumerate(found):
        if name in _SKIPPED:
            if not closing:
                if not (name == "svg" and attributes.rstrip().endswith("/")):
                    opened.setdefault(name, []).append(k)
            elif opened.get(name):
                ends[opened[name].pop()] = k
    if not ends:
        return found
    out, k = [], 0
    while k < len(found):
        last = ends.get(k)
        out.append(found[k] if last is None else (found[k][0], found[last][1], "", False, ""))
        k = k + 1 if last is None else last + 1
    return out


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of a page's blocks; zone is out, article, main or open."""
    found: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # element, and out, article, main or nothing
    text: list[str] = []
    cuts: list[int] = []  # where in `text` inline elements begin that are out
    at = 0

    def flush():
        if cuts:
            del text[min(cuts) :]
            cuts[:] = [0] * len(cuts)
        if text:
            words = html.unescape("".join(text)).split()
            text.clear()
            if words:
                kinds = {k for _, k in stack}
                found.append((next((k for k in ("out", "article", "main") if k in kinds), "open"), " ".join(words)))

    skipping = False  # in an element that isn't closed: up to the next structural tag
    for start, end, name, closing, attributes in tokens(page):
        if not skipping:
            text.append(page[at:start])
        at = end
        if not name:
            if page.startswith("<!", start) and not page.startswith("<!--", start):
                flush()
            continue
        if name in _SKIPPED:
            skipping |= not closing and not (name == "svg" and attributes.rstrip().endswith("/"))
            continue
        if skipping and name not in _STRUCTURAL:
            continue
        skipping = False
        if name == "head":  # what may stand in it has no text; all else belongs to the body, whether it's closed or not
            flush()
            continue
        if name in _INLINE:
            if name in ("br", "wbr", "img"):
                text.append(" " if name == "br" else "")
                continue
        else:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name in _INLINE and any(e not in _INLINE for e, _ in stack[k + 1 :]):
                        break  # a stray end inside another element
                    for e, zone in reversed(stack[k:]):
                        if zone == "inline out":
                            del text[min(cuts.pop(), len(text)) :]
                        elif zone and e not in _INLINE:
                            flush()
                    del stack[k:]
                    break
                if name in _LOOSE and stack[k][0] not in _LOOSE and stack[k][0] not in _INLINE:
                    break
            continue
        if name in _VOID or attributes.rstrip().endswith("/"):
            continue
        kind = ""
        inside = {k for _, k in stack}
        if name in _OUT:
            kind = "out"
            if name == "header" and "article" in inside:
                kind = ""
        elif name in ("article", "main"):
            kind = name
            stack[:] = [(e, "") if e == "form" and k == "out" else (e, k) for e, k in stack]  # a form around the whole page
        if attributes:
            for a in _ATTRIBUTE.finditer(attributes):
                key, value = a[1].lower(), (a[2] or "").strip("\"'")
                if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    kind = "out"
                elif key in ("class", "id", "role") and name not in ("body", "html") and _named(value, name, inside):
                    kind = "out"
                elif not kind and key != "style" and name not in _INLINE and _MAIN.search(value):
                    kind = "main"
        if name not in _INLINE:
            while stack and (stack[-1][0] in _INLINE or stack[-1][0] in _CLOSES.get(name, ()) or stack[-1][0] == "p"):
                if stack.pop()[1] == "inline out":  # elements left open end with the next block
                    cuts.pop()
        elif kind == "out":
            kind = "inline out"
            cuts.append(len(text))
        if kind or name not in _INLINE:
            stack.append((name, kind))
    if not skipping:
        text.append(page[at:])
    flush()
    return found


def zoned(page: str) -> tuple[str, bool]:
    """The text of a page and whether it's still to be judged by its host."""
    found = blocks(page)
    if all(z == "out" for z, _ in found) and re.search(r"<form\b", page, re.I):  # the whole page may be one form
        found = blocks(re.sub(r"</?form\b[^>]*>", " ", page, flags=re.I))
    if main := [t for z, t in found if z in ("article", "main")]:
        return "\n".join(main), False
    return "\n".join(t for z, t in found if z == "open"), True


def suffix_keys(host: str, text: str, depth: int) -> list[int]:
    """For each place in the token stream with `depth` tokens from it on: a hash of the host and of those tokens."""
    from xxhash import xxh3_64_intdigest

    words = text.split()
    return [xxh3_64_intdigest("\n".join((host, *words[i : i + depth]))) - (1 << 63) for i in range(len(words) - depth + 1)]


def rest_keys(text: str, depth: int, margin: int = MARGIN) -> list[int]:
    """For each place with `depth` tokens from it on: what tells the page, a hash of its longest block but for the one that their middle stands
    in, or of the text, if that block is short."""
    from xxhash import xxh3_64_intdigest

    lines = text.split("\n")
    sizes = [line.count(" ") + 1 for line in lines]
    block = [k for k, n in enumerate(sizes) for _ in range(n)]
    first, *second = sorted(range(len(lines)), key=lambda k: (-sizes[k], lines[k]))[:2]
    longest, other = (xxh3_64_intdigest(lines[k] if sizes[k] >= margin else text) - (1 << 63) for k in (first, *(second or [first])))  # an only block is the text
    return [other if first in (block[i + (depth - 1) // 2], block[i + depth // 2]) else longest for i in range(len(block) - depth + 1)]


def unique_runs(text: str, host: str, depth: int, repeated: set[int], margin: int = MARGIN, prose: int = PROSE) -> str:
    """The text without the tokens that repeated substrings cover, but for passages quoted inside a block, and blocks that are most of the page."""
    hits = [i for i, k in enumerate(suffix_keys(host, text, depth)) if k in repeated]
    if not hits:
        return text
    lines = [line.split() for line in text.split("\n")]
    total = sum(map(len, lines))

    def cover(hits):
        covered = bytearray(total)
        for i in hits:
            covered[i : i + depth] = b"\1" * depth
        return covered

    covered, at = cover(hits), 0
    stay = bytearray(total)
    for line in lines:
        end, own, i = at + len(line), len(line) - sum(covered[at : at + len(line)]), at
        before = 0
        while i < end:
            j = i
            while j < end and covered[j] == covered[i]:
                j += 1
            if not covered[i]:
                before += j - i
            elif j - i >= max(prose, total // 2 + 1) or min(before, own - before) >= margin:
                stay[i:j] = b"\1" * (j - i)
            i = j
        at = end
    if any(stay):
        covered = cover(i for i in hits if not any(stay[i : i + depth]))
    out, at = [], 0
    for line in lines:
        if kept := [w for w, c in zip(line, covered[at : at + len(line)], strict=True) if not c]:
            out.append(" ".join(kept))
        at += len(line)
    return "\n".join(out)


def _host(url: str) -> str:
    m = re.match(r"[^:]*://([^/?#]*)", url)
    return m[1].lower() if m else ""


def extracted(pages: DataFrame, depth: int = DEPTH, min_pages: int = MIN_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars."""
    ship(pages.sparkSession)
    scratch = Scratch(pages.sparkSession, "html")
    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("open", T.BooleanType()), T.StructField("row", T.LongType())])

    def structure(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                got = [zoned(str(raw, "utf-8", "replace")) for raw in utf8(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([t for t, _ in got], pa.string()), pa.array([o for _, o in got], pa.bool_()), pa.array(range(row, row + len(got)), pa.int64())], names=schema.names)
                row += len(got)

    def suffixes(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 64):
                rows, keys, page = [], [], []
                part = b.slice(i, 64)
                for row, url, text in zip(part.column(0).to_pylist(), utf8(part.column(1)), utf8(part.column(2)), strict=True):
                    url, text = str(url, "utf-8"), str(text, "utf-8")
                    own = dict(zip(suffix_keys(_host(url), text, depth), rest_keys(text, depth), strict=True))
                    rows += [row] * len(own)
                    page += own.values()
                    keys += own
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(keys, pa.int64()), pa.array(page, pa.int64())], names=["row", "key", "page"])

    def cleaned(batches):
        import pyarrow as pa

        for b in batches:
            texts = [unique_runs(str(t, "utf-8"), _host(str(u, "utf-8")), depth, set(k or ())) for u, t, k in zip(utf8(b.column(1)), utf8(b.column(2)), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    told = scratch.table(pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html")).mapInArrow(structure, schema), "structure")
    done = told.where("NOT open").select("id", "url", "text")
    judged = told.where("open AND text != ''")
    if not judged.isEmpty():
        array = judged.select("row", "url", "text").mapInArrow(suffixes, "row long, key long, page long")
        runs = array.groupBy("key", "page").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("key")
        covered = array.join(runs, "key").groupBy("row").agg(F.collect_set("key").alias("keys"))  # as many as the page has tokens
        rest = judged.join(covered, "row", "left").select("id", "url", "text", "keys").mapInArrow(cleaned, T.StructType(schema.fields[:3]))
        done = done.union(rest).union(told.where("open AND text = ''").select("id", "url", "text"))
    else:
        done = done.union(told.where("open").select("id", "url", "text"))
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
