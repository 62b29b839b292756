"""Main text of web pages: page structure, and the difference to the page with the nearest URL on the same host."""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import zip_longest
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise

#: Elements whose content is never text of the page, up to their end tag, whatever it holds.
_RAW = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "object", "xmp", "noembed", "noframes")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORDS = re.compile(r"[a-z]+")
#: Elements that begin a new line of the page.
_BLOCK = frozenset("address article aside blockquote body br button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul video audio".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold an article's text.
_CHROME = frozenset("nav aside footer form head menu dialog button select fieldset".split())
_MAIN = frozenset(("article", "main"))
#: Words of a class, id or role that mark what is not the article.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "newsletter subscribe subscription signup login sidebar widget widgets comment comments commentlist disqus discussion reply replies respond related recommended breadcrumb breadcrumbs "
    "share sharing social nav navbar navigation menu menubar footer masthead topbar toolbar pagination pager popup modal overlay paywall complementary contentinfo search searchbox skip".split()
)
_BESIDE = frozenset(("has", "with", "without", "no", "layout", "wrapper"))
#: Words that say nothing by themselves, beside which a mark holds within an article too: ``ad-box``, but not ``search-note``.
_PLAIN = frozenset(
    "box block area container wrapper section list item items bar icon icons button buttons link links post posts article articles content inner outer left right top bottom site page form "
    "header title text body count thread message slot unit label top up js the new row col column group panel card main meta info here and by a of".split()
)
#: Neighbours on either side that are looked at, pages that a bucket is to hold, and the share of a page's characters that makes two pages copies.
NEAR, TOGETHER, COPY = 4, 64, 0.9
#: Neighbours that a line of an article needs against it, all that there are, and the share of an article that makes a neighbour a reprint of it.
AGAINST, REPRINT = 3, 0.5
#: End tags that are left out: what a start tag closes.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_PARAGRAPH_ENDS = _BLOCK - {"br", "body", "html", "button", "canvas", "option", "select", "legend", "summary", "td", "th", "li", "dd", "dt"}


@dataclass
class Line:
    """A block's text, whether chrome surrounds it, whether an article does, and whether a name in the article may mark it as none of it."""

    text: str
    chrome: bool
    main: bool
    doubt: bool = False


@dataclass
class _Open:
    name: str
    chrome: bool
    main: bool
    inline: bool
    doubt: bool


@dataclass
class Page:
    page_id: int | None
    url: str | None
    lines: list[Line] = field(default_factory=list)

    @cached_property
    def has_main(self) -> bool:
        return any(x.main and not x.chrome for x in self.lines)

    @cached_property
    def texts(self) -> frozenset[str]:
        return frozenset(x.text for x in self.lines)

    @cached_property
    def places(self) -> frozenset[tuple[str, int]]:
        """The article's lines, each with its place from the article's beginning and from its end."""
        own = [x.text for x in self.lines if x.main and not x.chrome]
        return frozenset(found for i, x in enumerate(own) for found in ((x, i), (x, i - len(own))))


def _names_chrome(name: str, inside: bool) -> bool:
    """Whether one class, id or role says that the element is no article; ``has-sidebar`` only says what is beside it.

    Outside an article any mark will do. Inside, all other words must be plain ones, or text would go for the sake of a word.
    """
    words = _WORDS.findall(name)
    return not _MARKS.isdisjoint(words) and _BESIDE.isdisjoint(words) and (not inside or all(w in _MARKS or w in _PLAIN for w in words))


def _may_be_chrome(attributes: str) -> bool:
    """Whether a class, id or role has a mark beside words that are not plain, of which structure alone can't tell what they mean."""
    names = (name for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id", "role") for name in (m[2] or m[3] or m[4] or "").lower().split())
    return any(_names_chrome(name, False) for name in names)


def _marked(name: str, attributes: str, inside: bool) -> bool:
    if not attributes or name in ("html", "body") or name in _MAIN:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role") and any(_names_chrome(name, inside) for name in value.lower().split()):
            return True
        if key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|/|$)", re.sub(r"=\s*(?:\"[^\"]*\"|'[^']*'|\S+)", "", attributes), re.IGNORECASE))


def parse(source: str) -> list[Line]:
    """A page's lines in order, one for each run of text between block boundaries, white space turned to single spaces.

    What an inline element holds that is no article's text is left out of its line.
    """
    lines: list[Line] = []
    stack: list[_Open] = []
    opened: Counter[str] = Counter()  # names on the stack
    text: list[str] = []
    beside = 0  # open inline elements that are no article's text

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined:
                lines.append(Line(joined, any(o.chrome and not o.inline for o in stack), any(o.main for o in stack), any(o.doubt for o in stack)))

    def close(names: tuple[str, ...], stop: frozenset[str]) -> None:
        nonlocal beside
        if not any(opened[n] for n in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name in names:
                for o in stack[i:]:
                    opened[o.name] -= 1
                    beside -= o.chrome and o.inline
                del stack[i:]
                return
            if stack[i].name in stop:
                return

    def say(piece: str) -> None:
        if not beside:
            text.append(piece)

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            say(source[at:])
            break
        if m.start() > at:
            say(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if not closing and name in _RAW:
            stop = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(source, at)
            at = stop.end() if stop else end
            continue
        if name in _BLOCK:
            flush()
        if closing:
            close((name,), frozenset())
            continue
        if name in _VOID or m[3].rstrip().endswith("/"):
            continue
        if name in _PARAGRAPH_ENDS:
            close(("p",), frozenset(("article", "main", "section", "div", "td", "th", "li", "table", "button", "blockquote")))
        if name in _CLOSES:
            close(_CLOSES[name], frozenset(("ul", "ol", "dl", "table", "select", "article", "main", "div")))
        main = name in _MAIN
        inside = any(o.main for o in stack)
        chrome = name in _CHROME or name == "header" and not inside or _marked(name, m[3], inside)
        inline = name not in _BLOCK
        # An inline element matters if it is no article's text, or if its end tag could be taken for that of one that is none.
        if not inline or chrome or opened[name]:
            doubt = inside and not inline and not main and not chrome and _may_be_chrome(m[3])
            stack.append(_Open(name, chrome, main, inline, doubt))
            opened[name] += 1
            beside += chrome and inline
    flush()
    return lines


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Lines the other page lacks cannot be part of it and are set aside. The rest is solved a machine word of columns at
    a time: row by row, the bits that are 0 mark where the length of the best match grows; walking back through the
    kept rows finds the lines.
    """
    shared = set(a) & set(b)
    places = [i for i, x in enumerate(a) if x in shared]
    other = [x for x in b if x in shared]
    if not places or not other:
        return set()
    at: dict[str, int] = {}
    for j, x in enumerate(other):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(other)) - 1
    rows, v = [], full
    for i in places:
        u = v & at[a[i]]
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    found, j = set(), len(other)
    length = lambda r, j: j - (r & ((1 << j) - 1)).bit_count()
    for k in range(len(places) - 1, -1, -1):
        above = rows[k - 1] if k else full
        while j and length(rows[k], j) == length(rows[k], j - 1):
            j -= 1
        if not j:
            break
        if length(above, j) < length(rows[k], j):
            found.add(places[k])
            j -= 1
    return found


def _path(url: str | None) -> tuple[str, list[str]]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").removeprefix("www."), [x for x in parts.path.split("/") if x]
    except ValueError:
        return "", []


def _share(page: Page, other: Page) -> float:
    """Share of what a page says, menus aside, that stands on another page too."""
    mine = [x.text for x in page.lines if not x.chrome] or [x.text for x in page.lines]
    return sum(len(x) for x in mine if x in other.texts) / max(sum(map(len, mine)), 1)


def _copies(page: Page, other: Page) -> bool:
    """Whether two pages share nearly all they say: a repeated or reprinted page is no witness to a template."""
    return not page.lines or _share(page, other) >= COPY


def _witnesses(page: Page, others: list[Page]) -> list[Page]:
    """Of neighbours in URL order on the same host, nearest first by order, those that are no copies, the longest common path first."""
    host, path = _path(page.url)
    if not host:
        return []

    def common(other: Page) -> int:
        theirs = _path(other.url)[1]
        return next((i for i, (x, y) in enumerate(zip(path, theirs, strict=False)) if x != y), min(len(path), len(theirs)))

    fit = sorted((o for o in others if _path(o.url)[0] == host), key=common, reverse=True)
    out: list[Page] = []
    for o in fit:
        if not _copies(page, o) and not any(_copies(o, w) for w in out):
            out.append(o)
    return out


def _against(page: Page, witnesses: tuple[Page, ...], shared: set[int]) -> set[int]:
    """Of the lines that a page shares with the nearest one, those that are template although an article vouches for them.

    Sites reprint articles and quote the same sentences, so more is asked than of other lines: at least ``AGAINST`` neighbours
    whose articles are no reprints, all of which have the line in the same place, in an unbroken run up to the article's
    end or down from its beginning, whose first line, the title, may differ; so bylines and notices stand. Where a name in the
    article may mark the line as none of it, it is enough that the two nearest pages have it.
    """
    own = [i for i, x in enumerate(page.lines) if x.main and not x.chrome]
    if shared.isdisjoint(own):
        return set()
    found = {i for i in own if i in shared and page.lines[i].doubt and all(page.lines[i].text in w.texts for w in witnesses[:2])}
    fit = [w for w in witnesses if w.has_main and _share(page, w) < REPRINT]
    if len(fit) < AGAINST:
        return found
    for places in (range(len(own)), range(-1, -len(own) - 1, -1)):
        for k in places:
            i = own[k]
            if i in shared and all((page.lines[i].text, k) in w.places for w in fit):
                found.add(i)
            elif k:
                break
    return found


def main_text(page: Page, *witnesses: Page) -> tuple[str, int, int]:
    """The page's main text, the number of its lines that the nearest page shares, and how many of those were deleted.

    Lines in chrome are no text of an article. Of the others, those in a common subsequence with the nearest page are template
    and go; if there is a second witness, it has to hold them too, so that a sentence that two pages quote stays. An article
    element vouches for the lines in it, which go only on the evidence of :func:`_against`. On a page with such an element, only
    what is in it counts.
    """
    mine = [x.text for x in page.lines]
    shared = common_lines(mine, [x.text for x in witnesses[0].lines]) if witnesses else set()
    has_main = page.has_main
    if has_main:
        template = _against(page, witnesses, shared)
    else:
        template = {i for i in shared if all(mine[i] in w.texts for w in witnesses[1:2])}
    kept, deleted = [], 0
    for i, x in enumerate(page.lines):
        vouched = x.main and not x.chrome
        if i in template:
            deleted += 1
        elif vouched or not has_main and not x.chrome:
            kept.append(x.text)
    return " ".join(kept), len(shared), deleted


_OUT = "page_id long, url string, text string, n_shared int, n_deleted int"


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in order of bucket and URL; as many in hand as there can be neighbours on either side."""
    held: deque[Page] = deque()
    turn, bucket = 0, None  # the place in hand of the page whose turn it is
    rows: list[tuple] = []

    def settle() -> None:
        nonlocal turn
        page = held[turn]
        before, after = list(held)[max(0, turn - NEAR) : turn][::-1], list(held)[turn + 1 : turn + 1 + NEAR]
        others = [p for pair in zip_longest(before, after) for p in pair if p is not None]
        rows.append((page.page_id, page.url, *main_text(page, *_witnesses(page, others))))
        turn += 1
        if turn > NEAR:
            held.popleft()
            turn -= 1

    for batch in batches:
        for page_id, url, source, key in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
            if key != bucket:
                while turn < len(held):
                    settle()
                held.clear()
                turn, bucket = 0, key
            held.append(Page(page_id, url, parse(source or "")))
            if len(held) - turn > NEAR:
                settle()
        if len(rows) > 500:
            yield _batch(rows)
            rows.clear()
    while turn < len(held):
        settle()
    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    columns = zip(*rows, strict=True) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "url", "text", "n_shared", "n_deleted"])


def extract(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """``page_id, url, text, n_shared, n_deleted`` for every row of ``pages``.

    Pages are dealt to buckets by their URL, and the neighbours of a page are those before and after it in its bucket, in
    order of path. A host of few pages is one bucket; of a larger one, whole directories go to each bucket, and the pages of
    a large directory, which are equally near to each other, are dealt by their hash. So no host is too large for a
    task, and the text does not depend on the number of partitions.

    Args:
        pages: needs ``page_id`` (whole numbers), ``url`` and ``html``; other columns are ignored.
        parts: partitions; the session's number of shuffle partitions unless given.

    Defined cases: a null or empty page has empty text. A page without a host in its URL, or alone on its host, has no
    neighbour, and only structure decides; the same goes for pages all of whose neighbours are copies. Repeated rows each
    give a row. Markup that is never closed is text of the element it is in; a comment, script or style that is never
    closed hides the rest. Texts of any length are kept whole. An empty table gives an empty result.
    """
    parts = parts or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.xxhash64(host).alias("_host"), (host == "").alias("_none"), path.alias("_path"))
    named = named.withColumn("_dir", F.xxhash64("_host", F.regexp_extract("_path", r"^(.*)/[^/]+/?$", 1)))
    dirs = materialise(named.groupBy("_host", "_dir").agg(F.count(F.lit(1)).alias("n")), "url-paths")
    total = dirs.agg(F.sum("n")).first()[0] or 0
    most = max(TOGETHER, total // 100_000)
    # Whoever holds more than ``most`` pages: 100,000 rows of two numbers at most, so they can be sent everywhere.
    times = F.ceil(F.col("n") / most).cast("int")
    hosts = dirs.groupBy("_host").agg(F.sum("n").alias("n")).filter(F.col("n") > most).select("_host", times.alias("_hosts"))
    large = dirs.filter(F.col("n") > most).select("_dir", times.alias("_dirs"))
    page = F.xxhash64("_path", "url", "page_id")
    bucket = (
        F.when(F.col("_none"), F.xxhash64(F.lit("none"), page))
        .when(F.col("_dirs").isNotNull(), F.xxhash64("_dir", F.pmod(page, "_dirs")))
        .when(F.col("_hosts").isNotNull(), F.xxhash64("_host", F.pmod("_dir", "_hosts")))
        .otherwise(F.col("_host"))
    )
    dealt = named.join(F.broadcast(hosts), "_host", "left").join(F.broadcast(large), "_dir", "left")
    keyed = dealt.select("page_id", "url", "html", bucket.alias("_bucket"), "_path")
    return keyed.repartition(parts, "_bucket").sortWithinPartitions("_bucket", "_path", "url", "page_id").mapInArrow(_difference, _OUT)
