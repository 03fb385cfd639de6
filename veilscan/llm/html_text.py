"""Main text of web pages, with site templates removed by counting.

Every container element of a page is hashed with all that it holds. Spark counts
for each host on how many different articles an element occurs; what recurs on
many of a host's articles (menus, notices, footers, share bars) is template and
is deleted with its subtree. Pages whose articles are copies or near copies of
each other count once, so an article does not become template by being copied or
changed a little. The page's article, its headings and paragraphs, and a
container that holds most of the article's text outside links are never
candidates. What tags, roles and class names say about an element is used
besides.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import keep, prepare
from veilscan.llm.hashing import U, Words, mix64

#: An element is template on a host when it is on so many articles, and either
#: on this share of the host's articles or on many of them.
MIN_ARTICLES = 4
MIN_SHARE = 0.3
MANY_ARTICLES = 50
#: Near copies agree in one of BANDS keys, each of ROWS smallest hashes of the
#: article's runs of RUN words.
BANDS, ROWS, RUN = 8, 4, 3
#: Parts that a hot key's rows are dealt to.
SALTS = 16

# Names from the HTML standard and common class names; fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe title".split())
DROPPED = frozenset(
    "script style noscript template textarea iframe title head nav footer aside form button select input svg canvas dialog object audio video".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CANDIDATES = frozenset("div section ul ol dl table aside header footer nav form figure fieldset details".split())
CLOSES_P = BLOCKS - frozenset("html body caption tbody td tfoot th thead tr".split())
CLOSES_SAME = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar toolbar".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus"
    " footer menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related share"
    " sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that say nothing of what a container holds, next to a word of NOISE.
PLACES = frozenset(
    "area bar block bottom box buttons container content form global group holder inner items left links list main outer page panel"
    " post posts primary right row secondary section site top unit wrap wrapper zone".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")


class Element:
    __slots__ = ("attributes", "inner", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.inner = tag, attributes, []


def parse(page: str) -> Element:
    """Element tree of a page; unclosed and misnested tags are put right the
    way a browser would in the common cases."""
    root = Element("html", {})
    stack, at = [root], 0
    open_tags: Counter[str] = Counter()
    while True:
        token = _TOKEN.search(page, at)
        if token is None:
            break
        if token.start() > at:
            stack[-1].inner.append(html.unescape(page[at : token.start()]))
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag or tag in ("html", "body"):
            continue
        if token[1]:
            if open_tags[tag] > 0:
                _close(stack, tag, open_tags)
            continue
        if tag in CLOSES_P or tag in CLOSES_SAME:
            _imply(stack, tag, open_tags)
        element = Element(tag, _attributes(token[3]))
        stack[-1].inner.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not token[3].endswith("/"):
            stack.append(element)
            open_tags[tag] += 1
    if at < len(page):
        stack[-1].inner.append(html.unescape(page[at:]))
    open_forms(root)
    return root


def _attributes(source: str) -> dict[str, str]:
    if not source.strip(" /"):
        return {}
    found = _ATTRIBUTE.findall(source)
    return {name.lower(): html.unescape(a or b or c) for name, a, b, c in found}


def _end(stack: list[Element], depth: int, open_tags: Counter) -> None:
    for element in stack[depth:]:
        open_tags[element.tag] -= 1
    del stack[depth:]


def _close(stack: list[Element], tag: str, open_tags: Counter) -> None:
    depth = next(d for d in range(len(stack) - 1, 0, -1) if stack[d].tag == tag)
    _end(stack, depth, open_tags)


def _imply(stack: list[Element], tag: str, open_tags: Counter) -> None:
    """End what a new ``tag`` ends: an open paragraph with all inside it, an
    open item of the same list, and the head."""
    ends = CLOSES_SAME.get(tag, ())
    for depth in range(len(stack) - 1, 0, -1):
        name = stack[depth].tag
        if name in ends or (name == "p" and tag in CLOSES_P) or (name == "head" and tag in BLOCKS):
            _end(stack, depth, open_tags)
            return
        if name in BLOCKS and name != "p":
            return


def _noise(element: Element, inside: bool) -> bool:
    """Whether names alone say that the element is not main text; ``inside``
    the article a header is part of the text."""
    tag, own = element.tag, element.attributes
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not own:
        return False
    if "hidden" in own or own.get("aria-hidden") == "true" or own.get("role", "").lower() in ROLES:
        return True
    if "display:none" in own.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("article", "main") or tag in HEADINGS:
        return False
    return any(_is_noise(name) for name in f"{own.get('class', '')} {own.get('id', '')}".lower().split())


def _is_noise(name: str) -> bool:
    """Whether a class or id names what is not main text: a word of NOISE, alone
    or joined with others of it and with PLACES only. ``has-sidebar`` and
    ``market-share`` are other names."""
    words = set(_WORDS.findall(name))
    return not words.isdisjoint(NOISE) and words <= NOISE | PLACES


def main_element(root: Element) -> Element:
    """The article: the <main> or, without one, <article> with most text (of
    nested ones the outermost); the whole page if it has neither. Containers
    that are noise are looked into only if nothing is found outside of them."""
    best: dict[str, tuple[int, Element]] = {}
    stack, aside = [root], []
    while stack or (aside and not best):
        if not stack:
            stack, aside = aside, []
        element = stack.pop()
        kind = "main" if element.attributes.get("role") == "main" else element.tag
        if kind in ("main", "article"):
            size = sum(len(b) for b in blocks(element))
            if size > best.get(kind, (-1, None))[0]:
                best[kind] = (size, element)
            continue
        for x in element.inner[::-1]:
            if isinstance(x, Element):
                (aside if _noise(x, False) else stack).append(x)
    return best.get("main", best.get("article", (0, root)))[1]


def open_forms(root: Element) -> None:
    """Forms are noise but for those around the page: one that holds the article
    or most of the text outside links becomes a plain container."""
    order = [root]
    for element in order:  # parents before children; the list grows on the way
        order += [x for x in element.inner if isinstance(x, Element)]
    if not any(x.tag == "form" for x in order):
        return
    held: dict[int, tuple[int, bool]] = {}
    for element in reversed(order):
        size = 0 if element.tag in RAW or element.tag == "a" else sum(len(_BLANK.sub(" ", x).strip()) for x in element.inner if isinstance(x, str))
        inner = [held[id(x)] for x in element.inner if isinstance(x, Element)]
        if element.tag != "a":
            size += sum(n for n, _ in inner)
        held[id(element)] = size, element.tag in ("main", "article") or any(a for _, a in inner)
    for element in order:
        size, article = held[id(element)]
        if element.tag == "form" and (article or 2 * size > held[id(root)][0]):
            element.tag = "div"


def blocks(element: Element, dropped: frozenset[int] | set[int] = frozenset(), inside: bool = True) -> list[str]:
    """Texts of the blocks in page order, white space made single spaces;
    without the elements whose id() is ``dropped``."""
    out, run = [], []

    def flush() -> None:
        text = _BLANK.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    # a None on the stack ends the block that was opened below it
    stack: list = element.inner[::-1]
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            run.append(item)
        elif item.tag == "br":
            run.append(" ")
        elif not _noise(item, inside) and id(item) not in dropped:
            if item.tag in BLOCKS:
                flush()
                stack.append(None)
            stack += item.inner[::-1]
    flush()
    return out


def candidates(root: Element, main: Element) -> list[tuple[Element, int, bool]]:
    """The containers that may be template, all but those around the article
    and those with most of its text, each with a hash of all that it holds and
    whether its text is part of the article's. Those without text are left out."""
    order, above = [root], {}
    for element in order:  # parents before children; the list grows on the way
        for item in element.inner:
            if isinstance(item, Element):
                above[id(item)] = element
                order.append(item)
    around, at = {id(main), id(root)}, main
    while (at := above.get(id(at))) is not None:
        around.add(id(at))
    inside = {id(main)}
    for element in order:
        parent = above.get(id(element))
        if parent is not None and id(parent) in inside and not _noise(element, main is not root):
            inside.add(id(element))
    marks: dict[int, bytes] = {}
    # characters of all text, and of the article's text outside links
    whole, prose = {}, {}
    for element in reversed(order):
        mark = hashlib.blake2b(f"{element.tag} {element.attributes.get('class', '')}".encode("utf-8", "surrogatepass"), digest_size=8)
        size = own = 0
        for item in element.inner:
            if isinstance(item, str):
                text = _BLANK.sub(" ", item).strip()
                mark.update(b"\0" + text.encode("utf-8", "surrogatepass"))
                size += len(text)
                own += len(text)
            else:
                mark.update(b"\1" + marks[id(item)])
                size += whole[id(item)]
                own += prose[id(item)]
        marks[id(element)] = mark.digest()
        whole[id(element)] = size
        prose[id(element)] = own if id(element) in inside and element.tag != "a" else 0
    most = prose[id(main)] / 2
    return [
        (x, int.from_bytes(marks[id(x)], "little", signed=True), id(x) in inside)
        for x in order
        if x.tag in CANDIDATES and id(x) not in around and whole[id(x)] and not prose[id(x)] > most
    ]


def near_copy_keys(texts: list[str]) -> np.ndarray:
    """BANDS keys for each text; texts with nearly the same words have one in
    common. Texts without words have the same keys."""
    words = Words(pa.array(texts, pa.large_string()), lower=True, terms=True)
    hashes = words.hashes.copy()
    last = np.zeros(len(hashes), bool)  # where a run would leave the text
    ends = words.rows[1:]
    for back in range(1, RUN):
        at = ends - back
        last[at[at >= words.rows[:-1]]] = True
    hashes[~last] = words.runs(RUN)[~last]
    full = np.flatnonzero(words.rows[1:] > words.rows[:-1])
    keys = np.zeros((len(texts), BANDS), np.uint64)
    for band in range(BANDS):
        for row in range(ROWS):
            seed = mix64(np.array([ROWS * band + row + 1], np.uint64))
            if len(full):
                least = np.minimum.reduceat(mix64(hashes ^ seed), words.rows[:-1][full])
                keys[full, band] = mix64(keys[full, band] + least)
    return keys.view(np.int64)


# --- Spark ------------------------------------------------------------------


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of ``pages``.

    text joins the blocks of the article, each with single spaces, by line
    breaks. A null or empty page and a page without an article's text give an
    empty text. Pages without a host (a null or odd url) are counted together as
    one host. Repeated rows are extracted alike. An empty table gives an empty
    result; other columns are ignored.
    """
    prepare(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract(url_col, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host")
    )
    rows = rows.withColumn("page", F.md5(F.encode("html", "UTF-8")))
    seen = rows.select("host", "page", "html").mapInArrow(
        _marked, "host string, page string, article long, mark long, inside boolean, keys array<long>"
    )
    seen = keep(seen)
    templates = site_templates(seen)
    # a mark of many pages and a page of many copies are dealt to several tasks
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    inside = seen.where("inside").select("host", "page", "mark").distinct().withColumn("salt", F.expr(f"pmod(xxhash64(page), {SALTS})"))
    marks = inside.join(templates.withColumn("salt", every), ["host", "mark", "salt"])
    marks = marks.groupBy("host", "page").agg(F.collect_list("mark").alias("marks")).withColumn("salt", every)
    salt = F.expr(f"pmod(xxhash64(page_id, url), {SALTS})")
    joined = rows.withColumn("salt", salt).join(marks, ["host", "page", "salt"], "left").select("page_id", "url", "html", "marks")
    schema = joined.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return joined.mapInArrow(_extracted, schema).toDF(id_col, url_col, "text", "n_chars")


def site_templates(seen: DataFrame) -> DataFrame:
    """(host, mark), one row for each element that recurs across a host's
    articles, near copies of one counted once."""
    groups = article_groups(seen.where("mark is null").select("host", "article", "keys").dropDuplicates(["host", "article"]))
    found = seen.select("host", "article", "mark").distinct().join(groups, ["host", "article"], "left")
    found = found.select("host", "mark", F.coalesce("first", "article").alias("article")).distinct()
    counts = keep(found.groupBy("host", "mark").agg(F.count("*").alias("articles")))
    total = counts.where("mark is null").select("host", F.col("articles").alias("total"))
    recurring = counts.where(f"mark is not null and articles >= {MIN_ARTICLES}").join(total, "host")
    return recurring.where(f"articles >= least({MIN_SHARE} * total, {MANY_ARTICLES})").select("host", "mark")


def article_groups(articles: DataFrame) -> DataFrame:
    """(host, article, first) for the articles that share a key with others:
    the smallest of these articles, the same for nearly all of a group."""
    keyed = articles.selectExpr("host", "article", "posexplode(keys) as (band, key)")
    keyed = keyed.selectExpr("host", "article", "xxhash64(host, band, key) key")
    shared = keyed.groupBy("key").agg(F.min("article").alias("first"), F.count("*").alias("members")).where("members > 1")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    dealt = keyed.withColumn("salt", F.expr(f"pmod(xxhash64(article), {SALTS})"))
    return dealt.join(shared.withColumn("salt", every), ["key", "salt"]).groupBy("host", "article").agg(F.min("first").alias("first"))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each candidate element of a page, and one without a mark that
    counts the article and holds its near-copy keys."""
    for batch in batches:
        hosts, pages, articles, marks, inside, texts, first = [], [], [], [], [], [], []
        for host, page, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            root = parse(source)
            main = main_element(root)
            text = "\n".join(blocks(main, inside=main is not root)).encode("utf-8", "replace")
            article = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)
            found = {(mark, within) for _, mark, within in candidates(root, main)}
            first.append(len(hosts))
            texts.append(text.decode())
            hosts += [host] * (len(found) + 1)
            pages += [page] * (len(found) + 1)
            articles += [article] * (len(found) + 1)
            marks += [None, *(mark for mark, _ in found)]
            inside += [False, *(within for _, within in found)]
        keys: list = [None] * len(hosts)
        for at, own in zip(first, near_copy_keys(texts).tolist(), strict=True):
            keys[at] = own
        columns = [
            pa.array(hosts, pa.string()),
            pa.array(pages, pa.string()),
            pa.array(articles, pa.int64()),
            pa.array(marks, pa.int64()),
            pa.array(inside, pa.bool_()),
            pa.array(keys, pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["host", "page", "article", "mark", "inside", "keys"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, marks in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            root = parse(page)
            main = main_element(root)
            known = set(marks or ())
            dropped = {id(element) for element, mark, _ in candidates(root, main) if mark in known} if known else set()
            texts.append("\n".join(blocks(main, dropped, inside=main is not root)).encode("utf-8", "replace").decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )
