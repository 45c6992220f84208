"""Operator 7: main text of web pages by site style trees.

Each page is read into blocks of text, each with its style path: the block elements above it, with their first class.
Merging the paths of all pages of a host gives the host's style tree; merging all hosts' trees gives one more. A node's
content importance is 1 less the mean entropy of its texts over the pages that have it (a text on every page: 0; a text
of one page: 1). Its presentation importance joins the entropy of its styles over those pages (child elements and size;
the nearest ancestors' count as well, for less the farther) and the share of a page's text that it holds. What a host's few
pages say is drawn towards the tree of all hosts, and what few pages say at all towards a neutral value, by weights
that grow with the pages; no number of pages is treated apart.

A block's importance is its node's, and a term for what its elements are called: an article's are worth more; those of
menus, footers, asides, forms, adverts and notices less, and readers' comments least, since no entropy tells them from an
article's text. A name counts from the element that has it down to the next that has one, which outweighs it; words
inside longer names count little. A boilerplate class, or a form, that holds over half of a page's text says less the more
it holds, and nothing of a whole page; an aside whose class names no boilerplate counts half. Blocks of low importance, and so branches that have no others, are cut from the page.

Only counts are shuffled for the trees; pages' paths meet the importance of theirs by a join on (host, path), and each
page gets the list of its own paths to cut. No group is larger than a page. A host that holds a large share of all pages
is one key of that join: its side of one row a path is small, and Spark splits the pages' side or broadcasts.

Defined results: null or empty html gives an empty text; very long pages are read whole, in one row; a block whose importance equals
the bound stays; malformed and cut-off html is read as far as it goes; pages
without a host form one site; repeated rows give one row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Weights: of content in a node's importance, of a name; the importance that stays; pages' weight against the wider
#: tree's; what is assumed of content and style before any page; what an ancestor's style is worth by its distance.
CONTENT, NAMED, LOW, DRAWN, NEUTRAL_CONTENT, NEUTRAL_STYLE, FADE = 0.4, 0.4, 0.55, 20, 0.7, 0.5, 0.7
#: What names are worth: an article's; boilerplate's; comments'; words that fit articles; a word inside a longer name;
#: and the share of the outer name's worth that an inner name leaves.
ARTICLE, BOILERPLATE, COMMENT, FITTING, INSIDE, LEFT = 1.7, -1.0, -2.5, 0.4, -0.2, 0.3

#: Elements that start and end a block of text; elements whose content is no text of the page; elements,
#: and words of classes, ids and roles, of boilerplate, of comments and of the main text; words that say nothing beside these.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
SILENT = frozenset("head script style noscript template iframe object svg canvas audio video title textarea select button".split())
RAW = frozenset("script style textarea title noscript iframe".split())
PLAIN = frozenset("nav footer aside form menu dialog button".split())
WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs consent cookie cookies footer gdpr masthead menu menus modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promotion related share sharing sidebar sidebars skip social sponsor sponsored subscribe subscription toolbar widget widgets contentinfo complementary search".split())
TALK = frozenset("comment comments disqus discussion replies reply respond response responses".split())
FIT = frozenset("article articles body content entry post story text".split())
EMPTY = frozenset("area bar block box container global group inner item items left link links list main outer page panel primary right row secondary section site top bottom wrap wrapper".split())
MAIN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Za-z]+")


def _worth(element: str, names: list[str], outer: float, share: float) -> float:
    """What a block inside this element is called, given what it is called outside and the element's share of the page's text."""
    fades = min(1.0, 2 * (1 - share))
    own = ARTICLE if element in MAIN else BOILERPLATE * (fades if element == "form" else 1.0) if element in PLAIN or element == "header" and outer <= 0 else 0.0
    talk = plain = fits = inside = False
    for name in names:
        words = set(_WORD.findall(name.lower()))
        rest = words - WORDS - TALK - EMPTY
        if element == "header" and outer > 0:
            words.discard("header")
        if words & TALK and not rest - WORDS:
            talk = True
        elif (words & WORDS or "header" in words) and not rest - {"header"}:
            plain = True
        elif words & (WORDS | TALK):
            inside = True
        elif words & FIT and not words - FIT - EMPTY or words == {"main"}:
            fits = True
    if element == "aside" and names and not (talk or plain or inside):
        own /= 2
    own += COMMENT * talk + BOILERPLATE * fades * plain + FITTING * (fits and not plain and not talk)
    weak = INSIDE * inside
    return (own + LEFT * outer if abs(own) > FITTING else own + outer) + weak


def blocks_of(page: str | None) -> tuple[list[tuple[str, str, float]], dict[str, list[str]]]:
    """(path, text, worth of names) of each block of text in order, and the child elements of each path's nodes, in words."""
    out: list[tuple[str, str, int]] = []
    children: dict[str, list[str]] = {}
    opened: list[tuple[int, str, list[str]]] = [(0, "", [])]  # the element around each, its element, its names
    size: list[int] = [0]
    stack: list[tuple[str, str, int, bool]] = [("", "", 0, False)]  # element, path, number, silent
    parts: list[str] = []
    page = page or ""

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            _, path, number, silent = stack[-1]
            if text and not silent:
                out.append((path, text, number))
                size[number] += len(text)

    at = 0
    while True:
        m = _MARKUP.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        parts.append(page[at : m.start()])
        at = m.end()
        closes, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if not m[0].endswith(">"):
            break  # a tag that the end of the page cut off
        if closes:
            if name == "p" or name in BLOCK or name in SILENT:
                flush()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>|\Z", re.I).search(page, at)
            at = end.end()
            continue
        if name not in BLOCK and name not in SILENT:
            continue
        flush()
        if name == "hr" or name in VOID:
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or name in BLOCK:
            _close(stack, name)
        names: list[str] = []
        first = ""
        for kind, *values in _NAMED.findall(rest):
            value = next((v for v in values if v), "")
            names += value.split()
            if kind.lower() == "class" and value.split():
                first = "." + value.split()[0].replace("/", "|")
        _, path, number, silent = stack[-1]
        children.setdefault(path, []).append(name + first)
        stack.append((name, f"{path}/{name}{first}", len(opened), silent or name in SILENT))
        opened.append((number, name, names))
        size.append(0)
    flush()
    for k in range(len(opened) - 1, 0, -1):
        size[opened[k][0]] += size[k]
    worth = [0.0]
    for (around, name, names), held in zip(opened[1:], size[1:], strict=True):
        worth.append(_worth(name, names, worth[around], held / max(size[0], 1)))
    return [(path, text, worth[number]) for path, text, number in out], children


#: Which open elements a start tag ends, and where the search for them stops.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


def _close(stack: list, name: str) -> None:
    if stack[-1][0] == "p":
        stack.pop()
    if name in _ENDS:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in _WALLS[name]:
                return
            if stack[k][0] in _ENDS[name]:
                del stack[k:]
                if name != "tr":
                    return


def _host(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].partition(":")[0].lower() if m else ""


_PAGE = "row bigint, page_id {}, url string, host string, nodes array<struct<path:string,style:bigint,share:double,texts:array<struct<seq:int,text:string,worth:double>>>>"
_TEXT = pa.struct([("seq", pa.int32()), ("text", pa.string()), ("worth", pa.float64())])
_NODES = pa.list_(pa.struct([("path", pa.string()), ("style", pa.int64()), ("share", pa.float64()), ("texts", pa.list_(_TEXT))]))


def nodes_of(page: str | None) -> list[dict]:
    """The style nodes of a page: path, style (a hash of child elements and size), share of the page's text, blocks."""
    found, children = blocks_of(page)
    by: dict[str, list] = {path: [] for path in children}
    for seq, (path, text, worth) in enumerate(found):
        by.setdefault(path, []).append({"seq": seq, "text": text, "worth": worth})
    whole = sum(len(text) for _, text, _ in found)
    out = []
    for path, texts in by.items():
        size = sum(len(x["text"]) for x in texts)
        looks = f"{' '.join(children.get(path, ()))} {size.bit_length()}".encode()
        out.append({"path": path, "style": int.from_bytes(hashlib.blake2b(looks, digest_size=8).digest(), "little", signed=True), "share": size / max(whole, 1), "texts": texts})
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            hosts = [_host(url) for url in part.column(2).to_pylist()]
            pages = [nodes_of(page) for page in part.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(hosts, pa.string()), pa.array(pages, _NODES)], names=["row", "page_id", "url", "host", "nodes"])


def read_pages(pages: DataFrame) -> DataFrame:
    kind = dict(pages.dtypes)["page_id"]
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", F.col("url").cast("string").alias("url"), "html")
    return stored(rows.mapInArrow(_read, _PAGE.format(kind)), "pages")


def _drawn(pages: Column, value: Column, to: Column) -> Column:
    """`value`, of so many pages, drawn to the wider tree's; one page has no entropy and no say."""
    return ((pages - 1) * F.when(pages > 1, value).otherwise(0.0) + DRAWN * to) / (pages - 1 + DRAWN)


def importance(rows: DataFrame) -> DataFrame:
    """host, path, pages, importance of every node that holds text; `rows` has a row a page and path: host, path, style, share, texts."""
    at = ["host", "path"]
    pages = rows.groupBy(*at).agg(F.count("*").alias("m"), F.sum("share").alias("share"))
    texts = rows.select(*at, F.explode(F.array_distinct(F.transform("texts", lambda x: F.xxhash64(x["text"])))).alias("text")).groupBy(*at, "text").agg(F.count("*").alias("n"))
    styles = rows.groupBy(*at, "style").agg(F.count("*").alias("n"))
    n_log_n = F.sum(F.col("n") * F.ln("n"))

    def tree(keys: list[str], pages: DataFrame, texts: DataFrame, styles: DataFrame) -> DataFrame:
        # sums of n log n give both entropies, given each node's number of pages
        both = pages.join(texts.groupBy(*keys).agg((n_log_n / F.sum("n")).alias("t")), keys, "left").join(styles.groupBy(*keys).agg((n_log_n / F.sum("n")).alias("s")), keys)
        return both.select(*keys, "m", "share", (1 - F.col("t") / F.ln("m")).alias("content"), (1 - F.col("s") / F.ln("m")).alias("style"))

    wide = lambda df, key, n: df.groupBy("path", *key).agg(*[F.sum(c).alias(c) for c in n])
    all_ = tree(["path"], wide(pages, [], ["m", "share"]), wide(texts, ["text"], ["n"]), wide(styles, ["style"], ["n"]))
    m = F.col("m")
    all_ = all_.select("path", *[_drawn(m, F.col(c), F.lit(v)).alias(f"all_{c}") for c, v in (("content", NEUTRAL_CONTENT), ("style", NEUTRAL_STYLE))])
    own = tree(at, pages, texts, styles).join(all_, "path")
    own = stored(own.select(*at, "m", (F.col("share") / m).alias("share"), _drawn(m, F.coalesce("content", "all_content"), F.col("all_content")).alias("content"), _drawn(m, F.col("style"), F.col("all_style")).alias("style")), "tree")
    # a node's own style and those of the elements above it, but for the page's
    steps = F.split("path", "/")
    parts = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(F.array_join(F.slice(steps, 1, k), "/").alias("above"), F.pow(F.lit(FADE), (F.size(steps) - k).cast("double")).alias("worth")))
    up = own.where("share > 0").select(*at, F.explode(parts).alias("x")).select(*at, "x.above", "x.worth").where("not rlike(above, '(^|/)(html|body)([.][^/]*)?$') and above <> ''")
    above = own.select("host", F.col("path").alias("above"), F.col("style").alias("s"))
    looks = up.join(above, ["host", "above"]).groupBy(*at).agg(F.max(F.col("s") * F.col("worth")).alias("looks"))
    joined = own.where("share > 0").join(looks, at, "left")
    style = 1 - (1 - F.coalesce("looks", F.lit(0.0))) * (1 - F.col("share"))
    return joined.select(*at, m.alias("pages"), (CONTENT * F.col("content") + (1 - CONTENT) * style).alias("importance"))


def main_text(pages: DataFrame, low: float = LOW) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (columns page_id, url and html)."""
    read = read_pages(pages)
    rows = read.select("row", "host", F.explode("nodes").alias("x")).select("row", "host", "x.path", "x.style", "x.share", "x.texts")
    found = stored(importance(rows.drop("row")), "importance")
    least = rows.where(F.size("texts") > 0).select("row", "host", "path", F.array_min(F.transform("texts", lambda x: x["worth"])).alias("worth"))
    poor = least.join(found, ["host", "path"]).where(F.col("importance") + NAMED * F.col("worth") < low)
    # written, so that Spark knows its size: pages are only shuffled where it is too large to broadcast
    cut = stored(poor.groupBy("row").agg(F.collect_list(F.struct("path", "importance")).alias("cut")), "cut")
    judged = read.join(cut, "row", "left")

    def kept(node: Column) -> Column:
        mine = F.get(F.filter("cut", lambda c: c["path"] == node["path"]), 0)["importance"]
        return F.filter(node["texts"], lambda x: mine.isNull() | (mine + NAMED * x["worth"] >= low))

    texts = F.flatten(F.transform("nodes", kept))
    text = F.array_join(F.transform(F.array_sort(texts), lambda x: x["text"]), "\n\n")
    return judged.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("bigint"))
