"""Main text of web pages by paths that the pages of a host agree on.

Each page's containers are scored by the text of their paragraphs. The best one votes
for its generalised path (tags, ids and classes from the body down, without
digits). The winning paths of a host are then read out of all its pages. The host also says
which paths are often there without being the best of their page: those are extras, however
much they hold on one page.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import blocks as B
from docloom.llm.urls import host_and_path
from docloom.session import materialise

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?][^>]*>|<[A-Za-z/!?][^<>]*\Z""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article main div section td body blockquote center".split())
#: Elements that never hold main text.
DROPPED = frozenset(
    "head script style title textarea noscript iframe noembed noframes xmp template svg canvas object audio video nav footer aside button select "
    "option input label fieldset menu dialog".split()
)
#: Noise like a name is, as some pages are one form from end to end.
WRAPPING = frozenset(("form",))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Parts of class names and ids of elements that hold no main text.
NOISE = frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar sidebars widget widgets rail "
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promoted promotion banner banners "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay paywall "
    "newsletter subscribe subscription signup login register share sharing social comment comments commentlist respond reply replies "
    "discussion disqus reviews feedback guestbook kommentar kommentare commentaire commentaires comentario comentarios reacties related recommended recommendations pagination pager toolbar search searchbox form forms hidden".split()
)
NOT_NOISE = frozenset("has with without no is not".split())
#: An element that is noise by its name only is kept if it has more than this share of the
#: page's unlinked text; one with a name of text by others only if nothing is outside of it,
#: and one with a name of noise words alone never.
MOST = 0.5
BY_OTHERS = frozenset(
    "comment comments commentlist respond reply replies discussion disqus reviews feedback guestbook kommentar kommentare commentaire commentaires "
    "comentario comentarios reacties related recommended recommendations".split()
)
#: An element of these opens anew where one is still open, up to the element in the second place.
IMPLIED = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
PATHS = 3
#: A path whose container scores less than this share of the page's own best is not followed, unless
#: the path is named and that best one is an extra.
SMALL = 0.25
#: A voted path is an extra if it was the best of less than this share of the pages that have it.
SELDOM = 0.5
#: So many voted paths of a host are told apart in that way.
KNOWN_PATHS = 50


class Node(NamedTuple):
    tag: str
    parent: int
    #: What this element adds to its path, and the whole path as a number.
    label: str
    key: int
    #: 0: plain tags only, 1: some class or id, 2: an article or main.
    says: int
    dropped: bool
    #: Innermost element around (or this) that is noise by its class or id only, or 0.
    named: int = 0
    share: float = 0.0


class Block(NamedTuple):
    node: int
    text: str
    linked: int


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):  # of an attribute that is given twice the first counts
        found.setdefault(m[1].lower(), html.unescape((m[2] or "").strip("\"'")))
    return found


@lru_cache(maxsize=1 << 16)
def _step(label: str) -> int:
    return int.from_bytes(hashlib.blake2b(label.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little")


def _longer(key: int, label: str) -> int:
    """Number of the path that goes one label on."""
    return ((key ^ _step(label)) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 61) + 1


def path_of(nodes: list[Node], at: int) -> str:
    labels = []
    while at > 0:
        labels.append(nodes[at].label)
        at = nodes[at].parent
    return "".join(reversed(labels))


def _label(tag: str, attributes: dict[str, str]) -> str:
    if not attributes:
        return tag
    name = attributes.get("id", "").split()[:1]
    classes = sorted(set(attributes.get("class", "").split()))
    return tag + re.sub(r"\d+", "0", "".join(f"#{x}" for x in name) + "".join(f".{x}" for x in classes))


def _hidden(attributes: dict[str, str]) -> bool:
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").lower() in ROLES:
        return True
    return "none" in attributes.get("style", "") and bool(re.search(r"display\s*:\s*none", attributes["style"], re.I))


def _noise(attributes: dict[str, str]) -> float:
    """The share of a page's text above which its class names and ids are no noise: 0 for
    any, 1 for nothing less than all of it, 2 for none."""
    share = 0.0
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        pieces = {x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if x}
        if NOT_NOISE.isdisjoint(pieces) and (words := NOISE & pieces):
            share = max(share, 2.0 if words == pieces else MOST if words.isdisjoint(BY_OTHERS) else 1.0)
    return share


def _weights(nodes: list[Node], blocks: list[Block]) -> list[int]:
    """Unlinked characters in every element, with all below it."""
    held = [0] * len(nodes)
    for block in blocks:
        held[block.node] += max(0, len(block.text) - block.linked)
    for at in range(len(nodes) - 1, 0, -1):
        held[nodes[at].parent] += held[at]
    return held


def _without_noise(nodes: list[Node], blocks: list[Block]) -> list[Block]:
    """Blocks outside elements that are noise by their names. A name of an element that
    holds most of the page's unlinked text, where no article or main is outside of all such
    elements, says how the page is laid out; so does that of one with the page's only main,
    or else only article."""
    if not any(nodes[b.node].named for b in blocks):
        return blocks
    held = _weights(nodes, blocks)
    aims = {tag: [k for k, n in enumerate(nodes) if n.tag == tag and held[k] and n.named != k] for tag in ("main", "article")}
    kept = set()
    only = aims["main"] or aims["article"]
    for at in only if len(only) == 1 else ():
        while at > 0:
            kept.add(at)
            at = nodes[at].parent
    outside = any(not nodes[at].named for x in aims.values() for at in x)
    noise = [False] * len(nodes)
    for k, node in enumerate(nodes):
        if node.named:
            poor = outside or held[k] <= node.share * held[0] - (node.share == 1)
            noise[k] = noise[node.parent] or node.named == k and k not in kept and poor
    return [b for b in blocks if not noise[b.node]]


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """Elements and text blocks of a page, in page order.

    Never fails: unknown or unclosed tags are taken as they come, a tag cut off at the
    end is dropped.
    """
    nodes = [Node("", -1, "", 0, 0, False)]
    blocks: list[Block] = []
    stack = [0]
    held: list[str] = []
    linked = links = 0
    place = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                blocks.append(Block(next(i for i in reversed(stack) if nodes[i].tag in BLOCK or not i), text, linked))
            held.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not nodes[stack[-1]].dropped:
            text = html.unescape(text)  # piece by piece: a tag ends a reference
            held.append(text)
            linked += len(text) if links else 0

    def close(depth: int) -> None:
        """Close open elements until so many are left."""
        nonlocal links
        closed = [nodes[i].tag for i in stack[depth:]]
        if not BLOCK.isdisjoint(closed):
            flush()
        links -= closed.count("a")
        del stack[depth:]

    def nearest(tags, within=()) -> int:
        """Depth of the innermost open element of these, or 0."""
        for depth in range(len(stack) - 1, 0, -1):
            if nodes[stack[depth]].tag in tags:
                return depth
            if nodes[stack[depth]].tag in within:
                return 0
        return 0

    while found := TOKEN.search(page, place):
        add(page[place : found.start()])
        place = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:
            if tag in BLOCK and (depth := nearest((tag,))):
                close(depth)
            elif tag == "br":
                add(" ")
            elif depth := nearest((tag,), CONTAINERS):
                close(depth)
            continue
        text = found[3] if found[2] else found[6]
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, place)
            place = page.find(">", end.start()) + 1 or len(page) if end else len(page)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                add(" ")
            continue
        if tag in BLOCK:
            if depth := nearest(("p",), CONTAINERS | {"li", "td", "th", "dd"}):
                close(depth)
            if tag in IMPLIED and (depth := nearest((tag,) if tag not in ("dt", "dd", "td", "th") else ("dt", "dd") if tag[0] == "d" else ("td", "th"), IMPLIED[tag])):
                close(depth)
            if tag in HEADINGS and (depth := nearest(HEADINGS, BLOCK - HEADINGS)):
                close(depth)
            flush()
        attributes = _attributes(text) if text.strip("/ \n\t") else {}
        if tag == "a":
            if "href" not in attributes:  # a place to jump to, which is often never closed
                continue
            if depth := nearest(("a",), BLOCK):  # links do not nest
                close(depth)
        parent = stack[-1]
        layout = tag in ("html", "body", "article", "main") or not attributes
        noise = 0.0 if layout else _noise(attributes)
        if tag in WRAPPING:
            noise = max(noise, MOST)
        # inline elements are parts of a block and wrap no layout; those of a page's own making may
        wraps = tag in BLOCK or "-" in tag
        dropped = nodes[parent].dropped or tag in DROPPED or (not layout and _hidden(attributes)) or (bool(noise) and not wraps)
        if tag == "header" and not nearest(("article",)):
            dropped = True
        label, key, says = "", nodes[parent].key, nodes[parent].says
        if tag in BLOCK and tag not in ("html", "body"):
            label = f">{_label(tag, attributes)}"
            key, says = _longer(key, label), max(says, 2 if tag in ("article", "main") else int(len(label) > len(tag) + 1))
        if not text.endswith("/") or tag in BLOCK:
            nodes.append(Node(tag, parent, label, key, says, dropped, len(nodes) if noise else nodes[parent].named, noise))
            stack.append(len(nodes) - 1)
            links += tag == "a"
    add(page[place:])
    flush()
    return nodes, _without_noise(nodes, blocks)


def container_scores(nodes: list[Node], blocks: list[Block]) -> dict[int, float]:
    """Scores of all containers with text.

    A block's characters outside links count fully for every container up to the
    innermost article (or else main) around it, and half for each one further out. Where
    there is neither, they lose a fifth with each step out, so that a container with
    several parts wins over its largest part.
    """
    aims = [-1] * len(nodes)
    for k, node in enumerate(nodes):
        above = aims[node.parent] if node.parent >= 0 else -1
        if node.tag == "article" or node.tag == "main" and (above < 0 or nodes[above].tag == "main"):
            above = k
        aims[k] = above
    if not any(len(b.text) > b.linked for b in blocks):  # a page of links only
        blocks = [b._replace(linked=0) for b in blocks]
    # what elements hold, from the innermost out: text without an article or main around it,
    # text inside of its own one, and text that has left it
    free, inside, left = ([0.0] * len(nodes) for _ in range(3))
    for block in blocks:
        (inside if aims[block.node] >= 0 else free)[block.node] += max(0, len(block.text) - block.linked)
    scores: dict[int, float] = {}
    for at in range(len(nodes) - 1, -1, -1):
        a, b, c = free[at], inside[at], left[at]
        if not a + b + c:
            continue
        if nodes[at].tag in CONTAINERS or at == 0:
            scores[at] = a + b + c
            a, c = 0.8 * a, 0.5 * c
            if at == aims[at]:
                b, c = 0.0, c + 0.5 * b
        above = nodes[at].parent
        if above >= 0:
            free[above] += a
            inside[above] += b
            left[above] += c
    return scores


def _best(scores: dict[int, float], among=None) -> int:
    """The container with the highest score, or -1. Of equals the outer one wins."""
    return min(scores if among is None else among, key=lambda n: (-scores[n], n), default=-1)


def best_container(nodes: list[Node], blocks: list[Block]) -> int:
    return _best(container_scores(nodes, blocks))


def chosen_container(nodes: list[Node], blocks: list[Block], paths: list[int], extras: frozenset[int] = frozenset()) -> int:
    """The container at the first of the paths that the page has and that is good for it,
    or else the page's own best, or -1."""
    scores = container_scores(nodes, blocks)
    own = _best(scores)
    if own < 0:
        return -1
    for path in paths:
        at = _best(scores, [n for n in scores if nodes[n].key == path])
        if at < 0:
            continue
        weak = nodes[at].says < 2 <= nodes[own].says or not nodes[at].says or nodes[own].key not in extras
        if not (weak and scores[at] < SMALL * scores[own]):
            return at
    return own


def text_in(nodes: list[Node], blocks: list[Block], container: int) -> str:
    inside = [False] * len(nodes)
    for k in range(container, len(nodes)):
        inside[k] = k == container or (nodes[k].parent >= container and inside[nodes[k].parent])
    return " ".join(b.text for b in blocks if inside[b.node])


def _votes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """How often each path of a host is there in the batch, and how often it is the best of its page."""
    there, best_of, names = Counter(), Counter(), {}
    for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
        nodes, blocks = parse(page.as_py() or "")
        scores = container_scores(nodes, blocks)
        there.update((host, key) for key in {nodes[n].key for n in scores})
        if scores:
            best = _best(scores)
            best_of[host, nodes[best].key] += 1
            names[host, nodes[best].key] = path_of(nodes, best)
    keys = list(there)
    columns = [[h for h, _ in keys], [k for _, k in keys], [names.get(k) for k in keys], [best_of[k] for k in keys], [there[k] for k in keys]]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "key", "path", "votes", "there"])


def extract_pages(pages: DataFrame, html_column: str = "html", url: str = "url", paths: int = PATHS) -> DataFrame:
    """Main text of every page: adds ``text`` (empty if there is none) and ``path``, the
    path it was read from; the raw html is left out, equal names are replaced, all other columns stay as they are.

    Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and
    styles are left out by their tags, roles, classes and ids; a form or a name around most of the page is its layout. Character references are
    decoded, white space in a block becomes one space, blocks are joined by one. A host's
    ``paths`` most voted paths are tried in turn; a page that has none of them (or whose host
    has none) gives its own best container. So does a page where the path holds less than a quarter of that
    one's score, unless the path has a class or id (and is not outside of the page's article or main) and the best one is an extra of the host: a
    path that is the best of less than half of the pages that have it. Ties between paths go to the first by name.

    NULL and empty pages give an empty text; a NULL address belongs to the host "".
    Every row is treated by itself, so repeated rows give the same text (and vote each). Pages of any length and depth are parsed whole, in
    time and memory that grow with the page. An empty table gives an empty table.
    """
    schema = B.added(pages.drop(html_column).schema, ("text", T.StringType()), ("path", T.StringType()))
    names = schema.fieldNames()
    host = host_and_path(F.col(url))[0]
    # names of our own on the way, so that no column of the pages can clash
    carried = [c for c in names if c not in ("text", "path")]
    given = pages.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carried)], host.alias("host"), F.col(html_column).alias("html"))

    votes = given.select("host", "html").mapInArrow(lambda batches: map(_votes, batches), "host string, key long, path string, votes long, there long")
    counted = votes.groupBy("host", "key").agg(F.min("path").alias("path"), F.sum("votes").alias("votes"), F.sum("there").alias("there")).where("votes > 0")
    order = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    ranked = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(paths, KNOWN_PATHS))
    tried = F.array_sort(F.collect_list(F.when(F.col("rank") <= paths, F.struct("rank", "key"))))
    extras = F.collect_list(F.when(F.col("votes") < SELDOM * F.col("there"), F.col("key")))
    winners = ranked.groupBy("host").agg(F.transform(tried, lambda x: x["key"]).alias("tried"), extras.alias("extras"))
    winners = materialise(winners.withColumnRenamed("host", "its_host"), "paths")

    def extract(batches):
        for batch in batches:
            texts, used = [], []
            for page, tried, extras in zip(batch.column("html"), batch.column("tried"), batch.column("extras"), strict=True):
                nodes, blocks = parse(page.as_py() or "")
                best = chosen_container(nodes, blocks, tried.as_py() or [], frozenset(extras.as_py() or ()))
                texts.append(text_in(nodes, blocks, best) if best >= 0 else "")
                used.append(path_of(nodes, best) if best >= 0 else None)
            found = {"text": pa.array(texts, pa.string()), "path": pa.array(used, pa.string())}
            columns = [found[n] if n in found else batch.column(f"c{carried.index(n)}") for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return given.join(winners, F.col("host") == F.col("its_host"), "left").mapInArrow(extract, schema)
