"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged: elements with the same path of tags, classes and ids
are one node. Nodes whose presentation and content hardly differ from page to page carry
templates. What a branch declares itself to be is a prior that its importance is multiplied with; branches
whose product is low go.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spurline.llm.common import keep, slices
from spurline.llm.urls import host_of

# Elements and names that say what a branch is for.
RAW = frozenset("script style noscript template textarea title iframe object svg canvas math audio video noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input".split()
)
NOT_MAIN = frozenset("nav footer aside form head button select dialog menu datalist fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar status".split())
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner banners
    nav navbar navigation menu menus breadcrumb breadcrumbs topbar sidebar sidebars aside rail footer foot header masthead
    cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login
    share sharing social related recommended recommendations teaser teasers comment comments commentlist disqus replies reply respond
    discussion feedback reactions widget widgets toolbar pagination pager copyright legal disclaimer search tags""".split()
)
PLAIN = frozenset("article content contents body entry post story text main page prose copy section paragraph lead intro title headline heading container wrapper inner row column".split())
#: Names that also head a main text.
HEADS = frozenset(("header", "head"))
MAIN = frozenset(("article", "main"))
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
#: What the importance of a branch, 0 to 1, is multiplied with: one declared as boilerplate by its element, role, class, id or as hidden; one outside
#: the main text that the page marks; an unnamed one inside it; any other.
DECLARED, OUTSIDE, INSIDE, PLAIN_BRANCH = 0.4, 0.4, 2.0, 1.0
#: Elements nested deeper belong to the node of the element at this depth; ends that a tag implies are looked for so far up.
DEPTH, SCOPE = 64, 512
#: Pages that a worker counts together at most.
PAGES = 500
#: Elements that hold running text; in a marked main text less importance is asked of them as long as their branch has no name.
TEXT = frozenset("div p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tr td th caption figure figcaption section article main address details summary".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)


@dataclass(frozen=True)
class Settings:
    """least: importance times prior below which a branch goes. pages: a template node is on so many pages of its host,
    however many that has; a host with fewer pages takes the importance of a node from the tree of all hosts. gamma: how fast differing presentations raise importance."""

    least: float = 0.5
    pages: int = 5
    gamma: float = 0.9


@dataclass
class Block:
    """A block of text and its style node. declared: in a branch declared as boilerplate; main: in a marked main text; safe: in that, and in no named branch of it."""

    node: int
    text: str
    declared: bool
    main: bool
    safe: bool


@dataclass
class _Open:
    """An open element. held: of an inline element whose text goes, the block's text before it."""

    tag: str
    label: str
    declared: bool = False
    main: bool = False
    named: bool = False
    node: int = 0
    depth: int = 0
    children: list[str] = field(default_factory=list)
    held: list[str] | None = None


@dataclass
class Parsed:
    """blocks: in order. above: each node's parent, parents first; 0 is the page. styles: each node's presentation: its child elements in order, runs as one."""

    blocks: list[Block]
    above: dict[int, int]
    styles: dict[int, int]

    def textual(self) -> dict[int, list[int]]:
        """The nodes with text in them, each with the nodes above it, itself first."""
        found: dict[int, list[int]] = {}
        for b in self.blocks:
            way, n = [], b.node
            while n and n not in found:
                way.append(n)
                n = self.above[n]
            for k in reversed(way):
                found[k] = [k, *found.get(self.above[k], ())]
        return found


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


_nodes: dict[tuple[int, str], int] = {}


def node(parent: int, label: str) -> int:
    """The name of a style node: a hash of its parent's and its own label."""
    if len(_nodes) > 200_000:
        _nodes.clear()
    found = _nodes.get((parent, label))
    if found is None:
        found = _nodes[parent, label] = _hash(f"{parent}>{label}") or 1
    return found


#: Nodes that hold every page's text.
WHOLE = (0, node(0, "html"), node(node(0, "html"), "body"), node(0, "body"))


def _attributes(rest: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), html.unescape("".join(values)))
    return found


def _opened(tag: str, rest: str, above: _Open) -> _Open:
    at = _attributes(rest) if rest.strip() else {}
    # digits and the case of letters tell pages apart, not templates
    label = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", f"{at.get('class', '')} {at.get('id', '')}").lower()
    names, role = {w for w in re.split(r"[^a-z]+", label) if w}, at.get("role", "").lower()
    heads = HEADS if above.main or tag in MAIN else frozenset()
    hidden = "hidden" in at or at.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", at.get("style", ""), re.IGNORECASE)
    declared = above.declared or bool(names & NAMES - heads or hidden) or tag in NOT_MAIN or role in ROLES or (tag == "header" and not above.main)
    named = above.main and (above.named or tag not in TEXT or bool(names - PLAIN - heads))
    return _Open(tag, ".".join([tag, *sorted(names)]), declared, above.main or tag in MAIN or role == "main", named)


def parse(page: str | None) -> Parsed:
    """The blocks of a page with their style nodes; text of scripts, styles and the like, and of declared inline elements, is left out."""
    page, out = page or "", Parsed([], {}, {})
    stack, run, there = [_Open("", "")], [], Counter()

    def settle() -> None:
        """Ends inline elements whose text goes."""
        while stack[-1].held is not None:
            run[:] = stack.pop().held

    def flush() -> None:
        settle()
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        top = stack[-1]
        if text:
            out.blocks.append(Block(top.node, text, top.declared, top.main, top.main and not top.named))

    def close(upto: int) -> None:
        while len(stack) > upto:
            e = stack.pop()
            there[e.tag] -= 1
            out.styles[e.node] = _hash(" ".join(e.children)) if e.children else out.styles.get(e.node, 0)

    def top_down(tags: tuple[str, ...], stop: tuple[str, ...] = ()) -> int:
        """The place of the outermost open element of tags above the innermost of stop."""
        found = len(stack)
        if any(there[t] > 0 for t in tags):
            for i in range(len(stack) - 1, max(0, len(stack) - 1 - SCOPE), -1):
                if stack[i].tag in stop:
                    break
                found = i if stack[i].tag in tags else found
        return found

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        run.append(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        tag, end, rest = (m["tag"] or m["tag2"] or "").lower(), bool(m["end"] or m["end2"]), m["rest"] or ""
        if not tag:
            continue
        if tag in RAW:
            run.append(" ")
            if not end and not rest.endswith("/"):
                closing = re.compile(rf"</{tag}(?![a-z0-9])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = closing.end() if closing else len(page)
        elif tag == "hr":
            flush()
        elif tag in VOID:
            run.append(" ")
        elif tag in INLINE:
            if end and stack[-1].held is not None and stack[-1].tag == tag:
                settle()
            elif not end and rest.strip() and not stack[-1].declared and (inner := _opened(tag, rest, stack[-1])).declared:
                inner.held, inner.node, inner.depth, run = run, stack[-1].node, stack[-1].depth, []
                stack.append(inner)
        else:
            flush()
            if end:
                close(next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), len(stack)) if there[tag] > 0 else len(stack))
                continue
            if tag in CLOSES:
                close(top_down(*CLOSES[tag]))
            elif stack[-1].tag == "p":
                close(len(stack) - 1)
            top = stack[-1]
            new = _opened(tag, rest, top)
            new.depth = top.depth + 1
            new.node = node(top.node, new.label) if new.depth <= DEPTH else top.node
            if new.node != top.node:
                out.above.setdefault(new.node, top.node)
                if top.children[-1:] != [new.label]:
                    top.children.append(new.label)
            there[tag] += 1
            stack.append(new)
    flush()
    close(1)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """On how many pages of a host each node is under each above it, itself too (kind 0), has each presentation (1), and holds each text (2); node 0 is the page."""
    for part in slices(batches, "html", PAGES):
        counts = Counter()
        for host, page in zip(part.column("host").to_pylist(), part.column("html")):
            found = parse(page.as_py())
            if not found.blocks:
                continue
            textual = found.textual()
            counts[host, 0, 0, 0] += 1
            counts.update((host, 0, n, a) for n, way in textual.items() for a in way)
            counts.update((host, 1, n, found.styles[n]) for n in textual if found.styles.get(n))
            counts.update({(host, 2, b.node, _hash(b.text)) for b in found.blocks})
        columns = list(zip(*counts)) or [(), (), (), ()]
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(counts.values(), pa.int64())], ["host", "kind", "node", "feature", "n"])


def importance(counted: DataFrame, s: Settings) -> DataFrame:
    """counted: host, kind, node, feature, n (pages) of _features. Per host and node: its pages and importance.

    Importance is (1 - gamma**l) * E + gamma**l * C: l presentations with entropy E to the base of the node's pages, and
    C the mean, over the texts in the branch, of 1 minus the entropy of a text's pages, ln(pages of text) / ln(pages of its node).
    The sums need no join: they are taken of n first, and divided by the node's pages after.
    """
    n, own = F.col("n"), lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    nodes = counted.groupBy("host", "node").agg(
        own(0, F.when(F.col("node") == F.col("feature"), n)).alias("pages"), own(1, 1).alias("l"), own(1, n).alias("shown"), own(1, n * F.ln(n)).alias("shown_ln"), own(2, 1).alias("texts"), own(2, F.ln(n)).alias("texts_ln")
    )
    base = F.ln(F.greatest("pages", F.lit(2)))
    nodes = nodes.where("pages is not null").withColumns({"base": base, "h": F.col("texts_ln") / base, "e": (F.col("shown") * F.ln("pages") - F.col("shown_ln")) / F.col("pages") / base})
    ways = counted.where("kind = 0").select("host", "node", F.col("feature").alias("of"))
    branch = ways.join(nodes.where("texts > 0").select("host", "node", "h", "texts"), ["host", "node"]).groupBy("host", F.col("of").alias("node")).agg((1 - F.sum("h") / F.sum("texts")).alias("content"))
    kept = F.pow(F.lit(s.gamma), F.coalesce("l", F.lit(0)))
    found = (1 - kept) * F.coalesce("e", F.lit(0.0)) + kept * F.col("content")
    return nodes.join(branch, ["host", "node"]).select("host", "node", "pages", F.when(F.col("pages") < 2, 1.0).otherwise(found).alias("importance"))


def count_features(pages: DataFrame) -> DataFrame:
    """pages: host, html. The rows of _features over all of them: a grouped aggregation of hashes; texts don't move."""
    kinds = "host string, kind int, node long, feature long, n long"
    return pages.select("host", "html").mapInArrow(_features, kinds).groupBy("host", "kind", "node", "feature").agg(F.sum("n").alias("n"))


def noisy_nodes(pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """host, node, importance: the nodes of low importance of each host of pages (host, html)."""
    counted = keep(count_features(pages))
    everywhere = counted.groupBy("kind", "node", "feature").agg(F.sum("n").alias("n")).withColumn("host", F.lit(""))
    own, joint = importance(counted, s), importance(everywhere, s)
    sizes = counted.where("kind = 0 and node = 0").select("host", F.col("n").alias("size"))
    # importances above may matter only where a prior lets them
    low = max([s.least, *(x for p in (DECLARED, OUTSIDE) if (x := s.least / p) <= 1)])
    joint = joint.select("node", F.col("importance").alias("joint"), (F.col("pages") >= s.pages).alias("common"))
    enough = F.col("pages") >= s.pages
    noisy = F.when(enough, F.col("importance") < low).otherwise((F.col("size") < s.pages) & F.col("common") & (F.col("joint") < low))
    found = own.join(sizes, "host").join(joint, "node").where(noisy).where(~F.col("node").isin(*WHOLE))
    return found.select("host", "node", F.when(enough, F.col("importance")).otherwise(F.col("joint")).alias("importance"))


def _listed(noisy: DataFrame, key: str) -> DataFrame:
    return noisy.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("node", "importance"))).alias("nodes"))


def _nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page and node of its blocks: row, host, node."""
    for batch in batches:
        found = [list(parse(page.as_py()).textual()) for page in batch.column("html")]
        at = pa.array([i for i, nodes in enumerate(found) for _ in nodes], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("row").take(at), batch.column("host").take(at), pa.array([n for nodes in found for n in nodes], pa.int64())], ["row", "host", "node"])


def _found_by_shuffling(rows: DataFrame, noisy: DataFrame) -> DataFrame:
    """Adds nodes to rows: the noisy ones that each page itself has."""
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    on_page = numbered.select("row", "host", "html").mapInArrow(_nodes_of, "row long, host string, node long").join(noisy, ["host", "node"])
    return numbered.join(_listed(on_page, "row"), "row", "left")


def main_text(page: str | None, noisy: Mapping[int, float], s: Settings = Settings()) -> tuple[str, int]:
    """The blocks of a page whose branch's importance times prior is high enough, and the number of blocks that the tree finds unimportant without any prior.

    noisy: nodes and their importance; that of others is 1, that of a branch the least of its nodes. Pages that are copies of each other make all their nodes noisy; of
    a marked main text without any other block the unnamed branches stay.
    """
    found, low = parse(page), {0: 1.0}
    for n, parent in found.above.items():
        low[n] = min(noisy.get(n, 1.0), low[parent])
    marked = any(b.main and not b.declared for b in found.blocks)
    kept = []
    for b in found.blocks:
        prior = DECLARED if b.declared else OUTSIDE if marked and not b.main else INSIDE if b.safe else PLAIN_BRANCH
        if low[b.node] * prior >= s.least:
            kept.append(b)
    text = "\n".join(b.text for b in kept or (b for b in found.blocks if b.safe and not b.declared))
    return text, sum(low[b.node] < s.least for b in found.blocks)


def extract(pages: DataFrame, s: Settings = Settings(), sent_bytes: int = 32 << 20, host_bytes: int = 64 << 10) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text: the main text, blocks joined by line breaks, and n_noisy: blocks whose branch alone is of low importance.

    Every block's branch has an importance by its host's style tree, declared boilerplate and what is outside a marked main text (article, main)
    too. It is multiplied with a prior: low for branches declared as menus, headers, footers, sidebars, notices, adverts, forms or comments (elements,
    roles, classes, ids, hidden) and for all outside a marked main text, high for text elements without a name of their own in that. Branches
    whose product is under s.least go; at the least of 0.5 a prior of 0.4 decides alone. Text of scripts, styles, and the like is none. Character references are decoded, white space in a block becomes one space.
    Null, empty and textless pages give an empty text. Null urls and urls without a host are one host; ids may repeat. Work and memory are linear in a
    page's length: elements nested over 64 deep share a node.

    The noisy nodes of hosts are sent to all executors if those of a host take at most host_bytes and all together sent_bytes. Those of other hosts
    are joined, by shuffling, with the nodes of each page, which are numbered: pages with such hosts are to be read from files.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html", PAGES):
            found = [main_text(p.as_py(), dict(n.as_py() or ()), s) for p, n in zip(part.column("html"), part.column("nodes"))]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["page_id", "url", "text", "n_noisy"]
            )

    noisy = keep(noisy_nodes(rows, s))
    hosts = keep(noisy.groupBy("host").agg((F.count(F.lit(1)) * 32).alias("bytes")))
    few = F.col("bytes") <= host_bytes
    sent, wide = hosts.agg(F.sum(F.when(few, F.col("bytes") + 64).otherwise(64)), F.count_if(~few)).first()
    if (sent or 0) > sent_bytes:
        joined = _found_by_shuffling(rows, noisy)
    else:
        of_host = _listed(noisy.join(F.broadcast(hosts.where(few)), "host", "left_semi"), "host")
        joined = rows.join(F.broadcast(of_host), "host", "left")
        if wide:
            many = F.broadcast(hosts.where(~few))
            of_many = _found_by_shuffling(rows.join(many, "host", "left_semi"), noisy)
            joined = joined.join(many, "host", "left_anti").select(*rows.columns, "nodes").unionByName(of_many.select(*rows.columns, "nodes"))
    return joined.select("page_id", "url", "html", "nodes").mapInArrow(run, "page_id long, url string, text string, n_noisy long")
