"""How the sources of a language differ in their words: byte tries counted by partition, merged by prefix range."""

from __future__ import annotations

import gc
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spurline.llm.common import SENT_ROWS, cut, keep, segments, slices, written

#: Counters that are held before they are given away as tries, rows of an output batch.
COUNTERS, ROWS = 1_000_000, 8_192
#: Terms of a chunk and sources of a block that are compared at a time.
CHUNK, BLOCK = 512, 256
#: Letters, ASCII ones as lower case, and bytes of other characters stay, all else ends a term.
_LETTERS = bytes(c | 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


class Trie:
    """A radix trie of byte strings: an edge holds as many bytes as no other string leaves it; a node has counters by source, each a source with its occurrences and documents."""

    __slots__ = ("label", "children", "counts")

    def __init__(self, label: bytes = b"") -> None:
        self.label, self.children, self.counts = label, [], []

    @classmethod
    def of(cls, terms: Iterable[tuple[bytes, list[tuple[str, int, int]]]]) -> Trie:
        """The trie of distinct terms in the order of their bytes, each with its counters; only the path to the last term is looked at for the next."""
        root = cls()
        path, ends, last = [root], [0], b""
        for term, counts in terms:
            same, most = 0, min(len(term), len(last))
            while same < most and term[same] == last[same]:
                same += 1
            while ends[-1] > same:
                node, end = path.pop(), ends.pop()
                if ends[-1] < same:
                    # the edge to the node is cut where the term leaves it
                    upper = cls(node.label[: same - ends[-1]])
                    node.label = node.label[same - ends[-1] :]
                    upper.children.append(node)
                    path[-1].children[-1] = upper
                    path.append(upper)
                    ends.append(same)
            if same == len(term):
                path[-1].counts = counts
            else:
                node = cls(term[same:])
                node.counts = counts
                path[-1].children.append(node)
                path.append(node)
                ends.append(len(term))
            last = term
        return root

    def ordered(self) -> Iterator[tuple[bytes, list[tuple[str, int, int]]]]:
        """All terms with counters, in the order of their bytes."""
        open_ = [(b"", self)]
        while open_:
            before, node = open_.pop()
            term = before + node.label
            if node.counts:
                yield term, node.counts
            open_ += [(term, child) for child in reversed(node.children)]


class Counts:
    """Occurrences and documents of the terms of one source of a language."""

    def __init__(self) -> None:
        self.n: Counter[bytes] = Counter()
        self.docs: Counter[bytes] = Counter()

    def add(self, text: bytes) -> int:
        """Counts the terms of a whole text, a piece at a time, and says how many are new."""
        before, found = len(self.n), set()
        for piece in cut(text.translate(_LETTERS)):
            self.n.update(piece)
            found.update(piece)
        self.docs.update(found)
        return len(self.n) - before


def trie_of(sources: dict[str, Counts]) -> Trie:
    """The counts of the sources of a language as one trie. Its root counts nothing but names all sources."""
    leaves: dict[bytes, list[tuple[str, int, int]]] = {b"": [(source, 0, 0) for source in sources]}
    for source, c in sources.items():
        docs = c.docs
        for term, n in c.n.items():
            leaf = (source, n, docs[term])
            if term in leaves:
                leaves[term].append(leaf)
            else:
                leaves[term] = [leaf]
    return Trie.of((term, leaves[term]) for term in sorted(leaves))


def _given(counts: dict[str, dict[str, Counts]]) -> Iterator[pa.RecordBatch]:
    gc.disable()  # many small objects and no cycles
    try:
        for lang, sources in counts.items():
            leaves = trie_of(sources).ordered()
            while rows := list(islice(leaves, ROWS)):
                ends = pa.array(np.cumsum([0, *(len(c) for _, c in rows)]), pa.int32())
                source, n, docs = (list(x) for x in zip(*(leaf for _, c in rows for leaf in c)))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((source, pa.string()), (n, pa.int64()), (docs, pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array([t for t, _ in rows], pa.binary()).cast(pa.string()), *lists], ["lang", "term", "source", "n", "docs"])
    finally:
        gc.enable()


def _counted(counters: int):
    """Rows (lang, source, text), none null: the tries of the languages, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[str, Counts]] = {}
        size = 0
        for part in slices(batches, "text", 2_000):
            for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), part.column("text").cast(pa.binary())):
                sources = counts.setdefault(lang, {})
                if source not in sources:
                    sources[source] = Counts()
                size += sources[source].add(text.as_py())
            if size > counters:
                yield from _given(counts)
                counts, size = {}, 0
        yield from _given(counts)

    return run


def _sent(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= SENT_ROWS else small


def share(count: Column, total: Column, n_terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 n_terms)), exact for all counts of 64 bits."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    scaled = wide(F.lit(1_000_000_000), 10) * wide(count + 5, 20)
    return F.call_function("div", scaled, wide(total + 5 * n_terms, 20)) + 1


def _distances(size: int):
    """Sorted rows (lang, chunk, a, b, term, place, p): of a block of terms the shares of all sources of two blocks, those of terms that a source hasn't as term null. Sums of absolute differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in segments(batches, ["lang", "chunk", "a", "b"]):
            lang, a, b = (block.column(c)[0].as_py() for c in ("lang", "a", "b"))
            place, p = block.column("place").to_numpy(), block.column("p").to_numpy()
            of = block.column("term").dictionary_encode().indices
            at, rest = of.fill_null(-1).to_numpy(zero_copy_only=False), np.asarray(of.is_null())
            named = np.unique(place[rest])
            dense = np.empty((int(at.max()) + 1, len(named)), dtype=np.int64)
            dense[:] = p[rest][np.argsort(place[rest], kind="stable")]
            dense[at[~rest], np.searchsorted(named, place[~rest])] = p[~rest]
            left, right = np.flatnonzero(named // size == a), np.flatnonzero(named // size == b)
            for i in left:
                others = right[right > i] if a == b else right
                if len(others):
                    total = np.abs(dense[:, others] - dense[:, i : i + 1]).sum(axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(others), pa.string()), pa.array(np.full(len(others), named[i])), pa.array(named[others]), pa.array(total)], ["lang", "i", "j", "value"])

    return run


def audit(docs: DataFrame, least_docs: int = 30, most: int = 50, counters: int = COUNTERS, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """docs: text, lang, source; null counts as ''. Per row: lang, source, part, item, value, rank.

    A term is a run of ASCII letters, lower-cased, and of characters beyond ASCII; a language keeps those in at least least_docs of its documents. A source gives a term the share
    p = 1 + floor(10^9 (count + 5) / (N + 5 V)). Part `pair`: for each other source of the language the sum of absolute differences of shares over all kept terms, all of them
    ranked. Part `term`: the kept terms which the source has and gives more than the whole language does, by how much, the first `most` of them. Ranks by value, descending, then by item in the
    order of its bytes.

    Each task makes radix tries of what it counts, one a language, with counters by source at the leaves, and gives them away in byte order when there are `counters` counters, so its memory is bounded
    whatever the words. The tries are dealt by ranges of (lang, term), that is by prefix, and equal leaves add up there. Of the kept leaves chunks of terms are compared for blocks of sources, so that no task holds all
    terms or all pairs; what is absent has the share of count 0. All is exact integers.

    Repeated rows and ids count as rows; a source without terms is a source, with a single source there are no pairs, and without kept terms all pairs are at 0. An empty table gives no row. Long texts are cut into
    terms a piece at a time. Other columns are ignored.
    """
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    parts = written(docs.select(lang, source, text).mapInArrow(_counted(counters), "lang string, term string, source array<string>, n array<long>, docs array<long>"))
    leaf = F.explode(F.arrays_zip("source", "n", "docs")).alias("leaf")
    leaves = parts.where("term <> ''").repartitionByRange("lang", "term").select("lang", "term", leaf).groupBy("lang", "term", F.col("leaf.source").alias("source"))
    leaves = leaves.agg(F.sum("leaf.n").alias("n"), F.sum("leaf.docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = keep(leaves.withColumns({"docs": F.sum("docs").over(of_term), "all": F.sum("n").over(of_term)}).where(F.col("docs") >= least_docs).select("lang", "term", "source", "n", "all"))

    named = parts.where("term = ''").select("lang", F.explode("source").alias("source")).distinct()
    whole = kept.groupBy("lang").agg(F.count_distinct("term").alias("terms"), F.sum("n").alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    placed = named.join(sums, ["lang", "source"], "left").join(whole, "lang", "left").select("lang", "source", *map(zero, ("total", "terms", "lang_total")))
    groups = keep(placed.withColumns({
        "place": (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long"), "sources": F.count(F.lit(1)).over(Window.partitionBy("lang")),
        "chunks": F.greatest(F.lit(1), F.ceil(F.col("terms") / chunk)), "rest": F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(0),
    }))

    cells = kept.join(_sent(groups), ["lang", "source"]).withColumns({"p": share(F.col("n"), F.col("total"), F.col("terms")), "q": share(F.col("all"), F.col("lang_total"), F.col("terms"))})
    cells = keep(cells.select("lang", "source", "term", "place", "sources", "chunks", "p", "q", "n"))
    top = cells.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    own, dealt_to = (F.col("place") / block).cast("long"), F.pmod(F.xxhash64("term"), F.col("chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("sources") - 1) / block).cast("long")))
    present = cells.select("lang", dealt_to.alias("chunk"), "term", "place", "p", own.alias("own"), other.alias("other"))
    absent = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    absent = absent.select("lang", "chunk", F.lit(None).cast("string").alias("term"), "place", F.col("rest").alias("p"), own.alias("own"), other.alias("other"))
    dealt = present.unionByName(absent).select("lang", "chunk", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "term", "place", "p")
    keys = ["lang", "chunk", "a", "b"]
    summed = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_distances(block), "lang string, i long, j long, value long").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    both = summed.select("lang", "value", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("at")).select("lang", "value", "at.*")
    name = lambda place, c: _sent(groups.select("lang", F.col("place").alias(place), F.col("source").alias(c)))
    pairs = both.join(name("i", "source"), ["lang", "i"]).join(name("j", "item"), ["lang", "j"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(order)
    return pairs.withColumn("rank", rank).unionByName(top.withColumn("rank", rank).where(F.col("rank") <= most))
