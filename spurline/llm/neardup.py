"""Near-duplicate texts: DartMinHash signatures of word shingles, banded joining, exact confirmation."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spurline.llm.common import SENT_IDS, keep, segments, slices
from spurline.llm.components import components, merged

WORD = re.compile(r"\w+")
_U = np.uint64
#: Members of a bucket, and about how many shingles of theirs, that are compared at a time with as many others.
BLOCK, SHINGLES = 256, 200_000


@dataclass(frozen=True)
class Settings:
    """words: in a shingle; similarity: least Jaccard similarity of a link. bands of rows coordinates each make the signature.
    weighted: shingles weigh their number of occurrences, not 1, in signatures and in similarity."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 6
    seed: int = 5
    weighted: bool = False


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit numbers."""
    x = (x + _U(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(31))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(29))


_hashes: dict[str, int] = {}


def shingles(text: str | None, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles of a text, and how often each occurs.

    A shingle is s.words lower-cased words in a row; a text with fewer words is one shingle; without words there is none.
    """
    if len(_hashes) > 100_000:
        _hashes.clear()
    codes = []
    for w in WORD.findall((text or "").lower()):
        code = _hashes.get(w)
        if code is None:
            code = _hashes[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "big")
        codes.append(code)
    if not codes:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    one, n = np.array(codes, dtype=np.uint64), min(s.words, len(codes))
    rolled = np.zeros(len(one) - n + 1, dtype=np.uint64)
    for k in range(n):
        rolled = _mixed(rolled ^ one[k : len(one) - n + 1 + k], k + 1)
    return np.unique(rolled, return_counts=True)


@lru_cache(maxsize=64)
def _poisson(mean: float) -> np.ndarray:
    """Cumulative chances of 0, 1, 2, ... darts."""
    chances, n = [np.exp(-mean)], 0
    while n < mean or chances[-1] > 1e-17:
        n += 1
        chances.append(chances[-1] * mean / n)
    return np.cumsum(chances)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) / 2.0**53


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], s: Settings) -> np.ndarray:
    """DartMinHash (Christiani 2020): a row of s.bands * s.rows codes for each weighted set (elements, weights); no set may be empty.

    On the plane of weight by rank that each element owns, darts fall as a Poisson process of density 1. They are
    drawn cell by cell from the element's hash, so all sets that hold an element see the same darts: cells double in weight
    (0 to 1, to 2, to 4, ...) and in rank (0 to 1/8, to 1/4, to 1/2, ...). A set sees the darts below each
    element's weight. Every dart has a coordinate, and the set keeps the earliest in rank of each; it looks at later ranks until all
    coordinates have one, about k ln k darts for any size of set. Two sets agree on a coordinate with the chance of their weighted Jaccard similarity.
    """
    k = s.bands * s.rows
    of = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
    elements, weights = np.concatenate([e for e, _ in sets]), np.concatenate([w for _, w in sets]).astype(np.float64)
    earliest, codes = np.full(len(sets) * k, np.inf), np.zeros(len(sets) * k, dtype=np.uint64)
    low, high, column = 0.0, 1 / 8, 0
    while len(of):
        for level in range(int(np.ceil(np.log2(max(weights.max(), 1.0)))) + 1):
            bottom, top = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0**level)
            inside = np.flatnonzero(weights > bottom)
            # a cell of large area is cut in rank, so that one number draws the count of darts in each piece
            cuts = max(1, int((top - bottom) * (high - low) // 32))
            for cut in range(cuts):
                cell = _mixed(elements[inside] ^ _U(s.seed), (column * 64 + level) * 65_536 + cut + 1)
                counts = np.searchsorted(_poisson((top - bottom) * (high - low) / cuts), _unit(cell), side="right")
                owner = np.repeat(np.arange(len(cell)), counts)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                dart = _mixed(cell[owner] ^ _mixed(number.astype(np.uint64), 2), 3)
                hit = bottom + (top - bottom) * _unit(_mixed(dart, 4)) < weights[inside][owner]
                dart, owner = dart[hit], inside[owner[hit]]
                rank = low + (high - low) * (cut + _unit(_mixed(dart, 5))) / cuts
                at = of[owner] * k + (_mixed(dart, 6) % _U(k)).astype(np.int64)
                np.minimum.at(earliest, at, rank)
                first = earliest[at] == rank
                codes[at[first]] = dart[first]
        low, high, column = high, high * 2, column + 1
        missing = ~np.isfinite(earliest.reshape(len(sets), k)).all(axis=1)
        left = missing[of]
        of, elements, weights = of[left], elements[left], weights[left]
    return codes.reshape(len(sets), k)


def _signed(s: Settings):
    """Per row: its number and id, a digest of its weighted set (null without words), the keys of its bands, and four bits of each coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 200, 1 << 20):
            sets = _weighted([shingles(t.as_py(), s) for t in part.column("text")], s)
            digests = [hashlib.blake2b(e.tobytes() + w.tobytes(), digest_size=16).digest() if len(e) else None for e, w in sets]
            # equal sets of a part are signed once
            distinct = {d: x for d, x in zip(digests, sets) if d is not None}
            keys: dict[bytes | None, list[int]] = {None: []}
            nibbles: dict[bytes | None, list[int]] = {None: []}
            if distinct:
                codes = signatures(list(distinct.values()), s).reshape(len(distinct), s.bands, s.rows)
                joint = np.broadcast_to(np.arange(s.bands, dtype=np.uint64), (len(distinct), s.bands))
                for r in range(s.rows):
                    joint = _mixed(joint ^ codes[:, :, r], r + 1)
                keys.update(zip(distinct, joint.view(np.int64).tolist()))
                bits = np.zeros((len(distinct), -(-s.bands * s.rows // 16) * 16), dtype=np.uint64)
                bits[:, : s.bands * s.rows] = codes.reshape(len(distinct), -1) & _U(15)
                packed = (bits.reshape(len(distinct), -1, 16) << (np.arange(16, dtype=np.uint64) * _U(4))).sum(axis=2, dtype=np.uint64)
                nibbles.update(zip(distinct, packed.view(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), pa.array(digests, pa.binary()), pa.array([len(e) for e, _ in sets], pa.int64()), *(pa.array([x[d] for d in digests], pa.list_(pa.int64())) for x in (keys, nibbles))],
                ["row", "doc_id", "digest", "size", "keys", "nibbles"],
            )

    return run


def _distances(s: Settings):
    """Sorted rows (a, salt, b, text), the text of a first as b null: the links of a with each b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in segments(batches, ["a", "salt"]):
            sets = _weighted([shingles(t.as_py(), s) for t in block.column("text")], s)
            like = Overlaps(sets).similarity(0)[1:]
            linked = pa.array(like >= s.similarity - 1e-12)
            if block.num_rows > 1:
                yield pa.RecordBatch.from_arrays([block.column("a")[1:].filter(linked), block.column("b")[1:].filter(linked)], ["a", "b"])

    return run


def _weighted(sets: list[tuple[np.ndarray, np.ndarray]], s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    return sets if s.weighted else [(e, np.ones(len(e), dtype=np.int64)) for e, _ in sets]


class Overlaps:
    """Jaccard similarities within a block of weighted sets (none empty), one set against all at a time."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> None:
        distinct, self.at = np.unique(np.concatenate([e for e, _ in sets]), return_inverse=True)
        self.weight = np.concatenate([w for _, w in sets])
        self.ends = np.cumsum([0, *(len(e) for e, _ in sets)])
        self.total = np.add.reduceat(self.weight, self.ends[:-1])
        self.own = np.zeros(len(distinct), dtype=np.int64)

    def similarity(self, i: int) -> np.ndarray:
        mine = slice(self.ends[i], self.ends[i + 1])
        self.own[self.at[mine]] = self.weight[mine]
        both = np.add.reduceat(np.minimum(self.own[self.at], self.weight), self.ends[:-1])
        self.own[self.at[mine]] = 0
        return both / (self.total + self.total[i] - both)


def _linked(pairs: DataFrame, rows: DataFrame, s: Settings) -> DataFrame:
    """pairs: a, b, parts (blocks of a bucket of both); rows: row, text. The pairs that are links: a, b.

    A text that is compared with many is copied to each block of them. Only the texts asked for are shuffled.
    """
    salted = keep(pairs.select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), "b"))
    asked = salted.select(F.col("a").alias("row"), "a", "salt", F.lit(None).cast("long").alias("b")).distinct().unionByName(salted.select(F.col("b").alias("row"), "a", "salt", "b"))
    texts = _with_texts(keep(asked), rows).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return texts.select("a", "salt", "b", "text").mapInArrow(_distances(s), "a long, b long")


def _with_texts(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """asked, a kept table of numbers, joined with rows on row. The numbers of the texts asked for, up to SENT_IDS of them, are sent to all executors
    first, so that no other text is shuffled."""
    wanted = keep(asked.select("row").distinct())
    texts = rows.join(F.broadcast(wanted), "row", "left_semi") if wanted.count() <= SENT_IDS else rows
    return texts.join(asked, "row")


def _least_alike(s: Settings) -> int:
    """Three standard deviations below the coordinates that agree at the similarity of a link, chance agreement of four bits included."""
    k, p = s.bands * s.rows, s.similarity + (1 - s.similarity) / 16
    return int(-(-k // 16) * 16 - k + k * p - 3 * (k * p * (1 - p)) ** 0.5)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _candidates(block: pa.RecordBatch, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of a block that may be links: of different components and parts of the bucket as the block asks for, of signatures that
    agree in enough coordinates, and in no bucket of an earlier band together."""
    one, other, key = block.column("first")[0].as_py(), block.column("second")[0].as_py(), block.column("key")[0].as_py()
    part, component = block.column("part").to_numpy(), block.column("component").to_numpy()
    bits, keys = _matrix(block.column("nibbles")), _matrix(block.column("keys"))
    left, right = np.flatnonzero(part == one), np.flatnonzero(part == other)
    found = []
    for at in range(0, len(left), 64):
        i = left[at : at + 64]
        x = bits[i][:, None, :] ^ bits[right][None, :, :]
        for shift in (1, 2):
            x |= (x >> shift) & (2 ** (64 - shift) - 1)
        alike = bits.shape[1] * 16 - np.bitwise_count(x & 0x1111111111111111).sum(axis=2, dtype=np.int64)
        a, b = np.nonzero((alike >= _least_alike(s)) & (component[i][:, None] != component[right][None, :]))
        found.append(np.stack([i[a], right[b]]))
    i, j = np.concatenate(found, axis=1) if found else np.empty((2, 0), dtype=np.int64)
    if one == other:
        i, j = i[i < j], j[i < j]
    first = (keys[i] == keys[j]).argmax(axis=1)
    here = keys[i, first] == key
    return i[here], j[here]


def _promising(s: Settings):
    """Of each block the rows that are in a candidate pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in segments(batches, ["key", "first", "second"]):
            yield block.take(pa.array(np.unique(np.concatenate(_candidates(block, s)))))

    return run


def _spanning(s: Settings):
    """Of each block as few links as join all that its candidate pairs link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in segments(batches, ["key", "first", "second"]):
            i, j = _candidates(block, s)
            if not len(i):
                continue
            like = Overlaps(_weighted([shingles(t.as_py(), s) for t in block.column("text")], s))
            group, links = block.column("component").to_numpy().copy(), []
            for a in np.unique(i):
                others = j[i == a]
                others = others[group[others] != group[a]]
                if len(others):
                    for b in others[like.similarity(a)[others] >= s.similarity - 1e-12]:
                        if group[a] != group[b]:
                            group[group == group[b]] = group[a]
                            links.append((a, b))
            if links:
                ids, at = block.column("id"), np.array(links)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[:, 0])), ids.take(pa.array(at[:, 1]))], ["a", "b"])

    return run


def near_copies(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, component_id, group_size, kept, row.

    Two texts link when the Jaccard similarity of their sets of shingles (s.words lower-cased words in a row) is at
    least s.similarity. Rows reachable by links are one group: component_id is its smallest doc_id, group_size its rows,
    and kept marks one row, that with the smallest doc_id (null last). Texts with fewer words than a shingle are one shingle; those without words, null and
    empty ones, are groups of their own. Ids may repeat. docs has to give the same rows in the same partitions each time it
    is computed, as a table read from files does; row is monotonically_increasing_id() on it.

    Rows with equal sets are one class. Classes whose signatures agree in a band share a bucket: at
    similarity 0.8 a pair meets in none with a chance of 0.0007. In each bucket all are compared with one, not with each other; links give
    components, and buckets in one component are finished, as more links can't change a group. The members of the others are dealt into blocks of about
    BLOCK, or fewer long ones, and each pair of blocks is one bounded piece of work: pairs from different components whose signatures agree in enough coordinates, which
    0.999 of the pairs at similarity 0.8 do, are compared there, in the first band they share, and as few links as join their components are written. So no pairs
    but links are ever rows, and those no more than the members of the blocks.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = keep(rows.mapInArrow(_signed(s), "row long, doc_id long, digest binary, size long, keys array<long>, nibbles array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row"))
    classes = keep(
        signed.where("digest is not null").groupBy("digest").agg(first.alias("first"), F.first("keys").alias("keys"), F.first("nibbles").alias("nibbles"), F.max("size").alias("size"), F.count(F.lit(1)).alias("many"))
        .withColumn("id", F.col("first.row"))
    )
    member = classes.select(F.explode("keys").alias("key"), "id", "size")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / SHINGLES)).cast("int")
    buckets = keep(member.groupBy("key").agg(F.count(F.lit(1)).alias("n"), parts.alias("parts"), F.min("id").alias("pivot")).where("n > 1").drop("n"))
    member, texts = keep(member.join(buckets, "key").select("key", "id", "pivot", "parts")), rows.select("row", "text")

    pairs = member.where("id <> pivot").groupBy(F.col("pivot").alias("a"), F.col("id").alias("b")).agg(F.max("parts").alias("parts"))
    group, named = components(_linked(pairs, texts, s)), F.coalesce("component", "id")

    # what is left are buckets whose members are in different components
    placed = keep(member.join(group, "id", "left").select("key", "id", "parts", named.alias("component")))
    open_ = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    dealt = (
        placed.join(open_, "key", "left_semi").join(classes.select("id", "keys", "nibbles"), "id")
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"), "part", "id", "component", "keys", "nibbles")
    )
    of_block, kinds = ["key", "first", "second"], "key long, first int, second int, part int, id long, component long, keys array<long>, nibbles array<long>"
    asked = keep(dealt.repartition(*of_block).sortWithinPartitions(*of_block).mapInArrow(_promising(s), kinds)).withColumn("row", F.col("id"))
    compared = _with_texts(asked, texts).select(*(k.split()[0] for k in kinds.split(", ")), "text")
    links = keep(compared.repartition(*of_block).sortWithinPartitions(*of_block).mapInArrow(_spanning(s), "a long, b long"))
    group = merged(group, links)

    placed = classes.join(group, "id", "left").select("digest", "first", "many", named.alias("component"))
    whole = keep(placed.groupBy("component").agg(F.min("first").alias("best"), F.sum("many").alias("group_size")))
    found = keep(placed.join(whole, "component").select("digest", "best", "group_size"))
    own = F.coalesce(F.col("row") == F.col("best.row"), F.lit(True))
    return signed.join(found, "digest", "left").select(
        "doc_id", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), own.alias("kept"), "row"
    )
