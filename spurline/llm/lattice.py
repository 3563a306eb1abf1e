"""Near-duplicate vectors by hashing random projections to points of the E8 lattice."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spurline.llm.common import SENT_ROWS, keep, segments
from spurline.llm.components import components


@dataclass(frozen=True)
class Settings:
    """tables: of cells; blocks: lattice points that name a cell together; probes: points tried for each, the nearest included.

    scale: of a unit vector against the lattice, whose points are the square root of 2 apart. block_rows: vectors compared at a time.
    """

    cosine: float = 0.98
    tables: int = 6
    blocks: int = 2
    probes: int = 3
    scale: float = 5.0
    seed: int = 8
    block_rows: int = 512


@lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of the lattice, which lead to a point's neighbours."""
    pairs = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    halves = [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(pairs + halves)


def _even(v: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum: the coordinate rounded furthest gives way if the sum is odd."""
    near = np.rint(v)
    off = v - near
    odd, rows = near.sum(axis=1) % 2 != 0, np.arange(len(v))
    worst = np.abs(off).argmax(axis=1)
    near[rows[odd], worst[odd]] += np.where(off[rows, worst] >= 0, 1, -1)[odd]
    return near


def nearest(v: np.ndarray) -> np.ndarray:
    """The nearest points of E8: of the even whole points, and those moved by 1/2 in each coordinate."""
    whole, half = _even(v), _even(v - 0.5) + 0.5
    return np.where((((v - whole) ** 2).sum(axis=1) <= ((v - half) ** 2).sum(axis=1))[:, None], whole, half)


@lru_cache(maxsize=64)
def _projections(dim: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng([s.seed, dim])
    wide = max(dim, 8)
    bases = [[np.linalg.qr(random.standard_normal((wide, 8)))[0][:dim] for _ in range(s.blocks)] for _ in range(s.tables)]
    return s.scale * np.array(bases) * np.sqrt(wide / 64), random.random((s.tables, s.blocks, 8)) * 2


def cells(unit: np.ndarray, s: Settings) -> np.ndarray:
    """For each row of unit vectors, table and probe: the cell's key; probe 0 is the vector's own cell."""
    bases, moves = _projections(unit.shape[1], s)
    mixers = np.random.default_rng(s.seed).integers(1, 2**63, size=(s.blocks, 8), dtype=np.uint64) | np.uint64(1)
    keys = np.empty((len(unit), s.tables, s.probes**s.blocks), dtype=np.uint64)
    for t in range(s.tables):
        joint = np.zeros((len(unit), 1), dtype=np.uint64)
        for b in range(s.blocks):
            at = unit @ bases[t, b] + moves[t, b]
            point = nearest(at)
            near = np.argsort(-((at - point) @ roots().T), axis=1, kind="stable")[:, : s.probes - 1]
            tried = np.concatenate([point[:, None, :], point[:, None, :] + roots()[near]], axis=1)
            coded = ((tried * 2).astype(np.int64).astype(np.uint64) * mixers[b]).sum(axis=2, dtype=np.uint64)
            joint = ((joint[:, :, None] * np.uint64(0x9E3779B97F4A7C15)) ^ coded[:, None, :]).reshape(len(unit), -1)
        joint ^= joint >> np.uint64(29)
        keys[:, t] = joint * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(t)
    return keys


def _units(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and unit vectors of a list column, for each length of lists."""
    lengths = np.diff(column.offsets.to_numpy())
    flat, starts = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()[:-1] - column.offsets[0].as_py()
    found = []
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        v = flat[starts[at][:, None] + np.arange(d)]
        v = v / np.abs(v).max(axis=1, keepdims=True)
        found.append((at, v / np.linalg.norm(v, axis=1, keepdims=True)))
    return found


def _placed(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                for at, unit in _units(part.column("vector")):
                    keys = cells(unit, s).view(np.int64)
                    n, tables, probes = keys.shape
                    rows = np.repeat(at, tables * probes)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(pa.array(rows)), part.column("label").take(pa.array(rows)), pa.array(np.full(len(rows), unit.shape[1], dtype=np.int32)),
                         pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), probes), n)), pa.array(keys.ravel()), pa.array(np.tile(np.arange(probes) == 0, n * tables))],
                        ["id", "label", "dim", "place", "key", "own"],
                    )

    return run


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Of the links between n rows, those by which a search reaches each row first: as few as join the same rows."""
    linked = np.zeros((n, n), dtype=bool)
    linked[i, j] = linked[j, i] = True
    unseen, found = linked.any(axis=1), []
    while unseen.any():
        ways = [int(unseen.argmax())]
        unseen[ways[0]] = False
        while ways:
            at = ways.pop()
            new = np.flatnonzero(linked[at] & unseen)
            unseen[new] = False
            found += [(at, k) for k in new]
            ways += new.tolist()
    return np.array(found, dtype=np.int64).reshape(-1, 2)


def _compared(s: Settings):
    """Of each pair of blocks of a cell: rows a, n: the other rows (equal ones of a class each) that a links with, and rows a, b: as few links as join the same.

    Each link counts once: in the first table whose cells join the pair, in the smaller id's cell if both do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in segments(batches, ["label", "dim", "place", "key", "first", "second"]):
            ids, at = np.unique(block.column("id").to_numpy(), return_index=True)  # two probes of a row may meet in a cell
            block = block.take(pa.array(at))
            part, many = block.column("part").to_numpy(), block.column("many").to_numpy()
            place, key = block.column("place")[0].as_py(), np.int64(block.column("key")[0].as_py())
            unit = _units(block.column("vector"))[0][1]
            one, other = block.column("first")[0].as_py(), block.column("second")[0].as_py()
            left, right = np.flatnonzero(part == one), np.flatnonzero(part == other)
            i, j = np.nonzero(unit[left] @ unit[right].T >= s.cosine)
            i, j = left[i], right[j]
            i, j = (i[i < j], j[i < j]) if one == other else (np.minimum(i, j), np.maximum(i, j))  # rows are in order of ids
            if not len(i):
                continue
            keys, counted = cells(unit, s).view(np.int64), np.zeros(len(i), dtype=bool)
            for at in range(0, len(i), 100_000):
                a, b = i[at : at + 100_000], j[at : at + 100_000]
                by_a = (keys[a, :, :1] == keys[b]).any(axis=2)
                by_b = (keys[b, :, :1] == keys[a]).any(axis=2)
                met = by_a | by_b
                counted[at : at + 100_000] = met.any(axis=1) & (met.argmax(axis=1) == place) & (np.where(by_a[:, place], keys[a, place, 0], keys[b, place, 0]) == key)
            i, j = i[counted], j[counted]
            links = np.bincount(i, many[j], len(ids)) + np.bincount(j, many[i], len(ids))
            of, tree = np.flatnonzero(links), _forest(i, j, len(ids))
            null = lambda k: pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids[of]), null(len(of)), pa.array(links[of].astype(np.int64))], ["a", "b", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(ids[tree[:, 0]]), pa.array(ids[tree[:, 1]]), null(len(tree))], ["a", "b", "n"])

    return run


def near_vectors(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Two rows link when their labels are equal and not null and the cosine of their vectors, in double precision, is at
    least s.cosine. n_links counts the other rows linked directly; component_id is the smallest vec_id reachable by
    links, the row's own included; kept says whether it is the row's own. Vectors that are null, empty, zero, or hold null, NaN or infinite
    components link with nothing, as do vectors of different length. A row with a null vec_id links as others do but is never
    kept, nor names a component; ids may repeat, each row counts.

    Equal vectors of a label are one class with a multiplicity. Each class goes to one cell in each table and probes the cells
    of the neighbouring lattice points. Only cells that hold a vector and anything else are compared: their rows are dealt into
    blocks of about s.block_rows, and each pair of blocks is one matrix product, so a crowded cell is many bounded pieces of work. Written are
    each row's number of links in a pair of blocks, and as few links as join what is linked there: no more than twice the rows compared.
    """
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(kind).alias("vector"))
    sound = F.coalesce(F.expr("label is not null and size(vector) > 0 and forall(vector, x -> x is not null and abs(x) < double('Infinity')) and exists(vector, x -> x <> 0)"), F.lit(False))
    classes = keep(rows.where(sound).groupBy("label", "vector").agg(F.count(F.lit(1)).alias("many"), F.min("vec_id").alias("least")).withColumn("id", F.monotonically_increasing_id()))

    placed = keep(classes.select("id", "label", "vector").mapInArrow(_placed(s), "id long, label string, dim int, place int, key long, own boolean"))
    cell = ["label", "dim", "place", "key"]
    busy = keep(placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("held")).where("held and n > 1").select(*cell, F.ceil(F.col("n") / s.block_rows).cast("int").alias("parts")))
    # most probes meet nobody; where the busy cells are few enough to be sent, the others are dropped before anything is shuffled again
    met = placed.join(F.broadcast(busy) if busy.count() <= SENT_ROWS else busy, cell)
    dealt = (
        met.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("id", *cell, "part", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"))
    )
    group = [*cell, "first", "second"]
    found = keep(dealt.join(classes.select("id", "vector", "many"), "id").repartition(*group).sortWithinPartitions(*group).mapInArrow(_compared(s), "a long, b long, n long"))

    linked = found.where("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    links = found.where("b is not null").select("a", "b")
    joined = classes.join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    found = keep(
        joined.join(keep(least), "component").join(linked, "id", "left")
        .select(F.col("label").alias("of"), F.col("vector").alias("like"), (F.coalesce("others", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id")
    )
    out = rows.withColumn("sound", sound).join(found, F.col("sound") & (F.col("label") == F.col("of")) & (F.col("vector") == F.col("like")), "left")
    alone = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), alone.alias("component_id"), F.coalesce(F.col("vec_id") == alone, F.lit(False)).alias("kept"))
