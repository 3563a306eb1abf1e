"""Exact duplicates by deterministic block naming.

Texts without their white space are cut into blocks of fixed size. Distinct blocks get
integer names in sorted order; then adjacent names are paired and the distinct pairs named,
level by level, until each text has one name. Two texts have the same name and number of
levels just when they are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spurline.llm.common import SPACES, keep, shuffles, slices

#: Bytes of UTF-8 in a block.
BLOCK_BYTES = 8192
#: Texts that a worker holds as Python bytes at a time.
TEXTS = 200


def _key(block: bytes, seed: int) -> bytes:
    return hashlib.blake2b(block, digest_size=16, key=seed.to_bytes(4, "big")).digest()


def _blocks(text: bytes | None, size: int) -> tuple[bytes, list[bytes]]:
    """The text without white space, and its blocks: one empty block for an empty text."""
    bare = (text or b"").translate(None, SPACES)
    return bare, [bare[i : i + size] for i in range(0, len(bare), size)] or [b""]


def _measured(size: int, seed: int):
    """Per row: its number, id, code points, digest of the bare text, and the sort key of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "raw", TEXTS):
            digests, keys = [], []
            for text in part.column("raw"):
                bare, blocks = _blocks(text.as_py(), size)
                digests.append(hashlib.sha256(bare).hexdigest())
                keys.append([_key(b, seed) for b in blocks])
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), part.column("points"), pa.array(digests, pa.string()), pa.array(keys, pa.list_(pa.binary()))],
                ["row", "doc_id", "points", "text_sha256", "keys"],
            )

    return run


def _contents(size: int, seed: int):
    """Each different block of some texts with its sort key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "raw", TEXTS):
            seen = {b: _key(b, seed) for text in part.column("raw") for b in _blocks(text.as_py(), size)[1]}
            yield pa.RecordBatch.from_arrays([pa.array(seen.values(), pa.binary()), pa.array(seen.keys(), pa.binary())], ["key", "block"])

    return run


def _named(distinct: DataFrame, spread: Column, order: list[str]) -> DataFrame:
    """Adds an integer name to distinct rows: their place in the order within one of many even shares, and the share.

    A name follows from the set of rows alone, so a lost task gives the same names again.
    """
    shares = 8 * shuffles(distinct.sparkSession)
    place = F.row_number().over(Window.partitionBy("share").orderBy(*order)).cast("long")
    return distinct.withColumn("share", F.pmod(spread, F.lit(shares))).withColumn("name", (place - 1) * shares + F.col("share")).drop("share")


def find_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D]; a null
    text counts as empty, and all empty texts are equal. The row with the most code points in
    its original text stays, then the smallest doc_id (a null id comes last); of rows alike in both, one.
    keep_id is the doc_id of the row that stays. Other columns of docs are ignored. An empty
    table gives an empty result; ids may repeat.

    Blocks are sorted by a 128-bit key of their content. Before names are given, a grouped
    aggregation compares the contents under each key; should two different blocks share one,
    all keys are made anew from another seed, so names never collide.
    """
    raw = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("points"), F.col("text").cast("binary").alias("raw"),
    )
    seed = 0
    while True:
        contents = raw.select("raw").mapInArrow(_contents(block_bytes, seed), "key binary, block binary")
        keys = keep(contents.groupBy("key").agg((F.min("block") == F.max("block")).alias("one")))
        if keys.where("not one").isEmpty():
            break
        seed += 1
    rows = keep(raw.mapInArrow(_measured(block_bytes, seed), "row long, doc_id long, points long, text_sha256 string, keys array<binary>"))

    level = (
        rows.select("row", F.struct("doc_id", "points", "text_sha256").alias("doc"), F.size("keys").alias("blocks"), F.posexplode("keys").alias("place", "key"))
        .join(_named(keys.select("key"), F.conv(F.substring(F.hex("key"), 1, 8), 16, 10).cast("long"), ["key"]), "key")
        .select("row", "doc", "blocks", "place", "name")
    )
    widest = rows.agg(F.max(F.size("keys"))).first()[0] or 1
    depth, level = 0, keep(level)
    named = [level.where("blocks = 1").withColumn("depth", F.lit(0))]
    while widest > 1:
        pairs = keep(
            level.where("blocks > 1")
            .withColumns({"left": F.when(F.col("place") % 2 == 0, F.col("name")), "right": F.when(F.col("place") % 2 == 1, F.col("name"))})
            .groupBy("row", F.expr("place div 2").cast("int").alias("place"))
            .agg(F.first("doc").alias("doc"), F.expr("(first(blocks) + 1) div 2").cast("int").alias("blocks"), F.max("left").alias("left"), F.coalesce(F.max("right"), F.lit(-1)).alias("right"))
        )
        distinct = pairs.select("left", "right").distinct()
        level = keep(pairs.join(_named(distinct, F.xxhash64("left", "right"), ["left", "right"]), ["left", "right"]).select("row", "doc", "blocks", "place", "name"))
        depth, widest = depth + 1, (widest + 1) // 2
        named.append(level.where("blocks = 1").withColumn("depth", F.lit(depth)))
    texts = reduce(DataFrame.unionByName, named).select("row", "doc.*", "depth", "name")

    first = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), "doc_id", "row"))
    groups = keep(texts.groupBy("depth", "name").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first")))
    return texts.join(groups, ["depth", "name"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256", "row"
    )
