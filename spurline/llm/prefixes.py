"""Trie of the common beginnings of conversations: a Patricia tree over sorted sequences, expanded to one row a node."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spurline.llm.common import SENT_ROWS, keep
from spurline.llm.mixing import words

#: Bytes of a turn's digest, ids in one piece of the ends of a node that several slices share, rows of an output batch.
WIDTH, PIECE, ROWS = 16, 4_096, 8_192
NO_ENDS = hashlib.sha256(b"").hexdigest()


def conversations(rows: DataFrame, group: str | None = None) -> DataFrame:
    """rows: conv_id, turn, role, text. Per conv_id: turns, an array of (digest, words) in order of turn, and group if that column is named.

    A digest is the MD5 of role and text, null as empty. Turns come in ascending order, null first; equal turns by role, then digest; repeated rows
    are turns of their own. Rows without conv_id are in no conversation. Texts aren't shuffled: a conversation's array has 16 bytes a turn and a count of words.
    With group all conversations of one group meet in one partition, so what compares them afterwards needs no further exchange.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    by = [group] if group else []
    turns = rows.where("conv_id is not null").select(
        *by, F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("there"), F.coalesce(F.col("turn"), F.lit(0)).alias("turn"), role.alias("role"), F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), words(text).alias("words")).alias("t"),
    )
    if group:
        turns = turns.repartition(group)
    plain = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
    return turns.groupBy(*by, "conv_id").agg(plain.alias("turns"))


def with_heads(rows: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations of which each begins with the first h turns of conversation c - c % every and goes on with its own after its first h; h = crc32(c) % most.

    Where that conversation has fewer turns all are taken, where it is absent none. The conversations of one group, fewer than 2 * every, meet in one partition of a window.
    """
    # group_ isn't a column of the result, so a column of rows named so is overlaid
    grouped = conversations(rows.select("conv_id", "turn", "role", "text").withColumn("group_", F.col("conv_id") - F.col("conv_id") % every), "group_")
    head = F.first(F.when(F.col("conv_id") == F.col("group_"), F.slice("turns", 1, most - 1)), ignorenulls=True).over(Window.partitionBy("group_"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    begun = F.slice(F.coalesce(F.col("head"), F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return grouped.withColumn("head", head).withColumn("h", h).select("conv_id", F.concat(begun, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def common(a: bytes, b: bytes) -> int:
    """The number of digests that two sequences have in common at their beginning."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * WIDTH : middle * WIDTH] == b[low * WIDTH : middle * WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low


class _Point:
    """A branch, end or leaf point of the compressed tree on the path from the root to the last conversation read."""

    __slots__ = ("depth", "key", "left", "n", "low", "kids", "leaves", "saved", "ends", "piece", "first", "waiting")

    def __init__(self, depth: int, key: bytes | None, left: bool) -> None:
        self.depth, self.key, self.left = depth, key, left
        self.n = self.kids = self.leaves = self.saved = 0
        self.low: int | None = None
        self.ends = None
        self.piece: list[str] = []
        self.first = 0
        self.waiting: list[tuple] = []


_POINT = pa.schema([
    ("part", pa.int32()), ("depth", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()), ("parent", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("low", pa.int64()),
    ("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("suffix", pa.list_(pa.int64())), ("ends", pa.string()),
])
_POINT_SQL = "part int, depth long, key binary, parent_key binary, parent long, n long, m long, low long, kids long, leaves long, saved long, suffix array<long>, ends string"
#: Kinds of rows: a point of which a slice holds all members, what a slice adds to a point that others share, and ids of conversations that end at such a point.
CLOSED, SHARED, ENDS = 0, 1, 2


class _Slice:
    """One slice of the sorted sequences, read once from left to right with a stack of the open path.

    A node is shared with other slices only if it lies on the path of the slice's first sequence, as far as that agrees with the sequence before
    it, or on that of its last, as far as that agrees with the one after. The root and all such nodes become points of their own, named by a hash of their prefix, and the slice gives what
    its members add to them; all others are complete here.
    """

    def __init__(self, before: bytes | None, after: bytes | None, last: bytes) -> None:
        self.before, self.after, self.last = before, after, last
        self.to_right = common(last, after) if after is not None else 0
        self.stack = [_Point(0, b"", before is not None)]
        self.seq, self.sums, self.out = None, [0], []

    def add(self, conv_id: int, seq: bytes, counts: list[int]) -> None:
        n = len(seq) // WIDTH
        same = common(seq, self.seq if self.seq is not None else self.before or b"")
        begin = same
        if self.seq is None:
            begin, first = 0, True  # nothing of its path is on the stack yet
        else:
            first = False
            self._close(same)
        sums = [0]
        for w in counts:
            sums.append(sums[-1] + w)
        self.seq, self.sums = seq, sums
        # shared nodes are points of their own, named by the hash of their prefix
        shared = max(same if first else 0, min(common(seq, self.last), self.to_right))
        if shared > begin:
            digest = hashlib.blake2b(seq[: begin * WIDTH], digest_size=16)
            for depth in range(begin + 1, shared + 1):
                digest.update(seq[(depth - 1) * WIDTH : depth * WIDTH])
                self.stack.append(_Point(depth, digest.copy().digest(), first and depth <= same))
        if self.stack[-1].depth < n:
            self.stack.append(_Point(n, None, False))
        top = self.stack[-1]
        top.n += 1
        top.low = conv_id if top.low is None else min(top.low, conv_id)
        if top.key is None:
            if top.ends is None:
                top.ends = hashlib.sha256(str(conv_id).encode())
            else:
                top.ends.update(f",{conv_id}".encode())
        else:
            if not top.piece:
                top.first = conv_id
            top.piece.append(str(conv_id))
            if len(top.piece) == PIECE:
                self._piece(top)

    def _piece(self, p: _Point) -> None:
        if p.piece:
            self.out.append((ENDS, p.depth, p.key, None, None, None, None, p.first, None, None, None, None, ",".join(p.piece)))
            p.piece = []

    def _close(self, depth: int) -> None:
        """Takes all points deeper than depth from the stack; the last sequence is a leaf if the next one does not go on from its end."""
        if self.stack[-1].depth == len(self.seq) // WIDTH and depth < self.stack[-1].depth:
            self.stack[-1].leaves += 1
        while self.stack[-1].depth > depth:
            q = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(_Point(depth, None, False))
            p = self.stack[-1]
            suffix = [self.sums[q.depth] - self.sums[k] for k in range(p.depth, q.depth)]
            m = q.n - (not q.left)
            p.n += q.n
            p.low = q.low if p.low is None else min(p.low, q.low)
            p.leaves += q.leaves
            p.saved += q.saved + m * suffix[0]
            p.kids += not q.left
            self._give(q, p, m, suffix)

    def _give(self, q: _Point, p: _Point | None, m: int, suffix: list[int]) -> None:
        if q.key is not None:
            self._piece(q)
            own = suffix[-1] if suffix else 0
            self.out.append((SHARED, q.depth, q.key, p.key if p else None, None, q.n, m, q.low, q.kids, q.leaves, q.saved + m * own, None, None))
            return
        for row in q.waiting:
            self.out.append((*row[:4], q.low, *row[5:]))
        row = (CLOSED, q.depth, None, p.key, None, q.n, m, q.low, q.kids, q.leaves, q.saved, suffix, q.ends.hexdigest() if q.ends else NO_ENDS)
        # the parent's id is known once all its members are
        (p.waiting if p.key is None else self.out).append(row)

    def end(self) -> None:
        if self.seq is None:
            return
        if self.after is None and not len(self.seq):
            self.stack[0].leaves += 1  # nothing but conversations without turns
        after = self.to_right
        if self.stack[-1].depth == len(self.seq) // WIDTH and after < self.stack[-1].depth:
            self.stack[-1].leaves += 1
        while len(self.stack) > 1:
            # all that is left is one path: its points are taken one by one, without the rule for leaves
            q = self.stack.pop()
            p = self.stack[-1]
            suffix, m = [self.sums[q.depth] - self.sums[k] for k in range(p.depth, q.depth)], q.n - (not q.left)
            p.n += q.n
            p.low = q.low if p.low is None else min(p.low, q.low)
            p.leaves += q.leaves
            p.saved += q.saved + m * suffix[0]
            p.kids += not q.left
            self._give(q, p, m, suffix)
        root = self.stack[0]
        self._give(root, None, root.n - (not root.left), [])

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.out) >= least:
            for at in range(0, len(self.out), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*self.out[at : at + ROWS]), _POINT)], schema=_POINT)
            self.out = []


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, seq, words, before, after, last; the last three of the first row alone) of one slice, sorted: its points."""
    slice_ = None
    for batch in batches:
        for row in batch.to_pylist():
            if slice_ is None:
                slice_ = _Slice(row["before"], row["after"], row["last"])
            slice_.add(row["conv_id"], row["seq"], row["words"])
            yield from slice_.batches(ROWS)
    if slice_ is not None:
        slice_.end()
        yield from slice_.batches(1)


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, low, ends) sorted by key and low: per key the digest of all pieces, read one after the other."""
    key, digest, keys, found = None, None, [], []
    for batch in batches:
        for k, piece in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if k != key:
                if key is not None:
                    keys.append(key)
                    found.append(digest.hexdigest())
                key, digest = k, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([*keys, key], pa.binary()), pa.array([*found, digest.hexdigest()], pa.string())], ["key", "ends"])


def trie(convs: DataFrame) -> DataFrame:
    """convs: conv_id (long, distinct), turns (array of digest, words), as conversations() gives them.

    Per distinct sequence of the first d turns of a conversation, from the one without turns (d = 0), a row: conv_id (the smallest that begins so), depth,
    parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens (over its subtree each node's n_convs - 1 times the words of its last turn), ends_sha256 (of
    the ids that end there, ascending, joined by commas).

    Sequences are byte strings of digests, sorted in ranges together with conv_id, so that a beginning which many share, or many equal conversations, are dealt over as many slices as they fill.
    A slice makes only branch, end and leaf points: a sequence leaves the path of the one before it where the two differ, and ends where it ends. Aggregates are summed
    up the compressed tree in the same pass. What slices share are the nodes on the paths of their borders, as many as a conversation has turns; these are
    added up by the hash of their prefix. In the end the nodes between two points, which have the upper edge's members, are made from the lower point and the sums of words from each
    node to the end of the edge.

    A conversation's digests are one value of 16 bytes a turn. An empty table gives no row; conversations without turns count at the root alone. Other columns are ignored.
    """
    hexes = F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")
    sequences = convs.select("conv_id", F.unhex(hexes).alias("seq"), F.transform("turns", lambda t: t["words"]).alias("words"))
    ordered = keep(sequences.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").withColumn("at", F.monotonically_increasing_id()))
    number = F.shiftright("at", 33)
    over = Window.orderBy("slice")  # a row for each slice
    borders = ordered.groupBy(number.alias("slice")).agg(F.min_by("seq", "at").alias("first"), F.max_by("seq", "at").alias("last"))
    borders = keep(borders.select("slice", "last", F.lag("last").over(over).alias("before"), F.lead("first").over(over).alias("after")))
    marked = ordered.withColumn("slice_of", F.when(F.col("at") % 2**33 == 0, number)).join(F.broadcast(borders), F.col("slice_of") == F.col("slice"), "left")
    points = keep(marked.select("conv_id", "seq", "words", "before", "after", "last").mapInArrow(_points, _POINT_SQL))

    ends = points.where(F.col("part") == ENDS).select("key", "low", "ends").repartition("key").sortWithinPartitions("key", "low").mapInArrow(_joined_ends, "key binary, ends string")
    sums = points.where(F.col("part") == SHARED).groupBy("depth", "key").agg(
        F.first("parent_key").alias("parent_key"), *(F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")), F.min("low").alias("low")
    )
    shared = keep(sums.join(ends, "key", "left"))
    above = shared.select(F.col("key").alias("parent_key"), F.col("low").alias("above"))
    above = F.broadcast(above) if shared.count() <= SENT_ROWS else above
    top = shared.join(above, "parent_key", "left").select(
        F.col("low").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    edges = points.where(F.col("part") == CLOSED).join(above, "parent_key", "left").withColumn("length", F.size("suffix")).select("*", F.posexplode("suffix").alias("pos", "below"))
    lower = F.col("pos") == F.col("length") - 1
    nodes = edges.select(
        F.col("low").alias("conv_id"), (F.col("depth") - F.col("length") + 1 + F.col("pos")).alias("depth"), F.when(F.col("pos") > 0, F.col("low")).otherwise(F.coalesce("parent", "above")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(lower, F.col("kids")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") + F.col("m") * F.col("below")).alias("saved_tokens"),
        F.when(lower, F.col("ends")).otherwise(NO_ENDS).alias("ends_sha256"),
    )
    return top.unionByName(nodes)
