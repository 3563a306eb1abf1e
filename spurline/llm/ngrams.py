"""Scores of a word n-gram model whose counts are in log-frequency Bloom filters."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spurline.llm.common import cut, segments, slices, written

_U = np.uint64
#: White space as spaces, A-Z as a-z.
_PLAIN = bytes(0x20 if 0x09 <= c <= 0x0D else c | 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Bytes of text in a block, n-grams and words asked for in one shard about, bytes of a model that is sent to all workers.
BLOCK_BYTES, GRAMS, WORDS, SENT_BYTES = 8 << 20, 4_000_000, 1_000_000, 64 << 20
#: Kinds of rows: exact counts of words, filters of n-grams.
WORD, GRAM = 0, 1


@dataclass(frozen=True)
class Settings:
    """order: words in the longest n-gram. base: counts c are held as 1 + floor(log_base c). probes: bits tested for each level, so an unseen n-gram is taken for a seen one with the chance 2^-probes.
    strength: words of the shorter context's distribution that are added to each context (Dirichlet smoothing)."""

    order: int = 3
    base: float = 2.0
    probes: int = 7
    strength: float = 30.0


@dataclass(frozen=True)
class Model:
    """table: kind, shard, body: the shards. tokens and words: all and distinct ones learnt from; shards: how many of each kind; size: bytes of all bodies."""

    table: DataFrame
    tokens: int
    words: int
    shards: tuple[int, int]
    size: int
    settings: Settings


def code(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


#: The end of a text, which is no word.
END = code(b"")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


# ---- blocks of texts


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, learn): blocks of documents as numbers of words."""
    number = TaskContext.get().partitionId() << 33
    for part in slices(batches, "text", 1 << 20, BLOCK_BYTES):
        index: defaultdict[bytes, int] = defaultdict()
        index.default_factory = index.__len__
        found, sizes = [np.empty(0, dtype=np.int32)], []
        for text in part.column("text").cast(pa.binary()):
            size = 0
            for words in cut((text.as_py() or b"").translate(_PLAIN)):
                found.append(np.fromiter(map(index.__getitem__, words), dtype=np.int32, count=len(words)))
                size += len(words)
            sizes.append(size)
        tokens = np.concatenate(found)
        codes = np.fromiter(map(code, index), dtype=np.uint64, count=len(index))
        whole = lambda c: pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c))
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), whole("doc_id"), whole("learn"), pa.array([sizes], pa.list_(pa.int64())), pa.array([codes.tobytes()]), pa.array([_small(tokens)]), pa.array([len(tokens) + len(sizes)], pa.int64())],
            ["block", "doc_id", "learn", "sizes", "codes", "body", "n"],
        )
        number += 1


def pack(docs: DataFrame, learn: Column) -> DataFrame:
    """docs: doc_id, text; learn: whether the model learns from a row (null: yes). A table of blocks of whole texts of about BLOCK_BYTES, one long text being a block of its own."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learn, F.lit(True)).alias("learn"))
    return written(rows.mapInArrow(_packed, "block long, doc_id array<long>, learn array<boolean>, sizes array<long>, codes binary, body binary, n long"))


def _small(numbers: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes."""
    width = numbers.dtype.itemsize
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, width).T).tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _large(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * width, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).reshape(n)


def _steps(keys: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return _small(np.diff(keys, prepend=keys.dtype.type(0)))


def _sums(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(_large(data, kind), dtype=kind)


class Block:
    """The words of a block: code and n-grams of each token, ends of texts included.

    At a token after j others of its text, n-grams up to j + 2 words count: the end of a text stands before the first word of the next.
    """

    def __init__(self, row: dict, shards: tuple[int, int], s: Settings) -> None:
        sizes = np.array(row["sizes"], dtype=np.int64)
        self.ends = np.cumsum(sizes + 1) - 1
        own = np.append(np.frombuffer(row["codes"], dtype=np.uint64), _U(END))
        of = np.full(int(sizes.sum()) + len(sizes), len(own) - 1, dtype=np.int32)
        word = np.ones(len(of), dtype=bool)
        word[self.ends] = False
        of[word] = _large(row["body"], np.int32)
        self.learn = np.repeat(np.array(row["learn"], dtype=bool), sizes + 1)
        self.distinct, back = np.unique(own, return_inverse=True)
        self.of = back.astype(np.int32)[of]
        place = np.arange(len(of)) - np.repeat(self.ends - sizes, sizes + 1)
        codes = own[of]
        before, self.grams, self.valid = np.concatenate([[_U(END)], codes[:-1]]), [], []
        for n in range(2, s.order + 1):
            joint = _mixed(before * _U(2 * n + 1) + codes)
            # the shard of an n-gram, then what names it there
            self.grams.append((((joint >> _U(32)) * _U(shards[GRAM])) >> _U(32)) << _U(32) | joint & _U(0xFFFFFFFF))
            self.valid.append(place >= n - 2)
            before = np.concatenate([[_U(0)], joint[:-1]])

    def _every(self) -> np.ndarray:
        return np.concatenate([g[v] for g, v in zip(self.grams, self.valid)] or [np.empty(0, dtype=np.uint64)])

    def asked(self) -> np.ndarray:
        """Its distinct n-grams in order."""
        return np.unique(self._every())

    def placed(self) -> list[np.ndarray]:
        """Where in the order of its distinct n-grams each token's are, by length; 0 where there is none."""
        every = self._every()
        order = np.argsort(every)
        ordered = every[order]
        new = np.concatenate([[False], ordered[1:] != ordered[:-1]]) if len(every) else np.empty(0, dtype=bool)
        where = np.empty(len(every), dtype=np.int64)
        where[order] = np.cumsum(new)
        out, at = [], 0
        for v in self.valid:
            place, n = np.zeros(len(v), dtype=np.int64), int(v.sum())
            place[v] = where[at : at + n]
            out.append(place)
            at += n
        return out

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """The same, and how often each occurs in texts to learn from."""
        held = np.concatenate([~self.learn[v] for v in self.valid] or [np.empty(0, dtype=bool)])
        both = np.sort(self._every() << _U(1) | held.astype(np.uint64))
        keys = both >> _U(1)
        at = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        return keys[at], np.add.reduceat((both & _U(1)) == 0, at, dtype=np.uint32) if len(at) else np.empty(0, dtype=np.uint32)


def _dealt(keys: np.ndarray, shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of equal shards."""
    at = np.flatnonzero(np.diff(shard, prepend=-1))
    for a, b in zip(at, [*at[1:], len(keys)]):
        yield int(shard[a]), slice(a, b)


def _word_shard(codes: np.ndarray, shards: int) -> np.ndarray:
    return (((codes >> _U(32)) * _U(shards)) >> _U(32)).astype(np.int64)


_MESSAGE = "kind int, shard int, block long, keys binary, counts binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kind, shard, block, keys, counts = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(shard, pa.int32()), pa.array(block, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["kind", "shard", "block", "keys", "counts"])


def _messages(shards: tuple[int, int], s: Settings, learning: bool, asking: bool):
    """Per block and shard its words and n-grams there, with how often they are to be learnt if learning; all of them if asking, else those to learn alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                if not asking and not any(row["learn"]):
                    continue
                b, out = Block(row, shards, s), []
                words, grams = (b.distinct, np.bincount(b.of[b.learn], minlength=len(b.distinct)).astype(np.uint32)), b.counted() if learning else (b.asked(), None)
                for kind, (keys, counts) in ((WORD, words), (GRAM, grams)):
                    if not asking:
                        keys, counts = keys[counts > 0], counts[counts > 0]
                    shard = _word_shard(keys, shards[WORD]) if kind == WORD else (keys >> _U(32)).astype(np.int64)
                    for k, at in _dealt(keys, shard):
                        out.append((kind, k, row["block"], _steps(keys[at] if kind == WORD else keys[at].astype(np.uint32)), _small(counts[at]) if learning else None))
                for at in range(0, len(out), 256):
                    yield _batch(out[at : at + 256])

    return run


# ---- the model


def _hashed(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    joint = _mixed(keys.astype(np.uint64) + (_U(level) << _U(32)))
    return joint & _U(0xFFFFFFFF), (joint >> _U(32)) | _U(1)


def _bit(first: np.ndarray, step: np.ndarray, probe: int, m: int) -> np.ndarray:
    """The bit of m that a pair asks for in its probe: double hashing, its 32 bits spread over m."""
    return (((first + _U(probe) * step) & _U(0xFFFFFFFF)) * _U(m)) >> _U(32)


class LogFilter:
    """A Bloom filter of pairs (n-gram, level): an n-gram that occurs c times is in it with all levels from 1 to 1 + floor(log_base c).

    It is read by asking for levels in turn until one is absent, so a count is never taken for less than it is held as, and for more with a chance that halves with each probe and level.
    """

    def __init__(self, bits: np.ndarray, m: int, top: int, probes: int) -> None:
        self.bits, self.m, self.top, self.probes = bits, m, top, probes

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, s: Settings) -> LogFilter:
        levels = 1 + np.floor(np.log(counts) / np.log(s.base) + 1e-9).astype(np.int64)
        m = max(64, int(np.ceil(levels.sum() * s.probes / np.log(2))))
        full = np.zeros(m, dtype=np.uint8)
        top = int(levels.max(initial=0))
        for level in range(1, top + 1):
            first, step = _hashed(keys[levels >= level], level)
            for probe in range(s.probes):
                full[_bit(first, step, probe, m)] = 1
        return cls(np.packbits(full), m, top, s.probes)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each n-gram, 0 for those not found."""
        found = np.zeros(len(keys), dtype=np.uint8)
        left = np.arange(len(keys))
        for level in range(1, self.top + 1):
            first, step = _hashed(keys[left], level)
            for probe in range(self.probes):
                at = _bit(first, step, probe, self.m)
                there = (self.bits[at >> _U(3)] >> (_U(7) - (at & _U(7))).astype(np.uint8)) & 1 == 1
                left, first, step = left[there], first[there], step[there]
            found[left] = level
            if not len(left):
                break
        return found

    def body(self) -> bytes:
        return np.array([self.m, self.top, self.probes], dtype=np.int64).tobytes() + self.bits.tobytes()

    @classmethod
    def read(cls, body: bytes) -> LogFilter:
        m, top, probes = np.frombuffer(body[:24], dtype=np.int64).tolist()
        return cls(np.frombuffer(body, dtype=np.uint8, offset=24), m, top, probes)


class WordCounts:
    """The exact counts of the words of a shard, by their codes in order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = keys, counts

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.uint64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], _U(0))

    def body(self) -> bytes:
        return len(self.keys).to_bytes(8, "little") + self.keys.tobytes() + self.counts.tobytes()

    @classmethod
    def read(cls, body: bytes) -> WordCounts:
        n = int.from_bytes(body[:8], "little")
        return cls(*np.frombuffer(body, dtype=np.uint64, offset=8).reshape(2, n))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and the sums of their counts."""
    every, n = np.concatenate(keys), np.concatenate(counts)
    if every.dtype == np.uint32:
        both = np.sort(every.astype(np.uint64) << _U(32) | n)  # numbers sort faster than places
        every, n = both >> _U(32), both & _U(0xFFFFFFFF)
    else:
        order = np.argsort(every)
        every, n = every[order], n[order].astype(np.uint64)
    at = np.flatnonzero(np.diff(every, prepend=~every[:1]))
    return every[at].astype(keys[0].dtype), np.add.reduceat(n, at) if len(at) else np.empty(0, dtype=np.uint64)


_KEYS = {WORD: np.uint64, GRAM: np.uint32}


def _learnt(kind: int, messages: pa.RecordBatch, s: Settings) -> tuple[WordCounts | LogFilter, list[np.ndarray], int, int]:
    """What a shard holds of all messages to it; their keys; the distinct ones learnt and how often they occur."""
    keys = [_sums(k.as_py(), _KEYS[kind]) for k in messages.column("keys")]
    counts = [_large(c.as_py(), np.uint32) for c in messages.column("counts")]
    every, total = _summed([k[c > 0] for k, c in zip(keys, counts)], [c[c > 0] for c in counts])
    return WordCounts(every, total) if kind == WORD else LogFilter.of(every, total, s), keys, len(every), int(total.sum())


def _shards(s: Settings):
    """Sorted messages to learn from: the shards of the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in segments(batches, ["kind", "shard"]):
            kind, shard = rows.column("kind")[0].as_py(), rows.column("shard")[0].as_py()
            held, _, distinct, total = _learnt(kind, rows, s)
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([shard], pa.int32()), pa.array([held.body()], pa.binary()), pa.array([distinct], pa.int64()), pa.array([total], pa.int64())], ["kind", "shard", "body", "distinct", "total"])

    return run


def _shards_asked(s: Settings):
    """Sorted messages with counts to learn and keys to ask for: the answers, and for each shard what it has learnt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "shard", "block", "keys", "distinct", "total"]
        for rows in segments(batches, ["kind", "shard"]):
            kind = rows.column("kind")[0].as_py()
            held, keys, distinct, total = _learnt(kind, rows, s)
            one = lambda x, t: pa.array([x], t)
            yield pa.RecordBatch.from_arrays([rows.column("kind")[:1], rows.column("shard")[:1], one(None, pa.int64()), one(None, pa.binary()), one(distinct, pa.int64()), one(total, pa.int64())], names)
            for i, k in enumerate(keys):
                found = held.of(k) if kind == WORD else held.levels(k)
                yield pa.RecordBatch.from_arrays([rows.column("kind")[i : i + 1], rows.column("shard")[i : i + 1], rows.column("block")[i : i + 1], one(_small(found), pa.binary()), one(None, pa.int64()), one(None, pa.int64())], names)

    return run


def _shard_counts(blocks: DataFrame, s: Settings) -> tuple[int, int]:
    sizes = blocks.agg(F.sum("n").alias("n"), F.sum(F.length("codes") / 8).alias("codes")).first()
    return max(1, -(-int(sizes["codes"] or 0) // WORDS)), max(1, -(-(sizes["n"] or 0) * (s.order - 1) // GRAMS))


def train(blocks: DataFrame, s: Settings = Settings()) -> Model:
    """Learns from the texts of pack() that are to be learnt from.

    A block sends each shard its distinct n-grams, named by 32 bits within their shard, and their counts; a shard adds them up and holds them as a LogFilter. Words are held
    with exact counts by 64-bit codes, of which two among n words are equal with a chance of n^2 / 2^65. Shards are as many as the tokens ask for, so each is of bounded size and together they grow with the corpus. No text to learn from: a model of nothing.
    """
    shards = _shard_counts(blocks, s)
    sent = blocks.mapInArrow(_messages(shards, s, True, False), _MESSAGE).repartition("kind", "shard").sortWithinPartitions("kind", "shard")
    table = written(sent.mapInArrow(_shards(s), "kind int, shard int, body binary, distinct long, total long"))
    word = F.col("kind") == WORD
    known = table.agg(F.sum(F.when(word, F.col("total"))).alias("tokens"), F.sum(F.when(word, F.col("distinct"))).alias("words"), F.sum(F.length("body")).alias("size")).first()
    return Model(table.select("kind", "shard", "body"), known["tokens"] or 0, known["words"] or 0, shards, known["size"] or 0, s)


# ---- scores


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, shard, block, keys, body) sorted by kind, shard and block: a shard, whose block is null, then what blocks ask of it."""
    of, held = None, None
    for batch in batches:
        for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            if row["block"] is None:
                of, held = (row["kind"], row["shard"]), (WordCounts if row["kind"] == WORD else LogFilter).read(row["body"])
                continue
            here = held if of == (row["kind"], row["shard"]) else None  # nothing was learnt for the shard
            if row["kind"] == WORD:
                keys = _sums(row["keys"], np.uint64)
                found = here.of(keys) if here else np.zeros(len(keys), dtype=np.uint64)
            else:
                keys = _sums(row["keys"], np.uint32)
                found = here.levels(keys) if here else np.zeros(len(keys), dtype=np.uint8)
            yield _batch([(row["kind"], row["shard"], row["block"], _small(found), None)])


def _scores(b: Block, row: dict, counts: np.ndarray, levels: np.ndarray, tokens: int, words: int, s: Settings) -> pa.RecordBatch:
    """The scores of the texts of a block, given the counts of its distinct words and the levels of its distinct n-grams."""
    steps = s.base ** np.arange(0, 66)
    first, beyond = np.ceil(steps - 1e-9), np.ceil(steps[1:] - 1e-9)
    value = np.concatenate([[0.0], (first[:-1] + np.maximum(beyond - 1, first[:-1])) / 2])  # the middle of the counts of a level
    c = counts[b.of].astype(np.float64)
    p = (c + 0.5) / (tokens + 0.5 * (words + 1))
    base = np.log10(p)
    # what goes before the first word is an end
    ends = float(counts[np.searchsorted(b.distinct, _U(END))])
    context = np.concatenate([[ends], c[:-1]])
    for at, valid in zip(b.placed(), b.valid):
        seen = np.where(valid, value[levels[at]], 0.0)
        p = np.where(valid, (seen + s.strength * p) / (np.maximum(context, seen) + s.strength), p)
        context = np.concatenate([[0.0], seen[:-1]])
    starts = np.concatenate([[0], b.ends[:-1] + 1])
    known = np.add.reduceat((c > 0).astype(np.int64), starts)
    return pa.RecordBatch.from_arrays(
        [pa.array(row["doc_id"], pa.int64()), pa.array([not x for x in row["learn"]]), pa.array(np.array(row["sizes"], dtype=np.int64) + 1), pa.array(known), pa.array(np.full(len(starts), tokens, dtype=np.int64)),
         pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(np.log10(p), starts))],
        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _with_answers(tokens: int, words: int, shards: tuple[int, int], s: Settings):
    """Rows sorted by block, kind and shard: a block, whose kind is null, then its answers in the order in which it asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in segments(batches, ["block"]):
            row = rows.slice(0, 1).to_pylist()[0]
            kind, b = rows.column("kind").to_pylist(), Block(row, shards, s)
            found = {k: [_large(rows.column("keys")[i].as_py(), t) for i, x in enumerate(kind) if x == k] for k, t in ((WORD, np.uint64), (GRAM, np.uint8))}
            levels = np.concatenate(found[GRAM] or [np.zeros(1, dtype=np.uint8)])
            yield _scores(b, row, np.concatenate(found[WORD]), levels, tokens, words, s)

    return run


def _by_broadcast(sent, tokens: int, words: int, shards: tuple[int, int], s: Settings):
    """Blocks scored with the whole model at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {(k, n): (WordCounts if k == WORD else LogFilter).read(body) for k, n, body in sent.value}
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                b = Block(row, shards, s)
                asked = b.asked()
                counts, levels = np.zeros(len(b.distinct), dtype=np.uint64), np.zeros(max(len(asked), 1), dtype=np.uint8)
                for shard, at in _dealt(b.distinct, _word_shard(b.distinct, shards[WORD])):
                    if (WORD, shard) in held:
                        counts[at] = held[WORD, shard].of(b.distinct[at])
                for shard, at in _dealt(asked, (asked >> _U(32)).astype(np.int64)):
                    if (GRAM, shard) in held:
                        levels[at] = held[GRAM, shard].levels(asked[at].astype(np.uint32))
                yield _scores(b, row, counts, levels, tokens, words, s)

    return run


def score(blocks: DataFrame, model: Model, most_bytes: int = SENT_BYTES) -> DataFrame:
    """Per text of pack(): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words of anything but white space, A-Z lower-cased, and an end. base_score is the exact unigram sum of log10((c + 0.5) / (N + 0.5 (V + 1))). score interpolates:
    with p of the shorter context, p' = (c + strength p) / (context's c + strength), where c comes from the filters by asking for level after level, and a context counts at
    least as often as what follows it, so no probability is over 1.

    A model of at most most_bytes is broadcast to the workers, where blocks ask it. A larger one stays in its shards: blocks send each shard what they ask for, and the answers, a byte each,
    go back to the block. Both give the same numbers.

    A null or empty text is an end alone. Rows with a null id are learnt from as pack() was told. Repeated rows are scored each. An empty table gives no row.
    """
    spark, m = blocks.sparkSession, model
    if m.size <= most_bytes:
        sent = spark.sparkContext.broadcast([(r["kind"], r["shard"], bytes(r["body"])) for r in m.table.collect()])
        return blocks.mapInArrow(_by_broadcast(sent, m.tokens, m.words, m.shards, m.settings), _SCORE)
    asked = blocks.mapInArrow(_messages(m.shards, m.settings, False, True), _MESSAGE).select("kind", "shard", "block", "keys", F.lit(None).cast("binary").alias("body"))
    shards = m.table.select("kind", "shard", F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("keys"), "body")
    met = asked.unionByName(shards).repartition("kind", "shard").sortWithinPartitions("kind", "shard", F.col("block").asc_nulls_first())
    answers = met.mapInArrow(_answers, _MESSAGE).drop("counts")
    return _scored(blocks, answers, m.tokens, m.words, m.shards, m.settings)


def _scored(blocks: DataFrame, answers: DataFrame, tokens: int, words: int, shards: tuple[int, int], s: Settings) -> DataFrame:
    both = blocks.drop("n").unionByName(answers, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("kind").asc_nulls_first(), "shard")
    return both.mapInArrow(_with_answers(tokens, words, shards, s), _SCORE)


def learnt_and_scored(blocks: DataFrame, s: Settings = Settings()) -> DataFrame:
    """score(blocks, train(blocks, s)) with one exchange instead of two: a block sends each shard its n-grams once, with what is to be learnt of them, and the shard, when it has learnt from all blocks, asks its filter for each.

    So no filter leaves its shard, and what is moved grows with the texts alone, where a model as large as its corpus could not be broadcast.
    """
    shards = _shard_counts(blocks, s)
    sent = blocks.mapInArrow(_messages(shards, s, True, True), _MESSAGE).repartition("kind", "shard").sortWithinPartitions("kind", "shard")
    answers = written(sent.mapInArrow(_shards_asked(s), "kind int, shard int, block long, keys binary, distinct long, total long"))
    known = answers.where((F.col("kind") == WORD) & F.col("block").isNull()).agg(F.sum("total").alias("tokens"), F.sum("distinct").alias("words")).first()
    return _scored(blocks, answers.where("block is not null").select("kind", "shard", "block", "keys"), known["tokens"] or 0, known["words"] or 0, shards, s)
