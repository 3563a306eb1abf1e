"""SentencePiece encoding and decoding through tables of distinct chunks."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from spurline.llm.common import slices

MARK, BREAK = "▁", "\n"
#: A run of markers with what follows it, text after a line break, or a line break.
CHUNK = re.compile(f"{MARK}+[^{MARK}{BREAK}]*|[^{MARK}{BREAK}]+|{BREAK}")
#: Distinct chunks that a worker remembers at least, and texts that it holds encoded at a time at most.
REMEMBERED, TEXTS = 100_000, 500
#: Chunks that are segmented as the lines of one short text.
LINES = 200

_processors: dict[bytes, Table] = {}


def _table(model: bytes) -> Table:
    """One table for each worker and model."""
    key = hashlib.blake2b(model).digest()
    if key not in _processors:
        _processors[key] = Table(sentencepiece.SentencePieceProcessor(model_proto=model))
    return _processors[key]


def check_model(model: bytes) -> None:
    """Raises ValueError for a model whose pieces may cross the borders of chunks."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    crossing = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if BREAK in p or MARK in p.lstrip(MARK)]
    probe = sp.encode(f"{BREAK}  a")
    if crossing or sp.decode(probe) != f"{BREAK}  a" or len(sp.encode(BREAK)) != 2:
        raise ValueError(f"pieces cross white space or line breaks, or white space is normalised: {crossing[:3]}")


class Table:
    """Ids of distinct chunks. Holds the last REMEMBERED to twice as many that were met; those unused for longest go."""

    def __init__(self, sp: sentencepiece.SentencePieceProcessor) -> None:
        self.sp, self.new, self.old = sp, {}, {}
        self.line_break = sp.encode(BREAK)[-1]

    def learn(self, chunks: set[str]) -> None:
        """Segments the chunks that the table lacks, as lines of short texts: no piece crosses a line break, nor holds one."""
        if len(self.new) > REMEMBERED:
            self.new, self.old = {}, self.new
        unknown = []
        for c in chunks - self.new.keys():
            if c == BREAK:
                self.new[c] = array("i", [self.line_break])
            elif (ids := self.old.get(c)) is None:
                unknown.append(c)
            else:
                self.new[c] = ids
        for at in range(0, len(unknown), LINES):
            some = unknown[at : at + LINES]
            ids = array("i", self.sp.encode(f"{BREAK}{BREAK.join(some)}{BREAK}".replace(MARK, " ")))
            ends = [i for i, x in enumerate(ids) if x == self.line_break]
            self.new.update((c, ids[i + 1 : j]) for c, i, j in zip(some, ends, ends[1:]))


def encode_texts(texts: list[str | None], table: Table) -> tuple[list[int], array]:
    """Lengths and all ids of the texts. Each distinct chunk that the table lacks is segmented once."""
    split = [CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
    table.learn(set().union(*split))
    known, flat, lengths = table.new, array("i"), []
    for chunks in split:
        before = len(flat)
        for c in chunks:
            flat += known[c]
        lengths.append(len(flat) - before)
    return lengths, flat


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id and ids, exactly those of the library, without begin or end ids.

    model is the content of a SentencePiece file whose pieces cross neither white space markers nor
    line breaks. Null and empty texts give an empty array. Ids may be null or repeat; every row gives a row.
    Other columns are ignored.
    """
    check_model(model)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(sent.value)
        for part in slices(batches, "text", TEXTS):
            lengths, flat = encode_texts(part.column("text").to_pylist(), table)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(flat, dtype=np.int32) if flat else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, model: bytes) -> DataFrame:
    """encode() and decode() of docs (doc_id, text) in one pass, so that a task needs one worker: doc_id, ids, decoded."""
    check_model(model)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(sent.value)
        for part in slices(batches, "text", TEXTS):
            lengths, flat = encode_texts(part.column("text").to_pylist(), table)
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(flat, dtype=np.int32) if flat else [], pa.int32()))
            texts = [table.sp.decode(flat[a:b].tolist()) if b > a else "" for a, b in zip(ends.tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode(rows: DataFrame, model: bytes) -> DataFrame:
    """Adds decoded, the library's text for ids, to rows (doc_id, ids). Null and empty ids give an empty text."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _table(sent.value).sp
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                texts = [sp.decode(x.as_py()) if x.is_valid and len(x) else "" for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
