"""From documents to token ids: language, exact copies, near copies, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. Stages find rows by monotonically_increasing_id() on that table, so that texts needn't
move with the decisions; the last stage alone returns other columns than those of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spurline.llm import exact, language, mixing, neardup, pieces
from spurline.llm.common import SENT_ROWS, checkpoint_dir, drop_written, keep, table
from spurline.llm.queries import tokenizer_model

def _free(docs: DataFrame, name: str) -> str:
    """name, or that with as many `_` as make it no column of docs."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _joined(docs: DataFrame, decisions: DataFrame, how: str, renamed: dict[str, str] | None = None) -> DataFrame:
    """docs joined on their row numbers with decisions (row and a few more columns, renamed) for each row they name. Columns of docs stay as they are, whatever their names."""
    row = _free(docs, "row")
    decisions = keep(decisions.withColumnsRenamed({"row": row, **(renamed or {})}))
    small = decisions.count() <= SENT_ROWS
    return docs.withColumn(row, F.monotonically_increasing_id()).join(F.broadcast(decisions) if small else decisions, row, how).drop(row)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no language of the corpus for sure: no letters, or text that no language makes likely.

    So null, empty and letterless texts go, and with no declared language at all every row. Rows without a language or source of their own are judged by their text; long texts by all of it.
    Repeated rows are judged alike, each one. An empty table stays empty; further columns of any name are kept.
    """
    rows = language.from_documents(docs.select("text", "lang", "source", F.monotonically_increasing_id().alias("row"))).select("row", "text", "is_page", "declared", "host")
    found = language.identify(rows, language.fit(docs), carry=("row",))
    return _joined(docs, found.where("not accepted").select("row"), "left_anti")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts that are equal but for white space: the longest, of these the one with the smallest doc_id (null last), of repeated rows one.

    Null, empty and blank texts are one group. An empty table stays empty; further columns of any name are kept.
    """
    return _joined(docs, exact.find_copies(docs.select("doc_id", "text")).where("not kept").select("row"), "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the smallest doc_id (null last), of repeated rows one.

    Documents without words, null and empty ones among them, are groups of their own and all stay. An empty table stays empty; further columns of any name are kept.
    """
    return _joined(docs, neardup.near_copies(docs.select("doc_id", "text")).where("not kept").select("row"), "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mixture wants it: not at all, once, or as so many rows.

    A null source is one source. Documents without words, null and empty ones among them, are never taken. Repeated rows count each. An empty table stays empty; further columns of any name are kept.
    """
    found = mixing.mix(docs.select("doc_id", "text", "source", F.monotonically_increasing_id().alias("row")), carry=("row",))
    copies = _free(docs, "copies")
    taken = _joined(docs, found.where("copies > 0").select("row", "copies"), "inner", {"copies": copies})
    return taken.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).drop(copies)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row doc_id, ids, n_tokens, and decoded_sha256: of the text that the ids decode to.

    A null or empty text has no ids and decodes to an empty text. Repeated rows give a row each. An empty table gives an empty one; further columns are left out.
    """
    return pieces.round_trip(docs, tokenizer_model()).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("sentencepiece", sentencepiece),
]

#: Signatures, random rounding and pieces are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents of sf_dir; tables between them are written under the shared checkpoint folder, and deleted once the next is written."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4()}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before is not None:
            drop_written(before)
        docs = before = spark.read.parquet(f"{folder}/{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
