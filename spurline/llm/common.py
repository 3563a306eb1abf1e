"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: The characters that count as white space in the contracts of this subpackage.
SPACES = b" \t\n\x0b\x0c\r"
#: Rows of a few numbers that are sent to all executors at most; the same join shuffles beyond.
SENT_ROWS = 1_000_000
#: Row numbers alone, of 16 bytes each, that are sent to all executors at most.
SENT_IDS = 4_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share.

    A folder of this machine is used only where none is named and Spark runs in one process.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not (sc.master.startswith("local[") or sc.master == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-spurline-"))
    return sc.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """Computes df once into the checkpoint folder and cuts its lineage.

    A checkpoint hands its inferred constraints on, which in loops of joins grow until planning takes longer than the work: they are off meanwhile.
    """
    checkpoint_dir(df.sparkSession)
    conf, name = df.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(name, "true")
    conf.set(name, "false")
    try:
        return df.checkpoint()
    finally:
        conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """df as a table of the checkpoint folder. For loops of joins: unlike a checkpoint it is planned by its own size, not by
    an estimate that multiplies from round to round until it takes longer to compute than the round."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table of written()."""
    sc = df.sparkSession.sparkContext
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, rows: int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most `rows` rows and about `size` bytes of a text or binary column, one row at least; what Arrow has freed goes back to the system after each batch."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
            yield batch.slice(at, end - at)
            at = end
        del batch
        pa.default_memory_pool().release_unused()


def cut(plain: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words between the spaces of a text, of about `size` bytes of it at a time."""
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + size)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def segments(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The runs of equal keys in sorted batches, each as one batch; holds one run and one batch at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
        for k in keys:
            column = batch.column(k)
            changes |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
        borders = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.concat_batches(held)
            held = []
        for at, end in zip(borders, borders[1:]):
            if at and held:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
    if held:
        yield pa.concat_batches(held)
