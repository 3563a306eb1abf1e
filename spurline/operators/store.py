"""Tables that are computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(df: DataFrame) -> str:
    """The folder that spark.checkpoint.dir names; one of this machine only where none is named and Spark runs in one process."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not (sc.master.startswith("local[") or sc.master == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-spurline-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df as a table of the shared folder, for loops of joins: it is planned by its own size, where the estimate of a checkpoint is a product that gets longer every round, until it takes longer to multiply than the round."""
    path = f"{shared_folder(df)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table of written()."""
    sc = df.sparkSession.sparkContext
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame) -> DataFrame:
    """Computes df once into the shared folder and cuts its lineage.

    Constraints that a checkpoint hands on would make the plans of a loop grow, so none are inferred meanwhile.
    """
    shared_folder(df)
    conf, name = df.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(name, "true")
    conf.set(name, "false")
    try:
        return df.checkpoint()
    finally:
        conf.set(name, before)
