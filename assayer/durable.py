"""Cuts of long plans that survive lost executors, and broadcasts of measured size."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.errors import Refusal

#: Rows measured to be no larger than this travel by broadcast; beyond it Spark plans the join by shuffles.
BROADCAST_BYTES = 16 << 20
#: Characters of a plan's text that the driver keeps for each of the many jobs whose rows are cut.
PLAN_TEXT = "8192"
INFERRING = "spark.sql.constraintPropagation.enabled"


def _shared_folder(df: DataFrame) -> str:
    """The folder that ``spark.checkpoint.dir`` names, made known to Spark.

    Without that setting a local session writes to a temporary folder; a cluster,
    whose executors share no such folder, is refused.
    """
    context = df.sparkSession.sparkContext
    df.sparkSession.conf.set("spark.sql.maxPlanStringLength", PLAN_TEXT)
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise Refusal("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Rows written to the shared folder."""
    _shared_folder(df)
    return df.checkpoint(eager=True)


def cut_long(df: DataFrame) -> DataFrame:
    """``cut`` of rows with long expressions, of which Spark infers no constraints; that takes the driver many seconds a plan and serves filters only."""
    conf = df.sparkSession.conf
    was = conf.get(INFERRING)
    conf.set(INFERRING, "false")
    try:
        return cut(df)
    finally:
        conf.set(INFERRING, was)


def table(df: DataFrame) -> DataFrame:
    """Rows written to the shared folder as a Parquet table: far smaller than a cut where rows are many and narrow, and read by column."""
    path = f"{_shared_folder(df)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows, written out, are at most ``limit`` bytes; give cut rows, they are read once for this."""
    written = F.octet_length(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    return (df.agg(F.sum(written)).first()[0] or 0) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The rows, to be broadcast in a join if they are small; give cut rows, they are read twice."""
    return F.broadcast(df) if is_small(df, limit) else df
