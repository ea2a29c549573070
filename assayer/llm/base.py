"""What the text operators share: column picking, batching and durable cuts.

Conventions that hold for every operator of this subpackage:

* A document table needs the columns named by the operator and may hold any
  others, even several with the same name in the same or another case. The
  exact name wins over a case-insensitive match, the first column over later
  ones; a missing column is a ``ValueError``.
* A null text is an empty text unless the operator says otherwise.
* Every input row gives its own output row; repeated rows give repeated rows.
* An empty table gives an empty result of the documented schema.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.durable import BROADCAST_BYTES as BROADCAST_BYTES
from assayer.durable import broadcast_if_small as broadcast_if_small
from assayer.durable import cut as cut
from assayer.durable import is_small as is_small
from assayer.durable import table as table

#: Arrow types of the column types that the operators add.
ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()), "array<array<bigint>>": pa.list_(pa.list_(pa.int64())),
}
#: Bytes of a batch that Spark hands to Python and that both sides hold at once; a longer text comes alone.
BATCH_BYTES = 4 << 20
#: Rows whose checksum leaves this remainder are held out of every fit.
FOLDS, HELD_OUT = 4, 2


def position_of(columns: list[str], name: str) -> int:
    """Index of the column meant by ``name``: exact spelling first, then any case, the first of several."""
    for k, have in enumerate(columns):
        if have == name:
            return k
    for k, have in enumerate(columns):
        if have.lower() == name.lower():
            return k
    raise ValueError(f"the table has no column {name!r}; it has {columns}")


def numbered(df: DataFrame) -> DataFrame:
    """The same rows under the names c0, c1, ...; clashing names are no obstacle afterwards. Batches of them for Python are bounded."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, under exactly these names."""
    columns = df.columns
    return numbered(df).select(*[F.col(f"c{position_of(columns, n)}").alias(n) for n in names])


def held_out(doc_id: Column) -> Column:
    """True for rows that no fit may see; a null id counts as the empty string."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(FOLDS)) == HELD_OUT


def cut_small(df: DataFrame, rows: int) -> DataFrame:
    """``cut`` of a result of at most ``rows`` rows in as few files as suit them; a large one keeps its partitions."""
    return cut(df.coalesce(8 + rows // 100_000))


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of at most ``rows`` rows and about ``size`` bytes of ``column``, a longer text alone, so that few texts are Python objects at once."""
    held = batch.column(column)
    width = pc.list_value_length(held) if pa.types.is_list(held.type) else pc.binary_length(held)
    ends = np.cumsum(pc.fill_null(width, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list], dict[str, list]]],
    adds: str,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Columns ``keep`` of ``docs`` with the columns ``adds`` computed from ``text`` in Python.

    ``make`` runs once a task and returns the function from a list of texts to
    lists of the added columns. Batches go through Arrow; no shuffle happens.
    """
    schema = ", ".join([f"`{n}` {t}" for n, t in docs.dtypes if n in keep] + [adds])
    kinds = {part.split()[0]: ARROW[part.split()[1]] for part in adds.split(", ")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            for part in slices(batch):
                found = score(part.column("text").to_pylist())
                columns = [part.column(n) for n in keep] + [pa.array(found[n], kind) for n, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *kinds])

    return docs.select(*keep, *[n for n in ("text",) if n not in keep]).mapInArrow(run, schema)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
