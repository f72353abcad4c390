"""What the operators share: tables, lineage cuts, folds, skew-proof lookups and grouped streaming."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulore.plans.shared import shared_folder

#: Where the C library has it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: ASCII white space, as in the class [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: A key is frequent if one row in so many has it, so there are fewer frequent keys: between the two, such that others have
#: a million rows at most, and a ten-thousandth of all rows beyond 10 ** 10 rows. 10,000 is the most that freqItems takes.
LEAST_FREQUENT, MOST_FREQUENT, RARE_ROWS = 512, 10_000, 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which checkpoints use too."""
    found = shared_folder(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors don't bring its lineage back."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As cut(), in Parquet, which takes less room than a checkpoint. What the driver no longer needs of earlier steps,
    their shuffle files among it, is let go: Spark does that when its driver collects garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    for _ in range(2):  # the first round lets go of what refers to the shuffles, the second of the shuffles
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)
    return spark.read.schema(df.schema).parquet(path)


def is_held_out(doc_id: Column) -> Column:
    """Whether the document belongs to the held-out quarter; a null doc_id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def frequent_one_in(rows: int) -> int:
    return min(MOST_FREQUENT, max(LEAST_FREQUENT, rows // RARE_ROWS))


def lookup(big: DataFrame, small: DataFrame, key: str, count: str, most: int = MOST_FREQUENT) -> DataFrame:
    """big left joined with small, which has a row for each non-null key and in `count` the number of rows that
    the key has in big. Frequent keys, of which there are fewer than `most`, are joined by broadcast, so
    no task gets all the rows of one; the rest are shuffled. `count` is dropped."""
    total = small.agg(F.sum(count)).first()[0] or 0
    at_least = max(1, total // min(most, frequent_one_in(total)))
    often = small.filter(F.col(count) > at_least).drop(count)
    rare = small.filter(F.col(count) <= at_least).drop(count)
    met = big.join(F.broadcast(often), key)
    rest = big.join(F.broadcast(often.select(key)), key, "left_anti").join(rare, key, "left")
    return met.unionByName(rest)


def release() -> None:
    """Give the memory that a Python worker no longer uses back to the machine; it would keep it for its next tasks, beside an
    executor's heap that other stages have filled."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a task's function of batches, with what it used given back at its end."""

    def each(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return each


def by_key(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The groups of a partition that is sorted by key, one at a time."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        values = batch[key].to_numpy()
        starts = np.flatnonzero(values[1:] != values[:-1]) + 1
        bounds = [0, *starts.tolist(), len(batch)]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            part = batch.iloc[lo:hi]
            if held and held[0][key].iloc[0] != part[key].iloc[0]:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def in_groups(df: DataFrame, key: str, order: list[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run over each group of key, its rows sorted by order; groups stream, so a task holds one at a time."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in by_key(batches, key):
            yield run(group)

    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInPandas(releasing(each), schema)
