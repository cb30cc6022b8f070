"""A sample that stays as it is when data is added.

Each record keeps the epoch in which it was first seen, each epoch the rate frozen
for it then. A record is in the sample if a counter-based random number keyed by its
identifier is below its epoch's rate: the same in every run and partitioning, and
never changed by records that come later, nor by a new rate for new epochs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 52  # of each random number
SEED = "pairloom-sample-1"


def draw(key: Column | str, counter: int = 0, seed: str = SEED) -> Column:
    """The ``counter``-th number of a record, uniform in [0, 1): the generator is SHA-256 in counter mode, keyed by identifier and seed."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed), F.lit(str(counter)), F.col(key) if isinstance(key, str) else key), 256)
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long") / F.lit(float(1 << BITS))


def first_epochs(seen: DataFrame, key: str, epoch: str) -> DataFrame:
    """``key, first_epoch``: the earliest epoch of each key. Null keys and epochs are left out."""
    return seen.where(F.col(key).isNotNull() & F.col(epoch).isNotNull()).groupBy(key).agg(F.min(epoch).alias("first_epoch"))


def stable_sample(records: DataFrame, epochs: DataFrame, rates: DataFrame, key: str, seed: str = SEED) -> DataFrame:
    """``key, first_epoch, rate, draw`` of the sampled keys of ``records``, each key once.

    ``epochs`` has ``key, first_epoch``; ``rates`` has ``epoch, rate``. A key without an
    epoch or a rate can't be sampled. Repeated rows count once; other columns are ignored.
    """
    # Draws above the highest rate are dropped before anything is shuffled.
    top = rates.agg(F.max("rate")).first()[0]
    low = draw(key, seed=seed) < F.lit(-1.0 if top is None else top)
    ids = records.select(key).where(F.col(key).isNotNull() & low).distinct().withColumn("draw", draw(key, seed=seed))
    return ids.join(epochs.where(low), key).join(rates, F.col("first_epoch") == F.col("epoch")).where(F.col("draw") < F.col("rate")).select(key, "first_epoch", "rate", "draw")


class Ledger:
    """First-seen epochs and frozen rates on disk: tables of ids with their epoch, and tables of epochs with their rate, one for each time something new was observed."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def epochs(self) -> DataFrame | None:
        """``key, first_epoch`` of all keys observed so far."""
        return self.spark.read.parquet(f"{self.path}/ids/*") if self._exists("ids") else None

    def rates(self) -> DataFrame:
        """``epoch, rate`` of the frozen epochs."""
        schema = "epoch long, rate double"
        return self.spark.read.schema(schema).json(f"{self.path}/rates/*") if self._exists("rates") else self.spark.createDataFrame([], schema)

    def observe(self, records: DataFrame, key: str, epoch: str, rate: float | Callable[[int], float]) -> None:
        """Register keys of ``records`` that were not seen before, each under its earliest epoch; epochs without a rate get theirs, for good.

        ``rate``: of new epochs, one number or a function of the epoch. Null keys and epochs are left out. What was
        registered before stays as it is, so a failed attempt can be repeated.
        """
        ids, known = first_epochs(records, key, epoch), self.epochs()
        if known is not None:
            ids = ids.join(known, key, "left_anti")
        ids.write.parquet(f"{self.path}/ids/{uuid.uuid4().hex}")
        # Rates are written last: an epoch without one gives no sample. There are as many as epochs.
        first = self.epochs().select(F.col("first_epoch").cast("long").alias("epoch")).distinct()
        fresh = [(e, float(rate(e) if callable(rate) else rate)) for e in sorted(r.epoch for r in first.join(self.rates(), "epoch", "left_anti").collect())]
        if fresh:
            self.spark.createDataFrame(fresh, "epoch long, rate double").coalesce(1).write.json(f"{self.path}/rates/{uuid.uuid4().hex}")

    def add(self, records: DataFrame, key: str, epoch: int, rate: float) -> None:
        """Register all keys of ``records`` not seen before under one new epoch."""
        if self.rates().where(F.col("epoch") == epoch).count():
            raise ValueError(f"epoch {epoch} is frozen")
        self.observe(records.select(key).withColumn("_epoch", F.lit(epoch).cast("long")), key, "_epoch", rate)
