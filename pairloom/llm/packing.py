"""Documents into containers of fixed capacity.

Documents are dealt into shards by a hash of their id. In each shard Karmarkar-Karp
multiway differencing merges partial partitions so that imbalances oppose each
other, giving near-equal windows; if one exceeds the capacity, there are more.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import tokens

CAPACITY = 2048
SHARD = 4096  # items balanced together
TASKS = 20_000  # of a pass at most


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item, by largest differencing: the two partial partitions of the widest spread are merged, heaviest with lightest."""
    n = len(sizes)
    if windows == 1 or not n:
        return np.zeros(n, int)
    # A partial partition: loads of its windows in rising order, less the lightest, and a tree node for each window (-1: none).
    left, right = [np.arange(n)], [np.full(n, -1)]
    count = n
    heap = []
    for i, s in enumerate(sizes.tolist()):
        loads, nodes = np.zeros(windows, np.int64), np.full(windows, -1)
        loads[-1], nodes[-1] = s, i
        heap.append((-s, i, loads, nodes))
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        loads, p, q = a + b[::-1], x, y[::-1]
        both = (p >= 0) & (q >= 0)
        nodes = np.where(p >= 0, p, q)
        made = int(both.sum())
        left.append(p[both])
        right.append(q[both])
        nodes[both] = count + np.arange(made)
        count += made
        rank = np.argsort(loads, kind="stable")
        loads, nodes = loads[rank] - loads[rank[0]], nodes[rank]
        heapq.heappush(heap, (-int(loads[-1]), order, loads, nodes))
        order += 1
    one, two = np.concatenate(left), np.concatenate(right)
    window = np.full(count, -1)
    top = heap[0][3]
    window[top[top >= 0]] = np.flatnonzero(top >= 0)
    for k in range(count - 1, n - 1, -1):
        window[one[k]] = window[two[k]] = window[k]
    return window[:n]


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The container of each item, none above capacity; every size must be at most the capacity."""
    sizes = np.asarray(sizes, np.int64)
    windows = max(1, math.ceil(sizes.sum() / capacity))
    while True:
        window = differencing(sizes, windows)
        over = np.bincount(window, sizes, windows) > capacity
        if not over.any():
            return window
        windows += max(1, int(over.sum()) // 16)


def containers(documents: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, vocabulary: str | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``<doc>, piece, first_token, tokens, container``: where each document, or piece of one above capacity, goes.

    A document above capacity fills containers of its own; what is left of it is an item
    like others (``piece`` counts from 0). Documents without tokens go along with others.
    Repeated ids are packed once; null ids are left out; null text has no tokens.
    """
    ids = documents.where(F.col(doc).isNotNull()).select(F.col(doc).alias("_d"), F.col(text).alias("_t"))
    # Repeated ids are merged once their texts are mere numbers: no text is shuffled.
    sized = cut(tokens.with_tokens(ids, "_t", "n", vocabulary).groupBy("_d").agg(F.max("n").alias("n")))
    full = F.floor(F.col("n") / capacity)
    whole = sized.where(full > 0).select("_d", F.posexplode(F.sequence(F.lit(1), full)).alias("piece", "_x"), F.lit(capacity).cast("long").alias("n")).drop("_x")
    own = F.concat(F.lit("full-"), F.col("_d").cast("string"), F.lit("-"), F.col("piece").cast("string"))
    whole = whole.select("_d", "piece", (F.col("piece") * capacity).cast("long").alias("first"), "n", own.alias("container"))
    rest = sized.where((F.col("n") % capacity > 0) | (F.col("n") == 0)).select("_d", full.cast("int").alias("piece"), (full * capacity).cast("long").alias("first"), (F.col("n") % capacity).alias("n"))
    count = rest.count()
    shards = max(1, math.ceil(count / shard))
    dealt = rest.withColumn("_s", F.pmod(F.xxhash64("_d"), F.lit(shards)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "_d"], ascending=[False, True], kind="stable")
        window = pack(rows["n"].to_numpy(), capacity)
        return rows.assign(container=[f"{s}-{w}" for s, w in zip(rows["_s"], window, strict=True)])[["_d", "piece", "first", "n", "container"]]

    # A task for each shard, up to a bound: their rows are few bytes and much work, which adaptive execution would put in few tasks.
    packed = dealt.repartition(min(shards, TASKS), "_s").groupBy("_s").applyInPandas(run, whole.schema)
    return packed.unionByName(whole).select(F.col("_d").alias(doc), "piece", F.col("first").alias("first_token"), F.col("n").alias("tokens"), "container")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, unused share, greatest load."""
    loads = packed.groupBy("container").agg(F.sum("tokens").alias("load"))
    return loads.agg(F.count("*").alias("containers"), F.sum("load").alias("tokens"), (1 - F.sum("load") / (F.count("*") * capacity)).alias("unused_share"), F.max("load").alias("max_load"))
