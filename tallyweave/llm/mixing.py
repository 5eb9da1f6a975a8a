"""Mixing sources to target weights by Pfair scheduling of blocks.

A source's rows, in an order dealt by hash, form blocks. If all sources were served at once,
each at its weight, block k of a source of weight w would go from (k - 1) / w to k / w; it is
released at the slot in which it would begin and due by the end of the one in which it would
be done, and in every slot the released block that is due first goes next. When a source has no
block left the others go on with their weights scaled up. Served so at once, the blocks fill
every slot, so whole blocks fit as well, and earliest deadline first finds such a schedule: after
any slot a source is within one block of its exact share. Weights are whole numbers of any
length in exactly the targets' proportion, and every block is placed on its own.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Mapping
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, salted_rank, salts_for

BLOCK = 64  # rows
#: Without given weights a source's target is its share of rows to this power, scaled to a sum of 1.
TEMPERATURE = 0.7
#: Up to so many blocks their places are broadcast.
BROADCAST_BLOCKS = 200_000


def whole_weights(weights: Mapping[str, float], cycle: int) -> dict[str, int]:
    """Whole numbers from 1 in proportion to the weights that add up to the cycle, by largest remainder."""
    total = sum(weights.values())
    exact = {s: w / total * cycle for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(out, key=lambda s: (int(exact[s]) - exact[s], s))
    while (gap := cycle - sum(out.values())) > 0:
        for s in order[:gap]:
            out[s] += 1
    while sum(out.values()) > cycle:
        out[max(out, key=lambda s: (out[s], s))] -= 1
    return out


def exact_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the weights; one that isn't above 0 counts as a billionth of the least."""
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0}
    least = min(exact.values(), default=Fraction(1)) / 10**9
    exact = {s: exact.get(s, least) for s in weights}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: x.numerator * (scale // x.denominator) for s, x in exact.items()}
    common = math.gcd(*whole.values()) or 1
    return {s: w // common for s, w in whole.items()}


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float], cycle: int | None = None) -> dict[str, np.ndarray]:
    """Slots of each source's blocks; all blocks are placed, from slot 0 without gaps.

    Ties between deadlines go to the heavier source, then by name. With ``cycle`` the weights
    are first rounded to whole numbers over it. Time and memory follow the number of blocks.
    """
    live = {s: weights[s] for s in blocks if blocks[s]}
    exact = exact_weights(whole_weights(live, max(cycle, len(live))) if cycle else live)
    names = sorted(live, key=lambda s: (-exact[s], s))
    n, w = [blocks[s] for s in names], [exact[s] for s in names]
    # Until virtual time v a source's share is min(n, w v) blocks; in order of their ends n / w:
    ends = sorted(range(len(names)), key=lambda i: (n[i] / w[i], Fraction(n[i], w[i])))
    at = [n[i] / w[i] for i in ends]
    ended = [0, *accumulate(n[i] for i in ends)]
    going = [*accumulate((w[i] for i in reversed(ends)), initial=0)][::-1]

    def shared(k: int, own: int) -> tuple[int, int]:
        """The real time, rounded down and up, at which a source of this weight has its share of k blocks."""
        i = bisect_right(at, k / own)
        while i < len(ends) and n[ends[i]] * own <= k * w[ends[i]]:
            i += 1
        while i and n[ends[i - 1]] * own > k * w[ends[i - 1]]:
            i -= 1
        whole, more = divmod(k * going[i], own)
        return ended[i] + whole, ended[i] + whole + (more > 0)

    slots = [np.empty(x, dtype=np.int64) for x in n]
    done, then = [0] * len(names), [0] * len(names)  # blocks placed; the next block's release
    waiting: list[tuple[int, int]] = [(0, i) for i in range(len(names))]  # (release, source)
    ready: list[tuple[int, int]] = []  # (deadline, source)
    for t in range(ended[-1]):
        while waiting and waiting[0][0] <= t:
            i = heapq.heappop(waiting)[1]
            then[i], deadline = shared(done[i] + 1, w[i])
            heapq.heappush(ready, (deadline, i))
        i = heapq.heappop(ready)[1]
        slots[i][done[i]] = t
        done[i] += 1
        if done[i] < n[i]:
            heapq.heappush(waiting, (then[i], i))
    return dict(zip(names, slots, strict=True))


def cycle_slots(weights: Mapping[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in one cycle of sum(weights) slots."""
    return {s: slots.tolist() for s, slots in schedule(weights, weights).items()}


def slots_of(slots: Mapping[str, np.ndarray], source: str, block: np.ndarray) -> np.ndarray:
    """Slots of blocks (from 0) of a source."""
    return slots[source][block]


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, order: tuple[str, ...] = ("doc_id",), temperature: float = TEMPERATURE) -> DataFrame:
    """Every row of ``docs`` with ``stream`` (its source), ``block`` and ``position``.

    Positions are gapless from 0 over all rows. ``weights`` are targets by source; a source
    without one, as a null source (named by the empty text), gets its share of rows to the power
    ``temperature``. No row is left out or repeated: when a source ends, the others go on. The
    driver holds counts by source and the slot of every block; rows meet their block's place
    in a join. ``order`` names columns that tell rows apart. An empty table gives an empty result.
    """
    keyed = docs.withColumn("stream", F.coalesce("source", F.lit("")))
    counts = {r.stream: r.n for r in keyed.groupBy("stream").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    power = {s: (n / total) ** temperature for s, n in counts.items()}
    scale = sum(power.values()) or 1.0
    target = {s: float((weights or {}).get(s, x / scale)) for s, x in power.items()}
    places = block_places(docs.sparkSession, counts, target, block)
    dealt = keyed.withColumn("_mix", F.xxhash64(*order, F.lit(29)))
    ranked = salted_rank(dealt, ["stream"], ["_mix", *order], salts_for(4 * max(counts.values(), default=0)), "_rank").drop("_mix")
    ranked = ranked.withColumn("block", F.floor(F.col("_rank") / block).cast("long"))
    placed = ranked.join(places, (F.col("stream") == F.col("_stream")) & (F.col("block") == F.col("_block")))
    return placed.withColumn("position", F.col("_first") + F.col("_rank") % block).drop("_rank", "_stream", "_block", "_first")


def block_places(spark: SparkSession, counts: Mapping[str, int], target: Mapping[str, float], block: int) -> DataFrame:
    """A row for each block of each source: _stream, _block and _first, the position of its first row."""
    blocks = {s: -(-n // block) for s, n in counts.items()}
    slots = schedule(blocks, target)
    names = list(slots)
    many = np.array([blocks[s] for s in names], dtype=np.int64)
    every = np.concatenate([np.zeros(0, dtype=np.int64), *slots.values()])
    ends = np.cumsum(many)
    missing = np.zeros(len(every) + 1, dtype=np.int64)  # only a source's last block may be short; later rows move up by what is missing
    missing[every[ends - 1] + 1] = [blocks[s] * block - counts[s] for s in names]
    found = pa.table(
        {
            "_stream": pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(names)), many))),
            "_block": pa.array(np.arange(len(every)) - np.repeat(ends - many, many), pa.int64()),
            "_first": pa.array(every * block - np.cumsum(missing)[every], pa.int64()),
        }
    )
    places = spark.createDataFrame(found, "_stream string, _block long, _first long")
    return F.broadcast(places) if len(every) <= BROADCAST_BLOCKS else places


def in_order(mixed: DataFrame, rows: int) -> DataFrame:
    """Rows dealt by ranges of position, in order within each and from one to the next."""
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionById(n, F.least(F.floor(F.col("position") * n / max(1, rows)), F.lit(n - 1)).cast("int")).sortWithinPartitions("position")


def file_order(docs: DataFrame) -> DataFrame:
    """Adds ``place``, which rises from row to row and from file to file, as :func:`in_order` had them
    written; a table that isn't read from files is taken in the order of its partitions."""
    try:
        rows = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        part, every = F.spark_partition_id(), F.monotonically_increasing_id()
        rows = docs.select("*", F.lpad(part.cast("string"), 10, "0").alias("_file"), every.bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    ends = sorted((r["_file"], r.n) for r in rows.groupBy("_file").agg((F.max("_row") + 1).alias("n")).collect())
    first = [*accumulate((n for _, n in ends), initial=0)]
    found = docs.sparkSession.createDataFrame([(f, at) for (f, _), at in zip(ends, first, strict=False)], "_name string, _first long")
    return rows.join(F.broadcast(found), F.col("_file") == F.col("_name")).withColumn("place", F.col("_first") + F.col("_row")).drop("_file", "_row", "_name", "_first")


def op7_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixing order of all documents: doc_id, source, block, position."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("_text"))
    return mix(docs, order=("doc_id", "_text")).select("doc_id", "source", "block", "position")
