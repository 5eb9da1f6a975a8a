"""K-d tree sharding with DataFrame functions only.

Units are groups of equal texts. The few heavy ones go whole to shards with room for them; the tree splits a node's other units along its widest metadata
dimension at the weighted quantile that gives each side its share of the room left in its leaves,
until every leaf holds the target bytes. A quantile is found from small histograms of all units, refined
where the quantile falls; the driver sees histograms and splits only, never units.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, salted_rank, salts_for

SHARDS = 24
#: A group of equal texts above this share of a leaf's bytes is placed before the tree; there are 25 a shard at most.
HEAVY = 1 / 25
#: A split is settled when the undecided bytes are under this share of a leaf's.
TOLERANCE = 1 / 1000
BINS = 256
_HASH_BITS = 30
GROUP = ("text_crc32", "size", "_h")
DIMENSIONS = ("source", "lang", "length", "doc_id")


def _hashed(c: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(1 << 20))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_h"),
    )


def _heavy(rows: DataFrame, leaf_bytes: float, shards: int) -> tuple[DataFrame, list[float]]:
    """Groups of equal texts above HEAVY of a shard with their ``_shard``, and the room that they leave in
    each shard. The largest goes first, to the shard in which it leaves least room. A group that fits
    nowhere, as one above a shard, has ``_parts`` instead: it falls apart into units of a few rows."""
    groups = rows.groupBy(*GROUP).agg(F.sum("size").alias("_b")).filter(F.col("_b") > HEAVY * leaf_bytes).filter(F.col("_b") > F.col("size"))
    room, out = [leaf_bytes] * shards, []
    for g in groups.orderBy(F.desc("_b"), *GROUP).collect():
        fits = [i for i in range(shards) if room[i] >= g["_b"]]
        i = min(fits, key=lambda i: (room[i], i)) if fits else None
        if i is not None:
            room[i] -= g["_b"]
        out.append((*[g[c] for c in GROUP], i, None if fits else math.ceil(g["_b"] / max(g["size"], HEAVY * leaf_bytes))))
    kinds = dict(rows.dtypes)
    return rows.sparkSession.createDataFrame(out, ", ".join([*(f"g_{c} {kinds[c]}" for c in GROUP), "_shard int", "_parts long"])), room


def _units(rows: DataFrame, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_shard`` or else their unit's key, and the units: key, bytes and dimensions."""
    on = functools.reduce(Column.__and__, [F.col(c) == F.col(f"g_{c}") for c in GROUP])
    keyed = rows.join(F.broadcast(heavy), on, "left")
    part = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("_parts"))).otherwise(F.lit(0))
    keyed = keyed.withColumn("unit", F.xxhash64(*GROUP, part)).drop("_parts", "_h", *[f"g_{c}" for c in GROUP])
    units = keyed.filter("_shard IS NULL").groupBy("unit").agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("doc_id"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.min("size").alias("size"))
    return keyed, units


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    The law is ``bytes``: sizes of shards are near equal. Equal texts share a shard, save groups
    that no shard has room for, above all those larger than one, which are dealt by rows.
    Null text counts as empty (size 8); null metadata is a value of its own; repeated rows count
    each. Slots are gapless from 0 by a salted rank. An empty table gives an empty result; with
    fewer units than shards some shards stay empty.
    """
    rows = materialize(_rows(docs), "shard-rows")
    totals = rows.agg(F.sum("size"), F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    total, low, high, n = totals[0] or 0, totals[1] or 0, totals[2] or 0, totals[3]
    leaf_bytes = max(1.0, total / shards)
    heavy, room = _heavy(rows, leaf_bytes, shards)
    keyed, units = _units(rows, heavy)
    keyed = materialize(keyed, "shard-keys")
    span = max(1, high - low)
    tie = F.pmod(F.xxhash64("unit", F.lit(3)), F.lit(1 << _HASH_BITS))
    units = materialize(
        units.select(
            "unit", "bytes", tie.alias("tie"), _hashed(F.coalesce("source", F.lit("\x00")), 1).alias("source"), _hashed(F.coalesce("lang", F.lit("\x00")), 2).alias("lang"),
            F.least(F.lit((1 << 20) - 1), F.floor(F.log2(F.col("size").cast("double")) / 40 * (1 << 20))).cast("long").alias("length"),
            F.floor((F.coalesce("doc_id", F.lit(low)) - low).cast("double") / span * ((1 << 20) - 1)).cast("long").alias("doc_id"),
        ).select("unit", "bytes", *[(F.col(d) * (1 << _HASH_BITS) + F.col("tie")).alias(d) for d in DIMENSIONS]), "shard-units",
    )
    place = {d: F.col(d) for d in DIMENSIONS}  # ties along a dimension are told apart by the unit's hash

    nodes: list[tuple[int, int, Column]] = [(0, shards, F.lit(True))]  # first shard, shards, condition
    while any(k > 1 for _, k, _ in nodes):
        splits = [x for x in nodes if x[1] > 1]
        node = F.coalesce(*[F.when(c, F.lit(i)) for i, (_, _, c) in enumerate(splits)])
        spread = [f(d).alias(f"{name}_{d}") for d in DIMENSIONS for name, f in (("a", F.min), ("b", F.max))]
        facts = {r["node"]: r for r in units.withColumn("node", node).filter("node IS NOT NULL").groupBy("node").agg(F.sum("bytes").alias("bytes"), *spread).collect()}
        open_: dict[int, list] = {}  # node: dimension, range of places, bytes below it, bytes wanted below the cut
        cuts: dict[int, tuple[str, int]] = {}
        for i, (first, k, _) in enumerate(splits):
            if i not in facts:
                cuts[i] = ("length", 0)
                continue
            f = facts[i]
            d = max(DIMENSIONS, key=lambda d: f[f"b_{d}"] - f[f"a_{d}"])
            left, both = sum(room[first : first + k // 2]), sum(room[first : first + k])
            open_[i] = [d, f[f"a_{d}"], f[f"b_{d}"] + 1, 0, f["bytes"] * (left / both if both else (k // 2) / k)]
        while open_:
            at = F.coalesce(*[F.when((F.col("_node") == i) & (place[d] >= a) & (place[d] < b), F.struct(F.lit(i).alias("node"), F.least(F.lit(BINS - 1), F.floor((place[d] - a).cast("double") * BINS / (b - a))).cast("int").alias("bin"), place[d].alias("place"))) for i, (d, a, b, _, _) in open_.items()])
            found = units.withColumn("_node", node).select(at.alias("_at"), "bytes").filter("_at IS NOT NULL").groupBy("_at.node", "_at.bin").agg(F.sum("bytes").alias("bytes"), F.min("_at.place").alias("a"), F.max("_at.place").alias("b")).collect()
            for i in list(open_):
                d, a, b, below, wanted = open_[i]
                for r in sorted((r for r in found if r["node"] == i), key=lambda r: r["a"]):
                    if below + r["bytes"] <= wanted:
                        below += r["bytes"]
                        continue
                    if r["bytes"] <= TOLERANCE * leaf_bytes or r["a"] == r["b"]:
                        cuts[i] = (d, r["a"] if wanted - below <= r["bytes"] / 2 else r["b"] + 1)
                        del open_[i]
                    else:
                        open_[i] = [d, r["a"], r["b"] + 1, below, wanted]
                    break
                else:
                    cuts[i] = (d, b)
                    del open_[i]
        grown = [x for x in nodes if x[1] == 1]
        for i, (first, k, c) in enumerate(splits):
            d, cut = cuts[i]
            left = place[d] < cut
            grown += [(first, k // 2, c & left), (first + k // 2, k - k // 2, c & ~left)]
        nodes = grown
    leaf = F.coalesce(*[F.when(c, F.lit(first)) for first, _, c in nodes]).cast("int")
    placed = keyed.join(units.select("unit", leaf.alias("_leaf")), "unit", "left").select("doc_id", "size", "text_crc32", F.coalesce("_shard", "_leaf").alias("shard"))
    ranked = salted_rank(placed, ["shard"], ["doc_id", "text_crc32", "size"], salts_for(n // max(1, shards)), "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
