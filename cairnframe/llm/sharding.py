"""Sharding by vector bin packing.

Rows are grouped by equal text. A group is a vector (bytes, tokens, rows); each is placed in the shard whose residual
capacity has the highest dot product with it. What the driver packs is bounded at every size: groups are gathered into
`bundles` hash bundles, and only groups that hold more than 1 / (`per_shard` * shards) of a dimension's total
(at most 3 * per_shard * shards of them) are packed on their own. A group that alone exceeds a shard's capacity can't stay
whole; it is dealt in equal pieces by doc_id.

Defined results: a null text has no bytes or tokens and is a group of its own; rows that are the same in id and text are
separate rows with slots of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_JAVA, Stored

DIMENSIONS = ("size", "tokens", "n_rows")


def pack(items: np.ndarray, shards: int, weights=(4.0, 1.0, 1.0)) -> np.ndarray:
    """The shard of each row of items (any non-negative dimensions).

    Items go from the largest to the smallest, each to the shard with the highest dot product of the item with the
    residual capacity; the weights say how much a dimension's balance counts.
    """
    total = items.sum(0)
    unit = np.divide(items, total / shards, out=np.zeros(items.shape), where=total > 0) * np.sqrt(np.asarray(weights)[: items.shape[1]])
    residual = np.tile(np.sqrt(np.asarray(weights)[: items.shape[1]]), (shards, 1))
    out = np.zeros(len(items), np.int32)
    for i in np.lexsort((np.arange(len(items)), -unit.max(1, initial=0))):
        s = int(np.argmax(residual @ unit[i]))
        residual[s] -= unit[i]
        out[i] = s
    return out


def shard(spark: SparkSession, docs: DataFrame, shards: int = 8, bundles: int = 8192, per_shard: int = 256, sub_buckets: int = 65_536) -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard, slot for every row of docs (doc_id, text)."""
    store = Stored(spark, "sharding")
    text = F.coalesce("text", F.lit(""))
    rows = store.write(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.regexp_count(text, F.lit(WORD_JAVA)).cast("long").alias("tokens"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text, F.col("text").isNull()).alias("g1"),
        )
    )
    group = ["g1", "text_crc32", "size"]
    spread = F.pmod(F.xxhash64(*group, F.lit(1)), F.lit(bundles)).cast("long")
    groups = rows.groupBy(*group).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows")).select(*group, spread.alias("item"), (F.col("size") * F.col("n_rows")).alias("bytes"), "tokens", "n_rows")
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()
    if not total[2]:
        total = (0, 0, 0)
    limit = [t / (per_shard * shards) for t in total]
    heavy_if = (F.col("bytes") > limit[0]) | (F.col("tokens") > limit[1]) | (F.col("n_rows") > limit[2])
    heavy = groups.where(heavy_if).collect()  # at most 3 * per_shard * shards rows
    light = groups.where(~heavy_if).groupBy("item").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("n_rows").alias("n_rows")).collect()  # at most `bundles` rows

    items, vectors, split = [], [], []
    for r in light:
        items.append(r["item"])
        vectors.append((r["bytes"], r["tokens"], r["n_rows"]))
    following = bundles
    for r in sorted(heavy, key=lambda r: (r["g1"], r["text_crc32"], r["size"])):
        fair = max(1.0, *(v * shards / t for v, t in zip((r["bytes"], r["tokens"], r["n_rows"]), total) if t))
        n = 1 if fair <= 1 else shards * int(np.ceil(fair))
        split.append((r["g1"], r["text_crc32"], r["size"], following, n))
        if n == 1:
            items.append(following)
            vectors.append((r["bytes"], r["tokens"], r["n_rows"]))
        following += n
    heavies = F.broadcast(spark.createDataFrame(split, "g1 long, text_crc32 long, size long, first_item long, n long").coalesce(1))
    salt = lambda n, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), n)
    piece = F.col("first_item") + salt(F.col("n"), 2)
    if any(n > 1 for *_, n in split):
        # What the pieces really hold: at most shards * 3 * (shards + 1) of them.
        for r in rows.join(heavies.where("n > 1"), group).groupBy(piece.alias("item")).agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows")).collect():
            items.append(r["item"])
            vectors.append((r["bytes"], r["tokens"], r["n_rows"]))
    placed = pack(np.array(vectors, float).reshape(-1, 3), shards)

    # Slots: rows are dealt to about sub_buckets parts of at most a few bundles' worth, whose counts give each part its first slot.
    each = max(1.0, total[2] / sub_buckets)
    of_item = [(int(i), int(s), int(np.ceil(max(1.0, v[2] / each)))) for i, s, v in zip(items, placed, vectors)]
    places = F.broadcast(spark.createDataFrame(of_item, "item long, shard int, parts int").coalesce(1))
    dealt = (
        rows.join(heavies, group, "left")
        .withColumn("item", F.when(F.col("n").isNull(), spread).otherwise(piece))
        .join(places, "item")
        .select("doc_id", "size", "tokens", "text_crc32", "g1", "shard", "item", salt(F.col("parts"), 3).alias("part"))
    )
    counts = sorted(dealt.groupBy("shard", "item", "part").count().collect())  # at most sub_buckets + items rows
    firsts, taken = [], {}
    for s, item, part, n in counts:
        firsts.append((item, part, taken.get(s, 0)))
        taken[s] = taken.get(s, 0) + n
    firsts = F.broadcast(spark.createDataFrame(firsts, "item long, part long, first_slot long").coalesce(1))
    within = Window.partitionBy("item", "part").orderBy("doc_id", "text_crc32", "size", "g1")
    return (
        dealt.withColumn("nth", F.row_number().over(within))
        .join(firsts, ["item", "part"])
        .select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("first_slot") + F.col("nth") - 1).alias("slot"))
    )
