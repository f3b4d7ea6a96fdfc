"""Sharding by best-fit-decreasing bin packing of groups that must stay together."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import stored
from strandframe.plans.scan import running


def best_fit(sizes: list[tuple[int, str]], capacity: int, bins: int | None = None) -> dict[str, int]:
    """Item -> bin: largest first, each into the bin with the tightest remaining room (an ordered list of rooms).

    Without ``bins`` a new bin opens when none has room.  With ``bins``, that many
    are open from the start and an item without a place goes where most room is.
    """
    rooms, opened = [(capacity, i) for i in range(bins or 0)], bins or 0
    out = {}
    for size, name in sorted(sizes, key=lambda x: (-x[0], x[1])):
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, i = rooms.pop(at)
        elif bins:
            room, i = rooms.pop()
        else:
            room, i, opened = capacity, opened, opened + 1
        out[name] = i
        insort(rooms, (room - size, i))
    return out


def packed(docs: DataFrame, shards: int = 16, pieces: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs`` (doc_id, text), law ``bytes``.

    Size is the UTF-8 length plus one (null: one).  Rows of equal text, null
    texts included, are one group and stay in one shard; only a group larger than
    a shard is cut, by row hash, into parts of about a ``pieces``-th of a shard.
    Groups below a ``pieces``-th of a shard are first packed to pieces in parallel; the
    pieces and larger groups, at most a few ``shards * pieces``, are then packed
    into the shards on the driver.  Slots follow a hash order inside a shard.
    An empty table gives no rows; repeated and null doc_ids are rows like any other.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    text = F.col("text")
    rows = docs.select(
        "doc_id", size.alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"),
        F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("null")).alias("_group"), F.monotonically_increasing_id().alias("_rid"),
    )
    rows = stored(rows, "rows")
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    room = max(1, -(-total // shards))
    piece = max(1, room // pieces)
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_gs"))
    wide = groups.where(F.col("_gs") > room).withColumn("_parts", F.ceil(F.col("_gs") / piece).cast("int")).select("_group", "_parts")
    part = F.concat_ws(":", "_group", F.pmod(F.xxhash64("_rid"), F.col("_parts")))
    rows = stored(rows.join(wide, "_group", "left").withColumn("_item", F.when(F.col("_parts").isNull(), F.col("_group")).otherwise(part)).drop("_parts"), "items")
    items = rows.groupBy("_item").agg(F.sum("size").alias("_is"))
    buckets = max(32, n_rows // 200_000)

    def pack(key, frame: pd.DataFrame) -> pd.DataFrame:
        got = best_fit(list(zip(frame["_is"].tolist(), frame["_item"].tolist(), strict=True)), piece)
        return pd.DataFrame({"_item": list(got), "_piece": [f"{key[0]}:{i}" for i in got.values()]})

    small = items.where(F.col("_is") < piece).withColumn("_b", F.pmod(F.xxhash64("_item"), F.lit(buckets)))
    small = small.groupBy("_b").applyInPandas(pack, "_item string, _piece string")
    put = stored(small.unionByName(items.where(F.col("_is") >= piece).select("_item", F.col("_item").alias("_piece"))).join(items, "_item"), "pieces")
    sizes = [(r["s"], r["_piece"]) for r in put.groupBy("_piece").agg(F.sum("_is").alias("s")).collect()]  # about shards * pieces + buckets
    spark: SparkSession = docs.sparkSession
    where = spark.createDataFrame(list(best_fit(sizes, room, shards).items()), "_piece string, shard int")
    home = put.join(F.broadcast(where), "_piece").select("_item", "shard")
    placed = rows.join(home, "_item").withColumn("_o", F.xxhash64("_rid")).withColumn("_blk", F.shiftright("_o", 56).cast("int"))
    placed = placed.withColumn("_one", F.lit(1).cast("long"))
    numbered = running(placed, ["shard"], ["_o"], "_blk", [("slot", "_one", "sum", "before")])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.coalesce("slot", F.lit(0)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
