"""Sharding by fixed virtual slots: DataFrame and SQL functions only.

A record's slot is a hash of its id into a fixed number of slots, so a slot's content never changes. Bytes and rows are
summed per slot, and a stored, versioned map says which shard holds which slot; rebalancing or adding a shard edits the map
and moves whole slots. A slot that holds far more than its part, as where one id or none is in a third of all rows, is listed
in parts, among which its rows are dealt. All that is gathered in one place is the map, of at most SLOTS + PARTS rows, at any
corpus size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import folder, keep

SLOTS = 4096
#: A part of a slot holds about 1 / PARTS of all bytes at most; rows that are numbered together.
PARTS, TOGETHER = 1024, 1 << 20


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a key; a null key has a slot as well."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, a null having none, plus 8), text_crc32 (0 for a null), vslot, and row, a number of the row that holds once it is written."""
    key, text = docs[id_col], docs[text_col]
    return docs.select(
        key.cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        slot_of(key, slots).alias("vslot"),
        F.monotonically_increasing_id().alias("row"),
    )


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS, parts: int = PARTS) -> DataFrame:
    """vslot, part, parts, bytes, rows: every slot, also one without rows, in as many parts as its share of all bytes asks for.

    bytes and rows of a part are those of the slot over its parts, until part_sizes measures them.
    """
    known = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot")).join(F.broadcast(_summed(rows, "vslot")), "vslot", "left").na.fill(0)
    total = max(1, known.agg(F.sum("bytes")).first()[0])
    cut = known.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("bytes") * F.lit(parts) / F.lit(total) / 4)).cast("int"))
    share = lambda c: F.expr(f"{c} div parts").alias(c)
    return cut.select("vslot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts", share("bytes"), share("rows"))


def dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows with the part of their slot that they go to. sizes is bounded, so it is broadcast."""
    parts = sizes.where("part = 0").select("vslot", "parts")
    return rows.join(F.broadcast(parts), "vslot").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")


def part_sizes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """sizes with the bytes and rows that their parts have."""
    return sizes.select("vslot", "part", "parts").join(F.broadcast(_summed(rows, "vslot", "part")), ["vslot", "part"], "left").na.fill(0)


#: One step for each slot: it stays where it is if its shard is ahead of the least loaded one by less than the slot, or else goes there, to the first of several.
_BALANCE = """
aggregate(
  slots,
  named_struct('loads', array_repeat(cast(0 as bigint), {n}), 'shards', cast(array() as array<int>)),
  (a, s) -> transform(array(if(s.shard is not null and a.loads[s.shard] < array_min(a.loads) + s.bytes, s.shard, cast(array_position(a.loads, array_min(a.loads)) - 1 as int))),
    k -> named_struct('loads', transform(a.loads, (x, j) -> if(j = k, x + s.bytes, x)), 'shards', concat(a.shards, array(k))))[0],
  a -> a.shards)
"""
#: One step for each slot: it moves to the new shard if its own shard stays at the target or above it and the new one below.
_GROW = """
aggregate(
  slots,
  named_struct('loads', loads, 'taken', cast(0 as bigint), 'shards', cast(array() as array<int>)),
  (a, s) -> if(a.loads[s.shard] - s.bytes >= target - s.bytes div 2 and a.taken + s.bytes <= target + s.bytes div 2,
    named_struct('loads', transform(a.loads, (x, j) -> if(j = s.shard, x - s.bytes, x)), 'taken', a.taken + s.bytes,
      'shards', concat(a.shards, array({n}))),
    named_struct('loads', a.loads, 'taken', a.taken, 'shards', concat(a.shards, array(s.shard)))),
  a -> a.shards)
"""


def _listed(slot_map: DataFrame) -> DataFrame:
    """One row: the map's units from the largest down."""
    order = F.struct((-F.col("bytes")).alias("order"), "vslot", "part", "parts", "bytes", "rows", "shard")
    return slot_map.agg(F.array_sort(F.collect_list(order)).alias("slots"), F.max("version").alias("version"))


def _mapped(listed: DataFrame, shards: str) -> DataFrame:
    return listed.select("version", "slots", F.expr(shards).alias("shards")).select("version", F.inline(F.arrays_zip("slots", "shards"))).select(
        "version", "slots.vslot", "slots.part", "slots.parts", F.col("shards").alias("shard"), "slots.bytes", "slots.rows"
    )


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1: slots dealt to shards in turn, whatever they hold."""
    return sizes.select(F.lit(1).alias("version"), "vslot", "part", "parts", F.pmod(F.col("vslot") + F.col("part"), F.lit(shards)).cast("int").alias("shard"), "bytes", "rows")


def balanced_map(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version, in which shards are near equal in bytes: slots from the largest down stay where they are unless their shard is ahead, or go to the least loaded."""
    listed = _listed(slot_map).select((F.col("version") + 1).alias("version"), "slots")
    return _mapped(listed, _BALANCE.format(n=shards))


def grown_map(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of a map of so many shards, with one more: slots move to the new shard only, till it has its part."""
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda j: F.aggregate(F.filter("slots", lambda s: s["shard"] == j), F.lit(0).cast("long"), lambda a, s: a + s["bytes"]),
    )
    listed = _listed(slot_map).select((F.col("version") + 1).alias("version"), "slots", loads.alias("loads"))
    # What the least loaded shard has when all give alike: one very long text does not raise it.
    listed = listed.withColumn("target", F.expr(f"array_min(loads) * {shards} div {shards + 1}"))
    return _mapped(listed, _GROW.format(n=shards))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Store a version beside the others, which stay readable; storing it again replaces it, so a retry does no harm."""
    version = slot_map.agg(F.max("version")).first()[0]
    if version is not None:
        slot_map.where(F.col("version") == version).drop("version").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, or the latest."""
    stored = spark.read.parquet(path)
    if version is None:
        return stored.join(F.broadcast(stored.agg(F.max("version").alias("version"))), "version")
    return stored.where(F.col("version") == version)


def placed(rows: DataFrame, slot_map: DataFrame, together: int = TOGETHER) -> DataFrame:
    """rows with shard and slot, the row's place in its shard, gapless from 0.

    Places follow the map's units in turn, then doc_id in a unit. Units of many rows are numbered in chunks, so no task numbers
    more than about so many rows; the first places of chunks come from counts, of which there are rows / together + SLOTS + PARTS.
    """
    unit = slot_map.select("vslot", "part", "shard", F.greatest(F.lit(1), F.ceil(F.col("rows") / together)).cast("int").alias("chunks"))
    own = rows.join(F.broadcast(unit), ["vslot", "part"]).withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(1)), F.col("chunks")).cast("int")).drop("chunks")
    before = Window.partitionBy("shard").orderBy("vslot", "part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy("shard", "vslot", "part", "chunk").agg(F.count(F.lit(1)).alias("rows")).select("vslot", "part", "chunk", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    at = F.row_number().over(Window.partitionBy("vslot", "part", "chunk").orderBy("doc_id", "text_crc32", "size", "row"))
    numbered = own.withColumn("at", at.cast("long") - 1)
    return numbered.join(starts.hint("shuffle_hash"), ["vslot", "part", "chunk"]).withColumn("slot", F.col("start") + F.col("at"))


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", maps: str | None = None, together: int = TOGETHER) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null under this law), vslot, version, for every row of docs.

    A null text has no bytes and CRC 0; a text of any length counts in full and is not split; rows with a null or repeated id are
    placed like any other, and where they are very many they are dealt among parts of their slot; rows that tie are numbered by
    their place in the input; no rows give no rows; further columns, of whatever names, are ignored. Sizes of shards differ by at
    most the largest part of a slot. Versions of the map are stored under maps (a folder of this run's own, if none is given):
    the first deals slots in turn, the second is the first one edited by what slots hold, and rows are placed by the one stored last.
    """
    rows = keep(sized(docs, id_col, text_col, slots), "sized")
    sizes = keep(slot_sizes(rows, slots), "slot-sizes")
    rows = dealt(rows, sizes)
    path = maps or f"{folder(docs.sparkSession)}/tessera-maps-{uuid.uuid4().hex}"
    save_map(first_map(part_sizes(rows, sizes), shards), path)
    save_map(balanced_map(load_map(docs.sparkSession, path, 1), shards), path)
    return placed(rows, load_map(docs.sparkSession, path, 2), together).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(2).alias("version")
    )
