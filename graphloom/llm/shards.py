"""Sharding over fixed virtual slots: records hash into slots, and a versioned map from slots to shards is edited to rebalance."""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._shared import shared_dir, staged

#: Slots never change in number; a record's slot never changes either. SHARDS may.
SLOTS, SHARDS = 8192, 40
#: Bytes that a record has besides its text.
OVERHEAD = 16
MAP = "version int, slot int, shard int, bytes long"


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, uid): what a record weighs. uid tells rows apart within one reading of the table."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("uid"))


def with_slots(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """rows and virtual_slot, a hash of the record's content.

    Rows alike in all columns would share a slot however many they are, and a slot can't be split between shards. Those of which
    there are enough to outweigh an average slot are dealt over all slots by uid. There are at most `slots` such kinds of rows, as
    each holds more than 1/slots of all bytes, so sending them to every task is bounded.
    """
    h = F.xxhash64("doc_id", "size", "text_crc32")
    keyed = rows.withColumn("h", h)
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()["total"]
    kinds = keyed.groupBy("h").agg(F.count("*").alias("n"), F.sum("size").alias("held"))
    heavy = kinds.where((F.col("n") > 1) & (F.col("held") * slots > total)).select("h", F.lit(True).alias("heavy"))
    dealt = keyed.join(F.broadcast(heavy), "h", "left")
    of = F.when(F.col("heavy"), F.xxhash64("h", "uid")).otherwise(F.xxhash64("h"))
    return dealt.withColumn("virtual_slot", F.pmod(of, F.lit(slots)).cast("int")).drop("heavy")


# ---------------------------------------------------------------- the map: one row a slot, so at most SLOTS rows on the driver


def first_map(bytes_of: dict[int, int], slots: int = SLOTS, shards: int = SHARDS) -> list[tuple[int, int, int, int]]:
    """Version 0: slots in equal ranges."""
    return [(0, s, s * shards // slots, bytes_of.get(s, 0)) for s in range(slots)]


def _loads(held: dict[int, list[tuple[int, int]]]) -> dict[int, int]:
    return {k: sum(b for b, _ in v) for k, v in held.items()}


def rebalance(rows: list[tuple[int, int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """The next version: slots leave shards that hold more than the mean, largest first as far as they fit into the excess, and go
    to the emptiest shard. Then the fullest shard gives a slot to the emptiest, or swaps two, while that narrows their gap.
    Slots of shards that are no more leave as well."""
    version = max(v for v, *_ in rows) + 1
    weight = {s: b for _, s, _, b in rows}
    held: dict[int, list[tuple[int, int]]] = {k: [] for k in range(shards)}
    pool = []
    for _, s, k, b in rows:
        (held[k] if k in held else pool).append((b, s))
    total = sum(weight.values())
    for v in held.values():
        excess = sum(b for b, _ in v) - total // shards
        for item in sorted(v, reverse=True):
            if 0 < item[0] <= excess:
                v.remove(item)
                pool.append(item)
                excess -= item[0]
    load = _loads(held)
    heap = [(n, k) for k, n in load.items()]
    heapq.heapify(heap)
    for item in sorted(pool, reverse=True):
        n, k = heapq.heappop(heap)
        held[k].append(item)
        heapq.heappush(heap, (n + item[0], k))
    load = _loads(held)
    for _ in range(16 * shards):
        low, high = min(load, key=lambda k: (load[k], k)), max(load, key=lambda k: (load[k], -k))
        gap = load[high] - load[low]
        give, take = sorted(held[high]), sorted([*held[low], (0, -1)])
        best = (gap, None, None)  # what is left of the gap; a slot of 0 bytes that isn't there makes a swap a gift
        j = 0
        for a in give:
            while j + 1 < len(take) and abs(gap - 2 * (a[0] - take[j + 1][0])) <= abs(gap - 2 * (a[0] - take[j][0])):
                j += 1
            left = abs(gap - 2 * (a[0] - take[j][0]))
            if a[0] > take[j][0] and left < best[0]:
                best = (left, a, take[j])
        if best[1] is None:
            break
        _, a, b = best
        held[high].remove(a)
        held[low].append(a)
        if b[1] >= 0:
            held[low].remove(b)
            held[high].append(b)
        load[high], load[low] = load[high] - a[0] + b[0], load[low] + a[0] - b[0]
    return sorted((version, s, k, weight[s]) for k, v in held.items() for _, s in v)


def grow(rows: list[tuple[int, int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """The next version with one shard more, number `shards`: it takes slots from the others, the fullest first, until it holds its
    share of bytes; no slot moves between the others."""
    version = max(v for v, *_ in rows) + 1
    held: dict[int, list[tuple[int, int]]] = {k: [] for k in range(shards)}
    for _, s, k, b in rows:
        held[k].append((b, s))
    share = sum(b for *_, b in rows) // (shards + 1)
    heap = [(-n, k) for k, n in _loads(held).items()]
    heapq.heapify(heap)
    new: list[tuple[int, int]] = []
    have = 0
    while heap and have < share:
        n, k = heapq.heappop(heap)
        fits = [x for x in held[k] if 0 < x[0] <= min(share - have, max(-n - share, share // shards))]
        if fits:
            x = max(fits)
            held[k].remove(x)
            new.append(x)
            have += x[0]
            heapq.heappush(heap, (n + x[0], k))
    return sorted((version, s, k, b) for k, v in [*held.items(), (shards, new)] for b, s in v)


def write_map(spark: SparkSession, path: str, rows: list[tuple[int, int, int, int]]) -> None:
    """Adds a version to the stored map; earlier ones stay."""
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> list[tuple[int, int, int, int]]:
    """A version of the stored map, the latest if none is named."""
    stored = spark.read.schema(MAP).parquet(path)
    latest = stored.agg(F.max("version")).first()[0] if version is None else version
    return sorted(tuple(r) for r in stored.where(F.col("version") == latest).collect())


def _numbered(rows: DataFrame) -> DataFrame:
    """rows and slot, their place in their shard from 0, in the order of content. Sorting deals rows by range and rows alike by
    uid, so no shard or kind is one task's; the driver sees one row a task and shard."""
    order = ["shard", "virtual_slot", "h", "size", "text_crc32", "doc_id", "uid"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ranged = staged(ranged, "shards")
    task = F.shiftright("place", 33)
    found = sorted(tuple(r) for r in ranged.groupBy(task.alias("task"), "shard").agg(F.min("place").alias("first"), F.count("*").alias("n")).collect())
    before: dict[int, int] = {}
    starts = []
    for t, k, first, n in found:
        starts.append((t, k, before.get(k, 0) - first))
        before[k] = before.get(k, 0) + n
    shift = rows.sparkSession.createDataFrame(starts, "task long, shard int, shift long")
    return ranged.withColumn("task", task).join(F.broadcast(shift), ["task", "shard"]).withColumn("slot", F.col("place") + F.col("shift"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """docs: doc_id, text. One row per row: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    Records hash into `slots` fixed slots. Bytes are summed per slot; the map at map_path (a new one in the shared folder, if none
    is named) gets a first version, equal ranges of slots, if it has none, and one that is rebalanced to the bytes found. The law
    is `bytes`: shards are as near in size as whole slots can be. slot numbers a shard's records from 0; grown_shard is null, as
    under this law data decide what a new shard takes (`grow`).

    Null and empty texts weigh OVERHEAD bytes; a null doc_id is an id like others; repeated rows are records of their own, dealt
    over slots where they are many; texts of any length are one record, so a shard can't be smaller than its largest; no rows give
    no rows; other columns, whatever their names, play no part.
    """
    spark = docs.sparkSession
    slotted = staged(with_slots(staged(records(docs), "records"), slots), "slotted")
    bytes_of = {r["virtual_slot"]: r["held"] for r in slotted.groupBy("virtual_slot").agg(F.sum("size").alias("held")).collect()}
    path = map_path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    now = _stored(spark, path)
    if not now:
        now = first_map(bytes_of, slots, shards)
        write_map(spark, path, now)
    now = [(v, s, k, bytes_of.get(s, 0)) for v, s, k, _ in now]
    new = rebalance(now, shards)
    write_map(spark, path, new)
    held = spark.createDataFrame([(s, k) for _, s, k, _ in new], "virtual_slot int, shard int")
    out = _numbered(slotted.join(F.broadcast(held), "virtual_slot"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(new[0][0]).alias("map_version"))


def _stored(spark: SparkSession, path: str) -> list[tuple[int, int, int, int]]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return []
    return read_map(spark, path)
