"""Balanced shards by label propagation over linked documents.

Links are (row, hub) pairs: rows with a common hub are linked, and no pair of
rows is ever written out.  Linked rows start evenly dealt.  In each round a row
wants the shard in which most rows of its hubs are, if that shard has room or
is its own; ties are broken by a hash of hub and shard, alike for all rows of a
hub, so two linked rows do not just change places.  What may move between every
two shards is found from the matrix of wanted moves, so that no shard exceeds
its capacity, and the rows that move are cut off at exactly that total, in an
order that keeps a hub's rows together.  Rows without links then fill what each
shard has left, so the sizes come out even whatever the links are.

Capacities, loads and the matrix are 16 numbers and their square; everything
else stays in tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.session import cut_lineage, drop_table


def capacities(total: int, shards: int) -> np.ndarray:
    """Shares of a total in whole numbers that differ by one at most."""
    edges = np.array([total * k // shards for k in range(shards + 1)], object)
    return np.diff(edges)


def dealt(total: int, room: np.ndarray) -> np.ndarray:
    """A total spread in proportion to the room of each shard, in whole numbers, none beyond its room while that suffices."""
    room = np.maximum(room, 0)
    all_room = int(room.sum())
    if not all_room:
        return capacities(total, len(room))
    share = np.array([total * int(r) // all_room for r in room], object)
    for k in np.argsort(-(room - share), kind="stable").tolist() * 2:
        if share.sum() < total and (share[k] < room[k] or total > all_room):
            share[k] += 1
    share[0] += total - share.sum()
    return share


def allowed(wanted: np.ndarray, load: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The part of the wanted moves (from, to) after which no shard is beyond its capacity."""
    x = wanted.copy()
    while True:
        over = np.maximum(load + x.sum(0) - x.sum(1) - capacity, 0)
        into = x.sum(0)
        full = [int(k) for k in np.flatnonzero((over > 0) & (into > 0))]
        if not full:
            return x
        for k in full:
            excess = min(int(over[k]), int(into[k]))
            x[:, k] -= dealt(excess, x[:, k])


def running(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds the running sum of ``value`` within ``keys`` in the given order, ties included one by one.

    Rows are cut into ranges of the order, summed inside a range and offset by
    the ranges before it, so a key of any size spreads over many tasks.
    """
    named = {f"_o{k}": c for k, c in enumerate(order)}
    ranged = df.withColumns(named | {"_value": value}).repartitionByRange(*keys, *named).withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*keys, "_part").agg(F.sum("_value").alias("_sum"))
    offsets = offsets.select(*keys, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*named).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("_own", F.sum("_value").over(inside)).join(offsets, [*keys, "_part"])
    return summed.withColumn(out, F.col("_own") + F.col("_offset")).select(*df.columns, out)


def _by_position(position: Column, sizes: np.ndarray) -> Column:
    """The shard in whose share a position (from 0, in halves of rows) of the whole falls."""
    edges = np.cumsum(sizes)[:-1]
    return F.size(F.filter(F.array(*[F.lit(2 * int(e)) for e in edges]), lambda e: e <= position)).cast("int")


def _spread(df: DataFrame, sizes: np.ndarray, out: str) -> DataFrame:
    """Deals rows to shards along a hash order; a row goes where the middle of its weight lies."""
    if len(sizes) == 1:
        return df.withColumn(out, F.lit(0))
    placed = running(df.withColumn("_all", F.lit(0)), ["_all"], [F.xxhash64("row"), F.col("row")], F.col("weight"), "_upto")
    return placed.withColumn(out, _by_position(2 * F.col("_upto") - F.col("weight"), sizes)).drop("_upto", "_all")


def _round(state: DataFrame, links: DataFrame, load: np.ndarray, capacity: np.ndarray) -> tuple[DataFrame | None, int]:
    """The state after the moves of one round, and the weight that moved."""
    shards = len(load)
    in_hub = links.join(state.select("row", "shard"), "row")
    cells = in_hub.groupBy("hub", "shard").agg(F.count("*").alias("n"))
    # written out, so that a hub of many rows can be split where it meets them
    per_hub = cut_lineage(cells.groupBy("hub").agg(F.collect_list(F.struct(F.col("shard").alias("to"), "n")).alias("cells")))
    # a shard counts as having room from a thousandth of its capacity on, so that a full one is not wanted for ever
    room = F.array(*[F.lit(bool(1000 * (c - v) > c)) for c, v in zip(capacity, load, strict=True)])
    met = in_hub.join(per_hub, "hub").select("row", "hub", "shard", F.explode("cells").alias("c"))
    votes = met.groupBy("row", "shard", "c.to").agg(F.sum("c.n").alias("n"), F.min("hub").alias("hub"))
    open_ = votes.where((F.col("to") == F.col("shard")) | F.get(room, F.col("to")))
    best = open_.groupBy("row", "shard").agg(F.min("hub").alias("hub"), F.max(F.struct("n", F.xxhash64("hub", "to").alias("tie"), "to")).alias("best"))
    moves = best.where(F.col("best.to") != F.col("shard")).select("row", "hub", F.col("shard").alias("from"), F.col("best.to").alias("to"))
    moves = cut_lineage(moves.join(state.select("row", "weight"), "row"))
    wanted = np.zeros((shards, shards), object)
    for r in moves.groupBy("from", "to").agg(F.sum("weight").alias("w")).collect():
        wanted[r["from"], r["to"]] = r["w"]
    x = allowed(wanted, load, capacity)
    drop_table(per_hub)
    if not x.any():
        drop_table(moves)
        return None, 0
    going = moves
    if (x != wanted).any():
        limit = F.array(*[F.lit(int(v)) for v in x.ravel()])
        ordered = running(moves, ["from", "to"], [F.xxhash64("hub"), F.xxhash64("row"), F.col("row")], F.col("weight"), "_upto")
        going = ordered.where(F.col("_upto") <= F.get(limit, F.col("from") * shards + F.col("to")))
    after = state.join(going.select("row", "to"), "row", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to")
    after = cut_lineage(after)
    drop_table(moves)
    drop_table(state)
    return after, int(x.sum())


def propagate(rows: DataFrame, links: DataFrame, shards: int, rounds: int = 24) -> DataFrame:
    """(row, weight, shard) of every row of (row, weight), linked rows together as far as capacities allow.

    ``links`` holds (row, hub) pairs; hubs of a single row link nothing.  Ends
    when no move is possible or after ``rounds``; every round's state keeps the
    capacities.  With weight 1 the shards' counts differ by one at most, with
    other weights each shard is within the largest weight or so of its share.
    """
    total = int(rows.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0])
    capacity = capacities(total, shards)
    shared = cut_lineage(links.groupBy("hub").agg((F.min("row") < F.max("row")).alias("several")).where("several").select("hub"))
    links = cut_lineage(links.join(shared, "hub").select("row", "hub").distinct())
    linked = cut_lineage(rows.join(links.select("row").distinct(), "row", "left_semi"))
    weight = int(linked.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0])
    state = cut_lineage(_spread(linked, dealt(weight, capacity), "shard"))
    drop_table(linked)

    def loads() -> np.ndarray:
        load = np.zeros(shards, object)
        for r in state.groupBy("shard").agg(F.sum("weight").alias("w")).collect():
            load[r["shard"]] = int(r["w"])
        return load

    load = loads()
    for _ in range(rounds):
        after, moved = _round(state, links, load, capacity)
        if not moved:
            break
        state = after
        load = loads()
    others = rows.join(links.select("row").distinct(), "row", "left_anti")
    left = total - weight
    filled = _spread(others, dealt(left, capacity - load), "shard")
    out = cut_lineage(state.select("row", "weight", "shard").unionByName(filled.select("row", "weight", "shard")))
    drop_table(state)
    drop_table(links)
    return out


def shard_documents(docs: DataFrame, shards: int = 16, law: str = "rows", rounds: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row: the manifest of the shards.

    Documents with equal texts are linked.  ``law`` is ``rows`` (counts differ
    by one at most) or ``bytes`` (sizes even to within a document at the edges).
    ``size`` is the text's UTF-8 bytes plus 1; null texts have size 1 and are
    linked with the empty ones.  Slots count from 0 without gaps in each shard.
    Rows that share an id, and null ids, are rows of their own.  An empty table
    gives an empty manifest; other columns are not read.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(law)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    measured = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("hub"),
        F.monotonically_increasing_id().alias("row"),
    )
    measured = cut_lineage(measured)
    weight = F.lit(1).cast("long") if law == "rows" else F.col("size")
    placed = propagate(measured.select("row", weight.alias("weight")), measured.select("row", "hub"), shards, rounds)
    numbered = running(placed.select("row", "shard"), ["shard"], [F.xxhash64("row"), F.col("row")], F.lit(1).cast("long"), "slot")
    out = measured.join(numbered, "row").select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("slot") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
    out = cut_lineage(out)
    drop_table(placed)
    drop_table(measured)
    return out


def write_shards(docs: DataFrame, manifest: DataFrame, folder: str, id_col: str = "doc_id") -> None:
    """Writes the documents as one folder per shard, each file in the order of the slots.

    Ids must be unique and not null, else a ValueError names how many rows are not.
    """
    bad = manifest.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if bad:
        raise ValueError(f"{bad} rows have no id of their own")
    placed = docs.join(manifest.select(F.col("doc_id").alias("_id"), "shard", "slot"), F.col(f"`{id_col}`") == F.col("_id")).drop("_id")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
