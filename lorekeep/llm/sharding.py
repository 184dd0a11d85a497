"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations.

Every key has a place on a ring (hash of its id) and belongs to the next virtual node clockwise. A shard
holds at most its exact share of the rows. A shard that owns more keeps that share, taken from its virtual
nodes in proportion; a shard that owns less keeps all and spreads its room over its nodes. The rows beyond a
node's room continue clockwise to the next nodes with room. Rows stay at their own node first (in ring order), and the
k-th row that moves on takes the k-th free place it meets.

That walk is a queue along the ring, so it needs no row-by-row simulation: counts per virtual node
(a table of ``shards * vnodes`` rows, whatever the data) give, by running sums that start where no row is
under way, an interval plan "ranks a..b of node i go to node j". Rows are ranked within their node only.

Law: the row counts of shards differ by at most one. Movement: only what full shards
own beyond their share moves, the least that this law allows.

Defined cases: a null id hashes like the empty string; equal ids share a place on the ring and are ranked by
``tie_cols``; wholly equal rows are interchangeable; an empty table gives an empty result; fewer rows than
shards leave some shards empty. Broadcast tables are bounded by ``shards * vnodes`` and ``CELLS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING_BITS = 60
CELL_BITS = 48  # a cell is 2 ** 48 places: 4096 cells, over which arcs are laid for an equality join
CELLS = 1 << (RING_BITS - CELL_BITS)


def ring_place(name: Column) -> Column:
    """Place in 0 .. 2^60 - 1: the first 15 hex digits of MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(name, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def virtual_nodes(spark, shards: int, vnodes: int) -> DataFrame:
    """node (ring order from 0), shard, replica, place, before (the previous node's place)."""
    nodes = spark.range(shards * vnodes, numPartitions=1).select(
        (F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).cast("int").alias("replica")
    )
    nodes = nodes.withColumn("place", ring_place(F.format_string("shard %d replica %d", "shard", "replica")))
    order = Window.orderBy("place", "shard", "replica")
    return nodes.withColumn("node", F.row_number().over(order) - 1).withColumn("before", F.lag("place").over(order))


def arcs(nodes: DataFrame) -> DataFrame:
    """(cell, low, high, lap, node): places low < p <= high belong to node; the first node also owns the ring's end."""
    last = nodes.agg(F.max("place").alias("low")).join(nodes.where("node = 0").select("node"))
    end = last.select("node", "low", F.lit((1 << RING_BITS) - 1).cast("long").alias("high"), F.lit(0).alias("lap"))
    inner = nodes.select("node", F.coalesce("before", F.lit(-1)).alias("low"), F.col("place").alias("high"), F.lit(1).alias("lap"))
    return (
        inner.unionByName(end)
        .where("low < high")
        .withColumn("cell", F.explode(F.expr(f"sequence(shiftright(low + 1, {CELL_BITS}), shiftright(high, {CELL_BITS}))")))
    )


def capacities(nodes: DataFrame, counts: DataFrame, shards: int, vnodes: int) -> DataFrame:
    """Per node: count of own rows, room, and the first slot of the node within its shard."""
    filled = nodes.join(counts, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)).cast("long"))
    filled = filled.withColumn("total", F.sum("own").over(Window.partitionBy(F.lit(0))))
    up_to = Window.partitionBy("shard").orderBy("replica").rowsBetween(Window.unboundedPreceding, 0)
    filled = (
        filled.withColumn("share", F.expr(f"total div {shards} + if(shard < total % {shards}, 1, 0)"))
        .withColumn("load", F.sum("own").over(Window.partitionBy("shard")))
        .withColumn("own_to", F.sum("own").over(up_to))
    )
    scaled = "cast(floor(cast(share as decimal(19,0)) * {} / load) as bigint)"
    full = f"{scaled.format('own_to')} - {scaled.format('(own_to - own)')}"
    spare = f"own + (share - load) div {vnodes} + if(replica < (share - load) % {vnodes}, 1, 0)"
    filled = filled.withColumn("room", F.expr(f"if(load > share, {full}, {spare})"))
    before = Window.partitionBy("shard").orderBy("replica").rowsBetween(Window.unboundedPreceding, -1)
    return filled.withColumn("first_slot", F.coalesce(F.sum("room").over(before), F.lit(0)))


def moves(loads: DataFrame) -> DataFrame:
    """Interval plan (node, low, high, shard, slot): own ranks low < r <= high take slots from ``slot`` on."""
    ring = Window.orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(0))
    # The walk starts behind the node where the running surplus is smallest: nothing is under way there.
    turned = (
        loads.withColumn("surplus", F.sum(F.col("own") - F.col("room")).over(ring))
        .withColumn("start", F.min_by("node", F.struct("surplus", "node")).over(everything))
        .withColumn("turn", F.expr("if(node > start, 0, 1)"))
    )
    along = Window.orderBy("turn", "node").rowsBetween(Window.unboundedPreceding, 0)
    walk = (
        turned.withColumn("excess", F.greatest(F.col("own") - F.col("room"), F.lit(0)))
        .withColumn("free", F.greatest(F.col("room") - F.col("own"), F.lit(0)))
        .withColumn("excess_to", F.sum("excess").over(along))
        .withColumn("free_to", F.sum("free").over(along))
    )
    giver = F.struct("node", (F.col("excess_to") - F.col("excess")).alias("base"), "room")
    taker = F.struct("shard", (F.col("free_to") - F.col("free")).alias("base"), (F.col("first_slot") + F.col("own")).alias("slot"))
    none_giver, none_taker = F.lit(None).cast(walk.select(giver.alias("x")).schema["x"].dataType), F.lit(None).cast(walk.select(taker.alias("x")).schema["x"].dataType)
    marks = (
        walk.where("excess > 0").select(F.col("excess_to").alias("mark"), giver.alias("giver"), none_taker.alias("taker"))
        .unionByName(walk.where("free > 0").select(F.col("free_to").alias("mark"), none_giver.alias("giver"), taker.alias("taker")))
    )
    onward = Window.orderBy("mark").rangeBetween(0, Window.unboundedFollowing)
    pieces = (
        marks.select("mark", F.first("giver", True).over(onward).alias("giver"), F.first("taker", True).over(onward).alias("taker"))
        .dropDuplicates(["mark"])
        .withColumn("below", F.coalesce(F.lag("mark").over(Window.orderBy("mark")), F.lit(0)))
    )
    moved = pieces.select(
        F.col("giver.node").alias("node"),
        (F.col("giver.room") + F.col("below") - F.col("giver.base")).alias("low"),
        (F.col("giver.room") + F.col("mark") - F.col("giver.base")).alias("high"),
        F.col("taker.shard").alias("shard"),
        (F.col("taker.slot") + F.col("below") - F.col("taker.base")).alias("slot"),
    )
    own = loads.where("own > 0 AND room > 0").select(
        "node", F.lit(0).cast("long").alias("low"), F.least("own", "room").alias("high"), "shard", F.col("first_slot").alias("slot")
    )
    return own.unionByName(moved)


def shard_rows(rows: DataFrame, shards: int, id_col: str = "doc_id", tie_cols: tuple[str, ...] = (), vnodes: int = 64) -> DataFrame:
    """``rows`` with ``shard``, ``slot`` (gapless from 0 within the shard) and ``home_shard`` (the ring owner).

    Columns of these names are replaced. The rows are read twice: to count, and to place.
    """
    rows = rows.drop("shard", "slot", "home_shard")
    nodes = virtual_nodes(rows.sparkSession, shards, vnodes)
    kept = [F.col(f"`{c}`") for c in rows.columns]
    placed = rows.select(F.struct(*kept).alias("row"), ring_place(F.col(id_col).cast("string")).alias("place"))
    placed = placed.withColumn("cell", F.shiftright("place", CELL_BITS))
    owned = placed.join(F.broadcast(arcs(nodes)), "cell").where("place > low AND place <= high")
    counts = owned.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    loads = capacities(nodes, counts, shards, vnodes)
    plan = moves(loads)
    order = Window.partitionBy("node").orderBy("lap", "place", *[f"row.`{c}`" for c in (id_col, *tie_cols)])
    ranked = owned.select("row", "node", "lap", "place").withColumn("rank", F.row_number().over(order)).select("row", "node", "rank")
    home = nodes.select("node", F.col("shard").alias("home_shard"))
    return (
        ranked.join(F.broadcast(plan.join(home, "node")), "node")
        .where("rank > low AND rank <= high")
        .select("row.*", "shard", (F.col("slot") + F.col("rank") - F.col("low") - 1).alias("slot"), "home_shard")
    )
