"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A row's place on the ring is the hash of its text, so that equal texts lie together; each shard owns
the arcs that end at its virtual nodes. A shard takes the rows of its own arcs, in ring order, up to
its capacity; what overflows continues clockwise to the next shard with room. With ``slack`` 0 the
capacities are floor or ceil of rows/shards, so that counts are at most one apart (law ``rows``);
with more slack fewer rows move when shards come or go.

Only counts of arcs (shards x virtual nodes, a parameter) reach the driver, which lays the arcs' row
ranges on the shards. Rows get their rank in three steps (arc, cell, part of a cell), so that no task
holds an arc: a cell with many equal texts is split by the hash of the id.

Defined cases: a null text counts 0 bytes and lies where the empty text lies; repeated rows are
rows of their own; of a very long text only size and hash go on; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.llm.common import settle, whole

#: Cells of the ring; a cell with more than 1 / PARTS of all rows is split to that share by the id's hash.
CELLS, PARTS = 1 << 16, 2048


@dataclass(frozen=True)
class Segment:
    """Rows [start, stop) of an arc, in ring order, lie in ``shard`` from ``slot`` on."""

    arc: int
    start: int
    stop: int
    shard: int
    slot: int


def virtual_nodes(spark: SparkSession, shards: int, replicas: int) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node, in ring order; at most shards x replicas."""
    of = spark.range(shards * replicas).select((F.col("id") % shards).cast("int").alias("shard"), F.pmod(F.xxhash64(F.lit("node"), "id"), F.lit(CELLS)).cast("int").alias("cell"))
    return sorted((r.cell, r.shard) for r in of.collect())


def lay(nodes: list[tuple[int, int]], counts: dict[int, int], shards: int, slack: float = 0.0) -> list[Segment]:
    """Which shard takes which rows of each arc. Arc i ends at ``nodes[i]``; ``counts`` has its rows.

    First every shard fills from its own arcs in ring order; then the overflow of each arc, in ring
    order, walks clockwise. Both steps are over arcs and ranges, never over rows."""
    total = sum(counts.values())
    if slack > 0:
        room = [-(-int(total * (1 + slack)) // shards)] * shards
    else:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    filled, out, over = [0] * shards, [], []

    def take(arc: int, start: int, stop: int, shard: int) -> int:
        n = min(stop - start, room[shard] - filled[shard])
        if n > 0:
            out.append(Segment(arc, start, start + n, shard, filled[shard]))
            filled[shard] += n
        return start + max(n, 0)

    for arc, (_, shard) in enumerate(nodes):
        if rows := counts.get(arc, 0):
            if (at := take(arc, 0, rows, shard)) < rows:
                over.append((arc, at, rows))
    for arc, at, rows in over:
        step = arc
        while at < rows:
            step += 1
            at = take(arc, at, rows, nodes[step % len(nodes)][1])
    return out


def shard(docs: DataFrame, shards: int = 40, replicas: int = 64, slack: float = 0.0) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``docs``."""
    spark = docs.sparkSession
    nodes = virtual_nodes(spark, shards, replicas)
    ends = [c for c, _ in nodes]
    text = whole("text")
    place = F.xxhash64(text)
    slim = settle(docs.select(F.col("doc_id"), F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text")).cast("long").alias("bytes"), F.crc32(text).alias("text_crc32"), place.alias("place"), F.pmod(place, F.lit(CELLS)).cast("int").alias("cell"), F.xxhash64("doc_id").alias("mix")))

    # the arc of each cell: the first node at or after it, else the ring's first node
    found, arc_of = 0, []
    for c in range(CELLS):
        while found < len(ends) and ends[found] < c:
            found += 1
        arc_of.append(found % len(ends))
    runs, begin = [], 0
    for c in range(1, CELLS + 1):
        if c == CELLS or arc_of[c] != arc_of[begin]:
            runs.append({"low": begin, "high": c - 1, "arc": arc_of[begin]})
            begin = c
    arcs = _rows(spark, runs, "low int, high int, arc int").select(F.explode(F.sequence("low", "high")).alias("cell"), "arc")

    cells, total = slim.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")), slim.count()
    parts = cells.join(F.broadcast(arcs), "cell").select("cell", "arc", (F.floor(F.col("rows") * PARTS / max(total, 1)) + 1).cast("int").alias("parts"))  # at most CELLS rows
    placed = slim.join(F.broadcast(parts), "cell").withColumn("part", F.pmod("mix", "parts").cast("int"))
    counts = placed.groupBy("arc", "cell", "part").agg(F.count(F.lit(1)).alias("rows"))
    wrap = F.when((F.col("arc") == 0) & (F.col("cell") > ends[0] if ends else F.lit(False)), -CELLS).otherwise(0) + F.col("cell")
    ahead = Window.partitionBy("arc").orderBy(wrap, "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(counts.withColumn("before", F.coalesce(F.sum("rows").over(ahead), F.lit(0))))
    by_arc = {r.arc: r.rows for r in offsets.groupBy("arc").agg(F.sum("rows").alias("rows")).collect()}

    laid = [s.__dict__ for s in lay(nodes, by_arc, shards, slack)]
    segments = _rows(spark, laid, "arc int, start bigint, stop bigint, shard int, slot bigint")
    inside = Window.partitionBy("cell", "part").orderBy("place", "doc_id", "bytes", "text_crc32")
    ranked = placed.withColumn("nth", F.row_number().over(inside) - 1).join(offsets.select("cell", "part", "before"), ["cell", "part"])
    rank = F.col("before") + F.col("nth")
    return ranked.withColumn("rank", rank).join(F.broadcast(segments.withColumnRenamed("arc", "of")), (F.col("arc") == F.col("of")) & (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("stop"))).select(  # at most 2 x nodes + shards segments
        "doc_id", (F.col("bytes") + 16).alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot") + F.col("rank") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small local table, as one literal."""
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{', '.join(x.replace(' ', ':') for x in schema.split(', '))}>>")).alias("x")).select(*[f"x.{n}" for n in names])
