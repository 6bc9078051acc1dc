"""Similar pairs without comparing all pairs: a cosine join on an inverted index, and exact nearest neighbours.

Both are exact.  The join lets a pair meet only at features where what is left
of both vectors can still reach the threshold; the neighbour search looks into
another cell only where the triangle inequality leaves room for a closer node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.session import cut_lineage, drop_table

#: Parts of a frequency level; a node's features of one part are summed in one task.
PARTS = 64
#: Nodes of one block of a cell, and queries that meet a block in one row.
BLOCK = 512
#: Most pivots of a neighbour search; they are sent to every task.
MOST_PIVOTS = 2048
_SLACK = 1e-9


def unit_cells(cells: DataFrame) -> DataFrame:
    """(node, f, x) with x over the length of its node's vector; zeros and vectors without length are left out."""
    length = cells.groupBy("node").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_length"))
    return cells.join(length, "node").where((F.col("x") != 0) & (F.col("_length") > 0)).select("node", "f", (F.col("x") / F.col("_length")).alias("x"))


def postings(units: DataFrame, threshold: float) -> DataFrame:
    """(f, node, x, rest): the entries at which a pair may meet first.

    Features stand in the order of how many nodes have them, rare ones first.
    ``rest`` is the length of what follows the entry in its node's vector; an
    entry stays only if it and its rest can reach the threshold, which the
    features that everybody has seldom do.
    """
    often = units.groupBy("f").agg(F.count("*").alias("_n"))
    part = F.floor(F.log2("_n")) * PARTS + F.pmod(F.xxhash64("f"), F.lit(PARTS))
    ranked = cut_lineage(units.join(often, "f").select("node", "f", "x", part.alias("_part"), (F.col("x") * F.col("x")).alias("_q")))
    inside = Window.partitionBy("node", "_part").orderBy(F.desc("f"))
    after = Window.partitionBy("node").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranked.groupBy("node", "_part").agg(F.sum("_q").alias("_sum"))
    totals = totals.select("node", "_part", F.coalesce(F.sum("_sum").over(after), F.lit(0.0)).alias("_after"))
    summed = ranked.withColumn("_own", F.sum("_q").over(inside)).join(totals, ["node", "_part"]).withColumn("_left", F.col("_own") + F.col("_after"))
    rest = F.sqrt(F.greatest(F.col("_left") - F.col("_q"), F.lit(0.0)))
    return summed.where(F.sqrt("_left") >= threshold - _SLACK).select("f", "node", "x", rest.alias("rest"))


def candidates(entries: DataFrame, threshold: float) -> DataFrame:
    """(src, dst), each pair once, that some common entry does not rule out.

    Seen from a common feature, two vectors are (x, rest), and their product is
    at most that of these two.  Both are no longer than 1, so the angle between
    them must not exceed that of the threshold: a feature's entries are dealt by
    angle, and only neighbouring angles meet.  A feature that many nodes have is
    split that way.
    """
    width = max(math.acos(max(min(threshold, 1.0), -1.0)), 1e-3) + 1e-6
    turned = cut_lineage(entries.withColumn("_at", F.floor(F.atan2("rest", "x") / width)))
    here = turned.select("f", "_at", F.col("node").alias("a"), F.col("x").alias("xa"), F.col("rest").alias("ra"))
    there = turned.select("f", "_at", F.col("node").alias("b"), F.col("x").alias("xb"), F.col("rest").alias("rb"))
    same = here.join(there, ["f", "_at"]).where("a < b")
    beside = here.join(there.withColumn("_at", F.col("_at") + 1), ["f", "_at"]).where("a <> b")
    reach = F.col("xa") * F.col("xb") + F.col("ra") * F.col("rb") >= threshold - _SLACK
    return same.unionByName(beside).where(reach).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def cosine_pairs(cells: DataFrame, threshold: float) -> DataFrame:
    """(src, dst, weight) of all pairs of nodes with a cosine similarity of at least ``threshold`` (above 0).

    ``cells`` holds (node, f, x), each (node, f) once.  Candidates' products are
    summed feature by feature, partly before the shuffle, so no vector has to
    fit into a row.  Nodes without a value other than 0 have no pair.
    """
    if threshold <= 0:
        raise ValueError("a threshold above 0 is needed: pairs without a common feature are never met")
    units = cut_lineage(unit_cells(cells))
    met = cut_lineage(candidates(postings(units, threshold), threshold))
    first = met.join(units.select(F.col("node").alias("src"), "f", F.col("x").alias("xa")), "src")
    both = first.join(units.select(F.col("node").alias("dst"), "f", F.col("x").alias("xb")), ["dst", "f"])
    weight = F.sum(F.col("xa") * F.col("xb")).alias("weight")
    return both.groupBy("src", "dst").agg(weight).where(F.col("weight") >= threshold)


# ------------------------------------------------------------------ neighbours


def _matrix(column: pa.ListArray) -> np.ndarray:
    at = column.offsets.to_numpy(zero_copy_only=False)
    values = column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
    return values.reshape(len(column), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the order of the components wherever its pair stands."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += a[:, k, None] * b[None, :, k]
    return out


def _angles(products: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(products, -1.0, 1.0))


def _best(scores: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
    """Columns of the k best scores of each row, the later column first among equals; ``own`` marks what is left out."""
    scores = np.where(own, -np.inf, scores)
    order = np.argsort(-scores[:, ::-1], axis=1, kind="stable")[:, :k]
    order = scores.shape[1] - 1 - order
    return [row[np.isfinite(s[row])] for row, s in zip(order, scores, strict=True)]


@dataclass
class Cells:
    """Unit vectors dealt to the cell of their nearest pivot, in ``blocks`` of bounded size."""

    blocks: DataFrame
    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    chunks: np.ndarray

    @classmethod
    def of(cls, units: DataFrame, node_type: T.DataType, n: int) -> Cells:
        spark = units.sparkSession
        wanted = min(MOST_PIVOTS, max(1, math.ceil(2 * math.sqrt(n))))
        pivots = np.array([r.v for r in units.orderBy(F.xxhash64("node"), "node").limit(wanted).select("v").collect()])
        sent = spark.sparkContext.broadcast(pivots)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    angle = _angles(_matrix(batch.column("v")) @ sent.value.T)
                    cell = angle.argmin(1)
                    made = [pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(cell)), cell])]
                    yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("v"), *made], names=["node", "v", "cell", "angle"])

        schema = T.StructType([T.StructField("node", node_type), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
        placed = cut_lineage(units.select("node", "v").mapInArrow(assign, schema))
        # at most a row per pivot
        size = cut_lineage(placed.groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks")))
        low, high, chunks = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
        for r in size.collect():
            low[r.cell], high[r.cell], chunks[r.cell] = r.low, r.high, r.chunks
        dealt = placed.join(size.select("cell", "chunks"), "cell").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        members = F.sort_array(F.collect_list(F.struct("node", "v", "angle"))).alias("members")
        blocks = cut_lineage(dealt.groupBy("cell", "chunk").agg(members))
        drop_table(placed)
        drop_table(size)
        return cls(blocks, pivots, low, high, chunks)

    def may_hold(self, v: np.ndarray, angle: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Whether a cell can hold a node within ``reach`` of each vector (which lies ``angle`` from its own pivot)."""
        to = _angles(v @ self.pivots.T)
        nearest = np.maximum(np.maximum(to - self.high, self.low - to), (to - angle[:, None]) / 2)
        return (nearest <= reach[:, None] + 1e-6) & (self.chunks > 0)


def _found_schema(node_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("node", node_type), T.StructField("s", T.DoubleType()), T.StructField("other", node_type)])


def _members(column: pa.ListArray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    at = column.offsets.to_numpy(zero_copy_only=False)
    for a, b in zip(at[:-1], at[1:], strict=True):
        own = column.values.slice(a, b - a)
        node, v, angle = own.flatten()
        yield node, _matrix(v), angle.to_numpy(zero_copy_only=False)


def within_blocks(cells: Cells, k: int, node_type: T.DataType) -> DataFrame:
    """(node, v, cell, chunk, angle, kth, found) with the k best of each node's own block; kth is -2 if there are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, chunk, (node, v, angle) in zip(batch.column("cell").to_pylist(), batch.column("chunk").to_pylist(), _members(batch.column("members")), strict=True):
                scores = _products(v, v)
                chosen = _best(scores, np.eye(len(v), dtype=bool), k)
                kth = np.array([scores[i, c[-1]] if len(c) == k else -2.0 for i, c in enumerate(chosen)])
                sizes = np.array([len(c) for c in chosen])
                flat = np.concatenate(chosen).astype(np.int64)
                at = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
                found = pa.StructArray.from_arrays([pa.array(scores[np.repeat(np.arange(len(v)), sizes), flat]), node.take(pa.array(flat))], names=["s", "other"])
                n = len(v)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))
                columns = [node, rows, pa.array([cell] * n, pa.int32()), pa.array([chunk] * n, pa.int32()), pa.array(angle), pa.array(kth), pa.ListArray.from_arrays(at, found)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "v", "cell", "chunk", "angle", "kth", "found"])

    list_of = T.ArrayType(T.StructType([T.StructField("s", T.DoubleType()), T.StructField("other", node_type)]))
    fields = [("node", node_type), ("v", T.ArrayType(T.DoubleType())), ("cell", T.IntegerType()), ("chunk", T.IntegerType()), ("angle", T.DoubleType()), ("kth", T.DoubleType()), ("found", list_of)]
    return cells.blocks.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields]))


def probes(first: DataFrame, cells: Cells, node_type: T.DataType) -> DataFrame:
    """(node, v, cell, chunk) of the other blocks that can hold one of a node's k best."""
    sent = first.sparkSession.sparkContext.broadcast((cells.pivots, cells.low, cells.high, cells.chunks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Cells(None, *sent.value)
        for batch in batches:
            for part in (batch.slice(a, BLOCK) for a in range(0, batch.num_rows, BLOCK)):
                v, kth = _matrix(part.column("v")), part.column("kth").to_numpy()
                reach = np.where(kth < -1, np.pi, _angles(kth))
                row, cell = np.nonzero(own.may_hold(v, part.column("angle").to_numpy(), reach))
                times = own.chunks[cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                chunk = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                at_home = (part.column("cell").to_numpy()[row] == cell) & (part.column("chunk").to_numpy()[row] == chunk)
                row, cell, chunk = row[~at_home], cell[~at_home], chunk[~at_home]
                for a in range(0, len(row), 1 << 15):
                    some = pa.array(row[a : a + (1 << 15)])
                    made = [pa.array(x[a : a + (1 << 15)].astype(np.int32)) for x in (cell, chunk)]
                    yield pa.RecordBatch.from_arrays([part.column("node").take(some), part.column("v").take(some), *made], names=["node", "v", "cell", "chunk"])

    schema = T.StructType([T.StructField("node", node_type), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType()), T.StructField("chunk", T.IntegerType())])
    return first.select("node", "v", "cell", "chunk", "angle", "kth").mapInArrow(run, schema)


def _probed(asked: DataFrame, cells: Cells, k: int, node_type: T.DataType) -> DataFrame:
    """(node, s, other): the k best of each probed block, queries of a block in rows of about BLOCK."""
    count = cut_lineage(asked.groupBy("cell", "chunk").agg(F.ceil(F.count("*") / BLOCK).alias("_parts")))
    dealt = asked.join(count, ["cell", "chunk"]).withColumn("_part", F.pmod(F.xxhash64("node"), F.col("_parts")))
    asking = cut_lineage(dealt.groupBy("cell", "chunk", "_part").agg(F.collect_list(F.struct("node", "v", F.lit(0.0).alias("angle"))).alias("asking")))
    met = asking.join(cells.blocks, ["cell", "chunk"]).select("asking", "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (node, q, _), (other, v, _) in zip(_members(batch.column("asking")), _members(batch.column("members")), strict=True):
                scores = _products(q, v)
                chosen = _best(scores, np.zeros(scores.shape, bool), k)
                row = np.repeat(np.arange(len(q)), [len(c) for c in chosen])
                flat = np.concatenate(chosen).astype(np.int64)
                yield pa.RecordBatch.from_arrays([node.take(pa.array(row)), pa.array(scores[row, flat]), other.take(pa.array(flat))], names=["node", "s", "other"])

    return met.mapInArrow(run, _found_schema(node_type))


def nearest_by_cosine(units: DataFrame, k: int) -> DataFrame:
    """(node, s, other): the k other nodes with the highest cosine of each node, equal ones by descending id.

    ``units`` holds (node, v): each node once, vectors of one length, of length 1
    or all zeros.  A vector of zeros has cosine 0 with everything.
    """
    units = cut_lineage(units.select("node", "v"))
    node_type = units.schema["node"].dataType
    some = F.exists("v", lambda x: x != 0)
    rank = Window.partitionBy("node").orderBy(F.desc("s"), F.desc("other"))
    best = lambda df: df.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= k).drop("_r")
    # with a vector of zeros only ids decide: at most k + 1 rows, sent to the nodes they concern
    last = lambda df: F.broadcast(cut_lineage(df.orderBy(F.desc("node")).limit(k + 1).select(F.col("node").alias("other"), F.lit(0.0).alias("s"))))
    zero = units.where(~some).select("node")
    n = units.where(some).count()
    out = best(zero.join(last(units), F.col("node") != F.col("other")).select("node", "s", "other"))
    if not n:
        return out
    cells = Cells.of(units.where(some), node_type, n)
    first = cut_lineage(within_blocks(cells, k, node_type))
    asked = cut_lineage(probes(first, cells, node_type))
    own = first.select("node", F.explode("found").alias("f")).select("node", "f.s", "f.other")
    empty = first.select("node").join(last(zero), F.lit(True)).select("node", "s", "other")
    found = own.unionByName(_probed(asked, cells, k, node_type)).unionByName(empty)
    return best(found).unionByName(out)
