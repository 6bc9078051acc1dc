"""Hard negatives by packed products.

Vectors become integers.  The components of several candidates lie in separated
fields of one wide integer, so one multiplication per anchor component gives
the products with all of them, and the sum over components holds their exact
inner products in the same fields.  The wide integers are whole numbers below
2^53 carried in doubles, because the matrix product runs fastest there; the
width of a field follows from the largest norms in the data.  Vectors too large
for two fields take one, and those too large for exact doubles are multiplied
as Python integers.

Anchors are a stated query set: they are sent in blocks of bounded size, and
every block meets all rows, held as they lie in their partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.text import released
from panelwright.session import cut_lineage, drop_table

#: Bytes of anchors that are sent at once; more anchors take more passes.
SENT_BYTES = 16 << 20
#: Candidates and anchors that meet in one product.
_CANDIDATES, _ANCHORS = 2048, 256
_EXACT = 53
_LOWEST = np.iinfo(np.int64).min
_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> DataFrame:
    """(id, label, x) of the rows that take part, x being floor(scale * component) as long."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))
    vector = F.col(f"`{vec_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
    return rows.select("id", "label", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("x"))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors end in zeros."""
    at = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
    at = at - at[0]
    if len(values) == width * len(column) and (np.diff(at) == width).all():
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), np.diff(at))
    out[row, np.arange(len(values)) - at[row]] = values
    return out


@dataclass
class Fields:
    """Layout of the wide integers: ``count`` fields of ``width`` bits; no field at all if doubles are not exact."""

    count: int
    width: int

    @classmethod
    def for_bound(cls, bound: float) -> Fields:
        """Fields that hold inner products, and their partial sums, of up to ``bound`` in size."""
        width = math.ceil(bound + 1).bit_length() + 1 if math.isfinite(bound) else _EXACT + 1
        return cls(_EXACT // width, width)

    def pack(self, x: np.ndarray) -> np.ndarray:
        """Candidates as rows of wide integers; the last row is filled up with zeros."""
        rows = -(-len(x) // self.count)
        padded = np.zeros((rows * self.count, x.shape[1]))
        padded[: len(x)] = x
        powers = np.ldexp(1.0, self.width * np.arange(self.count))
        return np.tensordot(padded.reshape(rows, self.count, -1), powers, axes=([1], [0]))

    def unpack(self, products: np.ndarray, n: int) -> np.ndarray:
        """Inner products by anchor and candidate."""
        out = np.empty((*products.shape, self.count), np.int64)
        half, whole = np.ldexp(0.5, self.width), np.ldexp(1.0, self.width)
        rest = products
        for k in range(self.count - 1):
            above = np.floor((rest + half) / whole)
            out[..., k] = rest - above * whole
            rest = above
        out[..., -1] = rest
        return out.reshape(len(products), -1)[:, :n]

    def products(self, anchors: np.ndarray, x: np.ndarray) -> Callable[[slice], np.ndarray]:
        """Exact inner products of some of the anchors with all candidates ``x``."""
        if self.count:
            packed = self.pack(x).T
            wide = anchors.astype(np.float64)
            return lambda part: self.unpack(wide[part] @ packed, len(x))
        whole = x.astype(object).T
        return lambda part: np.clip(anchors[part].astype(object) @ whole, -_LONG, _LONG).astype(np.int64)


def top(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest allowed scores of each row, equal scores by ascending column."""
    k = min(k, scores.shape[1])
    bits = max(1, (scores.shape[1] - 1).bit_length())
    if not scores.size or max(scores.max(), -int(scores.min())) >> (62 - bits):
        chosen = [np.flatnonzero(a)[np.argsort(-s[a].astype(object), kind="stable")[:k]] for s, a in zip(scores, allowed, strict=True)]
        return np.repeat(np.arange(len(scores)), [len(c) for c in chosen]), np.concatenate([np.zeros(0, np.int64), *chosen]).astype(np.int64)
    key = np.where(allowed, (scores << bits) + (scores.shape[1] - 1 - np.arange(scores.shape[1])), _LOWEST)
    at = np.argpartition(key, key.shape[1] - k, axis=1)[:, key.shape[1] - k :]
    found = np.take_along_axis(key, at, 1) > _LOWEST
    row, _ = np.nonzero(found)
    return row, at[found]


class Kept:
    """The k best (score, id) of each slot over all blocks of a task."""

    def __init__(self, k: int) -> None:
        self.k, self._parts, self._held = k, [], 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self._parts.append(np.stack([slot, score, ids]))
        self._held += len(slot)
        if self._held > 1 << 18:
            self._held = self.settle().shape[1]
            # what the settled rows fill is no reason to settle again at once
            self._held = min(self._held, 1 << 17)

    def settle(self) -> np.ndarray:
        all_ = np.concatenate([np.zeros((3, 0), np.int64), *self._parts], axis=1)
        slot, score, ids = all_[:, np.lexsort((all_[2], -all_[1], all_[0]))]
        first = np.searchsorted(slot, slot)
        kept = np.arange(len(slot)) - first < self.k
        self._parts = [np.stack([slot[kept], score[kept], ids[kept]])]
        return self._parts[0]


def _met(rows: DataFrame, width: int, fields: Fields, sent, choose: Callable, k: int) -> DataFrame:
    """(slot, score, id): the k best candidates of each slot that ``choose`` allows, of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kept = sent.value, Kept(k)
        for batch in released(batches):
            ids = batch.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, label, x = ids[order], batch.column("label").to_numpy()[order], matrix(batch.column("x"), width)[order]
            for a in range(0, len(ids), _CANDIDATES):
                some = slice(a, a + _CANDIDATES)
                product = fields.products(own["x"], x[some])
                for b in range(0, len(own["id"]), _ANCHORS):
                    part = slice(b, min(b + _ANCHORS, len(own["id"])))
                    scores = product(part)
                    for slots, row, allowed in choose(own, part, scores, ids[some], label[some]):
                        at, column = top(scores[row], allowed, k)
                        kept.add(slots[at], scores[row][at, column], ids[some][column])
        slot, score, found = kept.settle()
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(score), pa.array(found)], names=["slot", "score", "id"])

    return rows.mapInArrow(run, "slot long, score long, id long")


def _ranked(met: DataFrame, k: int) -> pa.Table:
    """At most k rows of each slot of a bounded block of anchors."""
    order = Window.partitionBy("slot").orderBy(F.col("score").desc(), "id")
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.toArrow().sort_by([("slot", "ascending"), ("rank", "ascending")]).combine_chunks()


def _same_label(own, part, scores, ids, label):
    rows = np.arange(scores.shape[0])
    yield part.start + rows, rows, (own["label"][part][:, None] == label) & (own["id"][part][:, None] != ids)


def mine(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label: Column | None = None,
) -> DataFrame:
    """Hard negatives of each anchor and each of its positives.

    ``anchors`` is a condition on the column ``id``.  A score is the inner
    product of the vectors' floor(scale * component); higher scores come first,
    ties by smaller id.  Positives are the first rows with the anchor's label
    and another id.  Negatives are the first rows of another label with
    ``low * positive <= 100 * negative <= high * positive``.

    Returns (anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score, positive_rank).  Rows with a null id or label, a null vector
    or a null or non-finite component take no part; shorter vectors count as
    ending in zeros, scores beyond 64 bits as the largest.  Rows that share an
    id are candidates of their own; anchors that share one have results of
    their own.  Empty tables give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(quantised(vectors, id_col, vec_col, F.col("label") if label is None else label, scale))
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    of = rows.agg(F.max(norm).alias("all"), F.max(F.when(anchors, norm)).alias("anchors"), F.max(F.size("x")).alias("width"), F.count_if(anchors).alias("n")).first()
    fields, width = Fields.for_bound(math.sqrt(of["all"] or 0.0) * math.sqrt(of["anchors"] or 0.0) * 1.000001), of["width"] or 0
    passes = max(1, -(-(of["n"] * (width + 2) * 8) // SENT_BYTES))
    asked = cut_lineage(rows.where(anchors))

    def in_window(own, part, scores, ids, label):
        other = own["label"][part][:, None] != label
        for rank in range(own["positive"].shape[1]):
            score = own["positive"][part, rank]
            rows_ = np.flatnonzero(own["has"][part, rank])
            p, n = score[rows_][:, None], scores[rows_]
            if max(p.max(initial=0), n.max(initial=0), -n.min(initial=0)) >> 55:  # a hundred times it would not fit
                p, n = p.astype(object), n.astype(object)
            within = ((high * p >= 100 * n) & (low * p <= 100 * n)).astype(bool)
            yield (part.start + rows_) * positives + rank, rows_, other[rows_] & within

    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int"
    written = []
    for i in range(passes):
        own_rows = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == i)
        table = own_rows.toArrow().combine_chunks()
        if not table.num_rows:
            continue
        own = {"id": table.column("id").to_numpy(), "label": table.column("label").to_numpy(), "x": matrix(table.column("x").combine_chunks(), width)}
        sent = spark.sparkContext.broadcast(own)
        best = _ranked(_met(rows, width, fields, sent, _same_label, positives), positives)
        slot, rank = best.column("slot").to_numpy(), best.column("rank").to_numpy() - 1
        shape = (len(own["id"]), positives)
        own |= {"positive": np.zeros(shape, np.int64), "positive_id": np.zeros(shape, np.int64), "has": np.zeros(shape, bool)}
        own["positive"][slot, rank], own["positive_id"][slot, rank], own["has"][slot, rank] = best.column("score").to_numpy(), best.column("id").to_numpy(), True
        sent.unpersist()
        sent = spark.sparkContext.broadcast(own)
        order = Window.partitionBy("slot").orderBy(F.col("score").desc(), "id")
        found = _met(rows, width, fields, sent, in_window, negatives).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)

        def named(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in released(batches):
                own = sent.value
                anchor, at = np.divmod(batch.column("slot").to_numpy(), positives)
                made = [own["id"][anchor], own["positive_id"][anchor, at], batch.column("rank"), batch.column("id"), own["positive"][anchor, at], batch.column("score"), (at + 1).astype(np.int32)]
                names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank"]
                yield pa.RecordBatch.from_arrays([m if isinstance(m, pa.Array) else pa.array(m) for m in made], names=names)

        written.append(cut_lineage(found.mapInArrow(named, schema)))
        sent.unpersist()
    drop_table(asked)
    drop_table(rows)
    out = spark.createDataFrame([], schema)
    for k, part in enumerate(written):
        out = part if k == 0 else out.unionByName(part)
    return out
