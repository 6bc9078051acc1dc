"""Ranked lexical search over a length-stratified index.

Documents with the same normaliser ``m`` form a stratum.  A stratum is stored as
blocks, so a hot one spreads over many rows; a block holds its documents' ids
and, per term, its postings grouped by term frequency.  The impact of a posting
depends on (tf, m) alone, so it is computed once per group of a block.  The
largest tf of each term bounds what any document of the block can score: blocks
are visited from the highest bound down, and a block whose bound does not reach
the score that an item's result needs already is not read for that item.

Weights, normalisers and scores are integers; all documents count in N, L and
df, also those that hold no indexed term.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm import text as tx
from panelwright.session import cut_lineage, drop_table

#: Most documents and postings of one block of a stratum.
BLOCK_DOCS, BLOCK_POSTINGS = 1024, 200_000
#: Most terms that are sent to every task; a larger vocabulary is not sent, and all terms are indexed.
MOST_TERMS = 2_000_000
#: Most (item, term) entries of one pass over the index; more items take more passes.
MOST_ENTRIES = 1_000_000
#: Postings that are added up at once.
_AT_ONCE = 1_000_000


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms per text, and text and hash of every term."""
    data, offsets = tx.flat(texts)
    w = tx.words(tx.LOWER[data], offsets, tx.ALNUM)
    return w.per_text, w.text_of, tx.signed(tx.word_hashes(w))


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat, kind))


def _ragged(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without nulls."""
    at = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term) with each term's hash once per item; items that share an id are one item."""
    rows = items.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def found(texts: pa.Array) -> dict[str, object]:
        n, _, h = _tokens(texts)
        return {"terms": _lists(np.split(h, np.cumsum(n)[:-1]) if len(n) else [], pa.int64())}

    return tx.map_texts(rows, "text", found, "terms array<long>", keep=["item_id"]).select("item_id", F.explode("terms").alias("term")).distinct()


def _vocabulary(entries: DataFrame) -> np.ndarray | None:
    """The sorted distinct terms, or None if there are more than may be sent."""
    terms = entries.select("term").distinct()
    if terms.limit(MOST_TERMS + 1).count() > MOST_TERMS:
        return None
    return np.sort(terms.toArrow().column("term").to_numpy())


@dataclass
class Index:
    """``blocks`` holds the strata, ``n_docs`` and ``n_terms`` are N and L."""

    blocks: DataFrame
    n_docs: int
    n_terms: int

    def drop(self) -> None:
        drop_table(self.blocks)


def build(docs: DataFrame, vocabulary: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Indexes every document; with ``vocabulary`` (sorted hashes) only its terms have postings.

    Null and empty texts, and texts without terms, are in no stratum and do not
    count in N.  Rows that share an id are separate documents.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)

    def postings(texts: pa.Array) -> dict[str, object]:
        n, text, h = _tokens(texts)
        if sent.value is None:
            names, code = np.unique(h, return_inverse=True)
        else:
            names = sent.value
            code = np.searchsorted(names, h)
            known = np.append(names, 0)[code] == h
            known &= code < len(names)
            text, code = text[known], code[known]
        key, tf = np.unique(text * max(len(names), 1) + code, return_counts=True)
        text, code = key // max(len(names), 1), key % max(len(names), 1)
        at = np.searchsorted(text, np.arange(len(n) + 1)).astype(np.int32)
        lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))
        return {"n": n, "terms": lists(names[code] if len(code) else code, pa.int64()), "tfs": lists(tf, pa.int32())}

    rows = cut_lineage(tx.map_texts(tx.narrow(docs, id_col, text_col), "text", postings, "n long, terms array<long>, tfs array<int>", keep=["doc_id"]))
    total = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    m = F.expr(f"100L - 50L + ((50L * n * {total.docs}L) div {max(total.terms, 1)}L)")
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("m", T.LongType()), T.StructField("ids", T.ArrayType(kind))])
    for name, of in (("terms", T.LongType()), ("tops", T.IntegerType()), ("counts", T.IntegerType()), ("tfs", T.IntegerType()), ("sizes", T.IntegerType()), ("members", T.IntegerType())):
        schema.add(name, T.ArrayType(of))
    held = rows.where(F.size("terms") > 0).select(m.alias("m"), "doc_id", "terms", "tfs")
    # a stratum is dealt out in as many parts as it needs blocks: neither one length that many documents share
    # nor the few lengths of the long documents, which hold most postings, fill a task
    parts = F.greatest(F.ceil(F.sum(F.size("terms")) / BLOCK_POSTINGS), F.ceil(F.count("*") / BLOCK_DOCS))
    per_m = cut_lineage(held.groupBy(F.col("m").alias("_m")).agg(parts.alias("_parts")))
    placed = held.join(per_m, F.col("m") == F.col("_m")).withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.col("_parts")))
    strata = placed.repartition("m", "_part").sortWithinPartitions("m", "_part", "doc_id").drop("_m", "_parts", "_part")
    blocks = strata.mapInArrow(_pack, schema).withColumn("block", F.monotonically_increasing_id())
    index = Index(cut_lineage(blocks), total.docs, total.terms)
    drop_table(rows)
    drop_table(per_m)
    return index


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents of one stratum each, from documents sorted by m."""
    for batch in tx.released(batches):
        if not batch.num_rows:
            continue
        m = batch.column("m").to_numpy()
        term, at = _ragged(batch.column("terms"))
        tf, _ = _ragged(batch.column("tfs"))
        fresh = np.flatnonzero(np.diff(m)) + 1
        cuts, begin = [0], 0
        for end in [*fresh.tolist(), batch.num_rows]:
            while begin < end:
                begin = min(end, begin + BLOCK_DOCS, max(begin + 1, int(np.searchsorted(at, at[begin] + BLOCK_POSTINGS, "right")) - 1))
                cuts.append(begin)
        made: dict[str, list[np.ndarray]] = {k: [] for k in ("terms", "tops", "counts", "tfs", "sizes", "members")}
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            t, f = term[at[a] : at[b]], tf[at[a] : at[b]]
            doc = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
            order = np.lexsort((doc, f, t))
            t, f = t[order], f[order]
            new_term = np.r_[True, t[1:] != t[:-1]]
            group = np.flatnonzero(new_term | np.r_[True, f[1:] != f[:-1]])
            first = np.flatnonzero(new_term)
            ends = np.r_[first[1:], len(t)]
            made["terms"].append(t[first])
            made["tops"].append(f[ends - 1])
            made["counts"].append(ends - first)
            made["tfs"].append(f[group])
            made["sizes"].append(np.diff(np.r_[group, len(t)]))
            made["members"].append(doc[order])
        ids = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), batch.column("doc_id"))
        columns = [pa.array(m[cuts[:-1]], pa.int64()), ids] + [_lists(made[k], pa.int64() if k == "terms" else pa.int32()) for k in made]
        yield pa.RecordBatch.from_arrays(columns, names=["m", "ids", *made])


@dataclass
class Wanted:
    """Items of one pass: entries (item, term) sorted by item, as positions in the sorted distinct ``terms``."""

    ids: pa.Array
    offsets: np.ndarray
    code: np.ndarray
    terms: np.ndarray
    weight: np.ndarray | None = None

    @classmethod
    def of(cls, entries: pa.Table) -> Wanted:
        order = pc.sort_indices(entries, sort_keys=[("item_id", "ascending"), ("term", "ascending")])
        entries = entries.take(order).combine_chunks()
        ids = entries.column("item_id").combine_chunks().dictionary_encode("encode")
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        terms, code = np.unique(entries.column("term").to_numpy(), return_inverse=True)
        item = ids.indices.to_numpy()
        names = ids.dictionary
        rank = np.zeros(len(names), np.int64)
        first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        rank[item[first]] = np.arange(len(first))
        return cls(names.take(pa.array(item[first])), np.r_[first, len(item)], code, terms)

    def __len__(self) -> int:
        return len(self.ids)


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Block:
    """One row of the index, met with the terms of the items."""

    def __init__(self, wanted: Wanted, m: int, terms: np.ndarray, tops: np.ndarray) -> None:
        at = np.searchsorted(terms, wanted.terms)
        self.at = np.where(np.append(terms, 0)[at] == wanted.terms, at, -1)
        self.at[at >= len(terms)] = -1
        self.wanted, self.m = wanted, m
        best = np.where(self.at >= 0, impact(tops.astype(np.int64)[self.at], m), 0)
        self.bounds = np.add.reduceat((wanted.weight * best)[wanted.code], wanted.offsets[:-1])

    def scores(self, items: np.ndarray, counts: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, members: np.ndarray, n_docs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(items, their scores of all documents of the block), a bounded number of postings at a time."""
        wanted = self.wanted
        member_impact = np.repeat(impact(tfs.astype(np.int64), self.m), sizes)
        begin = np.cumsum(counts) - counts
        exact_float = self.bounds.max(initial=0) < 1 << 53
        per_item = np.add.reduceat(np.where(self.at >= 0, counts[self.at], 0)[wanted.code], wanted.offsets[:-1])[items]
        part = np.cumsum(per_item) // _AT_ONCE
        for some in np.split(items, np.flatnonzero(np.diff(part)) + 1):
            lengths = wanted.offsets[some + 1] - wanted.offsets[some]
            entry = np.repeat(wanted.offsets[some] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            row = np.repeat(np.arange(len(some)), lengths)
            term = self.at[wanted.code[entry]]
            row, code, term = row[term >= 0], wanted.code[entry][term >= 0], term[term >= 0]
            n = counts[term].astype(np.int64)
            where = np.repeat(begin[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            key = np.repeat(row * n_docs, n) + members[where]
            value = np.repeat(wanted.weight[code], n) * member_impact[where]
            if exact_float:
                dense = np.bincount(key, value, len(some) * n_docs).astype(np.int64)
            else:
                dense = np.zeros(len(some) * n_docs, np.int64)
                np.add.at(dense, key, value)
            yield some, dense.reshape(len(some), n_docs)


class Best:
    """The highest-scoring documents of each item so far, equal scores by ascending id."""

    def __init__(self, n_items: int, k: int, needed: np.ndarray) -> None:
        self.k, self.needed = k, needed.copy()
        self._parts: list[pa.Table] = []
        self._held, self._n_items = 0, n_items

    def add(self, items: np.ndarray, scores: np.ndarray, ids: pa.Array) -> None:
        if len(items):
            self._parts.append(pa.table({"item": items.astype(np.int64), "score": scores, "id": ids}))
            self._held += len(items)
            if self._held > 4 * self.k * self._n_items + 10_000:
                self.settle()

    def settle(self) -> pa.Table | None:
        if not self._parts:
            return None
        held = pa.concat_tables(self._parts)
        held = held.take(pc.sort_indices(held, sort_keys=[("item", "ascending"), ("score", "descending"), ("id", "ascending")]))
        item = held.column("item").to_numpy()
        first = np.searchsorted(item, np.arange(self._n_items))
        held = held.take(pa.array(np.flatnonzero(np.arange(len(item)) - first[item] < self.k)))
        item, score = held.column("item").to_numpy(), held.column("score").to_numpy()
        last = np.flatnonzero(np.bincount(item, minlength=self._n_items) == self.k)
        ends = np.searchsorted(item, last, "right") - 1
        self.needed[last] = np.maximum(self.needed[last], score[ends])
        self._parts, self._held = [held], held.num_rows
        return held


def _each(batch: pa.RecordBatch, *names: str) -> Iterator[list[np.ndarray]]:
    held = [_ragged(batch.column(k)) for k in names]
    for i in range(batch.num_rows):
        yield [values[at[i] : at[i + 1]] for values, at in held]


def _frequencies(blocks: DataFrame, wanted: Wanted) -> np.ndarray:
    """Documents that hold each wanted term."""
    sent = blocks.sparkSession.sparkContext.broadcast(wanted.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value) + 1, np.int64)
        for batch in tx.released(batches):
            term, _ = _ragged(batch.column("terms"))
            n, _ = _ragged(batch.column("counts"))
            at = np.searchsorted(sent.value, term)
            known = np.append(sent.value, 0)[at] == term
            total += np.bincount(at[known], n[known], len(total)).astype(np.int64)
        code = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_pydict({"code": code, "df": total[code]})

    found = blocks.select("terms", "counts").mapInArrow(count, "code long, df long").groupBy("code").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(wanted.terms), np.int64)
    df[found.column("code").to_numpy()] = found.column("df").to_numpy()
    sent.destroy()
    return df


def _best_blocks(blocks: DataFrame, sent) -> DataFrame:
    """(item, block) of the block with the highest bound of each item."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value[0]
        top, where = np.zeros(len(wanted), np.int64), np.full(len(wanted), -1)
        for batch in tx.released(batches):
            for m, block, (terms, tops) in zip(batch.column("m").to_pylist(), batch.column("block").to_pylist(), _each(batch, "terms", "tops"), strict=True):
                here = Block(wanted, m, terms, tops).bounds
                where = np.where(here > top, block, where)
                top = np.maximum(top, here)
        item = np.flatnonzero(where >= 0)
        yield pa.RecordBatch.from_pydict({"item": item, "bound": top[item], "block": where[item]})

    each = blocks.select("m", "block", "terms", "tops").mapInArrow(bound, "item long, bound long, block long")
    return each.groupBy("item").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))


def _visit(blocks: DataFrame, sent, k: int, id_type: T.DataType) -> DataFrame:
    """(item, score, id) of at least the k highest-scoring documents of each item above its needed score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, needed = sent.value
        best = Best(len(wanted), k, needed)
        for batch in tx.released(batches):
            met = [Block(wanted, m, *own) for m, own in zip(batch.column("m").to_pylist(), _each(batch, "terms", "tops"), strict=True)]
            ids, ids_at = batch.column("ids"), batch.column("ids").offsets.to_numpy(zero_copy_only=False)
            postings = list(_each(batch, "counts", "tfs", "sizes", "members"))
            for i in sorted(range(len(met)), key=lambda i: -met[i].bounds.max(initial=0)):
                items = np.flatnonzero(met[i].bounds >= best.needed)
                if not len(items):
                    continue
                own = ids.values.slice(ids_at[i], ids_at[i + 1] - ids_at[i])
                for some, dense in met[i].scores(items, *postings[i], len(own)):
                    row, doc = np.nonzero(dense >= best.needed[some][:, None])
                    best.add(some[row], dense[row, doc], own.take(pa.array(doc)))
            best.settle()
        held = best.settle()
        if held is not None:
            yield from held.combine_chunks().to_batches()

    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("score", T.LongType()), T.StructField("id", id_type)])
    return blocks.mapInArrow(run, schema)


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _pass(index: Index, entries: pa.Table, k: int, id_type: T.DataType) -> DataFrame:
    """(item_id, rank, doc_id, score) of the items of one pass."""
    spark = index.blocks.sparkSession
    context = spark.sparkContext
    wanted = Wanted.of(entries)
    df = _frequencies(index.blocks, wanted)
    wanted.weight = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    needed = np.ones(len(wanted), np.int64)

    # the block with the highest bound of each item gives the score that its k-th document reaches at least
    sent = context.broadcast((wanted, needed))
    chosen = cut_lineage(_best_blocks(index.blocks, sent))
    first = index.blocks.join(F.broadcast(chosen.select("block").distinct()), "block")  # a row per item of a bounded pass
    reached = _top(_visit(first, sent, k, id_type), k).where(F.col("rank") == k).select("item", "score").collect()
    for r in reached:
        needed[r["item"]] = r["score"]
    drop_table(chosen)

    sent = context.broadcast((wanted, needed))
    ranked = cut_lineage(_top(_visit(index.blocks, sent, k, id_type), k))
    names = context.broadcast(wanted.ids)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item = names.value.take(batch.column("item"))
            yield pa.RecordBatch.from_arrays([item, batch.column("rank"), batch.column("id"), batch.column("score")], names=["item_id", "rank", "doc_id", "score"])

    fields = [T.StructField("rank", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())]
    from pyspark.sql.pandas.types import from_arrow_type

    return ranked.mapInArrow(named, T.StructType([T.StructField("item_id", from_arrow_type(wanted.ids.type)), *fields]))


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the k highest-scoring documents of each item, with a score above 0.

    Terms are runs of ASCII letters (lower-cased), digits and characters beyond
    ASCII.  Items that share an id are one item with the terms of all; an item
    without terms, or whose terms no document holds, has no row; a null item id
    is an item like any other.  Equal scores are ranked by ascending id, rows
    that share an id are ranked apart.  Null and empty texts are never found.
    Empty tables give no rows.  Other columns are not read.

    The items' terms are sent to the tasks that build the index while there are
    at most ``MOST_TERMS`` of them, else every term is indexed.  Items are
    searched ``MOST_ENTRIES`` terms at a time, each time over the whole index.
    """
    entries = cut_lineage(item_terms(items, item_id_col, item_text_col))
    index = build(docs, _vocabulary(entries), id_col, text_col)
    id_type = index.blocks.schema["ids"].dataType.elementType
    passes = max(1, -(-entries.count() // MOST_ENTRIES))
    out = None
    for i in range(passes):
        own = entries if passes == 1 else entries.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i)
        own = own.toArrow()
        if not own.num_rows:
            continue
        found = _pass(index, own, k, id_type)
        out = found if out is None else out.unionByName(found)
    index.drop()
    drop_table(entries)
    if out is None:
        item_type = entries.schema["item_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type.simpleString()}, score long")
    return out
