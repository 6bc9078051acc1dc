"""A hierarchical Pitman-Yor language model over words, learned from the whole corpus.

A word is drawn in the restaurant of the word before it.  The parent of that
restaurant is the one of the class of the word before: its ending (last two
bytes), one of 255 classes, or the text's beginning.  All classes share one
parent, the restaurant of the corpus, whose own base is uniform over the known
words and one unknown.  A table in one restaurant is a customer in its parent.

Given the number of customers and tables in each restaurant, words are
independent of each other.  So the corpus is counted once by word, in ranges of
the hash space, and each range seats its own words by Gibbs sampling: sweep by
sweep the customers of a word in one context leave and sit down again, given the
tables of its other contexts.  Predictive probabilities are averaged over the
sweeps after the first.  A word before has successors in many ranges; its
customers and tables are summed over all of them, range by range of the words
before, and go back to the ranges that seat its successors.

Scoring sends words back by range too.  Pairs of word and word before that make
up a 2^-20th of all tokens or more (at most 2^20 pairs, whatever the input) are
known to every task instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import labelled
from panelwright.llm import text as tx
from panelwright.llm.ngram_join import _even_keys
from panelwright.session import cut_lineage, drop_table

CLASSES = 256
#: Share of all tokens from which a pair of word and context is sent to every task.
SENT_SHARE = 2.0**-20
CONCENTRATION = 1.0
WARM_UP, SAMPLES = 3, 4
#: Seatings after which the sizes of all restaurants are summed again before the counted one.
SEATINGS = 1
_END = np.uint64(0x5E4D)
#: Bytes of text per range, about: ranges follow from the corpus alone, so no setting moves a score.
RANGE_BYTES = 16 << 20


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with one end per text, their context classes, and the offsets of the texts."""
    data, offsets = tx.flat(texts)
    w = tx.words(tx.LOWER[data], offsets, tx.NOT_SPACE)
    w.data = tx.LOWER[data]
    n = len(offsets) - 1
    h = tx.word_hashes(w)
    last = w.data[w.end - 1].astype(np.uint64) if len(h) else np.zeros(0, np.uint64)
    before = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.uint64) if len(h) else last
    ending = (tx.mix((before << np.uint64(8)) | last) % np.uint64(CLASSES - 1)).astype(np.int64) + 1
    at = w.at + np.arange(n + 1)
    total = len(h) + n
    place = np.arange(len(h)) + w.text_of
    word = np.full(total, _END, np.uint64)
    word[place] = h
    context = np.zeros(total, np.int64)
    context[place + 1] = ending
    context[at[:-1]] = 0
    return tx.mix(word), context, at


def _pairs(word: np.ndarray, context: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Range of each token, and its pair of word (40 bits of it) and context as one number."""
    part = (((word >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    pair = ((word & np.uint64((1 << 40) - 1)) << np.uint64(8)) | context.astype(np.uint64)
    return part, pair


def words_before(word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The word before each token, 32 bits of it; 0 at a text's beginning."""
    before = np.zeros(len(word), np.uint32)
    before[1:] = (tx.mix(word[:-1]) >> np.uint64(32)).astype(np.uint32)
    before[at[:-1]] = 0
    return before


def _joint(pair: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A pair and the word before as one number of 48 bits."""
    return tx.mix(pair ^ tx.mix(before.astype(np.uint64))) >> np.uint64(16)


@dataclass
class Totals:
    """What all ranges share: per class customers and tables, the parent's, and the corpus's sizes."""

    customers: np.ndarray
    tables: np.ndarray
    parent_customers: float
    parent_tables: float
    tokens: int
    words: int
    discount: float
    parent_discount: float
    own_discount: float = 0.75


def opened(rng: np.random.Generator, customers: np.ndarray, weight: np.ndarray, discount: float) -> np.ndarray:
    """Tables that customers of one dish open when they sit down one after the other.

    ``weight`` is the restaurant's mass for a new table with this dish.  The
    first customer opens one; from the 16th on, an eighth of those seated come
    in at once and meet the same tables.
    """
    tables = np.minimum(customers, 1).astype(float)
    active = np.flatnonzero(customers > 1)
    seated = 1
    while len(active):
        group = np.minimum(max(1, seated // 8), customers[active] - seated)
        held = tables[active]
        p = weight[active] / (seated + group / 2 - 0.5 - discount * held + weight[active])
        tables[active] = held + rng.binomial(group, np.clip(p, 0, 1))
        seated += max(1, seated // 8)
        active = active[customers[active] > seated]
    return tables


def _least(first: float, second: float) -> float:
    """Discount from the number of types seen once and twice."""
    return float(np.clip(first / (first + 2 * second), 0.05, 0.95)) if first + second else 0.5


class Seating:
    """The classes' restaurants, and the corpus's, of the words of one range."""

    def __init__(self, pair: np.ndarray, customers: np.ndarray, seed: int) -> None:
        self.pair, self.customers = pair, customers
        self.context = (pair & np.uint64(CLASSES - 1)).astype(np.int64)
        word = pair >> np.uint64(8)
        self.first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(pair) else np.zeros(0, np.int64)
        self.word = np.cumsum(np.r_[True, word[1:] != word[:-1]]) - 1 if len(pair) else np.zeros(0, np.int64)
        self.count = np.add.reduceat(customers, self.first) if len(pair) else np.zeros(0, np.int64)
        self.tables = np.minimum(customers, 1).astype(float)
        self.upper = np.bincount(self.word, self.tables, len(self.first))
        self.upper_tables = np.minimum(self.upper, 1)
        self._rng = np.random.Generator(np.random.PCG64(seed))
        # entries of a word take turns in four groups, so most of its other contexts stand while one is seated anew
        rank = np.arange(len(pair)) - self.first[self.word] if len(pair) else np.zeros(0, np.int64)
        self._turns = [np.flatnonzero((rank % 4 == k) & (customers > 0)) for k in range(4)]

    def totals(self, share: float) -> Totals:
        """Totals of all ranges if the others are like this one (``share`` of them all)."""
        customers = np.bincount(self.context, self.customers, CLASSES)
        tables = np.bincount(self.context, self.tables, CLASSES)
        words = int((self.count > 0).sum())
        return Totals(customers / share, tables / share, self.upper.sum() / share, self.upper_tables.sum() / share, int(self.customers.sum() / share), max(int(words / share), 1), 0.75, 0.75)

    def upper_share(self, t: Totals, without: np.ndarray | None = None, words: np.ndarray | None = None) -> np.ndarray:
        """Probability of each word (of ``words``) in the parent, less the tables of one of its contexts."""
        words = np.arange(len(self.first)) if words is None else words
        upper = self.upper[words] - (without if without is not None else 0)
        kept = np.minimum(self.upper_tables[words], upper)
        base = (CONCENTRATION + t.parent_discount * t.parent_tables) / (t.words + 1)
        return (np.maximum(upper - t.parent_discount * kept, 0) + base) / (CONCENTRATION + t.parent_customers)

    def share(self, t: Totals, without: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probability of the words of the pairs ``at`` in their classes, less some customers of each."""
        left = self.customers[at] - without
        kept = np.minimum(self.tables[at], left)
        mass = CONCENTRATION + t.discount * t.tables[self.context[at]]
        own = np.maximum(left - t.discount * kept, 0)
        return (own + mass * self.upper_share(t, None, self.word[at])) / (CONCENTRATION + t.customers[self.context[at]])

    def sweep(self, t: Totals) -> None:
        for turn in self._turns:
            word = self.word[turn]
            mass = CONCENTRATION + t.discount * t.tables[self.context[turn]]
            weight = mass * self.upper_share(t, self.tables[turn], word)
            new = opened(self._rng, self.customers[turn], weight, t.discount)
            self.upper += np.bincount(word, new - self.tables[turn], len(self.first))
            self.tables[turn] = new
        base = np.full(len(self.first), (CONCENTRATION + t.parent_discount * t.parent_tables) / (t.words + 1))
        self.upper_tables = opened(self._rng, self.upper.astype(np.int64), base, t.parent_discount)

    def probabilities(self, t: Totals) -> np.ndarray:
        """Probability of every pair's word in its context under the present seating."""
        mass = CONCENTRATION + t.discount * t.tables[self.context]
        own = np.maximum(self.customers - t.discount * self.tables, 0)
        return (own + mass * self.upper_share(t)[self.word]) / (CONCENTRATION + t.customers[self.context])


class Followers:
    """The restaurants of the words before, above them those of the classes, for the words of one range.

    Entries (pair, word before) are in ascending order.
    """

    def __init__(self, pair: np.ndarray, before: np.ndarray, customers: np.ndarray, seed: int) -> None:
        self.pair, self.before, self.customers = pair, before, customers
        new = np.r_[True, pair[1:] != pair[:-1]][: len(pair)]
        first = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.tables = np.minimum(customers, 1).astype(float)
        self.classes = Seating(pair[first], np.bincount(self.group, self.tables, len(first)).astype(np.int64), seed)
        self.word = self.classes.word[self.group]
        self.count = np.bincount(self.word, customers, len(self.classes.first)).astype(np.int64)
        own = (before.astype(np.uint64) << np.uint64(8)) | (pair & np.uint64(CLASSES - 1))
        self.contexts, self.context = np.unique(own, return_inverse=True)
        self._rng = np.random.Generator(np.random.PCG64([seed, 1]))
        # as in the classes' seating; a single customer keeps a single table
        rank = np.arange(len(pair)) - first[self.group]
        self._turns = [np.flatnonzero((rank % 4 == k) & (customers > 1)) for k in range(4)]

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each of ``contexts`` in this range."""
        n = len(self.contexts)
        return np.bincount(self.context, self.customers, n), np.bincount(self.context, self.tables, n)

    def sweep(self, t: Totals, context_tables: np.ndarray) -> None:
        for turn in self._turns:
            group = self.group[turn]
            mass = CONCENTRATION + t.own_discount * context_tables[self.context[turn]]
            weight = mass * self.classes.share(t, self.tables[turn], group)
            new = opened(self._rng, self.customers[turn], weight, t.own_discount)
            self.classes.customers += np.bincount(group, new - self.tables[turn], len(self.classes.pair)).astype(np.int64)
            self.tables[turn] = new
        self.classes.sweep(t)

    def probabilities(self, t: Totals, context_customers: np.ndarray, context_tables: np.ndarray) -> np.ndarray:
        """Probability of every entry's word after its word before under the present seating."""
        mass = CONCENTRATION + t.own_discount * context_tables[self.context]
        own = np.maximum(self.customers - t.own_discount * self.tables, 0)
        return (own + mass * self.classes.probabilities(t)[self.group]) / (CONCENTRATION + context_customers[self.context])

    def predictive(self, t: Totals, context_customers: np.ndarray, context_tables: np.ndarray) -> np.ndarray:
        """Probabilities averaged over the seatings after the warm-up."""
        for _ in range(WARM_UP):
            self.sweep(t, context_tables)
        total = np.zeros(len(self.pair))
        for _ in range(SAMPLES):
            self.sweep(t, context_tables)
            total += self.probabilities(t, context_customers, context_tables)
        return total / SAMPLES


def _counted(docs: DataFrame, parts: int, keys: np.ndarray, tasks: int) -> DataFrame:
    """(part, pairs, before, train, seen): for each range one row with its pairs, their words before, training count and count."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.released(batches):
            for block in tx.blocks(batch, "text"):
                word, context, at = tokens_of(block.column("text"))
                train = np.repeat(block.column("train").to_numpy(zero_copy_only=False).astype(bool), np.diff(at))
                before = words_before(word, at)
                part, pair = _pairs(word, context, parts)
                order = np.lexsort((before, pair, part))
                part, pair, before, train = part[order], pair[order], before[order], train[order]
                start = np.flatnonzero(np.r_[True, (before[1:] != before[:-1]) | (pair[1:] != pair[:-1]) | (part[1:] != part[:-1])])
                seen = np.diff(np.r_[start, len(pair)])
                of_train = np.add.reduceat(train.astype(np.int64), start)
                cut = np.searchsorted(part[start], np.arange(parts + 1))
                yield _by_part(keys, cut, pair[start], before[start].astype("<u4"), of_train.astype("<u4"), seen.astype("<u4"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _runs(tx.released(batches)):
            pair = np.concatenate([_spread(r["pairs"], "<u8") for r in rows])
            before, *counts = (np.concatenate([_spread(r[c], "<u4") for r in rows]) for c in ("before", "train", "seen"))
            order = np.lexsort((before, pair))
            pair, before = pair[order], before[order]
            start = np.flatnonzero(np.r_[True, (before[1:] != before[:-1]) | (pair[1:] != pair[:-1])])
            sums = [np.add.reduceat(c[order].astype(np.int64), start) for c in counts]
            yield _rows(part=[part], pairs=[_squeezed(pair[start])], before=[_squeezed(before[start])], train=[_squeezed(sums[0])], seen=[_squeezed(sums[1])])

    sent = tx.small_batches(docs).select("text", "train").mapInArrow(send, "key int, part int, pairs binary, before binary, train binary, seen binary")
    ranged = sent.repartition(tasks, "key").sortWithinPartitions("part")
    return ranged.mapInArrow(merge, "part int, pairs binary, before binary, train binary, seen binary")


def _met(sent: DataFrame, keys: np.ndarray, tasks: int) -> DataFrame:
    """(part, customers, tables): the contexts' sizes over all ranges, for each range in the order of its contexts.

    ``sent`` (key, part, of, ids, customers, tables) holds what range ``of`` has of
    the contexts in range ``part`` of the words before.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _runs(tx.released(batches)):
            ids = [_spread(r["ids"], "<u8") for r in rows]
            _, place = np.unique(np.concatenate(ids), return_inverse=True)
            cut = np.cumsum([len(i) for i in ids])[:-1]
            of = [r["of"] for r in rows]
            sums = [np.split(np.bincount(place, np.concatenate([_spread(r[c], "<i8") for r in rows])).astype(np.int64)[place], cut) for c in ("customers", "tables")]
            yield _rows(key=[int(keys[o]) for o in of], part=of, at=[part] * len(of), customers=[_squeezed(v) for v in sums[0]], tables=[_squeezed(v) for v in sums[1]])

    def line_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _runs(tx.released(batches)):
            yield _rows(part=[part], **{c: [_squeezed(np.concatenate([_spread(r[c], "<i8") for r in rows]))] for c in ("customers", "tables")})

    back = sent.repartition(tasks, "key").sortWithinPartitions("part").mapInArrow(meet, "key int, part int, at int, customers binary, tables binary")
    return back.repartition(tasks, "key").sortWithinPartitions("part", "at").mapInArrow(line_up, "part int, customers binary, tables binary")


def _squeezed(values: np.ndarray) -> bytes:
    """An array's bytes compressed plane by plane: sorted hashes and small counts have few bytes that differ."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _spread(squeezed: bytes, kind: str) -> np.ndarray:
    raw = pa.decompress(squeezed[8:], int.from_bytes(squeezed[:8], "little"), codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _rows(**columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k in ("key", "part", "of", "at") else pa.binary()) for k, v in columns.items()], names=list(columns))


def _by_part(keys: np.ndarray, cut: np.ndarray, pairs: np.ndarray, before: np.ndarray, train: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
    full = np.flatnonzero(np.diff(cut))
    piece = lambda a: [_squeezed(a[cut[p] : cut[p + 1]]) for p in full]
    return _rows(key=[int(keys[p]) for p in full], part=full.tolist(), pairs=piece(pairs), before=piece(before), train=piece(train), seen=piece(seen))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows with the same part, which stand together."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[-1]["part"] != row["part"]:
                yield held[-1]["part"], held
                held = []
            held.append(row)
    if held:
        yield held[-1]["part"], held


def _followers(row: dict) -> Followers:
    return Followers(_spread(row["pairs"], "<u8"), _spread(row["before"], "<u4"), _spread(row["train"], "<i8"), 1 + row["part"])


def _sizes(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Customers and tables of the contexts of a range, over all ranges."""
    return _spread(row["customers"], "<i8"), _spread(row["tables"], "<i8")


class Model:
    """Counts by range with the sizes of their contexts, written to the shared folder, and what the ranges share."""

    def __init__(self, docs: DataFrame) -> None:
        """Counts (text, train) and seats every range to learn the sizes of the restaurants.

        First every word has one table in each of its contexts; each seating
        follows the sizes that all ranges made in the one before.
        """
        spark = docs.sparkSession
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        self.parts = max(1, -(-int(size) // RANGE_BYTES))
        self.tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.keys = np.resize(np.array(_even_keys(spark, self.tasks), np.int64), self.parts)
        counts = cut_lineage(_counted(docs, self.parts, self.keys, self.tasks))
        self.totals, self.counts = None, counts
        for _ in range(1 + SEATINGS):
            self.totals, sizes = self._totals(self.counts)
            self.counts = counts.join(sizes, "part")
        self.known = self._known()

    def _totals(self, counts: DataFrame) -> tuple[Totals, DataFrame]:
        """Totals of all ranges after a seating under the present ones (none: one table each), and the sizes of the contexts."""
        parts, keys, before = self.parts, self.keys, self.totals

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    s = _followers(row)
                    if before is not None and s.customers.sum():
                        _, tables = _sizes(row)
                        for _ in range(WARM_UP):
                            s.sweep(before, tables)
                    c = s.classes
                    final = c.totals(1.0)
                    ones = [(v == k).sum() for v in (s.customers, c.customers, c.upper) for k in (1, 2)]
                    sizes = [c.upper.sum(), c.upper_tables.sum(), s.customers.sum(), (s.count > 0).sum(), _spread(row["seen"], "<i8").sum()]
                    values = np.r_[final.customers, final.tables, ones, sizes].astype(float)
                    n = len(values)
                    none = [pa.nulls(n, pa.binary())] * 3
                    of_all = [pa.nulls(n, pa.int32()), pa.array(np.full(n, -1), pa.int32()), pa.array(np.arange(n), pa.int32()), *none, pa.array(values)]
                    yield pa.RecordBatch.from_arrays(of_all, names=names)
                    to = ((s.contexts * np.uint64(parts)) >> np.uint64(40)).astype(np.int64)
                    cut = np.searchsorted(to, np.arange(parts + 1))
                    full = np.flatnonzero(np.diff(cut)).tolist()
                    arrays = s.contexts, *[v.astype("<i8") for v in s.sizes()]
                    pieces = [pa.array([_squeezed(v[cut[p] : cut[p + 1]]) for p in full], pa.binary()) for v in arrays]
                    ends = [pa.array([int(keys[p]) for p in full], pa.int32()), pa.array(full, pa.int32()), pa.array([row["part"]] * len(full), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*ends, *pieces, pa.nulls(len(full), pa.float64())], names=names)

        names = ["key", "part", "of", "ids", "customers", "tables", "value"]
        made = cut_lineage(counts.mapInArrow(run, "key int, part int, of int, ids binary, customers binary, tables binary, value double"))
        sums = made.where("part = -1").groupBy("of").agg(F.sum("value").alias("value")).collect()
        v = np.zeros(2 * CLASSES + 11)
        for row in sums:
            v[row.of] = row.value
        own_once, own_twice, once, twice, upper_once, upper_twice, upper, upper_tables, tokens, words, seen = v[2 * CLASSES :]
        self.seen = int(seen)
        discounts = _least(once, twice), _least(upper_once, upper_twice), _least(own_once, own_twice)
        totals = Totals(v[:CLASSES], v[CLASSES : 2 * CLASSES], upper, upper_tables, int(tokens), int(words), *discounts)
        sizes = cut_lineage(_met(made.where("part >= 0").drop("value"), self.keys, self.tasks))
        drop_table(made)
        return totals, sizes

    def _known(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Frequent entries by range: numbers in ascending order, log10 probability, training count of the word."""
        totals, least = self.totals, SENT_SHARE * self.seen

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    at = _spread(row["seen"], "<i8") >= least
                    if at.any():
                        number, value, count = _answers(row, totals, at)
                        yield _rows(part=[row["part"]], pairs=[number.tobytes()], train=[value.tobytes()], seen=[count.tobytes()])

        rows = self.counts.mapInArrow(run, "part int, pairs binary, train binary, seen binary").collect()
        return {r.part: (np.frombuffer(r.pairs, np.uint64), np.frombuffer(r.train, float), np.frombuffer(r.seen, np.int64)) for r in rows}


def _answers(row: dict, totals: Totals, at: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of a range's entries in ascending order, their log10 probability, training count of their word."""
    s = _followers(row)
    number, value, count = _joint(s.pair[at], s.before[at]), np.log10(s.predictive(totals, *_sizes(row))[at]), s.count[s.word[at]]
    order = np.argsort(number)
    return number[order], value[order], count[order]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(row, n_tokens, n_known, base_score, score) of each different row number of (row, text), added up over rows that share one."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model.known)
    totals, parts, keys, tasks = model.totals, model.parts, model.keys, model.tasks
    schema = "row long, n_tokens long, n_known long, base_score double, score double"
    wide = "key int, part int, pairs binary, before binary, train binary, seen binary, customers binary, tables binary, block long"
    names = [f.strip().split(" ")[0] for f in wide.split(",")]

    def base(count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (totals.tokens + 0.5 * (totals.words + 1)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6, pa.int64()]
        for batch in tx.released(batches):
            for block in tx.blocks(batch, "text"):
                word, context, at = tokens_of(block.column("text"))
                ids = block.column("row").to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(len(ids)), np.diff(at))
                part, pair = _pairs(word, context, parts)
                pair = _joint(pair, words_before(word, at))
                order = np.lexsort((pair, part))
                part, pair, owner = part[order], pair[order], owner[order]
                cut = np.searchsorted(part, np.arange(parts + 1))
                # blocks that share a number have the same rows in the same places
                number = int(tx.signed(np.array([tx.mix(ids.view(np.uint64) ^ tx.mix(np.arange(1, len(ids) + 1, dtype=np.uint64))).sum()], np.uint64))[0])
                sums = np.zeros((4, len(ids)))
                rest: dict[str, list] = {c: [] for c in names}
                for p in np.flatnonzero(np.diff(cut)).tolist():
                    mine, who = pair[cut[p] : cut[p + 1]], owner[cut[p] : cut[p + 1]]
                    if p in known:
                        pairs, value, count = known[p]
                        place = np.minimum(np.searchsorted(pairs, mine), len(pairs) - 1)
                        hit = pairs[place] == mine
                        got, by = place[hit], who[hit]
                        for k, x in enumerate((None, count > 0, base(count), value)):
                            sums[k] += np.bincount(by, None if x is None else x[got], len(ids))
                        mine, who = mine[~hit], who[~hit]
                    if len(mine):
                        start = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                        rest["key"].append(int(keys[p]))
                        rest["part"].append(p)
                        rest["pairs"].append(_squeezed(mine[start]))
                        rest["train"].append(_squeezed(np.diff(np.r_[start, len(mine)]).astype("<u4")))
                        some, local = np.unique(who, return_inverse=True)
                        rest["before"].append(_squeezed(some.astype("<u4")))
                        rest["seen"].append(_squeezed(local.astype("<u4")))
                # what is known already goes with the questions, as range -1
                rest["key"].append(int(keys[number % parts]))
                rest["part"].append(-1)
                rest["pairs"].append(_packed_sums(ids, sums))
                for c in ("before", "train", "seen"):
                    rest[c].append(None)
                rest["block"] = [number] * len(rest["key"])
                rest |= {c: [None] * len(rest["key"]) for c in ("customers", "tables")}
                yield pa.RecordBatch.from_arrays([pa.array(rest[c], k) for c, k in zip(names, kinds, strict=True)], names=names)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: tuple | None = None
        for batch in tx.released(batches):
            blocks, places, packed = [], [], []
            for row in batch.to_pylist():
                if row["part"] == -1:
                    blocks.append(row["block"])
                    places.append(None)
                    packed.append(row["pairs"])
                    continue
                if row["block"] is None:
                    table = _answers(row, totals)
                    continue
                pairs, value, count = table
                place = np.searchsorted(pairs, _spread(row["pairs"], "<u8"))
                place = np.repeat(place, _spread(row["train"], "<u4"))
                n, who = len(_spread(row["before"], "<u4")), _spread(row["seen"], "<u4")
                got = count[place]
                sums = [np.bincount(who, minlength=n), np.bincount(who, got > 0, n), np.bincount(who, base(got), n), np.bincount(who, value[place], n)]
                blocks.append(row["block"])
                places.append(row["before"])
                packed.append(np.array(sums, "<f8").tobytes())
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(places, pa.binary()), pa.array(packed, pa.binary())], names=["part", "places", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches):
            own = [np.frombuffer(r["sums"], float).reshape(5, -1) for r in rows if r["places"] is None]
            ids, sums = own[0][0].view(np.int64), sum(o[1:] for o in own)
            for r in rows:
                if r["places"] is not None:
                    sums[:, _spread(r["places"], "<u4")] += np.frombuffer(r["sums"], float).reshape(4, -1)
            cols = [ids, np.rint(sums[0]).astype(np.int64), np.rint(sums[1]).astype(np.int64), sums[2], sums[3]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["row", "n_tokens", "n_known", "base_score", "score"])

    own = keys[: tasks].tolist()  # the keys repeat after as many ranges as there are tasks
    key_of = F.get(F.array(*[F.lit(int(k)) for k in own]), F.col("part") % len(own))
    none = F.lit(None)
    seated = "part", "pairs", "before", "train", none.cast("binary").alias("seen"), "customers", "tables"
    first = model.counts.select(key_of.cast("int").alias("key"), *seated, none.cast("long").alias("block"))
    asked = tx.small_batches(docs).select("row", "text").mapInArrow(send, wide)
    # a range's counts come before its questions
    ranged = first.union(asked).repartition(tasks, "key").sortWithinPartitions("part", F.col("block").isNotNull())
    # a block's answers, one row per range, meet again and are added up per document
    answers = ranged.mapInArrow(settle, "part long, places binary, sums binary").repartition(tasks, "part").sortWithinPartitions("part")
    out = answers.mapInArrow(add, schema)
    return out.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])


def _packed_sums(ids: np.ndarray, sums: np.ndarray) -> bytes:
    """Row numbers and four sums of each, as one array of eight-byte values."""
    return ids.astype("<i8").tobytes() + np.ascontiguousarray(sums, "<f8").tobytes()


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row.

    Learns from the rows whose crc32 of the id as text, modulo 5, is not
    ``held_out``.  Tokens are words without white space in lower case (A-Z) and
    one end per text; null and empty texts have the end alone.  ``base_score``
    is the additive unigram model's, ``score`` the averaged model's log10
    probability; perplexity is per token.  Equal rows stay as many rows, each
    with its own score; without training rows both models are uniform.
    """
    held = labelled.fold("doc_id") == held_out
    rows = tx.narrow(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held.alias("held_out"))
    rows = rows.withColumn("row", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    model = Model(rows.select("text", (~F.col("held_out")).alias("train")))
    sums = score(rows, model)
    # rows that share a number are equal and were added up: each has one end, so their tokens tell how many they are
    own = rows.select("doc_id", "held_out", "row")
    times = own.groupBy("row").agg(F.count("*").alias("times"))
    joined = own.join(sums.join(times, "row"), "row")
    share = lambda c: F.col(c) / F.col("times")
    return joined.select(
        "doc_id",
        "held_out",
        share("n_tokens").cast("long").alias("n_tokens"),
        share("n_known").cast("long").alias("n_known"),
        F.lit(model.totals.tokens).cast("long").alias("train_tokens"),
        share("base_score").alias("base_score"),
        share("score").alias("score"),
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
