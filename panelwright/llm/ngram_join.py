"""Near-duplicate documents by the Jaccard similarity of their word n-grams, exactly.

Equal sets are one class.  Of each class's set, tokens that no other class has
cannot be shared, so they only count; the others get their document frequency
and are put in the order of it.  In that order two sets that are similar share a
token near the beginning: a document's prefix.  A prefix lengthened by l - 1
tokens must share l of them; each document takes the l with the lowest estimated
cost, from the frequencies of the tokens that would be in it.  The entries that
two lengthened prefixes share are counted, and only pairs that share as many as
the smaller l asks for are verified.

``similar_pairs`` lets documents meet at the entries of the lengthened prefixes.
Groups of near copies are not expanded into pairs: there every token of the
shortest prefixes first links its documents to one of them (what precedes the
token bounds the overlap, so entries carry the sizes of the sets they may still
meet), then pairs that are still in different components meet at these tokens,
and the lengthened prefixes of a pair are counted against each other before its
sets are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import text as tx
from panelwright.llm.components import components
from panelwright.session import cut_lineage, drop_table

WORDS = 5
#: Similarity as a fraction of integers: intersection / union >= 3 / 4.
ABOVE, BELOW = 3, 4
#: Most tokens that a prefix may have to share before a pair is verified.
MOST_MATCHES = 8
#: Tokens that one task merges at a time, about.
RANGE_TOKENS = 500_000
#: Most ids of repeated documents that are sent to every task; more are joined by a shuffle.
SENT_ROWS = 1_000_000


def shingle_sets(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, and the offsets of the texts in them.

    Words are runs without white space, in lower case (A-Z).  A text of fewer
    words than ``size`` has its whole sequence as one n-gram, one without words
    none.
    """
    data, offsets = tx.flat(texts)
    w = tx.words(tx.LOWER[data], offsets, tx.NOT_SPACE)
    w.data = tx.LOWER[data]
    h = tx.word_hashes(w)
    grams, first = tx.window_hashes(h, w.at, size)
    grams = grams.copy()
    at = np.searchsorted(first, w.at)
    n = w.per_text
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        short = [tx.combine([np.array([k], np.uint64), *(h[j : j + 1] for j in range(w.at[t], w.at[t] + k))])[0] for t, k in zip(few, n[few], strict=True)]
        grams = np.insert(grams, at[few], np.array(short, np.uint64))
        at = at + np.searchsorted(few, np.arange(len(at)), side="left")
    for a, b in zip(at[:-1], at[1:], strict=True):
        grams[a:b].sort()
    fresh = np.ones(len(grams), bool)
    fresh[1:] = grams[1:] != grams[:-1]
    fresh[at[:-1][at[:-1] < len(grams)]] = True
    return grams[fresh], np.r_[0, np.cumsum(fresh)][at]


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _set_ids(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number per set, equal for equal sets."""
    sizes = np.diff(at).astype(np.uint64)
    return tx.combine([_sums(tx.mix(grams), at), _sums(tx.mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at), sizes])


def set_table(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, n, node): size and number of the set of every row of (doc_id, text)."""

    def measure(texts: pa.Array) -> dict[str, object]:
        grams, at = shingle_sets(texts, size)
        return {"n": np.diff(at), "node": tx.signed(_set_ids(grams, at))}

    return tx.map_texts(docs, "text", measure, "n long, node long", keep=["doc_id"])


def _even_keys(spark: SparkSession, parts: int) -> list[int]:
    """One number per partition that hash partitioning sends there."""
    found: dict[int, int] = {}
    begin = 0
    while len(found) < parts:
        ids = spark.range(begin, begin + 16 * parts).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p"))
        for row in ids.groupBy("p").agg(F.min("id").alias("id")).collect():
            found.setdefault(row.p, row.id)
        begin += 16 * parts
    return [found[p] for p in range(parts)]


_LOW = np.uint64((1 << 40) - 1)
_LOCAL = 0xFFFF


def shared_tokens(docs: DataFrame, size: int = WORDS, total: int = 0) -> DataFrame:
    """(node, token, df) of the tokens that at least two of the rows of (doc_id, text) have.

    Each task sends the tokens of a block of documents to ranges of the hash
    space, packed as arrays.  There are so many ranges that one holds about
    ``RANGE_TOKENS`` of the ``total`` tokens, and a task merges one range after
    the other.  A token that several documents of a block have is sent once with
    their number, so a token of a third of all documents costs a row per block;
    who has it is joined to its frequency afterwards, by a join whose hot keys
    Spark can split.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_task = max(1, -(-total // (tasks * RANGE_TOKENS)))
    keys = np.repeat(np.array(_even_keys(spark, tasks), np.int32), per_task)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.released(batches):
            for block in tx.blocks(batch, "text"):
                for part in (block.slice(i, _LOCAL) for i in range(0, block.num_rows, _LOCAL)):
                    yield _packed(part.column("text"), size, keys)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in tx.released(batches):
            for row in batch.to_pylist():
                if held and held[-1]["part"] != row["part"]:
                    yield from _frequent(held)
                    held = []
                held.append(row)
        if held:
            yield from _frequent(held)

    packed = "key int, part int, nodes binary, tokens binary, owner binary, counts binary, local_nodes binary, local_tokens binary"
    sent = tx.small_batches(docs).select("text").mapInArrow(send, packed)
    ranged = sent.repartition(tasks, "key").sortWithinPartitions("part")
    found = cut_lineage(ranged.mapInArrow(merge, "node long, token long, df long"))
    alone = found.where("node is not null and df is not null")
    # tokens that a block holds several times: their frequency, and who has them
    often = found.where("node is null").select("token", "df")
    local = found.where("df is null").select("node", "token")
    return alone.union(local.join(often, "token").select("node", "token", "df"))


def _slices(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of ``values[cuts[i]:cuts[i + 1]]`` for each i."""
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    at = (cuts * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _packed(texts: pa.Array, size: int, keys: np.ndarray) -> pa.RecordBatch:
    """A row per hash range: the block's tokens there as 5-byte numbers, with their owners or their count."""
    parts = len(keys)
    every = np.arange(parts + 1)
    grams, at = shingle_sets(texts, size)
    nodes = _set_ids(grams, at)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    part = (((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(grams), bool)
    first[1:] = grams[1:] != grams[:-1]
    start = np.flatnonzero(first)
    times = np.diff(np.r_[start, len(grams)])
    repeated = np.repeat(times > 1, times)
    # pairs (node, token) of repeated tokens travel by node, not by token
    pair_node, pair_token = nodes[owner[repeated]], (part[repeated].astype(np.uint64) << np.uint64(40)) | (grams[repeated] & _LOW)
    to = (pair_node % np.uint64(parts)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    pair_node, pair_token = pair_node[by], pair_token[by]
    pair_cut = np.searchsorted(to[by], every)
    at_part = part[start]
    cut = np.searchsorted(at_part, every)
    alone = times == 1
    # who has the tokens of a range, each document once, and their places in that list
    who, place = np.unique((at_part[alone] << 16) | owner[start[alone]], return_inverse=True)
    who_cut = np.searchsorted(who >> 16, every)
    mark = np.full(len(start), _LOCAL, "<u2")
    mark[alone] = place - who_cut[at_part[alone]]
    low = (grams[start] & _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    columns = {
        "key": pa.array(keys, pa.int32()),
        "part": pa.array(every[:-1], pa.int32()),
        "nodes": _slices(nodes[who & 0xFFFF], who_cut),
        "tokens": _slices(low, cut),
        "owner": _slices(mark, cut),
        "counts": _slices(times[~alone].astype("<u4"), np.searchsorted(at_part[~alone], every)),
        "local_nodes": _slices(pair_node, pair_cut),
        "local_tokens": _slices(pair_token, pair_cut),
    }
    some = np.flatnonzero((np.diff(cut) > 0) | (np.diff(pair_cut) > 0))
    return pa.RecordBatch.from_pydict(columns).take(pa.array(some))


def _frequent(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """Adds up one hash range: owners of tokens that several blocks have, and frequencies of those a block repeats."""
    tokens, nodes, counts = [], [], []
    for row in rows:
        low = np.zeros((len(row["tokens"]) // 5, 8), np.uint8)
        low[:, :5] = np.frombuffer(row["tokens"], np.uint8).reshape(-1, 5)
        tokens.append(low.view("<u8").ravel())
        mark = np.frombuffer(row["owner"], "<u2")
        known = np.frombuffer(row["nodes"], np.uint64)
        own = np.zeros(len(mark), np.uint64)
        own[mark != _LOCAL] = known[mark[mark != _LOCAL]]
        nodes.append(own)
        count = np.ones(len(mark), np.int64)
        count[mark == _LOCAL] = np.frombuffer(row["counts"], "<u4")
        counts.append(count)
    part = np.uint64(rows[0]["part"])
    token, node, count = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(counts)
    order = np.argsort(token, kind="stable")
    token, node, count = token[order], node[order], count[order]
    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
    total = np.add.reduceat(count, start) if len(start) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[start, len(token)])
    df = np.repeat(total, sizes)
    full = token | (part << np.uint64(40))
    single = (count == 1) & (df > 1)
    has_local = np.logical_or.reduceat(count > 1, start) if len(start) else np.zeros(0, bool)
    heads = start[has_local]
    pair_node = np.concatenate([np.frombuffer(r["local_nodes"], np.int64) for r in rows])
    pair_token = np.concatenate([np.frombuffer(r["local_tokens"], np.int64) for r in rows])
    none = lambda n: pa.nulls(n, pa.int64())
    for a, b, c in (
        (pa.array(tx.signed(node[single])), pa.array(tx.signed(full[single])), pa.array(df[single])),
        (none(len(heads)), pa.array(tx.signed(full[heads])), pa.array(total[has_local])),
        (pa.array(pair_node), pa.array(pair_token), none(len(pair_node))),
    ):
        for i in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([x.slice(i, 50_000) for x in (a, b, c)], names=["node", "token", "df"])


def _matches(shared: Column, n: Column, need: Column, base: Column) -> Column:
    """The number l of matches for which reading prefix entries and verifying candidates costs least.

    A prefix with l - 1 more tokens is read in as many entries as its tokens'
    frequencies add up to; at most an l-th of them can be candidates.  Similar
    sets need not share more tokens than ``need``, so l stays within it.
    """

    def cost(k: int) -> Column:
        read = F.aggregate(F.slice(shared, F.lit(1), base + k - 1), F.lit(0.0), lambda s, t: s + t["df"] - 1)
        return F.when(need >= k, F.struct((read * (1 + n / k)).alias("cost"), F.lit(k).alias("l")))

    return F.array_min(F.array(*[cost(k) for k in range(1, MOST_MATCHES + 1)]))["l"]


def _prefixes(tokens: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, n, shared, base, l) of the classes whose prefix reaches tokens that others have.

    ``shared`` holds those tokens from rare to frequent, ``base`` the number of
    them in the prefix for one match.
    """
    held = tokens.groupBy("node").agg(F.array_sort(F.collect_set(F.struct("df", "token"))).alias("shared"))
    n = F.col("n")
    need = F.ceil(n * ABOVE / BELOW).cast("int")
    own = (n - F.size("shared")).cast("int")
    base = F.least((n - need + 1).cast("int") - own, F.size("shared"))
    out = held.join(sizes, "node").withColumn("base", base).where("base > 0")
    return out.select("node", n.cast("int").alias("n"), F.col("shared.token").alias("tokens"), "base", _matches(F.col("shared"), n, need, F.col("base")).alias("l"))


def _entries(prefixes: DataFrame) -> DataFrame:
    """(token, node, n, own, most): prefix entries, with the largest partner for which the entry may come first.

    With ``rem`` tokens left from the entry on, an overlap of 3/7 of both sizes
    together needs a partner of at most 7/3 rem - n.
    """
    both = ABOVE + BELOW
    place = F.posexplode(F.slice("tokens", F.lit(1), F.col("base")))
    spread = prefixes.select("node", "n", F.size("tokens").alias("m"), place.alias("j", "token"))
    rem = F.col("m") - F.col("j")
    own = F.col("n") - F.col("m")
    return spread.select("token", "node", "n", own.alias("own"), F.floor((both * rem - ABOVE * F.col("n")) / ABOVE).cast("int").alias("most"))


def _lengthened(prefixes: DataFrame) -> DataFrame:
    """(token, node, n, l, rem): the entries of the prefix for l matches, with the tokens from each entry on."""
    place = F.posexplode(F.slice("tokens", F.lit(1), F.col("base") + F.col("l") - 1)).alias("j", "token")
    return prefixes.select("node", "n", "l", F.size("tokens").alias("m"), place).select("token", "node", "n", "l", (F.col("m") - F.col("j")).alias("rem"))


def _linked(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(a, b, na, nb, shared) of the pairs that are similar by their whole sets."""
    side = lambda k: prefixes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("tokens").alias(f"t{k}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    out = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("shared"))
    return out.where((ABOVE + BELOW) * F.col("shared") >= ABOVE * (F.col("na") + F.col("nb")))


def _matched(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose lengthened prefixes share as many entries as the smaller l of the two."""
    own = F.slice("tokens", F.lit(1), F.col("base") + F.col("l") - 1)
    side = lambda k: prefixes.select(F.col("node").alias(k), own.alias(f"p{k}"), F.col("l").alias(f"l{k}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return both.where(F.size(F.array_intersect("pa", "pb")) >= F.least("la", "lb")).select("a", "b")


def _may_meet(x: str, y: str) -> Column:
    return (F.col(f"{x}.n") <= F.col(f"{y}.most")) & (F.col(f"{y}.n") <= F.col(f"{x}.most"))


def _star_pairs(entries: DataFrame) -> DataFrame:
    """Pairs of the documents of each token with one that may be the smaller one.

    That is the one with the fewest tokens of its own: of a group of near copies
    most likely the text they were made from, which is similar to all of them.
    """
    hubs = entries.where("most >= n").groupBy("token").agg(F.min(F.struct("own", "node", "n", "most")).alias("hub"))
    hubs = cut_lineage(hubs.select("token", "hub.*").drop("own"))
    met = entries.alias("x").join(hubs.alias("y"), "token").where(_may_meet("x", "y") & (F.col("x.node") != F.col("y.node")))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(BELOW / ABOVE)) + 1e-9).cast("int")


def _all_pairs(entries: DataFrame, apart: Column) -> DataFrame:
    """(a, b) of the documents that may meet at an entry of their shortest prefixes, by token and band of sizes."""
    small = entries.where("most >= n").withColumn("band", F.explode(F.sequence(_band(F.col("n")), _band(F.col("most")))))
    large = entries.withColumn("band", _band(F.col("n")))
    order = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & order & _may_meet("x", "y") & apart
    met = small.alias("x").join(large.alias("y"), on)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _counted_pairs(entries: DataFrame, apart: Column | None = None) -> DataFrame:
    """(a, b, met) of the pairs whose lengthened prefixes share as many entries as the smaller l of the two.

    Two similar sets share l tokens in their prefixes for l matches, for every l
    up to their overlap, so none is missed.  Of these the first l are enough: at
    each of them fewer than l tokens were shared before and what is left of both
    sets bounds the rest, so a meeting from which the overlap cannot be reached
    is not counted.  Documents meet by token and band of sizes; meetings are
    added up before and after the shuffle.
    """
    n, most = F.col("n"), F.floor(F.col("n") * BELOW / ABOVE).cast("int")
    small = entries.withColumn("band", F.explode(F.sequence(_band(n), _band(most))))
    large = entries.withColumn("band", _band(n))
    order = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & order & (ABOVE * F.col("y.n") <= BELOW * F.col("x.n"))
    least = F.least("x.l", "y.l")
    on = on & ((ABOVE + BELOW) * (least - 1 + F.least("x.rem", "y.rem")) >= ABOVE * (F.col("x.n") + F.col("y.n")))
    if apart is not None:
        on = on & apart
    met = small.alias("x").join(large.alias("y"), on)
    pairs = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), least.alias("l"))
    return pairs.groupBy("a", "b", "l").agg(F.count("*").alias("met")).where(F.col("met") >= F.col("l")).drop("l")


def _prepared(docs: DataFrame, id_col: str, text_col: str, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets of all rows, classes of more than one row, and the prefixes of the classes."""
    rows = tx.narrow(docs, id_col, text_col)
    sets = cut_lineage(set_table(rows, size))
    classes = cut_lineage(sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.count("*").alias("times")))
    repeated = classes.where("times > 1").select("node", "first")
    # ids of which no row is the first of its set; a repeated id's other rows may be
    mine = sets.join(repeated, "node", "left").select("doc_id", F.coalesce(F.col("doc_id") != F.col("first"), F.lit(False)).alias("again"))
    again = cut_lineage(mine.groupBy("doc_id").agg(F.min("again").alias("again")).where("again").select("doc_id"))
    few = again.count() <= SENT_ROWS
    firsts = rows.join(F.broadcast(again) if few else again, "doc_id", "left_anti")
    total = int(classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    prefixes = cut_lineage(_prefixes(shared_tokens(firsts, size, total), classes.select("node", "n")))
    return sets, classes, prefixes


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """(a, b, jaccard): all pairs of different sets with a similarity of 3/4 or more.

    Each set is named by the smallest id of its rows; rows of equal sets are not
    expanded into pairs (``near_duplicates`` gives every row its class).
    """
    _, classes, prefixes = _prepared(docs, id_col, text_col, size)
    linked = _linked(cut_lineage(_counted_pairs(cut_lineage(_lengthened(prefixes)))), prefixes)
    name = classes.select("node", "first")
    out = linked.join(name.toDF("a", "fa"), "a").join(name.toDF("b", "fb"), "b")
    jaccard = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return out.select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"), jaccard.alias("jaccard"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    The component is named by the smallest id that a chain of similar texts
    reaches.  Null and empty texts, and those without words, have 0 n-grams and
    are linked with nothing.  A row with a null id is compared like any other;
    where a component holds only null ids its name is null.  Equal rows stay as
    many rows.
    """
    return _named_sets(docs, id_col, text_col, size).drop("node")


def _named_sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, node) for every row."""
    sets, classes, prefixes = _prepared(docs, id_col, text_col, size)
    entries = cut_lineage(_entries(prefixes))
    tried = cut_lineage(_star_pairs(entries))
    links = cut_lineage(_linked(_matched(tried, prefixes), prefixes).select("a", "b"))
    root = cut_lineage(components(links))
    # what the first links leave open: tokens whose documents are still in several components
    labelled = cut_lineage(entries.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")))
    open_ = cut_lineage(labelled.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token"))
    rest = cut_lineage(labelled.join(open_, "token"))
    drop_table(labelled)
    met = cut_lineage(_all_pairs(rest, F.col("x.root") != F.col("y.root")))
    untried = _matched(met.join(tried, ["a", "b"], "left_anti"), prefixes)
    more = _linked(untried, prefixes).select("a", "b")
    all_links = cut_lineage(links.union(more))
    for done in (entries, tried, links, root, open_, rest, met, prefixes):
        drop_table(done)
    final = cut_lineage(components(all_links))
    drop_table(all_links)
    # the smallest id of each component, for every class of it
    named = classes.join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = cut_lineage(named.select("node", "root", "first"))
    names = cut_lineage(named.groupBy("root").agg(F.min("first").alias("component_id")))
    per_class = cut_lineage(named.join(names, "root").select("node", "component_id"))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return sets.join(per_class, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "node")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """The rows whose id names their component, with all their columns; rows with a null id stay.

    Of an id that stands on rows with different texts, only the rows go whose
    own text is in a component of a smaller id.
    """
    found = cut_lineage(_named_sets(docs, id_col, text_col, size))
    goes = F.col("doc_id") != F.col("component_id")
    gone = found.where(goes).select("doc_id").distinct()
    split = cut_lineage(found.where(~goes).select("doc_id").join(gone, "doc_id", "left_semi").distinct())
    if split.isEmpty():
        return _without(docs, id_col, cut_lineage(gone))
    whole = _without(docs, id_col, cut_lineage(gone.join(split, "doc_id", "left_anti")))
    name, split = F.col(f"`{id_col}`"), split.withColumnRenamed("doc_id", "_split")
    some = whole.join(split, name == F.col("_split"), "left_semi")
    nodes = lambda texts: {"_node": tx.signed(_set_ids(*shingle_sets(texts, size)))}
    numbered = tx.map_texts(some.withColumn("_text", F.col(f"`{text_col}`").cast("string")), "_text", nodes, "_node long").drop("_text")
    sets = found.where(goes).select(F.col("doc_id").alias("_gone"), F.col("node").alias("_gone_node")).distinct()
    left = numbered.join(sets, (name == F.col("_gone")) & (F.col("_node") == F.col("_gone_node")), "left_anti").drop("_node")
    return whole.join(split, name == F.col("_split"), "left_anti").union(left)


def _without(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows whose id is not in ``gone``."""
    gone = gone.select(F.col("doc_id").alias("_gone"))
    few = gone.count() <= SENT_ROWS
    return docs.join(F.broadcast(gone) if few else gone, F.col(f"`{id_col}`") == F.col("_gone"), "left_anti")
