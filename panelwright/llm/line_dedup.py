"""Corpus-wide line deduplication with an edit bound, by a deletion-neighbourhood join.

Lines are compared as lists of words in lower case.  Two lines of at least
``MIN_WORDS`` words are alike if at most one word has to be inserted, deleted or
replaced; shorter lines only if equal.  A line goes if an earlier line (by
document id, then line number) is alike.

A line's neighbourhood holds each way of leaving one word out and each place
where one could be put in, as hashes of what stands before and after that
place.  All lines that share such a hash are alike, so each needs to meet only
the earliest of them.  Because an edit leaves either the beginning or the end of
a line as it is, only lines that share one of these with another line emit
their neighbourhood, and only on the other side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.session import cut_lineage

MIN_WORDS = 8
#: Most rows (and numbers in them) that are sent to every task; more are joined by a shuffle.
SENT_ROWS = 1_000_000
_BLOCK = 32


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, not once per element of a later lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sent(small: DataFrame, size: Column | None = None) -> DataFrame:
    """Marks a written table for sending to every task if its size is within the bound."""
    total = small.agg(F.coalesce(F.sum(size if size is not None else F.lit(1)), F.lit(0))).first()[0]
    return F.broadcast(small) if total <= SENT_ROWS else small


def _words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), r"[\x20\x09-\x0D]+"), "")


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, t, pos, h, n, sides) of every line with a word, t being the hash of the row's text; each line is read once."""

    def measured(words: Column) -> Column:
        n = F.size(words)
        sides = F.when(n >= MIN_WORDS, _sides(words, n))
        return F.struct(F.xxhash64(words).alias("h"), n.alias("n"), sides.alias("sides"))

    lines = F.transform(F.split(F.col(f"`{text_col}`"), "\n"), lambda line: _let(_words(line), measured))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("t"), F.posexplode(lines).alias("pos", "m"))
    return rows.where("m.n > 0").select("doc", "t", "pos", "m.h", "m.n", "m.sides")


def _sides(words: Column, n: Column) -> Column:
    """Hashes of the first and the last words that an edit may leave alone.

    Lines of 2^k to 2^(k+1)-1 words give 2^(k-1) words of either side.  A line
    of exactly 2^k may be alike to one of a word less, so it also gives the
    sides that such a line gives.
    """
    half = F.shiftright(F.pow(F.lit(2.0), F.floor(F.log2(n))).cast("int"), 1)

    def side(q: Column, end: int) -> Column:
        part = F.slice(words, F.lit(1), q) if end == 0 else F.slice(words, n - q + 1, q)
        return F.struct(F.xxhash64(F.lit(end), q, part).alias("key"), q.alias("q"), F.lit(end).alias("end"))

    plain = F.array(side(half, 0), side(half, 1))
    lower = F.shiftright(half, 1)
    edge = (n == 2 * half) & (n > MIN_WORDS)
    return F.when(edge, F.concat(plain, F.array(side(lower, 0), side(lower, 1)))).otherwise(plain)


def _running(hashes: Column, size: Column) -> Column:
    """Hash of the first i elements, for i = 0 to ``size``, by way of whole blocks."""

    def over(w: Column) -> Column:
        whole = F.sequence(F.lit(0), F.floor(size / _BLOCK).cast("int"))
        blocks = F.transform(whole, lambda k: F.xxhash64(F.slice(w, k * _BLOCK + 1, F.lit(_BLOCK))))

        def with_blocks(b: Column) -> Column:
            before = F.transform(whole, lambda k: F.xxhash64(F.slice(b, F.lit(1), k)))

            def upto(i: Column, known: Column) -> Column:
                k = F.floor(i / _BLOCK).cast("int")
                return F.xxhash64(F.get(known, k), F.slice(w, k * _BLOCK + 1, i % _BLOCK))

            return _let(before, lambda known: F.transform(F.sequence(F.lit(0), size), lambda i: upto(i, known)))

        return _let(blocks, with_blocks)

    return _let(hashes, over)


def _neighbourhood(lines: DataFrame) -> DataFrame:
    """(key, ord) for each place of a line where an edit may be."""
    w = F.transform("words", lambda x: F.xxhash64(x))
    head, tail = _running(w, F.col("n")), _running(F.reverse(w), F.col("n"))
    prepared = lines.select("ord", "n", "q_first", "q_last", "longer", F.struct(head.alias("head"), tail.alias("tail")).alias("run"))
    n, from_first, to_last = F.col("n"), F.coalesce("q_first", F.lit(2**31 - 1)), F.coalesce("q_last", F.lit(2**31 - 1))

    def places(run: Column, left_out: int) -> Column:
        last = n - left_out
        open_ = F.filter(F.sequence(F.lit(0), last), lambda i: (i >= from_first) | (i <= last - to_last))
        return F.transform(open_, lambda i: F.xxhash64(F.get(run["head"], i), F.get(run["tail"], last - i)))

    # one word left out meets replaced and longer lines; a line meets itself with a word put in only if a longer one is near
    keys = _let(F.col("run"), lambda run: F.when(F.col("longer"), F.concat(places(run, 1), places(run, 0))).otherwise(places(run, 1)))
    return prepared.select("ord", F.explode(keys).alias("key"))


def _within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word lists differ by at most one word: what they share at both ends leaves one word at most."""

    def shared(x: Column, y: Column) -> Column:
        short = F.least(F.size(x), F.size(y))
        equal = F.zip_with(F.slice(x, F.lit(1), short), F.slice(y, F.lit(1), short), lambda u, v: u == v)
        return _let(F.array_position(equal, False), lambda at: F.when(at == 0, short).otherwise(at - 1))

    return shared(a, b) + shared(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1


def _candidates(occurrences: DataFrame) -> DataFrame:
    """(h, first, q_first, q_last, longer) of the lines that share a beginning or an end with another line."""
    sides = occurrences.where(F.col("n") >= MIN_WORDS).select("doc", "t", "pos", "h", "n", F.explode("sides").alias("s"))
    sides = sides.select("doc", "t", "pos", "h", "n", "s.key", "s.q", "s.end")
    shared = sides.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.max("n").alias("most")).where("low <> high").select("key", "most")
    return (
        sides.join(_sent(cut_lineage(shared)), "key")
        .groupBy("h")
        .agg(
            F.min(F.struct("doc", "t", "pos")).alias("first"),
            F.min(F.when(F.col("end") == 0, F.col("q"))).alias("q_first"),
            F.min(F.when(F.col("end") == 1, F.col("q"))).alias("q_last"),
            F.max(F.col("most") > F.col("n")).alias("longer"),
        )
    )


def _near(occurrences: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Hashes of the lines to which an earlier, different line is alike."""
    per_doc = _candidates(occurrences).groupBy(F.col("first.doc").alias("_doc"), F.col("first.t").alias("_t"))
    wanted = cut_lineage(per_doc.agg(F.collect_list(F.struct("first.pos", "h", "q_first", "q_last", "longer")).alias("wanted")))
    source = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text")).withColumn("t", F.xxhash64("text"))
    met = source.join(_sent(wanted, F.size("wanted")), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("t") == F.col("_t")))
    lines = met.select("doc", "t", F.split("text", "\n").alias("lines"), F.explode("wanted").alias("c"))
    lines = lines.select("doc", "t", "c.*", _words(F.get("lines", F.col("c.pos"))).alias("words")).dropDuplicates(["h"])
    # numbered in the order of the documents, so the earliest line has the smallest number
    ordered = lines.orderBy("doc", "t", "pos").withColumn("ord", F.monotonically_increasing_id())
    lines = cut_lineage(ordered.select("ord", "h", "words", F.size("words").alias("n"), "q_first", "q_last", "longer"))

    around = cut_lineage(_neighbourhood(lines))
    shared = around.groupBy("key").agg(F.min("ord").alias("earliest"), F.max("ord").alias("latest")).where("earliest < latest")
    pairs = around.join(_sent(cut_lineage(shared.select("key", "earliest"))), "key").where("ord > earliest").select("ord", "earliest").distinct()
    texts = lines.select("ord", "words")
    later = pairs.join(lines.select("ord", "h", F.col("words").alias("a")), "ord")
    both = later.join(texts.select(F.col("ord").alias("earliest"), F.col("words").alias("b")), "earliest")
    return both.where(_within_one_edit(F.col("a"), F.col("b"))).select("h").distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, t, removed, n_equal, n_near) of the documents that lose lines, t being the hash of their text.

    ``removed`` holds the numbers (from 0) of the lines to leave out, in order;
    ``n_equal`` counts those equal to an earlier line, ``n_near`` the others.
    Lines are split at newlines; blank lines never go.  Null and empty texts
    lose nothing.  Rows that share an id are told apart by their text and stand
    in the order of its hash; equal rows keep the same lines.  A null id comes
    before all others.
    """
    occurrences = cut_lineage(_occurrences(docs, id_col, text_col))
    near = _near(occurrences, docs, id_col, text_col).withColumn("near", F.lit(True))
    first = occurrences.groupBy("h").agg(F.min(F.struct("doc", "t", "pos")).alias("first"), F.count("*").alias("times"))
    losing = first.join(near, "h", "left").where("times > 1 or near").select("h", "first", "near")
    here = F.struct("doc", "t", "pos")
    gone = (
        occurrences.select("doc", "t", "pos", "h")
        .join(_sent(cut_lineage(losing)), "h")
        .withColumn("equal", ~here.eqNullSafe(F.col("first")))
        .where("equal or near")
    )
    lines = F.array_distinct(F.sort_array(F.collect_list(F.struct("pos", "equal"))))
    count = lambda equal: F.size(F.filter("gone", lambda g: g["equal"] == equal)).cast("long")
    per_doc = gone.groupBy("doc", "t").agg(lines.alias("gone"))
    return per_doc.select("doc", "t", F.col("gone.pos").alias("removed"), count(True).alias("n_equal"), count(False).alias("n_near"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its text less the repeated lines, and n_lines, n_equal, n_near, removed.

    A document that loses all its lines with words has an empty text; a text
    that loses none stays as it is, null included.  Input columns named like a
    result are replaced.
    """
    lost = cut_lineage(repeated_lines(docs, id_col, text_col).withColumnsRenamed({"doc": "_lost_doc", "t": "_lost_t"}))
    rows = docs.drop(*[c for c in ("n_lines", "n_equal", "n_near", "removed") if c not in (id_col, text_col)])
    text = F.col(f"`{text_col}`")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("_lost_doc")) & (F.xxhash64(text) == F.col("_lost_t"))
    joined = rows.join(_sent(lost, F.size("removed")), same, "left").drop("_lost_doc", "_lost_t")
    # what follows the first word's beginning up to the newline: one match per line with a word
    n_lines = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D][^\n]*")), F.lit(0)).cast("long")

    def less(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    shorter = F.when(F.col("removed").isNull(), text).when(F.size("removed") == F.col("n_lines"), F.lit("")).otherwise(_let(F.split(text, "\n"), less))
    out = joined.withColumn("n_lines", n_lines).withColumn(text_col, shorter)
    return out.withColumns({
        "n_equal": F.coalesce("n_equal", F.lit(0).cast("long")),
        "n_near": F.coalesce("n_near", F.lit(0).cast("long")),
        "removed": F.coalesce("removed", F.array().cast("array<int>")),
    })
