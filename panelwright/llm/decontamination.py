"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of normalised words of every item.  A text's
words stream through it; after each word the state tells the longest run that
ends there and stands in some item.  Words inside a run of at least a window's
length, or inside a whole short item, are hit.

Only stretches in which every neighbouring pair of words is known to the items
are streamed: whatever lies between them cannot hold a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import text as tx

WINDOW = 13
#: Item words in one automaton; more items make more automata, applied one after the other.
BLOCK_WORDS = 500_000


_SPANS = "array<struct<begin:bigint,end:bigint,first:bigint,last:bigint>>"


class Automaton:
    """Generalised suffix automaton over the word hashes of one block of items."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW) -> None:
        self.window = window
        data, offsets = tx.flat(pa.array(texts, pa.large_string()))
        w = tx.words(tx.LOWER[data], offsets, tx.ALNUM)
        hashes = tx.word_hashes(w)
        self.vocabulary = np.unique(hashes)
        self._likely = np.zeros(1 << 16, bool)
        self._likely[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        words = np.searchsorted(self.vocabulary, hashes)
        runs = [words[a:b].tolist() for a, b in zip(w.at[:-1], w.at[1:], strict=True)]

        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for run in runs:
            state = 0
            for word in run:
                state = self._extend(state, word)

        self._of_window: dict[int, set[str]] = {}
        self._of_short: dict[int, list[tuple[int, str]]] = {}
        for name, run in zip(ids, runs, strict=True):
            state = 0
            for i, word in enumerate(run):
                state = self.next[state][word]
                if i + 1 >= window:
                    self._of_window.setdefault(self._holding(state, window), set()).add(name)
            if 0 < len(run) < window:
                self._of_short.setdefault(self._holding(state, len(run)), []).append((len(run), name))
        lengths = {min(len(run), window) for run in runs if run}
        self._single = 1 in lengths
        self._shortest = min(lengths - {1}, default=0)
        pairs = {p for run in runs for p in zip(run, run[1:], strict=False)}
        self._pairs = np.array(sorted(a * len(self.vocabulary) + b for a, b in pairs), np.int64)

    def _extend(self, last: int, word: int) -> int:
        """Adds a word after the run of state ``last``; gives the state of the longer run."""
        following, link, length = self.next, self.link, self.length
        if word in following[last]:
            there = following[last][word]
            return there if length[there] == length[last] + 1 else self._split(last, word, there)
        new = len(following)
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and word not in following[at]:
            following[at][word] = new
            at = link[at]
        if at >= 0:
            there = following[at][word]
            link[new] = there if length[there] == length[at] + 1 else self._split(at, word, there)
        return new

    def _split(self, at: int, word: int, there: int) -> int:
        following, link, length = self.next, self.link, self.length
        copy = len(following)
        following.append(dict(following[there]))
        link.append(link[there])
        length.append(length[at] + 1)
        link[there] = copy
        while at >= 0 and following[at].get(word) == there:
            following[at][word] = copy
            at = link[at]
        return copy

    def _holding(self, state: int, size: int) -> int:
        """The state that holds the last ``size`` words of a state's runs."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def lengths(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: state and longest matching length."""
        state = size = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            state = self.next[state].get(word, 0)
            size = size + 1 if state else 0
            yield state, size

    def _stretches(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Word numbers (-1: unknown) and the stretches of words that may hold a window."""
        ids = np.full(len(hashes), -1, np.int64)
        if not len(self.vocabulary):
            return ids, []
        maybe = np.flatnonzero(self._likely[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        found = self.vocabulary[place] == hashes[maybe]
        ids[maybe[found]] = place[found]
        out: list[tuple[int, int]] = []
        if self._single:
            alone = np.isin(ids, [w for w in self.next[0] if any(n == 1 for n, _ in self._of_short.get(self.next[0][w], []))])
            out += [(i, i + 1) for i in np.flatnonzero(alone).tolist()]
        if self._shortest and len(ids) > 1:
            both = (ids[:-1] >= 0) & (ids[1:] >= 0)
            edges = at[1:-1]
            both[edges[(edges > 0) & (edges < len(ids))] - 1] = False
            first = np.flatnonzero(both)
            key = ids[first] * len(self.vocabulary) + ids[first + 1]
            place = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
            linked = np.zeros(len(ids) + 1, bool)
            linked[first[self._pairs[place] == key] + 1] = True  # word i follows word i - 1 in some item
            begin = np.flatnonzero(~linked[:-1] & linked[1:])
            end = np.flatnonzero(linked[:-1] & ~linked[1:]) + 1
            long = end - begin >= self._shortest
            out += zip(begin[long].tolist(), end[long].tolist(), strict=True)
        return ids, out

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
        """Per text: number of words, hit word ranges [begin, end) merged, ids of the items with occurring windows."""
        data, offsets = tx.flat(texts)
        w = tx.words(tx.LOWER[data], offsets, tx.ALNUM)
        w.data = tx.LOWER[data]
        n = len(offsets) - 1
        spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        items: list[set[str]] = [set() for _ in range(n)]
        ids, stretches = self._stretches(tx.word_hashes(w), w.at)
        for begin, end in sorted(stretches):
            text = int(np.searchsorted(w.at, begin, side="right")) - 1
            base = begin - int(w.at[text])
            for i, (state, size) in enumerate(self.lengths(ids[begin:end].tolist())):
                reach = self._found(state, size, items[text])
                if reach:
                    spans[text].append((base + i + 1 - reach, base + i + 1))
        return w.per_text, [merged(s) for s in spans], items

    def _found(self, state: int, size: int, into: set[str]) -> int:
        """Collects the items that end at a state; gives the length of the longest run that is hit."""
        reach = 0
        if size >= self.window:
            reach = size
            into |= self._of_window[self._holding(state, self.window)]
        while state > 0:
            for n, name in self._of_short.get(state, ()):
                if n <= size:
                    into.add(name)
                    reach = max(reach, n)
            state = self.link[state]
        return reach


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, with touching ones joined."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def located(text: str, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Spans of words with the characters from the first word's beginning to the last word's end."""
    data, offsets = tx.flat(pa.array([text], pa.large_string()))
    w = tx.words(tx.LOWER[data], offsets, tx.ALNUM)
    character = np.cumsum((data & 0xC0) != 0x80)  # characters up to and including the one of a byte
    return [{"begin": a, "end": b, "first": int(character[w.start[a]]) - 1, "last": int(character[w.end[b - 1] - 1])} for a, b in spans]


def automata(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """Automata of blocks of items; the driver holds one block of bounded size at a time."""
    ids: list[str] = []
    texts: list[str] = []
    size = 0
    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t"))
    for row in rows.where("t is not null").toLocalIterator():
        ids.append(row.i or "")
        texts.append(row.t)
        size += 1 + len(row.t) // 2  # at least the number of words
        if size >= block_words:
            yield Automaton(ids, texts, window)
            ids, texts, size = [], [], 0
    if ids:
        yield Automaton(ids, texts, window)


def match(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds n_words, hit_spans and item_ids to every row of ``docs``.

    A span holds a range of words (begin, end) and of characters (first, last),
    numbered from 0, without its end.

    A window is ``window`` consecutive words of an item; a shorter item with a
    word is one window.  Words are runs of ASCII letters, digits and non-ASCII
    characters, in lower case (A-Z).  Null and empty texts have no words and no
    hits, null and empty items no windows; without items nothing is hit.  Equal
    item ids count once, a null id as ''.  Input columns named like a result are
    replaced.
    """
    context = docs.sparkSession.sparkContext
    out = docs.drop("n_words", "hit_spans", "item_ids")
    schema = f"n_words long, hit_spans {_SPANS}, item_ids array<string>"
    passes = []
    for k, automaton in enumerate(automata(items, item_id, item_text, window, block_words)):
        sent = context.broadcast(automaton)

        def scan(texts: pa.Array, sent=sent, k=k) -> dict[str, object]:
            n_words, spans, found = sent.value.scan(texts)
            places = [located(t.as_py(), s) if s else [] for t, s in zip(texts, spans, strict=True)]
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("begin", "end", "first", "last")]))
            return {f"n_words_{k}": n_words, f"hit_spans_{k}": pa.array(places, kind), f"item_ids_{k}": pa.array([sorted(f) for f in found], pa.list_(pa.string()))}

        out = tx.map_texts(out, text_col, scan, schema.replace("n_words", f"n_words_{k}").replace("hit_spans", f"hit_spans_{k}").replace("item_ids", f"item_ids_{k}"))
        passes.append(k)
    if not passes:
        empty = Automaton([], [], window)
        count = lambda texts: {"n_words": empty.scan(texts)[0]}
        out = tx.map_texts(out, text_col, count, "n_words long")
        return out.withColumns({c: F.array().cast(t) for c, t in (("hit_spans", _SPANS), ("item_ids", "array<string>"))})
    if len(passes) == 1:
        return out.withColumnsRenamed({f"{c}_0": c for c in ("n_words", "hit_spans", "item_ids")})
    spans = F.sort_array(F.concat(*[F.col(f"hit_spans_{k}") for k in passes]))
    ids = reduce(F.array_union, [F.col(f"item_ids_{k}") for k in passes])
    joined = out.withColumns({"n_words": F.col("n_words_0"), "hit_spans": _joined(spans), "item_ids": F.array_sort(ids)})
    return joined.drop(*[f"{c}_{k}" for k in passes for c in ("n_words", "hit_spans", "item_ids")])


def _joined(spans):
    """Joins touching ranges of a sorted array of ranges."""
    empty = F.array().cast(_SPANS)

    def step(done, span):
        last = F.element_at(done, -1)
        grown = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], span["end"]).alias("end"), last["first"].alias("first"), F.greatest(last["last"], span["last"]).alias("last"))
        touching = (F.size(done) > 0) & (span["begin"] <= F.get(done, F.size(done) - 1)["end"])
        return F.when(touching, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, empty, step)


def verdict(matched: DataFrame, share: int = 20) -> DataFrame:
    """Adds n_hit and contaminated (at least one word in ``share`` is hit) to the rows of ``match``."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return matched.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    )


def remove_spans(matched: DataFrame, text_col: str = "text", min_words: int = WINDOW, share: int | None = 20) -> DataFrame:
    """Cuts the hit spans of at least ``min_words`` words out of each text.

    With ``share``, rows of which at least one word in ``share`` is hit leave
    altogether; the spans of the others are cut by length alone.  Other rows keep
    their text as it is.
    """
    judged = verdict(matched, share or 1)
    kept = judged.where(~F.col("contaminated")) if share else judged

    text = F.col(f"`{text_col}`")
    long = F.filter("hit_spans", lambda s: s["end"] - s["begin"] >= min_words)
    # what stands between the long spans, before the first and after the last
    froms = F.concat(F.array(F.lit(0).cast("long")), F.transform(long, lambda s: s["last"]))
    upto = F.concat(F.transform(long, lambda s: s["first"]), F.array(F.length(text).cast("long")))
    parts = F.zip_with(froms, upto, lambda a, b: F.substring(text, a.cast("int") + 1, (b - a).cast("int")))
    return kept.withColumn(text_col, F.when(F.size(long) > 0, F.array_join(parts, "")).otherwise(text))
