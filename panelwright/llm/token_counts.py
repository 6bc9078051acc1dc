"""Token counts by rank-synchronous merging of ragged symbol arrays.

All pre-tokens of a batch that are not known yet lie in one flat array of
symbols.  Each round finds, in every sequence at once, the merge of lowest rank
and applies all its occurrences (left to right where they overlap).  Sequences
without a merge leave; what is left of them is their number of tokens.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from panelwright.llm.text import map_texts
from panelwright.llm.vocabulary import ByteBpe, PreTokens, parse

_NONE = np.iinfo(np.int64).max
#: Pre-tokens a worker remembers; a full memory is emptied, which costs time and changes no count.
REMEMBERED = 300_000


class MergeTable:
    """Rank of a pair of symbols, looked up for whole arrays."""

    def __init__(self, bpe: ByteBpe) -> None:
        self._width = len(bpe.symbol)
        keys = bpe.left * self._width + bpe.right
        order = np.argsort(keys, kind="stable")
        self._keys = np.r_[keys[order], _NONE]
        self._ranks = np.r_[order, _NONE]
        self.made = bpe.made

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self._width + right
        at = np.searchsorted(self._keys, wanted)
        return np.where(self._keys[at] == wanted, self._ranks[at], _NONE)


def merged_sizes(table: MergeTable, symbols: np.ndarray, starts: np.ndarray, leave: Callable[[np.ndarray, np.ndarray], None] | None = None) -> np.ndarray:
    """Number of symbols left of each sequence when no merge applies; sequences must not be empty.

    ``leave`` is told of sequences that are done: their numbers and, one after
    the other, their symbols.
    """
    total = len(starts)
    sizes = np.zeros(total, np.int64)
    who = np.arange(total)
    sym, start = symbols, starts
    length = np.diff(np.r_[start, len(sym)])
    rank = np.full(len(sym), _NONE)
    inner = np.ones(len(sym), bool)
    inner[start + length - 1] = False
    at = np.flatnonzero(inner)
    rank[at] = table.ranks(sym[at], sym[at + 1])
    while len(who):
        best = np.minimum.reduceat(rank, start)
        done = best == _NONE
        if done.any():
            sizes[who[done]] = length[done]
            stay = np.repeat(~done, length)
            if leave is not None:
                leave(who[done], sym[~stay])
            sym, rank, who, length, best = sym[stay], rank[stay], who[~done], length[~done], best[~done]
            start = np.cumsum(length) - length
            if not len(who):
                break
        hit = rank == np.repeat(best, length)
        at = np.flatnonzero(hit)
        # an occurrence that overlaps the one before it waits: only every other one of a run applies
        run_start = np.r_[True, np.diff(at) > 1]
        run = np.maximum.accumulate(np.where(run_start, at, 0))
        at = at[(at - run) % 2 == 0]
        sym[at] = table.made[rank[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        owner = np.searchsorted(start, at, side="right") - 1
        length = length - np.bincount(owner, minlength=len(length))
        new_at = at - np.arange(len(at))
        sym, rank = sym[keep], rank[keep]
        start = np.cumsum(length) - length
        last = np.zeros(len(sym), bool)
        last[start + length - 1] = True
        first = np.zeros(len(sym), bool)
        first[start] = True
        left_of = new_at[~first[new_at]] - 1
        redo = np.concatenate([left_of, new_at])
        rank[redo] = _NONE
        redo = redo[~last[redo]]
        rank[redo] = table.ranks(sym[redo], sym[redo + 1])
    return sizes


class TokenCounter:
    """Counts tokens of texts; remembers the counts of the pre-tokens it has seen."""

    def __init__(self, content: bytes) -> None:
        self._bpe = parse(content)
        self._table = MergeTable(self._bpe)
        self._cut = PreTokens(self._bpe.special)
        self._known: dict[str, int] = {}

    def _learn(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        data = np.frombuffer(b"".join(raw), np.uint8)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        sizes = merged_sizes(self._table, self._bpe.byte_id[data], np.cumsum(lengths) - lengths)
        self._known.update(zip(pieces, sizes.tolist(), strict=True))

    def counts(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        held: list[tuple[int, list[str]]] = []
        n_held = 0

        def settle() -> None:
            nonlocal n_held
            new = list({p for _, found in held for p in found}.difference(self._known))
            if len(self._known) + len(new) > REMEMBERED:
                self._known.clear()
                new = list({p for _, found in held for p in found})
            if new:
                self._learn(new)
            known = self._known.__getitem__
            for i, found in held:
                out[i] += sum(map(known, found))
            held.clear()
            n_held = 0

        for i, text in enumerate(texts):
            for found in self._cut(text or ""):
                if isinstance(found, tuple):
                    out[i] += 1
                    continue
                held.append((i, found))
                n_held += len(found)
                if n_held > 200_000:
                    settle()
        settle()
        return out


@lru_cache(maxsize=1)
def _counter(content: bytes) -> TokenCounter:
    """One counter per worker process, kept between its tasks."""
    return TokenCounter(content)


def token_counts(df: DataFrame, tokenizer_file: str, text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens above ``limit``) to every row.

    Counts are those of the file's own library without added tokens; a special
    token's string inside a text counts as that token.  Null and empty texts
    have 0 bytes and 0 tokens.  Rows are neither dropped nor merged; input
    columns named like a result are replaced.  The file is read on the driver
    and sent once per executor (a vocabulary of fixed size).
    """
    with open(tokenizer_file, "rb") as file:
        content = df.sparkSession.sparkContext.broadcast(file.read())

    def count(texts: pa.Array) -> dict[str, object]:
        n_bytes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        n = _counter(content.value).counts(texts.to_pylist())
        return {"n_bytes": n_bytes, "n_tokens": n, "over_limit": n > limit}

    return map_texts(df, text_col, count, "n_bytes long, n_tokens long, over_limit boolean")
