"""BPE as a streaming transducer with bounded lookahead, and its inverse.

What follows a prefix can change the prefix's tokens only through a chain of
merges of rising rank: a merge ``(u, v)`` that happens or not at one boundary
changes the token that starts where ``u`` starts, and that token can only be
the right part of a later merge ``(u', v')`` whose ``v'`` begins with ``u``.
Each link moves left by the length of its left part, so the longest such chain
is a lookahead that suffices: a token that ends that many bytes before the end
of what has been read is stable.  ``sufficient_lookahead`` computes the chain
for a merge list; ``Encoder`` holds no more than it plus one block.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelwright.llm.text import map_texts
from panelwright.llm.token_counts import MergeTable, merged_sizes
from panelwright.llm.vocabulary import ByteBpe, PreTokens, parse

#: Pre-tokens of each of the two generations that a worker remembers; the older one is dropped when the younger
#: is full, which costs time and changes no token.
REMEMBERED = 60_000
#: Pre-tokens that are held before those among them that are new are learned together.
BATCH = 100_000
#: A pair of symbols is one integer, its rule another: the rank above the symbol made, so the least rule comes first.
_BITS = 24
_MADE = (1 << _BITS) - 1
_NO_RULE = 1 << 62


def sufficient_lookahead(merges: Iterable[tuple[bytes, bytes]]) -> int:
    """Bytes of lookahead after which a token can no longer change, for merges in rank order."""
    reach: dict[bytes, int] = {}
    longest = 0
    for left, right in merges:
        before = max((reach.get(right[:k], 0) for k in range(1, len(right) + 1)), default=0)
        here = before + len(left)
        if here > reach.get(left, 0):
            reach[left] = here
        longest = max(longest, here)
    return longest


class Transducer:
    """Merge rules by pair, with the lookahead of their list."""

    def __init__(self, bpe: ByteBpe) -> None:
        self.byte_id = bpe.byte_id.tolist()
        self.symbol = bpe.symbol
        pairs = ((bpe.left << _BITS) | bpe.right).tolist()
        rules = ((np.arange(len(pairs)) << _BITS) | bpe.made).tolist()
        self.rule = dict(zip(pairs, rules, strict=True))
        self.lookahead = sufficient_lookahead((bpe.symbol[a], bpe.symbol[b]) for a, b in zip(bpe.left.tolist(), bpe.right.tolist(), strict=True))
        rule, ids = self.rule.get, self.byte_id
        self._bytes = [rule(a << _BITS | b, _NO_RULE) for a in ids for b in ids]

    def tokens(self, piece: bytes) -> list[int]:
        """All tokens of a byte string that is read to its end."""
        byte_id, first = self.byte_id, self._bytes
        ids = [byte_id[b] for b in piece]
        if len(ids) > 64:
            return self._by_heap(ids)
        rule = self.rule.get
        waiting = [first[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
        while waiting:
            best = min(waiting)
            if best == _NO_RULE:
                break
            i = waiting.index(best)
            ids[i] = made = best & _MADE
            del ids[i + 1], waiting[i]
            if i < len(waiting):
                waiting[i] = rule(made << _BITS | ids[i + 1], _NO_RULE)
            if i:
                waiting[i - 1] = rule(ids[i - 1] << _BITS | made, _NO_RULE)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        n, rule = len(ids), self.rule.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found, i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := rule(ids[i] << _BITS | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i] = made = best & _MADE
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := rule(made << _BITS | ids[k]):
                    heapq.heappush(heap, (found, i, made, ids[k]))
            h = before[i]
            if h >= 0 and (found := rule(ids[h] << _BITS | made)):
                heapq.heappush(heap, (found, h, ids[h], made))
        return [x for x in ids if x >= 0]


class Encoder:
    """Reads bytes of one pre-token in parts and gives tokens as soon as they are stable."""

    def __init__(self, rules: Transducer, block: int = 4096) -> None:
        self._rules, self._block, self._buffer = rules, block, bytearray()

    def feed(self, part: bytes) -> Iterator[int]:
        for i in range(0, len(part), self._block):
            self._buffer += part[i : i + self._block]
            if len(self._buffer) >= self._rules.lookahead + self._block:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        limit = len(self._buffer) - self._rules.lookahead
        done = 0
        for token in self._rules.tokens(bytes(self._buffer)):
            end = done + len(self._rules.symbol[token])
            if end > limit:
                break
            yield token
            done = end
        # a boundary of the whole separates it: the rest encodes as if it stood alone
        del self._buffer[:done]

    def finish(self) -> list[int]:
        rest = self._rules.tokens(bytes(self._buffer))
        self._buffer.clear()
        return rest


class Decoder:
    """Turns token ids into text in parts; an unfinished character waits for its other bytes.

    Bytes that are not UTF-8 become U+FFFD, one for each maximal invalid part.
    """

    def __init__(self, symbol: list[bytes]) -> None:
        lengths = np.fromiter(map(len, symbol), np.int64, len(symbol))
        self._flat = np.frombuffer(b"".join(symbol), np.uint8)
        self._start, self._length = np.cumsum(lengths) - lengths, lengths
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        length = self._length[ids]
        begin = np.cumsum(length) - length
        at = np.repeat(self._start[ids] - begin, length) + np.arange(length.sum())
        return self._state.decode(self._flat[at].tobytes())

    def finish(self) -> str:
        rest = self._state.decode(b"", True)
        self._state.reset()
        return rest


class Codec:
    """Whole texts to token ids in parts, and back."""

    def __init__(self, content: bytes) -> None:
        bpe = parse(content)
        self.rules = Transducer(bpe)
        self.decoder = Decoder(bpe.symbol)
        self._special = bpe.special
        self._cut = PreTokens(bpe.special)
        self._table, self._byte_id = MergeTable(bpe), bpe.byte_id
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _stream(self, piece: str) -> Iterator[bytes]:
        """Ids of a long pre-token, as soon as they are stable."""
        raw, encoder = piece.encode(), Encoder(self.rules)
        for i in range(0, len(raw), 1 << 16):
            ids = list(encoder.feed(raw[i : i + (1 << 16)]))
            yield struct.pack(f"<{len(ids)}I", *ids)
        ids = encoder.finish()
        yield struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens within the lookahead: none is stable before its end, so all are merged at once."""
        raw = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[bytes] = [b""] * len(raw)

        def leave(who: np.ndarray, symbols: np.ndarray) -> None:
            order.append(who)
            left.append(symbols)

        order: list[np.ndarray] = []
        left: list[np.ndarray] = []
        symbols = self._byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        sizes = merged_sizes(self._table, symbols, np.cumsum(lengths) - lengths, leave)
        who = np.concatenate(order)
        flat = np.concatenate(left).astype("<u4").tobytes()
        ends = np.cumsum(4 * sizes[who]).tolist()
        begin = 0
        for i, end in zip(who.tolist(), ends, strict=True):
            out[i] = flat[begin:end]
            begin = end
        return dict(zip(pieces, out, strict=True))

    def _settle(self, held: list[tuple[int, list[str] | tuple[str]]]) -> Iterator[tuple[int, bytes]]:
        """Ids of the pre-tokens held; those met for the first time are learned together."""
        fresh = {p for _, found in held if isinstance(found, list) for p in found}.difference(self._young)
        for p in fresh.intersection(self._old):
            self._young[p] = self._old[p]
        fresh.difference_update(self._old)
        limit = min(self.rules.lookahead, 256) // 4
        short = [p for p in fresh if len(p) <= limit]
        if len(self._young) + len(short) > REMEMBERED:
            self._old, self._young = self._young, {}
        if short:
            self._young.update(self._learn(short))
        young, old = self._young.get, self._old.get
        for i, found in held:
            if isinstance(found, tuple):
                yield i, self._special[found[0]].to_bytes(4, "little")
            elif len(short) == len(fresh) or not any(len(p) > limit for p in found):
                yield i, b"".join([young(p) or old(p) for p in found])
            else:
                for p in found:
                    known = young(p) or old(p)
                    if known:
                        yield i, known
                    else:
                        for part in self._stream(p):
                            yield i, part

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes]]:
        """(number of the text, ids as little-endian unsigned 32-bit integers), in order, bounded parts at a time."""
        held, n = [], 0
        for i, text in enumerate(texts):
            for found in self._cut(text):
                held.append((i, found))
                n += len(found)
                if n > BATCH:
                    yield from self._settle(held)
                    held, n = [], 0
        yield from self._settle(held)

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of one text."""
        for _, part in self.encode_all([text]):
            yield part

    def decode(self, parts: Iterable[bytes]) -> Iterator[str]:
        for part in parts:
            yield self.decoder.feed(np.frombuffer(part, "<u4"))
        yield self.decoder.finish()


@lru_cache(maxsize=1)
def _codec(content: bytes) -> Codec:
    return Codec(content)


def _file(df: DataFrame, tokenizer_file: str):
    with open(tokenizer_file, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, tokenizer_file: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds the token ids of every text as an array; null and empty texts have an empty one."""
    content = _file(df, tokenizer_file)

    def run(texts: pa.Array) -> dict[str, object]:
        codec = _codec(content.value)
        parts = list(codec.encode_all(t or "" for t in texts.to_pylist()))
        sizes = np.zeros(len(texts), np.int64)
        for i, part in parts:
            sizes[i] += len(part) // 4
        flat = np.frombuffer(b"".join(part for _, part in parts), "<u4").astype(np.int32)
        return {ids_col: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat))}

    return map_texts(df, text_col, run, f"{ids_col} array<int>")


def decode(df: DataFrame, tokenizer_file: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Adds the text of every array of token ids; null counts as empty, ids outside the vocabulary raise an error."""
    content = _file(df, tokenizer_file)
    names = [c for c in df.columns if c != text_col]
    from pyspark.sql import types as T

    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codec = _codec(content.value)
            made = [
                "".join(codec.decode([np.asarray(ids or [], "<u4").tobytes()])) for ids in batch.column(ids_col).to_pylist()
            ]
            cols = [batch.column(c) for c in names] + [pa.array(made, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, text_col])

    return df.select(*[f"`{c}`" for c in dict.fromkeys([*names, ids_col])]).mapInArrow(run, schema)


def round_trip(df: DataFrame, tokenizer_file: str, text_col: str = "text") -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256: every text encoded and its ids decoded again.

    The ids enter their digest as little-endian unsigned 32-bit integers, the
    decoded text as UTF-8.  Both digests are fed part by part.  Null and empty
    texts have no tokens and the digests of nothing.  Rows are neither dropped
    nor merged; input columns named like a result are replaced.
    """
    content = _file(df, tokenizer_file)

    def run(texts: pa.Array) -> dict[str, object]:
        codec = _codec(content.value)
        counts = [0] * len(texts)
        of_ids, of_text = ([hashlib.sha256() for _ in counts] for _ in range(2))
        now = 0
        for i, part in codec.encode_all(t or "" for t in texts.to_pylist()):
            if i != now:
                of_text[now].update(codec.decoder.finish().encode())
                now = i
            counts[i] += len(part) // 4
            of_ids[i].update(part)
            of_text[i].update(codec.decoder.feed(np.frombuffer(part, "<u4")).encode())
        if counts:
            of_text[now].update(codec.decoder.finish().encode())
        of_ids, of_text = ([d.hexdigest() for d in made] for made in (of_ids, of_text))
        return {"n_tokens": counts, "ids_sha256": of_ids, "decoded_sha256": of_text}

    return map_texts(df, text_col, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
