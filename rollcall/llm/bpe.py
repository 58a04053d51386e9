"""Byte-level BPE: encoding by replaying the merges over a block's words, and decoding.

The words of a block of texts form a small corpus.  An inverted index leads from a
merge to the positions at which it applies; merges are taken in rank order, and each
one changes its own positions and touches only the neighbours there.  A word that
occurs many times is merged once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: characters of text whose words are merged together, and remembered for the next block only
BLOCK_CHARS = 10_000_000

_WS = "\t-\r \x85\xa0  -     　"
#: cuts at white space where the tokenizer's pattern always cuts too, with the same pieces
_COARSE = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")
_loaded: dict[tuple[str, str], "Bpe"] = {}


class Bpe:
    """A vocabulary in rank order with the tables that merging needs."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.pattern = regex.compile(pattern)
        self.token = {i: b for b, i in ranks.items()}
        self.whole = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        merge = {
            ranks[t[:i]] << 32 | ranks[t[i:]]: r
            for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        }
        #: sorted (left id << 32 | right id) and the id of both together
        self.pairs = np.array(sorted(merge), dtype=np.int64)
        self.made = np.array([merge[k] for k in self.pairs.tolist()], dtype=np.int64)
        #: ids that are part of an earlier id: merging to them can call for an earlier merge
        parts = np.concatenate([self.pairs >> 32, self.pairs & 0xFFFFFFFF])
        self.careful = set(parts[parts > np.concatenate([self.made, self.made])].tolist())
        self.first = np.full((256, 256), -1, dtype=np.int64)
        for a in range(256):
            for b in range(256):
                self.first[a, b] = ranks.get(bytes([a, b]), -1)
        self.ids_of: dict[str, tuple[int, ...]] = {}
        self.text_of: dict[str, str] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> "Bpe":
        if (path, pattern) not in _loaded:
            _loaded[path, pattern] = cls(path, pattern)
        return _loaded[path, pattern]

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of pairs of ids, -1 where they do not merge."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, key), self.pairs.size - 1)
        return np.where(self.pairs[at] == key, self.made[at], -1)

    def replay(self, words: Sequence[bytes]) -> list[tuple[int, ...]]:
        """Ids of every word: all merges in rank order over all words at once."""
        out: list[tuple[int, ...] | None] = [None] * len(words)
        todo = []
        for k, word in enumerate(words):
            whole = self.whole.get(word)  # a word that is a token is that token
            if whole is not None:
                out[k] = (whole,)
            else:
                todo.append(k)
        if not todo:
            return out
        # a gap before, between and behind the words ends every run of neighbours
        data = np.frombuffer(b"\0".join([b"", *[words[k] for k in todo], b""]), dtype=np.uint8)
        lengths = np.array([len(words[k]) for k in todo])
        ends = np.cumsum(lengths + 1) + 1
        starts = ends - lengths - 1
        gap = np.zeros(data.size, dtype=bool)
        gap[0] = True
        gap[ends - 1] = True
        pair = np.full(data.size, -1, dtype=np.int64)  # what the symbol here makes with the next one
        pair[:-1] = np.where(gap[:-1] | gap[1:], -1, self.first[data[:-1], data[1:]])
        symbol = np.where(gap, -1, self.byte_id[data])
        after = np.arange(1, data.size + 1)
        before = np.arange(-1, data.size - 1)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def post(places: np.ndarray) -> None:
            places = places[pair[places] >= 0]
            if not places.size:
                return
            ranks = pair[places]
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), ranks.size]
            heads = ranks[cuts[:-1]].tolist()
            for r, lo, hi in zip(heads, cuts, cuts[1:]):
                if r in index:
                    index[r].append(places[lo:hi])
                else:
                    index[r] = [places[lo:hi]]
                    heapq.heappush(queue, r)

        post(np.arange(data.size))
        while queue:
            rank = heapq.heappop(queue)
            parts = index.pop(rank)
            places = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
            places = places[pair[places] == rank]
            if not places.size:
                continue
            gone = after[places]
            if (gone[:-1] == places[1:]).any():  # runs like aaa: from the left, without overlap
                keep, last = [], -1
                for k, (p, q) in enumerate(zip(places.tolist(), gone.tolist())):
                    if p != last:
                        keep.append(k)
                        last = q
                places, gone = places[keep], gone[keep]
            if rank in self.careful and places.size > 1:
                # a merge may make an earlier one possible: one place per word at a time
                word = np.searchsorted(ends, places, side="right")
                lead = np.concatenate([[True], word[1:] != word[:-1]])
                post(places[~lead])
                places, gone = places[lead], gone[lead]
            beyond = after[gone]
            symbol[places] = rank
            symbol[gone] = -2
            pair[gone] = -1
            after[places] = beyond
            before[beyond] = places
            touched = np.unique(np.concatenate([before[places], places]))
            left, right = symbol[touched], symbol[after[touched]]
            pair[touched] = np.where((left >= 0) & (right >= 0), self.merged(left, right), -1)
            post(touched)
        kept = np.flatnonzero(symbol >= 0)
        ids = symbol[kept].tolist()
        lo = np.searchsorted(kept, starts).tolist()
        hi = np.searchsorted(kept, ends - 1).tolist()
        for k, a, b in zip(todo, lo, hi, strict=True):
            out[k] = tuple(ids[a:b])
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Fill the memory for the pieces of text that are new."""
        new = [p for p in pieces if p not in self.ids_of]
        split = [self.pattern.findall(p) for p in new]
        words = list({w for ws in split for w in ws})
        ids = dict(zip(words, self.replay([w.encode() for w in words]), strict=True))
        for piece, ws in zip(new, split, strict=True):
            got = ids[ws[0]] if len(ws) == 1 else tuple(i for w in ws for i in ids[w])
            self.ids_of[piece] = got
            self.text_of[piece] = " ".join(map(str, got))

    def pieces(self, texts: Sequence[str | None]) -> Iterator[list[str]]:
        """Per text its pieces, all of them in memory when they are given out."""
        k = 0
        while k < len(texts):
            block, seen, chars = [], {}, 0  # each piece is held once, however often it occurs
            while k < len(texts) and (chars < BLOCK_CHARS or not block):
                block.append([seen.setdefault(p, p) for p in _COARSE.findall(texts[k] or "")])
                chars += len(texts[k] or "")
                k += 1
            # pieces of the last block that come again are known; all others are forgotten
            known = self.ids_of.keys() & seen.keys()
            self.keep(known)
            self.learn(seen)
            yield from block
            if k == len(texts):
                self.keep(known)

    def keep(self, pieces: set[str]) -> None:
        self.ids_of = {p: self.ids_of[p] for p in pieces}
        self.text_of = {p: self.text_of[p] for p in pieces}

    def encode(self, texts: Sequence[str | None]) -> Iterator[list[int]]:
        for cut in self.pieces(texts):
            of = self.ids_of
            yield list(chain.from_iterable(map(of.__getitem__, cut)))

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def _run(df: DataFrame, keys: Sequence[str], column: str, schema: list[T.StructField], work) -> DataFrame:
    keys = [k for k in keys if k not in {f.name for f in schema}]
    narrow = df.select(*keys, df[column].alias("_bpe_input"))
    fields = [f for f in narrow.schema.fields if f.name != "_bpe_input"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            column = part.column(part.num_columns - 1)
            size = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
            ends = np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            row = 0
            while row < part.num_rows:  # a block of rows at a time
                before = int(ends[row - 1]) if row else 0
                last = max(row + 1, int(np.searchsorted(ends, before + BLOCK_CHARS, side="right")))
                piece = part.slice(row, last - row)
                made = work(piece.column(piece.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *made], names=[*part.schema.names[:-1], *[f.name for f in schema]])
                row = last

    return narrow.mapInArrow(batches, T.StructType([*fields, *schema]))


def encode_texts(df: DataFrame, path: str, pattern: str, keys: Sequence[str], text: str = "text") -> DataFrame:
    """``keys`` of every row with ids (array of int) and n_tokens.

    NULL and empty texts have no ids.  Repeated rows and NULL keys pass through; a key
    named like an output column is left out.
    """

    def work(texts):
        ids = list(Bpe.load(path, pattern).encode(texts))
        return pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64())

    return _run(df, keys, text, [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())], work)


def decode_ids(df: DataFrame, path: str, pattern: str, keys: Sequence[str], ids: str = "ids") -> DataFrame:
    """``keys`` of every row with decoded (binary); NULL ids decode to nothing.

    Ids outside the vocabulary raise KeyError.
    """

    def work(lists):
        bpe = Bpe.load(path, pattern)
        return (pa.array([bpe.decode(i or ()) for i in lists], pa.binary()),)

    return _run(df, keys, ids, [T.StructField("decoded", T.BinaryType())], work)


def round_trip(df: DataFrame, path: str, pattern: str, keys: Sequence[str], text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode, then decode the ids, in one pass: ``keys``, n_tokens and sha256 of ids and bytes.

    The ids are hashed as decimal numbers with one space between.  ``with_ids`` adds the
    ids themselves.  NULL is encoded like an empty text.
    """

    def work(texts):
        bpe = Bpe.load(path, pattern)
        kept, counts, left, right = [], [], [], []
        for cut in bpe.pieces(texts):
            of, said = bpe.ids_of, bpe.text_of
            ids = list(chain.from_iterable(map(of.__getitem__, cut)))
            counts.append(len(ids))
            left.append(hashlib.sha256(" ".join(map(said.__getitem__, cut)).encode()).hexdigest())
            right.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            if with_ids:
                kept.append(np.array(ids, dtype=np.int32))
        made = [pa.array(counts, pa.int64()), pa.array(left), pa.array(right)]
        if with_ids:
            bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            made.append(pa.ListArray.from_arrays(bounds, np.concatenate(kept) if kept else np.zeros(0, dtype=np.int32)))
        return made

    schema = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        schema.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return _run(df, keys, text, schema, work)
