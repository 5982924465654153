"""Byte-level BPE: a segment tree over byte positions picks each merge.

Each leaf holds the rank of the pair that starts at that byte (or infinity); an
inner node holds the least rank below it, so the root is the next merge and a
descent that prefers the left child finds its leftmost place.  A merge updates
the leaves of the merged pair and of its live neighbours, each in logarithmic
time.  Pieces of similar length run in lockstep, one tree per array row.

Contract for odd input: null text encodes as the empty text (no ids); every text
is encoded whole; rows are independent, so ties and repeated rows need no rule;
an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a worker's piece cache before it is emptied, and characters encoded together.
CACHE_PIECES = 400_000
CHUNK_CHARS = 2_000_000
NEVER = np.int32(2**31 - 1)
#: Lockstep pays off from this many pieces for each 32 bytes of width.
LOCKSTEP_PIECES = 16
_LOADED: dict[tuple[str, str], "ByteBpe"] = {}


class ByteBpe:
    """Ranks in tiktoken's file format; ids are ranks."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.int64(2**62))
        self.pair_ranks = np.append(np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))[order], NEVER)
        self.pairs = pairs
        self.cache: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> "ByteBpe":
        return cls.of(Path(path).read_bytes(), pattern)

    @classmethod
    def of(cls, ranks: bytes, pattern: str) -> "ByteBpe":
        """The model of a rank file's content, made once per process."""
        key = hashlib.sha256(ranks).hexdigest(), pattern
        if key not in _LOADED:
            _LOADED[key] = cls(ranks, pattern)
        return _LOADED[key]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ids below zero stand for "no token"."""
        keys = left << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], NEVER)

    def merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of 1 to ``width`` bytes (a power of two), as little-endian 32-bit bytes."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        ids = np.full((n, width + 1), -1, dtype=np.int64)  # the last column: past the end
        inside = np.arange(width) < lengths[:, None]
        ids[:, :width][inside] = self.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        after[:, :width] = np.minimum(after[:, :width], lengths[:, None])
        after[np.arange(n), lengths - 1] = width
        before = np.tile(np.arange(-1, width), (n, 1))  # -1 is the column past the end too, always without a token
        tree = np.full((n, 2 * width), NEVER, dtype=np.int32)
        tree[:, width:-1] = self._rank(ids[:, : width - 1].ravel(), ids[:, 1:width].ravel()).reshape(n, width - 1)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        live = np.flatnonzero(tree[:, 1] < NEVER)
        while len(live):
            best = tree[live, 1]
            node = np.ones(len(live), dtype=np.int64)
            while node[0] < width:
                node = 2 * node + (tree[live, 2 * node] != best)
            here = node - width
            gone = after[live, here]
            following = after[live, gone]
            previous = before[live, here]
            ids[live, here] = best
            ids[live, gone] = -1
            after[live, here] = following
            before[live, following] = here
            ids[live, width] = -1
            tree[live, node] = self._rank(best.astype(np.int64), ids[live, following])
            tree[live, gone + width] = NEVER
            has = np.flatnonzero(previous >= 0)
            rows = live[has]
            tree[rows, previous[has] + width] = self._rank(ids[rows, previous[has]], ids[rows, here[has]])
            row3 = np.concatenate((live, live, rows))
            leaf3 = np.concatenate((here, gone, previous[has])) + width
            while leaf3[0] > 1:
                leaf3 >>= 1
                tree[row3, leaf3] = np.minimum(tree[row3, 2 * leaf3], tree[row3, 2 * leaf3 + 1])
            live = live[tree[live, 1] < NEVER]
        kept = ids[:, :width] >= 0
        flat = ids[:, :width][kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merge_one(self, piece: bytes) -> bytes:
        """The same tree for a single piece of any length."""
        n = len(piece)
        never, pairs = int(NEVER), self.pairs
        width = 1 << max(1, n - 1).bit_length()
        ids = self.byte_id[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [never] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = pairs.get(ids[i] << 32 | ids[i + 1], never)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while (best := tree[1]) < never:
            node = 1
            while node < width:
                node *= 2
                if tree[node] != best:
                    node += 1
            here = node - width
            gone, previous = after[here], before[here]
            following = after[gone]
            ids[here], ids[gone], after[here] = best, -1, following
            changed = [(gone, never), (here, never)]
            if following < n:
                before[following] = here
                changed[1] = (here, pairs.get(best << 32 | ids[following], never))
            if previous >= 0:
                changed.append((previous, pairs.get(ids[previous] << 32 | best, never)))
            for leaf, rank in changed:
                node = leaf + width
                tree[node] = rank
                while node > 1:
                    node >>= 1
                    a, b = tree[2 * node], tree[2 * node + 1]
                    tree[node] = a if a < b else b
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of new pieces into the cache."""
        groups: dict[int, list[str]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if (rank := self.ranks.get(raw)) is not None:
                self.cache[piece] = rank.to_bytes(4, "little")
            else:
                groups.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append(piece)
        for width, group in groups.items():
            if len(group) * 32 < width * LOCKSTEP_PIECES:
                self.cache.update((p, self.merge_one(p.encode("utf-8", "surrogatepass"))) for p in group)
                continue
            step = max(1, 2_000_000 // width)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                self.cache.update(zip(part, self.merge_rows([p.encode("utf-8", "surrogatepass") for p in part], width)))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        k = 0
        while k < len(texts):
            chunk, size = [], 0
            while k < len(texts) and (not chunk or size + len(texts[k]) <= CHUNK_CHARS):
                size += len(texts[k])
                chunk.append(self.pattern.findall(texts[k]))
                k += 1
            new = set().union(*chunk)
            if len(self.cache) + len(new) > CACHE_PIECES:
                self.cache.clear()
            self.learn(new.difference(self.cache))
            for pieces in chunk:
                yield b"".join(map(self.cache.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_texts(frame: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """A row per input row: id, ids (array, if ``with_ids``), n_tokens and the digests of ids and of the decoded bytes.

    ``path``: the rank file; the driver reads it and broadcasts its content, whose size the vocabulary fixes.
    """
    shared = frame.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    source = frame.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    id_type = source.schema["_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ByteBpe.of(shared.value, pattern)
        for batch in batches:
            encoded = list(model.encode(batch.column(1).to_pylist()))
            columns = {
                id_col: batch.column(0),
                "n_tokens": pa.array([len(x) // 4 for x in encoded], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in encoded]),
                "decoded_sha256": pa.array([hashlib.sha256(model.decode(x)).hexdigest() for x in encoded]),
            }
            if with_ids:
                columns["ids"] = pa.array([np.frombuffer(x, dtype="<u4").astype(np.int64) for x in encoded], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(columns)

    kind = id_type.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>" if with_ids else "")
    return source.mapInArrow(run, schema)


def decode_ids(frame: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and the decoded bytes of each row; null ids decode to nothing."""
    source = frame.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<long>")).alias("_ids"))
    kind = source.schema["_id"].dataType.simpleString()
    shared = frame.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ByteBpe.of(shared.value, pattern)
        for batch in batches:
            out = [b"".join(map(model.bytes_of.__getitem__, ids)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "decoded": pa.array(out, pa.binary())})

    return source.mapInArrow(run, f"`{id_col}` {kind}, decoded binary")
