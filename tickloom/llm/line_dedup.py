"""Line dedup: two Bloom filters pick the lines worth a shuffle.

A first pass over the texts fills two filters, "seen once" and "seen twice".
Filters of different tasks merge without a shuffle of lines: a bit set on both
sides has been seen twice.  A second pass sends only lines that the second
filter suspects to a grouping by the key's 128-bit digest, which finds the keys of
several documents and the least document of each.

The filters have a fixed size, ``filter_bytes`` each (broadcast), whatever the
input: on more lines they suspect more, so more digests shuffle, and the result
is the same.  They sift while their bits are mostly free, up to some 8 keys a byte
of the filter; far beyond that every line is suspect.

Contract for odd input: ids are integers; a null or empty text is one empty line;
keys shorter than ``min_chars`` code points are never dropped; rows with one id
are one document; rows without an id are documents named by their text that sort
after all others; repeated rows each keep or lose their lines; an empty table
gives an empty result; other columns are ignored (``deduplicate_lines``) or kept,
whatever their names (``drop_repeated_lines``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, document_key, fresh_name, join_by_frequency

BLANK = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10
FILTER_BYTES = 1 << 22
#: Bits set for each key, and bytes of a merged piece of a filter.
PROBES = 4
PIECE = 1 << 16


def line_key(line: bytes, min_chars: int = 0) -> bytes | None:
    """The key of a UTF-8 line; None if it has fewer than ``min_chars`` code points."""
    key = line.strip(BLANK).lower()  # on bytes: A-Z only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8")) < min_chars:
        return None
    return key


def text_keys(text: bytes, min_chars: int) -> list[bytes]:
    return [key for line in text.split(b"\n") if (key := line_key(line, min_chars)) is not None]


def _digests(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit numbers for each key."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype=np.uint64).reshape(-1, 2)


def _bits(hashes: np.ndarray, filter_bytes: int) -> np.ndarray:
    """A row of PROBES bit places for each key, by double hashing."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (hashes[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(filter_bytes * 8)


class TwiceSeen:
    """Two Bloom filters over one bit space."""

    def __init__(self, filter_bytes: int):
        self.once = np.zeros(filter_bytes * 8, dtype=bool)
        self.twice = np.zeros(filter_bytes * 8, dtype=bool)

    def add(self, hashes: np.ndarray) -> None:
        keys, counts = np.unique(hashes, return_counts=True)
        places = _bits(keys, len(self.once) // 8)
        again = (counts > 1) | self.once[places].all(axis=1)
        self.twice[places[again].ravel()] = True
        # two new keys of one call may share a bit; the bit is then seen once, as a filter has it
        self.once[places.ravel()] = True


def build_filter(frame: DataFrame, text_col: str, min_chars: int, filter_bytes: int) -> bytes:
    """The merged "seen twice" filter, packed."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TwiceSeen(filter_bytes)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                seen.add(_digests([key for text in batch.column(0)[k : k + 512].to_pylist() for key in text_keys(text, min_chars)])[:, 0])
        once, twice = np.packbits(seen.once).tobytes(), np.packbits(seen.twice).tobytes()
        pieces = [k for k in range(0, filter_bytes, PIECE) if any(once[k : k + PIECE])]
        yield pa.RecordBatch.from_pydict(
            {"piece": pa.array(pieces, pa.int32()), "once": pa.array([once[k : k + PIECE] for k in pieces], pa.binary()), "twice": pa.array([twice[k : k + PIECE] for k in pieces], pa.binary())}
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for piece, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
                x, y = merged.get(piece, (np.zeros(len(a), dtype=np.uint8), np.zeros(len(a), dtype=np.uint8)))
                merged[piece] = (x | a, y | b | (x & a))
        yield pa.RecordBatch.from_pydict(
            {"piece": pa.array(list(merged), pa.int32()), "once": pa.array([a.tobytes() for a, _ in merged.values()], pa.binary()), "twice": pa.array([b.tobytes() for _, b in merged.values()], pa.binary())}
        )

    schema = "piece int, once binary, twice binary"
    parts = frame.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text")).mapInArrow(scan, schema)
    # first within salted groups of tasks, then the groups: no task reads a piece from every task
    salted = parts.withColumn("salt", F.spark_partition_id() % 16).repartition("piece", "salt").drop("salt").mapInArrow(merge, schema)
    whole = salted.repartition("piece").mapInArrow(merge, schema).select("piece", "twice")
    out = bytearray(filter_bytes)
    for row in whole.toLocalIterator():
        out[row.piece : row.piece + len(row.twice)] = row.twice
    return bytes(out)


def lost_keys(frame: DataFrame, id_col: str, text_col: str, min_chars: int, filter_bytes: int) -> DataFrame:
    """(nameless, doc, lost): for each document the 128-bit digests of the keys that it loses."""
    spark = frame.sparkSession
    shared = spark.sparkContext.broadcast(build_filter(frame, text_col, min_chars, filter_bytes))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.unpackbits(np.frombuffer(shared.value, dtype=np.uint8)).view(bool)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                own = [set(text_keys(text, min_chars)) for text in part.column(2).to_pylist()]
                digests = _digests([key for keys in own for key in keys])
                row = np.repeat(np.arange(part.num_rows), [len(keys) for keys in own])
                hit = twice[_bits(digests[:, 0], filter_bytes)].all(axis=1)
                both, row = digests[hit].view(np.int64), pa.array(row[hit])
                yield pa.RecordBatch.from_pydict({"h": pa.array(both[:, 0]), "l": pa.array(both[:, 1]), "nameless": part.column(0).take(row), "doc": part.column(1).take(row)})

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    source = frame.select(*document_key(frame, id_col, text), text.cast("binary").alias("text"))
    found = checkpointed(source.mapInArrow(suspects, "h long, l long, nameless int, doc long"))
    holder = F.struct("nameless", "doc")
    held = found.groupBy("h", "l").agg(F.min(holder).alias("first"), F.max(holder).alias("last"), F.count(F.lit(1)).alias("n"))
    lost = join_by_frequency(found, held.where("first < last").drop("last"), ["h", "l"], "n").where(holder != F.col("first"))
    return lost.groupBy("nameless", "doc").agg(F.collect_set(F.struct("h", "l")).alias("lost"))


def _rewrite(frame: DataFrame, id_col: str, text_col: str, min_chars: int, filter_bytes: int) -> tuple[DataFrame, str]:
    """(``frame`` with one more column, its name): the digests of the keys that the document loses (null: none)."""
    own = fresh_name(frame, "line")
    lost = lost_keys(frame, id_col, text_col, min_chars, filter_bytes).toDF(f"{own}_nameless", f"{own}_doc", own)
    key = document_key(frame, id_col, F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    keyed = frame.select("*", key[0].alias(f"{own}_nameless"), key[1].alias(f"{own}_doc"))
    return keyed.join(lost, [f"{own}_nameless", f"{own}_doc"], "left").drop(f"{own}_nameless", f"{own}_doc"), own


def _kept(text: bytes, drop: list[dict] | None, min_chars: int) -> tuple[bytes, int, int]:
    if not drop:
        return text, text.count(b"\n") + 1, 0
    lines = text.split(b"\n")
    gone = {(d["h"], d["l"]) for d in drop}
    keys = [line_key(line, min_chars) for line in lines]
    digests = iter(map(tuple, _digests([k for k in keys if k is not None]).view(np.int64).tolist()))
    stay = [line for line, key in zip(lines, keys) if key is None or next(digests) not in gone]
    return b"\n".join(stay), len(lines), len(lines) - len(stay)


def deduplicate_lines(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, filter_bytes: int = FILTER_BYTES, with_text: bool = True) -> DataFrame:
    """A row per input row: id, n_lines, n_dropped, kept_sha256 and (if ``with_text``) kept_text."""
    narrow = frame.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = [_kept(t, d, min_chars) for t, d in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                columns = {
                    id_col: part.column(0),
                    "n_lines": pa.array([r[1] for r in rows], pa.int64()),
                    "n_dropped": pa.array([r[2] for r in rows], pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string()),
                }
                if with_text:
                    columns["kept_text"] = pa.array([r[0].decode("utf-8") for r in rows], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"`{id_col}` {kind}, n_lines long, n_dropped long, kept_sha256 string" + (", kept_text string" if with_text else "")
    joined, own = _rewrite(narrow, "id", "text", min_chars, filter_bytes)
    return joined.select("id", F.coalesce("text", F.lit("")).cast("binary"), own).mapInArrow(cut, schema)


def drop_repeated_lines(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``frame`` with the same columns and the repeated lines gone from the text (a null text stays null)."""
    joined, own = _rewrite(frame, id_col, text_col, min_chars, filter_bytes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [t if t is None else _kept(t.encode("utf-8"), d, min_chars)[0].decode("utf-8") for t, d in zip(batch.column(at).to_pylist(), batch.column(own).to_pylist())]
            yield batch.set_column(at, text_col, pa.array(texts, pa.string())).drop_columns(own)

    return joined.mapInArrow(cut, frame.schema)
