"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is embedded as the vector of bit counts of its segments.  The
Manhattan distance of two vectors never exceeds the fingerprints' Hamming
distance, so pairs within ``d`` bits are within ``d`` in the embedding.  Such a
pair differs in at most ``d`` coordinates; with the coordinates dealt into
``d + 3`` blocks it shares the grid cell of some ``3`` blocks, and every pair
meets in the cell of its first such choice.  Inside a cell the Manhattan bound
sifts candidates and the Hamming distance decides.  A cell passes on one link per
fingerprint, never all pairs.  Cells of many fingerprints are cut again on the
finest grid of the embedding, segments of one bit: a choice of ``FINE_SPARE`` of
``d + FINE_SPARE`` blocks leaves 2 blocks of 4 bits open at 2 bits of distance, so
a cell then holds at most 256 fingerprints.

Contract for odd input: ids are integers; null and empty texts have no words and
the fingerprint zero, which links like any other; texts are read whole; rows with
one id count as one document for the component, and all of them are returned; a
row without an id takes part, is returned with a null id, and its component is
null if no linked row has an id; an empty table gives an empty result; other
columns are ignored (``near_duplicates``) or kept (``drop_near_duplicates``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh_name, integer_ids, join_by_frequency
from .components import connected_components

SEED = 42
SHINGLE_WORDS = 3
SEGMENT_BITS = 2
#: Cells beyond CELL_LIMIT are cut again, by this choice of blocks.
CELL_LIMIT = 4096
FINE_SPARE = 14

_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], dtype=np.uint64)


def fingerprint_many(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of texts whose hashes stand one after another, ``counts`` for each (0: fingerprint zero)."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = counts > 0
    if not full.any():
        return out
    sizes = counts[full]
    begins = np.cumsum(sizes) - sizes
    # bytes of a hash spread to eight lanes each; runs of at most 255 rows cannot overflow a lane
    parts = -(-sizes // 255)
    of = np.repeat(np.arange(len(sizes)), parts)
    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = begins[of] + inner * 255
    lanes = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], starts, axis=0)
    ones = np.add.reduceat(np.ascontiguousarray(lanes).view(np.uint8).reshape(len(starts), 64).astype(np.int64), np.cumsum(parts) - parts, axis=0)
    bits = ones * 2 > sizes[:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def text_hashes(text: bytes, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each word shingle of a lower-cased text."""
    words = text.lower().split()  # on bytes: A-Z only, and exactly U+0020, U+0009..U+000D
    shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)] * bool(words)
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64)


def fingerprints(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """id and ``fp``, the 64-bit fingerprint as a signed long, a row per input row."""
    source = frame.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = np.zeros(len(texts), dtype=np.uint64)
            first, held, size = 0, [], 0
            for k, text in enumerate(texts):
                held.append(text_hashes(text.as_py(), shingle))
                size += len(held[-1])
                if size > 1_000_000 or k + 1 == len(texts):
                    found[first : k + 1] = fingerprint_many(np.concatenate(held), np.array([len(h) for h in held]))
                    first, held, size = k + 1, [], 0
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "fp": pa.array(found.view(np.int64))})

    return source.mapInArrow(run, f"`{id_col}` {kind}, fp long")


def segment_counts(fps: np.ndarray, segment_bits: int = SEGMENT_BITS) -> np.ndarray:
    """The embedding: bits set in each segment."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(fps), 64 // segment_bits, segment_bits).sum(axis=2, dtype=np.uint8)


def unary_codes(fps: np.ndarray, segment_bits: int = SEGMENT_BITS) -> np.ndarray:
    """The embedding with each count in unary: XOR and popcount give the Manhattan distance."""
    ones = np.arange(segment_bits) < segment_counts(fps, segment_bits)[:, :, None]
    return np.packbits(ones.reshape(len(fps), 64), axis=1, bitorder="little").view(np.uint64).ravel()


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _cells(columns: np.ndarray, keep: int, blocks: int, salt: int) -> Iterator[np.ndarray]:
    """A 64-bit cell name for each choice of ``keep`` of ``blocks`` blocks of columns."""
    names = []
    for part in np.array_split(np.arange(columns.shape[1]), blocks):
        name = np.full(len(columns), salt, dtype=np.uint64)
        for c in part:
            name = _mix(name * np.uint64(31) + columns[:, c].astype(np.uint64) + np.uint64(1))
        names.append(name)
    for k, chosen in enumerate(combinations(range(blocks), keep)):
        cell = np.full(len(columns), salt * 1000 + k, dtype=np.uint64)
        for b in chosen:
            cell = _mix(cell ^ names[b])
        yield cell


def reached_from(size: int, near: Callable) -> list[tuple[int, int]]:
    """(root, member) for every one of ``size`` members that some chain of near ones joins to a root.

    ``near(a, b)`` tells it for broadcast arrays of members; each member is compared with the free ones once.
    """
    free, out = np.ones(size, dtype=bool), []
    step = max(1, min(256, (1 << 21) // max(1, size)))
    for root in range(size):
        if not free[root]:
            continue
        free[root] = False
        front = np.array([root])
        while len(front) and free.any():
            reached = np.zeros(size, dtype=bool)
            for k in range(0, len(front), step):
                rest = np.flatnonzero(free & ~reached)
                reached[rest[near(front[k : k + step, None], rest[None, :]).any(axis=0)]] = True
            free &= ~reached
            front = np.flatnonzero(reached)
            out += [(root, k) for k in front.tolist()]
    return out


def cell_links(fps: np.ndarray, distance: int, segment_bits: int = SEGMENT_BITS) -> list[tuple[int, int]]:
    """Index pairs that connect the linked fingerprints of one cell, one for each but the first of a component."""
    codes = unary_codes(fps, segment_bits)
    return reached_from(len(fps), lambda a, b: (np.bitwise_count(codes[a] ^ codes[b]) <= distance) & (np.bitwise_count(fps[a] ^ fps[b]) <= distance))


def fingerprint_links(distinct: DataFrame, distance: int = 2, segment_bits: int = SEGMENT_BITS, spare: int = 3, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """(src, dst): pairs of fingerprints of one component, enough to connect all within ``distance`` bits.

    ``distinct`` has one column ``fp`` without repeats.
    """

    def explode(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                if level == 0:
                    names = list(_cells(segment_counts(fps, segment_bits), spare, distance + spare, 1))
                else:
                    names = list(_cells(segment_counts(fps, 1), FINE_SPARE, distance + FINE_SPARE, 2))
                cells = np.stack(names, axis=1) if len(fps) else np.zeros((0, 1), dtype=np.uint64)
                if level:
                    cells = _mix(cells ^ batch.column("cell").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[:, None])
                width = cells.shape[1]
                yield pa.RecordBatch.from_pydict({"cell": pa.array(cells.ravel().view(np.int64)), "fp": pa.array(np.repeat(fps, width).view(np.int64))})

        return run

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells arrive whole: the rows of a partition are sorted by cell."""
        held: list[pd.DataFrame] = []

        def flush(rows: pd.DataFrame) -> pd.DataFrame:
            cells, fps = rows["cell"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
            edges = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
            ends = np.r_[edges[1:], len(cells)]
            found = []
            for a, b in zip(edges[ends - edges > 1].tolist(), ends[ends - edges > 1].tolist()):
                group = fps[a:b]
                if b - a == 2:
                    if int(group[0] ^ group[1]).bit_count() <= distance:
                        found.append((group[0], group[1]))
                else:
                    found += [(group[i], group[j]) for i, j in cell_links(group, distance, segment_bits)]
            pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pd.DataFrame({"src": pairs[:, 0], "dst": pairs[:, 1]})

        for batch in batches:
            last = batch["cell"].iloc[-1] if len(batch) else None
            done = batch[batch["cell"] != last]
            if len(done):
                yield flush(pd.concat([*held, done], ignore_index=True))
                held = [batch[batch["cell"] == last]]
            elif len(batch):
                if held and held[-1]["cell"].iloc[-1] != last:
                    yield flush(pd.concat(held, ignore_index=True))
                    held = []
                held.append(batch)
        if held:
            yield flush(pd.concat(held, ignore_index=True))

    first = distinct.select("fp").mapInArrow(explode(0), "cell long, fp long")
    sizes = first.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = join_by_frequency(first, sizes.withColumn("weight", F.col("size")), ["cell"], "weight")
    small = shared.where(F.col("size") <= cell_limit).select("cell", "fp")
    large = shared.where(F.col("size") > cell_limit).select("cell", "fp").mapInArrow(explode(1), "cell long, fp long")
    cells = small.unionByName(large)
    return cells.repartition("cell").sortWithinPartitions("cell").mapInPandas(link, "src long, dst long").distinct()


def near_duplicates(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """A row per input row: id, fingerprint (16 hex digits) and component_id, the least id it is linked with."""
    source = frame.select(integer_ids(frame, id_col).alias("id"), F.col(f"`{text_col}`").alias("text"))
    marked = checkpointed(fingerprints(source, "id", "text", shingle))
    classes = marked.groupBy("fp").agg(F.min("id").alias("label"), F.count(F.lit(1)).alias("rows"))
    # rows that share an id connect their fingerprints
    repeated = marked.where("id is not null").groupBy("id").agg(F.min("fp").alias("src"), F.max("fp").alias("top")).where("src <> top")
    same = marked.join(repeated.select("id", "src"), "id").select("src", F.col("fp").alias("dst")).where("src <> dst").distinct()
    links = fingerprint_links(classes.select("fp"), distance).unionByName(same)
    least = connected_components(links, classes.select(F.col("fp").alias("node"), "label"))
    weighed = least.join(classes.select(F.col("fp").alias("node"), "rows"), "node").withColumnRenamed("node", "fp")
    return join_by_frequency(marked, weighed, ["fp"], "rows").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("label").alias("component_id")
    )


def drop_near_duplicates(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``frame`` with the documents of the least id of each group.

    Rows of one id stay or go together; rows without an id stay if their group
    has no row with one.
    """
    source = frame.select(integer_ids(frame, id_col).alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = near_duplicates(source, "id", "text", distance, shingle)
    kept = fresh_name(frame, "kept")
    least = found.where("id = component_id").select(F.col("id").alias(kept)).distinct()
    with_id = frame.join(least, F.col(f"`{id_col}`") == F.col(kept), "left_semi")
    alone = found.where("id is null and component_id is null").select("fingerprint").distinct()
    if not alone.limit(1).count():
        return with_id
    prints = fingerprints(source.where("id is null").select(F.col("text").alias("own"), "text").distinct(), "own", "text", shingle)
    stay = prints.select(F.col("own").alias(kept), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")).join(alone, "fingerprint", "left_semi").select(kept)
    without = frame.where(F.col(f"`{id_col}`").isNull())
    return with_id.unionByName(without.join(stay, F.col(f"`{text_col}`").eqNullSafe(F.col(kept)), "left_semi"))
