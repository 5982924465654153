"""SimHash near-duplicates of whole texts: five-word shingles, Jaccard similarity of 0.8 or more.

1. Texts with one set of shingles are one node, with the set's size and a SimHash
   fingerprint of ``WORDS`` times 64 bits.  A count sketch tells which shingles are
   frequent.
2. Two sets of similarity ``least`` share one of the first
   ``n - ceil(least * n) + 1`` shingles of each, in any one order of all shingles;
   the order here is rare ones first.  Nodes meet in the cells of these shingles.
   (Grid cells of the embedding alone cannot be used: such sets differ by some 10
   of 64 bits, where equal counts choose next to nothing.)
3. Inside a cell the segment-popcount embedding is range-joined under Manhattan
   distance, a lower bound of the fingerprints' Hamming distance, which is checked
   next.  Both allow ``sift_limits`` bits, five standard deviations above the mean
   of sets of similarity ``least``; unrelated sets lie as far beyond, so they do
   not chain up as cells grow with the input.  A cell passes on one link per node,
   never its pairs.
4. The components of these links hold all similar sets.  The texts of a component
   meet once and every pair in different groups that shares a shingle of step 2
   is checked on the whole sets.  Components of more than ``GROUP_SHINGLES``
   shingles are dealt at random into blocks, ``DEALS`` times, and the texts of a
   block meet: that joins the bulk of a group of near texts.  Then pairs of blocks
   meet, but no two of one such cluster, so what is copied are the few texts left.

Shingles and sets are named by 64-bit hashes.  Contract for odd input: ids are
integers; null and empty texts have the empty set and are alike; rows of one id
stay or go together; rows without an id are documents named by their set, sort
after all others and stay only if their group has no id; an empty table gives an
empty result; other columns are kept, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from math import acos, ceil, comb, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed, fresh_name, integer_ids
from .components import connected_components
from .simhash import _mix, fingerprint_many, reached_from, text_hashes, unary_codes

SHINGLE_WORDS = 5
#: Counters of a row of the sketch, of which there are two, and of a piece of it.
COUNTERS, PIECE = 1 << 17, 1 << 14
#: 64-bit words of a fingerprint; sets of SIFT_SIZE shingles or more share one limit.
WORDS, SIFT_SIZE = 3, 64
GROUP_SHINGLES = 4_000_000
DEALS = 2


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes())


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(COUNTERS - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def _scan(source: DataFrame, shingle: int) -> DataFrame:
    """(id, node) of every row, and the tasks' shares of the sketch (piece, counts), in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(2 * COUNTERS, dtype=np.uint32)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [np.unique(text_hashes(t.as_py(), shingle)) for t in part.column(1)]
                one, two = _places(np.concatenate(sets))
                sketch[:COUNTERS] += np.bincount(one, minlength=COUNTERS).astype(np.uint32)
                sketch[COUNTERS:] += np.bincount(two, minlength=COUNTERS).astype(np.uint32)
                none = pa.nulls(part.num_rows)
                yield pa.RecordBatch.from_pydict({"id": part.column(0), "node": pa.array([node_of(s) for s in sets], pa.uint64()).view(pa.int64()), "piece": none.cast(pa.int32()), "counts": none.cast(pa.binary())})
        pieces = [k for k in range(0, len(sketch), PIECE) if sketch[k : k + PIECE].any()]
        none = pa.nulls(len(pieces), pa.int64())
        yield pa.RecordBatch.from_pydict({"id": none, "node": none, "piece": pa.array(pieces, pa.int32()), "counts": pa.array([zlib.compress(sketch[k : k + PIECE].astype(np.uint64).tobytes(), 1) for k in pieces], pa.binary())})

    return source.mapInArrow(run, "id long, node long, piece int, counts binary")


def _frequency_classes(shares: DataFrame) -> np.ndarray:
    """For each counter 0, or how many times (as a power of two) it exceeds the noise of a chance counter."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(*(c.to_pylist() for c in batch.columns)):
                counts = np.frombuffer(zlib.decompress(counts), dtype=np.uint64)
                sums[piece] = sums[piece] + counts if piece in sums else counts
        yield pa.RecordBatch.from_pydict({"piece": pa.array(list(sums), pa.int32()), "counts": pa.array([zlib.compress(s.tobytes(), 1) for s in sums.values()], pa.binary())})

    kind = "piece int, counts binary"
    salted = shares.withColumn("salt", F.spark_partition_id() % 16).repartition("piece", "salt").drop("salt").mapInArrow(merge, kind)
    counts = np.zeros(2 * COUNTERS)
    for row in salted.repartition("piece").mapInArrow(merge, kind).toLocalIterator():  # 2 * COUNTERS numbers
        counts[row.piece : row.piece + PIECE] = np.frombuffer(zlib.decompress(row.counts), dtype=np.uint64)
    mean = counts.mean()
    excess = (counts - mean) / (4 * np.sqrt(mean) + 4)
    return np.where(excess >= 1, np.floor(np.log2(np.maximum(excess, 1))) + 1, 0).astype(np.uint8)


def prefix_of(hashes: np.ndarray, classes: np.ndarray, least: float) -> np.ndarray:
    """The shingles of a set (sorted hashes) by which it meets others: rare ones first."""
    n = len(hashes)
    if not n:
        return hashes
    size = n - int(np.ceil(least * n - 1e-9)) + 1
    one, two = _places(hashes)
    kind = np.minimum(classes[one], classes[COUNTERS + two])
    return hashes[np.argsort(kind, kind="stable")[:size]]


def wide_fingerprints(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of ``WORDS`` words, a column per word: the SimHash of the hashes, and of the hashes mixed anew."""
    return np.stack([fingerprint_many(_mix(hashes + np.uint64(k)) if k else hashes, sizes) for k in range(WORDS)], axis=1)


def _bit_difference(a: int, b: int, both: int) -> float:
    """Chance that a bit of the fingerprints of sets of ``a`` and ``b`` shingles, ``both`` of them shared, differs."""
    tail = lambda n, least: sum(comb(n, k) for k in range(max(least, 0), n + 1)) / 2**n
    total = 0.0
    for ones in range(both + 1):
        u, v = tail(a - both, a // 2 + 1 - ones), tail(b - both, b // 2 + 1 - ones)
        total += comb(both, ones) / 2**both * (u * (1 - v) + v * (1 - u))
    return total


@cache
def sift_limits(least: float) -> np.ndarray:
    """Bits that two sets of similarity ``least`` may differ in, by the smaller one's size (``SIFT_SIZE`` stands for all from there on)."""
    out = []
    for a in range(SIFT_SIZE + 1):
        rates = [_bit_difference(a, b, both) for b in range(a, int(a / least + 1e-9) + 1) if (both := ceil(least / (1 + least) * (a + b) - 1e-9)) <= a]
        rate = max(rates, default=0.0)
        if a == SIFT_SIZE:
            rate = max(rate, acos(2 * least / (1 + least)) / pi)  # what large sets tend to
        out.append(int(64 * WORDS * rate + 5 * sqrt(64 * WORDS * rate * (1 - rate))) + 1)
    return np.array(out)


FP_COLUMNS = [f"fp{k}" for k in range(WORDS)]


def _cells(source: DataFrame, shingle: int, least: float, classes: np.ndarray) -> DataFrame:
    """(cell, node, n, fp0, ...): each node in the cells of its prefix.  Copies are left out as far as one task sees them."""
    shared = source.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = shared.value, set()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                sets = {}
                for text in batch.column(1)[k : k + 256]:
                    hashes = np.unique(text_hashes(text.as_py(), shingle))
                    sets[node_of(hashes)] = hashes
                sets = {node: s for node, s in sets.items() if node not in seen and len(s)}
                seen.update(sets)
                if len(seen) > 1_000_000:
                    seen.clear()
                if not sets:
                    continue
                own = list(sets.values())
                sizes = np.array([len(s) for s in own])
                fps = wide_fingerprints(np.concatenate(own), sizes)
                heads = [prefix_of(s, classes, least) for s in own]
                times = [len(h) for h in heads]
                yield pa.RecordBatch.from_pydict(
                    {
                        "cell": pa.array(np.concatenate(heads).view(np.int64)),
                        "node": pa.array(np.repeat(np.array(list(sets), dtype=np.uint64), times).view(np.int64)),
                        "n": pa.array(np.repeat(sizes, times).astype(np.int32)),
                    }
                    | {name: pa.array(np.repeat(fps[:, k], times).view(np.int64)) for k, name in enumerate(FP_COLUMNS)}
                )

    return source.mapInArrow(run, "cell long, node long, n int, " + ", ".join(f"{name} long" for name in FP_COLUMNS))


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of runs of rows that hold the groups of the first column whole (rows are sorted by it)."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut or (held and held[-1][0][-1] != columns[0][-1]):
            held.append([c[:cut] for c in columns])
            yield tuple(np.concatenate(parts) for parts in zip(*held))
            held = []
        held.append([c[cut:] for c in columns])
    if held:
        yield tuple(np.concatenate(parts) for parts in zip(*held))


def _near(n: np.ndarray, fp: np.ndarray, code: np.ndarray, a, b, least: float) -> np.ndarray:
    """Whether sets a and b may be similar: sizes, Manhattan distance of the embeddings, Hamming distance."""
    small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    limit = sift_limits(least)[np.minimum(small, SIFT_SIZE)]
    bits = lambda x: sum(np.bitwise_count(x[a, k] ^ x[b, k]).astype(np.int16) for k in range(WORDS))
    return (small >= least * large - 1e-9) & (bits(code) <= limit) & (bits(fp) <= limit)


def cell_links(n: np.ndarray, fp: np.ndarray, code: np.ndarray, least: float) -> list[tuple[int, int]]:
    """(root, member) for every node that some chain of near nodes joins to a root."""
    return reached_from(len(n), lambda a, b: _near(n, fp, code, a, b, least))


def _link_cells(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, node, n, *fp in whole_groups(batches):
            order = np.lexsort((node, cell))
            cell, node, n, fp = cell[order], node[order], n[order], np.stack(fp, axis=1)[order].view(np.uint64)
            fresh = np.r_[True, (cell[1:] != cell[:-1]) | (node[1:] != node[:-1])]  # tasks may both have sent a copy
            cell, node, n, fp = cell[fresh], node[fresh], n[fresh], fp[fresh]
            edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            sizes = np.diff(edges)
            keep = np.repeat(sizes > 1, sizes)
            node, n, fp = node[keep], n[keep], fp[keep]
            code, sizes = unary_codes(fp.ravel()).reshape(-1, WORDS), sizes[sizes > 1]
            tops = np.cumsum(sizes) - sizes
            two = tops[sizes == 2]
            two = two[_near(n, fp, code, two, two + 1, least)]
            src, dst = [two], [two + 1]
            for a, size in zip(tops[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                own = slice(a, a + size)
                found = np.array(cell_links(n[own], fp[own], code[own], least), dtype=np.int64).reshape(-1, 2) + a
                src.append(found[:, 0])
                dst.append(found[:, 1])
            pairs = np.unique(np.sort(np.stack((node[np.concatenate(src)], node[np.concatenate(dst)]), axis=1), axis=1), axis=0)
            yield pa.RecordBatch.from_pydict({"src": pa.array(pairs[:, 0].copy()), "dst": pa.array(pairs[:, 1].copy())})

    return run


def similar_pairs(sets: list[np.ndarray], least: float, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest of the pairs of similarity ``least`` or more; with ``side``, of those on different sides."""
    sizes = np.array([len(s) for s in sets])
    whole, local, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum(sizes)
    own = [local[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
    heads = [x[np.argsort(counts[x], kind="stable")[: len(x) - int(np.ceil(least * len(x) - 1e-9)) + 1]] for x in own]
    holder = np.repeat(np.arange(len(sets)), [len(h) for h in heads])
    flat = np.concatenate(heads)
    order = np.argsort(flat, kind="stable")
    holder, first = holder[order], np.searchsorted(flat[order], np.arange(len(whole) + 1))
    label, out = np.arange(len(sets)), []
    mark = np.zeros(len(whole), dtype=bool)
    for x in range(len(sets)):
        begin, count = first[heads[x]], first[heads[x] + 1] - first[heads[x]]
        met = holder[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        met = np.unique(met[met > x])
        met = met[(label[met] != label[x]) & (np.minimum(sizes[met], sizes[x]) >= least * np.maximum(sizes[met], sizes[x]) - 1e-9)]
        if side is not None:
            met = met[side[met] != side[x]]
        if not len(met):
            continue
        mark[own[x]] = True
        both = np.add.reduceat(mark[np.concatenate([own[y] for y in met])], np.cumsum(sizes[met]) - sizes[met], dtype=np.int64)
        mark[own[x]] = False
        for y in met[both >= least * (sizes[met] + sizes[x] - both) - 1e-9].tolist():
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                out.append((x, y))
    return out


def _verify(texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """(src, dst): verified links.  ``texts``: (label, one, two, side, node, text), a group for each (label, one, two)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        last = None

        def flush() -> pa.RecordBatch:
            nodes = list(held)
            side = np.array([s for s, _ in held.values()])
            pairs = similar_pairs([s for _, s in held.values()], least, side if side.any() else None) if len(held) > 1 else []
            held.clear()
            return pa.RecordBatch.from_pydict({"src": pa.array([nodes[a] for a, _ in pairs], pa.int64()), "dst": pa.array([nodes[b] for _, b in pairs], pa.int64())})

        for batch in batches:
            for label, one, two, side, node, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (label, one, two) != last:
                    if held:
                        yield flush()
                    last = (label, one, two)
                if node not in held:  # copies come along
                    held[node] = (side, np.unique(text_hashes(text, shingle)))
        if held:
            yield flush()

    keys = ["label", "one", "two"]
    return texts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "src long, dst long")


def _met_at_random(members: DataFrame, group_shingles: int) -> DataFrame:
    """(label, one, two, side, node): ``members`` (node, label, n) dealt at random into blocks of their components, ``DEALS`` times."""
    loads = checkpointed(members.groupBy("label").agg(F.ceil(F.sum("n") / group_shingles).cast("int").alias("blocks")))
    placed = members.join(broadcast_if_small(loads), "label").withColumn("deal", F.explode(F.lit(list(range(DEALS)))))
    return placed.select("label", F.pmod(F.xxhash64("node", "deal"), "blocks").cast("int").alias("one"), (-1 - F.col("deal")).alias("two"), F.lit(0).alias("side"), "node")


def _met_by_blocks(members: DataFrame, group_shingles: int) -> DataFrame:
    """(label, one, two, side, node): pairs of blocks of ``members`` (node, label, n, cluster), but none within a cluster.

    A cluster of more than ``group_shingles`` has blocks of its own; the others share blocks.
    """
    loads = checkpointed(members.groupBy("label", "cluster").agg(F.sum("n").alias("load")))
    heavy = F.col("load") > group_shingles
    mixed = loads.groupBy("label").agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum(F.when(~heavy, F.col("load"))), F.lit(0)).alias("rest")).where("clusters > 1")
    shared = F.ceil(F.col("rest") / group_shingles).cast("int")
    owned = loads.join(mixed, "label").withColumns({"owner": F.when(heavy, F.col("cluster")), "parts": F.when(heavy, F.ceil(F.col("load") / group_shingles).cast("int")).otherwise(shared)})
    parts = owned.select("label", "owner", "parts").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = checkpointed(parts.withColumn("block", F.row_number().over(Window.partitionBy("label").orderBy("owner", "part"))).select("label", "owner", "part", "block"))
    other = blocks.select("label", F.col("owner").alias("owner_2"), F.col("block").alias("other"))
    pairs = blocks.join(other, "label").where("owner is null or owner_2 is null or owner <> owner_2")
    # a row for each block and each block that it meets
    meets = checkpointed(pairs.select("label", "owner", "part", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), (F.col("block") > F.col("other")).cast("int").alias("side")))
    own = members.join(broadcast_if_small(checkpointed(owned.select("label", "cluster", "owner", "parts"))), ["label", "cluster"])
    own = own.withColumn("part", F.pmod(F.xxhash64(F.when(F.col("owner").isNull(), F.col("cluster")).otherwise(F.col("node"))), "parts").cast("int"))
    found = own.alias("own").join(broadcast_if_small(meets).alias("meets"), (F.col("own.label") == F.col("meets.label")) & F.col("own.owner").eqNullSafe(F.col("meets.owner")) & (F.col("own.part") == F.col("meets.part")))
    return found.select("own.label", "one", "two", "side", "node")


def _verified(texts: DataFrame, shingle: int, least: float, group_shingles: int) -> DataFrame:
    """(src, dst): verified links of ``texts`` (node, n, text, label), enough to connect the similar ones of a label."""

    def verify(dealt: DataFrame) -> DataFrame:
        return _verify(texts.drop("label").join(dealt, "node").select("label", "one", "two", "side", "node", "text"), shingle, least)

    members = checkpointed(texts.select("node", "label", "n").distinct())
    large = checkpointed(members.groupBy("label").agg(F.sum("n").alias("load")).where(F.col("load") > group_shingles).select("label"))
    whole = members.join(broadcast_if_small(large), "label", "left_anti").select("label", F.lit(0).alias("one"), F.lit(0).alias("two"), F.lit(0).alias("side"), "node")
    if not large.limit(1).count():
        return verify(whole)
    crowded = checkpointed(members.join(broadcast_if_small(large), "label", "left_semi"))
    links = checkpointed(verify(whole.unionByName(_met_at_random(crowded, group_shingles))))
    clusters = connected_components(links, crowded.select("node", F.col("node").alias("label"))).withColumnRenamed("label", "cluster")
    return links.unionByName(verify(_met_by_blocks(checkpointed(crowded.join(clusters, "node")), group_shingles)))


def similar_links(source: DataFrame, nodes: DataFrame, classes: np.ndarray, shingle: int, least: float, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """(src, dst): links between nodes, enough to connect all of similarity ``least``.

    ``source``: (id, text) rows; ``nodes``: (node, label), a row per node with the least id of its rows.
    """
    cells = _cells(source, shingle, least, classes)
    chains = checkpointed(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_link_cells(least), "src long, dst long").distinct())
    met = chains.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    members = connected_components(chains, met.withColumn("label", F.col("node")))
    # one document of each node brings its text
    holders = checkpointed(members.join(nodes.withColumnRenamed("label", "id"), "node"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.unique(text_hashes(t.as_py(), shingle)) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"node": pa.array([node_of(h) for h in hashes], pa.uint64()).view(pa.int64()), "n": pa.array([len(h) for h in hashes], pa.int32()), "text": batch.column("text")})

    with_id = source.join(broadcast_if_small(holders.where("id is not null").select("id").distinct()), "id", "left_semi")
    wanted = with_id.select("text")
    if holders.where("id is null").limit(1).count():
        wanted = wanted.unionByName(source.where("id is null").select("text"))
    texts = checkpointed(wanted.mapInArrow(named, "node long, n int, text binary").join(broadcast_if_small(holders.select("node", "label")), "node"))
    return _verified(texts, shingle, least, group_shingles)


def similar_groups(source: DataFrame, shingle: int = SHINGLE_WORDS, least: float = 0.8, group_shingles: int = GROUP_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """((id, node) of every row, (node, label) with the least id of each node's group, null if it has none)."""
    scanned = checkpointed(_scan(source, shingle))
    marks = scanned.where("piece is null").select("id", "node")
    classes = _frequency_classes(scanned.where("piece is not null").select("piece", "counts"))
    nodes = checkpointed(marks.groupBy("node").agg(F.min("id").alias("label")))
    links = similar_links(source, nodes, classes, shingle, least, group_shingles)
    # rows that share an id connect their nodes
    repeated = marks.where("id is not null").groupBy("id").agg(F.min("node").alias("src"), F.max("node").alias("top")).where("src <> top")
    same = marks.join(repeated.select("id", "src"), "id").select("src", F.col("node").alias("dst")).where("src <> dst").distinct()
    return marks, checkpointed(connected_components(links.unionByName(same), nodes))


def drop_similar(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``frame`` with the documents of the least id of each group."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    source = frame.select(integer_ids(frame, id_col).alias("id"), text.alias("text"))
    marks, groups = similar_groups(source, shingle, least)
    kept = fresh_name(frame, "kept")
    least_ids = groups.where("label is not null").select(F.col("label").alias(kept)).distinct()
    with_id = frame.join(least_ids, F.col(f"`{id_col}`") == F.col(kept), "left_semi")
    alone = groups.where("label is null").select(F.col("node").alias(kept))
    if not alone.limit(1).count():
        return with_id
    texts = source.where("id is null").select("text").distinct()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [node_of(np.unique(text_hashes(t.as_py(), shingle))) for t in batch.column(0)]
            yield pa.RecordBatch.from_pydict({kept: pa.array(nodes, pa.uint64()).view(pa.int64()), f"{kept}_text": batch.column(0)})

    stay = texts.mapInArrow(named, f"`{kept}` long, `{kept}_text` binary").join(alone, kept, "left_semi").select(f"{kept}_text")
    without = frame.where(F.col(f"`{id_col}`").isNull()).join(stay, text == F.col(f"{kept}_text"), "left_semi")
    return with_id.unionByName(without)


__all__ = ["drop_similar", "similar_groups", "similar_links", "similar_pairs"]
