"""Exact substring dedup with suffix arrays built by linear Lyndon grouping.

A byte goes if some window of ``window`` bytes that covers it also starts
anywhere else, in its own or another document.  Windows never cross documents.

1. Every window is named by the least hash of its 32-byte substrings.  Runs of
   windows with one name form a segment (its bytes hold all their windows); equal
   windows have equal names, so segments meet by name.  Names seen once are done.
2. Equal segments of one name fold into one with a copy count.  The distinct
   segments of a name are fetched once, from one of their documents.
3. The distinct segments of a name go through the suffix array.  They are parsed
   into phrases at places chosen by content, phrases are ranked by their bytes,
   and the phrase string is suffix-sorted by grouping suffixes by Lyndon prefix
   in descending order with previous-smaller pointers, then emitting each group
   (``suffix_array``).  Windows are equal if they stand at one offset before
   their phrase start, the bytes of that offset are equal (neighbours in the order
   of a hash of them, then compared), and the suffixes of the phrase starts share
   the rest, which the common-prefix table tells.
4. Marked windows return to all documents of their segment.

A task holds the segments of a name, ``name_bytes`` bytes at most.  A name of more
is split: its distinct segments are cut again by the least hash of substrings twice
as long, as if they were documents with copies, and so on to 256 bytes; what is
still too long then is cut into single windows, named by all their bytes, which
fold by their copy counts alone.  Segments fold by 128-bit digests.

Contract for odd input: ids are integers; null text is the empty text; texts are
UTF-8 bytes and read whole; a text shorter than the window loses nothing; repeated
rows are copies and lose their windows; rows without an id are documents like any
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, document_key, join_by_frequency

WINDOW = 400
#: Lengths of the substrings that name a window, for each split of a name.
NAME_LENGTHS = (32, 64, 128, 256)
#: Longest run of windows in a segment; bytes of text or of segments worked on at once.
RUN = 512
CHUNK = 1_000_000
#: Phrase starts: one place in SPARSE by its 8-byte hash, and every place after GAP bytes without one.
SPARSE = 16
GAP = 96
#: Bytes of distinct segments of one name that a task may hold.
NAME_BYTES = 3_000_000
#: Rows of one segment that a join may bring to one task; more are scattered.
COPY_ROWS = 50_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def _words8(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; the buffer is padded by eight."""
    return np.ndarray(shape=(max(0, len(buffer) - 8),), dtype="<u8", buffer=buffer, strides=(1,))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of non-negative integers."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]]
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    place, group = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    place[order], group[order] = np.arange(n), starts
    heads = np.flatnonzero(first)
    size_of = np.zeros(n, dtype=np.int64)
    size_of[heads] = np.diff(np.r_[heads, n])
    sa, at, group, size = order.tolist(), place.tolist(), group.tolist(), size_of.tolist()
    smaller = [-1] * n
    high = n
    while high > 0:  # groups from the greatest Lyndon prefix down
        low = group[sa[high - 1]]
        members = sa[low:high]
        if high - low > 1:
            members.sort()
        followers: dict[int, int] = {}
        for x in members:
            p = x - 1
            while p >= 0 and group[p] > low:
                p = smaller[p]
            if p >= 0 and group[p] == low:
                p = smaller[p]
            smaller[x] = p
            if p >= 0:
                followers[p] = followers.get(p, 0) + 1
        if followers:
            # a prefix followed by more copies of this group's prefix sorts higher within its own group
            counts = {1: followers} if max(followers.values()) == 1 else {}
            if not counts:
                for j, c in followers.items():
                    counts.setdefault(c, []).append(j)
            for c in sorted(counts, reverse=True):
                moved: dict[int, int] = {}
                for j in counts[c]:
                    g = group[j]
                    size[g] = left = size[g] - 1
                    end, here = g + left, at[j]
                    other = sa[end]
                    sa[here], at[other] = other, here
                    sa[end], at[j] = j, end
                    moved[g] = moved.get(g, 0) + 1
                for g, count in moved.items():
                    begin = g + size[g]
                    size[begin] = count
                    for k in range(begin, begin + count):
                        group[sa[k]] = begin
        high = low
    out = [-1] * n
    free = list(range(n))  # the next free place of each group, by its start
    waiting = [True] * n

    def emit(j: int) -> None:
        while j >= 0 and waiting[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            waiting[j] = False
            j = smaller[j]

    emit(n - 1)
    for k in range(n):
        emit(out[k] - 1)
    return np.array(out, dtype=np.int64)


def _common(buffer: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray, most: int) -> np.ndarray:
    """Bytes that the strings from a and b on share, at most ``room`` and ``most``."""
    out = np.zeros(len(a), dtype=np.int64)
    padded = np.concatenate((buffer, np.zeros(most, dtype=np.uint8)))
    open_, done = np.arange(len(a)), 0
    while done < most and len(open_):
        step = min(most - done, max(16, done))
        reach = np.arange(done, done + step)
        parts = []
        for k in range(0, len(open_), 8192):
            rows = open_[k : k + 8192]
            differ = padded[a[rows, None] + reach] != padded[b[rows, None] + reach]
            hit = differ.any(axis=1)
            out[rows] = done + np.where(hit, differ.argmax(axis=1), step)
            parts.append(rows[~hit & (room[rows] > done + step)])
        open_ = np.concatenate(parts)
        done += step
    return np.minimum(np.minimum(out, room), most)


def repeated_windows(segments: list[bytes], copies: list[int], window: int = WINDOW) -> list[np.ndarray]:
    """For each segment, which of its windows start anywhere else in the segments (each with its copies)."""
    lengths = np.array([len(s) for s in segments], dtype=np.int64)
    counts = np.maximum(lengths - window + 1, 0)
    begins = np.cumsum(lengths) - lengths
    n = int(lengths.sum())
    buffer = np.zeros(n + 8, dtype=np.uint8)
    buffer[:n] = np.frombuffer(b"".join(segments), dtype=np.uint8)
    segment = np.repeat(np.arange(len(segments)), lengths)
    ends = begins + lengths
    gap = min(GAP, window // 4)
    places = np.arange(n)
    inside = places + 8 <= ends[segment]
    chosen = inside & (_mix(_words8(buffer)) % np.uint64(SPARSE) == 0)
    last = np.maximum.accumulate(np.where(chosen, places, begins[segment]))
    starts = np.flatnonzero(chosen | (inside & (places - last >= gap)))
    if not len(starts):
        return [np.full(c, m > 1) for c, m in zip(counts.tolist(), copies)]
    # phrases reach eight bytes into the next one, so none is a proper prefix of another
    owner = segment[starts]
    stop = np.r_[starts[1:] + 8, n]
    stop = np.where(np.r_[owner[1:] != owner[:-1], True], ends[owner], stop)
    raw = buffer.tobytes()
    phrases = [raw[a:b] for a, b in zip(starts.tolist(), stop.tolist())]
    rank = {p: k + 1 for k, p in enumerate(sorted(set(phrases)))}
    fresh = np.r_[False, owner[1:] != owner[:-1]]
    spot = np.arange(len(starts)) + np.cumsum(fresh)  # a zero stands between segments
    symbols = np.zeros(spot[-1] + 2, dtype=np.int64)
    symbols[spot] = [rank[p] for p in phrases]
    phrase_at = np.full(len(symbols), -1, dtype=np.int64)
    phrase_at[spot] = np.arange(len(starts))
    order = phrase_at[suffix_array(symbols)]
    order = order[order >= 0]
    position = np.empty(len(starts), dtype=np.int64)
    position[order] = np.arange(len(order))
    left, right = starts[order[:-1]], starts[order[1:]]
    room = np.minimum(ends[segment[left]] - left, ends[segment[right]] - right)
    shared = np.r_[0, _common(buffer, left, right, room, window - gap)]
    # each window's first phrase start at least `gap` on: there the parse depends on the window alone
    tops = np.flatnonzero(places + window <= ends[segment])
    phrase = np.searchsorted(starts, tops + gap)
    offset = starts[phrase] - tops
    found = np.zeros(n, dtype=bool)
    by_offset = np.argsort(offset, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(offset[by_offset]) != 0, True])
    base = 0x9E3779B97F4A7C15
    values = _mix(buffer.astype(np.uint64) + np.uint64(1))
    running = np.zeros(n + 1, dtype=np.uint64)  # of bytes weighted by place: equal strings differ by a factor only
    running[1:] = np.cumsum(values[:n] * np.cumprod(np.full(n, base, dtype=np.uint64)))
    back = np.cumprod(np.full(n, pow(base, -1, 2**64), dtype=np.uint64))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        mine = by_offset[a:b]
        if len(mine) < 2:
            continue
        d = int(offset[mine[0]])
        block = np.cumsum(shared < window - d)[position[phrase[mine]]]
        top = tops[mine]
        before = (running[top + d] - running[top]) * back[top]
        sort = np.lexsort((before, block))
        block, top = block[sort], top[sort]
        alike = np.flatnonzero((block[1:] == block[:-1]) & (before[sort][1:] == before[sort][:-1]))
        left, right = top[alike], top[alike + 1]
        equal = _common(buffer, left, right, np.full(len(left), d), d) >= d if d else np.ones(len(left), dtype=bool)
        found[left[equal]] = True
        found[right[equal]] = True
        for of in np.unique(block[alike[~equal]]):  # strings of one hash that differ: tell them apart by their bytes
            own = top[block == of]
            seen: dict[bytes, int] = {}
            for p in own.tolist():
                first = seen.setdefault(raw[p : p + d], p)
                if first != p:
                    found[[first, p]] = True
    return [np.ones(c, dtype=bool) if m > 1 else found[p : p + c] for p, c, m in zip(begins.tolist(), counts.tolist(), copies)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def name_segments(texts: list[bytes], window: int = WINDOW, length: int = NAME_LENGTHS[0]) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, name, weight) of every segment of the texts; names are hashes of ``length`` bytes (32 times a power of two).

    The weight is 2 if the segment may hold equal windows itself, else 1.
    """
    texts_len = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(texts_len) - texts_len
    n = int(texts_len.sum())
    if n < window:
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    buffer = np.zeros(n + 8, dtype=np.uint8)
    buffer[:n] = np.frombuffer(b"".join(texts), dtype=np.uint8)
    eight = _mix(_words8(buffer))
    hashes = _mix(eight[: n - 31] + np.uint64(3) * eight[8 : n - 23] + np.uint64(5) * eight[16 : n - 15] + np.uint64(7) * eight[24 : n - 7])
    reach = 32
    while reach < length:
        hashes = _mix(hashes[:-reach] + np.uint64(2 * reach + 1) * hashes[reach:])
        reach *= 2
    span = window - length + 1
    least, width = hashes, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    owner = np.repeat(np.arange(len(texts)), texts_len)[: len(least)]
    valid = np.arange(len(least)) + window <= (begins + texts_len)[owner]
    change = np.r_[True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])]
    heads = np.flatnonzero(change)
    size = np.diff(np.r_[heads, len(least)])
    # the least hash stands twice in a run if a place that holds it enters or leaves while the run goes on
    leaves = (hashes[: len(least)] == least) & ~np.r_[change[1:], True]
    enters = (hashes[span - 1 :] == least) & ~change
    weight = 1 + np.logical_or.reduceat(leaves | enters, heads)[valid[heads]]
    heads, size = heads[valid[heads]], size[valid[heads]]
    parts = -(-size // RUN)  # very long runs (periodic text) in pieces
    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(heads, parts) + inner * RUN
    count = np.minimum(np.repeat(size, parts) - inner * RUN, RUN)
    return owner[first], first - begins[owner[first]], count, least[first], np.repeat(weight, parts)


def _chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    first, size = 0, 0
    for k, text in enumerate(texts):
        if k > first and size + len(text) > most:
            yield first, texts[first:k]
            first, size = k, 0
        size += len(text)
    if first < len(texts):
        yield first, texts[first:]


def _segments(docs: DataFrame, window: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, copies = batch.column(0), batch.column(1), batch.column(3)
            for start in range(0, batch.num_rows, 1024):
                texts = batch.column(2)[start : start + 1024].to_pylist()
                for k, part in _chunks(texts):
                    owner, first, count, name, weight = name_segments(part, window, length)
                    digest = b"".join(xxhash.xxh3_128_digest(part[o][p : p + c + window - 1]) for o, p, c in zip(owner.tolist(), first.tolist(), count.tolist()))
                    both = np.frombuffer(digest, dtype=np.int64).reshape(-1, 2)
                    rows = pa.array(owner + k + start)
                    yield pa.RecordBatch.from_pydict(
                        {"name": pa.array(name.view(np.int64)), "d1": pa.array(both[:, 0]), "d2": pa.array(both[:, 1]), "doc": ids.take(rows), "key": keys.take(rows), "first": pa.array(first.astype(np.int32)), "n": pa.array(count.astype(np.int32)), "weight": pa.array(weight.astype(np.int32)), "copies": copies.take(rows)}
                    )

    return docs.mapInArrow(run, "name long, d1 long, d2 long, doc long, key long, first int, n int, weight int, copies long")


def _sort_groups(rows: DataFrame, window: int) -> DataFrame:
    """Marked windows of distinct segments: rows of one name arrive together."""
    schema = "name long, d1 long, d2 long, marks array<struct<a:int,b:int>>"
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[int, bytes]] = {}
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            keys = list(held)
            found = repeated_windows([held[k][1] for k in keys], [held[k][0] for k in keys], window)
            out = [(k, r) for k, f in zip(keys, found) if (r := _runs(f))]
            held.clear()
            return pa.RecordBatch.from_pydict(
                {"name": pa.array([k[0] for k, _ in out], pa.int64()), "d1": pa.array([k[1] for k, _ in out], pa.int64()), "d2": pa.array([k[2] for k, _ in out], pa.int64()), "marks": pa.array([[{"a": a, "b": b} for a, b in r] for _, r in out], kind)}
            )

        for batch in batches:
            for name, d1, d2, copies, body in zip(*(batch.column(c).to_pylist() for c in ("name", "d1", "d2", "copies", "body"))):
                if name != last and size >= CHUNK:
                    yield flush()
                    size = 0
                last = name
                if (name, d1, d2) not in held:  # a document that stands twice in the table sends a segment twice
                    held[name, d1, d2] = (copies, body)
                    size += len(body)
        if held:
            yield flush()

    return rows.repartition("name").sortWithinPartitions("name", "d1", "d2").mapInArrow(run, schema)


def _bodies(wanted: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """The bytes of wanted segments, cut from the document named for each."""
    per_doc = wanted.groupBy("doc", "key").agg(F.collect_list(F.struct("name", "d1", "d2", "copies", "first", "n")).alias("segments"))
    joined = docs.join(per_doc, ["doc", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                rows = [(s["name"], s["d1"], s["d2"], s["copies"], t[s["first"] : s["first"] + s["n"] + window - 1]) for t, own in zip(part.column("text").to_pylist(), part.column("segments").to_pylist()) for s in own]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_pydict({c: pa.array(v, k) for c, v, k in zip(("name", "d1", "d2", "copies", "body"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))})

    return joined.select("text", "segments").mapInArrow(run, "name long, d1 long, d2 long, copies long, body binary")


def _single_windows(bodies: DataFrame, window: int) -> DataFrame:
    """Marked windows of hot names, each window met by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, d1, d2, copies, body in zip(*(batch.column(c).to_pylist() for c in ("name", "d1", "d2", "copies", "body"))):
                count = len(body) - window + 1
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(body[k : k + window]) for k in range(count)), dtype=np.int64).reshape(-1, 2)
                same = lambda v: pa.array(np.full(count, v, dtype=np.int64))
                yield pa.RecordBatch.from_pydict({"w1": pa.array(digests[:, 0]), "w2": pa.array(digests[:, 1]), "name": same(name), "d1": same(d1), "d2": same(d2), "at": pa.array(np.arange(count, dtype=np.int32)), "copies": same(copies)})

    windows = bodies.dropDuplicates(["name", "d1", "d2"]).mapInArrow(run, "w1 long, w2 long, name long, d1 long, d2 long, at int, copies long")
    twice = windows.groupBy("w1", "w2").agg(F.sum("copies").alias("all")).where("all > 1").select("w1", "w2")
    marked = windows.join(twice, ["w1", "w2"]).groupBy("name", "d1", "d2").agg(F.sort_array(F.collect_list("at")).alias("at"))
    return _merged(marked.select("name", "d1", "d2", F.transform("at", lambda k: F.struct(k.alias("a"), (k + 1).alias("b"))).alias("marks")))


def _merged(marked: DataFrame) -> DataFrame:
    """``marked`` (name, d1, d2, marks) with overlapping and touching marks in one."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(3)
            flat = marks.flatten()
            a, b = flat.field("a").to_numpy(), flat.field("b").to_numpy()
            ends = np.cumsum(pc.list_value_length(marks).to_numpy())
            merged = [merge_ranges(a[p:q], b[p:q]) for p, q in zip([0, *ends[:-1].tolist()], ends.tolist())]
            counts = np.cumsum([0, *(len(x) for x, _ in merged)])
            both = [np.concatenate([np.zeros(0, np.int32), *side]).astype(np.int32) for side in zip(*merged)] if merged else [np.zeros(0, np.int32)] * 2
            rows = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays([pa.array(v) for v in both], ["a", "b"]))
            yield pa.RecordBatch.from_pydict({"name": batch.column(0), "d1": batch.column(1), "d2": batch.column(2), "marks": rows.cast(kind)})

    return marked.mapInArrow(run, "name long, d1 long, d2 long, marks array<struct<a:int,b:int>>")


def repeated_marks(docs: DataFrame, window: int, name_bytes: int, level: int = 0) -> DataFrame:
    """(doc, key, spans): for each document the runs of windows that repeat.  ``docs``: doc, key, text (binary) and copies."""
    lengths = [n for n in NAME_LENGTHS if n <= window]
    segments = checkpointed(_segments(docs.select("doc", "key", "text", "copies"), window, lengths[level]))
    names = segments.groupBy("name").agg(F.sum(F.col("weight") * F.col("copies")).alias("all")).where("all > 1").withColumn("met", F.lit(True))
    shared = checkpointed(join_by_frequency(segments.drop("weight"), names, ["name"], "all").drop("met"))
    distinct = shared.groupBy("name", "d1", "d2").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("doc", "key", "first", "n")).alias("one"))
    kinds = distinct.groupBy("name").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("one.n") + window - 1).alias("bytes"))
    sized = checkpointed(join_by_frequency(distinct, kinds.withColumn("weight", F.col("kinds")), ["name"], "weight").select("name", "d1", "d2", "copies", "rows", "kinds", "bytes", "one.*"))
    whole = sized.where("kinds = 1 and copies > 1").select("name", "d1", "d2", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("marks"))
    open_ = sized.where("kinds > 1 or copies = 1")
    marks = whole.unionByName(_sort_groups(_bodies(open_.where(F.col("bytes") <= name_bytes), docs, window), window))
    large = open_.where(F.col("bytes") > name_bytes)
    if large.limit(1).count():
        bodies = _bodies(large, docs, window)
        if level + 1 < len(lengths):
            parents = checkpointed(bodies.dropDuplicates(["name", "d1", "d2"]))
            inner = repeated_marks(parents.select(F.col("d1").alias("doc"), F.col("d2").alias("key"), F.col("body").alias("text"), "copies"), window, name_bytes, level + 1)
            moved = F.flatten(F.transform("spans", lambda s: F.transform(s["marks"], lambda m: F.struct((s["first"] + m["a"]).alias("a"), (s["first"] + m["b"]).alias("b")))))
            back = inner.select(F.col("doc").alias("d1"), F.col("key").alias("d2"), moved.alias("marks"))
            marks = marks.unionByName(_merged(parents.select("name", "d1", "d2").join(back, ["d1", "d2"]).select("name", "d1", "d2", "marks")))
        else:
            marks = marks.unionByName(_single_windows(bodies, window))
    keys, places = ["name", "d1", "d2"], shared.select("name", "d1", "d2", "doc", "key", "first")
    if (sized.agg(F.max("rows").alias("most")).first().most or 0) > COPY_ROWS:
        placed = join_by_frequency(places, marks.join(sized.select(*keys, "rows"), keys), keys, "rows", keep_keys=False)
    else:
        placed = places.join(marks, keys)
    return placed.groupBy("doc", "key").agg(F.collect_list(F.struct("first", "marks")).alias("spans"))


def merge_ranges(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges in order, with overlapping and touching ones in one."""
    order = np.argsort(begins, kind="stable")
    begins, reach = begins[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    fresh = np.flatnonzero(np.r_[True, begins[1:] > reach[:-1]]) if len(begins) else np.zeros(0, dtype=np.int64)
    return begins[fresh], reach[np.r_[fresh[1:] - 1, len(reach) - 1]] if len(fresh) else reach


def _cut(text: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """(bytes kept, bytes removed, maximal removed runs)."""
    if not len(begins):
        return text, 0, 0
    begins, ends = merge_ranges(begins, ends)
    kept, at = [], 0
    for a, b in zip(begins.tolist(), ends.tolist()):
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), int((ends - begins).sum()), len(begins)


def _ranges(spans: pa.ListArray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of all rows one after another, and where each row's end."""
    inner = spans.flatten()
    marks = inner.field("marks")
    counts = pc.list_value_length(marks).to_numpy(zero_copy_only=False)
    flat, first = marks.flatten(), np.repeat(inner.field("first").to_numpy(), counts)
    per_span = np.r_[0, np.cumsum(counts)]
    per_row = np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
    return first + flat.field("a").to_numpy(), first + flat.field("b").to_numpy() + window - 1, per_span[per_row]


def deduplicate_substrings(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, name_bytes: int = NAME_BYTES, with_kept: bool = True) -> DataFrame:
    """A row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 and (if ``with_kept``) kept, the remaining bytes."""
    if window < NAME_LENGTHS[0]:
        raise ValueError(f"windows have at least {NAME_LENGTHS[0]} bytes")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    nameless, doc = document_key(frame, id_col, text)
    docs = frame.select(F.col(f"`{id_col}`").alias("id"), doc, F.xxhash64(text, nameless).alias("key"), text.cast("binary").alias("text"), F.lit(1).cast("long").alias("copies"))
    spans = repeated_marks(docs, window, name_bytes)
    joined = docs.join(spans, ["doc", "key"], "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column(1).to_pylist()
                begins, ends, stops = _ranges(part.column(2), window)
                rows = [_cut(t, begins[p:q], ends[p:q]) for t, p, q in zip(texts, [0, *stops[:-1].tolist()], stops.tolist())]
                columns = {
                    id_col: part.column(0),
                    "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                    "n_removed": pa.array([r[1] for r in rows], pa.int64()),
                    "n_spans": pa.array([r[2] for r in rows], pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string()),
                }
                if with_kept:
                    columns["kept"] = pa.array([r[0] for r in rows], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["id"].dataType.simpleString()
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_kept else ""))
