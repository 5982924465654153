"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's terms are counted over all documents.
2. A randomised SVD of TF-IDF passages (all benchmark pieces and all passages of
   the corpus) gives the latent space.  The passages enter by their Gram matrix
   A^T A, which the executors add up in one pass; blocks of it meet by name, and
   what a group needs of them by group, where its space is fitted: the driver
   never holds a matrix of terms by terms.
   Groups of at most ``GROUP_PIECES`` pieces have a space each, so its rank
   follows the benchmark and every piece keeps (nearly) its whole norm.
   The same pass numbers the words of every document, from which 3. and 4. are
   answered (``decontaminate``; ``drop_contaminated`` reads the texts again).
3. Every window of every document is a candidate for the benchmark pieces whose
   latent cosine reaches ``min_cosine``.  A window whose terms cannot add up
   to it for any piece is skipped before the projection.
4. A candidate is a leak if the longest common subsequence with the piece covers
   ``min_lcs`` of its words, or covers ``min_paraphrase`` of them while nearly all
   of the piece's answer terms (its rarest ones) stand in the window.

Counts, Gram matrix, windows and checks cover all documents.  Windows are cut
by word offset, so a hot source or group of copies loads no single task.  What is
broadcast belongs to at most ``PASS_PIECES`` pieces (their terms and latent spaces,
some 40 MB); a larger benchmark is taken in blocks of items, one pass over the
documents each.  All its terms count.

Contract for odd input: null text and null benchmark items have no words and
never match; items of fewer than ``MIN_WORDS`` words are looked up as exact word
sequences, without retrieval; several items may match a document (all ids are
returned, in order); repeated rows are judged alike; an empty benchmark finds
nothing and an empty table gives an empty result; other columns are ignored
(``decontaminate``) or kept, whatever their names (``drop_contaminated``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby, repeat
from operator import itemgetter
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import checkpointed

_WORD = re.compile(r"\w+")
_ASCII_GAPS = {k: " " for k in range(128) if not (chr(k).isalnum() or k == ord("_"))}
#: Different characters between words that are replaced one by one; with more, the pattern is quicker.
MOST_GAPS = 64
#: Pieces that share a latent space, and its rank, which leaves room for the corpus beside them.
GROUP_PIECES = 96
#: Pieces that one pass over the documents looks for.
PASS_PIECES = 2_048
RANK, OVERSAMPLE, POWER_ROUNDS = 128, 16, 2
#: Terms of one Gram matrix (of more, groups of pieces take turns), documents of a task that adds one up, and such tasks at most.
GRAM_TERMS, GRAM_DOCUMENTS, GRAM_TASKS = 4_096, 20_000, 64
#: Words that are packed at a time.
PACK_WORDS = 1_000_000
#: Weight of the corpus in the SVD, against the benchmark's pieces.
CORPUS_SHARE = 0.25
#: Words of a benchmark piece; windows of a document are twice as long at most.
PIECE_WORDS = 40
MIN_WORDS = 5
MIN_COSINE = 0.2
MIN_LCS, MIN_PARAPHRASE, MIN_ANSWER = 0.6, 0.4, 0.8
ANSWER_TERMS = 5
TERM_BLOCK = 256
#: Neighbouring windows that are checked together first, and words whose windows are sifted at once.
TOGETHER, TOGETHER_WORDS = 5, 100_000


def words_of(text: str) -> list[str]:
    """``_WORD`` in the text in lower case; its characters are those of ``isalnum`` and the underscore."""
    text = text.lower()
    if text.isascii():
        return text.translate(_ASCII_GAPS).split()
    gaps = [c for c in set(text) if not (c.isalnum() or c == "_")]
    if len(gaps) > MOST_GAPS:
        return _WORD.findall(text)
    for c in gaps:
        text = text.replace(c, " ")
    return text.split()


def numbers_of(text: str, terms: dict[str, int]) -> np.ndarray:
    """The number of each word of a text; words that are no terms have the one after the terms'."""
    words = words_of(text)
    return np.fromiter(map(terms.get, words, repeat(len(terms))), np.int32, len(words))


def number_type(terms: dict[str, int]) -> type:
    return np.uint16 if len(terms) < 1 << 16 else np.uint32


def pieces_of(words: list[str], size: int = PIECE_WORDS) -> list[list[str]]:
    """Near-equal pieces of at most ``size`` words."""
    parts = max(1, -(-len(words) // size))
    edges = [round(k * len(words) / parts) for k in range(parts + 1)]
    return [words[a:b] for a, b in zip(edges, edges[1:]) if b > a]


def lcs_length(masks: dict[Any, int], size: int, words: list, least: float = 0) -> int:
    """Longest common subsequence with a piece given as bit masks of its words' places (0 if surely below ``least``)."""
    return _lcs_of_hits([masks[w] for w in words if w in masks], size, least)


def _lcs_of_hits(hits: list[int], size: int, least: float) -> int:
    if len(hits) < least:
        return 0
    full = (1 << size) - 1
    state = full
    for m in hits:
        hit = state & m
        state = ((state + hit) | (state - hit)) & full
    return size - state.bit_count()


@dataclass
class Piece:
    item: int
    words: list[str]
    masks: dict[str, int] = field(default_factory=dict)
    answer: frozenset[str] = frozenset()


@dataclass
class Space:
    """The latent space of a group of pieces of one scale, folded: what a term adds to the score of each piece.

    Scores are products of latent vectors, over the norm that the piece's own keeps, so they estimate full cosines.
    """

    size: int
    members: np.ndarray
    #: Row of each of the detector's terms here; the last row is that of all other words.
    local: np.ndarray
    folded: np.ndarray
    #: Words and answer terms of each piece, and which rows of the space are words and answer terms of it.
    lengths: np.ndarray
    answers: np.ndarray
    holds: np.ndarray
    answer_holds: np.ndarray
    #: Places of the words of each piece as bit masks, by their rows here.
    masks: list[dict[int, int]]

    def __post_init__(self):
        #: The most that each term adds to the score of any piece.
        self.peaks = np.append(self.folded.max(axis=1).clip(0), 0.0)

    def sums(self, ids: np.ndarray, tops: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sums of the rows of the known words from each top to its end."""
        none = len(self.folded)
        at = tops[:, None] + np.arange(int((ends - tops).max()))
        known = np.where(at < ends[:, None], ids[np.minimum(at, len(ids) - 1)], none)
        rows, cols = np.nonzero(known < none)
        out = np.zeros((len(tops), self.folded.shape[1]), dtype=np.float32)
        if len(rows):
            edges = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            out[rows[edges]] = np.add.reduceat(self.folded[known[rows, cols]], edges, axis=0)
        return out

    @staticmethod
    def shared_words(holds: np.ndarray, ids: np.ndarray, pieces: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words of each stretch from a to b its piece holds."""
        used, row = np.unique(pieces, return_inverse=True)
        low, high = int(a.min()), int(b.max())
        counts = np.zeros((len(used), high - low + 1), dtype=np.int32)
        np.cumsum(holds[used][:, ids[low:high]], axis=1, out=counts[:, 1:])
        return counts[row, b - low] - counts[row, a - low]

    def window_sums(self, ids: np.ndarray, chosen: np.ndarray, stride: int, width: int) -> np.ndarray:
        """Sums over the windows of ``width`` words that begin at ``chosen`` strides; a stride is summed once for all its windows."""
        n, full = len(ids), width // stride
        strides = np.unique(chosen[:, None] + np.arange(full))
        strides = strides[strides * stride < n]
        parts = np.vstack((self.sums(ids, strides * stride, np.minimum(strides * stride + stride, n)), np.zeros((1, self.folded.shape[1]), dtype=np.float32)))
        out = np.zeros((len(chosen), parts.shape[1]), dtype=np.float32)
        for k in range(full):
            out += parts[np.searchsorted(strides, chosen + k)]
        if width > full * stride:
            tops = np.minimum((chosen + full) * stride, n)
            out += self.sums(ids, tops, np.minimum(tops + width - full * stride, n))
        return out


@dataclass
class Detector:
    """What is broadcast: terms, their weights, the pieces and the latent spaces of their groups."""

    terms: dict[str, int]
    idf: np.ndarray
    unknown: float
    pieces: list[Piece]
    spaces: list[Space]
    thresholds: dict[str, float]

    def __post_init__(self):
        self.cost = np.append(self.idf, self.unknown) ** 2
        #: Terms by their numbers; the number after theirs stands for all other words.
        self.names = [*self.terms, ""]
        #: Pieces too short for retrieval, by their first word.
        self.short: dict[str, list[Piece]] = {}
        for piece in self.pieces:
            if len(piece.words) < MIN_WORDS:
                self.short.setdefault(piece.words[0], []).append(piece)

    def find(self, text: str) -> list[tuple[int, float]]:
        """(item, share of the best common subsequence) of every leak, in order of items."""
        return self.find_numbers(numbers_of(text, self.terms))

    def find_numbers(self, ids: np.ndarray) -> list[tuple[int, float]]:
        """``find``, for the numbers of a text's words."""
        return self.find_each([ids])[0]

    def find_each(self, texts: list[np.ndarray]) -> list[list[tuple[int, float]]]:
        """``find_numbers`` of each text; some ``TOGETHER_WORDS`` words are sifted at once."""
        out: list[list[tuple[int, float]]] = []
        ends = np.cumsum([len(x) for x in texts])
        top = 0
        while top < len(texts):
            last = max(top + 1, int(np.searchsorted(ends, (ends[top - 1] if top else 0) + TOGETHER_WORDS, "right")))
            out += self._find_some(texts[top:last])
            top = last
        return out

    def _find_some(self, texts: list[np.ndarray]) -> list[list[tuple[int, float]]]:
        lengths = np.array([len(x) for x in texts])
        best: list[dict[int, float]] = [{} for _ in texts]
        if not lengths.sum() or not self.pieces:
            return [[] for _ in texts]
        if self.short:
            for ids, leaks in zip(texts, best):
                words = self._words(ids)
                for at in [k for k, w in enumerate(words) if w in self.short]:
                    leaks.update((piece.item, 1.0) for piece in self.short[words[at]] if words[at : at + len(piece.words)] == piece.words)
        ids = np.concatenate(texts)
        bases = np.cumsum(lengths) - lengths
        weights = self.cost[ids]
        whole = np.concatenate(([0.0], np.cumsum(weights)))
        bound = self.thresholds["cosine"]
        for space in self.spaces:
            size = space.size
            own = space.local[ids]
            peaks = np.concatenate(([0.0], np.cumsum(space.peaks[own])))
            width, stride = size + size // 3, max(2, size // 3)
            windows = np.where(lengths > 0, -(-np.maximum(1, lengths - width + stride) // stride), 0)
            text = np.repeat(np.arange(len(texts)), windows)
            place = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
            tops = bases[text] + place * stride
            ends = np.minimum(tops + width, (bases + lengths)[text])
            # no piece's score exceeds the sum of its terms' peaks
            likely = np.flatnonzero((peaks[ends] - peaks[tops]) * 1.001 >= bound * np.sqrt(whole[ends] - whole[tops]))
            for some in np.split(likely, np.flatnonzero(np.diff(text[likely])) + 1) if len(likely) else ():
                k = text[some[0]]
                base, end = bases[k], bases[k] + lengths[k]
                mass = np.concatenate(([0.0], np.cumsum(weights[base:end])))
                self._search(space, own[base:end], mass, place[some], width, stride, best[k])
        return [sorted(leaks.items()) for leaks in best]

    def _search(self, space: Space, own: np.ndarray, whole: np.ndarray, likely: np.ndarray, width: int, stride: int, best: dict[int, float]) -> None:
        """Adds the leaks of a space's pieces in the ``likely`` windows of a text to ``best``."""
        n, size, bound = len(own), space.size, self.thresholds["cosine"]
        for top in range(0, len(likely), 512):
            chosen = likely[top : top + 512]
            tops = chosen * stride
            ends = np.minimum(tops + width, n)
            scores = space.window_sums(own, chosen, stride, width) / np.sqrt(np.maximum(whole[ends] - whole[tops], 1e-12))[:, None]
            w, p = np.nonzero(scores >= bound)
            if not len(w):
                continue
            # with half a window on either side; a common subsequence has no more words than the window shares,
            # and below min_lcs the answer terms must be there
            a, b = np.maximum(tops[w] - size // 2, 0), np.minimum(ends[w] + size // 2, n)
            shares = space.shared_words(space.holds, own, p, a, b) / space.lengths[p]
            answers = space.shared_words(space.answer_holds, own, p, a, b) >= self.thresholds["answer"] * space.answers[p]
            found = np.flatnonzero((shares >= self.thresholds["lcs"]) | (shares >= self.thresholds["paraphrase"]) & answers)
            if not len(found):
                continue
            found = found[np.lexsort((w[found], p[found]))]
            # neighbours of one piece: what fails on all of a stretch fails on every part of it
            fresh = np.r_[True, (np.diff(p[found]) != 0) | (np.diff(chosen[w[found]]) != 1)]
            place = np.arange(len(found)) - np.maximum.accumulate(np.where(fresh, np.arange(len(found)), 0))
            for part in np.split(found, np.flatnonzero(place % TOGETHER == 0)[1:]):
                row = int(p[part[0]])
                if len(part) > 1 and not self._verify_numbers(space, row, own[a[part[0]] : b[part[-1]]]):
                    continue
                share = max(self._verify_numbers(space, row, own[a[k] : b[k]]) for k in part)
                item = self.pieces[space.members[row]].item
                if share > best.get(item, 0.0):
                    best[item] = share

    def _words(self, ids: np.ndarray) -> list[str]:
        return list(map(self.names.__getitem__, ids.tolist()))

    def _verify(self, piece: Piece, words: list[str]) -> float:
        size = len(piece.words)
        return self._judged(lcs_length(piece.masks, size, words, self.thresholds["paraphrase"] * size) / size, lambda: len(piece.answer.intersection(words)), len(piece.answer))

    def _verify_numbers(self, space: Space, row: int, own: np.ndarray) -> float:
        """``_verify``, of the piece in a row of a space and the space's rows of a stretch's words."""
        size, masks = int(space.lengths[row]), space.masks[row]
        hits = [masks[w] for w in own[space.holds[row][own]].tolist()]
        return self._judged(_lcs_of_hits(hits, size, self.thresholds["paraphrase"] * size) / size, lambda: len(np.unique(own[space.answer_holds[row][own]])), int(space.answers[row]))

    def _judged(self, share: float, answers_held: Callable[[], int], answers: int) -> float:
        if share >= self.thresholds["lcs"]:
            return share
        if share >= self.thresholds["paraphrase"] and answers and answers_held() >= self.thresholds["answer"] * answers:
            return share
        return 0.0

    def column(self, text: Column) -> Column:
        """array<struct<item_id, share>> of the leaks in a text column."""
        return self._found(F.coalesce(text, F.lit("")), lambda detector, t: numbers_of(t, detector.terms))

    def numbers_column(self, numbers: Column) -> Column:
        """``column``, for a column of packed numbers (``_scan``)."""
        return self._found(numbers, lambda detector, x: np.frombuffer(x, dtype=number_type(detector.terms)).astype(np.int32))

    def _found(self, column: Column, numbers: Callable[[Detector, Any], np.ndarray]) -> Column:
        shared = (SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()).sparkContext.broadcast(self)

        @F.pandas_udf("array<struct<item_id:long,share:double>>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            detector = shared.value
            for batch in batches:
                found: list[list[tuple[int, float]]] = []
                held: list[np.ndarray] = []
                words_held = 0
                for x in batch:
                    held.append(numbers(detector, x))
                    words_held += len(held[-1])
                    if words_held > TOGETHER_WORDS:
                        found += detector.find_each(held)
                        held, words_held = [], 0
                found += detector.find_each(held)
                yield pd.Series([[{"item_id": i, "share": s} for i, s in leaks] for leaks in found])

        return run(column)


def _scan(texts: DataFrame, terms: dict[str, int]) -> DataFrame:
    """Documents with each term (term, n; term -1: all documents, -2: passages with a term), and packed passages, of every text.

    A packed row holds passages one after another: how many terms each has, its terms in order, and how often each stands in it.
    ``texts`` has the text first; if more columns follow, each document has a row of them and of the numbers of its words.
    """
    carried = texts.columns[1:]
    kinds = StructType.fromDDL("term int, n long, sizes binary, terms binary, tf binary, numbers binary").fields + [StructField(c, texts.schema[c].dataType) for c in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, packed_type = len(terms), number_type(terms)
        counts, rows, passages = np.zeros(none + 1, dtype=np.int64), 0, 0
        held: list[np.ndarray] = []
        empty: dict[str, pa.DataType] = {"term": pa.int32(), "n": pa.int64()} | dict.fromkeys(("sizes", "terms", "tf", "numbers"), pa.binary())

        def filled(n: int, columns: dict[str, Any]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({c: pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in empty.items()})

        def pack() -> tuple[int, pa.RecordBatch]:
            lengths = np.array([-(-len(x) // PIECE_WORDS) for x in held])
            begins = np.cumsum(lengths) - lengths
            cells = np.concatenate([(begin + np.arange(len(x)) // PIECE_WORDS) * none + x for begin, x in zip(begins.tolist(), held)])
            cell, tf = np.unique(cells[np.concatenate(held) < none], return_counts=True)
            sizes = np.bincount(cell // none)
            sizes = sizes[sizes > 0]
            held.clear()
            return len(sizes), filled(1, {"sizes": [sizes.astype(np.uint8).tobytes()], "terms": [(cell % none).astype(np.uint32).tobytes()], "tf": [tf.astype(np.uint8).tobytes()]})

        words_held = 0
        for batch in batches:
            rows += batch.num_rows
            empty |= {c: batch.column(1 + k).type for k, c in enumerate(carried)}
            numbers: list[bytes] = []
            for text in batch.column(0):
                ids = numbers_of(text.as_py(), terms)
                counts[np.unique(ids)] += 1
                held.append(ids)
                words_held += len(ids)
                if carried:
                    numbers.append(ids.astype(packed_type).tobytes())
                if words_held > PACK_WORDS:
                    found, packed = pack()
                    passages, words_held = passages + found, 0
                    yield packed
            if carried:
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(numbers), kind) for kind in list(empty.values())[:5]), pa.array(numbers, pa.binary()), *batch.columns[1:]], names=list(empty))
        if held:
            found, packed = pack()
            passages += found
            yield packed
        own = np.flatnonzero(counts[:-1])
        if rows:  # else the types of the carried columns are not known here
            yield filled(len(own) + 2, {"term": [-1, -2, *own.tolist()], "n": [rows, passages, *counts[own].tolist()]})

    return texts.mapInArrow(run, StructType(kinds))


def _document_counts(scanned: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(documents, passages with a term, documents with each term), over all documents."""
    out = np.zeros(n_terms + 2, dtype=np.int64)
    for row in scanned.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each benchmark term
        out[row.term] = row.n
    return int(out[-1]), int(out[-2]), out[:-2]


def _gram(packed: DataFrame, idf: np.ndarray, own: np.ndarray, places: list[np.ndarray], tasks: int) -> DataFrame:
    """(space, top, part): rows of A^T A, from place ``top`` on, of the terms ``own[places[space]]`` over the unit TF-IDF rows of all passages.

    Added up on the executors; parts begin at the diagonal, and parts of zeros are left out.
    """
    shared = packed.sparkSession.sparkContext.broadcast((idf, own, places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, own, _ = shared.value
        size = len(own)
        local = np.full(len(idf), -1)
        local[own] = np.arange(size)
        total = np.zeros(size * size)
        for batch in batches:
            for sizes, terms, tf in zip(*(c.to_pylist() for c in batch.columns)):
                sizes, terms = np.frombuffer(sizes, dtype=np.uint8), np.frombuffer(terms, dtype=np.uint32)
                row = np.repeat(np.arange(len(sizes)), sizes)
                value = np.frombuffer(tf, dtype=np.uint8) * idf[terms]
                value = value / np.sqrt(np.maximum(np.bincount(row, value**2), 1e-24))[row]
                place = local[terms]
                here = np.flatnonzero(place >= 0)
                row, place, value = row[here], place[here], value[here]
                counts = np.bincount(row)
                begins = np.cumsum(counts) - counts
                for length in np.unique(counts[counts > 0]).tolist():  # passages of as many terms at a time, every two terms of each
                    one, two = np.triu_indices(length)
                    tops = begins[counts == length]
                    for k in range(0, len(tops), 2_048):
                        at = tops[k : k + 2_048, None] + np.arange(length)
                        ids, own_values = place[at], value[at]
                        np.add.at(total, (ids[:, one] * size + ids[:, two]).ravel(), (own_values[:, one] * own_values[:, two]).ravel())
        total = total.reshape(size, size)
        for k in range(0, size, TERM_BLOCK):
            if (part := total[k : k + TERM_BLOCK, k:]).any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "part": pa.array([part.tobytes()], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, own, places = shared.value
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(part.as_py())
                sums[block] = sums[block] + part if block in sums else part
        for block, part in sums.items():
            part = part.reshape(-1, len(own) - block)
            for space, at in enumerate(places):
                top, end = np.searchsorted(at, (block, block + TERM_BLOCK)).tolist()
                if (rows := part[np.ix_(at[top:end] - block, at[top:] - block)]).any():
                    yield pa.RecordBatch.from_pydict({"space": pa.array([space], pa.int32()), "top": pa.array([top], pa.int32()), "part": pa.array([rows.tobytes()], pa.binary())})

    return packed.coalesce(tasks).mapInArrow(run, "block int, part binary").repartition("block").mapInArrow(merge, "space int, top int, part binary")


def _folded(parts: Iterator[tuple[int, bytes]], idf: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], share: float, rank: int, state: dict) -> np.ndarray:
    """What each term of a group adds to the score of each of its pieces (``rows``: places and values), by the randomised SVD of the pieces and ``share`` times the corpus."""
    n = len(idf)
    corpus = None
    for top, part in parts:
        corpus = np.zeros((n, n)) if corpus is None else corpus
        part = np.frombuffer(part).reshape(-1, n - top)
        corpus[top : top + len(part), top:] = part
    for k in range(0, 0 if corpus is None else n, TERM_BLOCK):  # the lower triangle, in place
        square = corpus[k : k + TERM_BLOCK, k : k + TERM_BLOCK]
        square[:] = np.triu(square) + np.triu(square, 1).T
        corpus[k + TERM_BLOCK :, k : k + TERM_BLOCK] = corpus[k : k + TERM_BLOCK, k + TERM_BLOCK :].T

    def product(x: np.ndarray) -> np.ndarray:
        own = _item_product(rows, x)
        return own if corpus is None else share * (corpus @ x) + own

    rng = np.random.default_rng()
    rng.bit_generator.state = state
    basis = np.linalg.qr(_item_product(rows, rng.standard_normal((n, min(rank + OVERSAMPLE, n)))))[0]
    for _ in range(POWER_ROUNDS):
        basis = np.linalg.qr(product(basis))[0]
    image = product(basis)
    small = basis.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    basis = basis @ turn[:, np.argsort(-values)[:rank]]
    vectors = np.stack([row @ basis[k] for k, row in rows])
    vectors /= np.maximum((vectors**2).sum(axis=1, keepdims=True), 1e-12)
    return ((basis * idf[:, None]) @ vectors.T).astype(np.float32)


def _spaces(packed: DataFrame, idf: np.ndarray, chosen: list[np.ndarray], rows: list[list[tuple[np.ndarray, np.ndarray]]], passages: int, rank: int, tasks: int) -> Iterator[np.ndarray]:
    """``_folded`` of each group (of the terms ``chosen``), fitted on the executors; groups of at most ``GRAM_TERMS`` terms together share a pass."""
    context = packed.sparkSession.sparkContext
    rng = np.random.default_rng(7)
    starts = []
    for ids in chosen:  # one sequence of draws for all groups, wherever they are fitted
        starts.append(rng.bit_generator.state)
        rng.standard_normal((len(ids), min(rank + OVERSAMPLE, len(ids))))
    fits = [(idf[ids], r, CORPUS_SHARE * len(r) / max(1, passages), rank, state) for ids, r, state in zip(chosen, rows, starts)]
    k = 0
    while k < len(chosen):
        own, last = chosen[k], k + 1
        while last < len(chosen) and len(more := np.union1d(own, chosen[last])) <= GRAM_TERMS:
            own, last = more, last + 1
        shared = context.broadcast(fits[k:last])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            parts = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (x.as_py() for x in batch.column(2))))
            for space, group in groupby(parts, itemgetter(0)):
                folded = _folded((row[1:] for row in group), *shared.value[space])
                yield pa.RecordBatch.from_pydict({"space": pa.array([space], pa.int32()), "folded": pa.array([folded.tobytes()], pa.binary())})

        places = [np.searchsorted(own, ids) for ids in chosen[k:last]]
        parts = _gram(packed, idf, own, places, tasks).repartition("space").sortWithinPartitions("space")
        found = {row.space: np.frombuffer(row.folded, dtype=np.float32) for row in parts.mapInArrow(run, "space int, folded binary").toLocalIterator()}
        for space, ids in enumerate(chosen[k:last]):
            # no passage holds any of the group's terms: the pieces alone span its space
            yield found[space].reshape(len(ids), -1) if space in found else _folded(iter(()), *fits[k + space])
        k = last


def _item_product(rows: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape)
    for k, row in rows:
        out[k] += np.outer(row, row @ x[k])
    return out


def _groups(pieces: list[Piece], most: int = GROUP_PIECES) -> list[tuple[int, list[int]]]:
    """(scale, pieces) of groups of at most ``most`` pieces of one scale."""
    by_size: dict[int, list[int]] = {}
    for k, p in enumerate(pieces):
        if len(p.words) < MIN_WORDS:
            continue
        size = next(s for s in (8, 12, 18, 27, PIECE_WORDS) if len(p.words) <= s or s == PIECE_WORDS)
        by_size.setdefault(size, []).append(k)
    return [(s, ks[a : a + most]) for s, ks in by_size.items() for a in range(0, len(ks), most)]


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", most: int = PASS_PIECES) -> Iterator[list[Piece]]:
    """Pieces of whole items, at most ``most`` at a time (a longer item is a block of its own)."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.coalesce(F.col(f"`{item_text_col}`"), F.lit("")).alias("text")).where("item is not null").orderBy("item", "text")
    block: list[Piece] = []
    for row in items.toLocalIterator():
        own = [Piece(row.item, p) for p in pieces_of(words_of(row.text))]
        if block and len(block) + len(own) > most:
            yield block
            block = []
        block += own
    if block:
        yield block


def _terms(pieces: list[Piece]) -> dict[str, int]:
    return {w: k for k, w in enumerate(sorted({w for p in pieces for w in p.words}))}


def fit(frame: DataFrame, pieces: list[Piece], id_col: str = "doc_id", text_col: str = "text", **options) -> Detector:
    """Counts and latent spaces for a block of pieces, against the documents of ``frame``."""
    terms = _terms(pieces)
    return _fit(checkpointed(_scan(frame.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")), terms)), terms, pieces, **options)


def _fit(scanned: DataFrame, terms: dict[str, int], pieces: list[Piece], rank: int = RANK, min_cosine: float = MIN_COSINE, min_lcs: float = MIN_LCS, min_paraphrase: float = MIN_PARAPHRASE, min_answer: float = MIN_ANSWER) -> Detector:
    limits = {"cosine": min_cosine, "lcs": min_lcs, "paraphrase": min_paraphrase, "answer": min_answer}
    if not terms:
        return Detector({}, np.zeros(0), 1.0, [], [], limits)
    documents, passages, counts = _document_counts(scanned, len(terms))
    idf = np.log((documents + 2) / (counts + 1))
    for p in pieces:
        for i, w in enumerate(p.words):
            p.masks[w] = p.masks.get(w, 0) | 1 << i
        p.answer = frozenset(sorted(set(p.words), key=lambda w: (-idf[terms[w]], w))[:ANSWER_TERMS])
    packed = scanned.where("sizes is not null").select("sizes", "terms", "tf")
    groups = _groups(pieces)
    chosen = [np.unique(np.array([terms[w] for k in members for w in pieces[k].words], dtype=np.int64)) for _, members in groups]
    own = []
    for (_, members), ids in zip(groups, chosen):
        own.append([])
        for k in members:
            found, tf = np.unique([terms[w] for w in pieces[k].words], return_counts=True)
            row = tf * idf[found]
            own[-1].append((np.searchsorted(ids, found), row / max(np.linalg.norm(row), 1e-12)))
    tasks = min(GRAM_TASKS, 1 + documents // GRAM_DOCUMENTS)
    spaces = []
    for (size, members), ids, folded in zip(groups, chosen, _spaces(packed, idf, chosen, own, passages, rank, tasks)):
        local = np.full(len(terms) + 1, len(ids), dtype=np.int32)
        local[ids] = np.arange(len(ids))
        holds = [np.zeros((len(members), len(ids) + 1), dtype=bool) for _ in range(2)]
        for row, k in enumerate(members):
            for words, held in zip((pieces[k].words, pieces[k].answer), holds):
                held[row, local[[terms[w] for w in words]]] = True
        lengths, answers = (np.array([len(x) for x in words]) for words in zip(*((pieces[k].words, pieces[k].answer) for k in members)))
        masks = [{int(local[terms[w]]): mask for w, mask in pieces[k].masks.items()} for k in members]
        spaces.append(Space(size, np.array(members), local, folded, lengths, answers, *holds, masks))
    return Detector(terms, idf, float(np.log(documents + 2)), pieces, spaces, limits)


def decontaminate(frame: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", pass_pieces: int = PASS_PIECES, **options) -> DataFrame:
    """A row per input row: id, contaminated, item_ids (ascending) and best_share (0 if none)."""
    kind = "array<struct<item_id:bigint,share:double>>"
    out = frame.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.array().cast(kind).alias("found"))
    blocks = item_blocks(benchmark, most=pass_pieces)
    ahead = next(blocks, None)
    while ahead is not None:
        pieces, ahead = ahead, next(blocks, None)
        terms = _terms(pieces)
        kept = ["id", "found", *["text"] * (ahead is not None)]  # texts are split into words once for each block
        scanned = checkpointed(_scan(out.select(F.col("text").alias("whole"), *kept), terms))
        found = _fit(scanned, terms, pieces, **options).numbers_column(F.col("numbers"))
        out = scanned.where("numbers is not null").withColumn("found", F.concat("found", found)).select(*kept)
    found = F.array_sort("found")
    return out.select(F.col("id").alias(id_col), (F.size("found") > 0).alias("contaminated"), found["item_id"].alias("item_ids"), F.coalesce(F.array_max("found.share"), F.lit(0.0)).alias("best_share"))


def drop_contaminated(frame: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", pass_pieces: int = PASS_PIECES, **options) -> DataFrame:
    """``frame`` without the documents that hold a benchmark item."""
    clean = frame
    for k, pieces in enumerate(item_blocks(benchmark, most=pass_pieces)):
        clean = checkpointed(clean) if k else clean
        clean = clean.where(F.size(fit(frame, pieces, id_col, text_col, **options).column(F.col(f"`{text_col}`"))) == 0)
    return clean
