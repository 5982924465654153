"""Substring dedup by sliding sentence spans.

Every run of consecutive sentences is hashed (128 bits): from each sentence on,
the shortest run of at least ``span`` sentences and ``min_words`` words.  Runs
join globally by their hash, and the sentences that any non-first repeated run
covers go.  The word count keeps chance repeats of very short sentences alone
and lets runs of one-word sentences grow.

A sentence is a run of text up to and including its ``.``, ``!`` or ``?`` signs,
or up to a line end.  One of more than 25 words (text without such signs) is cut
by content, so that a passage is cut alike wherever it stands: after every word
whose MD5 digest, together with the word before, begins with 0, 1 or 2, and after
25 words without such a place.  A repeated passage loses what lies between its
first and last common cut.

What repeats inside a document is told where it is hashed; documents are compared
by the least one that holds a run, which is one aggregation with map-side combine.
Frequent runs are joined by broadcast.  Runs compare by their sentences stripped of ASCII
white space with A-Z lower-cased; pieces that are empty after that are no
sentences and stay where they are.

Contract for odd input: ids are integers; null text has no sentences and stays
null; runs that the end of the text cuts short are not compared; the first
occurrence is that of the least (id, position); rows without an id are documents
named by their text that sort after all others; rows with one id are one document,
so what they share stays in all of them, and they lose the same places; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document_key, join_by_frequency

SPAN = 3
MIN_WORDS = 20
SENTENCE_WORDS = 25
#: First hexadecimal digits of a digest that end a piece of a long sentence.
CUTS = "012"
_BLANK = b" \t\n\x0b\x0c\r"
_SENTENCE = re.compile(rb"[^.!?\n]*[.!?]+|[^.!?\n]+|\n")
_TOKEN = re.compile(rb"[ \t\r\x0b\x0c]*[^ \t\r\x0b\x0c.!?]+[ \t\r\x0b\x0c]*[.!?]*")


def cut_places(words: list[bytes]) -> list[int]:
    """Numbers of words after which a long sentence is cut; the last is its length."""
    out, last, before = [], 0, b""
    for k, word in enumerate(words, 1):
        if hashlib.md5(before + b" " + word, usedforsecurity=False).hexdigest()[0] in CUTS:
            out.append(k)
            last = k
        elif (k - last) % SENTENCE_WORDS == 0:
            out.append(k)
        before = word
    if not out or out[-1] < len(words):
        out.append(len(words))
    return out


def split_sentences(text: bytes) -> tuple[list[bytes], list[int], list[bytes], list[int]]:
    """(pieces, the places of those that are sentences, their keys and their words); joined, the pieces give the text again."""
    pieces, counts = [], []
    for sentence in _SENTENCE.findall(text):
        words = sentence.rstrip(b".!?").split()
        if len(words) <= SENTENCE_WORDS:
            pieces.append(sentence)
            counts.append(len(words))
            continue
        tokens, first = _TOKEN.findall(sentence), 0
        for stop in cut_places(sentence.rstrip(b".!?").lower().split()):
            pieces.append(b"".join(tokens[first:stop]))
            counts.append(stop - first)
            first = stop
    places, keys, words_of = [], [], []
    for i, piece in enumerate(pieces):
        if key := piece.strip(_BLANK).lower():  # on bytes: A-Z only
            places.append(i)
            keys.append(key)
            words_of.append(counts[i])
    return pieces, places, keys, words_of


def run_ends(words: list[int], span: int, min_words: int) -> np.ndarray:
    """For each sentence that a whole run begins with, the one after its last."""
    if len(words) < span:
        return np.zeros(0, dtype=np.int64)
    total = np.cumsum([0, *words])
    starts = np.arange(len(words) - span + 1)
    ends = np.maximum(np.searchsorted(total, total[starts] + min_words), starts + span)
    return ends[: np.searchsorted(ends, len(words), side="right")]


def span_hashes(keys: list[bytes], words: list[int], span: int, min_words: int) -> list[bytes]:
    """Digests of the runs."""
    return [xxhash.xxh3_128_digest(b"\n".join(keys[a:b])) for a, b in enumerate(run_ends(words, span, min_words).tolist())]


def _remove(text: bytes | None, runs: list[int] | None, span: int, min_words: int) -> tuple[bytes | None, int, int]:
    if text is None:
        return None, 0, 0
    pieces, places, _, words = split_sentences(text)
    if not runs:
        return text, len(places), 0
    ends = run_ends(words, span, min_words).tolist()
    gone = {i for a in runs if a < len(ends) for i in range(a, ends[a])}
    out = {places[i] for i in gone}
    return b"".join(p for i, p in enumerate(pieces) if i not in out), len(places), len(gone)


def deduplicate_sentences(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, min_words: int = MIN_WORDS, with_text: bool = True) -> DataFrame:
    """A row per input row: id, n_sentences, n_removed, kept_sha256 (null text: of the empty text) and kept_text."""
    text = F.col(f"`{text_col}`")
    source = frame.select(F.col(f"`{id_col}`").alias("id"), text.cast("binary").alias("text"), *document_key(frame, id_col, F.coalesce(text, F.lit(""))))
    kind = source.schema["id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                found, rows, places = [], [], []
                for row, text in enumerate(part.column(2).to_pylist()):
                    _, _, keys, words = split_sentences(text)
                    digests = span_hashes(keys, words, span, min_words)
                    seen: dict[bytes, int] = {}
                    places += [at if seen.setdefault(d, at) == at else -1 - at for at, d in enumerate(digests)]  # below zero: not the document's first
                    found += digests
                    rows += [row] * len(digests)
                both, rows = np.frombuffer(b"".join(found), dtype=np.int64).reshape(-1, 2), pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_pydict({"h": pa.array(both[:, 0]), "l": pa.array(both[:, 1]), "nameless": part.column(0).take(rows), "doc": part.column(1).take(rows), "at": pa.array(places, pa.int32())})

    runs = source.where("text is not null").select("nameless", "doc", "text").mapInArrow(hashed, "h long, l long, nameless int, doc long, at int")
    own, other = (F.min(F.when(F.col("nameless") == k, F.col("doc"))) for k in (0, 1))
    repeated = runs.groupBy("h", "l").agg(F.count(F.lit(1)).alias("n"), own.alias("named"), other.alias("unnamed")).where("n > 1")
    first = repeated.select("h", "l", "n", F.coalesce("named", "unnamed").alias("first"), F.col("named").isNull().cast("int").alias("kind"))
    met = join_by_frequency(runs, first, ["h", "l"], "n", keep_keys=False)
    later = met.where("at < 0 or doc <> first or nameless <> kind").select("nameless", "doc", F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).alias("at"))
    cover = later.groupBy("nameless", "doc").agg(F.collect_set("at").alias("runs"))
    joined = source.join(cover, ["nameless", "doc"], "left").select("id", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = [_remove(t, r, span, min_words) for t, r in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                columns = {
                    id_col: part.column(0),
                    "n_sentences": pa.array([r[1] for r in rows], pa.int64()),
                    "n_removed": pa.array([r[2] for r in rows], pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(r[0] or b"").hexdigest() for r in rows], pa.string()),
                }
                if with_text:
                    columns["kept_text"] = pa.array([None if r[0] is None else r[0].decode("utf-8") for r in rows], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return joined.mapInArrow(cut, f"`{id_col}` {kind}, n_sentences long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else ""))


__all__ = ["cut_places", "deduplicate_sentences", "run_ends", "span_hashes", "split_sentences"]
