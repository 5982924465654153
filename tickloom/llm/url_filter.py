"""URL filter: every glob rule at once, by a bit-parallel Shift-And automaton.

All patterns are packed end to end into one state vector of 64-bit words.  A
state is "the first j symbols of pattern r have been read"; one character moves
every state of every pattern with a shift, an AND with that character's mask and
an OR that keeps the states standing before a ``*``.  The automaton runs over a
whole batch of URLs in lockstep, one character of each URL per step.

Contract for odd input: a null or empty URL, or one without ``://``, has an
empty host and path and still gets a verdict; rows are independent of each
other, so repeated rows give repeated results; an empty table gives an empty
result; further columns pass through unless they carry a result's name, in
which case the result wins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh_name

WORD_BITS = 64


@dataclass(frozen=True)
class UrlRule:
    """``allow`` or ``block`` what lies under ``host`` (and its subdomains) at ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        """The rule over the canonical form ``.host#path``; neither part holds a ``#``."""
        return f"*.{_literal(self.host)}#{_literal(self.path)}*"


@dataclass(frozen=True)
class UrlGlob:
    """A wildcard over the canonical form: ``*`` any run, ``?`` any one character, ``\\`` quotes."""

    verdict: str
    glob: str


def _literal(text: str) -> str:
    return "".join(f"\\{c}" if c in "*?\\" else c for c in text)


def _symbols(glob: str) -> list[tuple[str | None, bool]]:
    """(character or None for any, whether a ``*`` stands before it), then a last (None, star) end."""
    out: list[tuple[str | None, bool]] = []
    star, i = False, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            star = True
        elif c == "?":
            out.append((None, star))
            star = False
        else:
            if c == "\\" and i + 1 < len(glob):
                i += 1
                c = glob[i]
            out.append((c, star))
            star = False
        i += 1
    out.append((None, star))
    return out


class ShiftAnd:
    """All globs as one nondeterministic automaton on words of 64 states."""

    def __init__(self, globs: Sequence[str]):
        self.patterns = len(globs)
        rows = [_symbols(g) for g in globs]
        states = sum(map(len, rows))
        self.words = max(1, -(-states // WORD_BITS))
        self.alphabet = np.array(sorted({ord(c) for row in rows for c, _ in row if c is not None}), dtype=np.uint32)
        self.masks = np.zeros((len(self.alphabet) + 1, self.words), dtype=np.uint64)
        self.start = np.zeros(self.words, dtype=np.uint64)
        self.loop = np.zeros(self.words, dtype=np.uint64)
        self.accept: list[tuple[int, np.uint64]] = []
        position = 0
        for row in rows:
            self.start[position // WORD_BITS] |= self._bit(position)
            for j, (c, star) in enumerate(row):
                at = position + j
                if star:
                    self.loop[at // WORD_BITS] |= self._bit(at)
                if j + 1 < len(row):  # reading c leads from state j to state j + 1
                    classes = range(len(self.masks)) if c is None else [int(np.searchsorted(self.alphabet, ord(c)))]
                    for k in classes:
                        self.masks[k, (at + 1) // WORD_BITS] |= self._bit(at + 1)
            last = position + len(row) - 1
            self.accept.append((last // WORD_BITS, self._bit(last)))
            position += len(row)

    @staticmethod
    def _bit(at: int) -> np.uint64:
        return np.uint64(1 << (at % WORD_BITS))

    def matches(self, texts: Sequence[str]) -> np.ndarray:
        """A row for each text, a column for each glob: does it match the whole text?"""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        if len(self.alphabet):
            at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
            classes = np.where(self.alphabet[at] == codes, at, len(self.alphabet))
        else:
            classes = np.zeros(len(codes), dtype=np.int64)
        begins = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        state = np.tile(self.start, (len(texts), 1))
        live = len(texts)
        carry = np.uint64(WORD_BITS - 1)
        one = np.uint64(1)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            while lengths[live - 1] <= step:
                live -= 1
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> carry
            state[:live] = (moved & self.masks[classes[begins[:live] + step]]) | (now & self.loop)
        out = np.zeros((len(texts), self.patterns), dtype=bool)
        for k, (word, bit) in enumerate(self.accept):
            out[order, k] = (state[:, word] & bit) != 0
        return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host with A-Z lower-cased; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def filter_urls(
    frame: DataFrame,
    rules: Sequence[UrlRule],
    globs: Sequence[UrlGlob] = (),
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Adds host, path, rule (the longest fitting rule, else null) and verdict.

    A fitting rule's verdict stands.  Otherwise the first fitting glob of
    ``globs`` decides, and ``default`` where none fits.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))
    patterns = [r.glob for r in ranked] + [g.glob for g in globs]

    @F.pandas_udf("int")
    def first_match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ShiftAnd(patterns)
        for batch in batches:
            hit = automaton.matches(batch.tolist())
            found = hit.any(axis=1) if automaton.patterns else np.zeros(len(batch), dtype=bool)
            best = hit.argmax(axis=1) if automaton.patterns else np.zeros(len(batch), dtype=int)
            yield pd.Series(np.where(found, best, -1).astype(np.int32))

    host, path = url_parts(F.col(f"`{url_col}`"))
    out = frame.drop(*({"host", "path", "rule", "verdict"} - {url_col})).withColumns({"host": host, "path": path})
    match = fresh_name(frame, "match")
    out = out.withColumn(match, first_match(F.concat(F.lit("."), "host", F.lit("#"), "path")))
    names = F.array(*[F.lit(r.name) for r in ranked]) if ranked else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(r.verdict) for r in [*ranked, *globs]]) if patterns else F.array().cast("array<string>")
    return out.withColumns(
        {
            "rule": F.when(F.col(match).between(0, len(ranked) - 1), F.get(names, F.col(match))),
            "verdict": F.when(F.col(match) >= 0, F.get(verdicts, F.col(match))).otherwise(F.lit(default)),
        }
    ).drop(match)
