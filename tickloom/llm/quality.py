"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a built-in expression over the text, so the rules run inside
the scan's own stage: no shuffle, no user function.

Contract for odd input: null text counts as text without words (it fails the
word-count rule); texts are measured whole; rows are independent, so ties and
repeated rows need no rule; an empty table gives an empty result; other columns
pass through, and the measures win over columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, fresh_name

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages.
STOP_WORDS = (
    "the be to of and that have with a in is it for on are as was "
    "der die und in den von zu das mit sich des auf ist im dem nicht ein eine "
    "de la le et les des en un du une que est pour qui dans "
    "el los se del las por con no una su para es al lo como"
).split()


@dataclass(frozen=True)
class Threshold:
    """Fails a text whose ``numerator / denominator`` (over 1 if none) leaves [low, high]."""

    name: str
    numerator: str
    denominator: str | None = None
    low: float | None = None
    high: float | None = None

    def fails(self) -> Column:
        value, over = F.col(self.numerator).cast("double"), F.col(self.denominator).cast("double") if self.denominator else F.lit(1.0)
        broken = F.lit(False)
        if self.low is not None:
            broken = broken | (value < over * F.lit(float(self.low)))
        if self.high is not None:
            broken = broken | (value > over * F.lit(float(self.high)))
        return broken


#: The base rules, then the method's own.
BASE_RULES = (
    Threshold("too_few_words", "n_words", low=50),
    Threshold("repeated_words", "n_repeat_words", "n_words", high=0.5),
)
RULES = (
    Threshold("too_many_words", "n_words", high=1_000_000),
    Threshold("word_length", "word_chars", "n_words", low=2.0, high=15.0),
    Threshold("symbols", "n_symbols", "n_words", high=0.1),
    Threshold("stop_words", "n_stop_words", "n_words", low=0.02),
    Threshold("alphabetic_words", "n_alpha_words", "n_words", low=0.7),
    Threshold("shouting", "n_shouts", "n_words", high=0.3),
    Threshold("repeated_lines", "n_dup_lines", "n_lines", high=0.5),
    Threshold("bullet_lines", "n_bullet_lines", "n_lines", high=0.9),
    Threshold("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=0.3),
)


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Bits of a packed window that hold its place; texts of more words compare windows as structs.
PLACE_BITS = 20


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more (windows compared by a 64-bit hash)."""
    mask = (1 << PLACE_BITS) - 1

    def packed_starts(windows: Column) -> Column:
        # longs sort fastest: the hash's upper bits and the place; neighbours of one prefix compare whole hashes
        packed = F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))

        def same(p: Column, e: Column, j: Column) -> Column:
            other = F.get(p, j)
            full = lambda x: F.get(windows, x.bitwiseAND(F.lit(mask)).cast("int"))
            return F.coalesce(F.shiftright(e.bitwiseXOR(other), PLACE_BITS) == 0, F.lit(False)) & (full(e) == full(other))

        return _bind(packed, lambda p: F.sort_array(F.transform(F.filter(p, lambda e, j: same(p, e, j + 1) | same(p, e, j - 1)), lambda e: e.bitwiseAND(F.lit(mask)).cast("int"))))

    def struct_starts(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda p, e, j: F.coalesce(F.get(p, j)["h"] == e["h"], F.lit(False))
        return _bind(pairs, lambda p: F.sort_array(F.transform(F.filter(p, lambda e, j: same(p, e, j + 1) | same(p, e, j - 1)), lambda e: e["i"])))

    def covered(windows: Column) -> Column:
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
        starts = F.when(F.size(windows) <= mask, packed_starts(windows)).otherwise(struct_starts(windows))
        count = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), step, lambda a: a["n"])
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(count)

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_bind(windows, covered)).cast("long")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


#: Where a word begins and where it ends, and a line (of those that only U+000A ends).
_BEGIN, _END, _LINE = rf"(?<!{WORD_CLASS})", rf"(?!{WORD_CLASS})", "(?dm)"
_STOPPED = rf"{_BEGIN}(?:{'|'.join(dict.fromkeys(STOP_WORDS))})[.,;:!?]*+{_END}"
_LETTERED = rf"{_BEGIN}[^\x20\x09-\x0D\p{{L}}]*+\p{{L}}"


def _measures(text: Column) -> Column:
    """One struct of all counts of a non-null text.  What needs no array of words is one pass of a pattern over the text."""
    blank = "\x20\t\n\x0b\x0c\r"
    words = F.array_remove(F.split(text, SPACE_CLASS + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, blank, "") != "")
    return F.struct(
        F.length(F.translate(text, blank, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _count(F.lower(text), _STOPPED).alias("n_stop_words"),
        _count(text, _LETTERED).alias("n_alpha_words"),
        _count(text, f"!!{_END}").alias("n_shouts"),
        _count(text, f"{_LINE}^ *+[-*•]").alias("n_bullet_lines"),
        _count(text, rf"{_LINE}\.\.\. *+$").alias("n_ellipsis_lines"),
        _bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words"))).alias("w"),
        _bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_alpha_words", "n_shouts", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def judge_quality(frame: DataFrame, text_col: str = "text", base: Sequence[Threshold] = BASE_RULES, rules: Sequence[Threshold] = RULES) -> DataFrame:
    """Adds the measures, base_failed, failed_rules (names, in table order) and kept."""
    added = {*MEASURES, "base_failed", "failed_rules", "kept"}
    own = fresh_name(frame, "measures")
    measured = frame.drop(*(added - {text_col})).withColumn(own, _measures(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    inside = {"n_words": "w.", "n_repeat_words": "w.", "n_lines": "l.", "n_dup_lines": "l."}
    out = measured.withColumns({m: F.col(f"{own}.{inside.get(m, '')}{m}") for m in MEASURES}).drop(own)
    failed = lambda table: F.filter(F.array(*[F.when(t.fails(), F.lit(t.name)) for t in table]), lambda x: x.isNotNull())
    out = out.withColumns({"base_failed": F.size(failed(base)) > 0, "failed_rules": failed([*base, *rules])})
    return out.withColumn("kept", F.size("failed_rules") == 0)
