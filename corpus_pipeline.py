"""The training-corpus pipeline: documents in, tokens out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns they were given (those of ``documents``
and any others, whatever their names).

Contract for odd input, of every stage: a null text counts as the empty text and
stays null where it is returned; texts are read whole; repeated rows of one id
stay or go together; rows without an id take part and keep their null id; an empty
table gives an empty table of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import bpe, decontaminate, line_dedup, similar, toxicity
from tickloom.llm.common import checkpointed, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score of 0.5 or more) go.  Null and empty texts are scored alike; without toxic labels a fixed lexicon judges."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(model.column(docs["text"]) < 0.5)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of several documents stay in the one of least id; documents without an id come after all others.  No document goes, though its text may become empty."""
    return line_dedup.drop_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least id (ties are rows of one id, which all stay).

    Groups are linked by SimHash candidates verified at a Jaccard similarity of 0.8 or more of five-word shingles; texts
    without words are one group; rows without an id stay if no linked row has one.
    """
    return similar.drop_similar(docs, least=0.8, shingle=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go; null and empty texts hold none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left; null and empty texts have no tokens."""
    import public_tokenizers

    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: SQL cannot express the toxicity, SimHash, decontamination and BPE stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
