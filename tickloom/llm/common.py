"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: ASCII white space as the operators define it: space and U+0009..U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of a table that is broadcast; more go through a shuffle.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, _UPPER, _UPPER.lower())


def fresh_name(frame: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``frame`` begins with it."""
    name = f"_{name}"
    while any(c.lower().startswith(name.lower()) for c in frame.columns):
        name = f"_{name}"
    return name


def integer_ids(frame: DataFrame, id_col: str) -> Column:
    """The id column as a long; other than integers are refused, for no cast may make documents one."""
    kind = frame.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} must be an integer column, not {kind.simpleString()}")
    return F.col(f"`{id_col}`").cast("long")


def document_key(frame: DataFrame, id_col: str, text: Column) -> list[Column]:
    """(nameless, doc): 0 and the id; for rows without one, 1 and a hash of the text.

    Rows of one key are one document.  Nameless documents sort after all others and spread over the tasks.
    """
    own = integer_ids(frame, id_col)
    return [own.isNull().cast("int").alias("nameless"), F.coalesce(own, F.xxhash64(text)).alias("doc")]


def checkpointed(frame: DataFrame) -> DataFrame:
    """``frame`` with its lineage cut in the cluster's shared folder, the session's ``spark.checkpoint.dir``.

    Where that is unset, a single machine takes a temporary folder; on a cluster
    executors could not read it, so there the setting is required.
    """
    spark = frame.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="tickloom-checkpoint-")
        context.setCheckpointDir(shared)
    return frame.checkpoint(eager=True)


def broadcast_if_small(frame: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``frame`` (narrow, already computed) with a broadcast hint if it has at most ``most`` rows."""
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame


def join_by_frequency(left: DataFrame, right: DataFrame, keys: list[str], weight: str, most: int = 4096, keep_keys: bool = True) -> DataFrame:
    """Inner join of ``left`` with ``right``, a row per key with ``weight``, about its rows on the left.

    Keys of more than a ``most``-th of the total weight are at most ``most``: they
    are broadcast, and their rows take a scattered key into the shuffle that joins
    all other keys, so no task gathers them.  ``left`` is read once.  Without
    ``keep_keys`` the result has no keys, and the shuffle carries them once.
    """
    right = checkpointed(right)
    total = right.agg(F.sum(weight).alias("total")).first().total or 0
    limit = max(16, total // most)
    values = [c for c in right.columns if c not in (*keys, weight)]
    pack = F.struct(*values)
    hot = right.where(F.col(weight) > limit).select(*keys, pack.alias("_hot"))
    cold = right.where(F.col(weight) <= limit).select(*[F.col(k).alias(f"_{k}") for k in keys], pack.alias("_cold"))
    marked = left.join(F.broadcast(hot), keys, "left")
    marked = marked.withColumn("_at", F.xxhash64(F.monotonically_increasing_id()))
    marked = marked.withColumns({f"_k{i}": F.when(F.col("_hot").isNotNull(), F.col("_at")).otherwise(F.col(k)) for i, k in enumerate(keys)})
    match = F.col("_hot").isNull()
    for i, k in enumerate(keys):
        match = match & (F.col(f"_k{i}") == F.col(f"_{k}"))
    joined = marked.join(cold, match, "left").withColumn("_found", F.coalesce("_hot", "_cold")).where("_found is not null")
    return joined.select(*[c for c in left.columns if keep_keys or c not in keys], *[F.col(f"_found.{v}").alias(v) for v in values])
