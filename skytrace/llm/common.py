"""Helpers shared by the operators: table access, bounded lookups, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrace.session import store

# A lookup of at most this many narrow rows is broadcast; a larger one is merged, and adaptive execution splits hot keys.
LOOKUP_ROWS = 300_000
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(big: DataFrame, small: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """Join a stored table with at most one row per key. Its size is counted before it is broadcast."""
    if small.count() <= LOOKUP_ROWS:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("merge"), on, how)


def bound_batches(df: DataFrame) -> DataFrame:
    """Let no Arrow batch of this session hold more than 4 MB (or one row): long texts come in small batches, which bounds
    both sides of the exchange with the Python workers. A lower setting stays."""
    conf = df.sparkSession.conf
    held = int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864").rstrip("b"))
    if held > BATCH_BYTES or held <= 0:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Return memory that a Python worker no longer needs to the system: the worker outlives its task, next to later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: an expression used inside a lambda is otherwise evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doc_key() -> Column:
    """Key of a document: rows with equal doc_id and text are one document to operators that join results back."""
    return F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), text_or_empty()))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs) as (node, root): the root is one node of the component.

    Rounds of hooking: every node follows the neighbour with the smallest hash (itself, if that is smallest), edges
    are rewritten and loops and repeats dropped. Hashes make the order random, so a long path shrinks by a constant factor
    per round instead of one step. Each round is a written table; the rounds' tables are composed at the end.
    """
    edges = store(edges.where("a <> b").distinct())
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        turn = F.lit(len(levels))
        ends = edges.union(edges.select("b", "a"))
        best = ends.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b", turn).alias("h"), F.col("b").alias("to"))).alias("m"))
        parent = store(best.select("node", F.when(F.col("m.h") < F.xxhash64("node", turn), F.col("m.to")).otherwise(F.col("node")).alias("root")))
        levels.append(parent)
        for end in ("a", "b"):
            edges = lookup(edges, parent.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("root", end)
        edges = store(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    result = levels[0]
    for level in levels[1:]:
        step = level.select(F.col("node").alias("root"), F.col("root").alias("next"))
        result = lookup(result, step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return store(result)


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
