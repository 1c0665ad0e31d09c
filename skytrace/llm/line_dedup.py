"""Line dedup with a fixed-depth template tree, in DataFrame functions only.

A line's tokens with a digit become ``<*>``. The tree's first layer is the token count, the next ones the leading tokens; lines
that agree on them share a leaf. Inside a leaf a token stays in the template if enough of the leaf's distinct lines have it at
that position, else it becomes ``<*>``; the line takes the template if most of its tokens stay. Templates found in many
documents are recurring: every line of such a template goes, but for the first one (smallest document, then line).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytrace.llm.common import lookup, text_or_empty
from skytrace.session import store

FIELD = "<*>"
# Line positions to take out are broadcast up to this number (four bytes each), merged by document beyond it.
LOOKUP_POSITIONS = 1_000_000


@dataclass(frozen=True)
class TreeParams:
    depth: int = 3  # leading tokens that lead to a leaf
    min_docs: int = 2  # a template found in so many documents is recurring
    token_share: float = 0.1  # share of a leaf's distinct lines (two at least) that keeps a token in its place
    masked_share: float = 0.5  # share of tokens without a digit that a masked line needs
    similarity: float = 0.75  # share of constant tokens that a generalised template needs
    min_tokens: int = 5  # shorter lines are compared as they are, digits masked
    keep_first: bool = True


def _normal(line: Column) -> Column:
    odd = line.contains("\t") | line.contains("\r") | line.contains("  ")
    return F.trim(F.when(odd, F.regexp_replace(line, "[ \t\r]+", " ")).otherwise(line))


def _count(text: Column, part: str) -> Column:
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def _base(line: Column, n: Column, p: TreeParams) -> Column:
    """The line with its fields masked, if enough of it stays."""
    masked = F.regexp_replace(line, "[^ ]*[0-9][^ ]*", FIELD)
    return F.when(n - _count(masked, FIELD) >= p.masked_share * n, masked).otherwise(line)


def parsed_lines(docs: DataFrame, p: TreeParams) -> DataFrame:
    """(doc_id, dk, line_no, line, n, digits, leaf): every line that isn't blank; dk is a hash of the document's id and text.

    Only lines with a digit are masked, so the leaf of any other line needs its leading tokens alone.
    """
    text = text_or_empty()
    lines = docs.select("doc_id", F.xxhash64("doc_id", text).alias("dk"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", _normal(F.col("line"))).where("line <> ''")
    lines = lines.withColumn("n", _count(F.col("line"), " ") + 1).withColumn("digits", F.col("line").rlike("[0-9]"))
    shown = F.when(F.col("digits"), _base(F.col("line"), F.col("n"), p)).otherwise(F.col("line"))
    leaf = F.when(F.col("n") >= max(p.min_tokens, p.depth + 1), F.md5(F.concat_ws(" ", "n", F.substring_index(shown, " ", p.depth))))
    return lines.withColumn("leaf", leaf)


def with_base(lines: DataFrame, p: TreeParams) -> DataFrame:
    base = F.when(F.col("digits"), _base(F.col("line"), F.col("n"), p)).otherwise(F.col("line"))
    return lines.withColumn("base", base).withColumn("key", F.md5("base"))


def generalised(lines: DataFrame, p: TreeParams) -> DataFrame:
    """(key, template): lines of leaves with several distinct lines whose template differs from the line itself."""
    several = lines.where("leaf IS NOT NULL").groupBy("leaf").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("leaf")
    inside = lookup(lines.where("leaf IS NOT NULL").select("leaf", "key", "base", "n"), store(several), "leaf", "left_semi")
    distinct = store(inside.groupBy("key").agg(F.first("leaf").alias("leaf"), F.first("base").alias("base"), F.first("n").alias("n")))
    sizes = distinct.groupBy("leaf").agg(F.count("*").alias("of"))
    at = distinct.select("leaf", F.posexplode(F.split("base", " ")).alias("pos", "token")).where(F.col("pos") >= p.depth)
    support = at.groupBy("leaf", "pos", "token").agg(F.count("*").alias("held"))
    enough = F.when(F.col("held") >= F.greatest(F.lit(2), F.ceil(p.token_share * F.col("of"))), F.col("token"))
    kept = support.join(sizes, "leaf").groupBy("leaf", "pos").agg(F.collect_set(enough).alias("tokens"))
    leaves = store(kept.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("pos", "tokens"))).alias("kept")))
    tokens = F.split("base", " ")
    shaped = F.transform(tokens, lambda t, i: F.when(
        (i < p.depth) | F.array_contains(F.get(F.col("kept"), i - p.depth)["tokens"], t), t).otherwise(F.lit(FIELD)))
    found = distinct.join(leaves.hint("merge"), "leaf").select("key", "base", "n", F.array_join(shaped, " ").alias("template"))
    similar = F.col("n") - _count(F.col("template"), FIELD) >= p.similarity * F.col("n")
    return store(found.where(similar & (F.col("template") != F.col("base"))).select("key", F.md5("template").alias("template")))


def dropped_lines(docs: DataFrame, p: TreeParams = TreeParams()) -> DataFrame:
    """(doc_id, dk, gone): the positions of the lines that go, for documents that have any."""
    # the text of lines in leaves is kept next to their keys: reading it back costs less than parsing the documents again
    lines = store(with_base(parsed_lines(docs, p), p).select("doc_id", "dk", "line_no", "key", "leaf", "n", F.when(F.col("leaf").isNotNull(), F.col("base")).alias("base")))
    shapes = generalised(lines, p)
    placed = lookup(lines, shapes, "key", "left").select("doc_id", "dk", "line_no", F.coalesce("template", "key").alias("template"))
    placed = store(placed)
    once = placed.groupBy("template", "doc_id", "dk").agg(F.min("line_no").alias("line_no"))
    recurring = once.groupBy("template").agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "dk", "line_no")).alias("first"))
    recurring = store(recurring.where(F.col("docs") >= p.min_docs))
    hits = lookup(placed, recurring, "template")
    if p.keep_first:
        hits = hits.where(~F.struct("doc_id", "dk", "line_no").eqNullSafe(F.col("first")))
    return hits.groupBy("doc_id", "dk").agg(F.collect_set("line_no").alias("gone"))


def dedup_lines(docs: DataFrame, p: TreeParams = TreeParams()) -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of ``text``, and ``n_lines`` and ``n_dropped`` added.

    Rows stay, also those that lose every line (their text is then empty). A null text has one empty line and stays null. Blank lines
    stay. Rows with equal doc_id and text are one document: they lose the same lines. Other columns pass through; columns
    of ``docs`` called n_lines, n_dropped, dk or gone are replaced. An empty table gives an empty table.
    """
    docs = docs.drop("n_lines", "n_dropped", "dk", "gone")
    gone = store(dropped_lines(docs, p)).select(F.col("doc_id").alias("_id"), F.col("dk").alias("_dk"), "gone")
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", text_or_empty()))
    positions = gone.agg(F.sum(F.size("gone"))).first()[0] or 0
    gone = F.broadcast(gone) if positions <= LOOKUP_POSITIONS else gone
    out = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_dk")), "left")
    lines = F.split(text_or_empty(), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    out = out.withColumn("n_lines", (_count(text_or_empty(), "\n") + 1).cast("long"))
    out = out.withColumn("n_dropped", F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long"))
    return out.withColumn("text", text).drop("gone", "_id", "_dk", "_key")
