"""Alignment of two tokenizers over the same bytes by merge-path partitioning.

Both tokenizers cover a text's bytes, so each gives a rising list of token ends. The lists of many texts, one after another, form one
merge of A ends with B ends (a text's last ends agree, so nothing crosses texts). Binary searches along evenly spaced diagonals of the
merge cut it into pieces of equal work, whatever the texts' lengths. A piece finds its own links (each end stands under one token of the
other side) and which ends both sides share; pieces are then stitched: running sums of shared ends number the groups, also those that begin in one piece and
end in another. How often two ids are linked is summed over all texts, and comes back to each text by a join on the id pair.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.llm.common import bound_batches, lookup, vocabulary
from skytrace.session import store

STEP = 1 << 15  # ends in a piece
GROUP_BYTES = 1 << 20  # text that is merged at a time (a longer text alone)
LONG_BLANK = 2000  # white space in a row that the fast encoder's pattern can't take
_BLANKS = re.compile(r"\s{%d}" % LONG_BLANK)
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
SPACE_MARK = "▁"


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: visible Latin-1 characters for themselves, others from 256 on in order."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in {*seen}]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevelCoder:
    """Ids of a byte-level vocabulary file, whose ids are the ranks of its merges; ``bytes_of[id]`` are a token's bytes."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        special, letters = {t["content"] for t in whole["added_tokens"]}, byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in whole["model"]["vocab"].items() if token not in special}
        self.path, self.slow = path, None
        self.fast = tiktoken.Encoding("aligned", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._by_file(t) if len(t) >= LONG_BLANK and _BLANKS.search(t) else self.fast.encode_ordinary(t) for t in texts]

    def _by_file(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids


class PieceCoder:
    """Ids of a sentence-piece model, which puts a space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = [self._bytes(self.model.id_to_piece(i)) for i in range(self.model.vocab_size())]

    @staticmethod
    def _bytes(piece: str) -> bytes:
        byte = _BYTE_PIECE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE_MARK, " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


def merge_cuts(a: np.ndarray, b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two rising lists (of equal values a's comes first) crosses every ``step``-th diagonal: places in a and in b."""
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, step), total)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (searching := low < high).any():
        middle = (low + high) // 2
        ahead = np.zeros(len(d), bool)
        m = middle[searching]
        ahead[searching] = a[m] <= b[d[searching] - 1 - m]
        low = np.where(searching & ahead, middle + 1, low)
        high = np.where(searching & ~ahead, middle, high)
    return low, d - low


@dataclass(frozen=True)
class Piece:
    """Links (places in a, places in b) found by one piece, and which of its ends the other side shares."""

    link_a: np.ndarray
    link_b: np.ndarray
    shared_a: np.ndarray
    shared_b: np.ndarray


def piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> Piece:
    """The ends a[i0:i1] and b[j0:j1] of one piece. Only the next end of b and the end of a before the piece are read besides."""
    ends_a, ends_b = a[i0:i1], b[j0:j1]
    under_b = j0 + np.searchsorted(ends_b, ends_a)
    under_a = i0 + np.searchsorted(ends_a, ends_b)
    shared_a = b[under_b] == ends_a if len(ends_a) else np.zeros(0, bool)
    shared_b = np.zeros(len(ends_b), bool)
    inside = under_a < i1
    shared_b[inside] = a[under_a[inside]] == ends_b[inside]
    if i0 and len(ends_b) and a[i0 - 1] == ends_b[0]:
        shared_b[0] = True  # its partner closed the piece before
    own = ~shared_b
    return Piece(np.concatenate([np.arange(i0, i1), under_a[own]]), np.concatenate([under_b, np.arange(j0, j1)[own]]), shared_a, shared_b)


@dataclass(frozen=True)
class Merged:
    link_a: np.ndarray
    link_b: np.ndarray
    last_a: np.ndarray  # whether a token ends its group
    last_b: np.ndarray


def merged(a: np.ndarray, b: np.ndarray, step: int = STEP) -> Merged:
    """Links and group ends of two lists of token ends that reach the same last end."""
    at_a, at_b = merge_cuts(a, b, step)
    parts = [piece(a, b, *cut) for cut in zip(at_a[:-1], at_a[1:], at_b[:-1], at_b[1:])] or [piece(a, b, 0, 0, 0, 0)]
    return Merged(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("link_a", "link_b", "shared_a", "shared_b")))


class Aligner:
    """Tokenises and aligns lists of texts; holds both tokenizers."""

    def __init__(self, a_path: str, b_path: str, step: int = STEP):
        self.a, self.b, self.step = ByteLevelCoder(a_path), PieceCoder(b_path), step
        self.size_a, self.size_b = (np.array([len(t) for t in c.bytes_of], np.int64) for c in (self.a, self.b))
        # decimal ids with what follows them: a comma, or the end of a group's A or B ids
        names = [[str(i) for i in range(len(c.bytes_of))] for c in (self.a, self.b)]
        self.shown = [(n + end).encode() for held, close in zip(names, ("|", ";")) for end in (",", close) for n in held]

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """Per text: n_a, n_b, n_groups, n_links, groups_sha256, distinct pair codes and how many links each has."""
        spaced = [" " + t for t in texts]
        ids_a, ids_b = self.a.encode(spaced), self.b.encode(texts)
        for k, text in enumerate(spaced):
            raw = text.encode()
            if not texts[k] or b"".join(map(self.a.bytes_of.__getitem__, ids_a[k])) != raw or b"".join(map(self.b.bytes_of.__getitem__, ids_b[k])) != raw:
                ids_a[k], ids_b[k] = [], []
        held_a, held_b = (np.array([len(x) for x in ids]) for ids in (ids_a, ids_b))
        ids_a, ids_b = (np.concatenate([np.array(x, np.int64) for x in ids]) for ids in (ids_a, ids_b))
        m = merged(self.size_a[ids_a].cumsum(), self.size_b[ids_b].cumsum(), self.step)
        stops_a, stops_b = held_a.cumsum(), held_b.cumsum()
        doc_of_a = np.repeat(np.arange(len(texts)), held_a)
        doc_of_link = doc_of_a[m.link_a]
        codes = ids_a[m.link_a] * len(self.size_b) + ids_b[m.link_b]
        pairs, times = np.unique(doc_of_link << 32 | codes, return_counts=True)
        pair_stops = np.searchsorted(pairs, np.arange(1, len(texts) + 1) << 32)
        groups = np.bincount(doc_of_a[m.last_a], minlength=len(texts))
        links = np.bincount(doc_of_link, minlength=len(texts))
        order = self._listed(ids_a, ids_b, m)
        for k in range(len(texts)):
            a0, b0, p0 = (int(stops[k - 1]) if k else 0 for stops in (stops_a, stops_b, pair_stops))
            mine = slice(p0, pair_stops[k])
            yield (int(held_a[k]), int(held_b[k]), int(groups[k]), int(links[k]), self._digest(order[a0 + b0:stops_a[k] + stops_b[k]]), pairs[mine] & 0xFFFFFFFF, times[mine])

    def _listed(self, ids_a: np.ndarray, ids_b: np.ndarray, m: Merged) -> np.ndarray:
        """Places in ``shown`` of all ids, group by group, A before B."""
        ends_a, ends_b = np.flatnonzero(m.last_a) + 1, np.flatnonzero(m.last_b) + 1
        group_a, group_b = m.last_a.cumsum() - m.last_a, m.last_b.cumsum() - m.last_b
        before_b = np.concatenate([[0], ends_b])[group_a] if len(group_a) else group_a
        out = np.empty(len(ids_a) + len(ids_b), np.int64)
        out[np.arange(len(ids_a)) + before_b] = ids_a + len(self.size_a) * m.last_a
        out[np.arange(len(ids_b)) + (ends_a[group_b] if len(group_b) else group_b)] = 2 * len(self.size_a) + ids_b + len(self.size_b) * m.last_b
        return out

    def _digest(self, order: np.ndarray) -> str:
        if not len(order):
            return ""
        digest = hashlib.sha256()
        for at in range(0, len(order), 1 << 16):
            shown = b"".join(map(self.shown.__getitem__, order[at:at + (1 << 16)].tolist()))
            digest.update(shown if at + (1 << 16) < len(order) else shown[:-1])
        return digest.hexdigest()


_LOADED: dict[tuple[str, str], Aligner] = {}


def _aligner(a_path: str | None, b_path: str | None) -> Aligner:
    at = a_path or vocabulary("byte_bpe_50k.json"), b_path or vocabulary("piece_bpe_32k.model")
    return _LOADED.get(at) or _LOADED.setdefault(at, Aligner(*at))


ALIGNED = "doc_id {id}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, width long, pairs array<long>, times array<int>"


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per document with its counts and its distinct id pairs (A id x ``width`` + B id); ``row`` tells rows apart once stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = _aligner(a_path, b_path), TaskContext.get().partitionId() << 33
        names = [part.split()[0] for part in ALIGNED.split(", ")]
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, held = [], 0
                while at + len(texts) < batch.num_rows and (not texts or held < GROUP_BYTES):
                    texts.append(batch.column(1)[at + len(texts)].as_py() or "")
                    held += len(texts[-1])
                rows = list(coder.align(texts))
                columns = [pa.array(c, k) for c, k in zip(zip(*(r[:5] for r in rows)), [pa.int64()] * 4 + [pa.string()])]
                stops = pa.array(np.concatenate([[0], np.cumsum([len(r[5]) for r in rows])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(stops, pa.array(np.concatenate([r[k] for r in rows]).astype(kind))) for k, kind in ((5, np.int64), (6, np.int32))]
                numbers = pa.array(np.arange(row, row + len(rows)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), numbers, *columns, pa.array([len(coder.size_b)] * len(rows), pa.int64()), *lists], names)
                at, row = at + len(rows), row + len(rows)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bound_batches(docs).select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, ALIGNED.format(id=kind))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, held, best): links of every id pair in all documents, and whether no other A id has more links with its B id."""
    each = rows.select("width", F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("held"), F.max("width").alias("width"))
    each = store(each.withColumn("b", F.col("pair") % F.col("width")))
    highest = each.groupBy("b").agg(F.max("held").alias("most"))
    return store(lookup(each, store(highest), "b").select("pair", "held", (F.col("held") == F.col("most")).alias("best")))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs(doc_id, text, ...)``.

    A null or empty text, and one that a tokenizer doesn't give back byte by byte, has no tokens: zeros and an empty digest. Repeated
    rows count, and are returned, as often as they occur. Other columns are not read. An empty table gives an empty one.
    """
    rows = store(aligned(docs, a_path, b_path))
    counts = pair_counts(rows)
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    scored = lookup(each, counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("times") * F.col("held")).alias("count_sum"))
    out = lookup(rows.drop("pairs", "times", "width"), store(scored), "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
