"""Packing of tokenised documents into sequences, shortest pack first over the length histogram.

Documents are cut into pieces of ``capacity`` tokens and a rest. Only the histogram of piece lengths (at most ``capacity`` rows)
reaches the driver. Lengths are placed longest first, each into the pack with the most room; packs of one content are
one pattern with a count, so the work depends on the number of lengths, not of documents. A pattern's places are ranges of ranks
within a length, and pieces find theirs by their rank: their number inside the input partition plus the partitions before.
"""

from __future__ import annotations

import os
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytrace.llm.common import bound_batches, give_back, lookup, text_or_empty, vocabulary as vocabulary_file
from skytrace.session import store

CAPACITY = 2048
END = 1
CACHED_WORDS = 300_000  # in each of two generations
BLOCK = 1 << 22
# Punctuation that may stand around a run of letters; an apostrophe may begin a word of the tokenizer together with letters.
AROUND = "!\"#$%&()*+,-./:;=?@[]^_`{|}~"


def default_vocabulary() -> str:
    return vocabulary_file("word_bpe_49k.json")


class WordTokenizer:
    """Ids of a tokenizer whose words never cross a space or line break, with a bounded cache of words.

    Texts in Latin-1 without ``<|`` are lower-cased here and skip the tokenizer's own normaliser (NFC changes no Latin-1
    character). There a run of letters is one word of the tokenizer wherever it stands, so new runs are encoded together and cut where a
    token ends a word; punctuation around a run is looked up apart. All other words go through the tokenizer one by one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers

        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        self.ends[[i for token, i in self.whole.get_vocab().items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Empty the cache: some 100 MB when it is full."""
        self.words: dict[bool, dict[str, bytes]] = {True: {}, False: {}}
        self.older: dict[bool, dict[str, bytes]] = {True: {}, False: {}}

    def _one_by_one(self, words: list[str], plain: bool) -> None:
        coder, known = self.plain if plain else self.whole, self.words[plain]
        for word, got in zip(words, coder.encode_batch_fast(words, add_special_tokens=False)):
            known[word] = struct.pack(f"<{len(got.ids)}I", *got.ids)

    def _runs(self, runs: list[str]) -> None:
        ids = np.array(self.plain.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) != len(runs):
            return self._one_by_one(runs, True)
        flat, known, at = ids.tobytes(), self.words[True], 0
        for word, cut in zip(runs, cuts):
            known[word] = flat[at:cut]
            at = cut

    def _learn(self, missing: list[str]) -> None:
        known = self.words[True]
        runs: set[str] = set()
        around, others = [], []
        for word in missing:
            run = word.strip(AROUND)
            if run.isalpha():
                if run not in known:
                    runs.add(run)
                if len(run) < len(word):
                    around.append((word, run))
            else:
                others.append(word)
        sides = set()
        for word, run in around:
            start = word.index(run)
            sides.update((word[:start], word[start + len(run):]))
        others += [side for side in sides if side and side not in known]
        if runs:
            self._runs(list(runs))
        if others:
            self._one_by_one(others, True)
        known[""] = b""
        for word, run in around:
            start = word.index(run)
            known[word] = known[word[:start]] + known[run] + known[word[start + len(run):]]

    def _block(self, text: str, plain: bool) -> bytes:
        known = self.words[plain]
        words = (text.lower() if plain else text).replace("\n", " ").split(" ")
        missing = [w for w in set(words) if w not in known]
        if missing:
            if len(known) + len(missing) > CACHED_WORDS:
                # words that are still in use move on to the new generation
                self.older[plain], known = known, {}
                self.words[plain] = known
                missing = list(set(words))
            if older := self.older[plain]:
                known.update((w, older[w]) for w in missing if w in older)
                missing = [w for w in missing if w not in known]
            if missing:
                self._learn(missing) if plain else self._one_by_one(missing, False)
        return b"".join(map(known.__getitem__, words))

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        plain = "<|" not in text
        if plain:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                plain = False
        parts, at = [], 0
        while at < len(text):
            gap = text.find(" ", at + BLOCK) if len(text) > at + BLOCK else -1
            end = len(text) if gap < 0 else gap
            parts.append(self._block(text[at:end], plain))
            at = end
        return b"".join(parts)


_LOADED: dict[str, WordTokenizer] = {}


def _coder(vocabulary: str) -> WordTokenizer:
    return _LOADED.get(vocabulary) or _LOADED.setdefault(vocabulary, WordTokenizer(vocabulary))


Pattern = tuple[int, tuple[tuple[int, int], ...]]  # packs, ((length, times in each pack), ...)


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Shortest pack first. Gives what placing piece by piece would give, but moves all packs of one content at once.

    A length adds at most three patterns (the last pattern it splits, a filled new one, a partly filled new one), so there
    are at most 3 x capacity of them.
    """
    open_packs: dict[int, list[Pattern]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, held in open_packs.items() if held and r >= length), default=None)
            if room is None:
                times = capacity // length
                for packs, each in ((left // times, times), (1, left % times)):
                    if packs and each:
                        open_packs[capacity - length * each].append((packs, ((length, each),)))
                break
            packs, parts = open_packs[room].pop()
            moved = min(packs, left)
            if moved < packs:
                open_packs[room].append((packs - moved, parts))
            last = ((length, parts[-1][1] + 1),) if parts[-1][0] == length else (parts[-1], (length, 1))
            open_packs[room - length].append((moved, parts[:-1] + last))
            left -= moved
    return [p for held in open_packs.values() for p in held]


def places(found: list[Pattern]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, times, offset) of each pattern's places."""
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for packs, parts in found:
        offset = 0
        for length, times in parts:
            yield length, used[length], used[length] + packs * times, sequence, times, offset
            used[length] += packs * times
            offset += length * times
        sequence += packs


PIECE = "doc_id {id}, part int, start long, length long, doc_tokens long, local long, ids binary"
FLUSH_BYTES = 4 << 20


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part, start, length, doc_tokens, local, ids): all tokens of every document, cut.

    local numbers the pieces of one length inside the input partition ``part``; both hold for the table once it is stored.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = _coder(vocabulary), TaskContext.get().partitionId(), defaultdict(int)
        names = ["doc_id", "part", "start", "length", "doc_tokens", "local", "ids"]
        for batch in batches:
            rows, places, held = [], [], 0

            def flush() -> pa.RecordBatch:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), pa.array([part] * len(rows), pa.int32()), *columns], names)

            for place, text in enumerate(batch.column(1)):
                ids = coder.ids(text.as_py()) + END.to_bytes(4, "little")
                count = len(ids) // 4
                for start in range(0, count, capacity):
                    length = min(capacity, count - start)
                    rows.append((start, length, count, seen[length], ids[4 * start:4 * (start + length)]))
                    places.append(place)
                    seen[length] += 1
                held += len(ids)
                if held > FLUSH_BYTES:
                    yield flush()
                    rows, places, held = [], [], 0
            if rows:
                yield flush()
        coder.forget()
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bound_batches(docs).select("doc_id", text_or_empty().alias("text")).mapInArrow(cut, PIECE.format(id=kind))


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, carry: Column | None = None) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids) for every piece of ``docs(doc_id, text, ...)``.

    A null or empty text is one piece with the end id alone. Repeated rows are packed as often as they occur. An empty table packs
    to an empty one. Other columns are not read. ``carry`` replaces the ids by an expression over them, so that a caller
    who needs a digest only doesn't move the ids.
    """
    cut = store(pieces(docs, vocabulary or default_vocabulary(), capacity))
    counts = store(cut.groupBy("part", "length").agg(F.count("*").alias("held")))
    ahead = F.sum("held").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = store(counts.select("part", "length", F.coalesce(ahead, F.lit(0)).alias("ahead")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("held").alias("n")).collect()}
    spots = docs.sparkSession.createDataFrame(
        list(places(patterns(histogram, capacity))), "of long, low long, high long, sequence long, times long, at long")
    carried = (F.col("ids") if carry is None else carry).alias("ids")
    ranked = lookup(cut.select("doc_id", "part", "start", "length", "doc_tokens", "local", carried), ahead, ["part", "length"])
    ranked = ranked.withColumn("rank", F.col("local") + F.col("ahead"))
    placed = ranked.join(F.broadcast(spots), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    into = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id", "start", "length", "doc_tokens", (F.col("sequence") + F.floor(into / F.col("times"))).alias("sequence_id"),
        (F.col("at") + into % F.col("times") * F.col("length")).alias("offset"), "ids")
