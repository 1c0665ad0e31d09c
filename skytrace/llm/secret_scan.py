"""Secret scan with a battery of randomness tests, in DataFrame functions only.

Base kinds are patterns. The battery looks at every run of at least 16 letters, digits and ``+/_-`` that mixes character classes, infers its
encoding and measures three things: chi-squared uniformity over the encoding's alphabet, the number of runs of character
classes, and the lag-one serial correlation of alphabet positions. Each is compared with what a run made of ordinary words and numbers would
give at that length (its mean and spread grow with the length, so short runs hardly ever stand out), the three are averaged
into one z, and exp(-z^2/2) bounds its tail. Within each length class the false-discovery rate over all runs of all documents is held
by the step-up rule, on a histogram of the bounds that has a fixed number of bins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytrace.llm.common import let, text_or_empty
from skytrace.session import store

# The base kinds' patterns, in the order in which equal starts are listed. The runs that the contract drops for
# their length can't hide a longer one of their kind, except for assignments, whose length is checked afterwards.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
RUN = "[A-Za-z0-9+/_-]{16,}"
ASSIGN_VALUE = 6
PIECE = 128
KINDS = ("assign", "access", "hex", "random")


@dataclass(frozen=True)
class Encoding:
    name: str
    pattern: str
    alphabet: str
    coincidence: float  # chance that two characters of ordinary text in this alphabet agree


# Tried in this order. Coincidence of English letters 0.066; 0.12 where only digits and six letters occur.
ENCODINGS = (
    Encoding("hex", "^[0-9a-f]+$", "0123456789abcdef", 0.12),
    Encoding("upper hex", "^[0-9A-F]+$", "0123456789ABCDEF", 0.12),
    Encoding("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.066),
    Encoding("base36", "^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 0.066),
    Encoding("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.066),
)


@dataclass(frozen=True)
class BatteryParams:
    rate: float = 0.001  # false-discovery rate within a length class
    word_changes: float = 0.15  # class changes per character in names made of words and numbers
    word_correlation: float = 0.35  # serial correlation of such names
    length_class: int = 16
    classes: int = 32
    bins: int = 400  # of width 1/8 on the scale of z^2/2


def _matches(text: Column, pattern: str, keep: Column | None = None) -> Column:
    """[(start, end, found)] of a pattern in code points: the lengths of what lies between the matches add up."""
    width = lambda x: F.length(x["gap"]) + F.length(x["hit"])
    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def zipped(found: Column) -> Column:
        return F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"), found.alias("hit"))

    # appending copies the list, so no list grows with the text: pieces of bounded size, and one number per piece
    def pieces(pairs: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / PIECE).cast("int")), lambda i: F.slice(pairs, i * PIECE + 1, F.lit(PIECE)))
        return F.transform(cut, lambda c: F.struct(c.alias("c"), F.aggregate(c, F.lit(0), lambda n, x: n + width(x)).alias("n")))

    def starts(sized: Column) -> Column:
        return F.aggregate(
            sized, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, s: F.struct((a["at"] + s["n"]).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    def walk(c: Column, start: Column) -> Column:
        return F.aggregate(
            c, F.struct(start.alias("at"), empty.alias("out")),
            lambda a, x: F.struct(
                (a["at"] + width(x)).alias("at"),
                F.array_append(a["out"], F.struct((a["at"] + F.length(x["gap"])).alias("start"), (a["at"] + width(x)).alias("end"), x["hit"].alias("hit"))).alias("out")),
            lambda a: a["out"])

    walked = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(zipped(found), lambda pairs: let(
        pieces(pairs), lambda sized: F.flatten(F.zip_with(sized, starts(sized), lambda s, at: walk(s["c"], at))))))
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def _mixed(run: Column) -> Column:
    """At least two of lower case, upper case and digits."""
    return sum((run.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]")), F.lit(0)) >= 2


def _pick(run: Column, value) -> Column:
    out = F.lit(value(ENCODINGS[-1]))
    for e in reversed(ENCODINGS[:-1]):
        out = F.when(run.rlike(e.pattern), F.lit(value(e))).otherwise(out)
    return out


def battery(run: Column, p: BatteryParams) -> Column:
    """z of one run: how far its three statistics are from those of ordinary names, towards randomness."""
    return let(F.translate(run, "-_", "+/"), lambda text: let(_pick(run, lambda e: e.alphabet), lambda alphabet: _z(run, text, alphabet, p)))


def _z(run: Column, text: Column, alphabet: Column, p: BatteryParams) -> Column:
    coincidence = _pick(run, lambda e: e.coincidence)
    n, size = F.length(run).cast("double"), F.length(alphabet).cast("double")
    squares = F.aggregate(
        F.sequence(F.lit(1), F.length(alphabet)), F.lit(0.0),
        lambda a, i: a + F.pow((F.length(text) - F.length(F.replace(text, F.substr(alphabet, i, F.lit(1)), F.lit("")))).cast("double"), F.lit(2.0)))
    chi = size / n * squares - n
    excess = size * coincidence - 1
    uniform = (size - 1 + n * excess - chi) / F.sqrt(2 * (size - 1) + 4 * n * excess)
    runs = F.size(F.regexp_extract_all(text, F.lit("[a-z]+|[A-Z]+|[0-9]+|[+/]+"), F.lit(0)))
    changes = (runs - 1 - (n - 1) * p.word_changes) / F.sqrt((n - 1) * p.word_changes * (1 - p.word_changes))

    def correlation(off: Column) -> Column:
        spread = F.aggregate(off, F.lit(0.0), lambda a, x: a + x * x)
        pairs = F.zip_with(F.slice(off, 1, F.length(run) - 1), F.slice(off, 2, F.length(run) - 1), lambda a, b: a * b)
        return F.when(spread > 0, F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / spread).otherwise(F.lit(1.0))

    def lagged(at: Column) -> Column:
        mean = F.aggregate(at, F.lit(0.0), lambda a, x: a + x) / n
        return let(mean, lambda m: let(F.transform(at, lambda x: x - m), correlation))

    at = F.transform(F.split(text, ""), lambda c: F.instr(alphabet, c).cast("double"))
    serial = (p.word_correlation - F.abs(let(at, lagged))) * F.sqrt(n)
    return F.round((uniform + changes + serial) / math.sqrt(3), 6)


def scanned(docs: DataFrame, p: BatteryParams) -> DataFrame:
    """(doc_id, assign, access, hex, runs): the base spans, and the tested runs with length class and histogram bin."""
    text = F.col("text")
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= ASSIGN_VALUE
    rows = rows.select(
        "doc_id", F.filter(_matches(text, ASSIGN), lambda m: value(m["hit"])).alias("assign"), _matches(text, ACCESS).alias("access"), _matches(text, HEX).alias("hex"),
        F.filter(_matches(text, RUN), lambda m: _mixed(m["hit"])).alias("runs"))

    def tested(m: Column) -> Column:
        strength = let(battery(m["hit"], p), lambda z: F.when(z > 0, F.least(F.lit(p.bins - 1), F.floor(z * z / 2 * 8))).otherwise(F.lit(0)).cast("int"))
        group = F.least(F.lit(p.classes), F.floor(F.length(m["hit"]) / p.length_class)).cast("int")
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), group.alias("group"), strength.alias("bin"))

    place = lambda name: F.transform(name, lambda m: F.struct(m["start"], m["end"])).alias(name)
    return rows.select("doc_id", place("assign"), place("access"), place("hex"), F.transform("runs", tested).alias("runs"))


def thresholds(found: DataFrame, p: BatteryParams) -> dict[int, int]:
    """Smallest bin per length class at which the step-up rule holds; the histogram has at most classes x bins rows."""
    rows = found.select(F.explode("runs").alias("r")).groupBy("r.group", "r.bin").agg(F.count("*").alias("n")).collect()
    out: dict[int, int] = {}
    for group in {r["group"] for r in rows}:
        held = {r["bin"]: r["n"] for r in rows if r["group"] == group}
        total, above = sum(held.values()), 0
        for at in range(p.bins - 1, 0, -1):
            above += held.get(at, 0)
            if above and math.exp(-at / 8) <= p.rate * above / total:
                out[group] = at
    return out


def scan_secrets(docs: DataFrame, p: BatteryParams = BatteryParams()) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) for every row of ``docs(doc_id, text, ...)``.

    Spans are kind:start:end in code points, end exclusive, by start, then kind in the order of KINDS. Null and empty texts have none. Kinds may
    overlap; each is listed. Repeated rows give repeated rows. Other columns are not read.
    """
    found = store(scanned(docs, p))
    limits = thresholds(found, p)
    limit = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)) if limits else F.lit(None).cast("map<int,int>")
    chosen = F.filter("runs", lambda r: F.coalesce(r["bin"] >= F.element_at(limit, r["group"]), F.lit(False)))
    rows = found.withColumn("random", F.transform(chosen, lambda r: F.struct(r["start"], r["end"])))

    def joined(kinds: tuple[str, ...]) -> Column:
        def numbered(at: int):
            return lambda m: F.struct(m["start"].alias("start"), F.lit(at).alias("kind"), m["end"].alias("end"))

        parts = [F.transform(kind, numbered(at)) for at, kind in enumerate(kinds)]
        names = F.array(*(F.lit(k) for k in kinds))
        return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(joined(KINDS[:3]), 256).alias("base_sha256"), joined(KINDS).alias("spans"))
