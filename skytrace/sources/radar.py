"""Radar composites: a text header up to ETX, then one or two bytes per pixel, rows from south to north.

Files come in as rows (name, content), so that any store that Spark reads will do; one file is one bounded grid. What can't be decoded is
listed with the reason, never dropped silently.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values. One byte: value = 0.5 * byte - 32.5 dBZ; 250 marks missing, 249 clutter. Two bytes, low one first: twelve bits of value times the header's
# precision, then flags for secondary data, missing, negative and clutter.
ONE_BYTE = ("RX", "EX")
TWO_BYTES = ("RZ", "RY", "RV", "EZ", "RH", "RB", "RW", "RL", "RU", "RS", "RQ", "SQ", "SH", "SF")
SCALE, OFFSET = 0.5, -32.5
BYTE_MISSING, BYTE_CLUTTER = 250, 249
VALUE_BITS, SECONDARY, MISSING, NEGATIVE, CLUTTER = 0x0FFF, 0x1000, 0x2000, 0x4000, 0x8000
ETX = b"\x03"


@dataclass(frozen=True)
class Composite:
    product: str
    ts: int
    columns: int
    raw: np.ndarray
    value: np.ndarray  # NaN where missing or clutter
    missing: np.ndarray
    clutter: np.ndarray
    secondary: np.ndarray


def decode(content: bytes, products: tuple[str, ...] = ONE_BYTE + TWO_BYTES) -> Composite | str:
    """A composite, or why the content isn't one of ``products``."""
    head, end, body = content.partition(ETX)
    text = head.decode("latin-1")
    size = re.search(r"GP\s*(\d+)\s*x\s*(\d+)", text)
    if not end or size is None:
        return "no header with a grid size"
    product = text[:2]
    if product not in products:
        return f"product {product} is not a one-byte composite" if products == ONE_BYTE else f"product {product} is not known"
    try:
        at = datetime.strptime(text[2:8] + text[13:17], "%d%H%M%m%y").replace(tzinfo=timezone.utc)
    except ValueError:
        return "no time in the header"
    rows, columns = (int(v) for v in size.groups())
    width = 1 if product in ONE_BYTE else 2
    if len(body) < width * rows * columns:
        return f"{len(body) // width} of {rows * columns} pixels"
    raw = np.frombuffer(body, "<u1" if width == 1 else "<u2", rows * columns).astype(np.int32)
    if width == 1:
        missing, clutter, secondary = raw == BYTE_MISSING, raw == BYTE_CLUTTER, np.zeros(len(raw), bool)
        value = raw * SCALE + OFFSET
    else:
        precision = re.search(r"PR\s*E([+-]\d\d)", text)
        if precision is None:
            return "no precision in the header"
        missing, clutter, secondary = ((raw & flag) != 0 for flag in (MISSING, CLUTTER, SECONDARY))
        value = (raw & VALUE_BITS) * 10.0 ** int(precision[1]) * np.where(raw & NEGATIVE, -1, 1)
    return Composite(product, int(at.timestamp()), columns, raw, np.where(missing | clutter, np.nan, value), missing, clutter, secondary)


def encode(product: str, ts: int, rows: int, columns: int, raw: np.ndarray, precision: int = 0) -> bytes:
    """The content of a composite; ``raw`` are its pixels with their flags."""
    at = datetime.fromtimestamp(ts, timezone.utc)
    head = f"{product}{at:%d%H%M}10000{at:%m%y}BY{rows * columns * (1 if product in ONE_BYTE else 2):7d}VS 3SW   1.0.0PR E{precision:+03d}INT   5GP{rows:4d}x{columns:4d}MS  0"
    return head.encode() + ETX + np.asarray(raw).astype("<u1" if product in ONE_BYTE else "<u2").tobytes()


def composite_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the files below a path."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def encoded(cells: DataFrame, rows: int, columns: int) -> DataFrame:
    """(name, content): one composite per name from ``cells(name, product, ts, precision, pid, raw)``; pixels without a cell are missing."""
    scans = cells.groupBy("name", "product", "ts", "precision").agg(F.collect_list("pid").alias("pids"), F.collect_list("raw").alias("raws"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                raw = np.full(rows * columns, BYTE_MISSING if row["product"] in ONE_BYTE else MISSING, np.int64)
                raw[row["pids"]] = row["raws"]
                out.append((row["name"], encode(row["product"], row["ts"], rows, columns, raw, row["precision"])))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.string()), pa.array([c for _, c in out], pa.binary())], ["name", "content"])

    return scans.mapInArrow(run, "name string, content binary")


def pixels(files: DataFrame, products: tuple[str, ...] = ONE_BYTE + TWO_BYTES, threshold: float | None = None) -> DataFrame:
    """(name, product, ts, y, x, raw, value, missing, clutter, secondary): every pixel of the files (name, content) that hold one of the products.

    A value is NULL where it is missing or clutter. Values below the threshold become the product's least: -32.5 dBZ, or no rain.
    """
    names = ["name", "product", "ts", "y", "x", "raw", "value", "missing", "clutter", "secondary"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                c = decode(content.as_py() or b"", products)
                if isinstance(c, str):
                    continue  # rejects() lists it
                y, x = np.divmod(np.arange(len(c.raw), dtype=np.int32), np.int32(c.columns))
                fixed = [pa.array([v] * len(y), k) for v, k in ((name, pa.string()), (c.product, pa.string()), (c.ts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(y), pa.array(x), pa.array(c.raw), pa.array(c.value, from_pandas=True), *map(pa.array, (c.missing, c.clutter, c.secondary))], names)

    kinds = "name string, product string, ts long, y int, x int, raw int, value double, missing boolean, clutter boolean, secondary boolean"
    out = files.select("name", "content").mapInArrow(run, kinds)
    if threshold is None:
        return out
    least = F.when(F.col("product").isin(*ONE_BYTE), F.lit(OFFSET)).otherwise(F.lit(0.0))
    return out.withColumn("value", F.when(F.col("value") < F.lit(float(threshold)), least).otherwise(F.col("value")))


def rejects(files: DataFrame, products: tuple[str, ...] = ONE_BYTE + TWO_BYTES) -> DataFrame:
    """(name, reason) of the files that :func:`pixels` leaves out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1))
            found = [(n, r) for n, c in pairs if isinstance(r := decode(c.as_py() or b"", products), str)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.string()), pa.array([r for _, r in found], pa.string())], ["name", "reason"])

    return files.select("name", "content").mapInArrow(run, "name string, reason string")
