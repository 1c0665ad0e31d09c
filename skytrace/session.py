"""Session helpers: reliable lineage cuts and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup side of at most this many (narrow) rows is broadcast; a larger one is salted. Several are on the driver at once.
BROADCAST_ROWS = 100_000
SALTS = 16


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a temporary one on a local master only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="skytrace-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and gives later stages a short lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write a table below the checkpoint folder and read it back.

    Cuts lineage like :func:`cut`, and gives later joins the table's true size: use it for tables that are joined often.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """:func:`store` for tables of narrow rows whose number grows with the input.

    Their files are small, but packed numbers take many times that size in a broadcast, which the driver builds. So they are broadcast by their
    size only within ``BROADCAST_ROWS``; beyond that their joins merge.
    """
    return counted(store(df))


def counted(table: DataFrame) -> DataFrame:
    """A table read from files, as :func:`keep` returns it."""
    rows = table.count()
    if rows > BROADCAST_ROWS:
        table = table.hint("merge")
    _COUNTS[table] = rows
    return table


_COUNTS: WeakKeyDictionary = WeakKeyDictionary()


def row_count(df: DataFrame) -> int:
    """Rows of a stored table, counted once."""
    if df not in _COUNTS:
        _COUNTS[df] = df.count()
    return _COUNTS[df]


def attach(
    big: DataFrame, small: DataFrame, on: list[str], salt_by: str, how: str = "inner", part_of: DataFrame | None = None
) -> DataFrame:
    """Join a per-key lookup onto rows whose keys may be hot (a scan may hold a third of all rows).

    The lookup is counted first; ``part_of`` names a stored table it is a subset of, whose count then serves as
    the bound. Within the limit it is broadcast; beyond it every lookup row is copied per salt and the big
    side is spread by a hash of ``salt_by``, so one hot key reaches many tasks.
    """
    rows = row_count(part_of) if part_of is not None else small.limit(BROADCAST_ROWS + 1).count()
    if rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    return spread.join(salted, [*on, "_salt"], how).drop("_salt")
