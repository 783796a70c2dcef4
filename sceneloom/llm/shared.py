"""What the operators of this subpackage share: tables cut from their lineage, checked broadcasts, names, row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.session import materialised as cut

__all__ = ["checked_broadcast", "crc_remainder", "cut", "documents", "fold_ascii_column", "fresh", "others", "short_batches"]

#: A side of a join is broadcast only if it has at most so many (narrow) rows; beyond that both sides are shuffled.
BROADCAST_ROWS = 300_000
#: And at most so many entries (whole numbers) in the lists of its rows.
BROADCAST_ENTRIES = 8_000_000

_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def checked_broadcast(table: DataFrame, rows: int | None = None, entries: Column | None = None) -> DataFrame:
    """``table`` (best one from ``cut``) marked for broadcast if it is counted to be small, else as it is.

    ``rows`` is ``BROADCAST_ROWS`` by default.  ``entries`` is the length of a row's lists, where it has any; of these, at most ``BROADCAST_ENTRIES`` in all are broadcast.
    """
    rows = BROADCAST_ROWS if rows is None else rows
    fits = table.limit(rows + 1).count() <= rows
    if fits and entries is not None:
        fits = (table.agg(F.sum(entries.cast("long")).alias("n")).first()["n"] or 0) <= BROADCAST_ENTRIES
    return F.broadcast(table) if fits else table


def others(docs: DataFrame, *made: str) -> list[str]:
    """The columns of ``docs`` but for those that an operator makes anew (in any case)."""
    return [c for c in docs.columns if c.lower() not in made]


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names for internal columns: those given, with underlines before them where ``docs`` has such a column."""
    taken, found = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def fold_ascii_column(text: Column) -> Column:
    """A-Z in lower case and nothing else changed."""
    return F.translate(text, _ASCII_UPPER, _ASCII_LOWER)


def crc_remainder(doc_id: Column, modulus: int = 4) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def short_batches(spark: SparkSession, rows: int = 500) -> None:
    """Texts go to Python in batches of at most so many rows, unless the session has fewer already: what a worker and the JVM hold outside the heap stays small.

    A plan is run after the function that made it has returned, so the setting stays with the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    have = int(spark.conf.get(key, "10000"))
    if have <= 0 or have > rows:
        spark.conf.set(key, str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
