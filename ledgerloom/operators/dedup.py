"""First-wins and last-wins deduplication, and joins that keep or drop known keys.

Spark has no row order, so every operator takes the columns that define it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ledgerloom.functions.columns import named, whole_row
from ledgerloom.store import discard, stash

Keys = Sequence[str | Column]


def first_wins(df: DataFrame, keys: Keys, order: Keys, *, keep_blank: bool = False) -> DataFrame:
    """The first row of each key in the order. keep_blank keeps all rows whose only key is empty or null.

    The row travels as one struct under min_by, so equal keys are combined before the shuffle.
    """
    row = whole_row(df)
    at = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    by = [(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)]
    held = df.select(row.alias("_row"), at.alias("_at"), *by)
    names = [f"_k{i}" for i in range(len(keys))]
    blank = F.coalesce(F.col("_k0"), F.lit("")) == "" if keep_blank else F.lit(False)
    kept = held.where(~blank).groupBy(*names).agg(F.min_by("_row", "_at").alias("_row")).select("_row.*")
    return kept.unionByName(held.where(blank).select("_row.*")) if keep_blank else kept


def last_wins(df: DataFrame, keys: Keys, order: Keys) -> DataFrame:
    """The last row of each key in the order."""
    row, at = whole_row(df), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    return df.groupBy(*keys).agg(F.max_by(row, at).alias("_row")).select("_row.*")


def capped(df: DataFrame, n: int, order: Keys, within: Keys = ()) -> DataFrame:
    """The first n rows of each group in the order (of all rows without a group)."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    if not within:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def not_in(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the known ones; empty keys are dropped."""
    return df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").join(known.select(key).distinct(), key, "left_anti")


def allowed(df: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """Rows whose name, cut to letters and digits, is on the list; an empty list allows all."""
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    listed = names.select(plain(F.col(name)).alias("_name")).where("_name <> ''").distinct()
    if listed.isEmpty():
        return df
    return df.withColumn("_name", plain(F.col(name))).join(listed, "_name", "left_semi").drop("_name")


def new_rows(df: DataFrame, table: DataFrame | None, token: str, order: Keys) -> DataFrame:
    """What an append adds: the first row of each token that isn't in the table yet."""
    fresh = first_wins(df.where(F.coalesce(F.col(token), F.lit("")) != ""), [token], order)
    return fresh if table is None else fresh.join(table.select(token).distinct(), token, "left_anti").select(*df.columns)


#: Undecided rows that one task decides in order, at most (three values each).
FEW_ROWS = 100_000


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of the rows that a loop keeps; rows come in order."""
    links, ids = set(), set()
    for batch in batches:
        kept = []
        for at, link, ident in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if link not in links and ident not in ids:
                kept.append(at)
                links |= {link} - {None}
                ids |= {ident} - {None}
        yield pa.record_batch([pa.array(kept, batch.schema.field(0).type)], names=["at"])


def greedy_two_keys(df: DataFrame, link: str, ident: str, order: str, *, known: DataFrame | None = None, few: int = FEW_ROWS) -> DataFrame:
    """The rows that a loop in the order keeps, which skips a row whose link or id a kept row has; a skipped row registers neither.

    `order` is a column of unique values that can be compared. Null and empty keys match nothing, and a row with neither is
    dropped. `known` has one column of ids (or links, for rows without an id) that were dealt with before: their rows register like others and are left out.

    A row is decided once the earlier rows that share a key with it are. In each round the rows that are first of both their
    keys are kept, and the undecided rows that share a key with these go; each side of a join has one row a key, or is
    a written table, so a hot key is split. Rounds are few unless rows form long chains; the last `few` rows are decided by one task in order.
    """
    text = lambda c: F.nullif(named(c).cast("string"), F.lit(""))
    live = df.select(named(order).alias("at"), text(link).alias("link"), text(ident).alias("ident")).where("link IS NOT NULL OR ident IS NOT NULL")
    live = stash(live, "undecided")
    kept: list[DataFrame] = []
    while (left := live.count()) > few:
        by_link = live.where("link IS NOT NULL").groupBy("link").agg(F.min("at").alias("at"), F.min_by("ident", "at").alias("ident"))
        by_id = live.where("ident IS NOT NULL").groupBy("ident").agg(F.min("at").alias("at"), F.min_by("link", "at").alias("link"))
        firsts = by_link.where("ident IS NOT NULL").join(by_id.select("at"), "at", "left_semi").select("at", "link", "ident")
        firsts = firsts.unionByName(by_link.where("ident IS NULL")).unionByName(by_id.where("link IS NULL"))
        firsts = stash(firsts, "kept")
        rest = live.join(firsts.where("link IS NOT NULL").select("link"), "link", "left_anti").join(firsts.where("ident IS NOT NULL").select("ident"), "ident", "left_anti")
        rest = stash(rest.select("at", "link", "ident"), "undecided")
        discard(live)
        live, kept = rest, [*kept, firsts.select("at")]
    if left:
        at = live.schema["at"].dataType
        kept.append(live.coalesce(1).sortWithinPartitions("at").mapInArrow(_in_order, T.StructType([T.StructField("at", at)])))
    places = live.select("at").limit(0)
    for part in kept:
        places = places.unionByName(part)
    rows = df.join(places.withColumnRenamed("at", "_at"), named(order) == F.col("_at"), "left_semi")
    if known is None:
        return rows
    told = known.select(F.col(known.columns[0]).cast("string").alias("_known")).distinct()
    return rows.join(told, F.coalesce(text(ident), text(link)) == F.col("_known"), "left_anti")
