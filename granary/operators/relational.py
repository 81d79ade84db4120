"""Paging, upserts, guards, ordered choices: relational operators as functions of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of the ordered rows; ``order`` has to be total."""
    if not 1 <= size <= 100 or number < 1:
        raise ValueError("pages start at 1 and have 1 to 100 rows")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def best_per(rows: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows of each key; Spark cuts to k per task before it shuffles."""
    name = rank or "_rank"
    got = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return got if rank else got.drop(name)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key and are added where there is none."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of a key that ``new`` has go, then its rows are added."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def first_rule(rows: DataFrame, rules: DataFrame, matches: Column, key: list[str], order: str) -> DataFrame:
    """Each row with the first rule that matches it; rows without one are dropped. ``rules`` is a small table of fixed size."""
    hit = rows.join(F.broadcast(rules), matches)
    rest = [c for c in rules.columns if c != order]
    keep = [c for c in rows.columns if c not in key]
    picked = hit.groupBy(*key).agg(F.min_by(F.struct(*keep, *rest), F.col(order)).alias("m"))
    return picked.select(*key, "m.*")


def settings_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, value, description): a new value replaces the old one, a blank description keeps it."""
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, "key", "full").select("key", F.coalesce("n.value", "o.value").alias("value"), F.coalesce(F.nullif(F.col("n.description"), F.lit("")), F.col("o.description")).alias("description"))


def fallback(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``first``; for keys that it lacks, those of ``second``."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def translate_once(rows: DataFrame, column: str, translate, to: str) -> DataFrame:
    """Each distinct text goes through an expensive function once; a failure (null) keeps the text behind a mark, blanks pass."""
    blank = F.trim(F.coalesce(F.col(column), F.lit(""))) == ""
    once = rows.where(~blank).select(column).distinct().withColumn(to, translate(F.col(column)))
    out = rows.join(once, column, "left")
    return out.withColumn(to, F.when(blank, F.col(column)).otherwise(F.coalesce(F.col(to), F.concat(F.lit("[untranslated] "), F.col(column)))))
