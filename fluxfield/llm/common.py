"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxfield.plans.staging import Rounds, counted, new_path, sized, stored  # noqa: F401

#: White space between words, as a regular expression that Java, RE2 and Python read alike.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, **own: Column) -> DataFrame:
    """Rows of docs as one column `doc`, and own columns beside it, whose names cannot clash with those of docs."""
    return docs.select(F.struct("*").alias("doc"), *[c.alias(k) for k, c in own.items()])


def words_of(text: Column) -> Column:
    """The words of a text in order; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def int_array(values: list[int]) -> Column:
    """A constant array of integers; the optimizer folds it to one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once a row, however often a lambda in body refers to it."""
    return F.transform(F.array(value), body)[0]
