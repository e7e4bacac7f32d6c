"""Scalar column functions of the field and of node metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"
NUMERIC_TYPES = r"^(BIGINT|DOUBLE|DECIMAL)"


def sgn_deadzone(x: Column, eps: Column | float = 1e-9) -> Column:
    """+1 above eps, -1 below -eps, else 0; NaN and null give 0. eps may be a column."""
    if not isinstance(eps, Column):
        if eps < 0:
            raise ValueError("the dead zone is negative")
        eps = F.lit(float(eps))
    # Spark orders NaN above every number, so it is taken out first.
    value = F.when(F.isnan(x.cast("double")), 0).when(x > eps, 1).when(x < -eps, -1).otherwise(0)
    return value.cast("tinyint")


def default_weight(text: Column, blank: float | None = 1.0) -> Column:
    """A weight from text; null and blank give `blank`, text that is no number is an error."""
    given = F.trim(F.coalesce(text, F.lit("")))
    number = given.try_cast("double")
    wrong = F.raise_error(F.concat(F.lit("a weight is not a number: "), given)).cast("double")
    return F.when(given == "", F.lit(blank).cast("double")).when(number.isNull(), wrong).otherwise(number)


def as_number(text: Column) -> Column:
    """The number that a text spells, else null."""
    return F.trim(text).try_cast("double")


def parse_object(json: Column) -> Column:
    """A JSON object as map<string, variant>; null, broken JSON and other values give an empty map."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def _number(v: Column) -> Column:
    """A variant that is a JSON number, else 0."""
    return F.when(F.schema_of_variant(v).rlike(NUMERIC_TYPES), F.try_variant_get(v, "$", "double")).otherwise(F.lit(0.0))


def region_score(v: Column) -> Column:
    """pre + post of a JSON object, or a JSON number itself; quoted numbers and the rest score 0."""
    part = lambda k: F.coalesce(_number(F.try_variant_get(v, f"$.{k}", "variant")), F.lit(0.0))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), part("pre") + part("post")).otherwise(_number(v))


def primary_region(json: Column, regions: Column, unknown: str = UNKNOWN) -> Column:
    """The key of highest score (ties: least key), else the first item of a bar-separated list, else unknown."""
    entries = F.transform(F.map_entries(parse_object(json)), lambda e: F.struct((-region_score(e["value"])).alias("score"), e["key"].alias("key")))
    first = F.get(F.filter(F.split(regions, r"\|"), lambda x: x != ""), 0)
    return F.coalesce(F.array_min(entries)["key"], first, F.lit(unknown))


def with_side(label: Column, side: Column, unknown: str = UNKNOWN) -> Column:
    """label_side; the unknown label, and rows without a side, stay as they are."""
    return F.when(side.isNotNull() & (side != "") & (label != unknown), F.concat_ws("_", label, side)).otherwise(label)


def voxel_label(x: Column, y: Column, z: Column, size: float, unknown: str = UNKNOWN) -> Column:
    """floor of each coordinate over the bin size, joined by _; unknown if one is missing."""
    if size <= 0:
        raise ValueError("the bin size is not positive")
    cells = [F.floor(c.cast("double") / F.lit(float(size))).cast("long") for c in (x, y, z)]
    known = x.isNotNull() & y.isNotNull() & z.isNotNull()
    return F.when(known, F.concat_ws("_", *cells)).otherwise(F.lit(unknown))


def side_label(x: Column, midline: float | None) -> Column:
    """L below the midline, else R; null without x. A midline of 0 or None disables sides."""
    if not midline:
        return F.lit(None).cast("string")
    return F.when(x.isNotNull(), F.when(x < F.lit(float(midline)), "L").otherwise("R"))


def coordinate(point: Column, k: int) -> Column:
    """Coordinate k of a list of exactly three, else null."""
    return F.when(F.size(point) == 3, F.get(point, k).cast("double"))


def entropy(*counts: Column) -> Column:
    """Base-2 Shannon entropy of counts; 0 without any."""
    total = sum(counts[1:], counts[0]).cast("double")
    part = lambda c: F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(F.lit(0.0))
    return sum((part(c) for c in counts[1:]), part(counts[0]))


def purity(*counts: Column) -> Column:
    """The largest share; 0 without any."""
    total = sum(counts[1:], counts[0])
    return F.when(total > 0, F.greatest(*counts) / total).otherwise(F.lit(0.0))
