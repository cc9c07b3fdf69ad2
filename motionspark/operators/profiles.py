"""Lens profiles: search, names, best match and expansion."""

from __future__ import annotations

from functools import reduce
from itertools import permutations, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motionspark.functions import text as X
from motionspark.operators import asof

AXIS_CODES = ["".join(c) for p in permutations("XYZ") for c in product(*((x, x.lower()) for x in p))]


def search_profiles(df: DataFrame, text: str, aspect: int = 0, swapped: int = 0, limit: int = 200) -> DataFrame:
    """(id, name, author, favourite, aspect) rows that hold every word, favourites first, then by aspect, swapped aspect and name."""
    hit = df.where(X.matches_words(X.search_words(F.lit(text)), F.col("name"), F.col("author")))
    known = F.col("aspect") != 0
    order = [F.desc("favourite"), F.desc(known & (F.col("aspect") == aspect)), F.desc(known & (F.col("aspect") == swapped)), F.col("name"), F.col("id")]
    return hit.orderBy(*order).limit(limit)


def unique_names(df: DataFrame) -> DataFrame:
    """Adds ``shown``: names that repeat take their author with them, two at a time, in the order of id.

    The last of an odd number keeps the bare name.  The second of each two is numbered from 2 on where one
    before it already shows the same name and author.
    """
    names, same = Window.partitionBy("name"), Window.partitionBy("name", "author")
    df = df.withColumn("_k", F.row_number().over(names.orderBy("id"))).withColumn("_all", F.count(F.lit(1)).over(names))
    df = df.withColumn("_second", F.col("_k") % 2 == 0).withColumn("_first", F.min("_k").over(same))
    earlier = F.sum(F.col("_second").cast("int")).over(same.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    number = earlier + F.when(F.col("_first") % 2 == 1, 1).otherwise(0)
    authored = F.concat(F.col("name"), F.lit(" by "), F.coalesce("author", F.lit("")))
    numbered = F.when(F.col("_second") & (F.col("_number") > 1), F.concat(authored, F.lit(" - "), F.col("_number").cast("string"))).otherwise(authored)
    shown = F.when(~F.col("_second") & (F.col("_k") == F.col("_all")), F.col("name")).otherwise(numbered)
    return df.withColumn("_number", number).withColumn("shown", shown).drop("_k", "_all", "_second", "_first", "_number")


def match_profiles(recordings: DataFrame, profiles: DataFrame) -> DataFrame:
    """(recording_id, id): the identifier's profile; else of the same camera by size and rate, by size, or by aspect.

    Sides: recordings (recording_id, camera, identifier, width, height, fps) and profiles (id, camera,
    identifier, width, height, fps); of equals the smallest id.  Aspects count a hundredth and so do rates.  A
    profile of the same aspect and rate gives way to one of the same size or of the same aspect alone, which
    every such recording has, hence it never stands.  Recordings without any have no row.
    """
    aspect = F.round(F.col("width") * 100 / F.greatest(F.col("height"), F.lit(1)))
    keyed = lambda df: df.select("*", F.round(F.col("fps") * 100).alias("_rate"), aspect.alias("_aspect"))
    r, p = keyed(recordings), keyed(profiles)
    steps = [
        (r.where("identifier != ''"), ["camera", "identifier"]),
        (r, ["camera", "width", "height", "_rate"]),
        (r, ["camera", "width", "height"]),
        (r, ["camera", "_aspect"]),
    ]
    # Each step looks up the smallest id of its key, so a camera's recordings and profiles are never paired.
    hits = [left.join(p.groupBy(*on).agg(F.min("id").alias("id")), on).select("recording_id", F.lit(i).alias("rank"), "id") for i, (left, on) in enumerate(steps)]
    found = reduce(DataFrame.unionByName, hits).where("id IS NOT NULL")
    return found.groupBy("recording_id").agg(F.min(F.struct("rank", "id")).alias("b")).select("recording_id", "b.id")


def swap_portrait(df: DataFrame) -> DataFrame:
    """Width and height, and the matrix's focal lengths and centres, change places."""
    return df.withColumns({"width": F.col("height"), "height": F.col("width"), "fx": F.col("fy"), "fy": F.col("fx"), "cx": F.col("cy"), "cy": F.col("cx")})


def interpolated(left: DataFrame, knots: DataFrame, columns: list[str], whole: tuple[str, ...] = ("width", "height"), on: str = "focal", by: tuple[str, ...] = ("id",)) -> DataFrame:
    """``left`` with the profile's numbers at its focal position: between the knots and beyond them by straight lines, ``whole`` ones rounded.

    Positions count in millionths.  One knot is a constant, a profile without knots gives null.
    """
    key = F.round(F.col(on) * 1_000_000).cast("long")
    values = F.array(*(F.col(c).cast("double") for c in columns))
    blend = lambda a, b, t: F.zip_with(a, b, lambda x, y: x * (1 - t) + y * t)
    k = knots.select(*by, key.alias("_key"), values.alias("_values"))
    got = asof.interpolate(left.withColumn("_key", key), k, "_values", on="_key", by=by, mix=blend)
    return got.withColumns({c: F.round(F.get("_values", F.lit(i))) if c in whole else F.get("_values", F.lit(i)) for i, c in enumerate(columns)}).drop("_key", "_values")


def same_shape(files: DataFrame, by: str) -> DataFrame:
    """(group, mergeable): whether all files of a group have one size, rate (in hundredths) and rotation."""
    shape = F.struct("width", "height", F.round(F.col("fps") * 100).alias("fps"), "rotation")
    return files.groupBy(by).agg((F.count_distinct(shape) == 1).alias("mergeable"))


def duplicates(df: DataFrame, coefficients: list[str], name: str = "name") -> DataFrame:
    """(coefficients, names) of profiles that share all coefficients, names in order without regard to case."""
    entry = F.struct(F.lower(F.trim(name)).alias("k"), F.col(name).alias("n"))
    names = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["n"])  # of one lens there are few
    return df.groupBy(*coefficients).agg(names.alias("names")).where(F.size("names") > 1)
