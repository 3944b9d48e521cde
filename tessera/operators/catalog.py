"""Listing, lookup, union, overlay and comparison of catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import decoded_length, human_size, name_ok, num_elements, shape_text, size_of
from ..model import MAX_RANK, InvalidInput, NotFound, Rejected


def with_sizes(parts: DataFrame) -> DataFrame:
    """Adds nbytes: decoded bytes of each part."""
    return parts.withColumn("nbytes", decoded_length(F.col("encoding"), F.col("decoded_length"), F.col("length")))


def listing(objects: DataFrame, parts: DataFrame) -> DataFrame:
    """One row for each object by name: the first part's type, its shape, decoded bytes, and the same for people."""
    sized = with_sizes(parts).groupBy("name").agg(F.min_by("dtype", "part").alias("dtype"), F.sum("nbytes").alias("nbytes"), F.count(F.lit(1)).alias("n_parts"))
    out = objects.join(sized, "name", "left").select("name", "dtype", shape_text(F.col("shape")).alias("shape"), "layout", F.coalesce("n_parts", F.lit(0)).alias("n_parts"), F.coalesce("nbytes", F.lit(0)).alias("nbytes"))
    return out.withColumn("human", human_size(F.col("nbytes")))


def lookup(objects: DataFrame, name: str) -> DataFrame:
    """The object of a name; raises NotFound if there is none. The filter reaches the scan."""
    found = objects.where(F.col("name") == name)
    if found.isEmpty():
        raise NotFound(name)
    return found


def members(names: DataFrame, objects: DataFrame) -> DataFrame:
    """Those of the names that are in the catalog."""
    return names.join(objects, "name", "left_semi")


def only_part(parts: DataFrame) -> DataFrame:
    """(name, part, choices): the single part of each object; part is null where there are several, and choices names them."""
    got = parts.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list("part")).alias("_p"))
    return got.select("name", F.when(F.col("_n") == 1, F.element_at("_p", 1)).alias("part"), F.array_join("_p", ",").alias("choices"))


def collisions(sources: list[DataFrame]) -> DataFrame:
    """(name, n_sources) of the names that more than one source has, also where the contents are equal."""
    named = [s.select("name", F.lit(i).alias("source")) for i, s in enumerate(sources)]
    both = named[0]
    for n in named[1:]:
        both = both.union(n)
    got = both.groupBy("name").agg(F.countDistinct("source").alias("n_sources"))
    return got.where("n_sources > 1")


def merge(sources: list[tuple[DataFrame, int]], check: bool = True) -> DataFrame:
    """The union of the parts of several sources, each given with its number of stores, by which the next ones' ids move."""
    if not sources:
        raise InvalidInput("no sources")
    if check and (hit := collisions([p for p, _ in sources]).first()) is not None:
        raise Rejected("NameCollision", hit["name"])
    base, out = 0, None
    for parts, stores in sources:
        moved = parts.withColumn("store_id", F.col("store_id") + F.lit(base))
        out = moved if out is None else out.unionByName(moved)
        base += stores
    return out


def overlay(base: DataFrame, local: DataFrame) -> DataFrame:
    """Local objects, and those of the base that they don't replace; origin tells which."""
    kept = base.join(local.select("name").distinct(), "name", "left_anti").withColumn("origin", F.lit("base"))
    return kept.unionByName(local.withColumn("origin", F.lit("local")))


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, part, change): objects added or removed; else, for parts of the left side only, a changed shape, layout or digest.

    Both sides have name, part, shape (text), layout and digest."""
    a = left.select("name", "part", F.struct("shape", "layout").alias("form"), "digest")
    b = right.select("name", "part", F.struct("shape", "layout").alias("form"), "digest")
    names = a.select("name").distinct().withColumn("l", F.lit(1)).join(b.select("name").distinct().withColumn("r", F.lit(1)), "name", "full_outer")
    whole = names.where("l IS NULL OR r IS NULL").select("name", F.lit(None).cast("string").alias("part"), F.when(F.col("l").isNull(), "added").otherwise("removed").alias("change"))
    forms = b.groupBy("name").agg(F.min("form").alias("form2"))
    met = a.join(forms, "name").join(b.select("name", "part", F.col("digest").alias("digest2")), ["name", "part"], "left")
    how = F.when(F.col("form") != F.col("form2"), "form").when(~F.col("digest").eqNullSafe(F.col("digest2")), "content")
    return whole.union(met.select("name", "part", how.alias("change")).where("change IS NOT NULL"))


def latest_generation(parts: DataFrame, generation: str = "generation") -> DataFrame:
    """Of appended generations, each part's last."""
    last = Window.partitionBy("name", "part").orderBy(F.desc(generation))
    return parts.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def metadata_violations(objects: DataFrame, parts: DataFrame) -> DataFrame:
    """(name, part, rule) of names, shapes and dense sizes that break a rule."""
    none = F.lit(None).cast("string").alias("part")
    names = objects.where(~name_ok(F.col("name"))).select("name", none, F.lit("Name").alias("rule"))
    part_names = parts.where(~name_ok(F.col("part"))).select("name", "part", F.lit("Name").alias("rule"))
    bad = (F.size("shape") > MAX_RANK) | num_elements(F.col("shape")).isNull()
    shapes = objects.where(bad).select("name", none, F.lit("Shape").alias("rule"))
    sized = dense_sizes(objects, parts).where("needed IS NOT NULL AND needed <> nbytes")
    return names.union(part_names).union(shapes).union(sized.select("name", "part", F.lit("DenseSize").alias("rule")))


def dense_sizes(objects: DataFrame, parts: DataFrame) -> DataFrame:
    """Parts of dense objects, with the bytes that shape and type require."""
    dense = objects.where("layout = 'dense'").select("name", num_elements(F.col("shape")).alias("n"))
    got = with_sizes(parts).join(dense, "name")
    return got.withColumn("needed", size_of(F.col("logical"), F.col("dtype"), F.col("n")))
