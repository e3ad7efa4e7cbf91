"""Trees of JSON files: one document a file, of whatever shape, described by its path.

Bodies are read as VARIANT, since inferring a common schema loses keys whose values are empty objects and files that hold an
empty array. A file named X.layout.json is the companion of X.json in the same folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAYOUT = ".layout.json"


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """One row a file: path (below root), folder, name, domain (first folder), entity, purpose, kind, stem and body.

    kind is layout or base; entity is the name up to the first underscore, purpose what follows the last one.
    """
    read = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("singleVariantColumn", "body")
    base = root.rstrip("/").split("/")[-1]
    path = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), f"/\\Q{base}\\E/(.*)$", 1)
    df = read.json(root).select(path.alias("path"), "body")
    name = F.element_at(F.split("path", "/"), -1)
    bare = F.regexp_replace(name, r"(\.layout)?\.json$", "")
    return df.select(
        "path",
        F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"),
        name.alias("name"),
        F.element_at(F.split("path", "/"), 1).alias("domain"),
        F.element_at(F.split(bare, "_"), 1).alias("entity"),
        F.element_at(F.split(bare, "_"), -1).alias("purpose"),
        F.when(F.endswith(name, F.lit(LAYOUT)), "layout").otherwise("base").alias("kind"),
        F.regexp_replace("path", r"(\.layout)?\.json$", "").alias("stem"),
        "body",
    )


def scan_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The elements of array files as rows; an empty array gives none."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def companions(tree: DataFrame) -> DataFrame:
    """Layout files with has_base: whether the file that they belong to exists."""
    base = tree.filter("kind = 'base'").select(F.col("stem").alias("s"), F.lit(True).alias("has_base"))
    return tree.filter("kind = 'layout'").join(base, F.col("stem") == F.col("s"), "left").select("path", "stem", F.coalesce("has_base", F.lit(False)).alias("has_base"))


def without_layout(tree: DataFrame) -> DataFrame:
    """Base files that have no companion."""
    return tree.filter("kind = 'base'").join(tree.filter("kind = 'layout'").select("stem"), "stem", "left_anti")


def with_layout(tree: DataFrame) -> DataFrame:
    """Base files that have a companion."""
    return tree.filter("kind = 'base'").join(tree.filter("kind = 'layout'").select("stem"), "stem", "left_semi")


def profile(tree: DataFrame) -> DataFrame:
    """Files and distinct bodies by domain and kind, with subtotals (null)."""
    return tree.withColumn("text", F.to_json("body")).rollup("domain", "kind").agg(F.count("*").alias("files"), F.count_distinct(F.md5("text")).alias("bodies"))


def shapes(tree: DataFrame) -> DataFrame:
    """Distinct bodies with their number of files, variant schema and top-level keys."""
    own = tree.select(F.to_json("body").alias("text"), F.schema_of_variant("body").alias("shape"))
    return own.groupBy("text", "shape").agg(F.count("*").alias("files")).withColumn("keys", F.json_object_keys("text"))


def entries(tree: DataFrame, key: str) -> DataFrame:
    """The elements of an array or the values of a map under a top-level key: path, name (null in arrays), entry. Empty ones give no row."""
    text = F.get_json_object(F.to_json("body"), f"$.{key}")
    listed = F.transform(F.try_variant_get("body", f"$.{key}", "array<variant>"), lambda v: F.struct(F.lit(None).cast("string").alias("name"), v.alias("entry")))
    named = F.transform(F.map_entries(F.when(F.startswith(text, F.lit("{")), F.from_json(text, "map<string,variant>"))), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("entry")))
    return tree.select("path", F.explode(F.coalesce(listed, named)).alias("x")).select("path", "x.name", "x.entry")


def scalar(key: str, kind: str) -> Column:
    """A top-level value where it has the kind (string, bigint, double...), null where it has another."""
    return F.try_variant_get("body", f"$.{key}", kind)
