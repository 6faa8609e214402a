"""A nested JSON value as its strings and keys, each with a path, by variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels of nesting that are taken apart; what is nested deeper is one string, its JSON.
DEPTH = 16
# Digests and names that are checked elsewhere, and so aren't text of a page.
CHECKED = r"^root\.context\.visualPrivacy\.(?:imageSha256|modelSha256|schema|faceModel)(?:\.|$)"


def strings_of(rows: DataFrame, column: str, depth: int = DEPTH) -> DataFrame:
    """A row for each string or key: the other columns, path, string; a key has its object's path, numbers are measurements.

    Each level takes the containers of all rows apart by one more, without a shuffle: a value that is no
    container, or is empty, stays as it is.  Text that is no JSON has no strings.
    """
    kept = [c for c in rows.columns if c != column]
    levels = rows.select(F.struct(*kept).alias("_row"), F.lit("root").alias("_path"), F.lit(None).cast("string").alias("_key"), F.try_parse_json(F.col(column)).alias("_value"))
    child = F.concat_ws(".", "_path", F.coalesce(F.col("_child.key"), F.col("_child.pos").cast("string")))
    nothing = F.lit(None).cast("variant")
    found = [F.struct(child.alias("path"), F.lit(None).cast("string").alias("key"), F.col("_child.value").alias("value"))]
    name = [F.struct(F.col("_path").alias("path"), F.col("_child.key").alias("key"), nothing.alias("value"))]
    same = F.array(F.struct(F.col("_path").alias("path"), F.col("_key").alias("key"), F.col("_value").alias("value")))
    step = F.when(F.col("_child.pos").isNull(), same).when(F.col("_child.key").isNull(), F.array(*found)).otherwise(F.array(*name, *found))
    for _ in range(depth):
        taken = levels.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("_value").outer()).select(F.struct("pos", "key", "value").alias("_child")))
        levels = taken.select("_row", F.explode(step).alias("_next")).select("_row", *[F.col(f"_next.{c}").alias(f"_{c}") for c in ("path", "key", "value")])
    kind = F.schema_of_variant("_value")
    text = F.when(kind == "STRING", F.col("_value").cast("string")).when(kind.rlike("^(?:OBJECT|ARRAY)<"), F.to_json("_value"))  # of an empty one, brackets alone
    text = F.when(~text.isin("[]", "{}") | (kind == "STRING"), text)
    strings = levels.select("_row.*", F.col("_path").alias("path"), F.coalesce("_key", text).alias("string"))
    return strings.filter(F.col("string").isNotNull() & ~F.col("path").rlike(CHECKED))
