"""Operator 6: exact deduplication by content-defined chunk recipes. DataFrame functions only.

Method: a text is cut where its own content says so (a boundary is a separator and one of some letters, at least
LEAST and at most MOST characters after the last one), so equal stretches give equal chunks wherever they stand.
Chunks are named by a 64-bit hash. Names are verified: equal chunks are brought together once, combined in each
map task before they move, and a name that two different chunks share is listed. A text is then its recipe, the
ordered list of chunk names, and beside it the chunks whose names are shared (none, as a rule). Two texts are
equal if and only if recipes and shared-name chunks are. Recipes are grouped and joined, texts are not moved
again.

Null text counts as empty, and all empty texts are one group. Of equal texts the row with the largest doc_id
stays; of rows that share that doc_id too, one stays; a null doc_id is smaller than any other. An empty table
gives an empty result. Other columns are carried by `exact_dedup` and ignored by `exact_groups`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of

LEAST, MOST = 512, 4096
#: A chunk ends after a separator and one of these letters, or after MOST characters.
BOUNDARY = r"(?<=[\s.,;:!?>][b-hB-H0-4])"


def chunks_of(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text, in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{least},{most}}}?{BOUNDARY}|.{{1,{most}}}"), F.lit(0))


def shared_names(chunks: DataFrame) -> DataFrame:
    """Names (column name) that different chunks (column chunk) have."""
    return chunks.groupBy("name", "chunk").agg(F.lit(1).alias("one")).groupBy("name").agg(F.count("one").alias("n")).where("n > 1").select("name")


def _recipes(df: DataFrame, name_of: Callable[[Column], Column], carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """The written table of recipes (uid, recipe, escaped and what is carried), and its groups."""
    numbered = df.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").alias("_doc"), text_of().alias("_text"), *carry)
    cut = numbered.withColumn("_chunks", chunks_of(F.col("_text")))
    recipes = materialise(
        cut.select("uid", "_doc", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"), F.transform("_chunks", name_of).alias("recipe"), *carry),
        "recipes",
    )
    named = df.select(F.explode(chunks_of(text_of())).alias("chunk")).select(name_of(F.col("chunk")).alias("name"), "chunk")
    shared = materialise(shared_names(named), "shared-names")
    none = F.array().cast("array<string>")
    if shared.isEmpty():
        recipes = recipes.withColumn("escaped", none)
    else:
        # rows are numbered anew whenever they are read, so chunks find their recipes by the digest of the text
        at = cut.select(F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"), F.posexplode("_chunks").alias("pos", "chunk")).withColumn("name", name_of(F.col("chunk")))
        found = at.join(shared, "name", "left_semi").dropDuplicates(["text_sha256", "pos"]).groupBy("text_sha256").agg(F.sort_array(F.collect_list(F.struct("pos", "chunk"))).alias("found"))
        recipes = materialise(recipes.join(found, "text_sha256", "left").withColumn("escaped", F.coalesce(F.col("found.chunk"), none)).drop("found"), "recipes")
    groups = recipes.groupBy("recipe", "escaped").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("_doc", "uid")).alias("keeper"))
    # written before it is joined: a join of tables alone is split where one recipe has most of the rows
    return recipes, materialise(groups, "groups")


def default_name(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def exact_groups(df: DataFrame, name_of: Callable[[Column], Column] = default_name) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    recipes, groups = _recipes(df, name_of, [])
    return recipes.join(groups, ["recipe", "escaped"]).select(
        F.col("_doc").alias("doc_id"), F.col("keeper._doc").alias("keep_id"), "group_size", (F.col("uid") == F.col("keeper.uid")).alias("kept"), "text_sha256"
    )


def exact_dedup(df: DataFrame, name_of: Callable[[Column], Column] = default_name) -> DataFrame:
    """The rows of df that stay, with all their columns."""
    packed = df.select("doc_id", "text", F.struct(*df.columns).alias("_row"))
    recipes, groups = _recipes(packed, name_of, ["_row"])
    keepers = groups.select(F.col("keeper.uid").alias("uid"))
    return recipes.select("uid", "_row").join(keepers, "uid", "left_semi").select("_row.*")
