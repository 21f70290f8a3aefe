"""Conflicts between sources, golden records and their provenance."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.similarity import token_sort_ratio
from tablewright.functions.text import EMPTY_MERGE, is_empty, strip
from tablewright.operators.columns import ROW
from tablewright.operators.entities import TARGETS, ColumnMap, Sources, entity_names

# Parts of a source id that set each source flag.
SOURCE_FLAGS = {
    "_source_crm": ("crm",),
    "_source_tally": ("tally",),
    "_source_pos": ("pos",),
    "_source_excel": ("spreadsheet", "sales", "inventory", "excel"),
}
# Row numbers of a source that one part of an entity's log spans.
LOG_ROWS = 1000


def recommend_strategy(mapping: DataFrame) -> DataFrame:
    """Best key per dataset, from ``(dataset, target_field, source_id)`` rows of a mapping."""
    counts = mapping.groupBy("dataset").agg(
        F.count_if(F.col("target_field") == "GSTIN").alias("tax"), F.count_if(F.col("target_field") == "Customer_ID").alias("id")
    )
    key = F.when(F.col("tax") >= 2, "GSTIN").when(F.col("id") >= 2, "Customer_ID").otherwise("Customer_Name")
    return counts.select("dataset", key.alias("key"), F.lit("Entity Resolution").alias("strategy"))


def _value(target: str) -> Column:
    """Trimmed value of a target field, NULL where empty."""
    c = F.col(target)
    return F.when(~is_empty(c, EMPTY_MERGE), strip(c))


def conflicts(resolved: DataFrame, mapping: ColumnMap, key: str = "Customer_Name") -> DataFrame:
    """Fields on which the sources of one entity differ, each source speaking through its last value."""
    fields = [t for t in TARGETS if t != key and mapping.get(t)]
    latest = resolved.groupBy("_entity_id", "_source_id").agg(
        F.min_by("name", "_rec").alias("_name"),
        F.min("_rec").alias("_first"),
        *[F.max_by(_value(t), F.when(_value(t).isNotNull(), F.col("_rec"))).alias(t) for t in fields],
    )
    long = latest.unpivot(["_entity_id", "_source_id", "_name", "_first"], fields, "field", "value")
    entry = F.when(F.col("value").isNotNull(), F.struct("_source_id", "value"))
    grouped = long.groupBy("_entity_id", "field").agg(
        F.min_by("_name", "_first").alias("entity_id"),
        F.min("value").alias("_low"),
        F.max("value").alias("_high"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("values"),
    )
    differing = grouped.where(F.col("_low") != F.col("_high"))
    return differing.select("_entity_id", "entity_id", "field", "values", F.lit("CONFLICT").alias("status"))


def contributions(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("_source_id").agg(F.count("*").alias("records"))


def preview(resolved: DataFrame, mapping: ColumnMap, key: str = "Customer_Name") -> DataFrame:
    """Sizes of the merge to come, as one row."""
    sizes = resolved.groupBy("_entity_id").agg(F.count("*").alias("size"))
    zero = F.lit(0).cast("bigint")
    a = sizes.agg(
        F.count("*").alias("unique_entities"),
        F.coalesce(F.sum(F.when(F.col("size") > 1, F.col("size"))), zero).alias("matched_records"),
        F.count_if(F.col("size") == 1).alias("unmatched_records"),
        F.coalesce(F.sum(F.col("size") - 1), zero).alias("duplicates_resolved"),
        zero.alias("conflicts_detected"),
    )
    names = a.columns
    b = conflicts(resolved, mapping, key).agg(
        *[(F.count("*") if n == "conflicts_detected" else zero).alias(n) for n in names]
    )
    total = a.unionByName(b).agg(*[F.sum(n).alias(n) for n in names])
    return total.withColumn("new_columns", F.lit(16).cast("bigint"))


def merge_confidence(resolved: DataFrame) -> DataFrame:
    """Best similarity of a member's name, as written, to the leader's; over distinct names only."""
    names = entity_names(resolved)
    own = F.col("name") == F.col("primary")
    sims = names.where((F.col("size") > 1) & (~own | (F.col("c") > 1)))
    best = sims.withColumn("_sim", token_sort_ratio(F.col("primary"), F.col("name"))).groupBy("_entity_id").agg(F.max("_sim").alias("best"))
    return best.select("_entity_id", F.when(F.col("best") == 0, 90).otherwise(F.bround("best").cast("int")).alias("_merge_confidence"))


def apply_merge(
    resolved: DataFrame,
    sources: Sources | list[str],
    strategy: str = "Entity Resolution",
    overrides: DataFrame | Mapping[str, str] | None = None,
) -> DataFrame:
    """One golden record per entity: the first filled value of each field, an override where one is given.

    ``overrides`` holds ``(override_key, value)``, the key being ``<entity name>_<field>``.
    """
    ids = [s if isinstance(s, str) else s[0] for s in sources]
    filled = {t: _value(t) for t in TARGETS}
    flags = []
    for flag, words in SOURCE_FLAGS.items():
        test = F.lit(False)
        for word in words:
            test = test | F.lower("_source_id").contains(word)
        flags.append(F.max(test.cast("int")).alias(flag))
    golden = resolved.groupBy("_entity_id").agg(
        *[F.coalesce(F.min_by(v, F.when(v.isNotNull(), F.col("_rec"))), F.lit("")).alias(t) for t, v in filled.items()],
        *flags,
        F.min_by("name", "_rec").alias("_entity_match_id"),
        F.count_distinct("_src_pos").alias("_sources"),
        F.min("_src_pos").alias("_first_source"),
    )
    if strategy == "Left Join":
        golden = golden.where(F.col("_first_source") == 0)
    elif strategy == "Inner Join":
        golden = golden.where(F.col("_sources") == len(ids))
    if overrides is not None:
        golden = _override(golden, overrides)
    scored = golden.join(merge_confidence(resolved), "_entity_id", "left")
    return scored.withColumn("_merge_confidence", F.coalesce("_merge_confidence", F.lit(100))).drop("_sources", "_first_source")


def _override(golden: DataFrame, overrides: DataFrame | Mapping[str, str]) -> DataFrame:
    """Values picked by hand replace those of the entity of that name."""
    if isinstance(overrides, Mapping):
        if not overrides:
            return golden
        overrides = golden.sparkSession.createDataFrame(list(overrides.items()), "override_key string, value string")
    # One map of field to value per entity name; the join stays an equi-join on the name.
    slots = F.array(*[F.lit(t) for t in TARGETS])
    split = overrides.select(
        F.explode(F.filter(slots, lambda t: F.col("override_key").endswith(F.concat(F.lit("_"), t)))).alias("_field"), "override_key", "value",
        F.monotonically_increasing_id().alias("_at"),
    )
    name = F.expr("substring(override_key, 1, length(override_key) - length(_field) - 1)")
    # a key given twice: the last value counts
    split = split.groupBy(name.alias("_entity_match_id"), "_field").agg(F.max_by("value", "_at").alias("value"))
    chosen = split.groupBy("_entity_match_id").agg(
        F.map_from_entries(F.collect_list(F.struct("_field", "value"))).alias("_picked")
    )
    joined = golden.join(chosen, "_entity_match_id", "left")
    picked = {t: F.coalesce(F.try_element_at("_picked", F.lit(t)), F.col(t)).alias(t) for t in TARGETS}
    return joined.select(*[picked.get(c, F.col(c)) for c in golden.columns])


def provenance(resolved: DataFrame) -> DataFrame:
    """Where each entity comes from, one row per record."""
    return resolved.select("_entity_id", "_rec", F.col("_source_id").alias("source"), F.col(ROW).alias("row_idx"), F.col("name").alias("original_name"))


def log_parts(resolved: DataFrame, rows: int = LOG_ROWS) -> DataFrame:
    """(_entity_id, source, part, _provenance_log): every record of every entity, as JSON in row order.

    A part holds the records of an entity and source whose row numbers lie in one range of ``rows``, so it is bounded
    however many records an entity has.
    """
    entries = F.array_sort(F.collect_list(F.struct("row_idx", "source", "original_name")))
    text = F.to_json(F.transform(entries, lambda e: F.struct(e["source"].alias("source"), e["row_idx"].alias("row_idx"), e["original_name"].alias("original_name"))))
    part = F.floor(F.col("row_idx") / rows).cast("bigint")
    return provenance(resolved).groupBy("_entity_id", "source", part.alias("part")).agg(text.alias("_provenance_log"))
