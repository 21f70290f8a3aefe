"""Entity resolution over one or several sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.similarity import token_sort_ratio, within_length
from tablewright.functions.text import (
    email_key,
    has_keyword,
    last_ten_digits,
    name_key,
    normalize,
    phone_key,
    sort_tokens,
    strip,
    tax_key,
)
from tablewright.operators.columns import ROW, data_columns
from tablewright.operators.leaders import BATCH, ordered_leaders, similar_to
from tablewright.session import cut_lineage

# Target fields of a unified table, in output order.
TARGETS = (
    "Customer_ID", "Customer_Name", "Phone", "Email", "GSTIN",
    "Revenue", "Invoice_Date", "Internal_Notes", "Created_By", "Last_Login",
)
MATCH_AT = 80
HIGH_AT = 90
# Name parts of the helper columns of a single table.
PHONE_NAMES = ("phone", "mobile", "contact")
EMAIL_NAMES = ("email", "mail")
TAX_NAMES = ("gstin", "gst")

Sources = Sequence[tuple[str, DataFrame]]
ColumnMap = Mapping[str, Mapping[str, str]]


def block_keys(name: Column, phone: Column, email: Column, gstin: Column) -> list[Column]:
    """The keys of a record, strongest first."""
    return [tax_key(gstin), email_key(email), phone_key(phone), name_key(name)]


def unify(sources: Sources, mapping: ColumnMap, key: str = "Customer_Name") -> DataFrame:
    """All records with a name, tagged by source, with the target fields under their common names.

    ``_rec`` orders them: sources as given, then row order. Columns come straight from each source's scan.
    """
    names = mapping.get(key) or {sid: data_columns(df)[0] for sid, df in sources}
    parts = []
    for position, (sid, df) in enumerate(sources):
        if names.get(sid) not in df.columns:
            continue

        def field(target: str, sid: str = sid, df: DataFrame = df) -> Column:
            column = mapping.get(target, {}).get(sid)
            return F.col(f"`{column}`").cast("string") if column in df.columns else F.lit(None).cast("string")

        blank = F.lit("")
        parts.append(
            df.select(
                (F.lit(position).cast("bigint") * F.lit(1 << 52) + F.col(ROW)).alias("_rec"),
                F.lit(sid).alias("_source_id"),
                F.lit(position).alias("_src_pos"),
                F.col(ROW).cast("bigint").alias(ROW),
                strip(F.col(f"`{names[sid]}`").cast("string")).alias("name"),
                F.coalesce(field("Phone"), blank).alias("rec_phone"),
                F.coalesce(field("Email"), blank).alias("rec_email"),
                F.coalesce(field("GSTIN"), blank).alias("rec_gstin"),
                *[field(t).alias(t) for t in TARGETS],
            ).where(F.col("name") != "")
        )
    records = parts[0]
    for part in parts[1:]:
        records = records.unionByName(part)
    keys = block_keys(F.col("name"), F.col("rec_phone"), F.col("rec_email"), F.col("rec_gstin"))
    return records.withColumn("_block", F.coalesce(*keys))


def _usable(c: Column) -> Column:
    return (c != "") & (F.lower(strip(c)) != "nan")


FEATURES = ("sname", "rec_gstin", "rec_email", "phone10", "gstin_ok", "email_ok", "phone_ok")


def with_features(records: DataFrame) -> DataFrame:
    """What the match test looks at."""
    return records.select(
        "*",
        sort_tokens(normalize(F.col("name"))).alias("sname"),
        last_ten_digits(F.col("rec_phone")).alias("phone10"),
        _usable(F.col("rec_gstin")).alias("gstin_ok"),
        _usable(F.col("rec_email")).alias("email_ok"),
        _usable(F.col("rec_phone")).alias("phone_ok"),
    )


def _match(columns: dict[str, np.ndarray], lead: dict[str, object], rows: np.ndarray) -> np.ndarray:
    hit = np.zeros(len(rows), dtype=bool)
    for field, ok in (("rec_gstin", "gstin_ok"), ("rec_email", "email_ok"), ("phone10", "phone_ok")):
        if lead[ok]:
            hit |= columns[field][rows] == lead[field]
    open_rows = np.flatnonzero(~hit)
    if len(open_rows):
        hit[open_rows] = similar_to(lead["sname"], columns["sname"][rows[open_rows]], MATCH_AT)
    return hit


def resolve(records: DataFrame, batch: int = BATCH) -> DataFrame:
    """Records with ``_entity_id``, the first record of their entity.

    A record is grouped in the block of its strongest key only. Records that the match test cannot tell apart
    are settled as one; blocks where one identifier or name is shared by all are one entity without any
    comparison; only the others are clustered. The result is written out once, as every later step reads it.
    """
    tier = F.split("_block", "_", 2)[0]
    shared = (
        F.when(tier == "gstin", F.col("rec_gstin")).when(tier == "email", F.col("rec_email")).when(tier == "phone", F.col("phone10"))
    )
    featured = with_features(records)
    signature = ["_block", *FEATURES]
    forms = featured.where(F.col("_block").isNotNull()).groupBy(*signature).agg(F.min("_rec").alias("node"))
    forms = cut_lineage(forms.withColumn("_shared", F.coalesce(shared, F.col("sname"))))
    blocks = forms.groupBy("_block").agg(
        F.min("node").alias("first"), (F.min("_shared") == F.max("_shared")).alias("uniform")
    )
    told = forms.join(blocks, "_block")
    simple = told.where("uniform").select(*signature, F.col("first").alias("_entity_id"))
    nodes = told.where("not uniform").withColumnRenamed("_block", "block").drop("first", "uniform", "_shared")
    leaders = ordered_leaders(nodes, _match, batch).withColumnRenamed("block", "_block")
    hard = forms.join(leaders, ["_block", "node"]).select(*signature, F.col("leader").alias("_entity_id"))
    settled = simple.unionByName(hard)
    joined = featured.join(settled, signature, "left")
    return cut_lineage(joined.select(*records.columns, F.coalesce("_entity_id", "_rec").alias("_entity_id")))


def entity_names(resolved: DataFrame) -> DataFrame:
    """Distinct names per entity with the leader's name and size; an entity of any size stays small here."""
    spelled = resolved.groupBy("_entity_id", "name").agg(F.count("*").alias("c"), F.min("_rec").alias("_first"))
    whole = spelled.groupBy("_entity_id").agg(F.min_by("name", "_first").alias("primary"), F.sum("c").alias("size"))
    return spelled.join(whole, "_entity_id")


def cluster_variants(resolved: DataFrame) -> DataFrame:
    """Names that differ from their leader's, case ignored: ``(_entity_id, primary, variant)``."""
    names = entity_names(resolved).where((F.col("size") > 1) & (F.lower("name") != F.lower("primary")))
    return names.select("_entity_id", "primary", F.col("name").alias("variant"))


def scored_entities(resolved: DataFrame) -> DataFrame:
    """Per entity of two or more records: best similarity to the leader and the number of variants."""
    names = entity_names(resolved).where(F.col("size") > 1)
    own = F.col("name") == F.col("primary")
    lead, other = normalize(F.col("primary")), normalize(F.col("name"))
    alike = F.when((lead == "") | (other == ""), F.lit(0.0)).otherwise(token_sort_ratio(lead, other))
    # The leader's own name counts only through another record that bears it.
    compared = names.where(~own | (F.col("c") > 1)).withColumn("_sim", alike)
    return compared.groupBy("_entity_id", "primary", "size").agg(
        F.max("_sim").alias("best"), F.count_if(F.lower("name") != F.lower("primary")).alias("variants")
    )


def confidence(best: Column) -> Column:
    return F.when(best >= HIGH_AT, "HIGH").otherwise("MEDIUM")


def shown_similarity(best: Column) -> Column:
    return F.when(best > 0, best.cast("int")).otherwise(F.lit(90))


def duplicate_clusters(resolved: DataFrame) -> DataFrame:
    """Entities with more than one spelling."""
    best = F.col("best")
    return scored_entities(resolved).where(F.col("variants") > 0).select(
        "_entity_id", "primary", "variants", shown_similarity(best).alias("similarity"),
        confidence(best).alias("confidence"), F.lit("MERGE").alias("action"),
    )


def match_stats(resolved: DataFrame) -> DataFrame:
    """Matched records, single records, clusters with variants and sure matches."""
    sizes = resolved.groupBy("_entity_id").agg(F.count("*").alias("size"))
    zero = F.lit(0).cast("bigint")
    a = sizes.agg(
        F.coalesce(F.sum(F.when(F.col("size") > 1, F.col("size"))), zero).alias("matched_entities"),
        F.count_if(F.col("size") == 1).alias("unmatched_records"),
        zero.alias("potential_duplicates"),
        zero.alias("high_confidence_matches"),
    )
    b = scored_entities(resolved).agg(
        zero.alias("matched_entities"),
        zero.alias("unmatched_records"),
        F.count_if(F.col("variants") > 0).alias("potential_duplicates"),
        F.count_if(F.col("best") >= HIGH_AT).alias("high_confidence_matches"),
    )
    return a.unionByName(b).agg(*[F.sum(c).alias(c) for c in a.columns])


def probable_duplicates(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Clusters within one table, and their members.

    Four passes, strongest key first; the rows still free are written out before the next. In a pass the first row still free in a block takes the rows that match
    it; the others stay free for weaker keys.
    """
    columns = data_columns(df)

    def helper(names: Sequence[str]) -> Column:
        found = next((c for c in columns if has_keyword(c, names)), None)
        return F.coalesce(F.col(f"`{found}`").cast("string"), F.lit("nan")) if found else F.lit("")

    base = df.select(
        F.col(ROW).cast("bigint").alias("_rec"),
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("nan")).alias("name"),
        helper(PHONE_NAMES).alias("rec_phone"), helper(EMAIL_NAMES).alias("rec_email"), helper(TAX_NAMES).alias("rec_gstin"),
    )
    keys = block_keys(F.col("name"), F.col("rec_phone"), F.col("rec_email"), F.col("rec_gstin"))
    free = cut_lineage(with_features(base).select("*", *[k.alias(f"_key{i}") for i, k in enumerate(keys)]))
    members: DataFrame | None = None
    same = (
        (F.col("lead.gstin_ok") & (F.col("lead.rec_gstin") == F.col("rec_gstin")))
        | (F.col("lead.email_ok") & (F.col("lead.rec_email") == F.col("rec_email")))
        | (F.col("lead.phone_ok") & (F.col("lead.phone10") == F.col("phone10")))
    )
    lead_name, name = F.col("lead.sname"), F.col("sname")
    blank = (lead_name == "") | (name == "") | ~within_length(lead_name, name, MATCH_AT)
    for i in range(len(keys)):
        block = f"_key{i}"
        lead = F.struct("_rec", "name", *FEATURES)
        leads = free.where(F.col(block).isNotNull()).groupBy(block).agg(
            F.min_by(lead, "_rec").alias("lead"), F.count("*").alias("_size")
        )
        compared = free.join(leads.where(F.col("_size") > 1), block).where(F.col("_rec") != F.col("lead._rec"))
        compared = compared.withColumn("_same", same)
        quick = compared.where("_same").withColumn("sim", F.lit(100.0))
        slow = compared.where(~F.col("_same") & ~blank).withColumn("sim", token_sort_ratio(lead_name, name))
        taken = cut_lineage(quick.unionByName(slow.where(F.col("sim") >= MATCH_AT)).select(
            F.col("lead._rec").alias("primary_row"), F.col("lead.name").alias("primary"), F.col("_rec").alias("row"), "name", "sim"
        ))
        members = taken if members is None else members.unionByName(taken)
        if i < len(keys) - 1:
            gone = taken.select(F.col("row").alias("_rec")).unionByName(taken.select(F.col("primary_row").alias("_rec")).distinct())
            free = cut_lineage(free.join(gone, "_rec", "left_anti"))
    best = F.max("sim")
    clusters = members.groupBy("primary_row", "primary").agg(
        F.count("*").alias("members"), shown_similarity(best).alias("similarity"), confidence(best).alias("confidence")
    )
    return clusters, members
