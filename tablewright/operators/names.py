"""Near-duplicate names of one column.

In a fixed order a name joins the earliest leader that is similar to it or contains it (or is contained), and
otherwise leads a cluster itself. The order is that of a digest: names are taken in growing random batches. Of
the names that match no leader so far, a random batch holds few neighbors of any one name, so the matches
found in a batch stay about linear in its size even where most names are alike. Within a batch all names without
earlier open neighbor lead at once, and again among the rest; in random order few such rounds are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.similarity import ratio
from tablewright.functions.text import normalize, strip
from tablewright.operators.simjoin import contained, similar_texts
from tablewright.session import cut_lineage

SIMILAR_AT = 85
#: Names of the first batch, on average; each further one holds as many as all before it.
FIRST_BATCH = 100_000


def _matches(left: DataFrame, right: DataFrame, threshold: int) -> DataFrame:
    """Pairs ``(a, b)`` of different names, ``a`` from the left and ``b`` from the right."""
    l1, r1 = left.select(F.col("norm").alias("left")), right.select(F.col("norm").alias("right"))
    alike = similar_texts(l1, r1, threshold).select(F.col("left").alias("a"), F.col("right").alias("b"))
    inside = contained(left.select(F.col("norm").alias("small")), right.select(F.col("norm").alias("large")))
    around = contained(right.select(F.col("norm").alias("small")), left.select(F.col("norm").alias("large")))
    pairs = alike.unionByName(inside.select(F.col("small").alias("a"), F.col("large").alias("b")))
    pairs = pairs.unionByName(around.select(F.col("large").alias("a"), F.col("small").alias("b")))
    return pairs.where(F.col("a") != F.col("b")).distinct()


def _place(name: str) -> Column:
    """Place in the order."""
    return F.md5(name)


def _absorbed(matches: DataFrame) -> DataFrame:
    """Names of a batch that an earlier leader of the batch takes; ``a`` comes before ``b`` in each match."""
    left, taken = cut_lineage(matches), None
    while not left.isEmpty():
        # A name without earlier open neighbor leads, and takes its neighbors.
        leads = left.select(F.col("a").alias("norm")).distinct().join(left.select(F.col("b").alias("norm")), "norm", "left_anti")
        gone = cut_lineage(left.join(leads.withColumnRenamed("norm", "a"), "a", "left_semi").select(F.col("b").alias("norm")).distinct())
        taken = gone if taken is None else taken.unionByName(gone)
        both = gone.unionByName(leads)
        left = cut_lineage(
            left.join(both.withColumnRenamed("norm", "a"), "a", "left_anti").join(gone.withColumnRenamed("norm", "b"), "b", "left_anti")
        )
    return taken if taken is not None else left.select(F.col("b").alias("norm"))


def leaders_of_names(forms: DataFrame, threshold: int = SIMILAR_AT, batch: int = FIRST_BATCH) -> DataFrame:
    """``(norm, leader)`` for distinct normal forms ``(norm)``."""
    open_forms = cut_lineage(forms.select("norm"))
    total = open_forms.count()
    share, settled = min(1.0, batch / max(total, 1)), None
    # Grows with the place, so that a batch comes before all later ones.
    part = F.conv(F.substring(_place("norm"), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    while True:
        first, later = open_forms.where(part < share), open_forms.where(part >= share)
        inner = cut_lineage(_matches(first, first, threshold).where(_place("a") < _place("b")))
        absorbed = _absorbed(inner)
        leads = cut_lineage(first.join(absorbed, "norm", "left_anti"))
        joins = inner.join(leads.withColumnRenamed("norm", "a"), "a", "left_semi").join(absorbed.withColumnRenamed("norm", "b"), "b", "left_semi")
        if share < 1.0:
            joins = joins.unionByName(_matches(leads, later, threshold))
        best = cut_lineage(joins.groupBy("b").agg(F.min_by("a", _place("a")).alias("leader")).withColumnRenamed("b", "norm"))
        done = best.unionByName(leads.withColumn("leader", F.col("norm")))
        settled = done if settled is None else settled.unionByName(done)
        if share >= 1.0:
            return settled
        open_forms = cut_lineage(later.join(best, "norm", "left_anti"))
        share = min(1.0, share * 2)


def name_members(names: DataFrame, threshold: int = SIMILAR_AT, batch: int = FIRST_BATCH) -> DataFrame:
    """``(primary, variant, similarity)`` for a table with a ``name`` column."""
    spelled = names.select(strip(F.col("name")).alias("name")).where(F.col("name") != "").distinct()
    spelled = cut_lineage(spelled.withColumn("norm", normalize(F.col("name"))))
    forms = spelled.groupBy("norm").agg(F.min("name").alias("lead_name"))
    settled = leaders_of_names(forms, threshold, batch)
    heads = forms.withColumnsRenamed({"norm": "leader", "lead_name": "primary"})
    members = spelled.join(settled, "norm").join(heads, "leader").where(F.col("name") != F.col("primary"))
    return members.select("primary", F.col("name").alias("variant"), ratio(F.col("leader"), F.col("norm")).alias("similarity"))


def name_clusters(names: DataFrame, threshold: int = SIMILAR_AT, batch: int = FIRST_BATCH) -> DataFrame:
    """Clusters with their number of variations, best similarity and confidence."""
    best = F.max("similarity")
    return name_members(names, threshold, batch).groupBy("primary").agg(
        F.count("*").alias("variations"), F.when(best > 0, best.cast("int")).otherwise(90).alias("similarity"),
        F.when(best >= 90, "High").otherwise("Medium").alias("confidence"),
    )
