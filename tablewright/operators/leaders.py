"""Ordered leader clustering inside blocks, exact for blocks of any size.

In order, a node joins the earliest leader of its block that it matches and otherwise becomes a leader. A
block is worked off in rounds: its first nodes, a bounded batch, are settled by one task; the leaders found
are then compared with the rest of the block, which is split over many tasks. What matched is settled, what
did not enters the next round. No task holds a whole large block and no list of pairs is ever built.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.similarity import WORD, _lcs, _lcs_batch
from tablewright.session import cut_lineage

BATCH = 2000
CHUNK = 50000

# match(columns, lead, rows) -> which of the rows the lead takes; columns maps names to arrays.
Match = Callable[[dict[str, np.ndarray], dict[str, object], np.ndarray], np.ndarray]


def similar_to(lead: str, texts: np.ndarray, threshold: float) -> np.ndarray:
    """Which texts are at least that similar to ``lead``; blank texts never are."""
    out = np.zeros(len(texts), dtype=bool)
    if not lead:
        return out
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    total = sizes + len(lead)
    room = (sizes > 0) & (np.minimum(sizes, len(lead)) * 200 >= threshold * total)
    for start in range(0, len(texts), 4096):
        part = start + np.flatnonzero(room[start : start + 4096])
        if not len(part):
            continue
        others = [texts[i] for i in part]
        if len(lead) <= WORD:
            common = _lcs_batch([lead] * len(part), others)
        else:
            common = np.array([_lcs(lead, t) for t in others])
        out[part] = common * 200.0 / total[part] >= threshold
    return out


def _arrays(frame: pd.DataFrame) -> dict[str, np.ndarray]:
    return {c: frame[c].to_numpy(dtype=object) for c in frame.columns}


def _settle_batch(match: Match):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", kind="stable")
        columns = _arrays(frame)
        node = frame["node"].to_numpy()
        leader = node.copy()
        open_rows = np.arange(len(node))
        while len(open_rows) > 1:
            first, rest = open_rows[0], open_rows[1:]
            hit = match(columns, {c: a[first] for c, a in columns.items()}, rest)
            leader[rest[hit]] = node[first]
            open_rows = rest[~hit]
        return pd.DataFrame({"block": frame["block"].to_numpy(), "node": node, "leader": leader})

    return run


def _settle_rest(match: Match):
    def run(rest: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
        columns = _arrays(rest)
        found = np.full(len(rest), -1, dtype=np.int64)
        open_rows = np.arange(len(rest))
        leaders = leaders.sort_values("node")
        lead_columns = _arrays(leaders)
        for i, node in enumerate(leaders["node"].to_numpy()):
            if not len(open_rows):
                break
            hit = match(columns, {c: a[i] for c, a in lead_columns.items()}, open_rows)
            found[open_rows[hit]] = node
            open_rows = open_rows[~hit]
        return pd.DataFrame({"block": rest["block"].to_numpy(), "node": rest["node"].to_numpy(), "leader": found})

    return run


def ordered_leaders(nodes: DataFrame, match: Match, batch: int = BATCH, chunk: int = CHUNK) -> DataFrame:
    """``(block, node, leader)`` for nodes ``(block string, node bigint, features...)``; node is the order."""
    schema = "block string, node bigint, leader bigint"
    order = Window.partitionBy("block").orderBy("node")
    settled: DataFrame | None = None
    rest = nodes
    while True:
        sizes = rest.groupBy("block").agg(F.count("*").alias("_size"))
        large = sizes.where(F.col("_size") > batch)
        # The rank filter becomes a group limit before the shuffle: a task sends a batch per block at most.
        first = rest.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= batch).drop("_rank")
        done = first.groupBy("block").applyInPandas(_settle_batch(match), schema)
        if large.isEmpty():
            return done if settled is None else settled.unionByName(done)
        done = cut_lineage(done)
        settled = done if settled is None else settled.unionByName(done)
        leaders = first.join(done.where(F.col("node") == F.col("leader")).select("block", "node"), ["block", "node"], "left_semi")
        waiting = rest.join(large, "block").join(done.select("block", "node"), ["block", "node"], "left_anti")
        splits = F.ceil(F.col("_size") / F.lit(chunk)).cast("int")
        salted = waiting.withColumn("_salt", F.pmod(F.xxhash64("node"), splits).cast("int")).drop("_size")
        copies = leaders.join(large, "block").withColumn("_salt", F.explode(F.sequence(F.lit(0), splits - 1))).drop("_size")
        copies = copies.toDF(*copies.columns)  # both sides stem from the same rows, the cogroup needs them told apart
        compared = cut_lineage(
            salted.groupBy("block", "_salt").cogroup(copies.groupBy("block", "_salt")).applyInPandas(_settle_rest(match), schema)
        )
        settled = settled.unionByName(compared.where(F.col("leader") >= 0))
        rest = cut_lineage(rest.join(compared.where(F.col("leader") < 0).select("block", "node"), ["block", "node"], "left_semi"))
        if rest.isEmpty():
            return settled
