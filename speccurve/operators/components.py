"""Connected components of the graph of effect levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speccurve.operators.scale import attach, dropped, durable


def connected_components(rows: DataFrame, n_effects: int) -> dict[int, int]:
    """Components per sample (one driver number each)."""
    if n_effects < 2:
        return {r[0]: n_effects for r in rows.select("sid").distinct().collect()}
    table = component_counts(rows, n_effects)
    return {r["sid"]: r["components"] for r in table.collect()}


def component_counts(rows: DataFrame, n_effects: int) -> DataFrame:
    """sid, components: levels of the first effect joined to the levels of
    every other effect that occur with them in a row.

    Smallest-label propagation over distinct level combinations.  Every level
    of the first effect starts with its own number; a round takes the minimum
    over the minor levels and back, and then follows each label to its own
    label, which halves long chains.
    """
    minor = [f"f{k}" for k in range(1, n_effects)]
    combos = rows.select("sid", "f0", *minor).distinct()
    numbered = combos.select("sid", "f0").distinct().withColumn(
        "label", F.monotonically_increasing_id()
    )
    labels = durable(numbered)
    names = labels.select("sid", "f0", F.col("label").alias("node"))
    edges = durable(combos.join(names, ["sid", "f0"]).drop("f0"))
    sizes = [edges.select("sid", f).distinct().count() for f in minor]
    state = durable(names.select("sid", "node", F.col("node").alias("label")))
    dropped(labels)
    while True:
        pulled = edges.join(state, ["sid", "node"])
        best = None
        for f, size in zip(minor, sizes):
            low = pulled.groupBy("sid", f).agg(
                F.min("label").alias("low"), F.count("*").alias("n_rows")
            )
            offer = attach(edges.select("sid", "node", f), low, ["sid", f], size).drop(f)
            best = offer if best is None else best.unionByName(offer)
        fresh = best.groupBy("sid", "node").agg(F.min("low").alias("label"))
        parent = fresh.select("sid", F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = fresh.join(parent, ["sid", "label"]).select(
            "sid", "node", F.least("label", "up").alias("label")
        )
        jumped = durable(jumped)
        moved = (
            jumped.join(state.withColumnRenamed("label", "was"), ["sid", "node"])
            .where("label < was")
            .limit(1)
            .count()
        )
        dropped(state)
        state = jumped
        if not moved:
            dropped(edges)
            return state.groupBy("sid").agg(F.countDistinct("label").alias("components"))


def across(cells: DataFrame, table: DataFrame, here: str, there: str, parts: int):
    """The rows of ``table``, one for each level ``here``, brought to the levels
    ``there`` and grouped by them.  ``cells`` are dealt over ``parts`` tasks by
    ``here``; the groups are by ``there``."""
    met = cells.join(table.hint("shuffle_hash"), here).drop(here)
    return met.repartition(parts, there).groupBy(there)


def linked_counts(
    by_here: DataFrame, by_there: DataFrame, here: str, there: str, ids: DataFrame, parts: int
) -> dict[int, int]:
    """Components per sample of a graph of two effects whose cells are dealt by
    the level of either (``by_here``, ``by_there``); ``ids`` is sid, i: the
    numbers of the levels ``here``.

    Smallest-label propagation as in :func:`component_counts`; only labels are
    shuffled.
    """
    state = durable(ids.withColumn("label", F.col("i")).repartition(parts, "i"))
    while True:
        own = state.select(F.col("i").alias(here), "label")
        low = across(by_here, own, here, there, parts).agg(F.min("label").alias("label"))
        fresh = across(by_there, low, there, here, parts).agg(F.min("label").alias("low"))
        fresh = fresh.withColumnRenamed(here, "i").hint("shuffle_hash")
        fresh = durable(state.join(fresh, "i"))
        dropped(state)
        parent = fresh.select(F.col("i").alias("low"), F.col("low").alias("up"))
        jumped = durable(
            fresh.join(parent.hint("shuffle_hash"), "low").select(
                "sid", "i", F.least("low", "up").alias("new"),
                (F.least("low", "up") < F.col("label")).alias("moved"),
            ).repartition(parts, "i")
        )
        dropped(fresh)
        state = jumped.select("sid", "i", F.col("new").alias("label"))
        if not jumped.where("moved").limit(1).count():
            counts = state.groupBy("sid").agg(F.countDistinct("label").alias("n"))
            return {r["sid"]: r["n"] for r in counts.collect()}
