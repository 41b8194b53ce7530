"""Effective samples: complete cases, shared by models, without singletons."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speccurve.operators.panel import Panel
from speccurve.operators.scale import cached, durable, without


def expand(
    panel: Panel, masks: list[tuple[int, ...]], columns: list, coded: dict | None = None
) -> DataFrame:
    """Every row once per sample that admits it; ``sid`` is the mask's place.

    ``coded`` maps an output name to (key, code table): short keys instead of
    text or structs.  A code table has at most ``sweep_levels`` rows.

    The masks are literals of the plan, so this is a narrow projection: no
    join and no shuffle.
    """
    fits = []
    for sid, mask in enumerate(masks):
        tests = [
            F.col(f"p{w}").bitwiseAND(F.lit(bits).cast("long")) == 0
            for w, bits in enumerate(mask)
            if bits
        ]
        ok = F.lit(True)
        for test in tests:
            ok = ok & test
        fits.append(F.when(ok, F.lit(sid).cast("long")))
    rows = panel.rows
    for name, (key, table) in (coded or {}).items():
        named = table.select(F.col("level").alias(f"_{name}"), F.col("code").alias(name))
        rows = rows.join(F.broadcast(named), key == F.col(f"_{name}"), "left").drop(f"_{name}")
    every = rows.select(F.explode(F.array(*fits)).alias("sid"), *columns, *(coded or {}))
    return every.where(F.col("sid").isNotNull())


@dataclass
class Facts:
    """Counts of one sample: rows, levels per effect, groups per cluster."""

    n: int = 0
    levels: dict[int, int] = field(default_factory=dict)
    clusters: dict[tuple[int, ...], int] = field(default_factory=dict)
    nested: set[tuple[int, int]] = field(default_factory=set)


def _level_table(rows: DataFrame, effects, clusters, pairs) -> DataFrame:
    """Row counts per level of every effect, cluster and cluster pair.

    One grouping-sets aggregation: partial sums are formed before the shuffle,
    whatever the size of a level.  ``lo_j``/``hi_j`` are the smallest and
    largest cluster seen in a level: the effect is nested in cluster j when
    they agree everywhere.
    """
    columns = [f"f{k}" for k in effects] + [f"c{j}" for j in clusters]
    sets = [[f"f{k}"] for k in effects] + [[f"c{j}"] for j in clusters]
    sets += [[f"c{a}", f"c{b}"] for a, b in pairs]
    spans = []
    for j in clusters:
        spans += [F.min(f"x{j}").alias(f"lo_{j}"), F.max(f"x{j}").alias(f"hi_{j}")]
    copies = rows.withColumns({f"x{j}": F.col(f"c{j}") for j in clusters}) if clusters else rows
    grouped = copies.groupingSets(
        [[F.col("sid")] + [F.col(c) for c in s] for s in sets],
        "sid",
        *columns,
    )
    table = grouped.agg(F.grouping_id().alias("gid"), F.count("*").alias("n_rows"), *spans)
    width = len(columns)
    ids = [
        sum(1 << (width - 1 - i) for i, c in enumerate(columns) if c not in s) for s in sets
    ]
    which = F.lit(None).cast("int")
    for number, gid in enumerate(ids):
        which = F.when(F.col("gid") == gid, F.lit(number)).otherwise(which)
    return table.withColumn("set_no", which).drop("gid")


def _facts(table: DataFrame, n_effects: int, cluster_ids, pairs):
    nested = [
        F.min((F.col(f"lo_{j}") == F.col(f"hi_{j}")).cast("int")).alias(f"nested_{j}")
        for j in cluster_ids
    ]
    summary = table.groupBy("sid", "set_no").agg(
        F.count("*").alias("levels"),
        F.sum("n_rows").alias("n"),
        F.sum((F.col("n_rows") == 1).cast("long")).alias("lone"),
        *nested,
    )
    facts: dict[int, Facts] = {}
    lone: dict[int, int] = {}
    for row in summary.collect():
        fact = facts.setdefault(row["sid"], Facts())
        fact.n = row["n"]
        number = row["set_no"]
        if number < n_effects:
            fact.levels[number] = row["levels"]
            fact.nested |= {(number, j) for j in cluster_ids if row[f"nested_{j}"]}
            if row["n"] > 1:
                lone[number] = lone.get(number, 0) + row["lone"]
        elif number < n_effects + len(cluster_ids):
            fact.clusters[(cluster_ids[number - n_effects],)] = row["levels"]
        else:
            fact.clusters[pairs[number - n_effects - len(cluster_ids)]] = row["levels"]
    return facts, {k: n for k, n in lone.items() if n}


def settle(
    rows: DataFrame, n_effects: int, cluster_ids: list[int], pairs, drop: bool
) -> tuple[DataFrame, dict[int, Facts], bool]:
    """Remove rows alone in a level of any effect until none is left.

    Returns the remaining rows, their facts and whether any row went.  The state between rounds is
    the list of removed levels, not the rows: a level that once had a single
    row is gone for good, and a row stays while none of its levels is gone.
    """
    if n_effects == 0 and not cluster_ids:
        counts = rows.groupBy("sid").count().collect()
        return rows, {r["sid"]: Facts(n=r["count"]) for r in counts}, False
    gone: dict[int, tuple[DataFrame, int]] = {}
    alive = rows
    while True:
        table = _level_table(alive, range(n_effects), cluster_ids, pairs)
        if drop and n_effects:
            table = cached(table)
        facts, lone = _facts(table, n_effects, cluster_ids, pairs)
        if not drop or not lone:
            table.unpersist()
            return alive, facts, bool(gone)
        for k, n_lone in lone.items():
            fresh = table.where((F.col("set_no") == k) & (F.col("n_rows") == 1)).select(
                "sid", f"f{k}"
            )
            known, n_known = gone.get(k, (None, 0))
            merged = durable(fresh if known is None else known.unionByName(fresh))
            gone[k] = (merged, n_known + n_lone)
        table.unpersist()
        alive = rows
        for k, (levels, count) in gone.items():
            alive = without(alive, levels, ["sid", f"f{k}"], count)
