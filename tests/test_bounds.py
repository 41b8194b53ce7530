"""What a step may hold, order or shuffle, however large its table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from speccurve.operators import absorb, lattice, scale
from speccurve.operators.components import connected_components, linked_counts
from speccurve.operators.panel import prepare
from speccurve.plans import hetero


@pytest.mark.parametrize("accuracy", [10_000, 1])
def test_median_split_orders_the_middle_only(spark, monkeypatch, accuracy):
    """Accuracy 1: the percentiles miss the middle, and whole parts are ordered."""
    monkeypatch.setattr(hetero, "PERCENTILE_ACCURACY", accuracy)
    frame = spark.range(4001).select(
        (F.col("id") % 2).alias("g"), F.pmod(F.hash("id"), F.lit(11)).alias("z"),
        F.pmod(F.hash("id", F.lit(1)), F.lit(700)).alias("t"), "id",
    )
    ordered = []

    def counted(df, *rest):
        ordered.append(df.count())
        return scale.positions(df, *rest)

    monkeypatch.setattr(hetero, "positions", counted)
    order = [F.col(c) for c in ("z", "t", "id")]
    got = {r["id"]: r["half"] for r in hetero.median_split(frame, ["g"], order).collect()}
    data = frame.toPandas().sort_values(["z", "t", "id"])
    data["pos"] = data.groupby("g").cumcount()
    size = data.groupby("g")["id"].transform("size")
    want = dict(zip(data["id"], (data["pos"] >= (size + 1) // 2).astype(int)))
    assert got == want
    assert accuracy == 1 or ordered[0] < 0.25 * 4001


def test_sums_of_arrays_hold_one_batch(spark):
    """As many partial arrays as tasks: none of them wait in a task together."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        frame = spark.range(0, 3000, 1, 24).select(
            (F.col("id") % 3).alias("a"), (F.col("id") % 2).alias("b"),
            F.array(*[(F.col("id") * w).cast("double") for w in (1, 2, 3)]).alias("part"),
        )
        found = scale.sum_arrays(frame, ["a", "b"], "part")
        got = {(r["a"], r["b"]): r["part"] for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ids = np.arange(3000)
    for key, part in got.items():
        total = ids[(ids % 3 == key[0]) & (ids % 2 == key[1])].sum()
        assert part == [total, 2 * total, 3 * total]
    assert len(got) == 6 and "FlatMapGroupsInPandas" not in plan


def test_products_of_two_effects_deal_sums_only(spark):
    """Cells dealt by either effect give the products and components of the general way."""
    values = ["v0"]
    rows = spark.range(300).select(
        F.lit(0).cast("long").alias("sid"), (F.col("id") % 40).alias("f0"),
        (F.col("id") % 40 % 2 + 2 * F.pmod(F.hash("id"), F.lit(12))).alias("f1"),
        F.rand(1).alias("v0"),
    )
    cells, levels = absorb._numbered_cells(rows, 2, values)
    sizes = {k: table.count() for k, table in levels.items()}
    state = levels[1].select(
        "sid", F.lit(1).alias("k"), F.col("i1").alias("i"), "n_rows",
        (F.col("f1") * F.col("f1")).cast("double").alias("pv0"),
    )
    found, pair = {}, absorb._PairEquations(cells, 0, [1], values, sizes)
    for equations in (absorb._LevelEquations(cells, 0, [1], values, sizes), pair):
        product = equations.times(state, "p").collect()
        found[type(equations)] = [r["v0"] for r in sorted(product, key=lambda r: r["i"])]
    one, other = found.values()
    assert len(one) == sizes[1] and np.allclose(one, other)
    ids = levels[1].select("sid", F.col("i1").alias("i"))
    parts = linked_counts(pair.by_here, pair.by_there, "i1", "i0", ids, pair.parts)
    assert parts == connected_components(rows, 2) == {0: 2}
    pair.close()


def gappy_panel(spark):
    """900 rows; cluster 0 has a third of them, some clusters one."""
    a = F.pmod(F.hash("id"), F.lit(60))
    return spark.range(0, 900, 1, 6).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(a * F.when(a < 50, 1).otherwise(1000 + F.col("id")))
        .alias("a"),
        F.when(F.col("id") % 97 != 0, (F.col("id") % 2).cast("string")).alias("b"),
        *[F.when(F.pmod(F.hash("id", F.lit(j)), F.lit(5)) > 0, 100 * j + F.rand(j)).alias(f"x{j}")
          for j in range(2)],
        (F.rand(7) + F.col("id") % 7).alias("x2"),
    )


def products(cluster, centred):
    data = cluster[["v0", "v1", "v2"]].to_numpy()
    if centred:
        data = data - data.mean(axis=0)
    else:
        data = np.column_stack([np.ones(len(data)), data])
    row, col = np.triu_indices(data.shape[1])
    return (data.T @ data)[row, col]


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("term, centred", [(("a",), True), (("a", "b"), False)])
def test_clusters_deal_rows_and_no_products(spark, monkeypatch, hot, term, centred):
    """Clusters that reach over batches, and large ones by sums where they are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    if hot:
        monkeypatch.setattr(lattice, "HOT_LEVEL_ROWS", 200)
    try:
        panel = prepare(gappy_panel(spark), ["x0", "x1", "x2"], ["a", "b"])
        masks = [panel.mask(["b"]), panel.mask(["b", "x0"]), panel.mask(["b", "x0", "x1"])]
        table = lattice._cluster_tensors(
            panel, np.array(masks), 1, {"c0": panel.key(term)}, centred
        )
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        found = {}
        for r in table.collect():
            found.setdefault(r["sid"], {})[r["row"]] = r["part"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ("Aggregate" in plan) == hot
    rows = panel.rows.toPandas()
    for sid, mask in enumerate(masks):
        own = rows[(rows["p0"] & mask[0]) == 0]
        clusters = [c for _, c in own.groupby([f"k{'ab'.index(t)}" for t in term])]
        flat = np.array([products(c, centred) for c in clusters])
        got = np.array([found[sid][i] for i in range(len(found[sid]))])
        width = flat.shape[1]
        assert np.allclose(got[:width], flat.T @ flat, atol=1e-8)
        sizes = np.array([len(c) for c in clusters])
        if centred:
            assert np.allclose(got[width], flat.sum(axis=0), atol=1e-9)
            assert got[width + 1][:3].tolist() == [len(own), (sizes == 1).sum(), len(sizes)]
            assert (sizes == 1).any() and len(got) == width + 2
        else:
            assert got[width][0] == len(sizes) and len(got) == width + 1


def test_stored_rounds_can_be_deleted(spark):
    """Files, which a session can delete before it ends, and not a checkpoint."""
    table = scale.durable(spark.range(5).repartition(2))
    files = table.inputFiles()
    assert files and table.count() == 5
    scale.dropped(table)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0])
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert not system.exists(path.getParent())
    assert scale.durable(spark.sql("SELECT null AS a, 1 AS b")).collect()[0]["b"] == 1


def test_rounds_leave_no_tables_behind(spark):
    """Two effects by conjugate gradients: the tables of a round go with the next one."""
    import os

    rows = spark.range(400).select(
        F.lit(0).cast("long").alias("sid"), (F.col("id") % 70).alias("f0"),
        F.pmod(F.hash("id"), F.lit(50)).alias("f1"), F.rand(1).alias("v0"),
    ).localCheckpoint()
    folder = scale.checkpoint_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    times, inner = [], absorb._PairEquations.times
    absorb._PairEquations.times = lambda *a: times.append(1) or inner(*a)
    try:
        effects, _, loose = absorb._conjugate(rows, 2, 0, ["v0"], 100)
    finally:
        absorb._PairEquations.times = inner
    assert len(times) > 10 and not loose
    assert len(set(os.listdir(folder)) - before) <= 6
    data = rows.toPandas().merge(effects[1].toPandas(), on=["sid", "f1"])
    left = data["v0"] - data["_mv0"]
    left = left - left.groupby(data["f0"]).transform("mean")
    assert left.groupby(data["f0"]).sum().abs().max() < 1e-9
    assert left.groupby(data["f1"]).sum().abs().max() < 1e-9
