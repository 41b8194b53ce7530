"""Estimation queries over the panel, each with its SQL yardstick."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speccurve import SpecCurveJob, interaction_curves, manual_design, spec_curve, subgroup_curves
from speccurve.catalog import fe_pair_clusters
from speccurve.functions.labels import controls_text
from speccurve.operators.components import component_counts
from speccurve.plans.hetero import median_split
from speccurve.plans.inspect import effect_report, null_patterns, sample_report
from speccurve.plans.report import match_by_controls, significance_table, skipped_models
from workload.panels import (
    DOCS_SQL,
    EVENTS_SQL,
    PANEL_SQL,
    docs_panel,
    events_panel,
    panel,
)
from workload.regress_sql import regression

ROLES = dict(firm="firm", ind="ind", time="tm", region="region")
FIRM_ONLY = manual_design(["firm"], ["firm"], "firm_cl_firm")
FIRM_HOME = manual_design(["firm"], ["home"], "firm_cl_home")
MUST = ("c_tax", ["c_size", "c_sbal"])
TEST = ("c_cbal", ["c_retail", "x2"])
WITH_PANEL = f"WITH p AS ({PANEL_SQL}) "


def job(designs=(), extra=(), must=(), test=(), **more) -> SpecCurveJob:
    settings = dict(y=("y",), x=("x",), must=must, test=test, designs=tuple(designs),
                    extra_designs=tuple(extra), **ROLES)
    settings.update(more)
    return SpecCurveJob(**settings)


def six(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def basic(results: DataFrame) -> DataFrame:
    return results.select("spec_tag", "bits", *six("coef", "se", "t_value"), "obs")


def basic_sql(tag: str, bits: int = 0) -> str:
    return (
        f"'{tag}' AS spec_tag, CAST({bits} AS BIGINT) AS bits, round(coef, 6) AS coef, "
        "round(se, 6) AS se, round(coef / se, 6) AS t_value, n AS obs"
    )


def union(parts) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


# -- designs -----------------------------------------------------------------

# tag -> effects, clusters, parameter count for the standard error, rounds.
_FE = {
    "firm": "firm", "time": "tm", "ind": "ind", "region": "region",
    "indtime": "(ind, tm)", "regiontime": "(region, tm)",
}
_DESIGNS = {
    "no_absorb_cl_firm": ("", "firm", "{q} + 1", 1),
    "no_absorb_robust": ("", "", "{q} + 1", 1),
    "ab_firm_time_cl_firm": ("firm time", "firm", "{q} + l1", 8),
    "ab_firm_time_robust": ("firm time", "", "{q} + l0 + l1 - 1", 8),
    "ab_firm_time_cl_region": ("firm time", "region", "{q} + l0 + l1", 8),
    "ab_firm_time_cl_ind": ("firm time", "ind", "{q} + l0 + l1", 8),
    "ab_firm_indtime_cl_firm": ("firm indtime", "firm", "{q} + l1", 12),
    "ab_firm_indtime_robust": ("firm indtime", "", "{q} + l0 + l1 - 1", 12),
    "ab_firm_regiontime_cl_firm": ("firm regiontime", "firm", "{q} + l1", 12),
    "ab_firm_regiontime_robust": ("firm regiontime", "", "{q} + l0 + l1 - 1", 12),
    "ab_firm_indtime_regiontime_cl_firm":
        ("firm indtime regiontime", "firm", "{q} + l1 + l2", 14),
    "ab_firm_indtime_regiontime_robust":
        ("firm indtime regiontime", "", "{q} + l0 + l1 + l2 - 1", 14),
    "ab_ind_region_time_cl_ind": ("ind region time", "ind", "{q} + l1 + l2", 8),
    "ab_ind_region_time_robust": ("ind region time", "", "{q} + l0 + l1 + l2 - 1", 8),
    "ab_ind_time_cl_firm": ("ind time", "firm", "{q} + l0 + l1", 8),
    "ab_ind_time_robust": ("ind time", "", "{q} + l0 + l1 - 1", 8),
}


def design_sql(tag: str, **more) -> str:
    fe, clusters, k, rounds = _DESIGNS[tag]
    more.setdefault("select", basic_sql(tag))
    controls = more.pop("controls", ())
    return regression(
        "p", "y", "x", controls=controls, fe=[_FE[e] for e in fe.split()],
        clusters=clusters.split(), k=k.format(q=1 + len(controls)), rounds=rounds, **more,
    )


def _design_query(name: str, tags: list[str]) -> None:
    sql = WITH_PANEL + union(design_sql(t, controls=["c_size"]) for t in tags)

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return basic(spec_curve(panel(spark, sf_dir), job(tags, must=("c_size",))))


_design_query("no_absorb_designs", ["no_absorb_cl_firm", "no_absorb_robust"])
_design_query(
    "firm_time_designs",
    ["ab_firm_time_cl_firm", "ab_firm_time_robust", "ab_firm_time_cl_region",
     "ab_firm_time_cl_ind"],
)
_design_query("firm_indtime_designs", ["ab_firm_indtime_cl_firm", "ab_firm_indtime_robust"])
_design_query(
    "firm_regiontime_designs", ["ab_firm_regiontime_cl_firm", "ab_firm_regiontime_robust"]
)
_design_query(
    "three_effect_designs",
    ["ab_firm_indtime_regiontime_cl_firm", "ab_firm_indtime_regiontime_robust"],
)
_design_query(
    "ind_region_time_designs", ["ab_ind_region_time_cl_ind", "ab_ind_region_time_robust"]
)
_design_query("ind_time_designs", ["ab_ind_time_cl_firm", "ab_ind_time_robust"])


@query(
    "within_firm_cluster",
    WITH_PANEL + regression("p", "y", "x", fe=["firm"], clusters=["firm"], rounds=1,
                            select=basic_sql("firm_cl_firm")),
)
def within_firm_cluster(spark, sf_dir):
    return basic(spec_curve(panel(spark, sf_dir), job(extra=[FIRM_ONLY])))


def _two_way(inference: str) -> str:
    k = "1" if inference == "nested" else "1 + l0 + l1 - 1"
    return regression(
        "p", "y", "x", fe=["firm", "tm"], clusters=["firm", "tm"], k=k, rounds=8,
        drop=0 if inference == "nested" else 1, two_way=inference,
        select=basic_sql("ab_firm_time_cl_firm_time"),
    )


for _mode in ("nested", "full"):

    @query(f"two_way_clusters_{_mode}", WITH_PANEL + _two_way(_mode))
    def two_way_clusters(spark, sf_dir, mode=_mode):
        settings = job(["ab_firm_time_cl_firm_time"], inference=mode)
        return basic(spec_curve(panel(spark, sf_dir), settings))


@query(
    "manual_pair_cluster",
    WITH_PANEL + regression(
        "p", "y", "x", fe=["firm", "tm"], clusters=["(firm, tm)"], k="1 + l0 + l1", rounds=8,
        select=basic_sql("manual"),
    ),
)
def manual_pair_cluster(spark, sf_dir):
    clusters = fe_pair_clusters(["firm", "tm"])[1:]
    return basic(
        spec_curve(panel(spark, sf_dir), job(extra=[manual_design(["firm", "tm"], clusters)]))
    )


# -- curves ------------------------------------------------------------------


def decoded():
    """bits, chosen mandatory and optional controls of the default job."""
    for bits in range(12):
        must = ["c_tax", MUST[1][bits % 2]]
        test = ["c_cbal"] if bits // 2 % 2 else []
        digit = bits // 4
        test += [TEST[1][digit - 1]] if digit else []
        yield bits, must, test


def _firm_models():
    parts = []
    for bits, must, test in decoded():
        kept = must + [c for c in test if c != "c_cbal"]
        select = basic_sql("firm_cl_firm", bits) + f", '{', '.join(kept)}' AS controls"
        parts.append(
            regression("p", "y", "x", controls=kept, fe=["firm"], clusters=["firm"], rounds=1,
                       k=f"{1 + len(kept)}", select=select, nonnull=must + test)
        )
    return union(parts)


@query("controls_curve", WITH_PANEL + _firm_models())
def controls_curve(spark, sf_dir):
    """All 12 models; c_cbal never varies within a firm and is dropped."""
    settings = job(extra=[FIRM_ONLY], must=MUST, test=TEST)
    results = spec_curve(panel(spark, sf_dir), settings)
    return results.select(
        "spec_tag", "bits", *six("coef", "se", "t_value"), "obs",
        controls_text(settings.must_names + settings.test_names).alias("controls"),
    )


def _robust_models():
    parts = []
    for bits, must, test in decoded():
        parts.append(
            regression("p", "y2", "x2", controls=must[1:] + test, k=f"{2 + len(must[1:] + test)}",
                       rounds=1, select=basic_sql("no_absorb_robust", bits))
        )
    return union(parts[b] for b in range(8))


@query("robust_curve_other_outcome", WITH_PANEL + _robust_models())
def robust_curve_other_outcome(spark, sf_dir):
    settings = job(["no_absorb_robust"], y=("y2",), x=("x2",), must=(["c_size", "c_sbal"],),
                   test=("c_cbal", "c_retail"))
    return basic(spec_curve(panel(spark, sf_dir), settings))


# A control without any spread inside the levels of an effect is explained by it.
_WITHIN = (
    "(SELECT max(d) FROM (SELECT max({c}) - min({c}) AS d FROM p WHERE y IS NOT NULL AND "
    "x IS NOT NULL AND c_tax IS NOT NULL AND c_cbal IS NOT NULL GROUP BY {by}))"
)


def _kept_sql(tag: str, bits: int, by: str) -> str:
    tax, cbal = (f"{_WITHIN.format(c=c, by=by)} > 0" for c in ("c_tax", "c_cbal"))
    extra = f"CASE WHEN {cbal} THEN 'c_cbal' END" if bits else "NULL"
    return (
        f"SELECT '{tag}' AS spec_tag, CAST({bits} AS BIGINT) AS bits, "
        f"concat_ws(',', CASE WHEN {tax} THEN 'c_tax' END, {extra}) AS kept, "
        f"concat_ws(',', {extra}) AS kept_test"
    )


@query(
    "collinear_drop",
    WITH_PANEL + union(
        _kept_sql(tag, bits, by)
        for tag, by in (("firm_cl_firm", "firm"), ("no_absorb_robust", "true"))
        for bits in (0, 1)
    ),
)
def collinear_drop(spark, sf_dir):
    settings = job(["no_absorb_robust"], extra=[FIRM_ONLY], must=("c_tax",), test=("c_cbal",))
    results = spec_curve(panel(spark, sf_dir), settings)
    order = F.array(F.lit("c_tax"), F.lit("c_cbal"))
    kept = F.filter(order, lambda n: F.array_contains("controls_all", n))
    return results.select(
        "spec_tag", "bits", F.array_join(kept, ",").alias("kept"),
        F.array_join("controls_test", ",").alias("kept_test"),
    )


@query(
    "skipped_models",
    WITH_PANEL
    + "SELECT 'y' AS y, 'c_cbal' AS x, 'firm_cl_firm' AS spec_tag, 'x_collinear' AS status, "
    f"CAST(2 AS BIGINT) AS models WHERE {_WITHIN.format(c='c_cbal', by='firm')} = 0",
)
def skipped(spark, sf_dir):
    settings = job(extra=[FIRM_ONLY], x=("c_cbal",), test=("c_tax",))
    return skipped_models(spec_curve(panel(spark, sf_dir), settings))


@query(
    "fit_statistics",
    WITH_PANEL + design_sql(
        "ab_firm_time_cl_firm",
        select="round((1 - sse / tss) * 1000000, 4) AS within_r2_ppm, "
        "round(1 - sse / tss * (n - 1) / (n - 1 - (l0 + l1 - 1)), 8) AS adj_r2, "
        "round(coef * coef / se / se, 6) AS f_stat, "
        "CAST(n - 1 - (l0 + l1 - 1) AS BIGINT) AS df_resid",
    ),
)
def fit_statistics(spark, sf_dir):
    results = spec_curve(panel(spark, sf_dir), job(["ab_firm_time_cl_firm"]))
    return results.select(
        F.round(F.col("within_r2") * 1000000, 4).alias("within_r2_ppm"),
        F.round("adj_r2", 8).alias("adj_r2"), *six("f_stat"), "df_resid",
    )


@query(
    "full_inference",
    WITH_PANEL + union(
        regression(
            "p", "y", "x", controls=[own], fe=["firm", "tm"], clusters=["firm"],
            k="2 + l0 + l1 - 1", rounds=8, nonnull=[other],
            select=basic_sql("ab_firm_time_cl_firm", bits) + ", round((tss - sse) / 2 / "
            "(sse / (n - 2 - (l0 + l1 - 1))), 6) AS f_stat",
        )
        for bits, own, other in ((0, "c_size", "c_sbal"), (1, "c_sbal", "c_size"))
    ),
)
def full_inference(spark, sf_dir):
    """Full mode: every mandatory column must be present, nesting is ignored."""
    settings = job(["ab_firm_time_cl_firm"], must=(["c_size", "c_sbal"],), inference="full")
    results = spec_curve(panel(spark, sf_dir), settings)
    return results.select("spec_tag", "bits", *six("coef", "se", "t_value", "f_stat"), "obs")


def _series(df: int) -> str:
    """P(|T| > |t|) for even df as a finite cosine series."""
    sum_ = ["1.0"]
    factor = 1.0
    for j in range(1, df // 2):
        factor *= (2 * j - 1) / (2 * j)
        sum_.append(f"{factor!r} * pow(cos(th), {2 * j})")
    return f"1 - sin(th) * ({' + '.join(sum_)})"


# T quantiles at 24 degrees of freedom.
T24 = {"99": 2.796939504772804, "95": 2.063898561628021, "90": 1.7108820799094275}


@query(
    "p_values_and_limits",
    WITH_PANEL + "SELECT coef, se, obs, round(" + _series(24) + ", 8) AS p_value, "
    + ", ".join(
        f"round(b - {t} * s, 5) AS ci{level}_lo, round(b + {t} * s, 5) AS ci{level}_hi"
        for level, t in T24.items()
    )
    + " FROM (" + regression(
        "p", "y", "x", fe=["firm"], clusters=["home"], rounds=1,
        select="round(coef, 6) AS coef, round(se, 6) AS se, n AS obs, coef AS b, se AS s, "
        "atan(abs(coef) / se / sqrt(24)) AS th",
    ) + ")",
)
def p_values_and_limits(spark, sf_dir):
    """Firms nested in 25 home clusters: t with 24 degrees of freedom."""
    results = spec_curve(panel(spark, sf_dir), job(extra=[FIRM_HOME]))
    limits = [f"ci{lv}_{side}" for lv in T24 for side in ("lo", "hi")]
    return results.select(
        *six("coef", "se"), "obs", F.round("p_value", 8).alias("p_value"),
        *[F.round(c, 5).alias(c) for c in limits],
    )


def _control_stats_sql() -> str:
    names = ["x", "c_tax", "c_size", "c_retail"]
    parts = []
    for focal in names[1:]:
        others = [n for n in names if n != focal]
        parts.append(
            regression("p", "y", focal, controls=others, fe=["firm"], clusters=["firm"], k="4",
                       rounds=1, select=f"'{focal}' AS name, round(coef, 6) AS coef, "
                       "round(se, 6) AS se, round(coef / se, 6) AS t_value")
        )
    return union(parts)


@query("control_statistics", WITH_PANEL + _control_stats_sql())
def control_statistics(spark, sf_dir):
    settings = job(extra=[FIRM_ONLY], must=("c_tax", "c_size", "c_retail"))
    results = spec_curve(panel(spark, sf_dir), settings)
    stats = results.select(F.inline("control_stats"))
    return stats.select("name", *six("coef", "se", "t_value"))


# -- samples -----------------------------------------------------------------


def _sizes_sql() -> str:
    parts = []
    for bits, must, test in decoded():
        where = " AND ".join(f"{c} IS NOT NULL" for c in ["y", "x", *must, *test])
        full = "TRUE" if len(test) == 2 else "FALSE"
        parts.append(
            f"SELECT CAST({bits} AS BIGINT) AS bits, '{','.join(must)}' AS must, "
            f"'{','.join(test)}' AS test, {full} AS is_full, "
            f"count(*) FILTER (WHERE {where}) AS obs FROM p"
        )
    return union(parts)


@query("model_samples", WITH_PANEL + _sizes_sql())
def model_samples(spark, sf_dir):
    """The model grid with every model's own complete-case sample."""
    settings = job(["no_absorb_robust"], must=MUST, test=TEST)
    found = sample_report(panel(spark, sf_dir), settings)
    return found.select(
        "bits", F.array_join("must", ",").alias("must"), F.array_join("test", ",").alias("test"),
        "is_full", "obs",
    )


@query(
    "model_count",
    WITH_PANEL + "SELECT count(DISTINCT bits) AS models, sum(obs) AS rows_used FROM ("
    + _sizes_sql() + ")",
)
def model_count(spark, sf_dir):
    settings = job(["no_absorb_robust"], must=MUST, test=TEST)
    found = sample_report(panel(spark, sf_dir), settings)
    return found.agg(F.count("*").alias("models"), F.sum("obs").alias("rows_used"))


@query(
    "null_patterns",
    WITH_PANEL + "SELECT concat_ws(',', CASE WHEN c_size IS NULL THEN 'c_size' END, "
    "CASE WHEN c_sbal IS NULL THEN 'c_sbal' END, "
    "CASE WHEN c_retail IS NULL THEN 'c_retail' END) AS missing, count(*) AS n "
    "FROM p GROUP BY 1",
)
def patterns(spark, sf_dir):
    found = null_patterns(
        panel(spark, sf_dir), job(["no_absorb_robust"], must=MUST, test=TEST)
    )
    return found.select(F.array_join("missing", ",").alias("missing"), F.col("rows").alias("n"))


def _peeled(columns: list[str], rounds: int) -> str:
    chain = [f"s0 AS (SELECT {', '.join(columns)} FROM p)"]
    for r in range(rounds):
        counts = ", ".join(
            f"count(*) OVER (PARTITION BY {c}) AS n{i}" for i, c in enumerate(columns)
        )
        keep = " AND ".join(f"n{i} > 1" for i in range(len(columns)))
        chain.append(
            f"s{r + 1} AS (SELECT {', '.join(columns)} FROM "
            f"(SELECT *, {counts} FROM s{r}) WHERE {keep})"
        )
    return ", ".join(chain) + f" SELECT count(*) AS obs FROM s{rounds}"


@query("singleton_removal", WITH_PANEL + ", " + _peeled(["cell", "firm"], 6))
def singleton_removal(spark, sf_dir):
    design = manual_design(["cell", "firm"], [], "cell_firm")
    return sample_report(panel(spark, sf_dir), job(extra=[design])).select("obs")


@query(
    "sparse_effect",
    WITH_PANEL + regression("p", "y", "x", fe=["cell"], clusters=["home"], k="1 + l0", rounds=1,
                            select=basic_sql("cell_home")),
)
def sparse_effect(spark, sf_dir):
    design = manual_design(["cell"], ["home"], "cell_home")
    return basic(spec_curve(panel(spark, sf_dir), job(extra=[design])))


def _levels_sql(tag: str, effects: list[tuple[str, str]], cluster: str) -> str:
    """Facts of the sample without singletons: rows alone in a level go until
    none is left, then components of the graph around the first effect's levels."""
    keys = [f"f{i}" for i in range(len(effects))]
    counts = ", ".join(f"count(*) OVER (PARTITION BY {k}) AS n{k}" for k in keys)
    least = f"least({', '.join(f'n{k}' for k in keys)})"
    named = ", ".join(f"{sql} AS {k}" for k, (_, sql) in zip(keys, effects))
    where = " AND ".join(f"{c} IS NOT NULL" for c in ("y", "x", cluster, *(e for _, e in effects)))
    kept = f"f0, {', '.join([*keys[1:], 'g'])}" if keys[1:] else "f0, g"
    minor = " UNION ".join(
        f"SELECT f0, concat({k}, ':', CAST({k_} AS VARCHAR)) AS minor FROM s"
        for k, k_ in enumerate(keys) if k
    )
    components = "SELECT 1 AS components"
    if minor:
        components = "SELECT count(DISTINCT low) AS components FROM (SELECT min(b) AS low FROM reach GROUP BY a)"
    graph = (
        f"m AS ({minor}), "
        "near AS (SELECT DISTINCT min(minor) OVER (PARTITION BY f0) AS a, minor AS b FROM m), "
        "links AS (SELECT a, b FROM near UNION SELECT b, a FROM near), "
        "reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach "
        "JOIN links ON reach.b = links.a), "
    ) if minor else ""
    rows = union(
        f"SELECT '{tag}' AS spec_tag, '{name}' AS effect, count(*) AS n, "
        f"count(DISTINCT {k}) AS levels, "
        f"count(DISTINCT {k}) = count(DISTINCT ({k}, g)) AS nested FROM s"
        for k, (name, _) in zip(keys, effects)
    )
    return (
        f"WITH RECURSIVE peel AS (SELECT 0 AS step, *, {counts} FROM "
        f"(SELECT {named}, {cluster} AS g FROM p WHERE {where}) UNION ALL "
        f"SELECT step + 1, {kept}, {counts} FROM "
        f"(SELECT *, min({least}) OVER () AS lone FROM peel) WHERE lone = 1 AND {least} > 1), "
        f"s AS (SELECT {kept} FROM peel WHERE step = (SELECT max(step) FROM peel) AND {least} > 1), "
        f"{graph}parts AS ({components}) "
        f"SELECT spec_tag, effect, n, levels, nested, CAST(components AS INTEGER) AS components "
        f"FROM ({rows}), parts"
    )


@query(
    "effect_levels",
    WITH_PANEL + union(
        _levels_sql(tag, effects, cluster)
        for tag, cluster, effects in (
            ("ab_firm_indtime_cl_firm", "firm", [("firm", "firm"), ("ind^tm", "(ind, tm)")]),
            ("firm_cl_home", "home", [("firm", "firm")]),
            ("ab_ind_region_time_cl_ind", "ind",
             [("ind", "ind"), ("region", "region"), ("tm", "tm")]),
        )
    ),
)
def effect_levels(spark, sf_dir):
    settings = job(["ab_firm_indtime_cl_firm", "ab_ind_region_time_cl_ind"], extra=[FIRM_HOME])
    found = effect_report(panel(spark, sf_dir), settings)
    return found.select(
        "spec_tag", "effect", F.col("rows").alias("n"), "levels", "nested", "components"
    )


@query(
    "graph_components",
    WITH_PANEL + "SELECT count(DISTINCT home) AS components FROM p",
)
def graph_components(spark, sf_dir):
    """Firms and home nations: one component per nation."""
    keys = panel(spark, sf_dir).select(
        F.lit(0).cast("long").alias("sid"), F.col("firm").alias("f0"), F.col("home").alias("f1")
    )
    return component_counts(keys, 2).select("components")


# -- heterogeneity -----------------------------------------------------------

_TIES = "z, firm, tm, ind, y, x, c_tax"


def _split_sql(part: str, keys: str) -> str:
    over = f"PARTITION BY {part} " if part else ""
    return (
        f"SELECT {keys} half, count(*) AS n, min(z) AS z_min, max(z) AS z_max, "
        "round(sum(y), 2) AS sum_y FROM (SELECT *, CAST(ntile(2) OVER "
        f"({over}ORDER BY {_TIES}) - 1 AS INTEGER) AS half FROM p WHERE z IS NOT NULL) "
        f"GROUP BY {keys} half"
    )


for _name, _part in (("ind_time", ["ind", "tm"]), ("time", ["tm"]), ("none", [])):

    @query(
        f"median_split_by_{_name}",
        WITH_PANEL + _split_sql(", ".join(_part), "".join(f"{c}, " for c in _part)),
    )
    def split(spark, sf_dir, part=_part):
        rows = panel(spark, sf_dir).where("z IS NOT NULL").select(
            F.lit(0).alias("sid"), *_TIES.split(", ")
        )
        order = [F.col(c) for c in _TIES.split(", ")]
        halves = median_split(rows, ["sid", *part], order)
        return halves.groupBy(*part, "half").agg(
            F.count("*").alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max"),
            F.round(F.sum("y"), 2).alias("sum_y"),
        )


def _halves_sql() -> str:
    """The sample is halved after its singletons are out."""
    halves = (
        "SELECT *, ntile(2) OVER (PARTITION BY tm ORDER BY z, firm, y, x) - 1 AS half "
        "FROM (SELECT *, count(*) OVER (PARTITION BY firm) AS firm_rows FROM p "
        "WHERE y IS NOT NULL AND x IS NOT NULL AND firm IS NOT NULL) "
        "WHERE firm_rows > 1 AND z IS NOT NULL"
    )
    parts = []
    for half in (0, 1):
        select = (
            f"CAST({half} AS INTEGER) AS group_value, 'z[by_time]' AS grouping_variable, "
            "round(coef, 6) AS coef, round(se, 6) AS se, n AS obs"
        )
        parts.append(
            regression("h", "y", "x", fe=["firm"], clusters=["firm"], rounds=1, drop=2,
                       select=select, extra=f"AND half = {half}")
        )
    return f", h AS MATERIALIZED ({halves}) " + union(parts)


@query("subgroup_curves", WITH_PANEL + _halves_sql())
def subgroups(spark, sf_dir):
    settings = job(extra=[FIRM_ONLY], group_by_time=("z",))
    found = subgroup_curves(panel(spark, sf_dir), settings)
    return found.select("group_value", "grouping_variable", *six("coef", "se"), "obs")


@query(
    "interaction_curve",
    WITH_PANEL + union(
        regression("p", "y", "x * z", controls=["x", *extra], fe=["firm"], clusters=["firm"],
                   rounds=1, k=f"{2 + len(extra)}",
                   select=f"'c.x#c.z' AS x, '{','.join(extra)}' AS controls, "
                   + basic_sql("firm_cl_firm", bits))
        for bits, extra in ((0, []), (1, ["c_tax"]))
    ),
)
def interaction(spark, sf_dir):
    settings = job(extra=[FIRM_ONLY], test=("c_tax",), group_by_none=("z",))
    found = interaction_curves(panel(spark, sf_dir), settings)
    return found.select(
        "x", F.array_join("controls_all", ",").alias("controls"), "spec_tag", "bits",
        *six("coef", "se", "t_value"), "obs",
    )


def _matched_sql(x: str, z: str, scope: str, bits: int, extra: list[str]) -> str:
    """The interaction beside the plain model with the same controls."""
    return regression(
        "p", "y", f"{x} * {z}", controls=[x, *extra], k=f"{3 + len(extra)}",
        select=f"'{x}' AS x, '{z}[{scope}]' AS grouping_variable, CAST({bits} AS BIGINT) AS bits, "
        "round(coef, 6) AS other_coef, n AS other_obs",
    )


@query(
    "interaction_match",
    WITH_PANEL + union(
        _matched_sql(x, z, scope, bits, extra)
        for x in ("x", "x2")
        for z, scope in (("z", "by_time"), ("c_sbal", "by_none"))
        for bits, extra in ((0, []), (1, ["c_tax"]))
    ),
)
def interaction_match(spark, sf_dir):
    """Two regressors and two grouping variables: every plain model meets the
    interaction of its own regressor, once for each variable."""
    settings = job(["no_absorb_robust"], x=("x", "x2"), test=("c_tax",),
                   group_by_time=("z",), group_by_none=("c_sbal",))
    frame = panel(spark, sf_dir)
    joined = match_by_controls(
        spec_curve(frame, settings), interaction_curves(frame, settings), "other"
    )
    return joined.select(
        "x", "grouping_variable", "bits", F.round("other.coef", 6).alias("other_coef"),
        F.col("other.obs").alias("other_obs"),
    )


# Two-sided normal quantiles: robust errors have all residual degrees of freedom.
_STARS = (
    "CASE WHEN abs(coef / se) > 2.5758 THEN 3 WHEN abs(coef / se) > 1.9600 THEN 2 "
    "WHEN abs(coef / se) > 1.6449 THEN 1 ELSE 0 END * CASE WHEN coef < 0 THEN -1 ELSE 1 END"
)


# Outcomes of the run: one that depends on the second regressor, and one of the panel.
_OUTCOMES = {"y3": "y + 40000 * x2", "y2": "y2"}


def _table_sql(tag: str, y: str, x: str, extra: list[str]) -> str:
    fe, _, k, rounds = _DESIGNS[tag]
    effects = [_FE[e] for e in fe.split()]
    return regression(
        "p", _OUTCOMES[y], x, controls=["c_tax", *extra], fe=effects, k=k.format(q=2 + len(extra)),
        rounds=rounds,
        select=f"{_STARS} AS \"Star\", round(coef, 5) AS coef, round(coef / se, 5) AS t_value, "
        f"n AS obs, '{y}' AS \"Y\", '{x}' AS \"X\", '{', '.join(['c_tax', *extra])}' AS "
        f"\"Controls\", '{', '.join(effects)}' AS \"FE\", 'robust' AS cluster, "
        "CAST(16 AS BIGINT) AS \"Specs\"",
    )


@query(
    "run_to_significance_table",
    WITH_PANEL + "SELECT * FROM (" + union(
        _table_sql(tag, y, x, extra)
        for tag in ("no_absorb_robust", "ab_ind_time_robust")
        for y in _OUTCOMES
        for x in ("x", "x2")
        for extra in ([], ["c_retail"])
    ) + ") WHERE \"Star\" <> 0",
)
def run_to_table(spark, sf_dir):
    """A whole run: two outcomes, two regressors, two designs, to the table of
    significant models."""
    settings = job(["no_absorb_robust", "ab_ind_time_robust"], y=tuple(_OUTCOMES),
                   x=("x", "x2"), must=("c_tax",), test=("c_retail",))
    frame = panel(spark, sf_dir).withColumn("y3", F.expr(_OUTCOMES["y3"]))
    table = significance_table(spec_curve(frame, settings), settings)
    return table.select(
        "Star", F.round("coef", 5).alias("coef"), F.round("t_value", 5).alias("t_value"), "obs",
        "Y", "X", "Controls", "FE", "cluster", "Specs",
    )


_NEAR = "c_tax + c_cbal * 3e-11"


@query(
    "nearly_collinear_control",
    WITH_PANEL + regression(
        "p", "y", "x", controls=["c_tax", _NEAR], k="4",
        select="'c_tax,near' AS kept, round(coef, 3) AS coef, n AS obs",
    ),
)
def nearly_collinear(spark, sf_dir):
    """A control of which some millionths are its own stays in the model."""
    frame = panel(spark, sf_dir).withColumn("near", F.expr(_NEAR))
    found = spec_curve(frame, job(["no_absorb_robust"], must=("c_tax", "near")))
    order = F.array(F.lit("c_tax"), F.lit("near"))
    kept = F.filter(order, lambda n: F.array_contains("controls_all", n))
    return found.select(F.array_join(kept, ",").alias("kept"), F.round("coef", 3).alias("coef"), "obs")


# -- other panels ------------------------------------------------------------


@query(
    "hourly_events",
    f"WITH p AS ({EVENTS_SQL.format(k=chr(39).join(['json_extract_string(props, ', '$.k', ')']))}) "
    + union([
        regression("p", "y", "x", fe=["firm", "tm"], clusters=["firm"], k="1 + l1", rounds=25,
                   select=basic_sql("ab_firm_time_cl_firm"), drop=3),
        regression("p", "y", "x", fe=["firm", "tm"], clusters=["ind"], k="1 + l0 + l1", rounds=25,
                   select=basic_sql("ab_firm_time_cl_ind"), drop=3),
    ]),
)
def hourly_events(spark, sf_dir):
    settings = job(["ab_firm_time_cl_firm", "ab_firm_time_cl_ind"])
    return basic(spec_curve(events_panel(spark, sf_dir), settings))


@query(
    "document_panel",
    f"WITH p AS ({DOCS_SQL}) " + regression(
        "p", "y", "x", controls=["c1"], fe=["firm"], clusters=["region"], k="2 + l0", rounds=1,
        select="round(coef * 1000000, 4) AS coef_micro, round(se * 1000000, 4) AS se_micro, "
        "n AS obs",
    ),
)
def document_panel(spark, sf_dir):
    design = manual_design(["firm"], ["region"], "source_lang")
    settings = job(extra=[design], must=("c1",))
    results = spec_curve(docs_panel(spark, sf_dir), settings)
    return results.select(
        F.round(F.col("coef") * 1000000, 4).alias("coef_micro"),
        F.round(F.col("se") * 1000000, 4).alias("se_micro"), "obs",
    )


# -- many samples, many levels -----------------------------------------------

# Every control misses other rows: each pair of alternatives has 3 choices.
_GAPPY = [
    (f"w{i}", f"CASE WHEN (firm + cell) % {11 + 2 * i} = {i} THEN NULL ELSE {c} END")
    for i, c in enumerate(("c_tax", "c_size", "c_sbal", "c_retail", "c_cbal", "x2", "z", "c_tax * x2"))
]


def _gappy_models():
    parts = []
    for bits in range(81):
        chosen, rest = [], bits
        for slot in range(4):
            digit, rest = rest % 3, rest // 3
            chosen += [_GAPPY[2 * slot + digit - 1][1]] if digit else []
        for tag, clusters in (("no_absorb_robust", []), ("no_absorb_cl_firm", ["firm"])):
            parts.append(regression("p", "y", "x", controls=chosen, clusters=clusters,
                                    k=str(2 + len(chosen)), rounds=1, select=basic_sql(tag, bits)))
    return union(parts)


@query("gappy_controls_curve", WITH_PANEL + _gappy_models())
def gappy_controls_curve(spark, sf_dir):
    """81 models under two designs; all have samples of their own."""
    frame = panel(spark, sf_dir).withColumns({name: F.expr(sql) for name, sql in _GAPPY})
    slots = [[_GAPPY[2 * s][0], _GAPPY[2 * s + 1][0]] for s in range(4)]
    return basic(spec_curve(frame, job(["no_absorb_robust", "no_absorb_cl_firm"], test=slots)))


@query(
    "cell_firm_time_absorb",
    WITH_PANEL + regression(
        "p", "y", "x", controls=["x2"], fe=["cell", "(firm, tm)"], clusters=["home"], k="2 + l0",
        rounds=90, drop=0, select=basic_sql("cell_firmtm_home"),
    ),
)
def cell_firm_time_absorb(spark, sf_dir):
    """Two effects of thousands of levels each."""
    design = manual_design(["cell", ("firm", "tm")], ["home"], "cell_firmtm_home")
    settings = job(extra=[design], must=("x2",), drop_singletons=False)
    return basic(spec_curve(panel(spark, sf_dir), settings))
