"""Ordinary SQL for one regression, the yardstick of the estimation queries.

Effects are removed by repeated window averages, controls one after the other
by projection, and the standard error of the focal regressor follows from what
is left of it and of the outcome.
"""

from __future__ import annotations


def regression(
    source: str,
    y: str,
    focal: str,
    controls=(),
    fe=(),
    clusters=(),
    k: str = "1",
    drop: int = 1,
    rounds: int = 0,
    nonnull=(),
    select: str = "coef, se",
    extra: str = "",
    two_way: str = "nested",
) -> str:
    """A SELECT over one row.  Available names: coef, se, n, sse, tss, sxx,
    l0.. (levels), g0.. (clusters).  ``k`` is the parameter count for the
    standard error, ``rounds`` the number of averaging rounds (one effect needs
    one), ``drop`` the number of singleton rounds."""
    names = ["v_y", "v_x"] + [f"v_c{i}" for i in range(len(controls))]
    expressions = [y, focal, *controls]
    keys = [f"f{i}" for i in range(len(fe))] + [f"g{i}" for i in range(len(clusters))]
    base = ", ".join(
        [f"CAST({e} AS double) AS {n}" for e, n in zip(expressions, names)]
        + [f"{e} AS {n}" for e, n in zip([*fe, *clusters], keys)]
    )
    needed = [*expressions, *fe, *clusters, *nonnull]
    where = " AND ".join(f"{e} IS NOT NULL" for e in dict.fromkeys(needed))
    key_list = "".join(f", {k_}" for k_ in keys)
    steps = [("s0", f"SELECT {base} FROM {source} WHERE {where} {extra}")]

    def step(sql: str):
        steps.append((f"s{len(steps)}", sql.format(prev=f"s{len(steps) - 1}")))

    for _ in range(drop if fe else 0):
        counts = ", ".join(
            f"count(*) OVER (PARTITION BY f{i}) AS n{i}" for i in range(len(fe))
        )
        keep = " AND ".join(f"n{i} > 1" for i in range(len(fe)))
        step(
            f"SELECT {', '.join(names)}{key_list} FROM (SELECT *, {counts} FROM {{prev}}) "
            f"WHERE {keep}"
        )
    facts_from = steps[-1][0]
    spans = [f"PARTITION BY f{i}" for i in range(len(fe))] or [""]
    for _ in range(max(1, rounds)):
        for span in spans:
            cols = ", ".join(f"{n} - avg({n}) OVER ({span}) AS {n}" for n in names)
            step(f"SELECT {cols}{key_list} FROM {{prev}}")
    tss_from = steps[-1][0]
    left = list(names)
    for i in range(len(controls)):
        c = f"v_c{i}"
        left.remove(c)
        cols = ", ".join(
            f"{n} - {c} * (sum({n} * {c}) OVER () / sum({c} * {c}) OVER ()) AS {n}" for n in left
        )
        step(f"SELECT {cols}{key_list} FROM {{prev}}")
    last = steps[-1][0]
    levels = "".join(f", count(DISTINCT f{i}) AS l{i}" for i in range(len(fe)))
    groups = "".join(f", count(DISTINCT g{i}) AS g{i}" for i in range(len(clusters)))
    if len(clusters) == 2:
        groups += ", count(DISTINCT (g0, g1)) AS g01"
    steps.append(("facts", f"SELECT count(*) AS n{levels}{groups} FROM {facts_from}"))
    steps.append(("total", f"SELECT sum(v_y * v_y) AS tss FROM {tss_from}"))
    steps.append(
        ("b", f"SELECT sum(v_x * v_y) / sum(v_x * v_x) AS coef, sum(v_x * v_x) AS sxx FROM {last}")
    )
    steps.append(
        ("e", f"SELECT v_x, v_y - coef * v_x AS r{key_list} FROM {last}, b")
    )

    def meat(by):
        return f"(SELECT sum(s * s) FROM (SELECT sum(v_x * r) AS s FROM e GROUP BY {by}))"

    if not clusters:
        score = f"(SELECT sum(v_x * v_x * r * r) FROM e) * n / (n - ({k}))"
    elif len(clusters) == 1:
        score = f"{meat('g0')} * g0 / (g0 - 1.0) * (n - 1.0) / (n - ({k}))"
    elif two_way == "nested":
        score = (
            f"({meat('g0')} * g0 / (g0 - 1.0) + {meat('g1')} * g1 / (g1 - 1.0) "
            f"- {meat('g0, g1')} * g01 / (g01 - 1.0)) * (n - 1.0) / (n - ({k}))"
        )
    else:
        score = (
            f"({meat('g0')} + {meat('g1')} - {meat('g0, g1')}) "
            f"* least(g0, g1, g01) / (least(g0, g1, g01) - 1.0) * (n - 1.0) / (n - ({k}))"
        )
    chain = ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in steps)
    return (
        f"SELECT {select} FROM (WITH {chain} SELECT *, sqrt({score}) / sxx AS se, "
        f"(SELECT sum(r * r) FROM e) AS sse FROM b, facts, total)"
    )
