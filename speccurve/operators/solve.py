"""Small linear algebra per model: coefficients, covariance, statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

from speccurve.functions.tdist import quantile, two_sided_p
from speccurve.operators.moments import triangle

# A residual column whose norm is below this share of the original spread is
# explained by the effects; a Cholesky pivot (a squared norm) below PIVOT_TOL by
# earlier columns: less than a millionth of the column is its own.  Sums of
# products over many rows do not resolve much less than that.
NORM_TOL = 1e-9
PIVOT_TOL = 1e-12

SOLVED_SCHEMA = (
    "mid long, sid long, yi int, fi int, must array<int>, test array<int>, "
    "is_full boolean, kept array<int>, beta array<double>, sse double, tss double"
)
# Names and order of the result columns.
RESULT_FIELDS = {
    "y": "string",
    "x": "string",
    "spec_name": "string",
    "spec_tag": "string",
    "bits": "bigint",
    "coef": "double",
    "se": "double",
    "t_value": "double",
    "p_value": "double",
    "adj_r2": "double",
    "within_r2": "double",
    "f_stat": "double",
    "df_resid": "bigint",
    "ci99_lo": "double",
    "ci99_hi": "double",
    "ci95_lo": "double",
    "ci95_hi": "double",
    "ci90_lo": "double",
    "ci90_hi": "double",
    "controls_test": "array<string>",
    "controls_all": "array<string>",
    "control_stats": "array<struct<name:string,coef:double,se:double,t_value:double,p_value:double>>",
    "is_full": "boolean",
    "obs": "bigint",
    "status": "string",
}
RESULT_COLUMNS = list(RESULT_FIELDS)
RESULT_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in RESULT_FIELDS.items())


def independent(gram: np.ndarray, order: list[int], n_rows: int) -> list[int]:
    """Columns kept by an ordered rank test: a column goes when the effects or
    the columns before it explain it."""
    kept: list[int] = []
    factor = np.zeros((len(order), len(order)))
    for j in order:
        size = gram[j, j]
        if size <= NORM_TOL**2 * max(n_rows, 1):
            continue
        m = len(kept)
        row = np.zeros(m)
        for i in range(m):
            row[i] = (gram[j, kept[i]] - factor[i, :i] @ row[:i]) / factor[i, i]
        pivot = size - row @ row
        if pivot <= PIVOT_TOL * size:
            continue
        factor[m, :m] = row
        factor[m, m] = np.sqrt(pivot)
        kept.append(j)
    return kept


def solve_models(batches, grams: dict[int, np.ndarray], sizes: dict[int, int]):
    """Coefficients of each model from the cross-products of its sample."""
    for pdf in batches:
        kept_all, beta_all, sse, tss = [], [], [], []
        for row in pdf.itertuples(index=False):
            gram = grams.get(row.sid)
            kept, beta, left, total = [], np.zeros(0), np.nan, np.nan
            if gram is not None:
                kept = independent(gram, list(row.order), sizes.get(row.sid, 0))
                if row.fi not in kept:
                    kept = []
            if kept:
                right = gram[kept, row.yi]
                beta = np.linalg.solve(gram[np.ix_(kept, kept)], right)
                total = gram[row.yi, row.yi]
                left = max(total - 2 * beta @ right + beta @ gram[np.ix_(kept, kept)] @ beta, 0.0)
            kept_all.append(kept)
            beta_all.append(beta)
            sse.append(left)
            tss.append(total)
        out = pdf.drop(columns=["order"])
        out["kept"], out["beta"], out["sse"], out["tss"] = kept_all, beta_all, sse, tss
        yield out


@dataclass
class DesignFacts:
    """What one design needs to know about one sample."""

    n: int
    absorbed: int
    counted: int
    groups: tuple[int, ...]
    settled: bool = True


@dataclass
class Finisher:
    """Turns coefficients and score moments into result rows."""

    inference: str
    designs: list  # (name, tag, kinds); kinds: () robust, (c,) or (c1, c2, c12)
    facts: dict  # sid -> [DesignFacts per design]
    grams: dict
    names: list[str]
    labels: dict[int, str]  # focal variable -> X label
    scale: list[float]
    hidden: dict[int, set[int]]  # focal variable -> regressors not reported
    models: int
    outcomes: int
    halves: int  # 2 when every sample was split: the lowest bit of mid is the half

    def __call__(self, batches):
        for pdf in batches:
            rows = [r for row in pdf.itertuples(index=False) for r in self.rows(row)]
            yield self.with_probabilities(rows)

    def rows(self, row):
        kept = [int(k) for k in row.kept]
        moments = {}
        if row.kinds is not None:
            moments = dict(zip(row.kinds, row.parts))
        gram = self.grams.get(row.sid)
        inverse = None
        if kept:
            inverse = np.linalg.inv(gram[np.ix_(kept, kept)])
        chosen = [int(c) for c in row.must] + [int(c) for c in row.test]
        hidden = self.hidden.get(row.fi, set()) | {row.fi}
        reported = [self.names[k] for k in chosen if k in kept and k not in hidden]
        tested = [self.names[int(k)] for k in row.test if int(k) in kept]
        base = {
            "y": self.names[row.yi],
            "x": self.labels[row.fi],
            "bits": row.mid // self.halves % self.models,
            "group_value": row.mid % 2,
            "controls_test": sorted(tested),
            "controls_all": sorted(reported),
            "is_full": bool(row.is_full),
        }
        for (name, tag, kinds), fact in zip(
            self.designs, self.facts.get(row.sid, [None] * len(self.designs))
        ):
            out = dict(base, spec_name=name, spec_tag=tag)
            out.update(self.estimate(row, kept, inverse, moments, kinds, fact, chosen))
            yield out

    def estimate(self, row, kept, inverse, moments, kinds, fact, chosen):
        n = fact.n if fact else 0
        if n <= 1:
            return {"obs": n, "status": "too_few_rows"}
        if not fact.settled:
            return {"obs": n, "status": "not_converged"}
        if not kept:
            return {"obs": n, "status": "x_collinear"}
        q = len(kept)
        df_resid = max(1, n - q - fact.absorbed)
        k_se = q + (fact.counted if self.inference == "nested" else fact.absorbed)
        out = {"obs": n, "df_resid": df_resid}
        if n <= k_se:
            return dict(out, status="no_degrees_of_freedom")
        if kinds and min(fact.groups) <= 1:
            return dict(out, status="one_cluster")
        meat = self.meat(moments, kinds, q, fact, n, k_se)
        cov = inverse @ meat @ inverse
        beta = np.asarray(row.beta)
        variance = np.diag(cov)
        at = kept.index(row.fi)
        if not np.isfinite(beta[at]) or not np.isfinite(variance[at]) or variance[at] <= 0:
            two_way = len(kinds) == 3
            return dict(out, status="vcov_not_psd" if two_way else "no_standard_error")
        unit = self.scale[row.yi] / np.array([self.scale[k] for k in kept])
        coef = beta * unit
        se = np.sqrt(np.maximum(variance, 0.0)) * unit
        df_t = df_resid
        if kinds and self.inference == "nested":
            df_t = max(1, min(fact.groups[:2]) - 1)
        r2 = 1 - row.sse / row.tss if row.tss > 0 else None
        out.update(
            status="ok",
            coef=coef[at],
            se=se[at],
            t_value=coef[at] / se[at],
            df_t=df_t,
            within_r2=r2,
            adj_r2=None if r2 is None else 1 - (1 - r2) * (n - 1) / df_resid,
            f_stat=self.f_statistic(row, beta, cov, q, df_resid),
            stats=[
                (self.names[k], coef[i], se[i])
                for k in chosen
                if k in kept
                for i in (kept.index(k),)
                if k not in self.hidden.get(row.fi, set())
            ],
        )
        return out

    def meat(self, moments, kinds, q, fact, n, k_se):
        a, b = triangle(q)

        def block(kind):
            out = np.zeros((q, q))
            out[a, b] = out[b, a] = np.asarray(moments[kind])[: len(a)]
            return out

        if not kinds:
            return block(0) * (n / (n - k_se))
        small = (n - 1) / (n - k_se)
        factors = [g / (g - 1) for g in fact.groups]
        if len(kinds) == 1:
            return block(kinds[0]) * (factors[0] * small)
        if self.inference == "full":
            least = min(fact.groups)
            factors = [least / (least - 1)] * 3
        first, second, both = (f * block(k) for f, k in zip(factors, kinds))
        return small * (first + second - both)

    def f_statistic(self, row, beta, cov, q, df_resid):
        if self.inference == "full":
            return (row.tss - row.sse) / q / (row.sse / df_resid) if row.sse > 0 else None
        size = np.sqrt(np.abs(np.diag(cov)))
        if not np.all(size > 0):
            return None
        unit = cov / np.outer(size, size)
        if not np.all(np.isfinite(unit)) or np.linalg.cond(unit) > 1e13:
            return None
        scaled = beta / size
        return float(scaled @ np.linalg.solve(unit, scaled) / q)

    def with_probabilities(self, rows) -> pd.DataFrame:
        columns = RESULT_COLUMNS
        out = pd.DataFrame(rows, columns=columns + ["group_value", "df_t", "stats"])
        good = np.flatnonzero(out["status"].to_numpy() == "ok")
        out["control_stats"] = [[] for _ in range(len(out))]
        for level in ("99", "95", "90"):
            out[f"ci{level}_lo"] = out[f"ci{level}_hi"] = np.nan
        if len(good):
            df_t = out["df_t"].to_numpy(dtype=float)[good]
            coef = out["coef"].to_numpy(dtype=float)[good]
            se = out["se"].to_numpy(dtype=float)[good]
            p = np.full(len(out), np.nan)
            p[good] = two_sided_p(coef / se, df_t)
            out["p_value"] = p
            distinct, where = np.unique(df_t, return_inverse=True)
            for level, prob in (("99", 0.995), ("95", 0.975), ("90", 0.95)):
                half = quantile(prob, distinct)[where] * se
                out.loc[out.index[good], f"ci{level}_lo"] = coef - half
                out.loc[out.index[good], f"ci{level}_hi"] = coef + half
            flat = [(g, d, s) for g, d in zip(good, df_t) for s in out["stats"].iloc[g]]
            if flat:
                values = np.array([s[1:] for _, _, s in flat])
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = values[:, 0] / values[:, 1]
                probs = two_sided_p(t, np.array([d for _, d, _ in flat]))
                for (g, _, s), tv, pv in zip(flat, t, probs):
                    out["control_stats"].iloc[g].append(
                        {"name": s[0], "coef": s[1], "se": s[2], "t_value": tv, "p_value": pv}
                    )
        for name in ("coef", "se", "t_value", "p_value", "adj_r2", "within_r2", "f_stat"):
            out[name] = out[name].astype(float)
        out["df_resid"] = out["df_resid"].astype("Int64")
        return out[columns + (["group_value"] if self.halves == 2 else [])]
