"""One model at a time in dense NumPy: the brute-force check of the engine."""

import numpy as np
import pandas as pd


def settle(df, fe):
    while len(df) > 1:
        lone = np.zeros(len(df), bool)
        for term in fe:
            lone |= (df.groupby(list(term))[term[0]].transform("size") == 1).to_numpy()
        if not lone.any():
            return df
        df = df[~lone]
    return df


def dummies(df, term):
    codes = df.groupby(list(term)).ngroup().to_numpy()
    out = np.zeros((len(df), codes.max() + 1))
    out[np.arange(len(df)), codes] = 1
    return out


def components(df, fe):
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for row in df[list(dict.fromkeys(c for t in fe for c in t))].drop_duplicates().to_dict("records"):
        keys = [(k,) + tuple(row[c] for c in t) for k, t in enumerate(fe)]
        for other in keys:
            parent[find(other)] = find(keys[0])
    return len({find(a) for a in list(parent)})


def fit(df, y, regressors, fe, clusters, drop=True, inference="nested", required=()):
    """coef, se of the first regressor, df, obs and more, or None."""
    needed = [y, *regressors, *[c for t in fe for c in t], *[c for t in clusters for c in t]]
    df = df.dropna(subset=list(dict.fromkeys(needed + list(required))))
    if inference == "nested" and len(clusters) == 2:
        drop = False
    if fe and drop:
        df = settle(df, fe)
    n = len(df)
    if n <= 1:
        return None
    block = [dummies(df, t) for t in fe] or [np.ones((n, 1))]
    d = np.hstack(block)
    raw = df[[y, *regressors]].to_numpy(float)
    raw = raw - raw.mean(axis=0)
    res = raw - d @ np.linalg.lstsq(d, raw, rcond=None)[0]
    kept = []
    for j in range(1, res.shape[1]):
        if np.linalg.norm(res[:, j]) < 1e-9 * np.linalg.norm(raw[:, j]):
            continue
        trial = res[:, kept + [j]]
        left = trial[:, -1]
        if kept:
            left = left - trial[:, :-1] @ np.linalg.lstsq(trial[:, :-1], left, rcond=None)[0]
        if np.linalg.norm(left) > 1e-5 * np.linalg.norm(res[:, j]):
            kept.append(j)
    if 1 not in kept:
        return None
    x, yy = res[:, kept], res[:, 0]
    beta = np.linalg.lstsq(x, yy, rcond=None)[0]
    e = yy - x @ beta
    levels = [df.groupby(list(t)).ngroups for t in fe]
    absorbed = sum(levels) - (components(df, fe) if len(fe) > 1 else 1) if fe else 1
    q = len(kept)
    counted = absorbed
    if clusters and fe and inference == "nested":
        counted = 0
        for t, size in zip(fe, levels):
            inside = any(df.groupby(list(dict.fromkeys(t + c))).ngroups == size for c in clusters)
            counted += 0 if inside else size
    k = q + counted
    df_resid = max(1, n - q - absorbed)
    if n <= k:
        return None

    def meat(term):
        codes = df.groupby(list(term)).ngroup().to_numpy()
        s = np.zeros((codes.max() + 1, q))
        np.add.at(s, codes, x * e[:, None])
        return len(s), s.T @ s

    small = (n - 1) / (n - k)
    df_t = df_resid
    if not clusters:
        m = (x * e[:, None] ** 2).T @ x * n / (n - k)
    elif len(clusters) == 1:
        g, m = meat(clusters[0])
        if g <= 1:
            return None
        m = m * g / (g - 1) * small
        df_t = g - 1
    else:
        parts = [meat(c) for c in (*clusters, clusters[0] + clusters[1])]
        f = [g / (g - 1) for g, _ in parts]
        if inference == "full":
            least = min(g for g, _ in parts)
            f = [least / (least - 1)] * 3
        m = small * (f[0] * parts[0][1] + f[1] * parts[1][1] - f[2] * parts[2][1])
        df_t = min(parts[0][0], parts[1][0]) - 1
    if inference == "full":
        df_t = df_resid
    bread = np.linalg.inv(x.T @ x)
    cov = bread @ m @ bread
    r2 = 1 - (e @ e) / (yy @ yy)
    return {
        "coef": beta[0],
        "se": np.sqrt(cov[0, 0]) if cov[0, 0] > 0 else np.nan,
        "obs": n,
        "df_resid": df_resid,
        "df_t": df_t,
        "within_r2": r2,
        "kept": [regressors[j - 1] for j in kept[1:]],
        "coefs": dict(zip([regressors[j - 1] for j in kept], beta)),
        "ses": dict(zip([regressors[j - 1] for j in kept], np.sqrt(np.abs(np.diag(cov))))),
    }
