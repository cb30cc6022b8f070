"""Linear models from one pass of sufficient statistics, and what follows from them on the driver.

Each partition sums the products of its rows in NumPy blocks; p columns give p**2
numbers, whatever the number of rows, and only these sums reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import exact_median

Z95 = 1.959964
HUBER_K, MAD = 1.345, 0.67449


def levels_by_count(df: DataFrame, column: str) -> list[str]:
    """Levels of a factor, the most frequent first, then by name: the first is the reference. Factors have few levels; they are model columns."""
    return [r[0] for r in df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).collect()]


def one_hot(column: str, levels: list[str]) -> dict[str, Column]:
    """A 0/1 column for each level but the reference."""
    return {f"{column}={v}": (F.col(column) == v).cast("double") for v in levels[1:]}


def _blocks(df: DataFrame, columns: list[str], make, size: int) -> np.ndarray:  # noqa: ANN001
    """The sum over partitions of ``make(block)``, an array of ``size`` numbers; rows with a null or NaN are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in b.columns]) if b.num_rows else np.zeros((0, len(columns)))
            total += make(x[np.isfinite(x).all(axis=1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "v"])

    parts = df.select(*(F.col(f"`{c}`").cast("double") for c in columns)).mapInArrow(run, "i long, v double")
    out = np.zeros(size)
    got = parts.groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return out


@dataclass
class Gram:
    """Products of an intercept, the columns ``x`` and the outcomes ``y`` with one another."""

    x: list[str]
    y: list[str]
    matrix: np.ndarray

    @property
    def names(self) -> list[str]:
        return ["(intercept)", *self.x, *self.y]

    @property
    def n(self) -> float:
        return float(self.matrix[0, 0])

    def part(self, rows: list[str], columns: list[str]) -> np.ndarray:
        at = {k: i for i, k in enumerate(self.names)}
        return self.matrix[np.ix_([at[r] for r in rows], [at[c] for c in columns])]


def gram(df: DataFrame, x: list[str], y: list[str], weight: str | None = None) -> Gram:
    """One pass; ``weight`` multiplies each row's products."""
    p = 1 + len(x) + len(y)
    columns = [*x, *y, *([weight] if weight else [])]

    def make(b: np.ndarray) -> np.ndarray:
        w = b[:, -1] if weight else np.ones(len(b))
        a = np.column_stack([np.ones(len(b)), b[:, : p - 1]])
        return (a.T @ (a * w[:, None])).ravel()

    return Gram(x, y, _blocks(df, columns, make, p * p).reshape(p, p))


def subset_grams(df: DataFrame, x: list[str], y: list[str], subsets: dict[str, Column]) -> dict[str, Gram]:
    """Products for several overlapping row subsets in one pass."""
    p, names = 1 + len(x) + len(y), list(subsets)
    marked = df.select("*", *(c.cast("double").alias(f"__in_{i}") for i, c in enumerate(subsets.values()))).na.fill(0.0, [f"__in_{i}" for i in range(len(names))])

    def make(b: np.ndarray) -> np.ndarray:
        a = np.column_stack([np.ones(len(b)), b[:, : p - 1]])
        return np.concatenate([(a.T @ (a * b[:, p - 1 + i, None])).ravel() for i in range(len(names))])

    all_ = _blocks(marked, [*x, *y, *(f"__in_{i}" for i in range(len(names)))], make, p * p * len(names)).reshape(len(names), p, p)
    return {k: Gram(x, y, m) for k, m in zip(names, all_, strict=True)}


@dataclass
class Fit:
    """A least-squares fit from a Gram matrix."""

    outcome: str
    terms: list[str]
    n: float
    beta: np.ndarray
    inverse: np.ndarray
    ssr: float
    sst: float
    rank: int
    dropped: list[str] = field(default_factory=list)

    @property
    def r2(self) -> float:
        return 1 - self.ssr / self.sst if self.sst > 0 else float("nan")

    @property
    def adjusted_r2(self) -> float:
        return 1 - (1 - self.r2) * (self.n - 1) / (self.n - len(self.beta))

    @property
    def log_likelihood(self) -> float:
        return -0.5 * self.n * (math.log(2 * math.pi * self.ssr / self.n) + 1)

    @property
    def aic(self) -> float:
        return 2 * (len(self.beta) + 1) - 2 * self.log_likelihood

    @property
    def bic(self) -> float:
        return math.log(self.n) * (len(self.beta) + 1) - 2 * self.log_likelihood


def ols(g: Gram, outcome: str, x: list[str] | None = None) -> Fit:
    """Closed form, scaled by the root of the diagonal first. Columns without variance are dropped; a rank deficiency beyond that is reported in ``rank``."""
    wanted = x if x is not None else g.x
    sums = g.part(["(intercept)"], wanted)[0]
    squares = np.array([g.part([c], [c])[0, 0] for c in wanted])
    spread = squares - sums**2 / g.n
    kept = [c for c, s, q in zip(wanted, spread, squares, strict=True) if q > 0 and s / q > 1e-12]
    terms = ["(intercept)", *kept]
    a, b = g.part(terms, terms), g.part(terms, [outcome])[:, 0]
    scale = np.sqrt(np.diag(a) / g.n)
    scaled = a / np.outer(scale, scale)
    values = np.linalg.eigvalsh(scaled)
    rank = int((values > max(g.n, len(terms)) * np.finfo(float).eps * values[-1]).sum())
    inverse = np.linalg.inv(scaled) if rank == len(terms) else np.linalg.pinv(scaled, hermitian=True)
    inverse = inverse / np.outer(scale, scale)
    beta = inverse @ b
    yy, total = g.part([outcome], [outcome])[0, 0], g.part(["(intercept)"], [outcome])[0, 0]
    return Fit(outcome, terms, g.n, beta, inverse, float(max(yy - b @ beta, 0.0)), float(yy - total**2 / g.n), rank, [c for c in wanted if c not in kept])


def _normal_p(z: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(abs(v) / math.sqrt(2)) for v in np.atleast_1d(z)])


def hc1(df: DataFrame, fit: Fit) -> list[dict]:
    """Heteroskedasticity-robust table of a fit."""
    se = np.sqrt(np.diag(robust_covariance(df, fit)))
    z = fit.beta / se
    return [{"term": t, "beta": float(b), "se": float(s), "z": float(v), "p": float(q), "low": float(b - Z95 * s), "high": float(b + Z95 * s)} for t, b, s, v, q in zip(fit.terms, fit.beta, se, z, _normal_p(z), strict=True)]


def wild_bootstrap(df: DataFrame, fit: Fit, key: str, replicates: int, seed: int) -> np.ndarray:
    """``replicates`` draws of the coefficients under Rademacher weights, which come from a hash of key, replicate and seed: no row order matters."""
    p = len(fit.terms)
    words = -(-replicates // 32)
    bits = [F.xxhash64(F.col(key), F.lit(seed), F.lit(w)).bitwiseAND(F.lit(0xFFFFFFFF)).cast("double").alias(f"__w{w}") for w in range(words)]

    def make(b: np.ndarray) -> np.ndarray:
        a = np.column_stack([np.ones(len(b)), b[:, : p - 1]])
        e = b[:, p - 1] - a @ fit.beta
        w = b[:, p:].astype(np.int64)
        signs = ((w[:, :, None] >> np.arange(32)) & 1).reshape(len(b), -1)[:, :replicates] * 2.0 - 1
        return (a.T @ (signs * e[:, None])).ravel()

    names = [*fit.terms[1:], fit.outcome, *(f"__w{w}" for w in range(words))]
    sums = _blocks(df.select("*", *bits), names, make, p * replicates).reshape(p, replicates)
    return (fit.beta[:, None] + fit.inverse @ sums).T


def robust_covariance(df: DataFrame, fit: Fit) -> np.ndarray:
    """The HC1 covariance of a fit's coefficients: a second pass sums (x e)(x e)'."""
    p = len(fit.terms)

    def make(b: np.ndarray) -> np.ndarray:
        a = np.column_stack([np.ones(len(b)), b[:, :-1]])
        u = a * (b[:, -1] - a @ fit.beta)[:, None]
        return (u.T @ u).ravel()

    meat = _blocks(df, [*fit.terms[1:], fit.outcome], make, p * p).reshape(p, p)
    return fit.inverse @ meat @ fit.inverse * fit.n / (fit.n - p)


def wald(df: DataFrame, fit: Fit, terms: list[str]) -> dict:
    """The robust Wald test that all of ``terms`` have coefficient 0: chi-squared and degrees of freedom."""
    at = [fit.terms.index(t) for t in terms]
    b = fit.beta[at]
    return {"wald_chi2": float(b @ np.linalg.solve(robust_covariance(df, fit)[np.ix_(at, at)], b)), "df": len(at)}


def bootstrap_gain(df: DataFrame, g: Gram, fit: Fit, blocks: dict[str, list[str]], key: str, replicates: int, seed: int) -> dict[str, np.ndarray]:
    """For each block of columns, ``replicates`` draws of the R-squared that the full model gains by it.

    One pseudo-outcome for all blocks: the full fit plus residuals under Rademacher signs from a hash of the key. Its products
    with the columns, and its squares, are all that a pass needs to sum.
    """
    p = len(fit.terms)
    words = -(-replicates // 32)
    bits = [F.xxhash64(F.col(key), F.lit(seed), F.lit(w)).bitwiseAND(F.lit(0xFFFFFFFF)).cast("double").alias(f"__w{w}") for w in range(words)]

    def make(b: np.ndarray) -> np.ndarray:
        a = np.column_stack([np.ones(len(b)), b[:, : p - 1]])
        guess = a @ fit.beta
        w = b[:, p:].astype(np.int64)
        signs = ((w[:, :, None] >> np.arange(32)) & 1).reshape(len(b), -1)[:, :replicates] * 2.0 - 1
        y = guess[:, None] + signs * (b[:, p - 1] - guess)[:, None]
        return np.concatenate([(a.T @ y).ravel(), (y * y).sum(axis=0)])

    names = [*fit.terms[1:], fit.outcome, *(f"__w{w}" for w in range(words))]
    sums = _blocks(df.select("*", *bits), names, make, (p + 1) * replicates).reshape(p + 1, replicates)
    xy, yy = sums[:p], sums[p]
    sst = yy - xy[0] ** 2 / fit.n

    def r2(terms: list[str]) -> np.ndarray:
        at = [fit.terms.index(t) for t in terms]
        beta = np.linalg.solve(g.part(terms, terms), xy[at])
        return 1 - (yy - (beta * xy[at]).sum(axis=0)) / sst

    full = r2(fit.terms)
    return {k: full - r2([t for t in fit.terms if t not in own]) for k, own in blocks.items()}


def nested(full: Fit, reduced: Fit) -> dict:
    """What the full model adds: R-squared gain, partial R-squared, likelihood-ratio chi-squared and its degrees of freedom."""
    return {"delta_r2": full.r2 - reduced.r2, "partial_r2": 1 - full.ssr / reduced.ssr, "lr_chi2": full.n * math.log(reduced.ssr / full.ssr), "df": len(full.beta) - len(reduced.beta)}


def huber(df: DataFrame, x: list[str], y: str, rounds: int = 8) -> dict:
    """Huber regression by reweighting: each round one weighted pass; the scale is the exact median of absolute residuals."""
    fit = ols(gram(df, x, [y]), y)
    sigma = float("nan")
    for _ in range(rounds):
        guess = F.lit(float(fit.beta[0]))
        for t, b in zip(fit.terms[1:], fit.beta[1:], strict=True):
            guess = guess + F.col(f"`{t}`").cast("double") * F.lit(float(b))
        e = F.abs(F.col(f"`{y}`").cast("double") - guess)
        sigma = exact_median(df, e) / MAD
        w = F.least(F.lit(1.0), F.lit(HUBER_K * sigma) / F.greatest(e, F.lit(1e-300)))
        fit = ols(gram(df.withColumn("__w", w), x, [y], "__w"), y)
    return {"terms": fit.terms, "beta": fit.beta.tolist(), "sigma": sigma}


def collinearity(g: Gram) -> list[dict]:
    """``term, vif`` and the condition number of the correlation matrix, with triggers: VIF above 20, condition above 100."""
    a = g.part(["(intercept)", *g.x], ["(intercept)", *g.x])
    cov = a[1:, 1:] - np.outer(a[0, 1:], a[0, 1:]) / g.n
    sd = np.sqrt(np.diag(cov))
    corr = cov / np.outer(sd, sd)
    vif = np.diag(np.linalg.inv(corr))
    values = np.linalg.eigvalsh(corr)
    condition = math.sqrt(values[-1] / max(values[0], 1e-300))
    return [{"term": t, "vif": float(v), "condition": condition, "triggered": bool(v > 20 or condition > 100)} for t, v in zip(g.x, vif, strict=True)]


def triggers(g: Gram, groups: dict[str, list[str]], vif: float = 20, condition: float = 100) -> list[dict]:
    """``what, value, triggered``: the condition number, the greatest VIF, and for each group of columns GVIF**(1/2df), against their limits."""
    rows = collinearity(g)
    out = [("condition", rows[0]["condition"], condition), ("max_vif", max(r["vif"] for r in rows), vif)]
    out += [(f"gvif:{k}", gvif(g, terms) ** (1 / (2 * len(terms))), vif) for k, terms in groups.items()]
    return [{"what": w, "value": float(v), "triggered": bool(v >= limit)} for w, v, limit in out]


def gvif(g: Gram, terms: list[str]) -> float:
    """Generalized VIF of a group of columns, by determinants."""
    a = g.part(["(intercept)", *g.x], ["(intercept)", *g.x])
    cov = a[1:, 1:] - np.outer(a[0, 1:], a[0, 1:]) / g.n
    corr = cov / np.outer(np.sqrt(np.diag(cov)), np.sqrt(np.diag(cov)))
    own = [g.x.index(t) for t in terms]
    rest = [i for i in range(len(g.x)) if i not in own]
    logdet = lambda m: np.linalg.slogdet(m)[1] if len(m) else 0.0
    return float(math.exp(logdet(corr[np.ix_(own, own)]) + logdet(corr[np.ix_(rest, rest)]) - logdet(corr)))


def principal_components(g: Gram, k: int = 2) -> dict:
    """Shares of variance and loadings of standardized columns, from the Gram matrix."""
    a = g.part(["(intercept)", *g.x], ["(intercept)", *g.x])
    cov = a[1:, 1:] - np.outer(a[0, 1:], a[0, 1:]) / g.n
    corr = cov / np.outer(np.sqrt(np.diag(cov)), np.sqrt(np.diag(cov)))
    values, vectors = np.linalg.eigh(corr)
    order = np.argsort(values)[::-1][:k]
    return {"share": (values[order] / values.sum()).tolist(), "loadings": {t: vectors[i, order].tolist() for i, t in enumerate(g.x)}}


def fit_table(spark, fits: dict[str, Fit]) -> DataFrame:  # noqa: ANN001
    """``model, term, beta, n, r2, adjusted_r2, aic, bic`` of several fits."""
    rows = [(k, t, float(b), int(f.n), f.r2, f.adjusted_r2, f.aic, f.bic) for k, f in fits.items() for t, b in zip(f.terms, f.beta, strict=True)]
    return spark.createDataFrame(rows, "model string, term string, beta double, n long, r2 double, adjusted_r2 double, aic double, bic double")
