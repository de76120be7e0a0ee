"""Mixing to target weights with soft membership: every document belongs to all domains by its posterior.

A classifier fitted on a table of labelled texts gives each document's posterior over the domains.  Document rates r >= 0 then
minimise the squared distance between expected domain token totals, sum over documents of
r * tokens * posterior, and their targets.  Projected gradient descent does this without ever holding the rates: in
the metric that weighs documents by their tokens a step subtracts posterior . residual, the same numbers for all
documents, and cuts at zero; so a document's rate follows from its posterior and the short list of residuals so
far.  A step is one pass over (tokens, posterior) that sends a few sums to the driver.  Where ``STEPS`` of these leave the
targets unmet, as with rare domains, Newton's method on the dual problem, of one number for each domain, finds one last
step that meets them.  Targets that no rates meet are approached as far as can be, with a warning that says how far.

The classifier is naive Bayes over hashed words, tempered on a part of the sample that did not count: without that the
posteriors of long texts would all be 0 or 1.  The fit reads at most ``rows_per_domain`` labelled rows of each domain and
takes every labelled domain, however rare.  Tokens are words of the text, as the posteriors are made of them.

Defined results: a null text has no tokens; its posterior is the prior and its rate follows from that.  Rows with null labels are
left out of the fit.  Repeated rows each have a rate.  Without labelled rows there is one domain, ``all``.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import written
from spanwright.llm.linear_text import BITS, hashed_words, labelled_sample

STEPS = 80
TOLERANCE = 1e-4
LAST_STEPS = 200
#: Weight of the last step's own length, so that it is finite where targets are out of reach.
RIDGE = 1e-8


@dataclass(frozen=True)
class DomainModel:
    domains: tuple[str, ...]
    log_prior: np.ndarray
    words: np.ndarray  # sorted hashes
    log_likelihood: np.ndarray  # a row for each word, a column for each domain
    temper: float

    def posterior(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, ids)
        at[at == len(self.words)] = 0
        known = self.words[at] == ids if len(self.words) else np.zeros(len(ids), bool)
        z = self.log_prior.copy()
        if known.any():
            weight = counts[known].astype(float)
            z = z + self.temper * np.sqrt(weight.sum()) * (weight @ self.log_likelihood[at[known]]) / weight.sum()
        z = np.exp(z - z.max())
        return z / z.sum()


def fit_domains(documents: DataFrame, labelled: DataFrame, rows_per_domain: int = 1000, least_rows: int = 3) -> DomainModel:
    """``labelled`` has doc_id and domain (a string)."""
    sample, sizes = labelled_sample(documents, labelled.where("domain is not null"), ["domain"], rows_per_domain)
    names = sorted(n for (n,) in sizes)
    if not names:
        return DomainModel(("all",), np.zeros(1), np.empty(0, np.int64), np.empty((0, 1)), 1.0)
    place = {n: k for k, n in enumerate(names)}
    y = np.array([place[d] for d in sample["domain"]], int)
    prior = np.array([sizes.get((n,), 0) + 1 for n in names], float)
    log_prior = np.log(prior / prior.sum())
    fitted = np.arange(len(y)) % 4 != 3
    seen = np.zeros(1 << BITS, np.int64)
    for k in np.flatnonzero(fitted):
        seen[np.asarray(sample["ids"][k], int)] += 1
    words = np.flatnonzero(seen >= least_rows)
    totals = np.zeros((len(names), len(words)))
    for k in np.flatnonzero(fitted):
        ids, counts = np.asarray(sample["ids"][k], int), np.asarray(sample["counts"][k], float)
        often = seen[ids] >= least_rows
        totals[y[k], np.searchsorted(words, ids[often])] += counts[often]
    smooth = totals + 0.5
    log_likelihood = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T if len(words) else np.empty((0, len(names)))
    best = None
    for temper in 2.0 ** np.arange(-4, 5):
        model = DomainModel(tuple(names), log_prior, words, log_likelihood, float(temper))
        loss = 0.0
        for k in np.flatnonzero(~fitted):
            p = model.posterior(np.asarray(sample["ids"][k], int), np.asarray(sample["counts"][k], float))
            loss -= np.log(max(p[y[k]], 1e-12))
        if best is None or loss < best[0]:
            best = (loss, model)
    return best[1]


def posteriors(documents: DataFrame, model: DomainModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens (words of the whole text) and p0, p1, ... for every row."""
    columns = [f"p{k}" for k in range(len(model.domains))]

    def run(batches):
        for frame in batches:
            made = [hashed_words(t) for t in frame["text"]]
            p = np.array([model.posterior(*m) for m in made]).reshape(len(made), -1)
            out = pd.DataFrame({"key": frame["key"], "n_tokens": [int(m[1].sum()) for m in made]})
            yield pd.concat([out, pd.DataFrame(p, columns=columns)], axis=1)

    kind = f"key {dict(documents.dtypes)[key]}, n_tokens long, " + ", ".join(f"{c} double" for c in columns)
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, kind).withColumnRenamed("key", key)


def _rates(p: np.ndarray, residuals: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Replay the projected steps for documents with posteriors ``p``, from rate 1."""
    rate = np.ones(len(p))
    for step in residuals:
        rate = np.maximum(least, rate - p @ step)
    return rate


@dataclass(frozen=True)
class Mixture:
    domains: tuple[str, ...]
    targets: np.ndarray
    reached: np.ndarray
    residuals: np.ndarray
    least: float = 0.0

    def rate(self) -> Column:
        residuals, least = self.residuals, self.least

        @F.pandas_udf("double")
        def of(*p: pd.Series) -> pd.Series:
            return pd.Series(_rates(np.column_stack([x.to_numpy() for x in p]), residuals, least))

        return of(*[F.col(f"p{k}") for k in range(len(self.domains))])


def rate_of_text(text: Column, model: DomainModel, mixture: Mixture) -> Column:
    """The fitted rate straight from the text, so that a table of documents need not be joined with its rates."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        p = np.array([model.posterior(*hashed_words(t)) for t in texts]).reshape(len(texts), -1)
        return pd.Series(_rates(p, mixture.residuals, mixture.least))

    return of(text)


def _last_step(members: DataFrame, residuals: np.ndarray, goal: np.ndarray, total: float, least: float) -> np.ndarray:
    """The step after which the rates are the nearest ones, by tokens, that meet the goal, or come closest to it.

    Rates are counted from ``least`` on, and ``goal`` is what they are to add to the tokens that come with it.
    """
    d = len(goal)

    def value(step: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def sums(batches):
            for frame in batches:
                p, tokens = frame[[f"p{k}" for k in range(d)]].to_numpy(), frame["n_tokens"].to_numpy(float)
                rate = _rates(p, residuals, least) - least - p @ step
                mass, on = np.maximum(rate, 0) * tokens, np.where(rate > 0, tokens, 0)
                parts = [[mass @ np.maximum(rate, 0) / 2], mass @ p, ((p * on[:, None]).T @ p).ravel()]
                yield pd.DataFrame({"sums": [np.concatenate(parts)]})

        local = members.select("n_tokens", *[f"p{k}" for k in range(d)]).mapInPandas(sums, "sums array<double>")
        summed = local.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).toPandas()
        got = np.zeros(1 + d + d * d)
        got[summed["at"].to_numpy(int)] = summed["x"].to_numpy() / total
        f = got[0] + goal @ step + RIDGE / 2 * step @ step
        return f, got[1 : 1 + d] - goal - RIDGE * step, got[1 + d :].reshape(d, d)

    step = np.zeros(d)
    f, down, curve = value(step)
    for _ in range(LAST_STEPS):
        if np.abs(down).max() <= TOLERANCE / 2:
            return step
        way = np.linalg.solve(curve + RIDGE * np.eye(d), down)
        part = 1.0
        new = value(step + way)
        while new[0] > f - 1e-4 * part * (way @ down) + 1e-12 * (1 + abs(f)) and part > 1e-9:
            part /= 2
            new = value(step + part * way)
        step = step + part * way
        f, down, curve = new
    raise RuntimeError(f"rates not found after {STEPS} steps and {LAST_STEPS} more; the shares still differ by {np.abs(down).max():.2g}")


def fit_rates(members: DataFrame, domains: tuple[str, ...], targets: np.ndarray, steps: int | None = None, least: float = 0.0) -> Mixture:
    """``members`` has n_tokens and p0, p1, ...; ``targets`` are token totals, one for each domain.

    No rate is under ``least``.  With ``steps`` only so many gradient steps are done, met or not; ``reached`` says how far they came.
    """
    d = len(domains)
    columns = [F.col(f"p{k}") for k in range(d)]
    weigh = lambda x: F.coalesce(F.sum(F.col("n_tokens") * x), F.lit(0.0))
    moments = members.select(*[weigh(a * b) for i, a in enumerate(columns) for b in columns[i:]], weigh(F.lit(1.0))).first()
    total = max(float(moments[-1]), 1.0)
    gram = np.zeros((d, d))
    gram[np.triu_indices(d)] = np.array(moments[:-1], float) / total
    gram = gram + np.triu(gram, 1).T
    pace = 1 / max(float(np.linalg.eigvalsh(gram)[-1]), 1e-9)
    goal = np.asarray(targets, float) / total
    residuals = np.zeros((0, d))

    def reached() -> np.ndarray:
        history = residuals

        def sums(batches):
            for frame in batches:
                p = frame[[f"p{k}" for k in range(d)]].to_numpy()
                mass = (_rates(p, history, least) * frame["n_tokens"].to_numpy()) @ p
                yield pd.DataFrame([mass], columns=[f"s{k}" for k in range(d)])

        local = members.select("n_tokens", *columns).mapInPandas(sums, ", ".join(f"s{k} double" for k in range(d)))
        got = local.agg(*[F.coalesce(F.sum(f"s{k}"), F.lit(0.0)) for k in range(d)]).first()
        return np.array(got, float) / total

    now = reached()
    for _ in range(STEPS if steps is None else steps):
        gap = now - goal
        if np.abs(gap).max() <= TOLERANCE:
            break
        residuals = np.vstack([residuals, pace * gap])
        now = reached()
    if steps is None and np.abs(now - goal).max() > TOLERANCE:
        rest = goal - least * token_totals(members, d) / total
        residuals = np.vstack([residuals, _last_step(members, residuals, rest, total, least)])
        now = reached()
        if np.abs(now - goal).max() > TOLERANCE:
            far = ", ".join(f"{n} {a * total:.0f} of {g * total:.0f}" for n, a, g in zip(domains, now, goal))
            warnings.warn(f"no rates meet the targets; tokens reached: {far}", stacklevel=2)
    return Mixture(domains, np.asarray(targets, float), now * total, residuals, least)


def token_totals(members: DataFrame, d: int) -> np.ndarray:
    got = members.agg(*[F.coalesce(F.sum(F.col("n_tokens") * F.col(f"p{k}")), F.lit(0.0)) for k in range(d)]).first()
    return np.array(got, float)


def copies(rate: Column, key: Column) -> Column:
    """Whole copies of a document: the rate's integer part, and one more with its fraction's chance, by hash of the key."""
    chance = F.pmod(F.xxhash64(F.lit("copies"), key), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int")


def mix(documents: DataFrame, model: DomainModel, weights: Mapping[str, float] | None = None) -> tuple[DataFrame, Mixture]:
    """doc_id, n_tokens, domain (the likeliest), posteriors, rate and copies; as many tokens in all as there are.

    ``weights`` are the domains' shares of the tokens, equal shares if not given; unnamed domains get none.  A weight of
    a domain that no labelled row names can't be met; a warning says so.
    """
    unknown = sorted(n for n, w in (weights or {}).items() if w > 0 and n not in model.domains)
    if unknown:
        warnings.warn(f"no labelled rows of {', '.join(unknown)}: the other weights are raised to make up for theirs", stacklevel=2)
    members = written(posteriors(documents, model), "members")
    d = len(model.domains)
    shares = np.array([(weights or {}).get(name, 0.0) for name in model.domains]) if weights else np.ones(d)
    if not shares.sum() > 0:
        shares = np.ones(d)
    mixture = fit_rates(members, model.domains, shares / shares.sum() * token_totals(members, d).sum())
    p = [F.col(f"p{k}") for k in range(d)]
    top = F.greatest(*p) if d > 1 else p[0]
    domain = F.coalesce(*[F.when(c == top, F.lit(n)) for n, c in zip(model.domains, p)])
    out = members.withColumn("rate", mixture.rate()).select(
        "doc_id", "n_tokens", domain.alias("domain"), F.array(*p).alias("posteriors"), "rate"
    )
    return out.withColumn("copies", copies(F.col("rate"), F.col("doc_id"))), mixture
