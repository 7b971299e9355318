"""Mixing documents to target weights with soft domain membership.

A labelled table teaches a multinomial classifier (chosen hashed words and marks, calibrated) that gives each document a
posterior over domains, shown in thousandths. With t tokens and posterior p, a document at rate r adds r*t*p to the
domain totals. Nonnegative rates are fitted by accelerated projected gradient steps on the squared relative distance
of expected totals from targets, in the metric that weighs a document by its tokens, so that documents of one
posterior share one rate. Totals of tokens and of unrounded domain mass are therefore summed once for each rounded
posterior before the iteration; each step is one small aggregation on the executors, and only the vector of domain
residuals comes to the driver. The residuals of all steps are then replayed over the documents' unrounded posteriors.

Rows draw their copies each for itself: rows without an id, or of one id with different texts, do not go or stay
together; rows equal in id and text do.

Steps end when every posterior meets the optimality test: with rates in units of the start rate and g the sum of p times
the relative residuals, |min(rate, g)| is at most the tolerance (so g is about 0 where the rate is positive, and not
below 0 where it is 0). Where ``max_steps`` comes first, a warning gives the value reached; the result carries it.

Edge cases: null and empty texts have no tokens and take rate 1; without labels there is one domain and every rate is
the share asked for; a target for a domain that was never learned is ignored and the others are rescaled; repeated
rows are separate documents; extra columns are carried along untouched.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainspark.functions.durable import durable, release
from grainspark.llm.common import WordHasher, in_sample, map_texts, named, small_batches
from grainspark.llm.langid import fit_ftrl, fit_temperature, softmax
from grainspark.llm.selected import among, choose, chosen_rows, term_cells

GRID = 1000
TYPES_A_TASK = 20_000
#: As ``total_tokens``: as many tokens as the documents have, scarce domains getting rates above 1; or the greatest size at which no domain must be repeated.
INPUT, UNREPEATED = "input", "unrepeated"


@dataclass
class DomainModel:
    domains: list[str]
    cells: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, 1)))  # the last column belongs to a constant
    temperature: float = 1.0
    prior: np.ndarray | float = 0.0  # log odds of the labelled table against the even sample

    def posteriors(self, hasher: WordHasher, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(posterior in whole thousandths, tokens, unrounded posterior) for each text."""
        owner, found, tokens = term_cells(hasher, texts)
        owner, at = among(self.cells, owner, found)
        logits = np.stack([w[-1] + np.bincount(owner, w[at], len(texts)) for w in self.weights], 1)
        p = softmax(logits / self.temperature + self.prior)
        grid = np.floor(p * GRID).astype(np.int64)
        grid[np.arange(len(grid)), p.argmax(1)] += GRID - grid.sum(1)
        return grid, tokens, p


def train(docs: DataFrame, labels: DataFrame, domain: Column, text: str = "text", id_col: str = "doc_id", max_rows: int = 16_000, epochs: int = 4) -> DomainModel:
    """Learn domains from a labelled table; ``domain`` is a string column of it, null for rows without one.

    ``max_rows`` bounds the labelled rows that are learned from, dealt evenly over the domains by a hash of the id; it
    also bounds the broadcast of (id, domain) that picks their texts.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), domain.alias("domain")).where(F.col("id").isNotNull() & F.col("domain").isNotNull()).groupBy("id").agg(F.max("domain").alias("domain"))
    sizes = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = sorted(sizes)
    if len(domains) < 2:
        return DomainModel(domains or ["all"])
    chosen, number = F.lit(False), F.lit(0)
    for k, d in enumerate(domains):
        chosen = chosen | ((F.col("domain") == d) & in_sample("id", max_rows / len(domains) / sizes[d]))
        number = F.when(F.col("domain") == d, k).otherwise(number)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(known.where(chosen).select("id", number.alias("label"))), "id")
    cells = choose(picked, [min(sizes[d], max_rows / len(domains)) for d in domains], marks=True)
    found, y = chosen_rows(picked, cells, marks=True)
    rows = [(np.append(at, len(cells)), np.ones(len(at) + 1)) for at in found]
    held = np.arange(len(rows)) % 5 == 4
    fitted, tested = np.flatnonzero(~held), np.flatnonzero(held)
    weights = fit_ftrl([rows[i] for i in fitted], y[fitted], len(domains), len(cells) + 1, epochs, alpha=0.1, l1=0.3, l2=0.05)
    logits = np.array([weights[:, rows[i][0]] @ rows[i][1] for i in tested]) if len(tested) else np.zeros((0, len(domains)))
    prior = np.log(np.array([sizes[d] for d in domains]) / np.maximum(np.bincount(y, minlength=len(domains)), 1))
    return DomainModel(domains, cells, weights, fit_temperature(logits, y[tested]), prior - prior.max())


@dataclass
class Steps:
    """A fitted mixture: replaying its residuals gives the rate of any posterior."""

    scale: np.ndarray
    step: float
    residuals: list[np.ndarray]
    shift: float = 1.0
    restarts: set[int] = field(default_factory=set)  # residuals before which the momentum was dropped
    gap: float = np.inf  # the optimality test at the last residual

    def rates(self, p: np.ndarray) -> np.ndarray:
        return self.replay(p)[0]

    def replay(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(rates after the last step, the point where the next residual is taken, optimality test of the last residual)."""
        r = np.full(len(p), self.shift)
        look, t, gap = r.copy(), 1.0, np.inf
        for k, e in enumerate(self.residuals):
            if k in self.restarts:
                t = 1.0
            down = p @ (self.scale * e)
            if k == len(self.residuals) - 1:
                gap = float(np.abs(np.minimum(look / max(self.shift, 1e-300), down)).max(initial=0.0))
            new = np.maximum(0.0, look - self.step * down)
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            look = new + (t - 1) / t_new * (new - r)
            r, t = new, t_new
        return r, look, gap


def fit_rates(types: DataFrame, domains: int, targets: np.ndarray, max_steps: int = 400, tolerance: float = 1e-4) -> Steps:
    """Rates for posteriors: ``types`` is a stored table of (p array<int> in thousandths, tokens double) and, if the
    posteriors were rounded, mass array<double>: the tokens times unrounded posteriors.

    A step is one stage over the table in tasks of about ``TYPES_A_TASK`` posteriors.
    """
    types = types.coalesce(1 + types.count() // TYPES_A_TASK)

    def sums(f):
        """Sums of f's vectors over the table, and the greatest of its numbers."""

        def run(batches):
            total, most = np.zeros(domains * domains), 0.0
            for pdf in batches:
                tokens = pdf["tokens"].to_numpy()
                if "mass" in pdf:
                    p = np.array(pdf["mass"].tolist(), float).reshape(-1, domains) / tokens[:, None]
                else:
                    p = np.array(pdf["p"].tolist(), float).reshape(-1, domains) / GRID
                part, number = f(p, tokens)
                total[: len(part)] += part
                most = max(most, number)
            yield pd.DataFrame({"k": np.arange(-1, len(total)), "v": np.append(most, total)})

        out, most = np.zeros(domains * domains), 0.0
        for r in types.mapInPandas(run, "k int, v double").collect():  # a few sums from each of few tasks
            if r["k"] < 0:
                most = max(most, r["v"])
            else:
                out[r["k"]] += r["v"]
        return out, most

    def totals(p, t):
        look, gap = steps.replay(p)[1:]
        return (look * t) @ p, gap

    scale = 1 / np.maximum(targets, 1e-9)
    curvature = sums(lambda p, t: ((p.T @ (p * t[:, None])).ravel(), 0.0))[0].reshape(domains, domains)
    greatest = np.linalg.eigvalsh(np.sqrt(scale)[:, None] * curvature * np.sqrt(scale)[None, :])[-1]
    now = curvature.sum(1).sum()
    steps = Steps(scale, 1 / max(greatest, 1e-12), [], float(targets.sum() / max(now, 1e-9)))
    before = np.inf
    for k in range(max_steps + 1):
        total, steps.gap = sums(totals)
        e = total[:domains] - targets
        if np.abs(e * scale).max() < tolerance:
            steps.gap = float(np.abs(e * scale).max())
        if now <= 0 or k and steps.gap <= tolerance or k == max_steps:
            break
        worth = float((e * e * scale).sum())
        if worth > before:
            steps.restarts.add(k)
        before = worth
        steps.residuals.append(e)
    if now > 0 and steps.gap > tolerance:
        warnings.warn(f"mixture rates: optimality test at {steps.gap:.2g} after {max_steps} steps, wanted {tolerance:.2g}", stacklevel=2)
    return steps


def mix(docs: DataFrame, model: DomainModel, weights: dict[str, float], total_tokens: float | str = INPUT, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Add tokens, domain (the likeliest), posterior (thousandths by domain), rate, copies and gap to the documents.

    ``total_tokens`` is the size of the mixture: a number, by default the documents' own size (``INPUT``), or
    ``UNREPEATED``, which a scarce domain makes small.
    ``copies`` is the rate rounded down or up by a hash of id and text (and of the row's place in its partition if the
    id is null), so that its expectation is the rate. ``gap`` is the optimality test's value, the same for all rows.
    """
    new = ("tokens", "domain", "posterior", "rate", "copies", "gap")
    kept = [c for c in docs.columns if c not in new]
    domains = model.domains

    def masses():
        hasher = WordHasher(marks=True)

        def run(texts):
            grid, tokens, p = model.posteriors(hasher, texts)
            mass = pd.DataFrame(p * tokens[:, None])
            mass["p"], mass["tokens"] = [tuple(g) for g in grid.tolist()], tokens.astype(float)
            one = mass.groupby("p", as_index=False).sum()
            return np.zeros(len(one), np.int64), [one["p"].map(list).tolist(), one["tokens"].to_numpy(), one[list(range(len(domains)))].to_numpy().tolist()]

        return run

    found = map_texts(docs.select(named(text).alias("text")), "text", [], "p array<int>, tokens double, mass array<double>", masses)
    found = found.groupBy("p").agg(F.sum("tokens").alias("tokens"), F.array(*(F.sum(F.col("mass")[k]) for k in range(len(domains)))).alias("mass"))
    types = durable(found.where("tokens > 0"))
    share = np.array([max(0.0, weights.get(d, 0.0)) for d in domains])
    share = share / share.sum() if share.sum() > 0 else np.full(len(domains), 1 / len(domains))
    natural = np.zeros(len(domains))
    for r in types.select(F.posexplode("mass").alias("d", "v")).groupBy("d").agg(F.sum("v").alias("v")).collect():
        natural[r["d"]] = r["v"]
    if total_tokens == UNREPEATED:
        wanted = (share > 0) & (natural > 0)
        total_tokens = float((natural[wanted] / share[wanted]).min(initial=np.inf)) if wanted.any() else float(natural.sum())
    elif total_tokens == INPUT:
        total_tokens = float(natural.sum())
    steps = fit_rates(types, len(domains), share * total_tokens)

    release(types)

    def rated():
        hasher = WordHasher(marks=True)

        def run(texts, u):
            grid, tokens, p = model.posteriors(hasher, texts)
            rate = np.where(tokens > 0, steps.rates(p), 1.0)
            copies = np.floor(rate).astype(np.int32) + (u.to_numpy() < np.modf(rate)[0])
            gap = np.full(len(rate), steps.gap if np.isfinite(steps.gap) else 0.0)
            return None, [tokens.astype(np.int64), [domains[k] for k in grid.argmax(1)], grid.tolist(), rate, copies.astype(np.int32), gap]

        return run

    place = F.when(named(id_col).isNull(), F.monotonically_increasing_id())
    u = F.pmod(F.xxhash64(F.lit("copies"), named(id_col), named(text), place), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return map_texts(docs, text, kept, "tokens long, domain string, posterior array<int>, rate double, copies int, gap double", rated, (u,))
