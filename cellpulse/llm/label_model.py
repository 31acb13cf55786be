"""Weak-label model: expectation-maximisation over votes of overlapping labellers.

Each labeller votes 1, 0 or abstains (-1) on each item. Only the count of
every *vote pattern* is needed, so Spark counts all items by pattern and the
driver fits the model on the patterns: at most ``3 ** labellers`` rows, the
same table however many items there are.
"""

from __future__ import annotations

import numpy as np

VOTES = (-1, 0, 1)


class LabelModel:
    """Class-conditional vote probabilities of each labeller, and the class prior."""

    def __init__(self, prior: float, table: np.ndarray):
        self.prior, self.table = prior, table  # table[labeller, class, vote + 1]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(class 1) of each row of votes."""
        log = np.log(np.array([1 - self.prior, self.prior]))[None, :].repeat(len(votes), axis=0)
        for j in range(votes.shape[1]):
            log += np.log(self.table[j][:, votes[:, j] + 1]).T
        gap = np.clip(log[:, 0] - log[:, 1], -700, 700)
        return 1 / (1 + np.exp(gap))

    def accuracies(self) -> np.ndarray:
        """P(vote is right | labeller votes) of each labeller."""
        p = np.array([1 - self.prior, self.prior])
        right = p[0] * self.table[:, 0, 1] + p[1] * self.table[:, 1, 2]
        return right / (p[:, None] * self.table[:, :, 1:].sum(axis=2).T).sum(axis=0)


def fit(patterns: list[tuple[int, ...]], counts: list[int], rounds: int = 200,
        smooth: float = 1.0, prior: float = 0.5, anchor: float = 0.8, silent: bool = False) -> LabelModel:
    """Maximum a posteriori by EM, from vote patterns and how many items have each.

    By default a labeller's abstention is evidence like a vote: a detector of
    one kind of junk that stays silent speaks for an item. With ``silent`` it
    says nothing: labellers that abstain where they do not apply (a word list
    on a text in another language) have one rate of abstention for both
    classes.

    Every labeller starts at accuracy ``anchor`` and keeps that as a weak
    prior (``smooth`` pseudo-votes), which fixes which class is 1. No patterns
    at all give the starting model; a pattern of abstentions only stays at
    the class prior.
    """
    n = len(patterns[0]) if patterns else 0
    votes = np.array(patterns, dtype=np.int64).reshape(len(patterns), n)
    weight = np.array(counts, dtype=float)
    base = np.empty((n, 2, 3))
    base[:, 0] = (1.0, anchor, 1 - anchor)
    base[:, 1] = (1.0, 1 - anchor, anchor)
    base /= base.sum(axis=2, keepdims=True)
    model = LabelModel(prior, base.copy())
    for _ in range(rounds if len(patterns) else 0):
        one = model.posterior(votes)
        table = smooth * base.copy()
        for j in range(n):
            for v in VOTES:
                has = votes[:, j] == v
                table[j, 1, v + 1] += (weight * one)[has].sum()
                table[j, 0, v + 1] += (weight * (1 - one))[has].sum()
        if silent:
            rate = table[:, :, 0].sum(axis=1) / table.sum(axis=(1, 2))
            table[:, :, 1:] *= ((1 - rate)[:, None] / table[:, :, 1:].sum(axis=2))[:, :, None]
            table[:, :, 0] = rate[:, None]
        table /= table.sum(axis=2, keepdims=True)
        total = weight.sum()
        new_prior = float(((weight * one).sum() + smooth * prior) / (total + smooth))
        moved = np.abs(table - model.table).max() + abs(new_prior - model.prior)
        model = LabelModel(min(max(new_prior, 1e-6), 1 - 1e-6), table)
        if moved < 1e-9:
            break
    return model


def logistic(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, size: int,
             rounds: int = 60, rate: float = 0.5, penalty: float = 1e-5) -> np.ndarray:
    """Weights of a sparse logistic scorer (last one the intercept) for soft targets.

    ``rows`` are (indices, values) per item. Full-batch descent with one step
    size per weight (AdaGrad), the classes weighted equally; the same input gives
    the same weights.
    """
    weights, seen = np.zeros(size + 1), np.full(size + 1, 1e-8)
    if not rows:
        return weights
    index = np.concatenate([np.append(i, size) for i, _ in rows]).astype(np.int64)
    value = np.concatenate([np.append(v, 1.0) for _, v in rows])
    item = np.repeat(np.arange(len(rows)), [len(i) + 1 for i, _ in rows])
    share = min(max(float(target.mean()), 1e-3), 1 - 1e-3)
    balance = (target / share + (1 - target) / (1 - share)) / 2
    for _ in range(rounds):
        z = np.bincount(item, weights=weights[index] * value, minlength=len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * balance / len(rows)
        gradient = np.bincount(index, weights=error[item] * value, minlength=size + 1) + penalty * weights
        seen += gradient ** 2
        weights -= rate * gradient / np.sqrt(seen)
    return weights
