"""Small models on numpy arrays: discriminants, factor analysis, mixtures, Kalman filters. No Spark here."""

from __future__ import annotations

import numpy as np


def lda_fit(x: np.ndarray, y: np.ndarray, shrink: float | str = "auto") -> dict:
    """Linear discriminant with a shrunk pooled covariance; ``auto`` is the Ledoit-Wolf share of standardised features."""
    classes = np.unique(y)
    means = np.stack([x[y == c].mean(0) for c in classes])
    prior = np.array([(y == c).mean() for c in classes])
    centred = x - means[np.searchsorted(classes, y)]
    cov = centred.T @ centred / len(x)
    n, p = centred.shape
    if shrink == "auto":
        mu = np.trace(cov) / p
        delta = ((cov - mu * np.eye(p)) ** 2).sum()
        beta = min((((centred**2).T @ (centred**2)) / n - cov**2).sum() / n, delta)
        shrink = beta / delta if delta > 0 else 0.0
    cov = (1 - shrink) * cov + shrink * np.trace(cov) / p * np.eye(p)
    coef = np.linalg.pinv(cov) @ means.T
    return {"classes": classes, "coef": coef, "bias": np.log(prior) - 0.5 * np.einsum("ij,ji->i", means, coef)}


def lda_predict(model: dict, x: np.ndarray) -> np.ndarray:
    return model["classes"][np.argmax(x @ model["coef"] + model["bias"], 1)]


def stratified_folds(y: np.ndarray, folds: int, seed: int) -> np.ndarray:
    """Fold of each row, each class dealt evenly in a seeded order."""
    rng, out = np.random.default_rng(seed), np.empty(len(y), int)
    start = 0
    for c in np.unique(y):
        at = rng.permutation(np.flatnonzero(y == c))
        out[at] = (np.arange(len(at)) + start) % folds
        start += len(at)
    return out


def lda_cross_validate(x: np.ndarray, y: np.ndarray, folds: int = 5, repeats: int = 1, seed: int = 1, shrink: float | str = "auto") -> list[float]:
    """Accuracy of each fold of each repeat."""
    out = []
    for r in range(repeats):
        fold = stratified_folds(y, folds, seed + r)
        for k in range(folds):
            test = fold == k
            if test.any() and len(np.unique(y[~test])) > 1:
                out.append(float((lda_predict(lda_fit(x[~test], y[~test], shrink), x[test]) == y[test]).mean()))
    return out


def factor_fit(x: np.ndarray, k: int, rounds: int = 1000, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, loadings and noise variances of a factor model by expectation maximisation."""
    mean = x.mean(0)
    s = np.cov((x - mean).T, bias=True).reshape(x.shape[1], -1)
    value, vector = np.linalg.eigh(s)
    load, noise = vector[:, ::-1][:, :k] * np.sqrt(np.maximum(value[::-1][:k], 1e-12)), np.maximum(np.diag(s).copy(), 1e-12)
    before = -np.inf
    for _ in range(rounds):
        inv = load / noise[:, None]
        g = np.linalg.inv(np.eye(k) + load.T @ inv)
        beta = g @ inv.T
        second = g + beta @ s @ beta.T
        load = s @ beta.T @ np.linalg.inv(second)
        noise = np.maximum(np.diag(s - load @ beta @ s), 1e-12)
        now = factor_score(x, mean, load, noise)
        if now - before < tolerance:
            break
        before = now
    return mean, load, noise


def factor_score(x: np.ndarray, mean: np.ndarray, load: np.ndarray, noise: np.ndarray) -> float:
    """Mean log-likelihood of rows."""
    cov = load @ load.T + np.diag(noise)
    d = x - mean
    _, logdet = np.linalg.slogdet(cov)
    return float(-0.5 * (len(mean) * np.log(2 * np.pi) + logdet + np.einsum("ij,ij->i", d @ np.linalg.inv(cov), d)).mean())


def mixture_fit(x: np.ndarray, k: int = 2, rounds: int = 200, seed: int = 0) -> np.ndarray:
    """Class of each row of a Gaussian mixture (full covariances), classes in order of their first mean."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    mean = x[rng.choice(n, k, replace=False)]
    for _ in range(10):  # k-means first
        near = ((x[:, None] - mean[None]) ** 2).sum(-1).argmin(1)
        mean = np.stack([x[near == j].mean(0) if (near == j).any() else mean[j] for j in range(k)])
    r = np.eye(k)[near]
    for _ in range(rounds):
        w = r.sum(0) + 1e-9
        mean = (r.T @ x) / w[:, None]
        logp = np.empty((n, k))
        for j in range(k):
            c = x - mean[j]
            cov = (r[:, j, None] * c).T @ c / w[j] + 1e-6 * np.eye(d)
            _, ld = np.linalg.slogdet(cov)
            logp[:, j] = np.log(w[j] / n) - 0.5 * (ld + np.einsum("ij,ij->i", c @ np.linalg.inv(cov), c))
        new = np.exp(logp - logp.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        if np.abs(new - r).max() < 1e-6:
            break
        r = new
    order = np.argsort(np.argsort(mean[:, 0]))
    return order[r.argmax(1)]


def kalman_fit(x: np.ndarray, y: np.ndarray, c: float = 1.0) -> dict:
    """State and observation models of states x (time x dims) and observations y, by least squares."""
    a, b = x[:-1], x[1:]
    A = b.T @ a @ np.linalg.inv(a.T @ a)
    W = (b - a @ A.T).T @ (b - a @ A.T) / (len(x) - 1) / c
    H = y.T @ x @ np.linalg.inv(x.T @ x)
    Q = (y - x @ H.T).T @ (y - x @ H.T) / len(x)
    return {"A": A, "W": W, "H": H, "Q": Q}


def kalman_predict(model: dict, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """States in sequence from the observations."""
    A, W, H, Q = model["A"], model["W"], model["H"], model["Q"]
    n = len(A)
    state, p = np.asarray(start, float), np.zeros((n, n))
    out = np.empty((len(y), n))
    out[0] = state
    for t in range(1, len(y)):
        prior, pm = A @ state, A @ p @ A.T + W
        gain = pm @ H.T @ np.linalg.pinv(H @ pm @ H.T + Q)
        state, p = prior + gain @ (y[t] - H @ prior), (np.eye(n) - gain @ H) @ pm
        out[t] = state
    return out


def trough_peak(x: np.ndarray) -> tuple[int, int]:
    """Index of the least value and of the last rise after it."""
    t = int(np.argmin(x))
    after = np.flatnonzero(np.diff(x[t:]) < 0)
    return t, t + int(after[0]) if len(after) else len(x) - 1
