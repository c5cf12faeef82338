"""Plain one-group versions of what the library computes by sums, to test against."""

import math

import numpy as np


def cox_terms(time: np.ndarray, event: np.ndarray, eta: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log partial likelihood (Breslow ties), its gradient and Hessian; x is n x p."""
    order = np.argsort(-time, kind="stable")
    t, e, z = time[order], event[order].astype(bool), x[order]
    shift = eta.max(initial=0.0)
    w = np.exp(np.clip(eta[order] - shift, -50, 50))
    last = np.searchsorted(-t, -t, "right") - 1  # a time's risk set takes all its ties
    s0 = np.cumsum(w)[last]
    s1 = np.cumsum(w[:, None] * z, 0)[last]
    s2 = np.cumsum(w[:, None, None] * z[:, :, None] * z[:, None, :], 0)[last]
    mean = s1 / s0[:, None]
    loss = -(eta[order][e] - shift - np.log(s0[e])).sum()
    gradient = -(z[e] - mean[e]).sum(0)
    hessian = (s2[e] / s0[e, None, None] - mean[e][:, :, None] * mean[e][:, None, :]).sum(0)
    return float(loss), gradient, hessian


def ridge_cox(time: np.ndarray, event: np.ndarray, x: np.ndarray, penalty: float = 0.0, centre: np.ndarray | None = None, steps: int = 40) -> tuple[np.ndarray, bool]:
    """Newton fit of a Cox model with a quadratic penalty towards ``centre``; halves a step that does not help."""
    p = x.shape[1]
    centre = np.zeros(p) if centre is None else centre
    beta = centre.copy()

    def value(b: np.ndarray) -> float:
        return cox_terms(time, event, x @ b, x)[0] + penalty / 2 * ((b - centre) ** 2).sum()

    now = value(beta)
    for _ in range(steps):
        _, g, h = cox_terms(time, event, x @ beta, x)
        g = g + penalty * (beta - centre)
        if np.abs(g).max(initial=0.0) < 1e-8 * max(1, len(time)):
            return beta, True
        step = np.linalg.lstsq(h + penalty * np.eye(p), g, rcond=None)[0]
        for _ in range(30):
            new = value(beta - step)
            if new <= now + 1e-12:
                break
            step = step / 2
        beta, moved, now = beta - step, now - new, new
        if abs(moved) < 1e-12 * max(1, abs(now)):
            return beta, True
    return beta, False


def elastic_net_cox(time: np.ndarray, event: np.ndarray, x: np.ndarray, alphas: np.ndarray, l1_ratio: float, sweeps: int = 50) -> np.ndarray:
    """Coefficients along a falling path of penalties: coordinate descent on the quadratic approximation."""
    n, p = x.shape
    beta, out = np.zeros(p), []
    for alpha in alphas:
        for _ in range(10):
            _, g, h = cox_terms(time, event, x @ beta, x)
            g, h = g / n, h / n
            new, slope = beta.copy(), g.copy()
            for _ in range(sweeps):
                change = 0.0
                for j in range(p):
                    if h[j, j] <= 0:
                        continue
                    target = h[j, j] * new[j] - slope[j]
                    b = math.copysign(max(abs(target) - alpha * l1_ratio, 0), target) / (h[j, j] + alpha * (1 - l1_ratio))
                    delta = b - new[j]
                    if delta:
                        new[j] = b
                        slope += h[:, j] * delta
                        change = max(change, abs(delta))
                if change < 1e-8:
                    break
            done = np.abs(new - beta).max(initial=0.0) < 1e-7
            beta = new
            if done:
                break
        out.append(beta.copy())
    return np.array(out)


def principal_scores(x: np.ndarray, k: int) -> np.ndarray:
    """Scores of the first k components of centred rows; each component's largest loading is positive."""
    c = x - x.mean(0)
    _, _, v = np.linalg.svd(c, full_matrices=False)
    v = v[:k] * np.sign(v[np.arange(min(k, len(v))), np.abs(v[:k]).argmax(1)])[:, None]
    return c @ v.T


def logistic_l2(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 50) -> np.ndarray:
    """Coefficients and intercept (last, not penalised) of an L2 logistic classifier."""
    z = np.column_stack((x, np.ones(len(x))))
    penalty = np.append(np.full(x.shape[1], 1 / c), 0.0)
    b = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (p - y) + penalty * b
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty) + 1e-10 * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    return b


def uno_c(time: np.ndarray, event: np.ndarray, risk: np.ndarray, weight: np.ndarray, tau: float) -> float | None:
    """Concordance of events before tau with all later times, in n log n: risks are counted in a binary indexed tree."""
    order = np.lexsort((-event, time))  # at a tie, events come before censored times
    ranks = np.unique(risk, return_inverse=True)[1] + 1
    tree = np.zeros(ranks.max(initial=0) + 1, np.int64)

    def add(i: int) -> None:
        while i < len(tree):
            tree[i] += 1
            i += i & -i

    def below(i: int) -> int:
        s = 0
        while i > 0:
            s += tree[i]
            i -= i & -i
        return int(s)

    num = den = 0.0
    seen, i = 0, len(order) - 1
    while i >= 0:
        j = i
        while j >= 0 and time[order[j]] == time[order[i]]:
            j -= 1
        same = order[j + 1 : i + 1]
        for k in same:
            if event[k] and time[k] < tau and seen:
                low, upto = below(ranks[k] - 1), below(ranks[k])
                num += weight[k] * (low + 0.5 * (upto - low))
                den += weight[k] * seen
        for k in same:
            add(ranks[k])
        seen += len(same)
        i = j
    return num / den if den > 0 else None
