"""Slow, direct NumPy version of the quantities the library computes with Spark.

Everything is written from the definitions: the weighted stack is a function of all parameters
and its derivative is taken by central differences.
"""

import numpy as np
import pandas as pd


def random_study(seed, subjects=14, times=8, period=2, base=2, treat=2, late=False, gaps=False):
    """A small log with staggered entry; betas are arbitrary, so nothing is learned here."""
    rng = np.random.default_rng(seed)
    rows = []
    b = base + treat
    top = (times - 1) // period
    betas = rng.normal(scale=0.5, size=(top, b))
    for s in range(subjects):
        entry = int(rng.integers(0, times // 2))
        leave = times if s % 5 else int(rng.integers(times // 2, times))
        delay = int(rng.integers(0, 2)) if late else 0
        for t in range(times):
            active = entry <= t < leave and not (gaps and s % 7 == 3 and t % 3 == 1)
            x = rng.normal()
            policy = max(t - delay, 0) // period
            row = dict(
                study_id=f"s{seed}", subject_id=s, calendar_t=t, active=int(active),
                intercept=1.0, x=x, policy_num=None, action=None, action_prob=None, reward=None,
            )
            if active:
                prob = 0.5
                if policy > 0:
                    z = betas[policy - 1, base:] @ np.array([1.0, x])[:treat]
                    prob = 0.1 + 0.8 / (1 + np.exp(-2.0 * z))
                action = int(rng.uniform() < prob)
                row.update(
                    policy_num=policy, action=action, action_prob=prob,
                    reward=0.3 + 0.5 * x + action * (0.4 - 0.2 * x) + rng.normal(),
                )
            rows.append(row)
    return pd.DataFrame(rows), betas


class Brute:
    def __init__(self, df, betas, config, theta=None):
        self.config = config
        self.df = df.sort_values(["subject_id", "calendar_t"])
        self.subjects = sorted(df["subject_id"].unique())
        self.n = len(self.subjects)
        self.betas = np.asarray(betas, dtype=float)
        self.K, self.b = self.betas.shape
        self.q = config.inference.dim
        active = self.df[self.df["active"] == 1]
        numbers = sorted(int(p) for p in active["policy_num"].unique() if p >= 0)
        self.initial, self.updates = numbers[0], numbers[1:]
        self.first_t = [active[active["policy_num"] == p]["calendar_t"].min() for p in self.updates]
        self.by_subject = {s: g for s, g in active.groupby("subject_id")}
        self.n_users = [
            active[active["calendar_t"] < t]["subject_id"].nunique() for t in self.first_t
        ]
        self.theta = self.fit_theta() if theta is None else theta

    def probs(self, rows, betas):
        p = self.config.policy
        out = []
        for _, r in rows.iterrows():
            if r["policy_num"] in self.updates:
                beta = betas[self.updates.index(r["policy_num"])]
                z = beta[-len(p.treat):] @ r[list(p.treat)].to_numpy(dtype=float)
                e = 1 / (1 + np.exp(-p.steepness * z))
                out.append(
                    p.lower + (p.upper - p.lower) * e
                    if p.clip == "smooth" else min(max(e, p.lower), p.upper)
                )
            else:
                out.append(r["action_prob"])
        return np.array(out, dtype=float)

    def design(self, model, rows, probs):
        a = rows["action"].to_numpy(dtype=float) - (probs if model.centered else 0.0)
        treat = rows[list(model.treat)].to_numpy(dtype=float)
        return np.hstack([rows[list(model.base)].to_numpy(dtype=float), a[:, None] * treat])

    def estimating(self, model, rows, probs, par):
        f = self.design(model, rows, probs)
        return -2 * f.T @ (rows["reward"].to_numpy(dtype=float) - f @ par)

    def fit_theta(self, until=None):
        parts, rewards = [], []
        for rows in self.by_subject.values():
            if until is not None:
                rows = rows[rows["calendar_t"] <= until]
            if len(rows):
                parts.append(self.design(self.config.inference, rows, self.probs(rows, self.betas)))
                rewards.append(rows["reward"].to_numpy(dtype=float))
        return np.linalg.lstsq(np.vstack(parts), np.concatenate(rewards), rcond=None)[0]

    def subject_stack(self, s, params, blocks_lower=True):
        """Weighted stack of one subject; weights compare ``params`` with the fixed betas."""
        betas = params[: self.K * self.b].reshape(self.K, self.b)
        theta = params[self.K * self.b:]
        out = np.zeros(len(params))
        rows = self.by_subject.get(s)
        if rows is None:
            return out
        new, old = self.probs(rows, betas), self.probs(rows, self.betas)
        a = rows["action"].to_numpy(dtype=float)
        lik = lambda p: np.where(a == 1, p, 1 - p)
        w = lik(new) / lik(old)
        t, policy = rows["calendar_t"].to_numpy(), rows["policy_num"].to_numpy()
        learned = np.isin(policy, self.updates)
        for k, number in enumerate(self.updates):
            data = (t < self.first_t[k])
            if not data.any():
                continue
            window = learned & (policy < number)
            value = self.estimating(self.config.update, rows[data], new[data], betas[k])
            value = value + 2 * self.config.update.ridge / self.n_users[k] * betas[k]
            out[k * self.b:(k + 1) * self.b] = np.prod(w[window]) * value
        out[self.K * self.b:] = np.prod(w[learned]) * self.estimating(
            self.config.inference, rows, new, theta
        )
        return out

    @property
    def params(self):
        return np.concatenate([self.betas.ravel(), self.theta])

    def stacks(self, params=None):
        params = self.params if params is None else params
        return np.array([self.subject_stack(s, params) for s in self.subjects])

    def bread_inverse(self, step=1e-5):
        p0, cols = self.params, []
        for i in range(len(p0)):
            up, down = p0.copy(), p0.copy()
            up[i] += step
            down[i] -= step
            cols.append((self.stacks(up).mean(0) - self.stacks(down).mean(0)) / (2 * step))
        return np.array(cols).T
