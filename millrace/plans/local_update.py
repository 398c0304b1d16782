"""One worker's training pass: a one-hidden-layer network, plain SGD, numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd


@dataclass(frozen=True)
class LocalConfig:
    in_dim: int
    hidden: int
    out_dim: int
    lr: float = 0.1
    batch_size: int = 32
    local_steps: int = 10
    seed: int = 0

    @property
    def rows_touched(self) -> int:
        """No step reads a row beyond this index, however large the shard is."""
        return self.local_steps * self.batch_size

    def shapes(self) -> dict[str, tuple[int, ...]]:
        return {
            "0.weight": (self.hidden, self.in_dim),
            "0.bias": (self.hidden,),
            "2.weight": (self.out_dim, self.hidden),
            "2.bias": (self.out_dim,),
        }

    def initial(self) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        fan = {"0": self.in_dim, "2": self.hidden}
        out = {}
        for name, shape in self.shapes().items():
            bound = 1.0 / np.sqrt(fan[name[0]])
            out[name] = rng.uniform(-bound, bound, size=shape)
        return out


def train(
    config: LocalConfig, weights: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, samples: int
) -> tuple[dict[str, np.ndarray], float]:
    """Run the local steps; batch ``t`` holds rows ``(t * batch + i) mod samples``."""
    w = {k: v.copy() for k, v in weights.items()}
    loss = 0.0
    for t in range(config.local_steps):
        idx = (t * config.batch_size + np.arange(config.batch_size)) % samples
        xb, yb = x[idx], y[idx]
        z1 = xb @ w["0.weight"].T + w["0.bias"]
        a1 = np.maximum(z1, 0.0)
        z2 = a1 @ w["2.weight"].T + w["2.bias"]
        z2 = z2 - z2.max(axis=1, keepdims=True)
        log_p = z2 - np.log(np.exp(z2).sum(axis=1, keepdims=True))
        rows = np.arange(len(yb))
        loss = float(-log_p[rows, yb].mean())
        g2 = np.exp(log_p)
        g2[rows, yb] -= 1.0
        g2 /= len(yb)
        g1 = (g2 @ w["2.weight"]) * (z1 > 0)
        w["2.weight"] -= config.lr * g2.T @ a1
        w["2.bias"] -= config.lr * g2.sum(axis=0)
        w["0.weight"] -= config.lr * g1.T @ xb
        w["0.bias"] -= config.lr * g1.sum(axis=0)
    return w, loss


CONTRIBUTION = (
    "position int, task_id string, samples bigint, loss double, "
    "param string, shape array<int>, data array<double>"
)


def shard_update(config: LocalConfig, weights: dict[str, np.ndarray] | None):
    """Function for ``groupBy('shard').applyInPandas``: a shard's rows, cut to
    ``rows_touched``, with ``samples`` the shard's full size.

    Without weights the trained network itself is the contribution.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        shard, samples = int(pdf["shard"].iloc[0]), int(pdf["samples"].iloc[0])
        x = np.stack(pdf["features"].to_numpy()).astype(np.float64)
        y = pdf["label"].to_numpy().astype(np.int64)
        base = weights if weights is not None else config.initial()
        trained, loss = train(config, base, x, y, samples)
        rows = []
        for name, value in trained.items():
            delta = value - base[name] if weights is not None else value
            rows.append(
                (shard, f"shard-{shard:03d}", samples, loss, name, list(value.shape),
                 delta.ravel().tolist())
            )
        return pd.DataFrame(
            rows, columns=["position", "task_id", "samples", "loss", "param", "shape", "data"]
        )

    return run
