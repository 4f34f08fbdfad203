"""Divergence estimates between two log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rewardloom.functions.seq import clamp


def kl_penalty(logp: Column, ref: Column, kind: str) -> Column:
    """k1/kl, abs, k2/mse, k3/low_var_kl; a trailing + only changes gradients, not the value."""
    kind = kind.rstrip("+")
    gap = logp - ref
    if kind in ("kl", "k1"):
        return gap
    if kind == "abs":
        return F.abs(gap)
    if kind in ("mse", "k2"):
        return gap * gap * 0.5
    if kind in ("low_var_kl", "k3"):
        back = clamp(-gap, -20.0, 20.0)
        return clamp(F.exp(back) - back - 1.0, -10.0, 10.0)
    raise NotImplementedError(f"divergence estimate {kind} needs full distributions or is unknown")
