"""Settings of the search pipeline; pass one explicitly, there is no global."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    model_type: str = "CNN"
    adversarial: bool = False
    learning_rate: float = 1e-4
    l1: float = 0.0
    l2: float = 0.0
    parse_range: tuple[int, int] = (0, 1000)
    latent_weight: float = 1.0
    max_drop: int = 10
    max_swap: int = 10
    batch: int = 4
    latent: int = 8
    last_activation: str = "sigmoid"
    checkpoints_kept: int = 5
    num_perm: int = 128
    threshold: float = 0.5
    result_limit: int = 10
