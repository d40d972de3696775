"""One seed for all random choices that don't name their own."""

from __future__ import annotations

import os
import random

import numpy as np

_seed = 42


def set_seed(seed: int) -> int:
    """Seed Python's and numpy's generators and what this library draws; tell child processes by PYTHONHASHSEED."""
    global _seed
    _seed = int(seed)
    random.seed(_seed)
    np.random.seed(_seed % (1 << 32))
    os.environ["PYTHONHASHSEED"] = str(_seed % (1 << 32))
    return _seed


def current() -> int:
    return _seed
