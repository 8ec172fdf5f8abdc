"""What the operators of this subpackage share: written tables, hashing, components."""

from __future__ import annotations

import numpy as np

from wayloom.plans.lineage import connected_components, join_split, remove, shared_dir, written

__all__ = ["MIX_A", "MIX_B", "MIX_C", "connected_components", "fresh", "join_split", "mix64", "remove", "shared_dir", "written"]

#: Odd 64-bit multipliers of the mixing functions below.
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)
MIX_C = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * MIX_B
    x = (x ^ (x >> np.uint64(27))) * MIX_C
    return x ^ (x >> np.uint64(31))


def fresh(columns: list[str], name: str) -> str:
    """name, lengthened until no column has it (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
