"""Settings of a repair session."""

from __future__ import annotations

from dataclasses import dataclass

#: As a number of training cells: all there are.
EVERY = 2**63 - 1


@dataclass(frozen=True)
class Config:
    """pruning_threshold1: least co-occurrence probability of a candidate (exclusive); pruning_threshold2: of a suspect
    cell's candidate (inclusive). The breakoffs count the observed value: 0 means no limit, 1 the observed value alone."""

    learning_rate: float = 0.001
    momentum: float = 0.0
    weight_decay: float = 0.9
    batch_size: int = 1
    learning_iterations: int = 20
    pruning_threshold1: float = 0.0
    pruning_threshold2: float = 0.1
    pruning_dk_breakoff: int = 5
    pruning_clean_breakoff: int = 5
    k_inferred: int = 1
    seed: int = 42
    train_on_clean_only: bool = False
    #: Training is on all cells. Who wants fewer may name a number here; so many are drawn by a seeded hash.
    training_cells: int = EVERY
    #: Log the seconds of loading, detection, domains, training and inference.
    verbose: bool = False

    def __post_init__(self):
        for name in ("batch_size", "learning_iterations", "pruning_dk_breakoff", "pruning_clean_breakoff", "k_inferred", "training_cells"):
            value = getattr(self, name)
            if not isinstance(value, int) or isinstance(value, bool) or value < 0:
                raise ValueError(f"{name} must be a whole number of at least 0, not {value!r}")
        if not self.k_inferred or not self.batch_size or not self.training_cells:
            raise ValueError("k_inferred, batch_size and training_cells must be at least 1")
