"""Parameters of a training run."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha1


def parse_thresholds(text: str) -> list[int]:
    """``"20_30"`` -> ``[20, 30]``; an empty string means one sense for every word."""
    return [int(t) for t in text.split("_") if t]


@dataclass(frozen=True)
class TrainConfig:
    num_shards: int = 10            # random training shards per epoch
    num_epochs: int = 10
    min_count: int = 10             # keep a word iff its count reaches this
    num_negative: int = 20          # noise words per token position
    window: int = 5                 # one-sided context width
    dim: int = 50
    sense_thresholds: str = "20_30"  # count thresholds for 2, 3, ... senses
    learn_rate: float = 0.01
    one_sense: bool = False
    softmax: bool = False           # sampled softmax instead of sigmoid
    seed: int = 42
    validation_ratio: float = 0.1
    max_validation_lines: int = 10_000
    validation_is_subset: bool = False
    validate_every: int = 2
    save_every: int | None = None   # None: min(num_shards * num_epochs, 20)
    max_sq_norm: float = 4.0
    sense_prob_floor: float = 0.02
    max_passes: int = 10            # sense-assignment passes per sentence
    decay: float = 0.99
    sense_init_sd: float = 0.01
    group_tokens: int = 50_000      # tokens one training task holds at a time
    chunk_tokens: int = 2048        # longer lines are cut into chunks for sense assignment
    lockstep: int = 1               # sentences advanced together in a task; 1 = strictly sequential

    @property
    def thresholds(self) -> list[int]:
        return [] if self.one_sense else parse_thresholds(self.sense_thresholds)

    @property
    def max_senses(self) -> int:
        return len(self.thresholds) + 1

    @property
    def iterations(self) -> int:
        return self.num_shards * self.num_epochs

    @property
    def snapshot_every(self) -> int:
        return self.save_every or min(self.iterations, 20)

    @property
    def run_name(self) -> str:
        kind = "one" if self.one_sense else self.sense_thresholds
        return (f"shards{self.num_shards}-epochs{self.num_epochs}-min{self.min_count}"
                f"-neg{self.num_negative}-win{self.window}-dim{self.dim}"
                f"-senses{kind}-lr{self.learn_rate}-{sha1(repr(self).encode()).hexdigest()[:8]}")
