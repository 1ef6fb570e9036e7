"""Validated options of a decomposition."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Scoring:
    """Gap, mismatch and match scores of the segmentation."""

    insertion: int = -1
    deletion: int = -1
    mismatch: int = -1
    match: int = 1

    @classmethod
    def parse(cls, text: str) -> Scoring:
        """``ins,del,mismatch,match`` as four integers."""
        parts = text.split(",")
        if len(parts) != 4:
            raise ValueError(f"scoring takes four comma-separated integers, not {text!r}")
        return cls(*(int(p) for p in parts))


#: Reliability model: intercept, identity, identity minus second-best identity. Fixed values.
RELIABILITY = (-31.48494996, 0.41784018, 0.69186882)


@dataclass(frozen=True)
class Options:
    """``part_size`` and ``overlap`` change results near chunk ends; they are no tuning knobs."""

    part_size: int = 5000
    overlap: int = 500
    ed_thr: int = -1
    min_identity: float = 0
    second_best: bool = False
    scoring: Scoring = field(default_factory=Scoring)
    reliability: tuple[float, float, float] = RELIABILITY
    #: Most sequences of ``monomers`` (each strand counts) that are handed to the tasks.
    max_monomers: int = 20_000

    def __post_init__(self):
        if self.part_size <= 0 or self.overlap < 0:
            raise ValueError("part_size must be positive and overlap not negative")
        if self.part_size + self.overlap > 400_000:
            raise ValueError("part_size + overlap of more than 400000 would leave the score range")
