"""Settings of a job, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

from attestor.operators.sampling import check_seed

JOBS = ("pairs", "chains")


@dataclass(frozen=True)
class Job:
    """One run over lists of terms. position pairs the lists by place instead of crossing them."""

    a_terms: tuple[str, ...]
    b_terms: tuple[str, ...]
    c_terms: tuple[str, ...] = ()
    kind: str = "pairs"
    comparison: bool = False
    position: bool = False
    fet_threshold: float = 1.0
    bc_fet_threshold: float = 1.0
    censor_lower: int = 0
    censor_upper: int = 2024
    top_cited: int = 50
    top_recent: int = 50
    post_n: int = 20
    min_words: int = 98
    iterations: int = 1
    sample_seed: int | None = None
    sample_size: int = 50
    sample_floor: float = 0.06
    a_suffix: str = ""
    hypotheses: dict[str, str] = field(default_factory=lambda: {"ab": "{a_term} affects {b_term}.", "bc": "{b_term} affects {c_term}.", "ac": "{a_term} affects {c_term}."})

    def __post_init__(self):
        check_seed(self.sample_seed)
        if self.kind not in JOBS:
            raise ValueError(f"kind is one of {JOBS}")
        if not self.a_terms or not self.b_terms:
            raise ValueError("A and B terms are needed")
        if (self.kind == "chains") != bool(self.c_terms):
            raise ValueError("chains need C terms, pairs have none")
        if self.comparison and (self.kind != "pairs" or len(self.b_terms) != 2):
            raise ValueError("a comparison has exactly two B terms and no C terms")
        if self.position and len({len(x) for x in (self.a_terms, self.b_terms, self.c_terms) if x}) != 1:
            raise ValueError("lists that are paired by place must be equally long")
        if not 0 <= self.sample_floor <= 1:
            raise ValueError("the sample's floor is a share")

    def combinations(self) -> list[tuple[str, tuple[str, ...], str | None]]:
        """(A, Bs, C): by place, or each A (and C) with all Bs."""
        if self.position:
            return [(a, (b,), c) for a, b, c in zip(self.a_terms, self.b_terms, self.c_terms or (None,) * len(self.a_terms), strict=True)]
        return [(a, self.b_terms, c) for a in self.a_terms for c in self.c_terms or (None,)]
