"""Parameters of a dataset build, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from math import isclose

# fixed values: the published corpus sizes, in thousands of passages
CORPUS_SIZES = ("10", "20", "50")


@dataclass(frozen=True)
class SplitRatios:
    """Shares of the three splits, held by name and used as exact decimals."""

    train: float = 0.8
    valid: float = 0.1
    test: float = 0.1

    def __post_init__(self) -> None:
        for name, share in self.items():
            if not 0 <= share <= 1:
                raise ValueError(f"{name} share {share} is outside [0, 1]")
        if not isclose(sum(v for _, v in self.items()), 1.0, abs_tol=1e-3):
            raise ValueError("split shares must add up to 1")
        if not (self.valid > 0 and self.test > 0):
            raise ValueError("valid and test shares must be positive")

    def items(self) -> tuple[tuple[str, float], ...]:
        return (("train", self.train), ("valid", self.valid), ("test", self.test))

    @classmethod
    def of(cls, shares: dict[str, float]) -> SplitRatios:
        if set(shares) != {"train", "valid", "test"}:
            raise ValueError("split names must be train, valid and test")
        return cls(**shares)

    def rest_fraction(self) -> tuple[int, int]:
        """valid + test as an exact fraction."""
        return (Decimal(str(self.valid)) + Decimal(str(self.test))).as_integer_ratio()

    def test_of_rest(self) -> tuple[int, int]:
        """test / (valid + test) as an exact fraction."""
        test = Decimal(str(self.test)).as_integer_ratio()
        rest = self.rest_fraction()
        return test[0] * rest[1], test[1] * rest[0]


@dataclass(frozen=True)
class DatasetParams:
    """What a dataset build depends on; also names its outputs."""

    corpus: str = "10"
    fraction: float = 0.2
    ratios: SplitRatios = SplitRatios()
    seed: int = 42
    enriched: bool = False

    def __post_init__(self) -> None:
        if self.corpus not in CORPUS_SIZES:
            raise ValueError(f"corpus must be one of {CORPUS_SIZES}")
        if not 0 < self.fraction <= 1:
            raise ValueError("fraction must be in (0, 1]")


def _percent(share: float) -> int:
    return int((Decimal(str(share)) * 100).to_integral_value())


def dataset_tag(params: DatasetParams, model: str | None = None) -> str:
    """Artefact name made from the parameters, e.g. ``10k_percent20_split801010_seed42``.

    Percentages are rounded, so 0.29 gives 29. Enriched data gets the prefix ``extended_``, data made for one base
    model the last part of that model's name.
    """
    shares = "".join(f"{_percent(v):02d}" for _, v in params.ratios.items())
    tag = f"{params.corpus}k_percent{_percent(params.fraction)}_split{shares}_seed{params.seed}"
    if params.enriched:
        tag = f"extended_{tag}"
    return f"{model.rstrip('/').split('/')[-1]}_{tag}" if model else tag
