"""Settings of the text model, all of which a container records."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from functools import lru_cache

#: Fixed values of the format: flag bits, vocabulary sizes, quantisation total.
FLAG_NGRAM, FLAG_LZP, FLAG_ADAPTIVE, FLAG_SKIP = 1, 2, 4, 8
BYTE_VOCABULARY, WORD_VOCABULARY = 256, 49152
CDF_TOTAL = 1 << 24
SKIP_NGRAM, SKIP_LZP = 0.7, 0.3


@dataclass(frozen=True)
class Config:
    ngram: bool = True
    lzp: bool = True
    adaptive: bool = True
    skip: bool = True
    ngram_order: int = 4
    lzp_order: int = 8
    lzp_least: int = 4
    mixer_rate: float = 0.5
    adaptive_rate: float = 0.001
    skip_bits: float = 1.5
    warmup: int = 100
    temperature: float = 1.0
    vocabulary: int = BYTE_VOCABULARY
    total: int = CDF_TOTAL
    inner_cap: int = 64
    ngram_cap: int = 500_000
    lzp_cap: int = 1_000_000

    def __post_init__(self) -> None:
        # The header holds the temperature in steps of 1e-4, so that is what is used.
        object.__setattr__(self, "temperature", round(self.temperature * 10_000) / 10_000)
        if not 0 < self.temperature <= 6.5535:
            raise ValueError("temperature is from 0.0001 to 6.5535")
        if not self.ngram and self.skip:
            object.__setattr__(self, "skip", False)

    @property
    def flags(self) -> int:
        return FLAG_NGRAM * self.ngram | FLAG_LZP * self.lzp | FLAG_ADAPTIVE * self.adaptive | FLAG_SKIP * self.skip

    def with_flags(self, flags: int) -> Config:
        return replace(self, ngram=bool(flags & FLAG_NGRAM), lzp=bool(flags & FLAG_LZP), adaptive=bool(flags & FLAG_ADAPTIVE), skip=bool(flags & FLAG_SKIP))

    @property
    def models(self) -> int:
        return 1 + self.ngram + self.lzp

    def as_dict(self) -> dict:
        return asdict(self)


@lru_cache(maxsize=256)
def recorded(flags: int, temperature: float, settings: str | None, given: Config) -> Config:
    """What a container was written with: its header's flags and temperature, and all
    else from the recorded ``settings``, or from ``given`` where there are none."""
    base = Config(**json.loads(settings)) if settings else given
    return replace(base.with_flags(flags), temperature=temperature)
