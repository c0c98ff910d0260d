"""Driver-side choices: which features to compute, horizons as text, and whether a cached source is enough."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tidelane.operators import features

GROUPS = {
    "technical": features.technical,
    "microstructure": features.microstructure,
    "derivatives": features.derivatives,
    "sentiment": features.sentiment,
    "context": features.context,
}
_UNITS = {"h": 1, "d": 24, "w": 168}


def resolve(wanted: str | list[str]) -> list[str]:
    """Feature names in registry order from group names, feature names, "all" or "none"; an unknown name is an error."""
    every = {g: features.names(layers()) for g, layers in GROUPS.items()}
    names = [wanted] if isinstance(wanted, str) else list(wanted)
    flat = [n for group in every.values() for n in group]
    chosen: set[str] = set()
    for name in names:
        if name in ("all", "on"):
            chosen |= set(flat)
        elif name in ("none", "off"):
            continue
        elif name in every:
            chosen |= set(every[name])
        elif name in flat:
            chosen.add(name)
        else:
            raise ValueError(f"unknown feature or group: {name}")
    return [n for n in flat if n in chosen]


@dataclass(frozen=True, order=True)
class Horizon:
    hours: int
    label: str

    @classmethod
    def parse(cls, text: str) -> Horizon:
        m = re.fullmatch(r"(\d+)([hdw])", text.strip().lower())
        if not m or not int(m[1]):
            raise ValueError(f"not a horizon: {text!r}")
        return cls(int(m[1]) * _UNITS[m[2]], m[0])


def ladder(texts: list[str]) -> list[Horizon]:
    """Horizons by duration; two of one duration are an error."""
    out = sorted(map(Horizon.parse, texts))
    if len({h.hours for h in out}) < len(out):
        raise ValueError("two horizons of one duration")
    return out


def cache_is_enough(held: tuple[int, int] | None, requested_before: tuple[int, int] | None, wanted: tuple[int, int]) -> tuple[bool, bool]:
    """Whether a cached span covers the wanted one, and whether fetching again could help: not where an earlier request already reached as far."""
    if held is None:
        return False, True
    enough = held[0] <= wanted[0] and held[1] >= wanted[1]
    asked = requested_before or held
    return enough, not enough and (wanted[0] < asked[0] or wanted[1] > asked[1])
