"""Which families take part: defaults, exclusions, custom laws, and order of work."""

from __future__ import annotations

from collections.abc import Iterable

from lawfinder.functions.discrete import DISCRETE, DiscreteLaw
from lawfinder.functions.laws import DEFAULT_EXCLUDED, LAWS, SLOW, Law

_CUSTOM: dict[str, Law] = {}
_EXCLUDED: set[str] = set(DEFAULT_EXCLUDED)


def register_distribution(name: str, law: Law, overwrite: bool = False) -> None:
    """Add a custom law: an object with names, logpdf, cdf, support, starts and valid, as ``Law`` has them."""
    if name in LAWS:
        raise ValueError(f"{name!r} is a built-in family")
    if name in _CUSTOM and not overwrite:
        raise ValueError(f"{name!r} is registered already; pass overwrite=True to replace it")
    for needed in ("logpdf", "cdf", "names", "support", "starts"):
        if not hasattr(law, needed):
            raise TypeError(f"a law needs {needed!r}")
    _CUSTOM[name] = law


def unregister_distribution(name: str) -> None:
    if name not in _CUSTOM:
        raise KeyError(f"{name!r} is not registered")
    del _CUSTOM[name]


def get_custom_distributions() -> dict[str, Law]:
    return dict(_CUSTOM)


def get_exclusions() -> set[str]:
    return set(_EXCLUDED)


def add_exclusion(name: str) -> None:
    _EXCLUDED.add(name)


def remove_exclusion(name: str) -> None:
    _EXCLUDED.discard(name)


def reset_exclusions() -> None:
    _EXCLUDED.clear()
    _EXCLUDED.update(DEFAULT_EXCLUDED)


def get_law(name: str) -> Law | DiscreteLaw:
    found = _CUSTOM.get(name) or LAWS.get(name) or DISCRETE.get(name)
    if not found:
        raise KeyError(f"unknown distribution {name!r}")
    return found


def continuous_names(excluded: Iterable[str] | None = None, support_at_zero: bool = False, most: int | None = None) -> list[str]:
    """Candidate families. ``excluded`` replaces the default exclusions; an empty one leaves every family in."""
    out = set(_EXCLUDED if excluded is None else excluded)
    names = [n for n in [*LAWS, *_CUSTOM] if n not in out]
    if support_at_zero:
        names = [n for n in names if get_law(n).support(*(get_law(n).starts[0]))[0] >= 0]
    return names if most is None else names[:most]


def discrete_names(excluded: Iterable[str] | None = None, most: int | None = None) -> list[str]:
    names = [n for n in DISCRETE if n not in set(excluded or ())]
    return names if most is None else names[:most]


def interleaved(names: Iterable[str]) -> list[str]:
    """Slow families spread evenly among the others."""
    names = list(names)
    slow, fast = [n for n in names if n in SLOW], [n for n in names if n not in SLOW]
    if not slow or not fast:
        return names
    out, step = [], len(fast) / len(slow)
    for i, n in enumerate(slow):
        out += [n, *fast[round(i * step) : round((i + 1) * step)]]
    return out


def task_count(n_names: int, n_slow: int, cores: int) -> int:
    return max(1, min(n_names + 2 * n_slow, 2 * cores))
