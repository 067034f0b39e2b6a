"""Settings and sweep state: every field is checked, and a wrong one falls back to its default.

A limit that arrives as nothing must not become a limit of nothing, so a retention
or size cap under 1 is never believed.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field, replace

from pagevault import schemas as S
from pagevault.functions.presets import BUNDLES, rules_for
from pagevault.functions.rules import normalise
from pagevault.functions.stem import STEMMERS, default_languages

BROAD, STRICT = "broad", "strict"


@dataclass(frozen=True)
class Settings:
    setup_complete: bool = False
    mode: str = BROAD
    allowlist: tuple[str, ...] = ()
    custom_rules: tuple[str, ...] = ()
    presets: Mapping[str, bool] = field(default_factory=lambda: dict.fromkeys(BUNDLES, True))
    retention_months: float = S.RETENTION_MONTHS
    size_cap_bytes: float = S.SIZE_CAP
    paused_until: float = 0
    warned_at_fraction: float = 0
    stem_languages: tuple[str, ...] = ()

    def paused(self, now: int) -> bool:
        return self.paused_until > now

    def rules(self, bundles: Mapping[str, Iterable[str]] | None = None) -> list[str]:
        """All exclusion rules in force: of the bundles that are on, and custom ones."""
        return rules_for(self.presets, self.custom_rules, bundles)

    def policy(self, now: int, bundles: Mapping[str, Iterable[str]] | None = None) -> dict:
        """What ``functions.rules.reason`` needs of the settings."""
        strict = self.mode == STRICT
        return {"rules": self.rules(bundles), "allowlist": list(self.allowlist) if strict else None, "setup_complete": self.setup_complete, "paused": self.paused(now)}

    def json(self) -> str:
        return json.dumps(asdict(self))


def _number(value: object, fallback: float, least: float = 0) -> float:
    try:
        x = float(value) if isinstance(value, (int, float, str)) and str(value).strip() else math.nan
    except ValueError:
        x = math.nan
    return x if math.isfinite(x) and x >= least else fallback


def _rules(value: object) -> tuple[str, ...]:
    given = value if isinstance(value, (list, tuple)) else ()
    named = (normalise(x.strip()) for x in given if isinstance(x, str) and x.strip())
    return tuple(dict.fromkeys(x for x in named if x))


def normalised(raw: object, languages: Iterable[str] = ()) -> Settings:
    """Settings from whatever was stored; ``languages`` are the reader's own, for a stem list that was never set."""
    got = raw if isinstance(raw, dict) else {}
    on = got.get("presets") if isinstance(got.get("presets"), dict) else {}
    d = Settings()
    stems = got.get("stem_languages")
    return Settings(
        setup_complete=got.get("setup_complete") is True,
        mode=STRICT if got.get("mode") == STRICT else BROAD,
        allowlist=_rules(got.get("allowlist")),
        custom_rules=_rules(got.get("custom_rules")),
        presets={k: bool(on[k]) if k in on else True for k in BUNDLES},
        retention_months=_number(got.get("retention_months"), d.retention_months, 1),
        size_cap_bytes=_number(got.get("size_cap_bytes"), d.size_cap_bytes, 1),
        paused_until=_number(got.get("paused_until"), 0),
        warned_at_fraction=_number(got.get("warned_at_fraction"), 0),
        stem_languages=tuple(dict.fromkeys(x for x in stems if x in STEMMERS)) if isinstance(stems, (list, tuple)) else tuple(default_languages(languages)),
    )


def updated(settings: Settings, patch: object) -> Settings:
    """Settings with some fields changed; presets are merged by name."""
    given = patch if isinstance(patch, dict) else {}
    merged = {**asdict(settings), **given}
    merged["presets"] = {**settings.presets, **(given["presets"] if isinstance(given.get("presets"), dict) else {})}
    return normalised(merged)


@dataclass(frozen=True)
class State:
    """What a sweep knows of earlier ones, and which shipped rules were applied to what is kept."""

    last_sweep: float = 0
    cap_unmeetable: bool = False
    clock_problem: str | None = None
    clock_hold_until: float = 0
    applied_rules: tuple[str, ...] = ()
    new_bundles: tuple[str, ...] = ()

    def json(self) -> str:
        return json.dumps(asdict(self))

    def but(self, **changes) -> State:
        return replace(self, **changes)


def state(raw: object) -> State:
    got = raw if isinstance(raw, dict) else {}
    strings = lambda key: tuple(x for x in got.get(key) or () if isinstance(x, str)) if isinstance(got.get(key), (list, tuple)) else ()
    problem = got.get("clock_problem")
    return State(_number(got.get("last_sweep"), 0), got.get("cap_unmeetable") is True, problem if isinstance(problem, str) else None, _number(got.get("clock_hold_until"), 0), strings("applied_rules"), strings("new_bundles"))
