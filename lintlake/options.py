"""Scan options and score profiles: driver-side configuration, checked and clamped on construction."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace
from typing import Any

LANGUAGES = ("python", "java", "c", "cpp")
SEVERITIES = ("BLOCKER", "CRITICAL", "MAJOR", "MINOR")
METRICS = ("maxComplexity", "maxFunctionLines", "maxNestingDepth", "cloneRate")


def finite(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)


def clamp(value: float, low: float, high: float) -> float:
    return min(high, max(low, value))


@dataclass(frozen=True)
class MetricRule:
    threshold: float
    penalty: float


@dataclass(frozen=True)
class ScoreProfile:
    profile_id: str
    version: str
    title: str
    provenance: str
    finding_penalties: dict[str, float]
    metric_rules: dict[str, MetricRule]
    pass_score: float


#: Penalties, thresholds and pass line of the default profile.
DEFAULT_PROFILE = ScoreProfile(
    profile_id="default-v1",
    version="1.2.0",
    title="Default code quality profile",
    provenance="provisional",
    finding_penalties={"BLOCKER": 5.0, "CRITICAL": 3.0, "MAJOR": 1.0, "MINOR": 0.5},
    metric_rules={
        "maxComplexity": MetricRule(20.0, 1.0),
        "maxFunctionLines": MetricRule(150.0, 0.5),
        "maxNestingDepth": MetricRule(6.0, 0.5),
        "cloneRate": MetricRule(0.2, 10.0),
    },
    pass_score=60.0,
)
PROFILES = {DEFAULT_PROFILE.profile_id: DEFAULT_PROFILE}


class UnknownProfileError(ValueError):
    """No score profile has the id that was asked for."""


@dataclass(frozen=True)
class CustomProfile:
    """What a caller may set of a profile; metrics that are left out are not scored at all."""

    title: str | None = None
    finding_penalties: dict[str, float] = field(default_factory=dict)
    metric_rules: dict[str, MetricRule] = field(default_factory=dict)
    pass_score: float | None = None

    @classmethod
    def from_value(cls, value: Any) -> CustomProfile | None:
        """Keeps finite numbers, clamped from below by 0; None if nothing is left."""
        if not isinstance(value, dict):
            return None
        penalties = {k: max(0.0, float(v)) for k, v in (value.get("findingPenalties") or {}).items() if k in SEVERITIES and finite(v)} if isinstance(value.get("findingPenalties"), dict) else {}
        rules = {}
        for name, rule in (value.get("metrics") or {}).items() if isinstance(value.get("metrics"), dict) else ():
            if name in METRICS and isinstance(rule, dict) and finite(rule.get("threshold")) and finite(rule.get("penalty")):
                rules[name] = MetricRule(max(0.0, float(rule["threshold"])), max(0.0, float(rule["penalty"])))
        title = value.get("title") if isinstance(value.get("title"), str) and value["title"].strip() else None
        line = clamp(float(value["passScore"]), 0.0, 100.0) if finite(value.get("passScore")) else None
        return cls(title, penalties, rules, line) if title or penalties or rules or line is not None else None

    def profile(self) -> ScoreProfile:
        line = DEFAULT_PROFILE.pass_score if self.pass_score is None else clamp(self.pass_score, 0.0, 100.0)
        rules = {k: MetricRule(max(0.0, r.threshold), max(0.0, r.penalty)) for k, r in self.metric_rules.items()}
        return replace(DEFAULT_PROFILE, profile_id="custom", version="custom", title=self.title or "Custom profile", provenance="custom", finding_penalties=DEFAULT_PROFILE.finding_penalties | {k: max(0.0, v) for k, v in self.finding_penalties.items()}, metric_rules=rules, pass_score=line)


def find_profile(profile_id: str | None = None) -> ScoreProfile:
    try:
        return PROFILES[profile_id or DEFAULT_PROFILE.profile_id]
    except KeyError:
        raise UnknownProfileError(f"no score profile {profile_id!r}") from None


@dataclass(frozen=True)
class ScanOptions:
    languages: tuple[str, ...] = LANGUAGES
    rules: bool = True
    clone_detection: bool = True
    clone_threshold: float = 0.2
    scoring: bool = True
    profile_id: str | None = None
    pass_score: float | None = None
    custom: CustomProfile | None = None

    @classmethod
    def from_value(cls, value: Any) -> ScanOptions:
        """Unknown languages go (all, if none is left), numbers are clamped, flags default to true."""
        value = value if isinstance(value, dict) else {}
        engines = value.get("engines") if isinstance(value.get("engines"), dict) else {}
        scoring = value.get("scoring") if isinstance(value.get("scoring"), dict) else {}
        wanted = value.get("languages") if isinstance(value.get("languages"), (list, tuple)) else ()
        threshold, line = value.get("cloneThreshold"), scoring.get("passScore")
        return cls(
            languages=tuple(x for x in LANGUAGES if x in wanted) or LANGUAGES,
            rules=engines.get("rules", True) is not False,
            clone_detection=engines.get("cloneDetection", True) is not False,
            clone_threshold=clamp(float(threshold), 0.0, 1.0) if finite(threshold) else 0.2,
            scoring=scoring.get("enabled", True) is not False,
            profile_id=scoring.get("profileId") if isinstance(scoring.get("profileId"), str) and scoring.get("profileId") else None,
            pass_score=clamp(float(line), 0.0, 100.0) if finite(line) else None,
            custom=CustomProfile.from_value(scoring.get("custom")),
        )

    @classmethod
    def from_json(cls, text: str | None) -> ScanOptions:
        """Options from JSON text; blank text gives the defaults, bad JSON is an error."""
        if text is None or not text.strip():
            return cls()
        try:
            return cls.from_value(json.loads(text))
        except json.JSONDecodeError as error:
            raise ValueError(f"options are no valid JSON: {error}") from None

    def profile(self) -> ScoreProfile:
        """A custom profile wins over an id."""
        return self.custom.profile() if self.custom else find_profile(self.profile_id)


def checked_project_key(key: str | None) -> str:
    key = (key or "").strip()
    if not key:
        raise ValueError("a project key is needed")
    return key


#: Fixed value: the longest project name that a form takes.
NAME_LIMIT = 20


def short_project_key(key: str) -> str:
    """A key as a form takes it."""
    return key.strip()[:NAME_LIMIT]


def default_project_key(file_name: str) -> str:
    """The key that a form proposes for an upload: its base name without the last extension."""
    base = file_name.replace("\\", "/").rpartition("/")[2]
    stem, dot, extension = base.rpartition(".")
    return short_project_key(stem if dot and extension else base)


def custom_from_form(severities: dict[str, str], metrics: dict[str, tuple[str, str]], pass_score: str) -> CustomProfile | None:
    """A custom profile from the texts of a form; the clone rate's threshold is entered in percent."""

    def number(text: str) -> float | None:
        try:
            return float(text.strip() or "0")
        except ValueError:
            return None

    share = lambda name, value: value / 100 if name == "cloneRate" and value is not None else value
    rules = {k: {"threshold": share(k, number(t)), "penalty": number(p)} for k, (t, p) in metrics.items()}
    return CustomProfile.from_value({"findingPenalties": {k: number(v) for k, v in severities.items()}, "metrics": rules, "passScore": number(pass_score)})
