"""Fingerprints, label contracts and configuration checks (driver-side, small)."""

from __future__ import annotations

import hashlib
import json
import math
import os
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import date
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_sha256(value) -> str:
    """SHA-256 of JSON with sorted keys, no blanks, no NaN."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=False).encode()).hexdigest()


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, sha256, md5) of whole files."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def load_json(text: str) -> dict:
    """JSON without repeated keys, NaN or infinities."""

    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise ValueError("a key is repeated")
        return dict(items)

    def no_constant(x):
        raise ValueError(f"{x} is no JSON number")

    def finite(x):
        if not math.isfinite(value := float(x)):
            raise ValueError(f"{x} is beyond a double")
        return value

    return json.loads(text, object_pairs_hook=pairs, parse_constant=no_constant, parse_float=finite)


@dataclass(frozen=True)
class LabelContract:
    """What a label means; consumers compare fingerprints and refuse a difference."""

    low_ms: int
    high_ms: int
    min_future: int
    full_horizon: bool = True
    scale: float = 1.0
    clip_quantile: float = 0.99
    splits: dict[str, tuple[str, str]] = field(default_factory=dict)
    version: int = 2

    def fingerprint(self) -> str:
        return canonical_sha256({k: v for k, v in asdict(self).items()})


@dataclass(frozen=True)
class FeatureContract:
    """What can change a feature's value between building and using a model."""

    factors: tuple[str, ...]
    forward_fill: bool = True
    fill: float | None = 0.0
    volume_norm: tuple[str, ...] = ()
    mcap_norm: tuple[str, ...] = ()
    ema_span: int = 200
    volume_floor: float = 1.0
    mcap_floor: float = 1.0
    shares: dict[str, float] = field(default_factory=dict)
    version: int = 1

    def __post_init__(self):
        if both := set(self.volume_norm) & set(self.mcap_norm):
            raise ValueError(f"normalised in two ways: {sorted(both)}")
        if lost := (set(self.volume_norm) | set(self.mcap_norm)) - set(self.factors):
            raise ValueError(f"no such factor: {sorted(lost)}")
        if self.mcap_norm and not all(x > 0 and math.isfinite(x) for x in self.shares.values()):
            raise ValueError("float shares must be positive")

    def fingerprint(self) -> str:
        return canonical_sha256(asdict(self))


def check_identity(found: dict, wanted: dict, last_row: int) -> None:
    """A prediction bundle's metadata must name what is asked for, its model and source, and more rows than it ends at."""
    if wrong := sorted(k for k, v in wanted.items() if found.get(k) != v):
        raise ValueError(f"the bundle is another one: {wrong}")
    for k in ("model_sha256", "source_sha256"):
        if not isinstance(found.get(k), str) or len(found[k]) != 64:
            raise ValueError(f"the bundle lacks {k}")
    if not isinstance(found.get("source_rows"), int) or found["source_rows"] <= last_row:
        raise ValueError("the bundle ends behind its source")


def require_same(found: str, wanted: str, what: str) -> None:
    if found != wanted:
        raise ValueError(f"{what}: contract {found[:12]} where {wanted[:12]} is needed")


def problems(contract: LabelContract) -> list[str]:
    """All faults of a label contract, not only the first."""
    out = []
    if not 0 < contract.low_ms <= contract.high_ms:
        out.append("the horizon must be positive and ordered")
    if contract.min_future < 1:
        out.append("min_future must be 1 or more")
    if not (math.isfinite(contract.scale) and contract.scale > 0):
        out.append("scale must be finite and positive")
    if not 0 < contract.clip_quantile <= 1:
        out.append("clip_quantile must be in (0, 1]")
    last = ""
    for name, (a, b) in sorted(contract.splits.items(), key=lambda x: x[1]):
        if a > b or a <= last:
            out.append(f"split {name} is out of order or overlaps")
        last = b
    return out


@dataclass(frozen=True)
class Rule:
    """What a setting must be: its type, inclusive or open bounds, allowed values."""

    kind: type
    least: float | None = None
    most: float | None = None
    above: float | None = None
    among: tuple = ()
    optional: bool = False

    def fault(self, value) -> str | None:
        number = self.kind in (int, float)
        if number and isinstance(value, bool) or not isinstance(value, (int, float) if self.kind is float else self.kind):
            return f"must be {self.kind.__name__}"
        if number and not math.isfinite(value):
            return "must be finite"
        if self.least is not None and value < self.least:
            return f"must be {self.least} or more"
        if self.most is not None and value > self.most:
            return f"must be {self.most} or less"
        if self.above is not None and value <= self.above:
            return f"must be above {self.above}"
        if self.among and value not in self.among:
            return f"must be one of {list(self.among)}"
        return None


def setting(config: dict, path: str):
    """The value at a dotted path; KeyError where there is none."""
    for part in path.split("."):
        if not isinstance(config, dict) or part not in config:
            raise KeyError(path)
        config = config[part]
    return config


def config_problems(config: dict, rules: dict[str, Rule], chronology: Sequence[str] = (), distinct: Sequence[str] = ()) -> list[str]:
    """All faults of a configuration, in the order of the rules.

    ``chronology`` lists the paths of [first, last] date pairs (YYYY-MM-DD) that must follow one another
    without overlap; ``distinct`` the paths of outputs that must not share a place or lie in one another.
    """
    out = []
    for path, rule in rules.items():
        try:
            if fault := rule.fault(setting(config, path)):
                out.append(f"{path} {fault}")
        except KeyError:
            if not rule.optional:
                out.append(f"{path} is missing")
    last = None
    for path in chronology:
        try:
            first, until = (date.fromisoformat(x) for x in setting(config, path))
        except (KeyError, TypeError, ValueError):
            out.append(f"{path} must be two dates")
            continue
        if first > until:
            out.append(f"{path} ends before it starts")
        if last is not None and first <= last:
            out.append(f"{path} starts before the one before it ends")
        last = until
    places = []
    for path in distinct:
        try:
            place = PurePosixPath(os.path.normpath(setting(config, path)))
        except (KeyError, TypeError):
            out.append(f"{path} must be a path")
            continue
        if clash := [p for p, other in places if place == other or place in other.parents or other in place.parents]:
            out.append(f"{path} shares a place with {clash[0]}")
        places.append((path, place))
    return out


def checked(text: str, base: str, rules: dict[str, Rule], chronology: Sequence[str] = (), distinct: Sequence[str] = (), paths: Sequence[str] = ()) -> dict:
    """The configuration in ``text``, strictly read, with the settings named in ``paths`` made absolute from ``base``; fails with all faults."""
    config = load_json(text)
    if faults := config_problems(config, rules, chronology, distinct):
        raise ValueError("; ".join(faults))
    for path in paths:
        *above, last = path.split(".")
        owner = setting(config, ".".join(above)) if above else config
        owner[last] = os.path.normpath(os.path.join(base, os.path.expanduser(owner[last])))
    return config
