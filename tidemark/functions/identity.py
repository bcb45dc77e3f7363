"""Identities of runs, families and seeds from canonical JSON: of one run on the driver, of a table of runs as columns."""

from __future__ import annotations

import hashlib
import json
import math
import os
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SEED_VERSION = 1
#: Keys that say when or where a run was, not what it was.
VOLATILE = ("ts", "time", "timestamp", "path", "dir", "created_at", "generated_at", "out")


def canonical(x: Any, sort_lists: bool = False) -> Any:
    """Floats rounded to ten places, NaN and infinities as null, keys sorted, lists sorted if asked."""
    if isinstance(x, dict):
        return {str(k): canonical(v, sort_lists) for k, v in sorted(x.items(), key=lambda kv: str(kv[0]))}
    if isinstance(x, (list, tuple)):
        out = [canonical(v, sort_lists) for v in x]
        return sorted(out, key=lambda v: json.dumps(v, sort_keys=True)) if sort_lists else out
    if isinstance(x, float):
        return round(x, 10) if math.isfinite(x) else None
    return x


def to_json(x: Any, sort_lists: bool = False) -> str:
    return json.dumps(canonical(x, sort_lists), sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def digest(x: Any, n: int = 16, sort_lists: bool = False) -> str:
    return hashlib.sha256(to_json(x, sort_lists).encode()).hexdigest()[:n]


def run_id(payload: dict) -> str:
    return digest(payload)


def digest_of(*columns: str, n: int = 16) -> Column:
    """``digest`` of each row's payload of these columns, whole numbers, texts and booleans; NULL is null."""
    payload = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(payload, 256), 1, n)


def run_key(payload: dict) -> str:
    """Equal for runs that differ only in when and where they ran."""
    return digest({k: v for k, v in payload.items() if not any(k.lower() == w or k.lower().endswith("_" + w) for w in VOLATILE)})


def factor_run_id(config: dict) -> str:
    return "fctr_" + digest(config)


def regime_run_id(config: dict) -> str:
    return "rgm_" + digest(config)


def family_id(payload: dict) -> str:
    return "rcfam_" + digest(payload, sort_lists=True)


def hypothesis_id(payload: dict) -> str:
    return "hyp_" + digest(payload, sort_lists=True)


def cache_key(**parts: Any) -> str:
    return digest(parts, 64)


def seed_root(key: str, salt: str, fold_id: str | None = None, version: int = SEED_VERSION) -> int:
    """The first eight bytes of a hash of run key, salt, fold and version, below 2^63."""
    text = f"{key}|{salt}" + (f"|fold:{fold_id}" if fold_id else "") + f"|{version}"
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big") % 2**63


def seed_of(key: str, salt: str, version: int = SEED_VERSION) -> Column:
    """``seed_root`` of each row's run key."""
    head = F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(salt), F.lit(str(version))), 256), 1, 16), 16, 10)
    return (head.cast("decimal(20,0)") % F.lit(str(2**63)).cast("decimal(20,0)")).cast("long")


def rng_for(key: str, salt: str, fold_id: str | None = None) -> np.random.Generator:
    return np.random.default_rng(seed_root(key, salt, fold_id))


def now_iso(env: str = "TIDEMARK_NOW") -> str:
    """The time in UTC, or what the environment variable says, so that reruns can be equal."""
    return os.environ.get(env) or datetime.now(timezone.utc).replace(microsecond=0).isoformat()


@dataclass(frozen=True)
class RunContext:
    run_key: str
    run_instance_id: str
    dataset_id: str
    engine_version: str = ""
    config_version: str = ""
    seed_version: int = SEED_VERSION
    schema_versions: dict[str, int] = field(default_factory=dict)

    def require_for_promotion(self) -> None:
        empty = [k for k in ("run_key", "dataset_id", "engine_version", "config_version") if not getattr(self, k)]
        if empty:
            raise ValueError(f"missing for promotion: {', '.join(empty)}")


@dataclass(frozen=True)
class ExecutionEvidence:
    min_liquidity_usd: float | None = None
    max_participation_rate: float | None = None
    spread_model: str | None = None
    impact_model: str | None = None
    capacity_curve_path: str | None = None
    cost_config: dict | None = None
    notes: str = ""

    def missing(self) -> list[str]:
        return [k for k in ("min_liquidity_usd", "max_participation_rate", "spread_model", "impact_model", "capacity_curve_path", "cost_config") if getattr(self, k) is None]


def manifest(name: str, args: dict, window: tuple[str, str], outputs: list[str], metrics: dict, notes: str = "") -> dict:
    body = {"name": name, "args": args, "data_window": list(window), "outputs": outputs, "metrics": metrics, "notes": notes}
    return canonical(body | {"run_id": run_id(body), "run_key": run_key(args), "created_at": now_iso()})


def attestation(context: RunContext, folds: list[dict], transforms: list[dict], checks: dict[str, bool], seed: int | None = None) -> dict:
    return canonical({"context": asdict(context), "folds": folds, "transforms": transforms, "checks": checks, "seed_root": seed})


def attestation_blockers(att: dict) -> list[str]:
    """What keeps an attestation from proof: no folds, failed or missing checks, transforms fitted on more
    than training rows."""
    out = [f"{k} is missing" for k in ("run_key", "dataset_id") if not att.get("context", {}).get(k)]
    out += [] if att.get("folds") else ["no folds"]
    checks = att.get("checks") or {}
    out += [f"check failed: {c}" for c in ("train_only_fit", "no_overlap", "embargo_held") if not checks.get(c)]
    out += [f"transform {t.get('name')} was not fitted on training rows" for t in att.get("transforms") or [] if t.get("kind") == "trainable" and t.get("fitted_on") != "train"]
    return out
