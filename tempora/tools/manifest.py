"""A manifest of a run: inputs by hash, features by hash, parameters, results; and its verification."""

from __future__ import annotations

import hashlib
import json
import subprocess
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, date, datetime
from pathlib import Path
from typing import Any

from tempora.plans.registry import FeatureRegistry, global_registry


@dataclass
class Verification:
    checks: list[tuple[str, bool]] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)

    @property
    def passed(self) -> bool:
        return not self.errors

    def add(self, name: str, passed: bool, error: str | None = None) -> None:
        self.checks.append((name, passed))
        if not passed:
            self.errors.append(error or name)


def sha256_file(path: str | Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 16):
            digest.update(part)
    return digest.hexdigest()


def _plain(value: Any) -> Any:
    if isinstance(value, Mapping):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_plain(v) for v in value]
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return str(value) if isinstance(value, Path) else value


def snapshot(paths: Sequence[str | Path], root: str | Path = ".") -> list[dict[str, Any]]:
    """Size and hash of all files named or below the folders named."""
    root, out = Path(root).resolve(), []
    for p in map(Path, paths):
        for f in sorted(x for x in p.rglob("*") if x.is_file()) if p.is_dir() else [p]:
            full = f.resolve()
            out.append({"path": str(full.relative_to(root)) if full.is_relative_to(root) else str(full), "size_bytes": full.stat().st_size, "sha256": sha256_file(full)})
    return out


def _git(root: Path, *args: str) -> str | None:
    try:
        return subprocess.run(["git", "-C", str(root), *args], capture_output=True, text=True, check=True, timeout=20).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def run_id(reproducible: Mapping[str, Any]) -> str:
    return hashlib.sha256(json.dumps(_plain(reproducible), sort_keys=True).encode()).hexdigest()[:16]


def build_manifest(
    *, root: str | Path = ".", input_files: Sequence[str | Path] = (), input_snapshot: Sequence[Mapping[str, Any]] | None = None, feature_names: Sequence[str] = (),
    parameters: Mapping[str, Any] | None = None, results: Mapping[str, Any] | None = None, registry: FeatureRegistry | None = None,
) -> dict[str, Any]:
    """The `reproducible` part holds no clock and gives the run id; the rest tells of this run."""
    root = Path(root).resolve()
    reproducible = {
        "inputs": list(input_snapshot) if input_snapshot is not None else snapshot(input_files, root),
        "features": (registry or global_registry()).hashes(list(feature_names)) if feature_names else {},
        "parameters": dict(parameters or {}),
        "git_commit": _git(root, "rev-parse", "HEAD"),
    }
    changed = _git(root, "status", "--porcelain")
    return _plain({"run_id": run_id(reproducible), "created_utc": datetime.now(UTC), "git_dirty": None if changed is None else bool(changed), "reproducible": reproducible, "results": results or {}})


def write_manifest(manifest: Mapping[str, Any], folder: str | Path = "artifacts/runs") -> Path:
    path = Path(folder) / manifest["run_id"] / "manifest.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(_plain(manifest), indent=2, sort_keys=True))
    return path


def verify_manifest(path: str | Path, root: str | Path = ".", registry: FeatureRegistry | None = None) -> Verification:
    """Hash inputs and features again and the run id too. Inputs without path or hash are reported as not checked."""
    out, root = Verification(), Path(root)
    try:
        manifest = json.loads(Path(path).read_text())
        kept = manifest["reproducible"]
    except (OSError, ValueError, KeyError) as e:
        out.add("manifest", False, f"cannot be read: {e}")
        return out
    out.add("run_id", manifest.get("run_id") == run_id(kept), "the run id does not match its content")
    for x in kept.get("inputs", []):
        if not x.get("path") or not x.get("sha256"):
            out.skipped.append(str(x.get("path") or x))
            continue
        f = root / x["path"]
        out.add(x["path"], f.is_file() and sha256_file(f) == x["sha256"], f"{x['path']} is missing or changed")
    registry = registry or global_registry()
    for name, value in kept.get("features", {}).items():
        out.add(name, registry.has(name) and registry.get(name).compute_hash() == value, f"feature {name} is missing or changed")
    return out
