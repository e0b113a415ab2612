"""Experiment configurations: YAML files that extend each other, as frozen settings."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any

from tidewater.operators.overlay import Settings


@dataclass(frozen=True)
class Retrieval:
    pipeline: str = "lexical_title_abstract"
    text: str = "title_abstract"
    top_k: int = 1000
    k1: float = 1.5
    b: float = 0.75
    #: Folder of stored indexes, a folder per snapshot and text mode. What stands there is searched, what doesn't is built.
    index_root: str = ""


@dataclass(frozen=True)
class Expansion:
    docs: int = 3
    terms: int = 10
    original: float = 0.6


@dataclass(frozen=True)
class Rerank:
    candidate_k: int = 100
    top_k: int = 100


@dataclass(frozen=True)
class Experiment:
    name: str = "experiment"
    snapshots: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ("ndcg_cut_10", "ndcg_cut_1000", "map", "recall_100", "recall_1000")
    output_dir: str = "outputs"
    retrieval: Retrieval = field(default_factory=Retrieval)
    expansion: Expansion = field(default_factory=Expansion)
    rerank: Rerank = field(default_factory=Rerank)
    overlay: Settings | None = None


def deep_merge(base: dict, child: dict) -> dict:
    """The child's values over the base's; dicts merge, everything else is replaced."""
    out = dict(base)
    for k, v in child.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_raw(path: str | Path, seen: tuple[Path, ...] = ()) -> dict:
    """A file merged over what its `extends` names, relative to it. A circle is an error."""
    import yaml

    path = Path(path).resolve()
    if path in seen:
        raise ValueError(f"{path} extends itself")
    raw = yaml.safe_load(path.read_text()) or {}
    parent = raw.pop("extends", None)
    return deep_merge(load_raw(path.parent / parent, (*seen, path)), raw) if parent else raw


def _typed(kind: type, raw: dict) -> Any:
    known = {f.name: f for f in fields(kind)}
    if extra := raw.keys() - known.keys():
        raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
    nested = {"retrieval": Retrieval, "expansion": Expansion, "rerank": Rerank, "overlay": Settings}
    value = lambda k, v: _typed(nested[k], v) if k in nested and isinstance(v, dict) and not is_dataclass(v) else tuple(v) if isinstance(v, list) else v
    return kind(**{k: value(k, v) for k, v in raw.items()})


def for_snapshot(e: Experiment, snapshot: str) -> Experiment:
    """The experiment over one snapshot."""
    return replace(e, snapshots=(snapshot,))


def for_training(e: Experiment, variant: str = "dctr", snapshot: str = "snapshot-1") -> Experiment:
    """The experiment over the snapshot with training judgments, named by their variant."""
    return replace(e, snapshots=(snapshot,), name=f"{e.name}-train-{variant}")


def base_folder(path: str | Path) -> Path:
    """What relative paths in a configuration are relative to: the folder above `configs` if it lies right in one, else its own."""
    here = Path(path).resolve().parent
    return here.parent if here.name == "configs" else here


def load(path: str | Path) -> Experiment:
    e = _typed(Experiment, load_raw(path))
    return e if Path(e.output_dir).is_absolute() else _typed(Experiment, {**{f.name: getattr(e, f.name) for f in fields(e)}, "output_dir": str(base_folder(path) / e.output_dir)})
