"""Settings of a benchmark run: defaults, a YAML file, then what the caller gives. Lists know three states: None is all,
an empty list none, else only those."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Config:
    models: list | None = None
    datasets: list | None = None
    sources: list | None = None
    irs: list | None = field(default_factory=lambda: [5, 10, 20, 30])
    keel_folds: str = "5fold"
    n_folds: int = 5
    base_seed: int = 42
    smoke: bool = False
    out: str = "results.parquet"
    model_params: dict = field(default_factory=dict)


def load(path: str | None = None, **given) -> Config:
    """A missing file counts as empty; a given value beats the file's. One holdout is all that complete sets have."""
    import os

    read = {}
    if path and os.path.exists(path):
        import yaml

        with open(path) as f:
            read = yaml.safe_load(f) or {}
    names = {f.name for f in fields(Config)}
    made = replace(Config(), **{k: v for k, v in read.items() if k in names} | given)
    if made.keel_folds not in ("5fold", "complete"):
        raise ValueError("keel_folds is 5fold or complete")
    return replace(made, n_folds=1) if made.keel_folds == "complete" else made
