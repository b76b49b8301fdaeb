"""Parameters of a corpus build and of training metrics, from nested YAML to one flat, frozen record."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Config:
    """All settings with their defaults. None means no limit."""

    model_name: str = ""
    reduce_student: bool = True
    reduction_factor: int = 2
    train_file: str = ""
    max_length: int = 512
    overlap: int = 380
    batch_size: int = 4
    accumulation: int = 4
    epochs: int = 100
    learning_rate: float = 1e-4
    warmup_share: float = 0.1
    clip_norm: float | None = 1.0
    kd_ratio: float = 1.0
    max_steps_per_epoch: int | None = None
    eval_every: int = 200
    eval_steps: int | None = 200
    sample_every: int = 500
    log_every: int = 100
    save_every: int = 5
    keep_checkpoints: int = 1
    resume_from: str | None = None
    seed: int = 42
    output: str = "runs"
    tracking: bool = False
    track_every: int = 10
    project: str = ""
    run_name: str = ""
    run_resume_id: str | None = None


#: Where nested documents keep a setting; numbers are positions in a list.
PLACES: dict[str, tuple[str | int, ...]] = {
    "model_name": ("model", "name"),
    "reduce_student": ("model", "student", "reduce_size"),
    "reduction_factor": ("model", "student", "size_reduction_factor"),
    "train_file": ("data", "sources", 0, "path"),
    "max_length": ("data", "max_length"),
    "overlap": ("data", "stride"),
    "batch_size": ("data", "batch_size"),
    "learning_rate": ("training", "learning_rate"),
    "epochs": ("training", "epochs"),
    "max_steps_per_epoch": ("training", "max_steps_per_epoch"),
    "accumulation": ("training", "gradient_accumulation_steps"),
    "clip_norm": ("training", "clip_grad_norm"),
    "kd_ratio": ("training", "kd_ratio"),
    "seed": ("training", "seed"),
    "log_every": ("training", "log_every_n_steps"),
    "eval_every": ("training", "eval_every"),
    "eval_steps": ("training", "eval_steps"),
    "save_every": ("checkpointing", "save_every_n_epochs"),
    "keep_checkpoints": ("checkpointing", "keep_n_checkpoints"),
    "resume_from": ("checkpointing", "resume"),
    "output": ("output", "dir"),
    "tracking": ("wandb", "enabled"),
    "project": ("wandb", "project"),
    "run_name": ("wandb", "name"),
    "run_resume_id": ("wandb", "resume_id"),
    "track_every": ("wandb", "log_every_n_steps"),
    "sample_every": ("wandb", "generate_every_n_steps"),
}

_ABSENT = object()


def _at(document: Any, place: tuple[str | int, ...]) -> Any:
    for key in place:
        if isinstance(key, int):
            if not isinstance(document, list) or len(document) <= key:
                return _ABSENT
        elif not isinstance(document, dict) or key not in document:
            return _ABSENT
        document = document[key]
    return document


def flatten(document: dict[str, Any], **overrides: Any) -> Config:
    """A Config of a nested document; of a list of sources the first counts. Absent settings, and nulls where a value is needed, keep their defaults; a null in an optional setting is None. Overrides win (a resume path given by hand, say); unknown ones are errors."""
    optional = {f.name for f in dataclasses.fields(Config) if "None" in str(f.type)}
    found = {name: _at(document, place) for name, place in PLACES.items()}
    found = {n: v for n, v in found.items() if v is not _ABSENT and (v is not None or n in optional)}
    return Config(**found | overrides)


def read_yaml(path: str) -> dict[str, Any]:
    """A YAML file; without a YAML library, of nested mappings, lists and plain values."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        return _plain(text)
    return yaml.safe_load(text)


def _plain(text: str) -> dict[str, Any]:
    root: dict[str, Any] = {}
    stack: list[tuple[int, Any, Any, Any]] = [(-1, root, None, None)]  # indent, container, its parent and key there
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        indent = len(line) - len(body)
        while stack[-1][0] >= indent and not (body.startswith("- ") and stack[-1][0] == indent):
            stack.pop()
        _, box, parent, key = stack[-1]
        if body.startswith("- "):
            if not isinstance(box, list):
                parent[key] = box = []
                stack[-1] = (stack[-1][0], box, parent, key)
            body = body[2:].strip()
            if ": " not in f"{body} " or body[:1] in "\"'":
                box.append(_scalar(body))
                continue
            item: dict[str, Any] = {}
            box.append(item)
            stack.append((indent + 1, item, box, len(box) - 1))
            indent, box = indent + 2, item
        name, _, value = body.partition(":")
        if value.strip():
            box[name] = _scalar(value)
        else:
            box[name] = {}
            stack.append((indent, box[name], box, name))
    return root


def _scalar(text: str) -> Any:
    t = text.strip()
    if t[:1] in "\"'" and t[-1:] == t[:1] and len(t) > 1:
        return t[1:-1]
    if t in ("null", "~", "None", ""):
        return None
    if t == "[]":
        return []
    if t.lower() in ("true", "false"):
        return t.lower() == "true"
    for kind in (int, float):
        try:
            return kind(t)
        except ValueError:
            pass
    return t
