"""Output configuration: what a JSON document may ask for, checked on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

MISSING = ("null", "omit", "error")
TYPES = ("string", "number", "integer", "boolean", "string[]", "number[]", "object", "object[]", "any")


class ProjectionError(Exception):
    """A field that must not be missing is, in a strict run."""


class ValidationError(Exception):
    """An output row breaks its schema, in a strict run."""


@dataclass
class FieldSpec:
    path: str
    source: str | None = None
    type: str = "any"
    required: bool = False
    normalize: str | None = None
    on_missing: str | None = None

    @property
    def reads(self) -> str:
        return self.source or self.path


@dataclass
class OutputConfig:
    fields: list[FieldSpec] = field(default_factory=list)
    include_confidence: bool = True
    include_provenance: bool = True
    on_missing: str = "null"
    default_region: str = "US"

    @classmethod
    def from_dict(cls, given: dict) -> OutputConfig:
        if not isinstance(given, dict):
            raise ValueError("a configuration must be an object")
        top = given.get("on_missing", "null")
        if top not in MISSING:
            raise ValueError(f"on_missing must be one of {', '.join(MISSING)}, not {top!r}")
        specs = []
        for f in given.get("fields") or []:
            if not isinstance(f, dict) or not f.get("path"):
                raise ValueError("every field needs a path")
            if f.get("type", "any") not in TYPES:
                raise ValueError(f"field {f['path']!r}: type {f['type']!r} is not one of {', '.join(TYPES)}")
            if f.get("on_missing") is not None and f["on_missing"] not in MISSING:
                raise ValueError(f"field {f['path']!r}: on_missing must be one of {', '.join(MISSING)}")
            specs.append(FieldSpec(f["path"], f.get("from") or None, f.get("type", "any"), bool(f.get("required", False)), f.get("normalize"), f.get("on_missing")))
        paths = [s.path for s in specs]
        for p in paths:
            if any(q.startswith(p + ".") for q in paths):
                raise ValueError(f"output path {p!r} is both a value and a parent of others")
        return cls(specs, bool(given.get("include_confidence", True)), bool(given.get("include_provenance", True)), top, given.get("default_region", "US"))

    @classmethod
    def load(cls, path: str) -> OutputConfig:
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))
