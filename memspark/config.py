"""Settings from a TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass

from memspark.functions.text import REDACTION


@dataclass(frozen=True)
class Settings:
    """Least confidence of the gate, redaction of private data, how many rows retrieval and vectors give, and the retrieval backend (tables, vectors or auto)."""

    confidence_threshold: float = 0.7
    pii_redaction: str = "off"
    query_top_k: int = 20
    query_chunk_top_k: int = 10
    backend: str = "auto"

    def retrieval(self, has_vectors: bool) -> str:
        """The backend to use: ``auto`` takes vectors where there are any."""
        if self.backend != "auto":
            return self.backend
        return "vectors" if has_vectors else "tables"


def load_settings(path: str) -> Settings:
    """The settings of the sections engine, security and retrieval; what a file leaves out has its default, unknown keys and values are errors."""
    with open(path, "rb") as f:
        found = tomllib.load(f)
    flat = {k: v for section in ("engine", "security", "retrieval") for k, v in found.get(section, {}).items()}
    unknown = [s for s in found if s not in ("engine", "security", "retrieval")] + [k for k in flat if k not in Settings.__dataclass_fields__]
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    out = Settings(**flat)
    if out.pii_redaction not in REDACTION or out.backend not in ("auto", "tables", "vectors"):
        raise ValueError(f"bad value in {path}")
    return out
