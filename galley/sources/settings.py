"""Settings from the environment, and their redacted summary."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields

_SECRET = re.compile(r"key|token|secret|password", re.I)


def csv(value: str | None) -> tuple[str, ...]:
    return tuple(p.strip() for p in (value or "").split(",") if p.strip())


@dataclass(frozen=True)
class Settings:
    """Names are the environment's in lower case, behind ``GALLEY_``."""

    senders: tuple[str, ...] = ()
    lookback_days: int = 3
    chunk_chars: int = 14000
    max_chunks: int = 6
    max_retries: int = 3
    api_key: str = ""

    def __post_init__(self):
        for name, low, high in (("lookback_days", 1, 365), ("chunk_chars", 1, 10**7), ("max_chunks", 1, 32), ("max_retries", 0, 100)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        given = {f.name: env[f"GALLEY_{f.name.upper()}"] for f in fields(cls) if f"GALLEY_{f.name.upper()}" in env}
        return cls(**{k: csv(v) if k == "senders" else v if k == "api_key" else int(v) for k, v in given.items()})

    def summary(self) -> dict[str, str]:
        """All settings as text; secrets show their first three characters at most."""
        show = lambda n, v: (f"{v[:3]}…" if len(v) > 8 else "…") if _SECRET.search(n) and v else ",".join(v) if isinstance(v, tuple) else str(v)
        return {f.name: show(f.name, getattr(self, f.name)) for f in fields(self)}
