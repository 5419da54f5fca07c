"""Limits of a run, read strictly from the environment: unknown keys and bad values are errors that never show a value."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, replace

PREFIX = "DOCLOOM_"


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Limits:
    provider_timeout_ms: int = 30_000
    context_characters: int = 32_000
    raw_response_bytes: int = 1_048_576
    blob_bytes: int = 16_777_216

    @property
    def stored_response_bytes(self) -> int:
        """A raw response is held to the smaller of both bounds."""
        return min(self.blob_bytes, self.raw_response_bytes)


def positive(key: str, text: str) -> int:
    if not text.isascii() or not text.isdigit() or int(text) == 0:
        raise ConfigError(f"{key}: a positive integer is needed")
    return int(text)


def load(environment: Mapping[str, str] | None = None) -> Limits:
    found = {}
    for key, text in sorted((os.environ if environment is None else environment).items()):
        if not key.startswith(PREFIX):
            continue
        name = key.removeprefix(PREFIX).lower()
        if name not in Limits.__dataclass_fields__:
            raise ConfigError(f"{key}: unknown key")
        found[name] = positive(key, text)
    return replace(Limits(), **found)
