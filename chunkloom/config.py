"""Settings: defaults, a TOML file, per-document files beside the documents, command line."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields

from .model import E_CONFIG, DocError
from .operators.chunking import STRATEGIES

FORMATS = ("json", "jsonl", "parquet", "markdown")
#: Shapes of JSON output other than chunks: a flat list of typed elements.
COMPATS = ("elements",)
#: The largest number a settings file may give (token counts are 32-bit integers).
MOST = (1 << 31) - 1
#: Ending of the settings file beside a document (CHUNKLOOM_SIDECAR names another).
SIDECAR = os.environ.get("CHUNKLOOM_SIDECAR", ".chunkloom.toml")


@dataclass
class Settings:
    input: str | None = None
    output: str | None = None
    format: str = "json"
    output_compat: str | None = None
    chunk_strategy: str = "by-structure"
    max_tokens: int = 512
    overlap: int = 50
    tokenizer: str = "byte_bpe_50k"
    models: str | None = None
    mode: str = "accurate"
    workers: int | None = None
    gpu: bool = False
    strict: bool = False
    debug: bool = False
    debug_output: str | None = None
    log_level: str = "warn"

    def problems(self) -> list[str]:
        """All violations, not only the first."""
        return [
            why
            for bad, why in (
                (not self.input, "an input is required"), (not self.output, "an output is required"), (self.overlap >= self.max_tokens, "overlap must be less than max_tokens"), (not 1 <= self.max_tokens <= MOST, "max_tokens must be at least 1"), (not 0 <= self.overlap <= MOST, "overlap must be at least 0"),
                (bool(self.debug_output) and not self.debug, "debug output needs debug"), (self.workers is not None and self.workers < 1, "workers must be at least 1"), (self.gpu and self.mode == "fast", "gpu and fast mode exclude each other"),
                (self.format not in FORMATS, f"format must be one of {', '.join(FORMATS)}"), (self.chunk_strategy not in STRATEGIES, f"chunk_strategy must be one of {', '.join(STRATEGIES)}"),
                (self.output_compat not in (None, *COMPATS), f"output_compat must be one of {', '.join(COMPATS)}"),
            )
            if bad
        ]


def parse_toml(text: str) -> dict:
    """Known keys only."""
    try:
        got = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise DocError(E_CONFIG, f"configuration: {e}") from e
    unknown = sorted(set(got) - {f.name for f in fields(Settings)})
    if unknown:
        raise DocError(E_CONFIG, f"unknown keys: {', '.join(unknown)}")
    return got


def merged(defaults: Settings, file: dict, given: dict) -> Settings:
    """What was given on the command line goes before the file, the file before the defaults."""
    out = Settings(**{f.name: getattr(defaults, f.name) for f in fields(Settings)})
    for k, v in (file | given).items():
        setattr(out, k, v)
    return out


def parse_sidecar(text: str) -> dict | None:
    """Strategy, max_tokens and overlap of one document; None if it can't be read. Values that make no sense are an error."""
    try:
        got = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return None
    out = {k: got[k] for k in ("chunk_strategy", "max_tokens", "overlap") if k in got}
    if out.get("chunk_strategy", "fixed") not in STRATEGIES:
        return None
    if any(type(out.get(k, 1)) is not int for k in ("max_tokens", "overlap")):  # a boolean is no number
        return None
    if not 1 <= out.get("max_tokens", 1) <= MOST or not 0 <= out.get("overlap", 0) <= MOST:
        raise DocError(E_CONFIG, f"max_tokens must be from 1 and overlap from 0 to {MOST}")
    return out
