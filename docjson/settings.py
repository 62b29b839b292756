"""Settings of an extraction; each can come from an environment variable of its upper-case name."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from docjson.functions.truncate import Limits


@dataclass(frozen=True)
class Settings:
    # The defaults.
    max_iterations_per_chunk: int = 20
    max_chunk_retries: int = 3
    truncate_skeleton_limit: int = 6000
    truncate_guidance_limit: int = 6000
    truncate_read_value_limit: int = 6000
    truncate_indentation: int = 4
    truncate_min_string_len: int = 23
    truncate_ellipsis_size: int = 3
    truncate_min_array_items: int = 2
    truncate_min_object_keys: int = 2
    chunk_size: int = 8000
    chunk_overlap: int = 400
    keep_rounds: int = 2

    @classmethod
    def from_env(cls) -> Settings:
        return cls(**{f.name: int(os.environ[f.name.upper()]) for f in fields(cls) if f.name.upper() in os.environ})

    @property
    def limits(self) -> Limits:
        return Limits(self.truncate_indentation, self.truncate_min_string_len, self.truncate_ellipsis_size, self.truncate_min_array_items, self.truncate_min_object_keys)
