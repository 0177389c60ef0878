"""Options of the document flow: plain values, checked once, given to the operators."""

from __future__ import annotations

from dataclasses import dataclass, fields
from types import MappingProxyType


@dataclass(frozen=True)
class ChunkingOptions:
    parent_delimiter: str = "<<<PARENT_BREAK>>>"
    child_delimiter: str = "<<<CHILD_BREAK>>>"
    parent_max_chars: int = 4500
    child_target_chars: int = 900
    child_overlap_chars: int = 180


@dataclass(frozen=True)
class Options:
    """What changes results; ``extractor`` options are passed on as they are."""

    max_bytes: int = 80 << 20
    require_signature: bool = True
    light_repair: bool = True
    full_repair: bool = True
    rasterize: bool = True
    rasterize_dpi: int = 180
    native_first: bool = True
    chunk: bool = True
    chunking: ChunkingOptions = ChunkingOptions()
    hybrid_mode: str = "auto"
    hybrid_timeout_ms: int = 300_000
    timeout_s: int = 360
    extractor: MappingProxyType = MappingProxyType({"table_method": "cluster", "reading_order": "xycut", "use_struct_tree": False})

    def checked(self) -> Options:
        """Self, or a ValueError that names the first option out of its range."""
        c = self.chunking
        rules = [
            ("hybrid_mode must be auto or full", self.hybrid_mode in ("auto", "full")),
            ("hybrid_timeout_ms must be positive", self.hybrid_timeout_ms > 0),
            ("timeout_s must be positive", self.timeout_s > 0),
            ("max_bytes must be positive", self.max_bytes > 0),
            ("rasterize_dpi must be positive", self.rasterize_dpi > 0),
        ]
        if self.chunk:
            rules += [
                ("parent_delimiter must not be blank", bool(c.parent_delimiter.strip())),
                ("child_delimiter must not be blank", bool(c.child_delimiter.strip())),
                ("delimiters must differ", c.parent_delimiter != c.child_delimiter),
                ("parent_max_chars must be positive", c.parent_max_chars > 0),
                ("child_target_chars must be positive", c.child_target_chars > 0),
                ("child_overlap_chars must not be negative", c.child_overlap_chars >= 0),
            ]
        for message, holds in rules:
            if not holds:
                raise ValueError(message)
        return self

    @classmethod
    def from_conf(cls, spark, prefix: str = "quireflow.") -> Options:
        """Defaults, overridden by the session's settings ``quireflow.<option>``; checked."""

        def read(kind: type, defaults) -> dict:
            found = {}
            for f in fields(kind):
                value = spark.conf.get(prefix + f.name, None)
                default = getattr(defaults, f.name)
                if value is None or not isinstance(default, (bool, int, str)):
                    continue
                if isinstance(default, bool):
                    found[f.name] = value.strip().lower() in ("1", "true", "yes", "on")
                else:
                    found[f.name] = type(default)(value)
            return found

        return cls(**read(cls, cls()), chunking=ChunkingOptions(**read(ChunkingOptions, ChunkingOptions()))).checked()
