"""Settings: built-in defaults, overlaid field by field by a TOML file of sections [scope], [fts], [semantic] and [semantic.embeddings].

An empty list in the file doesn't erase a list of the defaults. Limits of 0 or less mean the default limit, so an overlap of 0 can't be set.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

INDEXED = tuple("." + e for e in "axaml cs csproj css editorconfig html json md mdx props razor scss slnx targets toml yaml yml".split())
MAX_BYTES, CHUNK, OVERLAP, PROBE = 524288, 110, 15, 8192


def normal(extensions: list[str] | tuple[str, ...] | None) -> list[str]:
    """Extensions trimmed, in lower case and with a dot, each once; empty ones dropped."""
    out: list[str] = []
    for e in extensions or []:
        e = e.strip().lower()
        e = e if not e or e.startswith(".") else "." + e
        if e and e not in out:
            out.append(e)
    return out


@dataclass(frozen=True)
class Settings:
    extra_include_roots: list[str] = field(default_factory=list)
    exclude_roots: list[str] = field(default_factory=list)
    exclude_path_segments: list[str] = field(default_factory=lambda: ".cache .git .idea .vs bin node_modules obj".split())
    ignore_files: list[str] = field(default_factory=lambda: [".gitignore", ".git/info/exclude"])
    include_cs_in_fts: bool = True
    include_extensions: list[str] = field(default_factory=lambda: list(INDEXED))
    exclude_extensions: list[str] = field(default_factory=list)
    max_indexed_file_bytes: int = MAX_BYTES
    chunk_lines: int = CHUNK
    chunk_overlap_lines: int = OVERLAP
    binary_probe_bytes: int = PROBE
    semantic_enabled: bool = False
    vec_extensions_mode: str = "inherit_fts"
    vec_extensions: list[str] = field(default_factory=list)
    vec_add_extensions: list[str] = field(default_factory=list)
    vec_remove_extensions: list[str] = field(default_factory=list)
    embedding_provider: str = "dummy"
    embedding_model: str = ""
    embedding_dim: int = 0
    embedding_model_path: str = ""
    embedding_vocab_path: str = ""
    embedding_do_lower_case: bool = True
    embedding_sequence_length: int = 0
    embedding_prefer_gpu: bool = True
    source: str = "default"
    error: str | None = None

    def extensions(self) -> list[str]:
        """Extensions that are indexed: included, less excluded; .cs goes by its own switch, whatever is excluded."""
        out = [e for e in normal(self.include_extensions) or list(INDEXED) if e not in normal(self.exclude_extensions)]
        if not self.include_cs_in_fts:
            return [e for e in out if e != ".cs"]
        return out if ".cs" in out else [*out, ".cs"]

    def vector_extensions(self) -> list[str]:
        """Extensions that are embedded: a list of its own or the indexed ones, less those removed, with those added."""
        own = normal(self.vec_extensions)
        base = own if self.vec_extensions_mode.strip().lower() == "custom" and own else self.extensions()
        out = [e for e in base if e not in normal(self.vec_remove_extensions)]
        return out + [e for e in normal(self.vec_add_extensions) if e not in out]

    def effective(self) -> dict:
        """Resolved scan and chunk settings."""
        pick = lambda v, default: v if v > 0 else default
        return {
            "include_cs_in_fts": self.include_cs_in_fts, "extra_include_roots": self.extra_include_roots, "exclude_roots": self.exclude_roots, "extensions": self.extensions(),
            "exclude_path_segments": self.exclude_path_segments, "ignore_files": self.ignore_files, "max_indexed_file_bytes": pick(self.max_indexed_file_bytes, MAX_BYTES),
            "chunk_lines": pick(self.chunk_lines, CHUNK), "chunk_overlap_lines": pick(self.chunk_overlap_lines, OVERLAP), "binary_probe_bytes": pick(self.binary_probe_bytes, PROBE),
        }


_SECTIONS = {
    ("scope",): ("extra_include_roots", "exclude_roots", "exclude_path_segments", "ignore_files"),
    ("fts",): ("include_cs_in_fts", "include_extensions", "exclude_extensions", "max_indexed_file_bytes", "chunk_lines", "chunk_overlap_lines", "binary_probe_bytes"),
    ("semantic",): ("enabled", "vec_extensions_mode", "vec_extensions", "vec_add_extensions", "vec_remove_extensions"),
    ("semantic", "embeddings"): ("provider", "model", "dim", "model_path", "vocab_path", "do_lower_case", "sequence_length", "prefer_gpu"),
}


def overlaid(text: str, base: Settings | None = None, source: str = "disk") -> Settings:
    """base with the values of a TOML text; if that can't be read, base with the error."""
    base = base or Settings()
    try:
        found = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        return replace(base, error=base.error or f"{type(e).__name__}: {e}")
    kinds = {f.name: type(getattr(base, f.name)) for f in fields(base)}
    values = {}
    for path, names in _SECTIONS.items():
        part = found
        for p in path:
            part = part.get(p, {}) if isinstance(part, dict) else {}
        for n in names:
            key = f"semantic_{n}" if n == "enabled" else f"embedding_{n}" if path[-1] == "embeddings" else n
            v = part.get(n) if isinstance(part, dict) else None
            if v is not None and isinstance(v, kinds[key]) and v != []:
                values[key] = v
    return replace(base, **values, source=source)


def load(index_folder: str) -> Settings:
    """Defaults with settings.toml of an index folder, where there is one."""
    file = Path(index_folder, "settings.toml")
    if not file.is_file():
        return Settings()
    return overlaid(file.read_text("utf-8-sig"), Settings(), "default+disk")
