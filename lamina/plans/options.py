"""Options of the merges, the compaction and the writer, with their checks."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class NumericMode(Enum):
    FLOAT64_PRAGMATIC = "float64_pragmatic"
    EXACT_SAFE = "exact_safe"


class StringMode(Enum):
    STRICT_TYPED = "strict_typed"
    PRIMITIVE_TO_STRING = "primitive_to_string"


class MergeOrder(Enum):
    PRESERVE_INPUT_ORDER = "preserve"
    ALLOW_INTERLEAVED = "interleaved"


class Encoding(Enum):
    PLAIN = "PLAIN"
    DELTA_BINARY_PACKED = "DELTA_BINARY_PACKED"
    DELTA_LENGTH_BYTE_ARRAY = "DELTA_LENGTH_BYTE_ARRAY"
    DELTA_BYTE_ARRAY = "DELTA_BYTE_ARRAY"
    BYTE_STREAM_SPLIT = "BYTE_STREAM_SPLIT"


#: Physical Parquet types that an encoding can hold; one that isn't here holds all.
ENCODABLE = {
    Encoding.DELTA_BINARY_PACKED: {"INT32", "INT64"},
    Encoding.DELTA_LENGTH_BYTE_ARRAY: {"BYTE_ARRAY"},
    Encoding.DELTA_BYTE_ARRAY: {"BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY"},
    Encoding.BYTE_STREAM_SPLIT: {"INT32", "INT64", "FLOAT", "DOUBLE", "FIXED_LEN_BYTE_ARRAY"},
}


@dataclass(frozen=True)
class Compression:
    """``uncompressed``, ``snappy``, ``lz4_raw`` or ``zstd`` with a level."""

    codec: str = "uncompressed"
    level: int | None = None

    def check(self, label: str) -> None:
        if self.codec not in ("uncompressed", "snappy", "lz4_raw", "zstd"):
            raise ValueError(f"{label} has unknown codec {self.codec}")
        if self.codec == "zstd" and not 1 <= (self.level if self.level is not None else 3) <= 22:
            raise ValueError(f"{label} zstd level must be between 1 and 22, got {self.level}")


@dataclass(frozen=True)
class WideningOptions:
    numeric: NumericMode = NumericMode.FLOAT64_PRAGMATIC
    strings: StringMode = StringMode.STRICT_TYPED


@dataclass(frozen=True)
class PayloadOptions:
    payload_column: str = "payload"
    widening: WideningOptions = WideningOptions()


@dataclass(frozen=True)
class TopLevelOptions:
    numeric: NumericMode = NumericMode.FLOAT64_PRAGMATIC

    @property
    def widening(self) -> WideningOptions:
        return WideningOptions(self.numeric, StringMode.STRICT_TYPED)


@dataclass(frozen=True)
class ColumnOptions:
    """Writer options of one leaf column, by its path."""

    path: tuple[str, ...]
    dictionary_enabled: bool | None = None
    encoding: Encoding | None = None
    compression: Compression | None = None


@dataclass(frozen=True)
class ExecutionOptions:
    """How a merge is written. Batch, prefetch, parallelism and memory options are checked and kept; Spark's own settings rule them."""

    ordering_field: str | None = None
    read_batch_size: int = 32_768
    output_batch_rows: int = 32_768
    prefetch_batches_per_source: int = 1
    output_row_group_rows: int = 128_000
    parallelism: int = 1
    unordered_merge_order: MergeOrder = MergeOrder.PRESERVE_INPUT_ORDER
    writer_compression: Compression = Compression()
    writer_dictionary_enabled: bool = True
    writer_column_options: tuple[ColumnOptions, ...] = ()
    writer_version: int = 1
    writer_data_page_size_limit: int | None = None
    writer_dictionary_page_size_limit: int | None = None
    writer_data_page_row_count_limit: int | None = None
    stats_fast_path: bool = True
    ordered_memory_budget_bytes: int | None = None

    def check(self) -> None:
        for name in ("read_batch_size", "output_batch_rows", "prefetch_batches_per_source", "output_row_group_rows"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be greater than zero")
        for name in ("ordered_memory_budget_bytes", "writer_data_page_size_limit", "writer_dictionary_page_size_limit", "writer_data_page_row_count_limit"):
            if getattr(self, name) is not None and getattr(self, name) <= 0:
                raise ValueError(f"{name} must be greater than zero when set")
        self.writer_compression.check("writer_compression")
        seen = set()
        for c in self.writer_column_options:
            if not c.path:
                raise ValueError("writer_column_options path must not be empty")
            label = ".".join(c.path)
            if any(not part.strip() for part in c.path):
                raise ValueError(f"writer_column_options path `{label}` contains an empty component")
            if c.dictionary_enabled is None and c.encoding is None and c.compression is None:
                raise ValueError(f"writer_column_options path `{label}` must set dictionary_enabled, encoding, or compression")
            if c.path in seen:
                raise ValueError(f"duplicate writer_column_options path `{label}`")
            seen.add(c.path)
            if c.compression:
                c.compression.check(f"writer_column_options `{label}` compression")
        if self.ordering_field is not None and not self.ordering_field.strip():
            raise ValueError("ordering_field must not be empty when provided")


@dataclass(frozen=True)
class NdjsonOptions:
    envelope_fields: tuple[str, ...] = ()
    payload_column: str = "payload"
    batch_rows: int = 8192
    scan_parallelism: int = 0
    read_buffer_bytes: int = 1 << 20
    sort_field: str | None = None
    sort_max_rows_in_memory: int | None = None  # Spark's sort spills; a caller may set a guard all the same
    widening: WideningOptions = field(default_factory=WideningOptions)

    def check(self) -> None:
        if not self.payload_column.strip():
            raise ValueError("payload_column must not be empty")
        for name in ("batch_rows", "sort_max_rows_in_memory"):
            if getattr(self, name) is not None and getattr(self, name) <= 0:
                raise ValueError(f"{name} must be greater than zero")
        seen = set()
        for name in self.envelope_fields:
            if name == self.payload_column:
                raise ValueError(f"envelope field `{name}` conflicts with payload column `{self.payload_column}`")
            if name in seen:
                raise ValueError(f"duplicate envelope field `{name}`")
            seen.add(name)
        if self.sort_field is not None:
            if not self.sort_field.strip():
                raise ValueError("sort_field must not be empty when provided")
            if self.sort_field not in seen:
                raise ValueError(f"sort_field `{self.sort_field}` must also be listed in envelope_fields")


def resolved_parallelism(requested: int, cores: int, inputs: int) -> int:
    """0 stands for all cores; never more than there are inputs, never less than one."""
    return max(1, min(requested or cores, max(inputs, 1)))
