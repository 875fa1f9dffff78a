"""Settings of the compressor. They are read on the driver and compiled into expressions.

Fixed values: names and defaults of the settings are the public surface that callers rely on.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class NoiseConfig:
    drop_timestamps: bool = True
    drop_progress_bars: bool = True
    drop_separators: bool = True
    drop_status_messages: bool = True
    drop_log_levels: bool = False
    drop_stack_trace_frames: bool = True
    collapse_blank_lines: bool = True
    #: (Python regular expression as text or compiled, label), tried after the built-in rules in this order.
    extra_patterns: list[tuple] = field(default_factory=list)


@dataclass
class RedundancyConfig:
    drop_exact_duplicates: bool = True
    annotate_duplicate_counts: bool = True
    near_duplicate: bool = False
    similarity_threshold: float = 0.92
    min_line_length_for_fuzzy: int = 12


@dataclass
class TrimConfig:
    max_string_length: int = 120
    keep_string_prefix: int = 60
    max_json_depth: int = 4
    max_list_items: int = 20
    max_table_rows: int = 12
    strip_log_metadata: bool = True


@dataclass
class CompressionConfig:
    model: str = "gpt-4"
    #: "auto" takes tiktoken where the model's files are at hand, "tiktoken" the same; the heuristic needs none and stays in the JVM.
    token_backend: str = "heuristic"
    #: Part of the tokens that may remain before the summarizer is used; None never uses it.
    target_ratio: float | None = None
    enable_noise_filter: bool = True
    enable_redundancy_filter: bool = True
    enable_detail_trim: bool = True
    enable_pattern_remover: bool = True
    noise: NoiseConfig = field(default_factory=NoiseConfig)
    redundancy: RedundancyConfig = field(default_factory=RedundancyConfig)
    trim: TrimConfig = field(default_factory=TrimConfig)

    @classmethod
    def aggressive(cls) -> CompressionConfig:
        """Small output first."""
        return cls(
            target_ratio=0.3,
            noise=NoiseConfig(drop_log_levels=True),
            redundancy=RedundancyConfig(near_duplicate=True),
            trim=TrimConfig(max_string_length=80, keep_string_prefix=40, max_list_items=10, max_table_rows=6),
        )

    @classmethod
    def conservative(cls) -> CompressionConfig:
        """Detail first; still summarizes what stays above 70 % of its tokens."""
        return cls(target_ratio=0.7, trim=TrimConfig(max_string_length=240, keep_string_prefix=160, max_list_items=40, max_table_rows=25))


PRESETS = {"default": CompressionConfig, "aggressive": CompressionConfig.aggressive, "conservative": CompressionConfig.conservative}
