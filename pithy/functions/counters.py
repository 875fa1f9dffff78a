"""Token counters: the heuristic in the JVM, or tiktoken in Arrow functions where its files are at hand."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import types as T

from pithy.functions import text as X


@lru_cache(maxsize=8)
def encoding(model: str):
    """The encoding of a model, else cl100k_base, else None."""
    try:
        import tiktoken

        try:
            return tiktoken.encoding_for_model(model)
        except KeyError:
            return tiktoken.get_encoding("cl100k_base")
    except Exception:  # not installed, or its files can't be had
        return None


class TokenCounter:
    """Counts tokens. The backend is chosen once on the driver, so executors can't differ.

    Special strings in a text are counted as ordinary text.
    """

    def __init__(self, model: str = "gpt-4", backend: str = "heuristic"):
        self.model = model
        self.backend = "tiktoken" if backend in ("tiktoken", "auto") and encoding(model) else "heuristic"

    def __call__(self, text: Column) -> Column:
        if self.backend == "heuristic":
            return X.tokens(text)
        from pithy.operators.fold import arrow_text

        model = self.model
        return arrow_text(lambda t: len(encoding(model).encode(t, disallowed_special=())) if t else 0, T.LongType(), pa.int64())(text)
