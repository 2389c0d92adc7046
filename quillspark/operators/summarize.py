"""Summaries of items by a pluggable summariser, with an extractive one built in."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import wordings


def extract(text: str, most: int = 320) -> str:
    """The first sentences of a text that fit."""
    out = ""
    for sentence in re.split(r"(?<=[.!?])\s+", " ".join(text.split())):
        if out and len(out) + 1 + len(sentence) > most:
            break
        out = f"{out} {sentence}".strip()
    return out if len(out) <= most else out[: most - 3].rsplit(" ", 1)[0].rstrip(" .,;:") + "..."


def resolve(providers: dict[str, Callable[[str], str] | None], asked: str = "auto") -> Callable[[str], str]:
    """The provider that is asked for, or for ``auto`` the first that is configured (not None); the extract where none is."""
    if asked != "auto":
        if providers.get(asked) is None:
            raise ValueError(f"no summary provider named {asked} is configured")
        return providers[asked]
    return next((p for p in providers.values() if p is not None), extract)


def summarize(items: DataFrame, summariser: Callable[[str], str] | None = None, *, id_col: str = "id", text_col: str = "content", fallback_col: str = "summary", allowed: Column | None = None) -> DataFrame:
    """id, status, text, error: ``ok`` with a summary, or ``error`` with an empty text and what went wrong.

    The item's own text (``fallback_col``) serves only where its page gave no content. A summariser that fails makes that
    item an error, never the job; rows that are not ``allowed``, such as those without a public address, are errors too.
    """
    id_type = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content, fallback, may in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
                text = content or fallback or ""
                try:
                    if not may:
                        raise ValueError(wordings.NO_PUBLIC_SOURCE)
                    if not text:
                        raise ValueError("nothing to summarise")
                    out.append(("ok", (summariser or extract)(text), None))
                except Exception as e:  # noqa: BLE001  a provider may fail in any way
                    out.append(("error", "", str(e) or type(e).__name__))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([o[k] for o in out], pa.string()) for k in range(3)]], names=["id", "status", "text", "error"])

    may = F.coalesce(allowed, F.lit(False)) if allowed is not None else F.lit(True)
    return items.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(fallback_col).alias("f"), may.alias("may")).mapInArrow(run, f"id {id_type}, status string, text string, error string").withColumnRenamed("id", id_col)
