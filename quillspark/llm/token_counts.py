"""Token counts by heap-and-linked-list byte-pair merging.

Each pre-token starts as a doubly linked list of single-byte symbols. A heap holds the adjacent pairs
that can merge, by (rank, position); the lowest is popped again and again, stale entries are skipped, and
the two neighbours of a merged pair are pushed. A pre-token's count is its initial symbols minus its
merges: no identifiers are ever made.

Equal pre-tokens have equal counts, so each task keeps a bounded memo of them. There is no shuffle at all:
the operator is one pass over the texts, in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern that the format's "ByteLevel" pre-tokenizer stands for (fixed value of the format).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of each of the memo's two generations; the older one goes when the younger is full.
MEMO_ENTRIES = 400_000


def byte_symbols() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from code point 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, nxt = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(nxt)
            nxt += 1
    return [table[b] for b in range(256)]


def pre_tokenizer(spec: dict | None) -> tuple[str | None, bool]:
    """The splitting pattern (None: texts stay whole) and whether a space is put before texts, as a file states them."""
    spec = spec or {"type": "ByteLevel"}
    if spec["type"] != "ByteLevel":
        raise ValueError(f"not a byte-level pre-tokenizer: {spec['type']}")
    return BYTE_LEVEL_PATTERN if spec.get("use_regex", True) else None, spec.get("add_prefix_space", False)


class BytePairCounter:
    """Counts tokens of texts for one byte-level BPE vocabulary file (the ``tokenizers`` JSON format).

    Files that ask for more than byte-level pre-tokenizing and plain merging are refused with a ValueError.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        asked = [k for k in ("normalizer",) if spec.get(k)] + [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback") if model.get(k)]
        asked += [t["content"] for t in spec.get("added_tokens", []) if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
        if asked:
            raise ValueError(f"not supported in a vocabulary file: {', '.join(asked)}")
        self.symbols = byte_symbols()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.vocab = model["vocab"] if model.get("ignore_merges") else ()
        pattern, self.lead = pre_tokenizer(spec.get("pre_tokenizer"))
        self.pieces = regex.compile(pattern).findall if pattern else lambda text: [text] if text else []
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.memo: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def merge_count(self, piece: str) -> int:
        """Tokens of one pre-token: symbols minus merges."""
        syms = [self.symbols[b] for b in piece.encode("utf-8", "replace")]
        n = len(syms)
        if n < 2:
            return n
        ranks = self.ranks
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, syms[i], syms[i + 1]) for i in range(n - 1) if (r := ranks.get((syms[i], syms[i + 1]))) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heappop(heap)
            j = nxt[i]
            if j < 0 or syms[i] != left or syms[j] != right:
                continue  # one of the two symbols has been merged since
            syms[i], syms[j] = left + right, ""
            merges += 1
            k = nxt[i] = nxt[j]
            if k >= 0:
                prev[k] = i
                if (r := ranks.get((syms[i], syms[k]))) is not None:
                    heappush(heap, (r, i, syms[i], syms[k]))
            if (h := prev[i]) >= 0 and (r := ranks.get((syms[h], syms[i]))) is not None:
                heappush(heap, (r, h, syms[h], syms[i]))
        return n - merges

    def _piece(self, piece: str) -> int:
        if (found := self.memo.get(piece)) is None:
            if (found := self.older.get(piece)) is None:
                found = self.merge_count(piece)
            if len(self.memo) >= MEMO_ENTRIES:
                self.older, self.memo = self.memo, {}
            if len(piece) <= 64:
                self.memo[piece] = found
        return found

    def _plain(self, text: str) -> int:
        return sum(map(self._piece, self.pieces(f" {text}" if self.lead and text and not text[0].isspace() else text)))

    def count(self, text: str | None) -> int:
        """Tokens of a whole text. A special token's string counts as one token, as the library's default has it."""
        if not text:
            return 0
        if self.special is None:
            return self._plain(text)
        total = at = 0
        for m in self.special.finditer(text):
            total += 1 + self._plain(text[at : m.start()])
            at = m.end()
        return total + self._plain(text[at:] if at else text)


_COUNTERS: dict[str, BytePairCounter] = {}


def _counter(path: str) -> BytePairCounter:
    """One counter for each worker process and vocabulary."""
    if path not in _COUNTERS:
        _COUNTERS[path] = BytePairCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc id, n_bytes, n_tokens and over_limit (n_tokens > limit) for each row of ``docs``.

    Null and empty texts count 0 bytes and 0 tokens. Repeated rows and ids give one row each. Columns other
    than the two named are ignored. ``tokenizer_path`` must be readable on the executors.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer_path).count
        for batch in batches:
            n = pa.array([count(t.as_py()) for t in batch.column(1)], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], names=["id", "n_bytes", "n_tokens"])

    lean = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    counted = lean.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
