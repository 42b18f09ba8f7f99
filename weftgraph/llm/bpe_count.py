"""Token counts by heap-and-linked-list byte-pair merging.

A piece of text starts as a linked list of its bytes. A heap holds the adjacent pairs by merge rank; the lowest is
popped, its two symbols become one, and the new neighbours are pushed. Every merge takes one symbol away, so the count
is the number of bytes less the number of merges: no token identifier is ever made.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shared import text_or_empty
from weftgraph.llm.tokens import default_vocabulary, library_tokenizer

#: Characters whose classes are the same in every regex engine's Unicode version (checked over all code points by a
#: test); a text with any other is split by the tokenizers library's own splitter.
STABLE = r"\0-՗֑-ۿऀ-୿฀-໿Ḁ-⁯₠-⃀℀-➿　-鿿가-힣\U0001f300-\U0001f64f"
UNSTABLE = re.compile(f"[^{STABLE}]")
ASCII_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


def count_merges(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Merges that byte-pair encoding makes in a list of symbols. ranks: (left, right) to (rank, merged symbol)."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r[0], i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1])))]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if j >= n or symbols[i] != left or symbols[j] != right:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = ranks[left, right][1], -1
        merges += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if r := ranks.get((symbols[i], symbols[k])):
                heapq.heappush(heap, (r[0], i, symbols[i], symbols[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))):
            heapq.heappush(heap, (r[0], h, symbols[h], symbols[i]))
    return merges


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: fixed values of the file format."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Counter:
    """Counts tokens of texts; counts of short pieces are kept in a bounded table."""

    def __init__(self, path: str, kept_pieces: int = 400_000):
        import regex
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.splitter = library_tokenizer(path).pre_tokenizer
        special = [t["content"] for t in vocabulary["added_tokens"] if t["special"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        letters = byte_letters()
        symbol = {c: i for i, c in enumerate(letters)}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(vocabulary["model"]["merges"]):
            merged = symbol.setdefault(a + b, len(symbol))
            self.ranks.setdefault((symbol[a], symbol[b]), (rank, merged))
        counter, ranks = self, self.ranks

        class Pieces(dict):
            def __missing__(self, piece: str) -> int:
                raw = list(piece.encode("utf-8", "surrogatepass"))
                n = len(raw) - count_merges(raw, ranks)
                if len(piece) <= 64:
                    if len(self) >= counter.kept_pieces:
                        self.clear()
                    self[piece] = n
                return n

        self.kept_pieces, self.pieces = kept_pieces, Pieces()

    def split(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII_PATTERN.findall(text)
        if UNSTABLE.search(text):
            return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def __call__(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        look = self.pieces.__getitem__
        return len(parts) - 1 + sum(sum(map(look, self.split(p))) for p in parts if p)


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = 1024) -> DataFrame:
    """One row per row of docs, in one pass without a shuffle: the id column, n_bytes, n_tokens, over_limit.

    Counts are those of the tokenizers library for the vocabulary, special strings in a text counting one token each.
    A null text is empty and has no tokens. Repeated rows are counted each; extra columns are not read.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        count = counter(path)
        for b in batches:
            n = [count(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
