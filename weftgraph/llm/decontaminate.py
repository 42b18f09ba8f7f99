"""Benchmark decontamination: CGK embeddings and bit-sampling LSH over item-sized windows, then exact edit verification.

Texts are read as words (letters, digits and underscores, lower-cased; a character each in scripts without spaces). A document is contaminated by an item if the word
edit distance between the item and some stretch of the document is at most `edits` times the item's words, rounded down: items of fewer than five words must
stand in it verbatim. That holds for items of every length; who doesn't want short ones to count leaves them out of the benchmark.

The CGK walk reads a word sequence from a start: at step j it emits the current word and moves on if a random bit of (j,
word) says so. Sequences a few edits apart so give strings of small Hamming distance. A hit at word o of an item and word p of a document proposes the
item-sized window that starts at p - o. A window with fewer of the item's words than its distance demands is dropped, which loses nothing; the others are verified.

How far a walk goes follows from the item's length:

- Items of `long_words` or more: `walks` independent walks of `steps`, and from each `samples` random sets of `bits` positions are the keys of hash tables. Items
  are entered from each of their words, and every word of every document that the benchmark has is looked up, so an edit near an item's start costs no recall.
- Shorter ones have too few words for that: most samples would end behind them. A stretch within the distance leaves at least one of an item's e + 1 equal pieces unchanged
  (e its edits). Walks that take no more steps than a piece has words can't leave it, so their strings are at Hamming distance 0 there, and the sample of all positions of all
  walks, entered from the start of each piece, proposes every such stretch.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shared import slices, text_or_empty

#: Scripts that are written without spaces: Thai, Lao, Burmese, Khmer, kana and Han.
SPACELESS = "\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ece\u0edc-\u0edf\u1000-\u103f\u1050-\u108f\u1780-\u17d3\u3005-\u3007\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
ASCII_WORD = re.compile(r"\w+")
WORD = re.compile(rf"[{SPACELESS}]|[^\W{SPACELESS}]+")
#: Most steps of the walks of short items.
WIDEST = 5


def words_of(text: str) -> list[str]:
    return (ASCII_WORD if text.isascii() else WORD).findall(text.lower())


def closest(item: list[int], stretch: list[int], most: int) -> tuple[int, int, int]:
    """Least edit distance of item to any part of stretch, that part's start and end; distance most + 1 if it is above most."""
    n = len(stretch)
    row, begun = [0] * (n + 1), list(range(n + 1))
    for i, w in enumerate(item, 1):
        last, last_begun = row, begun
        row, begun = [i], [0]
        for j in range(1, n + 1):
            best, b = last[j - 1] + (w != stretch[j - 1] or w == 0), last_begun[j - 1]
            if last[j] + 1 < best:
                best, b = last[j] + 1, last_begun[j]
            if row[j - 1] + 1 < best:
                best, b = row[j - 1] + 1, begun[j - 1]
            row.append(best)
            begun.append(b)
        if min(row) > most:
            return most + 1, 0, 0
    end = min(range(n + 1), key=row.__getitem__)
    return row[end], begun[end], end


class Index:
    """Hash tables over the CGK embeddings of a block of items."""

    def __init__(self, items: list[tuple[object, str]], edits: float, long_words: int, walks: int, steps: int, samples: int, bits: int, seed: int):
        self.steps = steps
        self.items = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if w]
        self.vocabulary = {w: n for n, w in enumerate(dict.fromkeys(w for _, ws in self.items for w in ws), 1)}
        self.tokens = [[self.vocabulary[w] for w in ws] for _, ws in self.items]
        self.sets = [frozenset(t) for t in self.tokens]
        self.most = [int(edits * len(t) + 1e-9) for t in self.tokens]
        rng = np.random.default_rng(seed)
        end = len(self.vocabulary) + 1  # stands after an item's last word, and in no document
        self.moves = rng.integers(0, 2, (walks, max(steps, WIDEST), end + 1), dtype=np.int32)
        self.picks = [[np.sort(rng.choice(steps, bits, replace=False)).tolist() for _ in range(samples)] for _ in range(walks)]
        self.mix = rng.integers(1, 1 << 62, (walks, samples, bits), dtype=np.int64).astype(np.uint64) | np.uint64(1)
        self.flat_mix = rng.integers(1, 1 << 62, (walks, WIDEST), dtype=np.int64).astype(np.uint64) | np.uint64(1)
        flat = np.array([w for t in self.tokens for w in [*t, *[end] * steps]], np.int32)
        firsts = np.cumsum([0, *[len(t) + steps for t in self.tokens]])
        short = defaultdict(list)
        for k, t in enumerate(self.tokens):
            parts = self.most[k] + 1
            if len(t) < long_words:
                short[min(len(t) // parts, WIDEST)] += [(k, len(t) * i // parts, firsts[k] + len(t) * i // parts) for i in range(parts)]
        #: for each number of steps of short items: a filter on the top bits of a key, the keys in order, and the (item, offset) of each
        self.short = []
        for width, rows in sorted(short.items()):
            rows = np.array(rows, np.int64)
            keys = self._whole(flat, rows[:, 2], width)
            order = np.argsort(keys, kind="stable")
            self.short.append((width, _filter(keys), keys[order], rows[order, :2]))
        places = [(k, o, firsts[k] + o) for k, t in enumerate(self.tokens) if len(t) >= long_words for o in range(len(t))]
        self.places = np.array(places, np.int64).reshape(-1, 3)
        #: for each walk and sample of long items: filter, keys in order, and their places
        self.tables = []
        for walk in range(walks) if places else ():
            strings = self._embed(flat, self.places[:, 2], walk, steps)
            row = []
            for s in range(samples):
                keys = self._keys(strings, walk, s)
                order = np.argsort(keys, kind="stable")
                row.append((_filter(keys), keys[order], order))
            self.tables.append(row)

    def _embed(self, flat: np.ndarray, starts: np.ndarray, walk: int, steps: int) -> list[np.ndarray]:
        at, out = starts.astype(np.int32), []
        for j in range(steps):
            out.append(flat[at])
            at = at + self.moves[walk, j][out[j]]
        return out

    def _keys(self, strings: list[np.ndarray], walk: int, sample: int) -> np.ndarray:
        key = np.zeros(len(strings[0]), np.uint64)
        for i, p in enumerate(self.picks[walk][sample]):
            key = key * np.uint64(0x9E3779B97F4A7C15) + strings[p].astype(np.uint64) * self.mix[walk, sample, i]
        return key ^ key >> np.uint64(29)

    def _whole(self, flat: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        """The key of all positions of all walks of width steps."""
        key = np.zeros(len(starts), np.uint64)
        for walk in range(len(self.moves)):
            for i, x in enumerate(self._embed(flat, starts, walk, width)):
                key = key * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64) * self.flat_mix[walk, i]
        return key ^ key >> np.uint64(29)

    def _windows(self, docs: list[np.ndarray]) -> dict[tuple[int, int], set[int]]:
        """Proposed first words of windows for each (text, item)."""
        found: dict[tuple[int, int], set[int]] = defaultdict(set)
        pad = np.zeros(max(self.steps, WIDEST) + 1, np.int32)
        flat = np.concatenate([x for ids in docs for x in (ids, pad)])
        begins = np.cumsum([0, *[len(ids) + len(pad) for ids in docs]])
        starts = np.flatnonzero(flat)

        def propose(at: np.ndarray, mine: np.ndarray, hit: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> None:
            some = np.flatnonzero(hit[mine >> np.uint64(44)])
            first, last = np.searchsorted(keys, mine[some]), np.searchsorted(keys, mine[some], "right")
            some, first, last = some[last > first], first[last > first], last[last > first]
            of = np.searchsorted(begins, at[some], "right") - 1
            for d, w, a, z in zip(of.tolist(), (at[some] - begins[of]).tolist(), first.tolist(), last.tolist()):
                for k, o in rows[a:z].tolist():
                    found[d, k].add(w - o)

        for lo in range(0, len(starts), 1 << 16):
            part = starts[lo : lo + (1 << 16)]
            for width, *table in self.short:
                propose(part, self._whole(flat, part, width), *table)
            for walk, row in enumerate(self.tables):
                strings = self._embed(flat, part, walk, self.steps)
                for s, (hit, keys, order) in enumerate(row):
                    propose(part, self._keys(strings, walk, s), hit, keys, _Rows(self.places, order))
        return found

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item number, distance, first word, words) of the closest stretch, for each text and item within the distance."""
        out, token, docs = [], self.vocabulary.get, []
        for t in texts:
            words = words_of(t)
            docs.append(np.fromiter(map(token, words, repeat(0)), np.int32, len(words)))
        for (d, k), starts in self._windows(docs).items() if docs and self.items else ():
            item, most, shared, best = self.tokens[k], self.most[k], self.sets[k], None
            for s in sorted(starts):
                lo = max(0, s - most)
                stretch = docs[d][lo : max(0, s + len(item) + 2 * most)].tolist()
                if sum(map(shared.__contains__, stretch)) < len(item) - most:
                    continue
                distance, a, z = closest(item, stretch, most)
                if distance <= most and (best is None or distance < best[0]):
                    best = (distance, lo + a, z - a)
                    if not distance:
                        break
            if best:
                out.append((d, k, *best))
        return sorted(out)


class _Rows:
    """Item and offset of the places in an order, looked up where they are asked for."""

    def __init__(self, places: np.ndarray, order: np.ndarray):
        self.places, self.order = places, order

    def __getitem__(self, part: slice) -> np.ndarray:
        return self.places[self.order[part], :2]


def _filter(keys: np.ndarray) -> np.ndarray:
    hit = np.zeros(1 << 20, bool)
    hit[keys >> np.uint64(44)] = True
    return hit


class Block:
    """Items of a block, at most block_bytes of text. Their index is built where it is used, once for each worker process, not on the driver."""

    def __init__(self, items: list[tuple[object, str]], settings: dict):
        self.items, self.settings = items, settings

    @cached_property
    def index(self) -> Index:
        return Index(self.items, **self.settings)


def _blocks(benchmark: DataFrame, item_id: str, text_col: str, block_bytes: int, settings: dict) -> Iterator[Block]:
    block, size = [], 0
    for r in benchmark.select(F.col(item_id).alias("i"), text_or_empty(text_col).alias("t")).orderBy("i", "t").toLocalIterator():
        if block and size + len(r["t"]) > block_bytes:
            yield Block(block, settings)
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    if block:
        yield Block(block, settings)


OPTIONS = {"edits": 0.2, "long_words": 12, "walks": 3, "steps": 14, "samples": 2, "bits": 6, "seed": 5}


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 8 << 20, **options) -> DataFrame:
    """One row per document row and item that contaminates it: the id column, the item column, distance, start_word, n_words, item_words.

    Items go out in blocks of block_bytes of text (or of one item that is longer), a broadcast of known size, and each block is held against all
    documents in one pass without a shuffle. Items without words, and documents without any, match nothing. Null texts are empty;
    repeated items and rows give a row each; extra columns aren't read; without documents or items there are no rows.
    """
    spark, settings = docs.sparkSession, OPTIONS | options
    id_type, item_type = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_id]
    item_field = benchmark.schema[item_id].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_item = to_arrow_type(item_field)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    schema = f"id {id_type}, item {item_type}, distance bigint, start_word bigint, n_words bigint, item_words bigint"
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, item_id, item_text, block_bytes, settings):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            index = shared.value.index
            for b in slices(batches):
                found = index.search(b.column("text").to_pylist())
                ids = b.column("id").take(pa.array([f[0] for f in found], pa.int64()))
                items = pa.array([index.items[f[1]][0] for f in found], arrow_item)
                rest = [pa.array([f[i] for f in found], pa.int64()) for i in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays([ids, items, *rest, pa.array([len(index.tokens[f[1]]) for f in found], pa.int64())], ["id", "item", "distance", "start_word", "n_words", "item_words"])

        out = out.union(rows.mapInArrow(run, schema))
    return out.withColumnsRenamed({"id": id_col, "item": item_id})


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 8 << 20, **options) -> DataFrame:
    """docs without the rows that an item contaminates (see contaminated); columns as they were, no shuffle."""
    settings = OPTIONS | options
    for block in _blocks(benchmark, item_id, item_text, block_bytes, settings):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for b in slices(batches, text_col):
                bad = {f[0] for f in shared.value.index.search([t or "" for t in b.column(text_col).to_pylist()])}
                yield b.take(pa.array([i for i in range(len(b)) if i not in bad], pa.int64()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
