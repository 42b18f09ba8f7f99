"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shared import slices, store, text_or_empty

#: First code points of script ranges, in order: fixed values of the Unicode blocks. Anything below the first is Latin.
SCRIPTS = [
    (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "asian"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"),
    (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "other"), (0x20000, "han"),
]
STARTS = [s for s, _ in SCRIPTS]
WORD = re.compile(r"[^\W\d_]+")


def script_of(char: str) -> str:
    i = bisect_right(STARTS, ord(char)) - 1
    return "latin" if i < 0 else SCRIPTS[i][1]


def pieces(word: str, order: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + order] for i in range(len(padded) - order + 1)] or [padded]


@dataclass
class Model:
    """langs; log-probabilities of words and of character pieces, a row each and a column a language; the scripts of each language.

    Scores of words seen lately are kept, at most `kept` of them.
    """

    langs: list[str]
    words: dict[str, int]
    word_rows: np.ndarray
    grams: dict[str, int]
    gram_rows: np.ndarray  # the last row is for pieces that aren't in grams
    scripts: dict[str, list[bool]]
    order: int
    most: float
    penalty: float
    kept: int = 100_000
    known: dict[str, int] = field(default_factory=dict, repr=False)
    scores: np.ndarray | None = field(default=None, repr=False)

    def score(self, words: list[str]) -> np.ndarray:
        """A row for each word, a column for each language: the best 0 and none under -most; -most also for a language that doesn't use the word's script."""
        out = np.empty((len(words), len(self.langs)))
        whole = [self.words.get(w, -1) for w in words]
        unseen = len(self.gram_rows) - 1
        at, ids, starts, look = [], [], [], self.grams.get
        for i, (w, k) in enumerate(zip(words, whole)):
            if k >= 0:
                out[i] = self.word_rows[k]
            else:
                at.append(i)
                starts.append(len(ids))
                ids += [look(g, unseen) for g in pieces(w, self.order)]
        if at:
            out[at] = np.add.reduceat(self.gram_rows[ids], starts, axis=0)
        for i, w in enumerate(words):
            allowed = self.scripts.get("latin" if w[0] < "\u0370" else script_of(w[0]))
            if allowed is not None and any(allowed) and not all(allowed):
                out[i] = np.where(allowed, out[i], -np.inf)
        return np.maximum(out - out.max(axis=1, keepdims=True), -self.most)

    def rows(self, words: list[str]) -> np.ndarray:
        if self.scores is None or len(self.known) > self.kept:
            self.known, self.scores = {}, np.empty((1024, len(self.langs)))
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            n = len(known)
            while len(self.scores) < n + len(new):
                self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
            self.scores[n : n + len(new)] = self.score(new)
            known.update(zip(new, range(n, n + len(new))))
        return self.scores[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def spans(self, words: list[str]) -> np.ndarray:
        """The index of each word's language on the best path, a switch costing penalty.

        Where no other language gains more than half a penalty over the best single one on any stretch, no switch can pay: k stretches
        in other languages gain k halves and cost k - 1 switches at least, and one over all words gains nothing. That is
        tested first, on whole columns; the path is then constant, as the search would find.
        """
        s = self.rows(words)
        best = int(s.sum(axis=0).argmax())
        gain = np.cumsum(np.vstack([np.zeros(s.shape[1]), s - s[:, [best]]]), axis=0)
        if (gain - np.minimum.accumulate(gain, axis=0)).max() <= self.penalty / 2:
            return np.full(len(words), best)
        return viterbi(s, self.penalty)

    def predict(self, text: str) -> tuple[str, float]:
        """The language with the most letters and its share of all letters; `und` and 0 if there is no letter."""
        words = WORD.findall(text.lower())
        if not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        letters = np.bincount(self.spans(words), weights=[len(w) for w in words], minlength=len(self.langs))
        top = int(letters.argmax())
        return self.langs[top], float(letters[top] / letters.sum())


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best path; only the values are kept on the way, since they say from where each state was reached."""
    rows = scores.tolist()
    values = [rows[0]]
    for row in rows[1:]:
        value = values[-1]
        jump = max(value) - penalty
        values.append([(v if v >= jump else jump) + x for v, x in zip(value, row)])
    state = max(range(len(rows[0])), key=values[-1].__getitem__)
    path = [state]
    for value in reversed(values[:-1]):
        top = max(value)
        if value[state] < top - penalty:
            state = value.index(top)
        path.append(state)
    return np.array(path[::-1])


def train(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    sample_rows: int = 6_000,
    least: int = 2,
    order: int = 3,
    most: float = 5.0,
    penalty: float = 20.0,
) -> Model:
    """Fit on about sample_rows labelled rows (all if there are fewer), chosen by a hash of their id, whole texts.

    Words and character pieces are counted on the executors; the driver gets the pieces, and the words seen at least `least` times in the sample (a
    word seen once says less than its pieces do). sample_rows bounds both.
    Rows with a null text or language don't teach. No such rows: a model without languages.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    total = rows.count()
    share = int(min(1.0, sample_rows / max(1, total)) * (1 << 30))
    rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share)

    def count(batches):
        tables = {kind: defaultdict(Counter) for kind in ("word", "gram", "script")}

        def out():
            for kind, by_lang in tables.items():
                for lang, counts in by_lang.items():
                    n = len(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), pa.array([lang] * n, pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["kind", "lang", "item", "n"])
                by_lang.clear()

        for b in slices(batches):
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                grams, scripts, found = tables["gram"][lang], tables["script"][lang], Counter(WORD.findall(text.lower()))
                tables["word"][lang].update(found)
                for w, n in found.items():
                    scripts[script_of(w[0])] += n
                    for g in pieces(w, order):
                        grams[g] += n
            if sum(map(len, tables["word"].values())) > 100_000:
                yield from out()
        yield from out()

    counts = rows.select("text", "lang").mapInArrow(count, "kind string, lang string, item string, n bigint").groupBy("kind", "lang", "item").agg(F.sum("n").alias("n"))
    by_item = counts.groupBy("kind", "item").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("lang", "n"))).alias("by"))
    by_item, _ = store(by_item, "language-counts")
    tables: dict[str, dict[str, dict[str, int]]] = {}
    for kind in ("word", "gram", "script"):
        seen = by_item.where(F.col("kind") == kind).where(F.col("n") >= (least if kind == "word" else 1)).orderBy("item")
        found = seen.select("item", "by").toArrow()  # from sample_rows texts
        tables[kind] = {i: {x["lang"]: x["n"] for x in by} for i, by in zip(found["item"].to_pylist(), found["by"].to_pylist())}
    langs = sorted({lang for by in tables["gram"].values() for lang in by})

    def logs(table: dict[str, dict[str, int]], add: float) -> tuple[dict[str, int], np.ndarray]:
        """The number of each item and its row; a last row for what isn't in the table."""
        counts = np.array([[by.get(lang, 0) for lang in langs] for by in table.values()] + [[0] * len(langs)], float).reshape(-1, len(langs)) + add
        return dict(zip(table, range(len(table)))), np.log(counts / counts.sum(axis=0))

    if not langs:
        return Model([], {}, np.zeros((1, 0)), {}, np.zeros((1, 0)), {}, order, most, penalty)
    words, word_rows = logs(tables["word"], 0.5)
    grams, gram_rows = logs(tables["gram"], 0.5)
    uses = {lang: sum(by.get(lang, 0) for by in tables["script"].values()) for lang in langs}
    scripts = {k: [by.get(lang, 0) >= 0.01 * uses[lang] for lang in langs] for k, by in tables["script"].items()}
    return Model(langs, words, word_rows, grams, gram_rows, scripts, order, most, penalty)


def identify(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "lang_") -> DataFrame:
    """docs with columns {prefix}pred and {prefix}score, in one pass without a shuffle; other columns as they were.

    A null text, one without letters and every text under a model without languages get `und` and 0. Columns of those names are replaced.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)  # what sample_rows texts hold
    known = bool(model.langs)
    names = (f"{prefix}pred", f"{prefix}score")
    rows = docs.drop(*names)
    schema = StructType([*rows.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])

    def run(batches):
        m = shared.value
        for b in slices(batches, text_col):
            found = [m.predict(t) if t and known else ("und", 0.0) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*b.schema.names, *names])

    return rows.mapInArrow(run, schema)


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id column, lang, start, end, words): the spans of one language in each text, as character offsets of the lower-cased text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = dict(docs.dtypes)[id_col]

    def run(batches):
        m = shared.value
        for b in slices(batches):
            rows = []
            for i, text in enumerate(b.column("text").to_pylist()):
                found = list(WORD.finditer(text.lower())) if m.langs else []
                path = m.spans([x.group() for x in found]) if found else []
                at = 0
                for k in range(1, len(found) + 1):
                    if k == len(found) or path[k] != path[at]:
                        rows.append((i, m.langs[path[at]], found[at].start(), found[k - 1].end(), k - at))
                        at = k
            ids = b.column("id").take(pa.array([r[0] for r in rows], pa.int64()))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(kinds)]], ["id", "lang", "start", "end", "words"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, lang string, start bigint, end bigint, words bigint").withColumnRenamed("id", id_col)
