"""URL filter: longest-match rules, then logistic regression on hashed character n-grams of host and path."""

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, rule); a rule is a host, which holds for its subdomains too, and the start of a path.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

#: Words that the labelled table builds its hosts from. Each word is shown with several of the affixes and paths, which both labels share.
BLOCKED = """
casino poker roulette jackpot slots betting bets gambling lottery viagra pharmacy pills meds steroids xxx porn sex nude adult escort webcam hookup
spam phishing malware virus crack keygen warez torrent serial hack popup banner adserver ads tracking clicks redirect payday loans replica fake doubler prize winner
""".split()
ALLOWED = """
library university museum history science weather recipes garden travel health parliament encyclopedia forum theatre gallery news trains botany writer observatory
physics music hospital school teacher maths software journal archive data cycling cooking kitchen bakery river mountain village harbour castle bridge forest island
football tennis chess knitting painting pottery photography poetry novel language dictionary grammar translation philosophy economics law court city council police
fire station post office bank insurance engineering robotics chemistry biology geology astronomy medicine nursing dentist veterinary farming fishing forestry
railway airport shipping cars bicycles walking hiking camping sailing skiing swimming running yoga dance opera cinema radio television podcast magazine bookshop
furniture clothing shoes toys games puzzles hardware tools electric solar wind water energy climate ocean wildlife birds horses dogs cats insects trees flowers
""".split()
AFFIXES = "best my online top the world blog home plus one daily site".split()
TOPS = "com net org info".split()
PATHS = "/ /index.html /en/12 /de/archive/7 /fr/404 /es/page/3 /about /item?id=5".split()


def labelled_table() -> list[tuple[str, str, bool]]:
    """(host, path, blocked): each word alone and with affixes before and behind it, by rule."""
    rows = []
    for blocked, words in ((True, BLOCKED), (False, ALLOWED)):
        for i, w in enumerate(words):
            affixes = [AFFIXES[(i + k * (1 + blocked)) % len(AFFIXES)] for k in (1, 3, 5, 7)]
            joined = [f"{a}{gap}{w}" if k % 2 else f"{w}{gap}{a}" for k, a in enumerate(affixes) for gap in ("-", "")]
            for j, name in enumerate([w, *joined]):
                rows.append((f"{name}.{TOPS[(i + j) % len(TOPS)]}", PATHS[(3 * i + j) % len(PATHS)], blocked))
    return rows


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    lengths: tuple[int, ...]
    buckets: int

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """The probability that each URL is to be blocked: one sparse matrix for all of them, times the weights."""
        row, bucket, value = features(hosts, paths, self.lengths, self.buckets)
        return 1 / (1 + np.exp(-(np.bincount(row, self.weights[bucket] * value, len(hosts)) + self.bias)))


def features(hosts: list[str], paths: list[str], lengths: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, buckets and values of the n-grams of hosts and paths, hashed apart; each part has length 1, the path weighing a tenth."""
    found = []
    for part, texts, weight in ((1, hosts, 1.0), (2, paths, 0.1)):
        padded = [f"^{t}$" for t in texts]
        chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        owner = np.repeat(np.arange(len(padded)), [len(p) for p in padded])
        rows, grams = [], []
        for n in lengths:
            if len(chars) < n:
                continue
            h = np.full(len(chars) - n + 1, part * 1000 + n, np.uint64)
            for j in range(n):
                h = (h + chars[j : len(h) + j]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            inside = owner[: len(h)] == owner[n - 1 :]
            rows.append(owner[: len(h)][inside])
            grams.append((h[inside] % np.uint64(buckets)).astype(np.int64))
        if not rows:
            continue
        keys, count = np.unique(np.concatenate(rows) * np.int64(buckets) + np.concatenate(grams), return_counts=True)
        row = keys // buckets
        norm = np.sqrt(np.bincount(row, count.astype(float) ** 2, len(texts)))
        found.append((row, keys % buckets, weight * count / norm[row]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def train(labelled: list[tuple[str, str, bool]], lengths: tuple[int, ...] = (3, 4, 5), buckets: int = 1 << 16, l2: float = 0.00001, rounds: int = 1000, rate: float = 60.0) -> Model:
    """Full-batch gradient descent on (host, path, blocked) rows, of which there are few; the same table gives the same model."""
    row, bucket, value = features([h for h, _, _ in labelled], [p for _, p, _ in labelled], lengths, buckets)
    target = np.array([float(b) for _, _, b in labelled])
    w, bias = np.zeros(buckets), 0.0
    for _ in range(rounds if labelled else 0):
        error = 1 / (1 + np.exp(-(np.bincount(row, w[bucket] * value, len(labelled)) + bias))) - target
        w -= rate * (np.bincount(bucket, error[row] * value, buckets) / len(labelled) + l2 * w)
        bias -= rate * error.mean()
    return Model(w, float(bias), lengths, buckets)


@functools.cache
def default_model() -> Model:
    return train(labelled_table())


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, of equally long ones the first; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, url_col: str = "url", rules: list[tuple[str, str]] | None = None, model: Model | None = None, threshold: float = 0.5) -> DataFrame:
    """pages with host, path, rule, score (probability of being blocked) and verdict; one pass, no shuffle.

    The verdict is the rule's where one fits, else block from threshold on. Null or a url without :// has an empty host and path, which the model
    judges like any other. Columns of those names are replaced; other columns and repeated rows stay; an empty table gives an empty result.
    """
    fitted = model or default_model()

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series(fitted.scores(host.tolist(), path.tolist()), dtype=float)

    url = F.col(url_col).cast("string")
    rows = pages.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")], host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("__rule", rule_for(F.col("host"), F.col("path"), RULES if rules is None else rules)).withColumn("score", score("host", "path"))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return rows.select(*[c for c in rows.columns if c not in ("__rule", "score")], F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), "score")
