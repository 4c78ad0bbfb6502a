"""Toxicity by class-conditional Kneser-Ney models.

Two models give the likelihood of a word's letters, toxic and ordinary, each letter after up to nine before it in its
word. Full contexts are counted by class; below them both classes share one Kneser-Ney backoff (counts of distinct
continuations over both classes), so a rare expression that neither class has seen weighs the same in both. The
length-normalised log-likelihoods are compared over the whole text and over its windows of 16 words, of which the most toxic
counts, so that one insult isn't diluted by a long text. A logistic curve, fitted on texts that the models it looks at have not
seen, turns both differences into a score.

The difference of the two log-likelihoods of a letter needs one number for each gram seen and one for each context
seen: where a class lacks the gram, its probability is a backoff weight times the shared probability, and the shared factor is the same
in both. So the model is two sorted arrays, a few megabytes, bounded by the training sample (TOXIC and ORDINARY rows at most).

Rows: null and empty texts and texts without letters have no evidence and get the score of none; rows without a usable
label are not learnt from; repeated rows score alike; an empty table gives an empty one. A doc_id labelled twice counts as toxic if either says so.
Without labels of both classes every score is 0.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustline.llm.common import U, map_arrow, mix, pieces

#: The most labelled rows to learn from, by class, in the order of a hash of doc_id.
TOXIC, ORDINARY = 700, 1400
ORDER, WINDOW, DISCOUNT = 9, 16, 0.75
FEATURES = ("evidence", "worst_window", "worst_word", "worst_words", "length")
LETTERS = re.compile(r"[^\W\d_]+")
_B = [U(pow(0x9E3779B97F4A7C15, d, 2**64)) for d in range(ORDER + 1)]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes [d, i] of the d + 1 letters that end at i, of all words with marks of begin and end; how many letters of its word stand before i, up to ORDER; the index of i's word."""
    codes = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.arange(len(codes))
    begins = codes == 2
    word = np.cumsum(begins) - 1
    before = np.minimum(at - at[begins][word], ORDER)
    letter = mix(codes.astype(U) + U(0x632BE59BD9B4E019))
    hashes = np.zeros((ORDER + 1, len(codes)), U)
    with np.errstate(over="ignore"):
        run = letter.copy()
        hashes[0] = run + U(1)
        for d in range(1, ORDER + 1):
            run[d:] += letter[:-d] * _B[d]
            hashes[d] = run + U(d + 1)
    return hashes, before, word


def _shared(hashes: np.ndarray, at: np.ndarray, depth: np.ndarray, letters: int) -> np.ndarray:
    """Kneser-Ney probability, over both classes, of the gram of `depth` letters of context that ends at each place; the places are distinct grams of the order above."""
    _, first, back, n = np.unique(hashes[depth, at], return_index=True, return_inverse=True, return_counts=True)
    at, depth = at[first], depth[first]
    context = np.where(depth > 0, hashes[depth - 1, at - 1], U(0))
    _, c = np.unique(context, return_inverse=True)
    total, kinds = np.bincount(c, n), np.bincount(c)
    lower = np.full(len(at), 1.0 / letters)
    more = depth > 0
    if more.any():
        lower[more] = _shared(hashes, at[more], depth[more] - 1, letters)
    return ((n - DISCOUNT) / total[c] + DISCOUNT * kinds[c] / total[c] * lower)[back]


class Model:
    """Log-likelihood of toxic less that of ordinary, by gram, and by context for grams that are not there."""

    def __init__(self, words: list[str], toxic: np.ndarray, ordinary: np.ndarray):
        hashes, before, word = grams(words)
        at = np.flatnonzero(before > 0)
        depth = before[at]
        gram, first, back = np.unique(hashes[depth, at], return_index=True, return_inverse=True)
        counts = [np.bincount(back, n[word[at]]) for n in (toxic, ordinary)]
        at, depth = at[first], depth[first]
        lower = _shared(hashes, at, depth - 1, letters=max(2, len(np.unique(hashes[0]))))
        context, c = np.unique(hashes[depth - 1, at - 1], return_inverse=True)
        logs, rests = [], []
        for n in counts:
            total, kinds = np.bincount(c, n), np.bincount(c, n > 0)
            rest = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            p = np.maximum(n - DISCOUNT, 0) / np.maximum(total[c], 1) + rest[c] * lower
            logs.append(np.log(p))
            rests.append(np.log(rest))
        self.gram, self.by_gram = gram, (logs[0] - logs[1]).astype(np.float32)
        self.context, self.by_context = context, (rests[0] - rests[1]).astype(np.float32)

    def words(self, words: list[str]) -> np.ndarray:
        """The difference for each word, over its letters and its end."""
        if not words:
            return np.zeros(0)
        hashes, before, word = grams(words)
        at = np.flatnonzero(before > 0)
        g, c = hashes[before[at], at], hashes[before[at] - 1, at - 1]
        i = np.minimum(np.searchsorted(self.gram, g), len(self.gram) - 1)
        k = np.minimum(np.searchsorted(self.context, c), len(self.context) - 1)
        found = np.where(self.gram[i] == g, self.by_gram[i], np.where(self.context[k] == c, self.by_context[k], np.float32(0)))
        return np.bincount(word[at], found, len(words))


class Reader:
    """Evidence of texts by one model; words and their values are remembered up to a fixed number."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """For each text: normalised difference, that of the most toxic window, of its most toxic word, the mean of its five most toxic ones (each word once), and log(1 + words)."""
        split = [LETTERS.findall((t or "").lower()) for t in texts]
        if len(self.known) > 400_000:
            self.known.clear()
        new = list({w for ws in split for w in ws} - self.known.keys())
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            self.known.update(zip(part, self.model.words(part).tolist()))
        out = np.zeros((len(texts), len(FEATURES)))
        for i, ws in enumerate(split):
            if n := len(ws):
                total = np.concatenate(([0.0], np.cumsum(np.fromiter(map(self.known.__getitem__, ws), np.float64, n))))
                w = min(n, WINDOW)
                top = heapq.nlargest(5, map(self.known.__getitem__, set(ws)))
                out[i] = total[-1] / n, np.max(total[w:] - total[:-w]) / WINDOW, top[0], sum(top) / 5, np.log1p(n)
        return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    x, w = np.column_stack((x, np.ones(len(x)))), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(w)) * 0.05
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * len(x) * 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Scorer:
    """What goes to the executors: a model, and the curve over its evidence."""

    def __init__(self, model: Model | None, mean=None, scale=None, weights=None):
        self.model, self.mean, self.scale, self.weights = model, mean, scale, weights

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.model is None:
            return np.zeros(len(evidence))
        z = np.column_stack(((evidence - self.mean) / self.scale, np.ones(len(evidence)))) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _map(df: DataFrame, keep: list[str], made: list[tuple[str, str]], reader, columns) -> DataFrame:
    """mapInArrow over texts: reader() is made once for each task, columns(reader, texts, part) gives the made columns."""
    whole = df.select(*keep, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader()
        for batch in batches:
            for part in pieces(batch, column="__text"):
                out = columns(read, part.column("__text").to_pylist(), part)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *out], names=[*keep, *(n for n, _ in made)])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.select(*keep).schema.fields)
    return map_arrow(whole, run, kept + "".join(f", {n} {t}" for n, t in made))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC, ordinary_rows: int = ORDINARY) -> Scorer:
    """Learns from the labelled rows with the smallest hashes, so many of each class at most; folds by another bit of the hash."""
    marks = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.withColumn("h", F.xxhash64("doc_id"))
    ids = [marks.where(F.col("toxic") == y).orderBy("h", "doc_id").limit(n) for y, n in ((1, toxic_rows), (0, ordinary_rows))]
    ids = ids[0].union(ids[1]).select(F.col("doc_id"), "toxic", F.expr("cast(pmod(xxhash64(doc_id, 1), 2) AS int)").alias("fold"))
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most toxic_rows + ordinary_rows ids

    def count(_, texts, part):
        seen = Counter()
        for t, y, k in zip(texts, part.column("toxic").to_pylist(), part.column("fold").to_pylist()):
            seen.update((w, 2 * k + y) for w in LETTERS.findall((t or "").lower()))
        row = [{"w": w, "k": k, "n": n} for (w, k), n in seen.items()]
        kind = pa.list_(pa.struct([("w", pa.string()), ("k", pa.int32()), ("n", pa.int64())]))
        return [pa.array([row] + [None] * (len(texts) - 1), kind)]

    words = _map(sample, ["toxic", "fold"], [("seen", "array<struct<w: string, k: int, n: bigint>>")], lambda: None, count)
    words = words.select(F.explode("seen").alias("s")).groupBy("s.w").pivot("s.k", [0, 1, 2, 3]).agg(F.sum("s.n")).na.fill(0).toPandas()
    if not len(words):
        return Scorer(None)
    all_words, n = words["w"].tolist(), words[["0", "1", "2", "3"]].to_numpy(np.float64)

    def model(columns_toxic: list[int], columns_ordinary: list[int]) -> Model | None:
        toxic, ordinary = n[:, columns_toxic].sum(1), n[:, columns_ordinary].sum(1)
        if not toxic.any() or not ordinary.any():
            return None
        own = np.flatnonzero(toxic + ordinary > 0)
        return Model([all_words[i] for i in own], toxic[own], ordinary[own])

    both = model([1, 3], [0, 2])
    if both is None:
        return Scorer(None)
    halves = [model([3], [2]) or both, model([1], [0]) or both]  # by the fold that it has not seen
    sent = docs.sparkSession.sparkContext.broadcast(halves)

    def evidence(read, texts, part):
        fold = np.asarray(part.column("fold"))
        x = np.where((fold == 0)[:, None], read[0](texts), read[1](texts))
        return [pa.array(x[:, i]) for i in range(len(FEATURES))]

    seen = _map(sample, ["toxic", "fold"], [(f, "double") for f in FEATURES], lambda: [Reader(m) for m in sent.value], evidence).toPandas()
    x, y = seen[list(FEATURES)].to_numpy(), seen["toxic"].to_numpy(np.float64)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    return Scorer(both, mean, scale, _logistic((x - mean) / scale, y))


def score(docs: DataFrame, scorer: Scorer, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all, if none are named) with evidence, worst_window, score and predicted. The model is bounded by its training sample, so it is broadcast."""
    made = [("evidence", "double"), ("worst_window", "double"), ("score", "double"), ("predicted", "int")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in dict(made)]
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def columns(read, texts, _):
        x = read(texts) if read else np.zeros((len(texts), len(FEATURES)))
        s = sent.value.score(x)
        return [pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(s), pa.array((s >= 0.5).astype("int32"))]

    return _map(docs, keep, made, lambda: Reader(sent.value.model) if sent.value.model else None, columns)


def held_out(mod: int, rest: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scorer = fit(docs.where(~held_out(5, 0)), labels.where(~held_out(5, 0)))
    out = score(docs, scorer)
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted", "evidence", "worst_window")
