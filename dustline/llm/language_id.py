"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

Training: segments of 64 bytes, every position labelled with its document's language, backpropagation through time over the whole
segment in both directions, Adam. Learns from about PER_LANGUAGE distinct texts of each language (never over twice as many), chosen by a hash of
the text (a bounded sample), four windows of 128 bytes of each, of which segments are drawn. Prediction: a whole text is cut into windows of 128 bytes (the last one
overlaps the one before, and only its new positions count); the network labels every position, and a document's
probabilities are the mean over its positions.

Rows: a text that is null or has no letter is `und` with score 0; texts shorter than a window are filled up with spaces
that don't count; very long texts count whole, in stretches of windows; rows without language are not learnt from; doc_id is only carried along, so it may be
null or repeat; repeated rows are predicted alike and learnt from once; an empty table
gives an empty one; with no language to learn every text is `und`. Ties go to the language that is first in order. Input columns named
lang_pred and score are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dustline.llm.common import map_arrow, pieces, tidy

PER_LANGUAGE, WINDOWS, WINDOW, HIDDEN = 400, 4, 128, 8
LETTER = re.compile(r"[^\W\d_]")


class Network:
    """States of both directions stand above each other, so weights of the recurrence are block diagonal.

    Rows of embed and recur: update gate (forward, backward), reset gate (both), candidate (both), `hidden` rows each.
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.h = languages, hidden
        self.embed = rng.normal(0, 0.3, (6 * hidden, 256))
        self.block = np.kron(np.tile(np.eye(2), (3, 1)), np.ones((hidden, hidden)))
        self.recur = rng.normal(0, 0.3, (6 * hidden, 2 * hidden)) * self.block
        self.out = rng.normal(0, 0.3, (len(languages), 2 * hidden))
        self.bias = np.zeros((len(languages), 1))

    def inputs(self, seen: np.ndarray, back: np.ndarray) -> np.ndarray:
        """The gates' inputs for the bytes that both directions read."""
        h = self.h
        x = np.take(self.embed, seen, axis=1)
        other = np.take(self.embed, back, axis=1)
        for g in (1, 3, 5):
            x[g * h : (g + 1) * h] = other[g * h : (g + 1) * h]
        return x

    def step(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        k = 2 * self.h
        g = self.recur @ state
        gates = x[: 2 * k] + g[: 2 * k]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        new = gates[k:] * g[2 * k :]
        new += x[2 * k :]
        np.tanh(new, out=new)
        after = state - new
        after *= gates[:k]
        after += new
        return after, gates, new, g[2 * k :]

    def positions(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities [language, position, window] of windows [window, position] of bytes."""
        n, t = windows.shape
        bytes_at = np.ascontiguousarray(windows.T)
        h, dtype = self.h, self.embed.dtype
        states = np.empty((t, 2 * h, n), dtype)
        state = np.zeros((2 * h, n), dtype)
        for i in range(t):
            state = self.step(self.inputs(bytes_at[i], bytes_at[t - 1 - i]), state)[0]
            states[i, :h] = state[:h]
            states[t - 1 - i, h:] = state[h:]
        p = np.exp(np.matmul(self.out, states) + self.bias)
        p /= p.sum(axis=1, keepdims=True)
        return p.transpose(1, 0, 2)

    def learn(self, windows: np.ndarray, labels: np.ndarray, steps: int = 160, size: int = 192, length: int = 64, rate: float = 0.03, seed: int = 11) -> None:
        """Backpropagation through time on batches of windows, as many of each language."""
        rng, h, k = np.random.default_rng(seed), self.h, 2 * self.h
        by = [np.flatnonzero(labels == i) for i in range(len(self.languages))]
        names = ("embed", "recur", "out", "bias")
        first, second = ({n: np.zeros_like(getattr(self, n)) for n in names} for _ in range(2))
        for at in range(1, steps + 1):
            y = np.arange(size) % len(by)
            rows = np.array([by[i][rng.integers(len(by[i]))] for i in y])
            start = rng.integers(0, windows.shape[1] - length + 1)
            x = np.ascontiguousarray(windows[rows, start : start + length].T)
            held, states = [], np.zeros((length, k, size))
            state = np.zeros((k, size))
            for i in range(length):
                after, gates, new, inner = self.step(self.inputs(x[i], x[length - 1 - i]), state)
                held.append((state, gates, new, inner))
                state = after
                states[i, :h], states[length - 1 - i, h:] = state[:h], state[h:]
            logits = np.matmul(self.out, states) + self.bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[:, y, np.arange(size)] -= 1
            p /= size * length
            grad = {"out": np.einsum("tlb,tkb->lk", p, states, optimize=True), "bias": p.sum(axis=(0, 2))[:, None], "recur": np.zeros_like(self.recur), "embed": np.zeros_like(self.embed)}
            d_states = np.matmul(self.out.T, p)
            d_inputs = np.zeros((length, 6 * h, size))
            d = np.zeros((k, size))
            for i in reversed(range(length)):
                d[:h] += d_states[i, :h]
                d[h:] += d_states[length - 1 - i, h:]
                state, gates, new, inner = held[i]
                z, r = gates[:k], gates[k:]
                d_new = d * (1 - z) * (1 - new * new)
                d_z = d * (state - new) * z * (1 - z)
                d_r = d_new * inner * r * (1 - r)
                d_inputs[i] = np.concatenate((d_z, d_r, d_new))
                d_g = np.concatenate((d_z, d_r, d_new * r))
                grad["recur"] += d_g @ state.T
                d = d * z + self.recur.T @ d_g
            grad["recur"] *= self.block
            seen, back = x.ravel(), x[::-1].ravel()
            for row in range(6 * h):
                grad["embed"][row] = np.bincount(back if row // h % 2 else seen, d_inputs[:, row].ravel(), 256)
            for n in names:
                g = grad[n]
                first[n] += 0.1 * (g - first[n])
                second[n] += 0.01 * (g * g - second[n])
                w = getattr(self, n)
                w -= rate * min(1.0, 2 - 2 * at / steps) * (first[n] / (1 - 0.9**at)) / (np.sqrt(second[n] / (1 - 0.99**at)) + 1e-7)

    def narrowed(self) -> Network:
        for n in ("embed", "recur", "out", "bias"):
            setattr(self, n, np.ascontiguousarray(getattr(self, n), dtype=np.float32))
        return self

    def documents(self, texts: list[str | None], most: int = 1024) -> np.ndarray:
        """Mean probabilities [document, language] over all positions; zeros for texts without a letter."""
        out = np.zeros((len(texts), len(self.languages)))
        doc, begin, skip, parts, lengths = [], [], [], [], np.zeros(len(texts), np.int64)
        offset = 0
        for i, t in enumerate(texts):
            if not t or not LETTER.search(t):
                continue
            b = t.encode("utf-8", "surrogatepass")
            lengths[i] = n = len(b)
            if n < WINDOW:
                b = b.ljust(WINDOW, b" ")
            parts.append(b)
            starts = list(range(0, max(n - WINDOW, 0) + 1, WINDOW))
            new = [0] * len(starts)
            if n > WINDOW and n % WINDOW:
                starts.append(n - WINDOW)
                new.append(WINDOW - n % WINDOW)  # positions that the window before has labelled
            doc += [i] * len(starts)
            begin += [offset + s for s in starts]
            skip += new
            offset += len(b)
        if not doc:
            return out
        buffer = np.frombuffer(b"".join(parts), np.uint8)
        doc, begin, skip = np.array(doc), np.array(begin), np.array(skip)
        at, place = np.arange(WINDOW), np.arange(WINDOW)[:, None]
        for s in range(0, len(doc), most):
            d = doc[s : s + most]
            p = self.positions(buffer[begin[s : s + most, None] + at])
            counted = (place >= skip[s : s + most]) & (place < np.minimum(lengths[d], WINDOW))
            p = (p * counted).sum(axis=1)
            for k in range(len(self.languages)):
                out[:, k] += np.bincount(d, p[k], len(texts))
        return out / np.maximum(lengths, 1)[:, None]


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, hidden: int = HIDDEN, steps: int = 160) -> Network | None:
    """Learns from about per_language documents of each language (never over twice as many for all together), WINDOWS windows of each."""
    known = docs.where("lang IS NOT NULL AND length(text) > 0").select("text", "lang", F.xxhash64("text", F.lit(5)).alias("h"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}  # languages, not documents
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang in sorted(counts) for x in (lang, min(1.0, per_language / max(1, counts[lang])))])
    some = known.where((F.col("h") / float(2**64) + 0.5) < share[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # of about per_language rows
    chosen = some.withColumn("k", rank).where(F.col("k") <= 2 * per_language).drop("k")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                got, langs = [], []
                for t, lang, h in zip(*(part.column(c).to_pylist() for c in ("text", "lang", "h"))):
                    b = t.encode("utf-8", "surrogatepass").ljust(WINDOW, b" ")
                    for s in np.random.default_rng(h & (2**63 - 1)).integers(0, len(b) - WINDOW + 1, WINDOWS):
                        got.append(b[s : s + WINDOW])
                        langs.append(lang)
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), pa.array(langs, pa.string())], names=["w", "lang"])

    rows = map_arrow(chosen.select("text", "lang", "h"), windows, "w binary, lang string").toPandas()
    if not len(rows):
        return None
    rows = rows.assign(w=rows["w"].map(bytes)).sort_values(["lang", "w"]).reset_index(drop=True)
    languages = sorted(rows["lang"].unique())
    network = Network(languages, hidden)
    labels = rows["lang"].map({lang: i for i, lang in enumerate(languages)}).to_numpy()
    network.learn(np.frombuffer(b"".join(rows["w"]), np.uint8).reshape(-1, WINDOW), labels, steps)
    del rows
    tidy()
    return network.narrowed()


def predict(docs: DataFrame, network: Network | None, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all, if none are named) with lang_pred and score. The network has a few kilobytes, so it is broadcast."""
    made = ["lang_pred", "score"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    sent = docs.sparkSession.sparkContext.broadcast(network)
    whole = docs.select(*keep, F.col("text").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        names = np.array([*(net.languages if net else []), "und"], dtype=object)
        for batch in batches:
            for part in pieces(batch, 4 << 20, "__text"):
                texts = part.column("__text").to_pylist()
                p = net.documents(texts) if net else np.zeros((len(texts), 1))
                best = p.max(axis=1)
                which = np.where(best > 0, p.argmax(axis=1), len(names) - 1)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(names[which], pa.string()), pa.array(np.clip(best, 0, 1))], names=[*keep, *made])

    return map_arrow(whole, run, f"{kept}, lang_pred string, score double")


def held_out(mod: int, rest: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    network = fit(docs.where(~held_out(3, 1)))
    return predict(docs.select("doc_id", "text"), network, keep=["doc_id"]).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
