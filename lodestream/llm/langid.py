"""Language identification by a convolutional network over bytes.

Byte embeddings, filters of several widths, the maximum of each filter over a window, and a softmax, trained in numpy on
windows of labelled texts. A whole text is covered by overlapping windows of fixed length, so that every run of bytes as long
as the widest filter lies in one; a text's probabilities are the windows' means, weighted by their letters.

Learning takes a bounded sample: at most SAMPLE texts of each language, and at most SAMPLED of all, chosen by a hash of doc_id and
text, with WINDOWS windows of each text; more than LANGUAGES values of lang are refused, as they can't be languages. One more class
is that of noise, learned from windows of random bytes, which no text is predicted as but which shares in the probabilities. Every prediction covers all documents.

Defined results: text that is null or has no letter is "und" with score 0, as is every text where nothing could be learned;
a null doc_id is neither learned from nor held out; repeated rows return a row each; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_blocks

SAMPLE, SAMPLED, LANGUAGES, WINDOWS = 300, 75_000, 10_000, 3
WINDOW, EMBEDDED, WIDTHS, FILTERS = 256, 8, (2, 3, 4, 5), 8
STEP = WINDOW - max(WIDTHS) + 1
PAD = 256
UNKNOWN = "und"
_AT_ONCE = 128

_LETTER = np.zeros(257, np.float32)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


class Network:
    """The trained network: weights for one window, as plain arrays; the class behind the labels is noise."""

    def __init__(self, labels: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.labels, wide = labels, max(WIDTHS)
        self.embedding = rng.normal(0, 0.5, (257, EMBEDDED)).astype(np.float32)
        self.embedding[PAD] = 0
        #: Which taps of each filter there are; a narrower filter lacks the last ones.
        self.taps = np.repeat(np.array([np.arange(wide) < w for w in WIDTHS]).T.astype(np.float32), FILTERS, axis=1).repeat(EMBEDDED, axis=0)
        self.filters = (rng.normal(0, 1, (wide * EMBEDDED, len(WIDTHS) * FILTERS)) / np.sqrt(self.taps.sum(0))).astype(np.float32) * self.taps
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels) + 1)).astype(np.float32)
        self.out_bias = np.zeros(len(labels) + 1, np.float32)

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        x = self.embedding[windows]
        wide = max(WIDTHS)
        view = np.lib.stride_tricks.sliding_window_view(x.reshape(len(x), -1), wide * EMBEDDED, axis=1)[:, ::EMBEDDED]
        return np.ascontiguousarray(view)

    def _pooled(self, patches: np.ndarray) -> np.ndarray:
        n, places, wide = patches.shape
        return (patches.reshape(-1, wide) @ self.filters).reshape(n, places, -1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Per window (bytes, PAD after the end): the probability of each label, and of noise."""
        hidden = np.maximum(self._pooled(self._patches(windows)).max(1) + self.bias, 0)
        z = hidden @ self.out + self.out_bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def train(self, windows: np.ndarray, targets: np.ndarray, epochs: int = 8, rate: float = 0.01, batch: int = 64, seed: int = 0) -> None:
        """Cross-entropy by Adam; the gradient of a maximum flows to its place alone."""
        rng, weights = np.random.default_rng(seed), [self.embedding, self.filters, self.bias, self.out, self.out_bias]
        first, second, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        wide, kinds = max(WIDTHS), np.bincount(targets, minlength=len(self.labels) + 1)
        share = (len(targets) / np.maximum(1, kinds) / len(kinds)).astype(np.float32)
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            for x in range(0, len(order), batch):
                own = order[x : x + batch]
                patches = self._patches(windows[own])
                scores = self._pooled(patches)
                place = scores.argmax(1)
                peak = np.take_along_axis(scores, place[:, None], 1)[:, 0] + self.bias
                hidden = np.maximum(peak, 0)
                z = hidden @ self.out + self.out_bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(own)), targets[own]] -= 1
                p *= share[targets[own]][:, None] / len(own)
                back = (p @ self.out.T) * (peak > 0)
                picked = patches[np.arange(len(own))[:, None], place]  # window, filter, tap
                d_filters = np.einsum("nf,nfk->kf", back, picked) * self.taps
                taps = (back[:, :, None] * self.filters.T[None]).reshape(-1, EMBEDDED)
                at = windows[own][np.arange(len(own))[:, None, None], place[:, :, None] + np.arange(wide)].reshape(-1)
                d_embedding = np.zeros_like(self.embedding)
                np.add.at(d_embedding, at, taps)
                d_embedding[PAD] = 0
                t += 1
                step = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                for w, g, m, v in zip(weights, (d_embedding, d_filters, back.sum(0), hidden.T @ p, p.sum(0)), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= (step * m / (np.sqrt(v) + 1e-8)).astype(np.float32)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row of a block: the label's index, its probability and that of noise; index -1 where a row has no letter."""
        n = np.diff(offsets)
        rows = len(n)
        count = np.where(n > WINDOW, -(-(n - WINDOW) // STEP) + 1, np.minimum(n, 1))
        of = np.repeat(np.arange(rows), count)
        start = STEP * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
        start = np.maximum(0, np.minimum(start, n[of] - WINDOW)) + offsets[of]
        total, weight = np.zeros((rows, len(self.labels) + 1)), np.zeros(rows)
        padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
        for x in range(0, len(of), _AT_ONCE):
            own, at = of[x : x + _AT_ONCE], start[x : x + _AT_ONCE, None] + np.arange(WINDOW)
            windows = np.where(at < offsets[own + 1][:, None], padded[at].astype(np.int64), PAD)
            letters = _LETTER[windows].sum(1)
            np.add.at(total, own, self.probabilities(windows) * letters[:, None])
            np.add.at(weight, own, letters)
        share = total / np.maximum(weight, 1)[:, None]
        best = np.where(weight > 0, share[:, :-1].argmax(1), -1)
        score = np.where(best >= 0, share[:, :-1].max(1), 0.0)
        # Bytes above ASCII may still be no letters.
        ascii_letters = _LETTER[:128][np.minimum(data, 127)] * (data < 128)
        sums = np.concatenate([[0], np.cumsum(ascii_letters)])
        for k in np.flatnonzero((best >= 0) & (np.diff(sums[offsets]) == 0)):
            if not any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode()):
                best[k], score[k] = -1, 0.0
        return best, np.clip(np.round(score, 6), 0, 1), share[:, -1]


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE, sampled: int = SAMPLED) -> Network | None:
    """A network of the languages of docs (doc_id, text, lang), from documents that aren't held out; None if there are none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("doc_id is not null and lang is not null and text is not null").filter(~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if not counts:
        return None
    if len(counts) > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} values")
    sample = max(1, min(sample, sampled // len(counts)))
    # A hash chooses somewhat more than the sample of each language; of these the least hashes are taken, repeated rows once.
    share = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, (1.3 * sample + 30) / r["count"])) for r in counts], "lang string, share double")
    rows = rows.withColumn("draw", F.xxhash64("doc_id", "text")).join(F.broadcast(share), "lang")
    rows = rows.filter(F.col("draw").cast("double") / 2.0**64 + 0.5 <= F.col("share")).dropDuplicates(["lang", "draw"])
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).filter(F.col("place") <= sample)
    raw = F.col("text").cast("binary")
    size = F.octet_length(raw)
    parts = [F.substring(raw, (F.greatest(size - WINDOW, F.lit(0)) * k / max(1, WINDOWS - 1)).cast("int") + 1, F.lit(WINDOW)) for k in range(WINDOWS)]
    drawn = rows.select("lang", "draw", F.array(*parts).alias("parts")).collect()
    labels, windows, targets = sorted(r["lang"] for r in counts), [], []
    for k, lang in enumerate(labels):
        for r in sorted((r for r in drawn if r["lang"] == lang), key=lambda r: r["draw"]):
            for part in dict.fromkeys(map(bytes, r["parts"])):
                window = np.full(WINDOW, PAD, np.int64)
                window[: len(part)] = np.frombuffer(part, np.uint8)
                if _LETTER[window].any():
                    windows.append(window), targets.append(k)
    network = Network(labels)
    if windows:
        noise = _noise(windows[:: max(1, len(windows) // (WINDOWS * sample))])
        network.train(np.array(windows + noise), np.array(targets + [len(labels)] * len(noise)))
    return network


def _noise(windows: list[np.ndarray], seed: int = 5) -> list[np.ndarray]:
    """Windows as long as these of random bytes, all that any of these has alike."""
    rng, out = np.random.default_rng(seed), []
    seen = np.setdiff1d(np.unique(windows), [PAD])
    for window in windows:
        out.append(np.where(window == PAD, PAD, rng.choice(seen, WINDOW)))
    return out


def _predicted(network: Network | None, batch: pa.RecordBatch, column: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    names, scores, noise = [], [], []
    for _, data, offsets in text_blocks(batch, column):
        if network is None:
            best, score, other = np.full(len(offsets) - 1, -1), np.zeros(len(offsets) - 1), np.ones(len(offsets) - 1)
        else:
            best, score, other = network.rows(data, offsets)
        names += [network.labels[k] if k >= 0 else UNKNOWN for k in best]
        scores.append(score)
        noise.append(other)
    return names, *(np.concatenate(x) if x else np.zeros(0) for x in (scores, noise))


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """Per document of docs (doc_id, text): doc_id, held_out, lang_pred, score."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, _ = _predicted(network, batch, "text")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, network: Network | None) -> DataFrame:
    """The rows of docs, all columns, whose text has a language that is at least as probable as noise."""
    text = next(x for x in docs.columns if x.lower() == "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, noise = _predicted(network, batch, text)
            kept = pa.array([n != UNKNOWN and s >= other for n, s, other in zip(names, scores, noise, strict=True)], pa.bool_())
            for x in range(0, batch.num_rows, 512):
                yield batch.slice(x, 512).filter(kept.slice(x, 512))

    return docs.mapInArrow(rows, docs.schema)
