"""Language identification with a small convolutional network over bytes.

Windows of fixed length; filters of widths 2, 3 and 4 over byte classes; the maximum of each filter
over the window; softmax. Trained in numpy on windows of labelled texts. A filter of width w is a
sum of w table rows, so a width is applied to a window by looking bytes (pairs of bytes) up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from ..session import write_once
from .scan import slices

WINDOW, FILTERS, WIDTHS = 256, 16, (2, 3, 4)
#: Training reads at most so many texts of each language (chosen by a hash of the text), so many windows of each,
#: and at most so many texts in all.
PER_LANGUAGE, PER_TEXT, TEXTS = 1_000, 4, 16_000
EPOCHS, BATCH, RATE = 6, 256, 0.01
#: Windows looked up at a time.
CHUNK = 256
UNKNOWN = "und"


def byte_classes() -> np.ndarray:
    """Letters by lower case, digits together, white space together, other ASCII together, and
    bytes beyond ASCII each alone."""
    out = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        out[b] = 1 + ord(c.lower()) - 97 if b < 128 and c.isalpha() else 27 if b < 128 and c.isdigit() else 28 if b < 128 and not c.isspace() else 0 if b < 128 else b - 99
    return out


CLASS = byte_classes()
N = int(CLASS.max()) + 1


@dataclass
class Network:
    labels: list[str]
    tables: list[np.ndarray]  # one (width, N, FILTERS) per width
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def lookups(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows for the pair of bytes at a place, and for the pair two places on."""
        t2, t3, t4 = self.tables
        pair = lambda t: t[0][:, None] + t[1][None, :]
        here = np.concatenate((pair(t2), pair(t3[:2]), pair(t4[:2])), 2).reshape(N * N, -1)
        on = np.concatenate((np.broadcast_to(t3[2][:, None], (N, N, FILTERS)), pair(t4[2:])), 2).reshape(N * N, -1)
        return np.ascontiguousarray(here, np.float32), np.ascontiguousarray(on, np.float32)

    def probabilities(self, windows: np.ndarray, rows: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """(windows, labels) for byte classes (windows, WINDOW)."""
        here, on = rows
        out = np.empty((len(windows), len(self.labels)), np.float32)
        for a in range(0, len(windows), CHUNK):
            part = windows[a:a + CHUNK]
            pairs = part[:, :-1] * N + part[:, 1:]
            x = here[pairs[:, :-2]]
            x[:, :, FILTERS:] += on[pairs[:, 2:]]
            z = np.maximum(x.max(1) + self.bias, 0) @ self.weights + self.offset
            z = np.exp(z - z.max(1, keepdims=True))
            out[a:a + CHUNK] = z / z.sum(1, keepdims=True)
        return out


def train(windows: np.ndarray, target: np.ndarray, labels: list[str], seed: int = 7) -> Network:
    """Adam on the cross-entropy; each language weighs the same. The gradient of a maximum goes to
    the place where it was reached."""
    rng = np.random.default_rng(seed)
    size = FILTERS * len(WIDTHS)
    net = Network(labels, [rng.normal(0, 0.3, (w, N, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(size, np.float32),
                  rng.normal(0, 0.1, (size, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))
    share = 1 / np.maximum(1, np.bincount(target, minlength=len(labels)))
    weight = (share / share[target].sum() * len(target))[target].astype(np.float32)
    values = [*net.tables, net.bias, net.weights, net.offset]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step = 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(windows)), -(-len(windows) // BATCH)):
            part, wide = windows[at], WINDOW - max(WIDTHS) + 1
            best, where = [], []
            for w, table in zip(WIDTHS, net.tables):
                x = sum(table[k][part[:, k:k + wide]] for k in range(w))
                where.append(x.argmax(1))
                best.append(x.max(1))
            pooled = np.concatenate(best, 1) + net.bias
            hidden = np.maximum(pooled, 0)
            z = hidden @ net.weights + net.offset
            z = np.exp(z - z.max(1, keepdims=True))
            dz = z / z.sum(1, keepdims=True)
            dz[np.arange(len(at)), target[at]] -= 1
            dz *= weight[at][:, None] / len(at)
            dp = (dz @ net.weights.T) * (pooled > 0)
            grads = []
            for i, w in enumerate(WIDTHS):
                g, d = np.zeros_like(net.tables[i]), dp[:, i * FILTERS:(i + 1) * FILTERS]
                for k in range(w):
                    np.add.at(g[k], (part[np.arange(len(at))[:, None], where[i] + k], np.arange(FILTERS)[None, :]), d)
                grads.append(g)
            grads += [dp.sum(0), hidden.T @ dz, dz.sum(0)]
            step += 1
            for v, g, m, s in zip(values, grads, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return net


def cut(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of all texts in windows, the last of a text filled up: classes (windows, WINDOW),
    bytes in each, and each text's first window, with their number at the end."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    _, _, data = column.buffers()
    offset = np.frombuffer(column.buffers()[1], np.int64)[column.offset] if len(column) else 0
    raw = CLASS[np.frombuffer(data, np.uint8)[offset:offset + n.sum()]] if data is not None else np.empty(0, np.int64)
    count = -(-n // WINDOW)
    flat = np.zeros(int(count.sum()) * WINDOW, np.int64)
    begin = (np.cumsum(count) - count) * WINDOW
    flat[np.arange(len(raw)) + np.repeat(begin - (np.cumsum(n) - n), n)] = raw
    full = np.full(int(count.sum()), WINDOW)
    last = np.cumsum(count)[count > 0] - 1
    full[last] = (n - (count - 1) * WINDOW)[count > 0]
    return flat.reshape(-1, WINDOW), full, np.append(0, np.cumsum(count))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, texts: int = TEXTS) -> DataFrame:
    """(lang, piece): windows at even distances of a bounded number of labelled texts. A hash of the text picks about twice as many
    distinct texts of each language as are wanted (all, if there are no more), equal ones fall together, and of the rest the first by
    hash stay, so little is shuffled and no language fills a task."""
    size, whole = F.length("text"), 1 << 31
    pieces = F.array(*[F.substring(F.col("text"), F.greatest(F.lit(1), ((size - WINDOW) * i / (PER_TEXT - 1)).cast("int") + 1), F.lit(WINDOW)) for i in range(PER_TEXT)])
    some = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("h"), "text")
    letter = F.col("text").rlike(r"\p{L}")
    # of distinct texts, as the hash picks these; written, so that its size is known before the join and the texts are not shuffled for it
    distinct = some.where(letter).select("lang", "h").dropDuplicates(["lang", "h"])
    counts = write_once(distinct.groupBy("lang").agg(F.count("*").alias("n")), "language-counts")
    few = some.join(counts, "lang").where(F.pmod("h", F.lit(whole)) / whole * F.col("n") < 2 * per_language).where(letter)
    # a text of few characters gives one piece
    few = few.select("lang", "h", F.array_distinct(pieces).alias("piece")).groupBy("lang", "h").agg(F.min("piece").alias("piece"))
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= per_language)
    return ranked.orderBy("h", "lang").limit(texts).select("lang", F.explode("piece").alias("piece"))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Network | None:
    """Fits the network on a bounded sample of rows with text, a letter, and lang. None if there are none."""
    rows = sample(docs, per_language).toPandas()
    if rows.empty:
        return None
    rows = rows.sort_values(["lang", "piece"])
    labels = sorted(set(rows["lang"]))
    windows, _, first = cut(pa.array(rows["piece"].tolist(), pa.string()))
    target = np.searchsorted(labels, rows["lang"].to_numpy(dtype=str))
    return train(windows, np.repeat(target, np.diff(first)), labels)


def identify(docs: DataFrame, network: Network | None, name: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two more columns, the language and its score (the mean of the windows' probabilities, by their bytes).

    Every window of every text counts. A null or empty text, or one without a letter, is ``und``
    with score 0, as is every text if nothing was learned. Repeated rows get the same answer;
    other columns stay, except that one of either name is replaced.
    """
    docs = docs.drop(name, score)
    rows = docs.withColumn("__has_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = network.lookups() if network else None
        for batch in batches:
            for part in slices(batch):
                letter = part.column("__has_letter").to_numpy(zero_copy_only=False)
                names, scores = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
                if network:
                    windows, full, first = cut(part.column("text"))
                    some = np.flatnonzero(letter & (np.diff(first) > 0))
                    if len(some):
                        p = network.probabilities(windows, table) * full[:, None]
                        sums = np.concatenate((np.zeros((1, p.shape[1])), np.cumsum(p, 0, dtype=np.float64)))
                        p = (sums[first[1:]] - sums[first[:-1]])[some]
                        p /= p.sum(1, keepdims=True)
                        names[some], scores[some] = np.array(network.labels, object)[p.argmax(1)], p.max(1)
                keep = [c for c in part.schema.names if c != "__has_letter"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(names, pa.string()), pa.array(np.clip(scores, 0, 1))], names=[*keep, name, score])

    return rows.mapInArrow(tell, schema)


def held_out(doc_id: str = "doc_id"):
    """A fifth of the documents, by a checksum of the id; rows without an id are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def accepted(docs: DataFrame, network: Network | None, least: float) -> DataFrame:
    """``docs`` without those that are ``und`` or whose language is less sure than ``least``."""
    told = identify(docs, network, "__language", "__sure")
    return told.where((F.col("__language") != UNKNOWN) & (F.col("__sure") >= least)).drop("__language", "__sure")
