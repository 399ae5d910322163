"""Quality classification by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered by overlapping chunks.  Learnt filters slide over
all bytes, each filter's largest response in a chunk is kept, a small layer turns a
chunk's responses into features, and the mean and the largest value of each feature
over all chunks make one probability.  Every byte of every text is read.

Fitting takes at most ``MOST_EACH`` labelled texts of either class, picked by a hash
of their key among those that are in ``docs``, each by all of its bytes; the bound is one of
rows, so the driver holds these texts and no more.  Filters go over long texts in runs of
cells, in fitting and in scoring.  Scoring is a stream over the texts in batches; a very
long text carries its sums and maxima from run to run, so that memory does not grow with it.

Edge cases: a null or empty text is scored as one chunk of padding; keys of equal hash
are picked by their order, and of a key's several texts the least; without
labelled rows of both classes every score is the smoothed share of label 1;
contradicting labels of a key count as 0; repeated rows are all scored; an empty
table gives an empty result; extra columns are never touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base
from .base import any_key, read, ship, slices, text_buffer

MOST_EACH = 1200
WIDTH, STRIDE, CELL, FILTERS, HIDDEN = 8, 2, 64, 24, 16
#: Cells of a long text that are worked on at once.
RUN = 1 << 14
EPOCHS, BATCH, RATE = 10, 64, 0.004
THRESHOLD = 0.3


def padded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with at least WIDTH zeros after each text and each text a whole number of cells; cell offsets of the texts."""
    size = np.diff(offsets)
    cells = (size + WIDTH + CELL - 1) // CELL
    at = np.concatenate(([0], np.cumsum(cells)))
    out = np.zeros(int(at[-1]) * CELL + WIDTH, np.uint8)
    out[np.arange(len(raw)) + np.repeat(at[:-1] * CELL - offsets[:-1], size)] = raw
    return out, at


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        normal = lambda scale, *shape: (r.standard_normal(shape) * scale).astype(np.float32)
        self.weights = {
            "filters": normal(0.3, WIDTH, 256, FILTERS), "filter_bias": np.zeros(FILTERS, np.float32),
            "layer": normal(FILTERS**-0.5, FILTERS, HIDDEN), "layer_bias": np.zeros(HIDDEN, np.float32),
            "top": normal((2 * HIDDEN) ** -0.5, 2 * HIDDEN), "top_bias": np.zeros(1, np.float32),
        }

    def _cells(self, data: np.ndarray, where: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest response of each filter in each cell, and the place it came from if asked for."""
        if len(data) > 2 * RUN * CELL:
            parts = [(at, self._cells(data[at : at + RUN * CELL + WIDTH], where)) for at in range(0, len(data) - WIDTH, RUN * CELL)]
            return np.vstack([x for _, (x, _) in parts]), np.vstack([at + y for at, (_, y) in parts]) if where else None
        n = (len(data) - WIDTH) // STRIDE
        response = np.zeros((n, FILTERS), np.float32)
        for k in range(WIDTH):
            response += self.weights["filters"][k].take(data[k : k + STRIDE * n : STRIDE], axis=0)
        grid = response.reshape(-1, CELL // STRIDE, FILTERS)
        if not where:
            return grid.max(1), None
        best = grid.argmax(1)
        return np.take_along_axis(grid, best[:, None], 1)[:, 0], best * STRIDE + np.arange(len(grid))[:, None] * CELL

    def forward(self, data: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logit of each text; a chunk is a cell and the next one of its text."""
        w = self.weights
        cells, place = self._cells(data, keep)
        after = np.vstack((cells[1:], cells[-1:]))
        last = at[1:] - 1
        after[last] = cells[last]
        chunk = np.maximum(cells, after)
        active = np.maximum(chunk + w["filter_bias"], 0)
        hidden = np.maximum(active @ w["layer"] + w["layer_bias"], 0)
        count = np.diff(at).astype(np.float32)[:, None]
        doc = np.concatenate((np.add.reduceat(hidden, at[:-1]) / count, np.maximum.reduceat(hidden, at[:-1])), 1)
        logit = doc @ w["top"] + w["top_bias"][0]
        return (logit, (cells, after, place, active, hidden, doc, count)) if keep else logit

    def long_logit(self, raw: np.ndarray) -> float:
        """Logit of one text of any length, in runs of cells; what ``forward`` gives but for rounding."""
        w = self.weights
        n = (len(raw) + WIDTH + CELL - 1) // CELL
        total, most = np.zeros(HIDDEN), np.zeros(HIDDEN, np.float32)
        for at in range(0, n, RUN):
            # One cell more than the run, for the last chunk, but at the text's end.
            to = min(at + RUN + 1, n)
            data = np.zeros((to - at) * CELL + WIDTH, np.uint8)
            part = raw[at * CELL : to * CELL + WIDTH]
            data[: len(part)] = part
            cells, _ = self._cells(data, False)
            own = min(RUN, n - at)
            chunk = np.maximum(cells[:own], np.vstack((cells[1:], cells[-1:]))[:own])
            active = np.maximum(chunk + w["filter_bias"], 0)
            hidden = np.maximum(active @ w["layer"] + w["layer_bias"], 0)
            total += hidden.sum(0, dtype=np.float64)
            most = np.maximum(most, hidden.max(0))
        return float(np.concatenate((total / n, most)) @ w["top"] + w["top_bias"][0])

    def gradients(self, data: np.ndarray, at: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        w = self.weights
        logit, (cells, after, place, active, hidden, doc, count) = self.forward(data, at, True)
        p = 1 / (1 + np.exp(-logit))
        loss = float(-np.mean(np.where(target > 0, np.log(p + 1e-7), np.log(1 - p + 1e-7))))
        d_logit = ((p - target) / len(target)).astype(np.float32)
        out = {"top": doc.T @ d_logit, "top_bias": d_logit.sum(keepdims=True)}
        d_doc = d_logit[:, None] * w["top"]
        text = np.repeat(np.arange(len(target)), np.diff(at))
        d_hidden = (d_doc[:, :HIDDEN] / count)[text]
        top = hidden == doc[text, HIDDEN:]
        d_hidden = (d_hidden + np.where(top, d_doc[text, HIDDEN:] / np.maximum(np.add.reduceat(top, at[:-1], dtype=np.float32), 1)[text], 0)) * (hidden > 0)
        out["layer"], out["layer_bias"] = active.T @ d_hidden, d_hidden.sum(0)
        d_chunk = (d_hidden @ w["layer"].T) * (active > 0)
        out["filter_bias"] = d_chunk.sum(0)
        here = cells >= after
        d_cell = np.where(here, d_chunk, 0)
        d_cell[1:] += np.where(here, 0, d_chunk)[:-1]
        some = d_cell != 0
        filters = np.broadcast_to(np.arange(FILTERS), d_cell.shape)[some]
        places, values = place[some], d_cell[some]
        grad = np.zeros((WIDTH, 256, FILTERS), np.float32)
        for k in range(WIDTH):
            grad[k] = np.bincount(data[places + k].astype(np.int64) * FILTERS + filters, values, 256 * FILTERS).reshape(256, FILTERS)
        out["filters"] = grad
        return loss, out

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> float:
        """Adam over shuffled batches; returns the last epoch's mean loss."""
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, losses = 0, [0.0]
        for epoch in range(epochs):
            losses = []
            order = r.permutation(len(texts))
            for i in range(0, len(order), BATCH):
                part = order[i : i + BATCH]
                chosen = [texts[j] for j in part]
                data, at = padded(np.frombuffer(b"".join(chosen), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in chosen]))))
                loss, grads = self.gradients(data, at, labels[part])
                losses.append(loss)
                step += 1
                rate = RATE * min(1.0, 2.0 * (1 - epoch / epochs))
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return float(np.mean(losses))

    def probabilities(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) == 2 and len(raw) > RUN * CELL:
            logit = np.array([self.long_logit(raw)])
        else:
            logit = self.forward(*padded(raw, offsets)).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def held_out(key: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, label: str, text: str = "text", most_each: int = MOST_EACH) -> tuple[list[bytes], np.ndarray]:
    """Texts and 0/1 labels of at most ``most_each`` keys of either class, in the order of their hash."""
    own = docs.filter(F.col(key).isNotNull()).select(key).distinct()
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("_label")).join(own, key, "left_semi")
    picked = [known.filter(F.col("_label") == v).orderBy(F.xxhash64(F.lit(5), key), key).limit(most_each) for v in (0, 1)]
    rows = docs.select(key, F.col(text).alias("_text")).join(F.broadcast(picked[0].union(picked[1])), key)
    rows = rows.groupBy(key, "_label").agg(F.min("_text").alias("_text"))
    found = rows.filter(F.col("_text").isNotNull()).orderBy(F.xxhash64(F.lit(5), key), key).select("_text", "_label").toArrow()
    return [t.encode() for t in found.column("_text").to_pylist()], found.column("_label").to_numpy().astype(np.float32)


@any_key("score", also=("labels",))
def classify(docs: DataFrame, labels: DataFrame, key: str, label: str, text: str = "text", most_each: int = MOST_EACH) -> DataFrame:
    """``(key, score)``: the probability of label 1 for every row of ``docs``; fitted on ``labels``."""
    texts, target = labelled_sample(docs, labels, key, label, text, most_each)
    network = None
    constant = float((target.sum() + 1) / (len(target) + 2))
    if 0 < target.sum() < len(target):
        network = Network()
        network.fit(texts, target)
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, text, 1_000_000):
            raw, offsets = text_buffer(batch.column(text))
            scores = np.full(batch.num_rows, constant) if network is None else network.probabilities(raw, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(scores)], [key, "score"])

    ship(__name__, base.__name__)
    return docs.select(key, text).mapInArrow(run, f"`{key}` {key_type}, score double")


def op9_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held_out(F.col("doc_id")))
    scored = classify(docs, labels, "doc_id", "quality")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op9_byte_cnn": op9_byte_cnn}
ORACLES: dict[str, str] = {}
