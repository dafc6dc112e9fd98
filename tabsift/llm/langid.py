"""Language identification by a small convolutional network over bytes, trained in numpy and applied to all windows of every text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabsift.llm.common import pick, ship
from tabsift.llm.sampling import draw, held_out
from tabsift.llm.wordhash import chunks

#: Bytes of a window, of a letter's embedding; filters of each width.
WINDOW, DEPTH, FILTERS, WIDTHS = 256, 6, 16, (2, 3, 4)
#: Training: about so many documents of each language, at most so many windows of each, so many passes, so many steps at least.
DOCUMENTS, WINDOWS, EPOCHS, STEPS, RATE = 1500, 2, 6, 400, 0.01
#: Windows that go through the network at once.
BATCH = 64
UNKNOWN = "und"


class Network:
    """Embedding, filters of several widths, maximum over the window, softmax."""

    def __init__(self, classes: int, seed: int = 7):
        rng, span = np.random.default_rng(seed), max(WIDTHS)
        self.span, self.mask = span, np.zeros((span * DEPTH, FILTERS * len(WIDTHS)), dtype=np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[:width * DEPTH, k * FILTERS:(k + 1) * FILTERS] = 1
        self.weights = {
            "letters": rng.normal(0, 0.5, (256, DEPTH)), "filters": rng.normal(0, 0.3, self.mask.shape) * self.mask,
            "bias": np.zeros(self.mask.shape[1]), "out": rng.normal(0, 0.1, (self.mask.shape[1], classes)), "shift": np.zeros(classes),
        }
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """The embeddings of every run of ``span`` bytes: windows x positions x (span * DEPTH)."""
        padded = np.pad(windows, ((0, 0), (0, self.span - 1)))
        deep = self.weights["letters"][padded]
        n, length = windows.shape
        view = np.lib.stride_tricks.as_strided(deep, (n, length, self.span * DEPTH), (deep.strides[0], deep.strides[1], deep.strides[2]))
        return np.ascontiguousarray(view).reshape(n * length, -1)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        columns = self.columns(windows)
        heights = (columns @ self.weights["filters"]).reshape(*windows.shape, -1)
        return columns, heights, np.maximum(heights.max(axis=1) + self.weights["bias"], 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.weights["shift"])), dtype=np.float32)
        for k in range(0, len(windows), BATCH):
            logits = self.pooled(windows[k:k + BATCH])[2] @ self.weights["out"] + self.weights["shift"]
            logits = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[k:k + BATCH] = logits / logits.sum(axis=1, keepdims=True)
        return out

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w, (n, length) = self.weights, windows.shape
        columns, heights, top = self.pooled(windows)
        logits = top @ w["out"] + w["shift"]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), labels] -= 1
        p /= n
        back = (p @ w["out"].T) * (top > 0)
        best = heights.argmax(axis=1) + np.arange(n)[:, None] * length          # one position a filter and window
        chosen = columns[best]                                                  # n x filters x (span * DEPTH)
        filters = np.einsum("nfk,nf->kf", chosen, back) * self.mask
        deep = (back[:, :, None] * w["filters"].T[None]).reshape(n, -1, self.span, DEPTH)
        padded = np.pad(windows, ((0, 0), (0, self.span - 1)))
        place = (best - np.arange(n)[:, None] * length)[:, :, None] + np.arange(self.span)
        letters = np.zeros_like(w["letters"])
        np.add.at(letters, padded[np.arange(n)[:, None, None], place], deep)
        return {"letters": letters, "filters": filters, "bias": back.sum(axis=0), "out": top.T @ p, "shift": p.sum(axis=0)}


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of WINDOW bytes, zeros after the end of a text, and how many each text has."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), counts)
    starts = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW
    place = starts[:, None] + np.arange(WINDOW)
    inside = place < offsets[row + 1][:, None]
    return np.where(inside, data[np.minimum(place, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8), counts


def _samples(batches, each: int):
    """Up to ``each`` evenly spread windows of every text with its language."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for row, data, offsets in chunks(batch.column("text")):
            windows, counts = windows_of(data, offsets)
            starts = np.cumsum(counts) - counts
            at = [(r, s + c * k // min(each, c)) for r, (s, c) in enumerate(zip(starts, counts)) for k in range(min(each, c))]
            yield pa.RecordBatch.from_arrays([pa.array([langs[row + r] for r, _ in at], pa.string()), pa.array([windows[w].tobytes() for _, w in at], pa.binary())],
                                             ["lang", "window"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", documents: int = DOCUMENTS,
          windows: int = WINDOWS, epochs: int = EPOCHS, steps: int = STEPS) -> tuple[list[str], Network]:
    """(languages, network) from texts outside the held-out fold whose language is known: at most ``documents`` of each language, drawn by hash."""
    ship(docs.sparkSession)
    rows = pick(docs, id=id_col, text=text_col, lang=lang_col).filter(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = draw(rows.select(F.col("lang").cast("string").alias("lang"), "id", "text"), "lang", documents)
    got = rows.mapInArrow(lambda b: _samples(b, windows), "lang string, window binary").toPandas().sort_values(["lang", "window"], kind="stable")
    langs = sorted(got["lang"].unique())
    network = Network(max(len(langs), 1))
    if len(langs) < 2:
        return langs, network
    labels = np.searchsorted(langs, got["lang"].to_numpy().astype(str))
    x = np.frombuffer(b"".join(got["window"]), dtype=np.uint8).reshape(-1, WINDOW)
    rng, state = np.random.default_rng(11), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.weights.items()}
    total = max(steps, epochs * -(-len(x) // BATCH))
    order = np.concatenate([rng.permutation(len(x)) for _ in range(-(-total * BATCH // len(x)))])
    for step in range(1, total + 1):
        part = order[(step - 1) * BATCH:step * BATCH]
        for name, g in network.gradients(x[part], labels[part]).items():                # Adam
            m, v = state[name]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            network.weights[name] -= np.float32(RATE * 0.05 ** (step / total)) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return langs, network


def _predict(batches, model):
    langs, weights = model.value
    network = Network(max(len(langs), 1))
    network.weights = weights
    for batch in batches:
        known = batch.column("letters").to_pylist()
        for row, data, offsets in chunks(batch.column("text")):
            windows, counts = windows_of(data, offsets)
            sums = np.zeros((len(counts), len(network.weights["shift"])))
            np.add.at(sums, np.repeat(np.arange(len(counts)), counts), network.probabilities(windows))
            mean = sums / np.maximum(counts, 1)[:, None]
            best = mean.argmax(axis=1)
            found = [langs[b] if known[row + k] and langs else UNKNOWN for k, b in enumerate(best)]
            score = [float(min(mean[k, b], 1)) if found[k] != UNKNOWN else 1.0 for k, b in enumerate(best)]
            rest = batch.slice(row, len(counts)).drop_columns(["text", "letters"])
            yield rest.append_column("lang_pred", pa.array(found, pa.string())).append_column("score", pa.array(score, pa.float64()))


def predict(docs: DataFrame, model: tuple[list[str], Network], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score.

    The score is the mean probability of the language over all windows of the text. Null, empty and letterless texts are "und" with score 1,
    and so is every text if no language was learned. Rows that repeat an id and text repeat the result. Other columns are ignored.
    """
    ship(docs.sparkSession)
    langs, network = model
    rows = pick(docs, id=id_col, text=text_col).select("id", held_out(F.col("id")).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text")
    shared = docs.sparkSession.sparkContext.broadcast((langs, network.weights))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(lambda b: _predict(b, shared), f"id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **training: int) -> DataFrame:
    """Learns from the documents' own known languages outside the held-out fold, and predicts all; see :func:`predict`. No rows give no rows."""
    return predict(docs, train(docs, id_col, text_col, lang_col, **training), id_col, text_col)
