"""Toxicity by non-negative positive-unlabelled learning: confirmed toxic texts against unlabelled ones, with a class-prior-corrected risk."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabsift.llm.common import pick, ship
from tabsift.llm.sampling import draw, held_out
from tabsift.llm.wordhash import STEP, chunks, mix

#: Features are byte runs of the lengths GRAMS, a word's first letters with the space before it, and the first LEAD bytes of words, hashed into 2 ** SPACE slots.
GRAMS, LEAD, SPACE = (4, 5), range(3, 10), 20
#: A feature that a text has so often, and in so large a share of its words, is another feature: stems that chance forms here and there are
#: told from stems that a text is full of, whatever its length.
LEVELS = ((2, 0.01), (3, 0.02), (4, 0.04))
#: Training: at most so many confirmed and unlabelled texts; slots kept at most, and the standard errors by which their shares must differ.
POSITIVE, UNLABELLED, KEPT, LEAST = 2000, 6000, 8192, 8.0
EPOCHS, RATE, DECAY, THRESHOLD = 40, 0.05, 1e-4, 0.7

_letter = np.full(256, 32, dtype=np.uint8)                       # all but letters, digits and non-ASCII bytes is a space
for _low, _high, _shift in ((48, 58, 0), (65, 91, 32), (97, 123, 0), (128, 256, 0)):
    _letter[_low:_high] = np.arange(_low, _high) + _shift


#: Bytes whose features are counted at once; longer texts take several rounds.
BLOCK = 2 << 20


def _keys(spaced: np.ndarray, left: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, slots, word starts) of the features that begin at the first ``size`` places; ``left`` bytes remain of the text from a place on."""
    at, keys = [], []
    code = np.zeros(size, dtype=np.uint64)
    for j in range(max(GRAMS)):
        part = spaced[j:j + size]
        code[:len(part)] |= part.astype(np.uint64) << np.uint64(8 * j)
        if j + 1 in GRAMS:
            whole = np.flatnonzero(left[:size] > j)
            at.append(whole)
            keys.append((code[whole] + np.uint64(j)) * STEP)
    after = np.append(spaced[1:], 32)[:size]
    starts = np.flatnonzero((spaced[:size] == 32) & (after != 32) & (left[:size] > 1))
    place, code = starts, np.zeros(len(starts), dtype=np.uint64)
    for n in range(1, max(LEAD) + 1):
        there = left[place] > n
        place, code = place[there], code[there]
        there = spaced[place + n] != 32
        place, code = place[there], code[there]
        code = mix(code + spaced[place + n].astype(np.uint64) + np.uint64(n << 8))
        if n in LEAD:
            at.append(place)
            keys.append(code)
    return np.concatenate(at), (np.concatenate(keys) >> np.uint64(64 - SPACE)).astype(np.int64), starts


def slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every feature of some texts, their levels included; a text begins with a space."""
    spaced = np.insert(_letter[data], offsets[:-1], 32)
    starts = offsets + np.arange(len(offsets))
    words = np.zeros(len(offsets) - 1, dtype=np.int64)
    held, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for begin in range(0, len(spaced), BLOCK):
        end = min(begin + BLOCK + max(LEAD), len(spaced))
        first, last = np.searchsorted(starts, begin, side="right") - 1, np.searchsorted(starts, end, side="left")
        row = np.repeat(np.arange(first, last), np.diff(np.clip(starts[first:last + 1], begin, end)))
        at, slot, fresh = _keys(spaced[begin:end], starts[row + 1] - np.arange(begin, end), min(BLOCK, end - begin))
        words += np.bincount(row[fresh], minlength=len(words))
        pairs, n = np.unique((row[at] << SPACE) + slot, return_counts=True)
        if len(held):
            pairs, place = np.unique(np.concatenate((held, pairs)), return_inverse=True)
            n = np.bincount(place, weights=np.concatenate((counts, n))).astype(np.int64)
        held, counts = pairs, n
    row, slot = held >> SPACE, held & ((1 << SPACE) - 1)
    rows, out = [row], [slot]
    for level, (least, share) in enumerate(LEVELS, 1):
        often = (counts >= least) & (counts >= share * words[row])
        rows.append(row[often])
        out.append((mix(slot[often].astype(np.uint64) + np.uint64(level << SPACE)) >> np.uint64(64 - SPACE)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(out)


def _shares(texts: pa.Array) -> np.ndarray:
    """In how many of the texts each slot occurs."""
    out = np.zeros(1 << SPACE, dtype=np.int64)
    for _, data, offsets in chunks(texts):
        row, slot = slots(data, offsets)
        np.add.at(out, np.unique((row << SPACE) + slot) & ((1 << SPACE) - 1), 1)
    return out


def _present(texts: pa.Array, place: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(texts), width), dtype=np.float32)
    for first, data, offsets in chunks(texts):
        row, slot = slots(data, offsets)
        at = place[slot]
        out[first + row[at >= 0], at[at >= 0]] = 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(positive: pa.Array, unlabelled: pa.Array, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, weights, bias) of a linear classifier over the presence of slots that are commoner or rarer among confirmed texts.

    Its risk is prior * loss(confirmed as toxic) + max(0, loss(unlabelled as clean) - prior * loss(confirmed as clean)) with the sigmoid
    loss; where the bracket is negative, a step is taken against it, as the non-negative estimator demands.
    """
    n, m = len(positive), len(unlabelled)
    if not n or not m:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.float32), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    a, b = _shares(positive), _shares(unlabelled)
    base = (b + 1) / (m + 2)
    gap = (a / n - base) / np.sqrt(base * (1 - base) * (1 / n + 1 / m))
    kept = np.argsort(-np.abs(gap), kind="stable")[:KEPT]
    kept = np.sort(kept[np.abs(gap[kept]) >= LEAST])
    place = np.full(1 << SPACE, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept))
    x, u = _present(positive, place, len(kept)), _present(unlabelled, place, len(kept))
    w, bias = np.zeros(len(kept), dtype=np.float32), -1.0
    rng, steps = np.random.default_rng(5), 0
    m1, m2 = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for _ in range(EPOCHS):
        order, own = rng.permutation(m), rng.permutation(n)
        size = max(1, min(m, 512))
        for k in range(0, m, size):
            pu, pp = u[order[k:k + size]], x[own[np.arange(k, k + min(n, 256)) % n]]
            zu, zp = _sigmoid(pu @ w + bias), _sigmoid(pp @ w + bias)
            su, sp = zu * (1 - zu) / len(zu), zp * (1 - zp) / len(zp)
            # Sigmoid losses: 1 - z for toxic, z for clean.
            clean = zu.mean() - prior * zp.mean()
            toward = np.append(pp.T @ -sp, -sp.sum()) * prior
            away = np.append(pu.T @ su, su.sum()) - prior * np.append(pp.T @ sp, sp.sum())
            g = toward + away if clean >= 0 else -away
            g[:-1] += DECAY * w
            steps += 1
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            move = RATE * (m1 / (1 - 0.9 ** steps)) / (np.sqrt(m2 / (1 - 0.999 ** steps)) + 1e-8)
            w -= move[:-1].astype(np.float32)
            bias -= float(move[-1])
    return kept, w, bias


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          prior: float | None = None, positive: int = POSITIVE, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, np.ndarray, float]:
    """A classifier from documents outside the held-out fold: at most ``positive`` confirmed toxic and ``unlabelled`` of all texts, drawn by hash.

    Labels of 0 teach nothing as such. The class prior is the share of toxic ones among all labelled rows outside the fold, unless it is given.
    """
    known = pick(labels, id=id_col, toxic=label_col).filter(~held_out(F.col("id")) & F.col("toxic").isNotNull())
    if prior is None:
        prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    rows = pick(docs, id=id_col, text=text_col).filter(~held_out(F.col("id")) & F.col("text").isNotNull())
    confirmed = rows.join(known.filter("toxic = 1").select("id").distinct(), "id", "left_semi")
    take = lambda df, n: draw(df.select("id", "text", F.lit(0).alias("g")), "g", n).select("text").toArrow().column("text").combine_chunks().cast(pa.large_string())
    own, rest = take(confirmed, positive), take(rows, unlabelled)
    as_array = lambda t: t if isinstance(t, pa.Array) else pa.concat_arrays(t.chunks) if t.num_chunks else pa.array([], pa.large_string())
    # Sorted, so that the model doesn't depend on the order in which tasks end.
    own, rest = (t.take(pa.compute.sort_indices(t)) for t in (as_array(own), as_array(rest)))
    return fit(own, rest, float(prior))


def _score(batches, model, threshold: float):
    kept, weights, bias = model.value
    place = np.full(1 << SPACE, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept))
    for batch in batches:
        for first, data, offsets in chunks(batch.column("text")):
            row, slot = slots(data, offsets)
            at = place[slot]
            pairs = np.unique(row[at >= 0] * max(len(kept), 1) + at[at >= 0])
            logit = np.bincount(pairs // max(len(kept), 1), weights=weights[pairs % max(len(kept), 1)] if len(pairs) else None, minlength=len(offsets) - 1) + bias
            score = _sigmoid(logit)
            rest = batch.slice(first, len(score)).drop_columns(["text"])
            yield rest.append_column("score", pa.array(score)).append_column("predicted", pa.array((score >= threshold).astype(np.int32)))


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score, predicted. Every whole text is scored; null and empty texts get the score of a text without features.

    Rows that repeat an id and text repeat the result. Null ids count as outside the held-out fold. Other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = pick(docs, id=id_col, text=text_col).select("id", held_out(F.col("id")).alias("held_out"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(lambda b: _score(b, shared, threshold), f"id {kind}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **training) -> DataFrame:
    """Learns from ``labels`` outside the held-out fold and scores all documents; see :func:`train` and :func:`predict`. No rows give no rows."""
    return predict(docs, train(docs, labels, id_col, text_col, label_col, **training), id_col, text_col)
