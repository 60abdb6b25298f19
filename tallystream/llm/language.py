"""Language identification with a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows; two gated recurrent layers read each
window forwards and backwards, a linear layer labels every byte, and the mean
of the label probabilities over all bytes of the text is the document's
distribution.  The weights are learned in numpy by backpropagation through
time.  Gates use the piecewise linear sigmoid, clip(x / 4 + 1/2), in training
and in use.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystream.llm._arrow import map_texts, utf8
from tallystream.llm._sample import least_by_hash

#: Bytes of a window, windows of a block, and units of each direction.
WINDOW, BLOCK, HIDDEN = 96, 1024, 8
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


class ByteGru:
    """Weights and both passes; ``labels`` in the order of the output units."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        self.labels, self.hidden = labels, hidden
        rng = np.random.default_rng(seed)
        h, c = hidden, len(labels)
        self.weights = {
            "embed": rng.normal(0, 0.3, (2, 256, 3 * h)).astype(np.float32),
            "gates": rng.normal(0, h**-0.5, (2, h, 2 * h)).astype(np.float32),
            "state": rng.normal(0, h**-0.5, (2, h, h)).astype(np.float32),
            "out": rng.normal(0, 0.3, (2 * h, c)).astype(np.float32),
            "bias": np.zeros(c, np.float32),
        }

    def states(self, windows: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States (T, B, 2h) of windows (B, T); ``trace`` collects what the backward pass needs."""
        w, h = self.weights, self.hidden
        steps, b = windows.shape[1], windows.shape[0]
        turned = np.ascontiguousarray(windows.T)
        out = np.empty((steps, b, 2 * h), np.float32)
        state = np.zeros((2, b, h), np.float32)
        forward, backward = w["embed"]
        for t in range(steps):
            drive = np.stack((forward.take(turned[t], 0), backward.take(turned[steps - 1 - t], 0)))
            gates = np.matmul(state, w["gates"])
            gates += drive[:, :, : 2 * h]
            gates *= 0.25
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            kept = gates[:, :, :h] * state
            fresh = np.matmul(kept, w["state"])
            fresh += drive[:, :, 2 * h :]
            np.tanh(fresh, out=fresh)
            z = gates[:, :, h:]
            if trace is not None:
                trace.append((state, gates, kept, fresh))
            state = fresh + z * (state - fresh)
            out[t, :, :h] = state[0]
            out[steps - 1 - t, :, h:] = state[1]
        return out

    def position_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Label probabilities (T, B, C) of every byte of the windows (B, T)."""
        x = self.states(windows).reshape(-1, 2 * self.hidden) @ self.weights["out"]
        x += self.weights["bias"]
        x -= x.max(1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(1, keepdims=True)
        return x.reshape(windows.shape[1], windows.shape[0], -1)

    def gradients(self, windows: np.ndarray, mask: np.ndarray, gold: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy of all unmasked bytes."""
        w, h = self.weights, self.hidden
        trace: list = []
        states = self.states(windows, trace)
        steps, b = windows.shape[1], windows.shape[0]
        logits = states @ w["out"] + w["bias"]
        logits -= logits.max(2, keepdims=True)
        delta = np.exp(logits)
        delta /= delta.sum(2, keepdims=True)
        delta[:, np.arange(b), gold] -= 1
        delta *= (mask.T / max(mask.sum(), 1))[:, :, None].astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["out"] = states.reshape(-1, 2 * h).T @ delta.reshape(-1, delta.shape[2])
        grad["bias"] = delta.sum((0, 1))
        above = delta @ w["out"].T
        carry = np.zeros((2, b, h), np.float32)
        gates_t, state_t = w["gates"].transpose(0, 2, 1), w["state"].transpose(0, 2, 1)
        for t in reversed(range(steps)):
            before, gates, kept, fresh = trace[t]
            carry[0] += above[t, :, :h]
            carry[1] += above[steps - 1 - t, :, h:]
            r, z = gates[:, :, :h], gates[:, :, h:]
            d_fresh = carry * (1 - z) * (1 - fresh * fresh)
            d_kept = np.matmul(d_fresh, state_t)
            d_gates = np.concatenate((d_kept * before, carry * (before - fresh)), 2)
            d_gates *= 0.25 * ((gates > 0) & (gates < 1))
            grad["state"] += np.matmul(kept.transpose(0, 2, 1), d_fresh)
            grad["gates"] += np.matmul(before.transpose(0, 2, 1), d_gates)
            d_drive = np.concatenate((d_gates, d_fresh), 2)
            for k, at in enumerate((t, steps - 1 - t)):
                np.add.at(grad["embed"][k], windows[:, at], d_drive[k])
            carry = carry * z + d_kept * r + np.matmul(d_gates, gates_t)
        return grad


def train(samples: list[tuple[str, str]], hidden: int = HIDDEN, passes: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 7) -> ByteGru:
    """Fits the network on (text, label) pairs by Adam; the same samples give the same weights."""
    labels = sorted({x for _, x in samples})
    net = ByteGru(labels or [UNDETERMINED], hidden, seed)
    parts, masks, gold = [], [], []
    for text, label in samples:
        x, m = cut(np.frombuffer(text.encode(), np.uint8), WINDOW)
        parts.append(x)
        masks.append(m)
        gold += [labels.index(label)] * len(x)
    if not gold:
        return net
    x, mask, y = np.concatenate(parts), np.concatenate(masks), np.array(gold)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    step, total = 0, passes * -(-len(x) // batch)
    for _ in range(passes):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            pick = order[at : at + batch]
            grad = net.gradients(x[pick], mask[pick], y[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step += 1
            now = rate * (1 - step / (total + 1))
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net.weights[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return net


def cut(raw: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (n, size) of the bytes, zero-padded, and the mask of real bytes."""
    n = -(-len(raw) // size)
    out = np.zeros(n * size, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, size), (np.arange(n * size) < len(raw)).reshape(n, size)


def pooled(net: ByteGru, texts: pa.Array, block: int = BLOCK) -> np.ndarray:
    """Mean label probabilities of each text, over all its bytes; zeros without bytes."""
    offsets, raw = utf8(texts)
    lengths = np.diff(offsets)
    counts = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(len(lengths)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[owner] + within * WINDOW
    real = np.minimum(WINDOW, offsets[owner + 1] - starts)
    sums = np.zeros((len(lengths), len(net.labels)))
    place = np.arange(WINDOW)
    for at in range(0, len(owner), block):
        here = slice(at, min(at + block, len(owner)))
        mask = place < real[here, None]
        x = np.zeros((block, WINDOW), np.uint8)  # blocks have one shape, so that a window's figures don't depend on its block
        x[: len(mask)][mask] = raw[(starts[here, None] + place)[mask]]
        p = net.position_probabilities(x)[:, : len(mask)]
        by_window = np.einsum("tbc,bt->bc", p, mask.astype(np.float32))
        np.add.at(sums, owner[here], by_window)
    return sums / np.maximum(lengths, 1)[:, None]


def training_sample(docs: DataFrame, text: str, label: str, doc_id: str, usable: Column, per_label: int, max_chars: int) -> list[tuple[str, str]]:
    """At most ``per_label`` usable documents of each label, the least by hash of their id.

    ``usable`` is a condition on the column ``id``.  Of rows that share an id one
    is taken, the least.  Of each a run of at most ``max_chars`` characters is taken, at a place that
    depends on the id, so the sample's size is bounded by the number of labels.
    Only ids and labels are ranked.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(label).alias("label"), F.col(text).cast("string").alias("text"))
    ids = rows.select("id", "label").filter(usable & F.col("label").isNotNull() & F.col("id").isNotNull())
    keys = [r["id"] for r in least_by_hash(ids.distinct(), "label", per_label).select("id").distinct().collect()]
    if not keys:
        return []
    wanted = docs.sparkSession.createDataFrame([(k,) for k in keys], T.StructType([T.StructField("wanted", docs.schema[doc_id].dataType)]))
    picked = rows.filter(F.col("label").isNotNull() & F.col("text").isNotNull()).join(F.broadcast(wanted), F.col("id") == F.col("wanted"), "left_semi")
    room = F.greatest(F.char_length("text") - max_chars + 1, F.lit(1))
    start = (F.pmod(F.xxhash64("id"), room) + 1).cast("int")
    one = picked.select("id", "label", F.substring("text", start, F.lit(max_chars)).alias("t")).groupBy("id").agg(F.min(F.struct("t", "label")).alias("first"))
    return [(r["first"]["t"], r["first"]["label"]) for r in sorted(one.collect(), key=lambda r: (r["id"], r["first"]))]


def fit(docs: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id", usable: Column | None = None, per_label: int = 160, max_chars: int = 1000) -> ByteGru:
    """A network for the labels of ``docs``, from a bounded sample of the usable labelled rows."""
    return train(training_sample(docs, text, label, doc_id, F.lit(True) if usable is None else usable, per_label, max_chars))


def identify(docs: DataFrame, net: ByteGru, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``lang_pred``, ``score`` and ``n_bytes`` of every row.

    The whole text is read.  A null text, or one without a letter, is ``und``
    with score 0.  The score is the mean probability of the predicted label
    over all bytes, rounded to 4 digits; ties go to the first label.  Repeated
    rows are labelled each, alike.
    """
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_bytes", T.LongType())]

    def kernel():
        def compute(texts):
            p = pooled(net, texts)
            lettered = [bool(t and _LETTER.search(t)) for t in texts.to_pylist()]
            best = p.argmax(1)
            langs = [net.labels[k] if ok else UNDETERMINED for k, ok in zip(best, lettered, strict=True)]
            scores = [round(min(1.0, float(x)), 4) if ok else 0.0 for x, ok in zip(p.max(1), lettered, strict=True)]
            return [langs, scores, np.diff(utf8(texts)[0]).tolist()]

        return compute

    return map_texts(docs, text, list(keep), fields, kernel)
