"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of an n-gram of lowered UTF-8 bytes, hashed into ``1 << BITS`` buckets. For
each bucket the log ratio of its rates among toxic and other texts is taken; the buckets whose ratio
stands out most from its error are kept, and a logistic regression is fitted over the presences times
the ratios. The fit runs in one task on a bounded sample: at most ``per_class`` labelled documents of
either class, by the hash of their ids, and of their texts at most ``SAMPLE_BYTES``. The model is one
number per bucket. Scoring is one pass over whole texts.

A NULL text counts as empty, and an empty text scores by the share of toxic labels. Labels that are NULL
or of no document are not used; of several labels of a document the highest counts. Without labels of
both classes the score is that share (a half without any). Repeated rows are scored each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tieout.llm.common import blocks, offsets, raw

ORDERS = (5, 6, 7)
BITS = 20
MASK = (1 << BITS) - 1
#: Labelled documents of each class that a fit takes at most, and bytes of their texts.
PER_CLASS = 2500
SAMPLE_BYTES = 96 << 20
#: Buckets kept, the smoothing of counts, passes over the sample, and the strength of the penalty.
KEPT, SMOOTHING, EPOCHS, PENALTY = 40_000, 0.5, 15, 1e-5
#: Passes are added until so many steps were taken, since a few labels make few steps a pass.
STEPS = 600
#: A kept bucket's log ratio is at least TELLING, and at least FIRM times its standard error.
TELLING, FIRM = 2.0, 2.5

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[[9, 10, 11, 12, 13]] = 32
LOWER[0] = 1  # zero sets texts apart


@dataclass
class Model:
    weights: np.ndarray  # per bucket; zero where the bucket is not kept
    intercept: float


def buckets(texts: pa.Array, kept: np.ndarray | None = None) -> np.ndarray:
    """The distinct pairs of a text's number and a bucket of its n-grams, as ``number << BITS | bucket``, sorted.

    With ``kept``, buckets that are not kept are passed over.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    sizes = np.diff(offsets(texts))
    ends = np.cumsum(sizes + 2)  # a space before each text, and a zero after it
    data = np.full(ends[-1] if len(ends) else 0, 32, np.uint8)
    mask = np.ones(len(data), bool)
    mask[ends - 1] = False
    mask[ends - sizes - 2] = False
    data[mask] = LOWER[raw(texts)]
    data[ends - 1] = 0
    wide = data.astype(np.uint32)
    rolled, n, keys = wide.copy(), 1, []
    for order in ORDERS:
        while n < order:
            rolled = rolled[:-1] * np.uint32(0x01000193)
            rolled += wide[n:]
            n += 1
        if len(rolled) == 0:
            break
        bucket = rolled * np.uint32(0x2C1B3C6D)
        bucket >>= np.uint32(32 - BITS)
        at = np.arange(len(bucket)) if kept is None else np.flatnonzero(kept.take(bucket))
        owner = np.searchsorted(ends, at, "right") if kept is not None else np.repeat(np.arange(len(sizes)), sizes + 2)[: len(at)]
        inside = at + order <= ends[owner] - 1
        keys.append((owner[inside] << BITS) | bucket[at[inside]])
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)


def sums(model: Model, texts: pa.Array) -> np.ndarray:
    """Each text's sum of the weights of the buckets present."""
    found = buckets(texts, model.weights != 0)
    return np.bincount(found >> BITS, model.weights[found & MASK], minlength=len(texts))


def fit(texts: list[str], labels: np.ndarray, share: float) -> Model:
    """Fit a model; ``share`` is how much of all labelled documents is toxic."""
    labels = np.asarray(labels, bool)
    share = min(max(share, 1e-4), 1 - 1e-4)
    prior = float(np.log(share / (1 - share)))
    if not labels.any() or labels.all():
        return Model(np.zeros(1 << BITS, np.float32), prior)
    counts = np.zeros((2, 1 << BITS), np.int64)
    groups = [slice(i, i + 64) for i in range(0, len(texts), 64)]
    for some in groups:
        found = buckets(pa.array(texts[some], pa.string()))
        toxic = labels[some][found >> BITS]
        for c in (0, 1):
            counts[c] += np.bincount(found[toxic == c] & MASK, minlength=1 << BITS)
    many = np.array([(~labels).sum(), labels.sum()])
    rates = (counts + SMOOTHING) / (many[:, None] + 2 * SMOOTHING)
    ratio = np.log(rates[1] / rates[0])
    error = np.sqrt(1 / (counts[0] + SMOOTHING) + 1 / (counts[1] + SMOOTHING))
    strength = np.where(counts.sum(axis=0) >= 3, np.abs(ratio) / error, 0)
    kept = np.argsort(-strength, kind="stable")[:KEPT]
    scale = np.zeros(1 << BITS)
    scale[kept] = np.where((strength[kept] >= FIRM) & (np.abs(ratio[kept]) >= TELLING), ratio[kept], 0)
    slot = np.flatnonzero(scale)
    index = np.full(1 << BITS, -1)
    index[slot] = np.arange(len(slot))
    rows = []
    for some in groups:
        keys = buckets(pa.array(texts[some], pa.string()), index >= 0)
        at = np.searchsorted(keys >> BITS, np.arange(len(texts[some]) + 1))
        rows += [index[keys[a:b] & MASK] for a, b in zip(at, at[1:])]
    weights, intercept = _logistic(rows, labels, scale[slot])
    out = np.zeros(1 << BITS, np.float32)
    out[slot] = weights * scale[slot]
    # The sample has its own share of toxic texts; the intercept goes back to that of all labels.
    return Model(out, intercept + prior - float(np.log(many[1] / many[0])))


def _logistic(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression over presences times ``scale``, by adaptive steps over small groups of rows."""
    # The bias starts at what fits without any n-gram: from zero, a small sample ends before it gets there.
    weights, bias = np.zeros(len(scale)), float(np.log(labels.sum() / (~labels).sum()))
    speed, bias_speed = np.full(len(scale), 1e-3), 1e-3
    order, target = np.random.default_rng(0), labels.astype(float)
    for _ in range(max(EPOCHS, -(-STEPS * 32 // len(rows)))):
        shuffled = order.permutation(len(rows))
        for i in range(0, len(shuffled), 32):
            some = shuffled[i : i + 32]
            sizes = np.array([len(rows[k]) for k in some])
            flat = np.concatenate([rows[k] for k in some]) if sizes.sum() else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(some)), sizes)
            z = bias + np.bincount(owner, weights[flat] * scale[flat], minlength=len(some))
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[some]) / len(some)
            touched, inverse = np.unique(flat, return_inverse=True)
            step = np.bincount(inverse, slope[owner], minlength=len(touched)) * scale[touched] + PENALTY * weights[touched]
            speed[touched] += step * step
            weights[touched] -= 0.05 * step / np.sqrt(speed[touched])
            bias_speed += slope.sum() ** 2
            bias -= 0.05 * slope.sum() / np.sqrt(bias_speed)
    return weights, bias


def held_out(key):
    """Rows that no fit may learn from: those whose id's CRC-32 leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Fit on labelled documents that are not held out."""
    marks = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).dropna().filter(~held_out(F.col("id")))
    marks = marks.groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    picked = [marks.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    # At most ``per_class`` rows of either class are sent out and come back with their texts.
    sample = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked[0].unionAll(picked[1])), "id")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((r["order"], r["id"], r["text"] or "", r["y"]) for b in batches for r in b.to_pylist()), key=lambda r: r[0])
        size = np.cumsum([len(r[2].encode()) for r in rows])
        rows = [r for r, s in zip(rows, size.tolist()) if s <= SAMPLE_BYTES]
        model = fit([r[2] for r in rows], np.array([r[3] for r in rows], bool), share)
        slot = np.flatnonzero(model.weights).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([slot.tobytes()]), pa.array([model.weights[slot].tobytes()]), pa.array([model.intercept])], ["slots", "weights", "intercept"])

    gathered = sample.withColumn("order", F.xxhash64("id", "text")).repartition(1)
    row = gathered.mapInArrow(fitted, "slots binary, weights binary, intercept double").first()
    weights = np.zeros(1 << BITS, np.float32)
    if row is None:
        return Model(weights, float(np.log(share / (1 - share))))
    weights[np.frombuffer(row["slots"], np.int32)] = np.frombuffer(row["weights"], np.float32)
    return Model(weights, row["intercept"])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", whole: bool = False, name: str = "score") -> DataFrame:
    """How likely each text is toxic, a row per row: column ``name`` beside ``key``, or with ``whole`` beside all columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs if whole else docs.select(key, text)
    beside = rows.columns if whole else [key]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text, 4 << 20):
            z = sums(sent.value, batch.column(text)) + sent.value.intercept
            chance = pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in beside], chance], [*beside, name])

    return rows.mapInArrow(scored, StructType([*[rows.schema[c] for c in beside], StructField(name, DoubleType())]))
