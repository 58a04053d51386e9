"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage is encoded, a gated attention learned
from document labels weighs the passages, and the weighted representation is scored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import prefix_hash, range_hash, utf8_blocks, word_bounds

#: words of a passage; the last one of a text may be shorter
PASSAGE_WORDS = 48
#: most labelled documents that a fit uses, chosen by a seeded hash of their id
TRAIN_DOCS = 4_000
_BYTES, _WORDS = 129, 128
#: numbers that describe a passage
WIDTH = _BYTES + _WORDS + 6


def passages(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a block, and the first passage of each row.

    Features: shares of the byte values (all above 127 together), shares of hashed words, share of
    words equal to the one or two before, word length, share of capitals among ASCII
    letters, share of words without an ASCII letter or high byte, and length.  A row
    without words has one passage of zeros.
    """
    starts, ends, first = word_bounds(data, bounds)
    count = np.diff(first)
    made = np.maximum(1, -(-count // PASSAGE_WORDS))
    bag = np.concatenate([[0], np.cumsum(made)])
    row = np.repeat(np.arange(count.size), count)
    of_word = bag[row] + (np.arange(starts.size) - first[row]) // PASSAGE_WORDS
    n = int(bag[-1])
    words = np.bincount(of_word, minlength=n).astype(np.float64)
    per_word = 1.0 / np.maximum(words, 1.0)
    lengths = ends - starts
    total = int(lengths.sum())
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(total)
    kind = np.minimum(data[at], 128)
    chars = np.bincount(np.repeat(of_word * _BYTES, lengths) + kind, minlength=n * _BYTES).reshape(n, _BYTES).astype(np.float64)
    hashes = range_hash(prefix_hash(data), starts, ends)
    hashed = np.bincount(of_word * _WORDS + (hashes % np.uint64(_WORDS)).astype(np.int64), minlength=n * _WORDS).reshape(n, _WORDS)
    same = np.zeros(starts.size)
    for back in (1, 2):
        if starts.size > back:
            hit = (hashes[back:] == hashes[:-back]) & (of_word[back:] == of_word[:-back])
            same[back:] = np.maximum(same[back:], hit)
    upper, lower = chars[:, 65:91].sum(1), chars[:, 97:123].sum(1)
    letter = np.zeros(256, dtype=bool)
    letter[65:91] = letter[97:123] = letter[128:] = True
    seen = np.concatenate([[0], np.cumsum(letter[data])])
    bare = (seen[ends] == seen[starts]).astype(np.float64)
    size = chars.sum(1)
    features = np.empty((n, WIDTH), dtype=np.float32)
    features[:, :_BYTES] = np.sqrt(chars / np.maximum(size, 1.0)[:, None])
    features[:, _BYTES : _BYTES + _WORDS] = np.sqrt(hashed * per_word[:, None])
    features[:, -6] = np.bincount(of_word, same, minlength=n) * per_word
    features[:, -5] = np.minimum(size * per_word, 40.0) / 10.0
    features[:, -4] = upper / np.maximum(upper + lower, 1.0)
    features[:, -3] = np.bincount(of_word, bare, minlength=n) * per_word
    features[:, -2] = words / PASSAGE_WORDS
    features[:, -1] = words > 0
    return features, bag


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class Attention:
    """Weights of the encoder, the gated attention and the scorer."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        """``bag`` holds the first passage of each document and ends with their number."""
        return self.pass_on((x - self.mean) * self.scale, bag)

    def pass_on(self, x: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        """The same for features that are centred and scaled already."""
        p, first = self.p, bag[:-1]
        h = np.tanh(x @ p["encode"] + p["encode0"])
        v, u = np.tanh(h @ p["view"]), _sigmoid(h @ p["gate"])
        e = (v * u) @ p["attend"]
        of = np.repeat(np.arange(first.size), np.diff(bag))
        a = np.exp(e - np.maximum.reduceat(e, first)[of])
        a /= np.add.reduceat(a, first)[of]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "of": of, "z": z, "score": _sigmoid(z @ p["score"] + p["score0"])}

    def backward(self, f: dict[str, np.ndarray], bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, of, first = self.p, f["of"], bag[:-1]
        d = (f["score"] - y) / y.size
        dz = d[:, None] * p["score"]
        da = (f["h"] * dz[of]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, first)[of])
        dv = de[:, None] * p["attend"] * f["u"] * (1 - f["v"] ** 2)
        du = de[:, None] * p["attend"] * f["v"] * f["u"] * (1 - f["u"])
        dh = (f["a"][:, None] * dz[of] + dv @ p["view"].T + du @ p["gate"].T) * (1 - f["h"] ** 2)
        return {
            "encode": f["x"].T @ dh, "encode0": dh.sum(0), "view": f["h"].T @ dv, "gate": f["h"].T @ du,
            "attend": (f["v"] * f["u"]).T @ de, "score": f["z"].T @ d, "score0": np.array(d.sum()),
        }


def fit_attention(x: np.ndarray, bag: np.ndarray, y: np.ndarray, hidden: int = 24, inner: int = 12, steps: int = 300, seed: int = 7) -> Attention:
    """Adam on the mean log loss of the documents plus a small weight decay; ``x`` is centred and scaled in place."""
    rng = np.random.default_rng(seed)
    mean, spread = x.mean(0), x.std(0)
    scale = np.where(spread > 1e-6, 1.0 / np.maximum(spread, 0.02), 0.0)
    start = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
    p = {
        "encode": start(x.shape[1], hidden), "encode0": np.zeros(hidden, np.float32), "view": start(hidden, inner),
        "gate": start(hidden, inner), "attend": start(inner, 1)[:, 0], "score": start(hidden, 1)[:, 0], "score0": np.zeros((), np.float32),
    }
    model = Attention(mean.astype(np.float32), scale.astype(np.float32), p)
    x -= model.mean
    x *= model.scale
    m, s = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}
    for step in range(1, steps + 1):
        grads = model.backward(model.pass_on(x, bag), bag, y)
        rate = 0.02 * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g + 1e-4 * p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may learn from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", train_docs: int = TRAIN_DOCS, seed: str = "quality") -> Attention | None:
    """Fit on at most ``train_docs`` labelled documents that are not held out.

    The sample is the ids with the smallest seeded hash, so it is bounded, random and the
    same in reruns.  Only passage features of the sample come to the driver.  NULL ids and
    labels other than 0 and 1 teach nothing.  With labels of one kind only, or none, there
    is nothing to learn: None.
    """
    key = F.col(doc_id).cast("string")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("k")))
    wanted = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
        .select(key.alias("k"), F.col(label).cast("int").alias("y")).groupBy("k").agg(F.max("y").alias("y"))
        .withColumn("o", order).orderBy("o").limit(train_docs)
    )
    sample = (
        docs.select(key.alias("k"), F.col(text).alias("text")).join(F.broadcast(wanted), "k")
        .orderBy("o", F.xxhash64("text")).limit(train_docs).select("o", "y", "text")
    )

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, bounds, data in utf8_blocks(part.column(2)):
                x, bag = passages(data, bounds)
                n = bounds.size - 1
                cells = [x[a:b].astype(np.float32).tobytes() for a, b in zip(bag[:-1], bag[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.slice(row, n).columns[:2], pa.array(cells, pa.binary())], names=["o", "y", "x"])

    rows = sorted(sample.mapInArrow(encode, "o string, y int, x binary").collect())
    if len({r["y"] for r in rows}) < 2:
        return None
    y = np.array([r["y"] for r in rows], dtype=np.float32)
    bag = np.concatenate([[0], np.cumsum([len(r["x"]) // (4 * WIDTH) for r in rows])])
    x = np.frombuffer(b"".join([r["x"] for r in rows]), dtype=np.float32).reshape(-1, WIDTH).copy()
    rows.clear()
    return fit_attention(x, bag, y)


def score_quality(docs: DataFrame, model: Attention | None, text: str = "text", keep: Sequence[str] = ("*",)) -> DataFrame:
    """(row, score): the ``keep`` columns of every row as a struct, and its score from 0 to 1.

    Only the text enters a score.  NULL and empty texts are one passage of zeros and get
    the score of that.  Without a model every score is 0.5.
    """

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(1) if own else part.column(0).flatten()[place]
            for row, bounds, data in utf8_blocks(texts, 1_000_000):
                n = bounds.size - 1
                if model is None:
                    score = np.full(n, 0.5)
                else:
                    score = model.forward(*passages(data, bounds))["score"].astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(row, n), pa.array(score)], names=["row", "score"])

    wide = docs.select(F.struct(*keep).alias("row"))
    names = wide.schema["row"].dataType.fieldNames()
    # a text that is among the kept columns goes to Python once
    own = text not in names or not isinstance(docs.schema[text].dataType, T.StringType)
    place = -1 if own else names.index(text)
    if own:
        wide = docs.select(F.struct(*keep).alias("row"), F.col(text).cast("string").alias("text"))
    return wide.mapInArrow(work, T.StructType([wide.schema["row"], T.StructField("score", T.DoubleType())]))
