"""Document quality by gated-attention multiple-instance learning.

A document is a bag of passages of 64 words, over its whole text.  Each passage
is encoded (shares of byte classes, repetition, word shape, hashed byte pairs,
then a learned layer); gated attention, learned from document labels alone,
weighs the passages, and the weighted mean is scored by a logistic unit (Ilse,
Tomczak and Welling, 2018).

Fitting uses at most `sample_rows` labelled documents, the first in the order
of a hash of the id, with at most `sample_passages` passages together, and runs
on the driver; scoring covers every document.  A document with more than a
hundredth of `sample_passages` is fitted by so many of its passages, spaced
evenly over the whole text, so that no long text takes the place of the others.  An id with several texts counts once, with
the smallest bag.
Only the text is ever an input of a score.

A null or empty text is one passage without words and gets that passage's
score.  A null id is never held out and never has a label.  Labels that
disagree count as their mean, rounded up at one half.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import ready

PASSAGE_WORDS = 64
PAIR_BUCKETS = 32


def _classes() -> tuple[np.ndarray, int]:
    """A class for each byte value: letters, digits, blanks, marks by kind, and bytes of longer characters."""
    out = np.full(256, 0, np.uint8)
    groups = [range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r\x0b\x0c", b".", b",", b"!", b"?;:", b"|", b"$%&*#@", b"'\"`", b"()[]{}<>", b"-_/\\=+~^", range(128, 192), range(192, 256)]
    for i, group in enumerate(groups, 1):
        out[list(group)] = i
    return out, len(groups) + 1


CLASS_OF, N_CLASSES = _classes()
#: Byte classes, then share of distinct words, of words like the one before, mean word length, log of words, pairs.
N_FEATURES = N_CLASSES + 4 + PAIR_BUCKETS


def passages(text: str | None) -> np.ndarray:
    """A row of features for each passage of the whole text, at least one row."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = max(1, -(-len(words) // PASSAGE_WORDS))
    out = np.zeros((n, N_FEATURES), np.float32)
    if not words:
        return out
    raw = np.frombuffer(data, np.uint8)
    kind = CLASS_OF[raw]
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts = ~blank
    starts[1:] &= blank[:-1]
    at = np.maximum(np.cumsum(starts) - 1, 0) // PASSAGE_WORDS
    counts = np.bincount(at * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    size = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    out[:, :N_CLASSES] = counts / size
    pair = (raw[:-1].astype(np.uint32) * 257 + raw[1:]) * np.uint32(2654435761) >> np.uint32(27)
    out[:, -PAIR_BUCKETS:] = np.bincount(at[1:] * PAIR_BUCKETS + pair, minlength=n * PAIR_BUCKETS).reshape(n, -1) / size
    for i in range(n):
        part = words[i * PASSAGE_WORDS : (i + 1) * PASSAGE_WORDS]
        out[i, N_CLASSES] = len(set(part)) / len(part)
        out[i, N_CLASSES + 1] = sum(map(bytes.__eq__, part, part[1:])) / len(part)
        out[i, N_CLASSES + 2] = sum(map(len, part)) / len(part) / 10
        out[i, N_CLASSES + 3] = np.log1p(len(part)) / 4
    return out


def spaced(bag: np.ndarray, most: int) -> np.ndarray:
    """The rows of a bag, or `most` of them, evenly spaced."""
    return bag if len(bag) <= most else bag[np.arange(most) * len(bag) // most]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class GatedAttention:
    """Encoder, gated attention and logistic head, with their gradients, in numpy."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, hidden: int = 24, gates: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, std
        draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
        self.p = {
            "W": draw(len(mean), hidden), "b": np.zeros(hidden), "V": draw(hidden, gates), "U": draw(hidden, gates),
            "w": draw(gates, 1)[:, 0], "c": draw(hidden, 1)[:, 0], "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """x: passages of all bags, one after another; starts: where each bag begins."""
        p, sizes = self.p, np.diff(np.append(starts, len(x)))
        x = (x.astype(np.float64) - self.mean) / self.std
        h = np.tanh(x @ p["W"] + p["b"])
        tan, gate = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (tan * gate) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"x": x, "h": h, "tan": tan, "gate": gate, "a": a, "z": z, "sizes": sizes, "score": _sigmoid(z @ p["c"] + p["d"])}

    def gradients(self, f: dict[str, np.ndarray], starts: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        p, n = self.p, len(y)
        at = lambda v: np.repeat(v, f["sizes"], axis=0)
        by_logit = (f["score"] - y) / n
        by_z = by_logit[:, None] * p["c"]
        inner = (at(by_z) * f["h"]).sum(axis=1)
        by_e = f["a"] * (inner - at(np.add.reduceat(f["a"] * inner, starts)))
        by_gated = by_e[:, None] * p["w"]
        by_tan = by_gated * f["gate"] * (1 - f["tan"] ** 2)
        by_gate = by_gated * f["tan"] * f["gate"] * (1 - f["gate"])
        by_h = at(by_z) * f["a"][:, None] + by_tan @ p["V"].T + by_gate @ p["U"].T
        by_in = by_h * (1 - f["h"] ** 2)
        out = {"W": f["x"].T @ by_in, "b": by_in.sum(axis=0), "V": f["h"].T @ by_tan, "U": f["h"].T @ by_gate, "w": (f["tan"] * f["gate"]).T @ by_e, "c": f["z"].T @ by_logit, "d": by_logit.sum(keepdims=True)}
        return {k: g + decay * p[k] for k, g in out.items()}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, steps: int = 2000, batch: int = 128, rate: float = 0.005, decay: float = 1e-5, seed: int = 11) -> None:
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        while step < steps:
            order = rng.permutation(len(bags))
            for i in range(0, len(order), batch):
                own = [bags[j] for j in order[i : i + batch]]
                starts = np.cumsum([0, *map(len, own)])[:-1]
                f = self.forward(np.concatenate(own), starts)
                step += 1
                for k, g in self.gradients(f, starts, y[order[i : i + batch]], decay).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    pace = rate * (0.5 + 0.5 * np.cos(np.pi * min(1, step / steps)))
                    self.p[k] = self.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 4000, sample_passages: int = 400_000) -> GatedAttention | None:
    """A model from at most sample_rows labelled, not held-out documents, the first whose passages fit; None if no label can be used."""
    most = max(1, sample_passages // 100)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [spaced(passages(x.as_py()), most).astype(np.float16) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary()), batch.column(2)], ["id", "bag", "y"])

    ready(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("__id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("__y"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    bags = texts.join(F.broadcast(chosen), "__id").select("__id", "__text", "__y").mapInArrow(encode, "id long, bag binary, y int")
    bags = bags.groupBy("id", "y").agg(F.min("bag").alias("bag"))  # sample_rows rows at most from here on
    before = F.sum(F.length("bag") / (2 * N_FEATURES)).over(W.orderBy(F.xxhash64("id"), "id").rowsBetween(W.unboundedPreceding, 0))
    rows = bags.withColumn("passages", before).where(F.col("passages") <= sample_passages).drop("passages").toArrow()
    if not len(rows):
        return None
    rows = rows.to_pandas().sort_values(["id", "bag"])
    bags = [np.frombuffer(b, np.float16).astype(np.float32).reshape(-1, N_FEATURES) for b in rows["bag"]]
    flat = np.concatenate(bags)
    model = GatedAttention(flat.mean(axis=0, dtype=np.float64), flat.std(axis=0, dtype=np.float64) + 1e-3)
    model.fit(bags, rows["y"].to_numpy(np.float64))
    return model


def score(docs: DataFrame, model: GatedAttention | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a double column `out` from 0 to 1; 0.5 throughout without a model."""
    if model is None:
        return docs.withColumn(out, F.lit(0.5))

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        found = []
        for at in range(0, len(texts), 500):
            bags = [passages(x) for x in texts.iloc[at : at + 500]]
            found.append(model.forward(np.concatenate(bags), np.cumsum([0, *map(len, bags)])[:-1])["score"])
        return pd.Series(np.concatenate(found) if found else np.empty(0))

    return docs.withColumn(out, run(F.col(text_col).cast("string")))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """docs with held_out, score and predicted (1 from the threshold up)."""
    model = fit(docs, labels, id_col, text_col, **options)
    scored = score(docs, model, text_col).withColumn("held_out", held_out(id_col))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
