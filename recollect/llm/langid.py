"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import fold

#: Character n-grams of 1 to this length, hashed to this many features.
ORDER, FEATURES = 3, 1 << 14
#: Bound of the labelled sample that is collected for training, in rows and in characters, and rows that each language has in it at least.
SAMPLE, SAMPLE_CHARS, LEAST = 3000, 12_000_000, 50
_M = np.uint64(0x9E3779B97F4A7C15)
#: Marks belong to the letters they stand on, as vowel signs do.
_other = regex.compile(r"[^\p{L}\p{M}]+")


def term_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams over lower-cased words with a space around each, or None where the text has no letter."""
    words = _other.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, words)):
        return None
    c = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    h = c.astype(np.uint64)
    total = np.zeros(FEATURES, dtype=np.int64)
    for n in range(1, ORDER + 1):
        if n > 1:
            h = h[:-1] * _M + c[n - 1 :]
        slot = ((h + np.uint64(n)) * _M) >> np.uint64(50)
        total += np.bincount(slot.astype(np.int64), minlength=FEATURES)
    return total


@dataclass
class Model:
    """Weights by feature and class; ``temperature`` divides the logits."""

    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str | None) -> np.ndarray | None:
        tf = term_counts(text)
        if tf is None:
            return None
        x = np.log1p(tf) * self.idf
        norm = np.sqrt(x @ x)
        return x / norm if norm else x

    def predict(self, text: str | None) -> tuple[str, float]:
        x = self.vector(text)
        if x is None or not self.classes:
            return "und", 0.0
        z = (x @ self.weights + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.classes[k], float(p[k])


def train(texts: list[str], langs: list[str], calibrate: list[bool], weight: dict[str, float] | None = None, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001, seed: int = 8) -> Model:
    """Follow-the-regularised-leader with per-coordinate rates and elastic-net penalties, then a temperature.

    Rows marked in ``calibrate`` set the temperature (all rows do, if none is marked) and no weight. ``weight`` says how many rows of all
    a language's row stands for, 1 by default: it shifts that language's bias and counts in the temperature's choice.
    """
    classes = sorted(set(langs))
    k = len(classes)
    weight = weight or {}
    number = {c: i for i, c in enumerate(classes)}
    sparse: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    df = np.zeros(FEATURES)
    for i, t in enumerate(texts):  # kept sparse: dense counts of the sample would take hundreds of MB
        tf = term_counts(t)
        if tf is not None:
            at = np.nonzero(tf)[0].astype(np.int32)
            sparse[i] = (at, np.log1p(tf[at]).astype(np.float32))
            df[at] += 1
    rows = list(sparse)
    model = Model(classes, np.log((1 + len(rows)) / (1 + df)) + 1.0, np.zeros((FEATURES, k)), np.zeros(k))
    for i, (at, x) in sparse.items():
        x = x * model.idf[at]
        sparse[i] = (at, (x / np.sqrt(x @ x)).astype(np.float32))
    fit = [i for i in rows if not calibrate[i]] or rows
    rest = [i for i in rows if calibrate[i]] or rows
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))
    rng = np.random.Generator(np.random.PCG64(seed))

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(z[at]) <= l1] = 0.0
        return w

    for _ in range(max(epochs, 2000 // max(1, len(fit)))):  # few rows need more turns
        for i in rng.permutation(np.array(fit, dtype=np.int64)) if fit else []:
            at, x = sparse[int(i)]
            at, x = np.r_[at, FEATURES], np.r_[x, 1.0]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[number[langs[int(i)]]] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(FEATURES + 1))
    model.weights, model.bias = w[:-1], w[-1] + np.log([weight.get(c, 1.0) for c in classes])
    if rest and k > 1:
        logits = np.array([sparse[i][1] @ model.weights[sparse[i][0]] + model.bias for i in rest])
        truth = np.array([number[langs[i]] for i in rest])

        counts = np.array([weight.get(langs[i], 1.0) for i in rest])

        def loss(t):
            s = logits / t
            s = s - s.max(axis=1, keepdims=True)
            return float(((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(rest)), truth]) * counts).sum())

        model.temperature = float(min(np.exp(np.linspace(np.log(0.05), np.log(5), 80)), key=loss))
    return model


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on a sample outside fold 0 with text and lang, chosen by a hash of doc_id; fold 1 calibrates.

    Each language has an equal share of ``sample`` rows, or LEAST, or all it has, so that none is lost however rare; its rows
    then count as its share of all labelled rows says.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    known = known.where(fold(F.col("doc_id")) != 0)
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("chars")).collect()
    each = max(LEAST, sample // max(1, len(sizes)))
    span, chosen = 1 << 24, F.lit(False)
    for r in sizes:
        share = min(1.0, each / r["n"], max(LEAST / r["n"], SAMPLE_CHARS / len(sizes) / max(1.0, r["n"] * r["chars"])))
        chosen = chosen | ((F.col("lang") == r["lang"]) & (F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(span)) < int(share * span) + (share == 1.0)))
    rows = known.where(chosen).select("text", "lang", (fold(F.col("doc_id")) == 1).alias("c"), "doc_id").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    total, drawn = sum(r["n"] for r in sizes), Counter(r["lang"] for r in rows)
    weight = {r["lang"]: r["n"] / total * len(rows) / drawn[r["lang"]] for r in sizes if drawn[r["lang"]]}
    return train([r["text"] for r in rows], [r["lang"] for r in rows], [r["c"] for r in rows], weight)


def _predicted(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            got = [model.predict(t) for t in batch.columns[-1].to_pylist()]
            added = pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, keep: list[str], model: Model | None = None) -> DataFrame:
    """The ``keep`` columns of every row with ``lang_pred`` and ``score``.

    The model sees the whole text: tf-idf of hashed character n-grams over
    letters and word edges, a linear layer, and a calibrated softmax whose largest probability is the score. Without
    ``model`` one is trained on the table itself (see ``fit``). Null texts, texts
    without a letter, and all texts if nothing could be learned, get ``und`` and 0.
    Rows with null doc_id or lang are predicted but never learned from; repeated rows
    get equal results; incoming columns named lang_pred or score are replaced; columns other than text, lang and doc_id play no part; an empty table gives an empty result.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    rows = docs.select(*keep, F.col("text").alias("_scored"))
    return rows.mapInArrow(_predicted(shared), schema + "lang_pred string, score double")
