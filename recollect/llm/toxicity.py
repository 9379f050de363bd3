"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or."""

from __future__ import annotations

import math
import re
import sys
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import fold

#: Bounds of the labelled sample that is collected for training: rows of each label, and characters in all.
SAMPLE, SAMPLE_CHARS = 2500, 16_000_000
#: A stretch without sentence marks is cut into sentences of so many words.
LONGEST = 25
#: Lengths of the word beginnings that are features beside the words; stems carry the meaning of inflected forms.
STEMS = range(4, 9)
_token = re.compile(r"[^\W_]+|[.!?\n]+")
_marks = frozenset(".!?\n")


def sentences(text: str | None) -> list[tuple[int, int, set[str]]]:
    """Start, end and distinct lower-cased words of each sentence that has a word."""
    out, words, first, last, n = [], set(), 0, 0, 0
    for m in _token.finditer(text or ""):
        w = m.group()
        if w[0] in _marks or n == LONGEST:
            if n:
                out.append((first, last, words))
            words, n = set(), 0
        if w[0] not in _marks:
            if not n:
                first = m.start()
            words.add(sys.intern(w.lower()))
            n += 1
            last = m.end()
    if n:
        out.append((first, last, words))
    return out


def features(word: str) -> list[str]:
    """The word, and its beginnings where it goes on."""
    return [word, *[word[:k] + "*" for k in STEMS if k < len(word)]]


@dataclass
class Model:
    """A sentence's logit is ``bias`` plus, for each of its distinct words, the weights of that word's features."""

    weights: dict[str, float]
    bias: float
    known: dict[str, float] = field(default_factory=dict)

    def word(self, w: str) -> float:
        got = self.known.get(w)
        if got is None:
            got = sum(self.weights.get(f, 0.0) for f in features(w))
            if len(self.known) < 200_000:  # only saves time
                self.known[w] = got
        return got

    def scored(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or over the sentences (0 without any), and start, end and logit of each sentence."""
        got = [(s, e, self.bias + math.fsum(map(self.word, words))) for s, e, words in sentences(text)]
        if not got:
            return 0.0, []
        z = np.array([x[2] for x in got])
        return float(-np.expm1(-np.logaddexp(0.0, z).sum())), got


def train(texts: list[str], labels: list[int], share: float, least_docs: int = 5, rounds: int = 300, rate: float = 0.3, l1: float = 2e-4) -> Model:
    """Fit sentence weights to document labels through the noisy-or.

    ``share`` is the part of toxic rows among all; documents are weighted so
    that the sample stands for it. With S the sum of softplus(logit) over sentences, a document
    is clean with probability exp(-S), so the loss is S for a clean and -log(1 - exp(-S)) for a toxic one. Adagrad steps with
    soft thresholding keep only words that matter. Features of fewer than ``least_docs`` documents get no weight.
    """
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():  # nothing to tell apart
        return Model({}, -30.0 if not len(y) or y.max() == 0 else 0.0)
    bags = [[words for _, _, words in sentences(t)] for t in texts]
    df: dict[str, int] = {}
    for b in bags:
        for f in {f for w in set().union(*b) for f in features(w)}:
            df[f] = df.get(f, 0) + 1
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in df.items() if n >= least_docs))}
    doc, word, sent, n = array("i"), array("i"), array("i"), 0
    for d, b in enumerate(bags):
        for s in b:
            doc.append(d)
            ids = [vocabulary[f] for w in sorted(s) for f in features(w) if f in vocabulary]
            word.extend(ids)
            sent.extend([n] * len(ids))
            n += 1
    doc, word, sent = (np.frombuffer(x, dtype=np.int32) for x in (doc, word, sent))
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    weight /= weight.sum()
    w, bias = np.zeros(len(vocabulary)), -6.0
    gw, gb = np.full(len(vocabulary), 1e-8), 1e-8
    for _ in range(rounds):
        z = bias + np.bincount(sent, w[word], minlength=n)
        s = np.maximum(np.bincount(doc, np.logaddexp(0.0, z), minlength=len(y)), 1e-12)
        ds = np.where(y > 0, -1.0 / np.expm1(np.minimum(s, 50.0)), 1.0) * weight
        dz = ds[doc] / (1 + np.exp(-z))
        grad = np.bincount(word, dz[sent], minlength=len(vocabulary))
        gw += grad * grad
        step = rate / np.sqrt(gw)
        w = w - step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0.0)
        gb += dz.sum() ** 2
        bias -= rate * dz.sum() / np.sqrt(gb)
    return Model({x: float(w[i]) for x, i in vocabulary.items() if w[i]}, float(bias))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on at most about ``sample`` labelled rows of each class, chosen by a hash of doc_id, outside fold 0."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("_y"))
    marks = marks.where(fold(F.col("_id")) != 0)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text")).where("_text is not null")
    known = texts.select("_id", F.length("_text").alias("_n")).join(marks, "_id")
    sizes = {r["_y"]: r for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n"), F.avg("_n").alias("chars")).collect()}
    total = sum(r["n"] for r in sizes.values())
    span, chosen = 1 << 24, F.lit(False)
    for y, r in sizes.items():
        part = min(1.0, sample / r["n"], SAMPLE_CHARS / 2 / max(1.0, r["n"] * r["chars"]))
        chosen = chosen | ((F.col("_y") == y) & (F.pmod(F.xxhash64("_id", F.lit("toxic")), F.lit(span)) < int(part * span) + (part == 1.0)))
    # the chosen ids are bounded by the sample, so that no text but theirs leaves its task
    ids = marks.where(chosen).limit(4 * sample)
    picked = texts.join(F.broadcast(ids), "_id").limit(8 * sample).toArrow().to_pylist()
    picked.sort(key=lambda r: (r["_id"], r["_text"]))
    share = sizes[1]["n"] / total if 1 in sizes else 0.0
    return train([r["_text"] for r in picked], [r["_y"] for r in picked], share)


def _scored(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            scores, found = [], []
            for t in batch.column(1).to_pylist():
                score, parts = model.scored(t)
                scores.append(score)
                # offending sentences: those likelier toxic than the prior of a sentence by far, in a document taken as toxic
                found.append([{"start": s, "end": e, "score": 1 / (1 + math.exp(-z))} for s, e, z in parts if z > model.bias + 2] if score >= 0.5 else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, _SPANS)], names=["doc_id", "score", "spans"])

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def score_toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, score, spans)`` for every row: the document's score and its offending sentences.

    Only text enters a score, a text of any length whole, sentence by sentence. Without ``model`` one is trained on labelled
    rows outside fold 0 (see ``fit``). Null and empty texts score 0 and have no
    spans; spans of a document of score 0.5 or more are places in the text with the sentence's own probability, of sentences
    whose logit exceeds the model's bias by over 2. Without any labelled row, or with one class
    only, all texts score by that class's prior. Null ids are scored and never learned from; a doc_id with several labels is
    toxic if any says so; repeated rows get equal results; other columns are ignored; an empty table gives an empty result.
    """
    model = model or fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_scored(shared), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, spans array<struct<start:int,end:int,score:double>>")
