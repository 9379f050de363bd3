"""Licence scans: a trained paragraph classifier confirmed by templates (native)."""

from __future__ import annotations

import functools
import math
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.license_texts import OTHER, OTHER_HELD_OUT, TEMPLATES
from recollect.session import Cut

#: Word n-grams of 1 to this length are features.
ORDER = 3
UNKNOWN = "unknown"
#: Share of a template sentence's n-grams that a paragraph must hold to confirm its family.
CONFIRM = 0.8
#: What every template sentence holds one of, and so every paragraph that can be confirmed.
ANCHOR = r"(?i)licen[cs]|copyright|rights|permi(?:ssion|tted)|public domain|creative commons|warrant|redistribut|proprietary|confidential|reproduc|\bCC(?:0| BY)|\bas[ -]is\b|liable|\bth(?:e|is) software"
#: Where sentences end, and line breaks that only wrap (the next line's comment mark goes with them).
SENTENCE, WRAP = r"(?<=[.!?])\s+", r"(?<![.!?:;\s])[ \t]*\r?\n[ \t]*(?:(?:[*#;%]+|//+|--+)[ \t]+)?(?=[^\s*#;%/-])"


#: A declared identifier, or an expression of several: what it says is taken as said.
_ID = r"[A-Za-z0-9][A-Za-z0-9.+-]*+"
TAG = rf"(?:SPDX-License-Identifier|(?i:licen[cs]e(?:-expression)?))[\"']?\s*[:=]\s*[\"']?(\(*\s*{_ID}(?:\)*\s+(?:AND|OR|WITH)\s+\(*\s*{_ID})*)"
#: Identifiers by family: fixed values. Others name no family here.
IDENTIFIERS = {
    "mit": r"MIT(?:-0)?", "apache-2.0": r"Apache-2\.0", "gpl": r"GPL-[123](?:\.\d)?(?:-only|-or-later|\+)?", "lgpl": r"LGPL-[23](?:\.\d)?(?:-only|-or-later|\+)?", "agpl": r"AGPL-[13](?:\.\d)?(?:-only|-or-later|\+)?",
    "bsd": r"0BSD|BSD-[1-4]-Clause(?:-[A-Za-z-]+)?", "mpl-2.0": r"MPL-2\.0(?:-no-copyleft-exception)?", "epl": r"EPL-[12]\.0", "isc": r"ISC", "zlib": r"Zlib", "boost": r"BSL-1\.0", "unlicense": r"Unlicense",
    "cc-by": r"CC-BY-\d\.\d", "cc-by-sa": r"CC-BY-SA-\d\.\d", "cc-by-nc": r"CC-BY-NC-\d\.\d", "cc0": r"CC0-1\.0",
}
#: What restricts or extends a licence of attribution, by name or sign; a family has just its own ones.
TERMS = {"nd": r"(?i:\bno[ -]?deriv(?:ative)?s?\b)|[ -]ND\b", "nc": r"(?i:\bnon[ -]?commercial\b)|[ -]NC\b", "sa": r"(?i:\bshare[ -]?alike\b)|[ -]SA\b"}
FAMILY_TERMS = {"cc-by": 0, "cc-by-sa": 4, "cc-by-nc": 2}
#: Other licences of the same maker, whose names hold the name of the first.
OTHER_GNU = r"(?i)\b(?:lesser|library|affero)\s+(?:GNU\s+)?general\s+public\s+licen[cs]e\b|\b[LA]GPL"
GNU = r"(?i)\bgeneral\s+public\s+licen[cs]e\b|\bGPL"


def terms(text: Column) -> Column:
    """A number that tells which TERMS a paragraph has (1, 2, 4), and whether it names only the other GNU licences (8)."""
    own = F.when(text.rlike(OTHER_GNU) & ~F.regexp_replace(text, OTHER_GNU, " ").rlike(GNU), 8).otherwise(0)
    return sum((F.when(text.rlike(p), 1 << i).otherwise(0) for i, p in enumerate(TERMS.values())), own)


def contradicted(family: Column, found: Column) -> Column:
    """Whether the terms of a paragraph are not those of the family that it is most like."""
    out = (family == "gpl") & found.bitwiseAND(F.lit(8)).cast("boolean")
    for name, own in FAMILY_TERMS.items():
        out = out | ((family == name) & (found.bitwiseAND(F.lit(7)) != own))
    return out


def declared(paragraphs: DataFrame) -> DataFrame:
    """``(doc_id, tk, paragraph, family)`` of the identifiers that paragraphs declare, one row for each family named."""
    said = F.regexp_extract_all("text", F.lit(TAG), F.lit(1))
    # what follows WITH is an exception to a licence
    plain = F.transform(said, lambda e: F.regexp_replace(e, rf"\sWITH\s+\(*\s*{_ID}", ""))
    ids = F.filter(F.flatten(F.transform(plain, lambda e: F.split(e, r"[()\s]+"))), lambda i: ~i.isin("", "AND", "OR"))
    family = F.lit(None).cast("string")
    for name, pattern in IDENTIFIERS.items():
        family = F.when(F.col("id").rlike(f"^(?i:{pattern})$"), name).otherwise(family)
    rows = paragraphs.where(F.col("text").rlike(TAG)).select("doc_id", "tk", "paragraph", F.explode(F.array_distinct(ids)).alias("id"))
    return rows.select("doc_id", "tk", "paragraph", family.alias("family")).where("family is not null").distinct()


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def anchored(paragraph: str) -> str:
    """The sentences that can be of a licence."""
    return " ".join(s for s in re.split(SENTENCE, paragraph) if re.search(ANCHOR, s))


def ngrams(tokens: list[str]) -> set[str]:
    return {" ".join(tokens[i : i + n]) for n in range(1, ORDER + 1) for i in range(len(tokens) - n + 1)}


def template_sentences() -> list[tuple[str, list[str]]]:
    """(family, n-grams) of each sentence by which a family is confirmed."""
    return [(family, sorted(ngrams(words(s)))) for family, texts in TEMPLATES.items() for t in texts for s in re.split(SENTENCE, t) if re.search(ANCHOR, s)]


@dataclass
class Model:
    """``weights[ngram]`` by class; classes end with UNKNOWN. ``scale`` and ``shift`` calibrate the unknown class."""

    classes: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    scale: float = 1.0
    shift: float = 0.0

    def probabilities(self, text: str) -> list[float]:
        z = list(self.bias)
        for g in sorted(ngrams(words(anchored(text))) & self.weights.keys()):
            z = [a + b for a, b in zip(z, self.weights[g])]
        z = [self.scale * x for x in z]
        z[-1] += self.shift
        top = max(z)
        e = [math.exp(x - top) for x in z]
        return [x / sum(e) for x in e]


def _examples(rng: random.Random, other: list[str], copies: int):
    """Notices with words lost or added around them, some sentences only or several paragraphs; and texts of no licence."""
    filler = [w for t in other for w in words(t)]
    for family, texts in TEMPLATES.items():
        parts = [s for t in texts for s in re.split(SENTENCE, t) if re.search(ANCHOR, s)]
        for t in texts + parts:
            for k in range(copies):
                w = words(t if k < 2 or rng.random() < 0.7 else t + " " + rng.choice(parts))
                lost = [x for x in w if k == 0 or rng.random() > 0.08]
                around = [rng.choice(filler) for _ in range(rng.randrange(0, 12) if k else 0)]
                at = rng.randrange(len(around) + 1)
                yield family, ngrams(around[:at] + lost + around[at:])
    for t in other:
        w = words(t)
        for k in range(2 * copies):
            yield UNKNOWN, ngrams(w if k < copies else w[rng.randrange(max(1, len(w) // 3)) :])
    every = [t for texts in TEMPLATES.values() for t in texts]
    for t in every:  # the words of notices in no order grant nothing
        for _ in range(copies // 2):
            w = words(t)
            rng.shuffle(w)
            yield UNKNOWN, ngrams(w[: rng.randrange(1, max(2, len(w) // 2))])


@functools.lru_cache(maxsize=2)
def train(epochs: int = 250, rate: float = 0.3, l1: float = 2e-5, seed: int = 10) -> Model:
    """Multinomial logistic regression over word n-grams, by proximal Adagrad, whose l1 penalty leaves few weights.

    It learns from the templates and from sentences of no licence, not from the corpus, so every table and partitioning meets the same model.
    Scale and unknown's shift are then set on examples held out: templates disturbed anew, with filler and unknown texts that training never saw.
    """
    classes = [*TEMPLATES, UNKNOWN]
    k = len(classes)
    vocabulary = sorted({g for texts in TEMPLATES.values() for t in texts for g in ngrams(words(t))})
    at = {g: i for i, g in enumerate(vocabulary)}

    def matrix(examples):
        rows = [(classes.index(c), [at[g] for g in sorted(grams & at.keys())]) for c, grams in examples]
        x = np.zeros((len(rows), len(vocabulary) + 1), dtype=np.float32)
        for i, (_, grams) in enumerate(rows):
            x[i, grams] = 1.0
        x[:, -1] = 1.0
        return x, np.array([y for y, _ in rows])

    x, y = matrix(_examples(random.Random(seed), OTHER, 8))
    weight = np.float32(1.0) / np.bincount(y, minlength=k)[y].astype(np.float32)
    weight *= len(y) / weight.sum() / len(y)
    target = np.eye(k, dtype=np.float32)[y]
    w, square = np.zeros((x.shape[1], k), dtype=np.float32), np.full((x.shape[1], k), 1e-6, dtype=np.float32)
    damp = np.float32(1.0) / np.sqrt(1.0 + x.sum(axis=0))[:, None]
    for _ in range(epochs):
        z = x @ w
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = (z / z.sum(axis=1, keepdims=True) - target) * weight[:, None]
        g = x.T @ d
        square += g * g
        step = rate * np.maximum(damp, 0.1) / np.sqrt(square)
        w -= step * g
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - step[:-1] * l1, 0.0)
    hx, hy = matrix(_examples(random.Random(seed + 1), OTHER_HELD_OUT, 4))
    z, share = hx @ w, 1.0 / np.bincount(hy, minlength=k)[hy]

    def loss(scale, shift):
        s = scale * z + shift * (np.arange(k) == k - 1)
        top = s.max(axis=1)
        return float((share * (top + np.log(np.exp(s - top[:, None]).sum(axis=1)) - s[np.arange(len(hy)), hy])).sum())

    scale, shift = min(((a, b) for a in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0) for b in np.arange(-3.0, 3.1, 0.5).tolist()), key=lambda p: loss(*p))
    kept = {g: [round(float(v), 6) for v in w[i]] for g, i in at.items() if np.abs(w[i]).max() > 0}
    return Model(classes, kept, [round(float(v), 6) for v in w[-1]], scale, shift)


def tokens(text: Column) -> Column:
    """The words of a lower-cased text, as ``words`` has them."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _ngrams(name: str) -> Column:
    """All n-grams of the word array ``name``, as ``ngrams`` has them."""
    size, parts = F.size(name), [F.col(name)]

    def joined(n: int):
        return lambda i: F.array_join(F.slice(name, i, n), " ")

    for n in range(2, ORDER + 1):
        starts = F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1)))
        parts.append(F.when(size >= n, F.transform(starts, joined(n))).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text: lines, joined where a line ends in mid-sentence and no blank line follows."""
    return F.split(F.regexp_replace(text, WRAP, " "), r"\r?\n")


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, paragraph, family, probability, coverage, confirmed)`` for each paragraph and licence family found in it.

    Every text is split into paragraphs (see ``paragraphs``; numbered from 0). A paragraph is judged by its sentences that
    hold an ANCHOR, as all template sentences do; the others can neither be a notice nor confirm one. Their n-grams
    that the model or a template knows (a fixed number, broadcast) are found by one join, summed by paragraph, and a softmax with the calibrated unknown
    class decides. Paragraphs of which unknown is not the likeliest class are returned. ``coverage`` is the largest share of
    a template sentence of that family whose n-grams the paragraph holds; ``confirmed`` says that it reaches CONFIRM and that the paragraph's
    TERMS are those of the family: a licence without derivatives is none of the families, however like one it is. Declared identifiers, of which
    an expression can hold several, name their families by themselves, with probability and coverage 1, and are not judged again; of those that
    name no family here nothing is said.

    All of it is DataFrame operations; only training, over templates, runs on the driver.
    Null and empty texts have no paragraphs. Texts of any length are read whole. Rows that repeat doc_id and text give one result. A null doc_id
    is carried along. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    model = model or train()
    k = len(model.classes)
    templates = template_sentences()
    grams = sorted(model.weights.keys() | {g for _, t in templates for g in t})
    weights = spark.createDataFrame([(g, i, model.weights.get(g, [0.0] * k)) for i, g in enumerate(grams)], "gram string, i int, w array<double>")
    at = {g: i for i, g in enumerate(grams)}
    rows = docs.where(F.col("text").rlike(ANCHOR)).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), F.posexplode(paragraphs(F.col("text"))).alias("paragraph", "text"))
    declarations = declared(rows)
    rows = rows.withColumn("text", F.regexp_replace("text", TAG, " ")).withColumn("terms", terms(F.col("text")))
    said = F.array_join(F.filter(F.split("text", SENTENCE), lambda s: s.rlike(ANCHOR)), " ")
    split = rows.where(F.col("text").rlike(ANCHOR)).select("doc_id", "tk", "paragraph", "terms", F.explode(F.array(tokens(said))).alias("t"))
    exploded = split.select("doc_id", "tk", "paragraph", "terms", F.explode(F.array_distinct(_ngrams("t"))).alias("gram"))
    found = exploded.join(F.broadcast(weights), "gram")
    sums = found.groupBy("doc_id", "tk", "paragraph", "terms").agg(F.sort_array(F.collect_set(F.struct("i", "w"))).alias("g"))  # bounded by the vocabulary
    z = F.aggregate("g", F.array(*[F.lit(float(b)) for b in model.bias]), lambda a, g: F.zip_with(a, g["w"], lambda x, y: x + y))
    z = F.transform(z, lambda x, i: x * F.lit(float(model.scale)) + F.when(i == k - 1, F.lit(float(model.shift))).otherwise(0.0))
    scored = sums.select("doc_id", "tk", "paragraph", "terms", F.explode(F.array(F.struct(F.transform("g", lambda g: g["i"]).alias("grams"), z.alias("z")))).alias("s")).select("doc_id", "tk", "paragraph", "terms", "s.grams", "s.z")
    top = F.array_max("z")
    scored = scored.select("*", F.array_position("z", top).cast("int").alias("at"), (1.0 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("z")))).alias("probability")).where(F.col("at") < k)
    family = F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.col("at"))
    # the template sentences of the predicted family only, as numbers of their n-grams
    sentences = F.array(*[F.array(*[F.array(*[F.lit(at[g]) for g in t]) for f, t in templates if f == c] or [F.array(F.lit(-1))]) for c in model.classes])
    coverage = F.array_max(F.transform(F.element_at(sentences, F.col("at")), lambda t: F.size(F.array_intersect(F.col("grams"), t)) / F.size(t)))
    picked = scored.select("doc_id", "tk", "paragraph", family.alias("family"), "probability", coverage.alias("coverage"), "terms")
    confirmed = (F.col("coverage") >= CONFIRM) & ~contradicted(F.col("family"), F.col("terms"))
    judged = picked.select("doc_id", "tk", "paragraph", "family", F.round("probability", 6).alias("probability"), F.round("coverage", 6).alias("coverage"), confirmed.alias("confirmed"))
    # what is declared is as sure as can be; beside it a paragraph can be of one more family
    sure = declarations.select("*", F.lit(1.0).alias("probability"), F.lit(1.0).alias("coverage"), F.lit(True).alias("confirmed"))
    best = F.max_by(F.struct("probability", "coverage", "confirmed"), F.struct("confirmed", "coverage", "probability"))
    both = judged.unionByName(sure).groupBy("doc_id", "tk", "paragraph", "family").agg(best.alias("b"))
    return Cut(both.select("doc_id", "paragraph", "family", "b.probability", "b.coverage", "b.confirmed"), "licences").df
