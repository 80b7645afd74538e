"""Toxicity by multiple-instance learning: documents are bags of sentences.

A sentence's probability is the logistic of a bias and the weights of its distinct
words' features. A document's is the noisy-or of its sentences, 1 - prod(1 - p): one bad sentence
is enough. Only documents carry labels; the gradient of the bag's likelihood shares them
out among the sentences, which is what then locates the offending ones.

The model is fitted in one task on a bounded sample of labelled documents (``SAMPLE``
of each label, by hash of the id); it has at most ``FEATURES`` features and goes to all tasks.
Features are the words and their beginnings, chosen by how much a document's having them
tells about its label.

Defined cases: null and empty texts have no sentence and score 0; null labels are not
learnt from, of repeated labels the largest counts; a null id is not held out; with no
labels or labels of one kind all scores come from the bias alone; equal rows score
alike. Neither ids, languages, sources nor labels enter a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.columns import as_text
from textloom.plans.workdir import materialize, ship_package

SAMPLE = 4000            # documents of each label that the model is fitted on
FEATURES = 1500          # features with a weight: those whose presence tells most about the label
FEWEST_DOCS = 4          # documents of the sample that a feature must be in
PREFIXES = (4, 5, 6)     # beginnings of words that are features too: compounds and inflections
STEPS = 250
KEPT_WORDS = 800_000     # tokens whose weight a Python worker remembers
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
SPOKEN = re.compile(r"[^\W\d_][^.!?\n]*")  # one match in each sentence that has a word
LEAST_DEVIATION = 2.0    # of a feature's share in toxic documents from that in clean ones
LEAST_WEIGHT = 0.2       # smaller ones are left out of the model
OFFENDING = 0.3


def features_of(token: str) -> list[str]:
    """The runs of letters in a token of a text, and their beginnings."""
    return [f for word in WORD.findall(token)
            for f in (word, *[f"{word[:n]}*" for n in PREFIXES if len(word) > n])]


def sentences(text: str) -> list[set[str]]:
    """The distinct tokens of each sentence that has a word."""
    return [set(part.split()) for part in SENTENCE.findall(lower(text)) if WORD.search(part)]


def lower(text: str) -> str:
    """Lower case that keeps the place of every character."""
    lowered = text.lower()
    if len(lowered) == len(text):
        return lowered
    return "".join([c.lower() if len(c.lower()) == 1 else c for c in text])


@dataclass
class Model:
    bias: float
    weights: dict[str, float]

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return {"bias": self.bias, "weights": self.weights, "known": {}}

    def weight(self, token: str) -> float:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        found = sum(self.weights.get(f, 0.0) for f in features_of(token))
        self.known[token] = found
        return found

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and (start, end, probability) of offending sentences."""
        low = lower(text)
        known, weight = self.known, self.weight
        # Most texts have no word of weight: their sentences are only counted.
        hits = any([known[w] if w in known else weight(w) for w in set(low.split())])
        plain, clean, offending, best = len(SPOKEN.findall(low)), 0.0, [], None
        for m in SENTENCE.finditer(low) if hits else ():
            z = sum([known[w] if w in known else weight(w) for w in set(m.group().split())])
            if not z:
                continue
            plain -= 1
            z += self.bias
            clean -= math.log1p(math.exp(-abs(z))) + max(z, 0.0)
            found = (m.start(), m.end(), 1 / (1 + math.exp(-z)))
            if found[2] >= OFFENDING:
                offending.append(found)
            best = max(best or found, found, key=lambda f: f[2])
        clean -= plain * math.log1p(math.exp(self.bias))
        whole = -math.expm1(clean)
        # Several doubtful sentences make a bad document: the likeliest stands for them.
        return whole, [best] if best and not offending and whole >= OFFENDING else offending


def chosen_features(bags: list[list[set[str]]], toxic: list[int], most: int = FEATURES) -> list[str]:
    """The features whose presence in a document deviates most between the labels."""
    counts: dict[str, list[int]] = {}
    for bag, y in zip(bags, toxic):
        for f in {f for w in set().union(*bag) for f in features_of(w)}:
            counts.setdefault(f, [0, 0])[y] += 1
    n1 = max(1, sum(toxic))
    n0 = max(1, len(toxic) - n1)

    def deviation(c):
        share = (c[0] + c[1] + 1) / (n0 + n1 + 2)
        return (c[1] / n1 - c[0] / n0) / (share * (1 - share) * (1 / n1 + 1 / n0)) ** 0.5

    told = sorted(((deviation(c), f) for f, c in counts.items() if sum(c) >= FEWEST_DOCS), reverse=True)
    return [f for d, f in told[:most] if d > LEAST_DEVIATION]


def fit(texts: list[str], toxic: list[int], steps: int = STEPS, rate: float = 0.1,
        decay: float = 1e-5) -> Model:
    """Maximum likelihood of the noisy-or by Adam, over all sentences at once."""
    bags = [sentences(t) for t in texts]
    names = chosen_features(bags, toxic)
    index = {f: i for i, f in enumerate(names)}
    features, owner, bag_of = [], [], []
    for b, bag in enumerate(bags):
        for sentence in bag:
            own = [index[f] for w in sentence for f in features_of(w) if f in index]
            features += own
            owner += [len(bag_of)] * len(own)
            bag_of.append(b)
    features, owner, bag_of = np.array(features, np.int64), np.array(owner, np.int64), np.array(bag_of, np.int64)
    y = np.array(toxic, np.float64)
    theta = np.zeros(len(names) + 1)
    theta[-1] = -7.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1 if len(bag_of) else 1):
        z = theta[-1] + np.bincount(owner, theta[features], len(bag_of))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        clean = np.bincount(bag_of, -np.logaddexp(0.0, z), len(y))
        whole = np.clip(-np.expm1(clean), 1e-9, 1.0)
        # Of a toxic bag each sentence is to blame by its share; of a clean one each in full.
        slope = p * np.where(y[bag_of] > 0, (1 - whole[bag_of]) / whole[bag_of], -1.0)
        grad = np.append(np.bincount(features, slope[owner], len(names)), slope.sum()) / max(1, len(y))
        grad[:-1] -= decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Model(float(theta[-1]), {f: float(theta[i]) for i, f in enumerate(names) if abs(theta[i]) >= LEAST_WEIGHT})


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of a sample of the labelled rows that are not held out."""
    spark = docs.sparkSession
    ship_package(spark)
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
             .groupBy(F.col(id_col).alias("l_id")).agg(F.max(label_col).cast("int").alias("y")))
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("l_id"), "l_id").limit(sample) for y in (1, 0)]
    chosen = materialize(chosen[0].unionByName(chosen[1]), "toxic-sample")
    # At most 2 * sample ids of 12 bytes: a proven bound.
    texts = docs.select(F.col(id_col).alias("d_id"), as_text(text_col).alias("text")).join(
        F.broadcast(chosen), F.col("d_id") == F.col("l_id")).select("l_id", "y", "text")
    # A repeated id counts once.
    texts = texts.groupBy("l_id", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(),
                                                b.column(2).to_pylist())]
        rows.sort(key=lambda r: r[0])
        model = fit([r[2] for r in rows], [r[1] for r in rows])
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *model.weights], pa.string()),
             pa.array([model.bias, *model.weights.values()], pa.float64())], ["word", "weight"])

    fitted = materialize(texts.coalesce(1).mapInArrow(run, "word string, weight double"), "toxic-model").collect()
    return Model(next((r["weight"] for r in fitted if r["word"] is None), -8.0),
                 {r["word"]: r["weight"] for r in fitted if r["word"] is not None})


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, offending): the probability, and the sentences' spans and probabilities."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.score(t.as_py()) for t in batch.column(1)]
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in f[1]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array(spans, span)],
                ["id", "score", "offending"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), as_text(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, score double, offending array<struct<start:int,end:int,score:double>>")
            .withColumnRenamed("id", id_col))
