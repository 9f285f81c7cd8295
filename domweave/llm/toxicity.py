"""Toxicity by multiple-instance learning: noisy-or over sentences, trained from document labels."""

from __future__ import annotations

import json
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domweave.llm.common import spread

#: Labelled documents of either class that the classifier is fitted on, at most.
SAMPLE = 2500
#: A document whose probability reaches this is toxic; so is a sentence.
THRESHOLD = 0.5

#: A sentence less likely than this counts for nothing in its document, so that length alone makes none toxic.
FLOOR = 0.5
#: The share of labels of either class that are taken to be wrong.
NOISE = 0.02

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (4, 5, 6)
_LEAST = math.log(FLOOR / (1 - FLOOR))


def features(word: str) -> list[str]:
    """The word itself and its proper prefixes of 4 to 6 letters."""
    return [f"={word}", *(f"{word[:k]}*" for k in _PREFIXES if len(word) > k)]


class Bags:
    """Texts as bags of sentences, and those as sets of words, all by number in flat arrays."""

    def __init__(self, texts: list[str], least_documents: int) -> None:
        words: dict[str, int] = {}
        flat, lengths, document, number = array("i"), array("i"), array("i"), Counter()
        for k, text in enumerate(texts):
            bag = {frozenset(_WORD.findall(s)) for s in _SENTENCE.findall(text.lower())} or {frozenset()}
            number.update({f for w in frozenset().union(*bag) for f in features(w)})
            for sentence in sorted(map(sorted, bag)):
                flat.extend([words.setdefault(w, len(words)) for w in sentence])
                lengths.append(len(sentence))
                document.append(k)
        self.columns = {f: k for k, f in enumerate(sorted(f for f, n in number.items() if n >= least_documents))}
        pairs = [(k, self.columns[f]) for w, k in words.items() for f in features(w) if f in self.columns]
        self.of_word, self.of_column = np.array(pairs, dtype=np.int32).reshape(-1, 2).T
        self.word, self.document = np.array(flat, dtype=np.int32), np.array(document, dtype=np.int32)
        self.sentence = np.repeat(np.arange(len(lengths), dtype=np.int32), np.array(lengths))
        self.sizes = len(words), len(lengths), len(texts)


def objective(bags: Bags, y: np.ndarray, w: np.ndarray, bias: float, noise: float = NOISE) -> tuple[float, np.ndarray, float]:
    """The negative mean log likelihood of the labels, each class with half of the weight, and its gradient by weights and bias."""
    words, sentences, texts = bags.sizes
    share = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum()))
    z = bias + np.bincount(bags.sentence, np.bincount(bags.of_word, w[bags.of_column], words)[bags.word], sentences)
    a = np.maximum(np.bincount(bags.document, np.logaddexp(0, z), texts), 1e-9)
    none = np.exp(-a)  # the chance that no sentence is toxic
    told = noise + (1 - 2 * noise) * (1 - none)
    of_a = share * (1 - 2 * noise) * none * np.where(y, -1 / told, 1 / (1 - told))
    of_z = of_a[bags.document] / (1 + np.exp(-np.maximum(z, -500)))
    of_word = np.bincount(bags.word, of_z[bags.sentence], words)
    return -float(share @ np.log(np.where(y, told, 1 - told))), np.bincount(bags.of_column, of_word[bags.of_word], len(w)), float(of_z.sum())


def fit(texts: list[str], labels: np.ndarray, epochs: int = 150, least_documents: int = 8, l1: float = 3e-4, noise: float = NOISE) -> dict[str, float]:
    """Weights by feature, and the bias at ''.

    A sentence's logit is the bias plus the weights of its words, each counted
    once; a document is toxic unless all its sentences aren't: P = 1 - prod(1 - p)
    over its distinct sentences. Labels are taken to be wrong at the rate
    `NOISE`, so that a document without any reason for its label can't bend the
    weights without bound. The likelihood of the labels is maximised by Adam with
    a proximal step for the L1 penalty, until it gains next to nothing.
    """
    bags, y = Bags(texts, least_documents), np.asarray(labels, dtype=bool)
    w, bias = np.zeros(len(bags.columns)), -4.0
    m, v, best = np.zeros(len(w) + 1), np.zeros(len(w) + 1), np.inf
    for epoch in range(1, epochs + 1):
        loss, of_w, of_bias = objective(bags, y, w, bias, noise)
        if epoch % 15 == 0:
            total = loss + l1 * np.abs(w).sum()
            if total > best - 5e-4:
                break
            best = total
        gradient = np.append(of_w, of_bias)
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        scale = 0.1 / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-4)
        step = scale * m / (1 - 0.9**epoch)
        w = w - step[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - scale[:-1] * l1, 0)
        bias = min(bias - step[-1], -2.0)
    return {"": float(bias)} | {f: round(float(w[k]), 5) for f, k in bags.columns.items() if abs(w[k]) > 1e-4}


class Scorer(dict):
    """The summed weight of each word met so far; sentences and documents are scored with it."""

    def __init__(self, model: dict[str, float], most: int = 100_000) -> None:
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        total = self[word] = sum(self.model.get(f, 0.0) for f in features(word))
        return total

    def sentences(self, text: str) -> Iterator[tuple[int, int, float, frozenset[str]]]:
        """Start, end, logit and words of each sentence. Lower-casing keeps the offsets, character by character."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        bias, find, get = self.model[""], _WORD.findall, self.__getitem__
        for s in _SENTENCE.finditer(low):
            words = frozenset(find(s.group()))
            if words:
                yield s.start(), s.end(), bias + sum(map(get, words)), words

    def probability(self, text: str | None) -> float:
        """The noisy-or of the distinct sentences that reach `FLOOR`."""
        if not text:
            return 0.0
        z = np.fromiter({x[3]: x[2] for x in self.sentences(text)}.values(), dtype=float)
        return float(-np.expm1(-np.logaddexp(0, z[z >= _LEAST]).sum()))

    def spans(self, text: str, least: float = THRESHOLD) -> list[dict]:
        """Sentences whose own probability is at least `least`; if none is, the most suspicious one."""
        found = [(a, b, 1 / (1 + np.exp(-z))) for a, b, z, _ in self.sentences(text)]
        named = [x for x in found if x[2] >= least] or sorted(found, key=lambda x: (-x[2], x[0]))[:1]
        return [{"start": a, "end": b, "probability": round(float(p), 4)} for a, b, p in named]


def training_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most `most` labelled documents of either class, the first by hash of doc_id.

    A doc_id with two labels counts as toxic if one says so; labels without a
    document, null labels and null texts are left out, and equal texts count once.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # the ids of at most 2 * most documents: the side to broadcast has a fixed size
    some = [known.where(F.col("toxic") == c).orderBy(*order).limit(most) for c in (0, 1)]
    picked = some[0].unionByName(some[1])
    texts = docs.where("text IS NOT NULL").select("doc_id", "text")
    return texts.join(F.broadcast(picked), "doc_id").select("text", "toxic").groupBy(F.xxhash64("text"), F.sha2("text", 256)).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> dict[str, float]:
    """The model fitted in one task on the bounded sample; with no toxic or no other document, a model of the bias alone."""

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(r["text"], r["toxic"]) for b in batches for r in b.to_pylist()]
        rows.sort()
        y = np.array([r[1] for r in rows], dtype=bool)
        model = fit([r[0] for r in rows], y) if rows and y.any() and not y.all() else {"": -20.0}
        yield pa.RecordBatch.from_pydict({"model": [json.dumps(model)]})

    sample = training_sample(docs, labels, most)
    found = sample.coalesce(1).mapInArrow(fitted, "model string").first()  # nothing where the sample has no partition
    return json.loads(found.model) if found else {"": -20.0}


def _probability(spark, model: dict[str, float]) -> Column:
    shared = spark.sparkContext.broadcast(model)

    def probability(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in parts:
            yield pa.array([scorer.probability(t.as_py()) for t in texts], pa.float64())

    probability = F.arrow_udf(probability, "double")
    return probability(F.col("text"))


def keep_clean(docs: DataFrame, training: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose probability is below the threshold, with all their columns.

    Null and empty texts have probability 0 and stay; repeated rows are judged alike.
    """
    model = train(training, labels)
    return docs.where(_probability(docs.sparkSession, model) < threshold)


def find_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, toxic, probability, sentences) of the documents that are toxic, all of the text read.

    The model is trained from the documents' labels alone (`fit`, on at most
    `SAMPLE` documents of either class); it then scores every sentence of every
    document. `sentences` has the offsets in characters of those that offend.

    Defined results: null and empty texts are not toxic and have no row; very
    long texts are read whole, and their length alone doesn't make them toxic
    (`FLOOR`); a null doc_id is kept; repeated rows give repeated rows, and a
    probability that is the threshold is toxic; without labels of both kinds
    nothing is toxic; an empty table gives an empty table. Other columns are
    not read, so their names can't clash.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs, labels))
    schema = "doc_id long, toxic boolean, probability double, sentences array<struct<start:int,end:int,probability:double>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                p = scorer.probability(text)
                if p >= threshold:
                    rows.append((doc_id, True, round(p, 6), scorer.spans(text)))
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.float64()), pa.array(columns[3], kind)], names=["doc_id", "toxic", "probability", "sentences"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every toxic document with its offending sentences."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return find_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
