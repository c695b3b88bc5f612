"""Toxicity by multiple-instance learning: sentence probabilities joined by noisy-or, learned from document labels."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import WordTable, fit_in_task, fresh, held_out, labelled_sample, per_text

#: Labelled documents that the model is fitted on, at most.
SAMPLE_ROWS = 8000
#: Probability that a document is toxic though no sentence bears evidence.
LEAK = 0.001
#: A document is toxic from this score on.
THRESHOLD = 0.3
#: Evidence (twice the log-likelihood ratio of document counts) that a feature needs.
LEAST_EVIDENCE = 15.0
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
OUTPUT = "score double, offending array<struct<start:int,end:int,score:double>>"


def features(word: str) -> list[str]:
    """The word and its stems of four to six letters, so that unseen endings of a known stem still count."""
    return [word, *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) > n)]


def fit(texts: list[str], labels: list[int]) -> dict:
    """Weights of features and the sentence bias, from document labels alone.

    A document is a bag of sentences.  A sentence without selected features has probability 0; another has
    the logistic value of bias plus weights.  P(document) = 1 - (1 - leak) * product(1 - P(sentence)), and the
    log-likelihood of the labels, less a squared penalty, is climbed by Adam steps.
    """
    counts = {0: Counter(), 1: Counter()}
    for text, label in zip(texts, labels):
        counts[label].update({f for w in set(WORD.findall(text.lower())) for f in features(w)})
    total = [labels.count(0), labels.count(1)]
    if not all(total):
        return {"bias": 0.0, "weights": {}}
    names = sorted(f for f, n in counts[1].items() if evidence(n, counts[0][f], total[1], total[0]) >= LEAST_EVIDENCE)
    place = {f: i for i, f in enumerate(names)}

    columns, sentence_of, document_of, targets = [], [], [], []
    for text, label in zip(texts, labels):
        bags = [sorted({place[f] for w in WORD.findall(m.group()) for f in features(w) if f in place})
                for m in SENTENCE.finditer(text.lower())]
        bags = [b for b in bags if b]
        if bags:
            for b in bags:
                columns += b
                sentence_of += [len(document_of)] * len(b)
                document_of.append(len(targets))
            targets.append(label)
    if not targets:
        return {"bias": 0.0, "weights": {}}
    columns, sentence_of, document_of = map(np.array, (columns, sentence_of, document_of))
    # Documents without evidence cannot move the weights; those that are clean still count in the bias through shape.
    targets, size = np.array(targets), len(names) + 1
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    w[-1] = -1.0
    for step in range(1, 401):
        z = np.bincount(sentence_of, w[columns], len(document_of)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        quiet = np.exp(np.bincount(document_of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(targets))) * (1 - LEAK)
        pull = np.where(targets == 1, -quiet / np.maximum(1 - quiet, 1e-9), 1.0)[document_of] * p
        slope = np.append(np.bincount(columns, pull[sentence_of], len(names)), pull.sum()) / len(targets)
        slope += 1e-3 * w
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope ** 2
        w -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return {"bias": float(w[-1]), "weights": {f: float(x) for f, x in zip(names, w)}}


def evidence(a: int, b: int, n1: int, n0: int) -> float:
    """Twice the log-likelihood ratio of a in n1 against b in n0; 0 where the second share is the larger."""
    if a * n0 <= b * n1:
        return 0.0
    both, out = (a + b) / (n1 + n0), 0.0
    for k, n in ((a, n1), (b, n0)):
        for x, q in ((k, both), (n - k, 1 - both)):
            if x:
                out += 2 * x * np.log(x / (n * q))
    return out


def scorer(model: dict):
    """Function from texts to [score, offending sentences], for `per_text`."""
    weights, bias = model["weights"], model["bias"]
    own = WordTable(lambda word: tuple((f, weights[f]) for f in features(word) if f in weights))

    def one(text):
        lower = (text or "").lower()
        if not any(map(own.__getitem__, set(WORD.findall(lower)))):
            return LEAK, []
        plain, found = 1 - LEAK, []
        # Offsets are those of the text itself; lower-casing can lengthen a text, then sentences are cut first.
        same = len(lower) == len(text)
        for m in SENTENCE.finditer(text):
            part = lower[m.start():m.end()] if same else m.group().lower()
            hits = {f: x for w in WORD.findall(part) for f, x in own[w]}
            if hits:
                z = bias + sum(hits[f] for f in sorted(hits))
                p = float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))
                plain *= 1 - p
                if p >= THRESHOLD:
                    found.append({"start": m.start(), "end": m.end(), "score": p})
        return 1 - plain, found

    def work(texts):
        made = [one(t) for t in texts]
        return [[x for x, _ in made], [x for _, x in made]]

    return work


def learn(docs: DataFrame, labels: DataFrame, rows=SAMPLE_ROWS) -> dict:
    """The model of at most `rows` labelled documents outside the held-out fold."""
    return fit_in_task(labelled_sample(docs, labels, "toxic", rows), fit)


def score(docs: DataFrame, model: dict, keep=("doc_id",)) -> DataFrame:
    """Columns `keep` with `score` and `offending` (start, end, score of sentences at or over the threshold).

    Null and empty texts score the leak, with no sentences.  Each repeated row is scored by itself; ids may be
    null; columns other than `keep` and `text` are not looked at.  Without usable labels every text scores the leak.
    """
    return per_text(docs, list(keep), lambda: scorer(model), OUTPUT)


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of `docs`, with all their columns, that score below the threshold."""
    name = fresh("toxic", docs.columns)

    def start():
        work = scorer(model)
        return lambda texts: [[x >= THRESHOLD for x in work(texts)[0]]]

    return per_text(docs, docs.columns, start, f"{name} boolean").where(~F.col(name)).drop(name)


def toxicity(docs: DataFrame, labels: DataFrame, rows=SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences of every document."""
    scored = score(docs, learn(docs, labels, rows))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")
