"""Quality rules: fixed counts of words, and a calibrated classifier over hashed word and character n-grams."""

import math
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import fit_in_task, labelled_sample, per_text

#: Labelled documents that the classifier is fitted on, at most; every fourth of them is kept for calibration.
SAMPLE_ROWS = 3000
#: Hash places of words and characters, then those of word bigrams and trigrams.
PLACES = 1 << 18
BITS = np.uint64(64 - 18)
ORDER_PLACES = 1 << 20
ORDER_BITS = np.uint64(64 - 20)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Words whose weights a worker keeps.
KEPT_WORDS = 400_000
#: Documents with a lower calibrated probability of good quality are dropped.
LEAST_PROBABILITY = 0.5
#: A text fails the fixed rules below so many words, or with a larger share of words in repeated windows.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 50, 50, 3
SYMBOLS = "#*$%&|<>"
OUTPUT = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "base_failed boolean, probability double")


def split(text: str) -> list[str]:
    """Words between space, tab, line feed, vertical tab, form feed and carriage return; str.split knows more spaces."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


def counts(text: str, words: list[str]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    seen, doubled = set(), 0
    for line in text.split("\n"):
        if line in seen:
            doubled += 1
        elif line.strip(" \t\x0b\x0c\r"):
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), doubled, repeated_words(words))


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of WINDOW words which the text holds twice or more."""
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    covered, end = 0, 0
    for at, window in enumerate(windows):
        if often[window] > 1:
            covered += at + WINDOW - max(at, end)
            end = at + WINDOW
    return covered


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places, owners): hash places of all features of words, and the number of the word that has each.

    Features are the word, its shape (upper, lower, digit or the character, of the first eight), and its character 1- to
    3-grams with ends marked.  All words are hashed together as one array of code points.
    """
    codes = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    inside = np.arange(len(codes)) - first[owner]
    room = sizes[owner] - inside
    padded = np.append(codes, np.zeros(2, np.uint64))
    places, owners, mixed = [], [], np.full(len(codes), 7, np.uint64)
    for n in (1, 2, 3):
        mixed = (mixed ^ padded[n - 1:n - 1 + len(codes)]) * MULTIPLIER
        mixed ^= mixed >> np.uint64(31)
        at = np.flatnonzero(room >= n)
        places.append(mixed[at] >> BITS)
        owners.append(owner[at])
    kinds = shape_of(codes)
    shown = (inside > 0) & (inside <= 8) & (room > 1)
    for values in (codes, np.where(shown, kinds, np.uint64(0))):
        whole = np.add.reduceat((values * MULTIPLIER ^ np.where(values > 0, inside + 1 + len(places), 0).astype(np.uint64)) * MULTIPLIER, first)
        places.append((whole ^ whole >> np.uint64(29)) * MULTIPLIER >> BITS)
        owners.append(np.arange(len(words)))
    return np.concatenate(places).astype(np.int64), np.concatenate(owners)


def shape_of(codes: np.ndarray) -> np.ndarray:
    """A for upper, a for lower, 0 for digits, other characters themselves; each distinct character is looked up once."""
    seen, where = np.unique(codes, return_inverse=True)
    shown = [ord("A") if c.isupper() else ord("a") if c.islower() else ord("0") if c.isdigit() else ord(c) for c in map(chr, seen)]
    return np.array(shown, np.uint64)[where]


def word_code(word: str) -> int:
    """The hash that stands for a word in word bigrams and trigrams."""
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def order_features(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, owners) of all word bigrams and trigrams, from the codes of texts' words one text after another."""
    places, owners, mixed = [], [], codes * MULTIPLIER
    mixed ^= mixed >> np.uint64(31)
    for n in (2, 3):
        mixed = (mixed[:-1] ^ codes[n - 1:]) * MULTIPLIER
        mixed ^= mixed >> np.uint64(31)
        at = np.flatnonzero(owner[n - 1:] == owner[:1 - n])
        places.append((mixed[at] >> ORDER_BITS) + np.uint64(PLACES))
        owners.append(owner[at])
    return np.concatenate(places).astype(np.int64), np.concatenate(owners)


def rows_of(texts: list[str]):
    """For each text, (places, shares): the mean of its words' features, each word's features weighing 1 together.

    Each word bigram and each word trigram weighs as much as a word; bigrams of one word twice also share a place.
    """
    for text in texts:
        words = split(text)
        if not words:
            yield np.zeros(0, np.int64), np.zeros(0)
            continue
        each = Counter(words)
        places, owners = word_features(list(each))
        share = (np.fromiter(each.values(), float, len(each)) / np.bincount(owners))[owners]
        repeats = sum(map(str.__eq__, words, words[1:]))
        code = {w: word_code(w) for w in each}
        ordered, _ = order_features(np.fromiter(map(code.__getitem__, words), np.uint64, len(words)), np.zeros(len(words), np.int64))
        found, where = np.unique(np.concatenate([places, [SAME_PAIR], ordered]), return_inverse=True)
        yield found, np.bincount(where, np.concatenate([share, [repeats], np.ones(len(ordered))])) / len(words)


#: Place of a word that is followed by itself.
SAME_PAIR = zlib.crc32(b"same pair") % PLACES


def fit(texts: list[str], labels: list[int]) -> dict:
    """Logistic regression by Adagrad over the sample, then Platt's calibration on the part that was kept apart."""
    if len(set(labels)) < 2:
        return {"weights": {}, "bias": 0.0, "slope": 1.0, "shift": 2.0 if 1 in labels or not labels else -2.0}
    rows, target = list(rows_of(texts)), np.array(labels, float)
    apart = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % 4 == 0 for t in texts])
    if min(target[apart].sum(), (1 - target[apart]).sum()) < 5:
        apart[:] = False
    w, seen, bias, seen_bias = np.zeros(PLACES + ORDER_PLACES), np.full(PLACES + ORDER_PLACES, 1e-8), 0.0, 1e-8
    draw = np.random.default_rng(7)
    share = max(target.mean(), 1 - target.mean())
    weigh = {1.0: 0.5 / target.mean() if share < 1 else 1.0, 0.0: 0.5 / (1 - target.mean()) if share < 1 else 1.0}
    learn = np.flatnonzero(~apart)
    for _ in range(12):
        for at in draw.permutation(learn):
            places, shares = rows[at]
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + float(w[places] @ shares)))))
            pull = (p - target[at]) * weigh[target[at]]
            slope = pull * shares + 1e-5 * w[places]
            seen[places] += slope ** 2
            w[places] -= 0.5 * slope / np.sqrt(seen[places])
            seen_bias += pull ** 2
            bias -= 0.5 * pull / math.sqrt(seen_bias)
    logits = np.array([bias + float(w[p] @ x) for p, x in rows])
    own = apart if apart.any() else ~apart
    slope, shift = calibrated(logits[own], target[own])
    used = np.flatnonzero(w)
    return {"places": used.astype(np.int32), "values": w[used].astype(np.float32), "bias": bias, "slope": slope, "shift": shift}


def calibrated(logits, target) -> tuple[float, float]:
    """Slope and shift of Platt's method: Newton steps on smoothed targets."""
    good, bad = target.sum(), len(target) - target.sum()
    aim = np.where(target == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        g = np.array([((p - aim) * logits).sum(), (p - aim).sum()])
        v = p * (1 - p)
        h = np.array([[(v * logits ** 2).sum(), (v * logits).sum()], [(v * logits).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def scorer(model: dict):
    """Function from texts to the counts, the fixed verdict and the probability of good quality, for `per_text`."""
    w = np.zeros(PLACES + ORDER_PLACES)
    if "places" in model:
        w[model["places"]] = model["values"]
    table, code, same = {}, {}, float(w[SAME_PAIR])

    def learn_words(texts):
        if len(table) > KEPT_WORDS:
            table.clear()
            code.clear()
        new = list({x for words in texts for x in words}.difference(table))
        if new:
            places, owners = word_features(new)
            table.update(zip(new, (np.bincount(owners, w[places], len(new)) / np.bincount(owners)).tolist()))
            code.update(zip(new, map(word_code, new)))

    def weights_of(texts):
        """Sum of the weights of each text's words, bigrams and trigrams."""
        sizes = [len(words) for words in texts]
        flat, owner = [x for words in texts for x in words], np.repeat(np.arange(len(texts)), sizes)
        places, owners = order_features(np.fromiter(map(code.__getitem__, flat), np.uint64, len(flat)), owner)
        return (np.bincount(owner, np.fromiter(map(table.__getitem__, flat), float, len(flat)), len(texts))
                + np.bincount(owners, w[places], len(texts))).tolist()

    def one(text, words, weights):
        found = counts(text, words)
        n = max(1, len(words))
        z = model["bias"] + (weights + same * sum(map(str.__eq__, words, words[1:]))) / n
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, model["slope"] * z + model["shift"]))))
        return *found, found[0] < LEAST_WORDS or 100 * found[4] > MOST_REPEATED_PERCENT * found[0], p

    def work(texts):
        texts = [t or "" for t in texts]
        words = [split(t) for t in texts]
        learn_words(words)
        made = [one(*row) for row in zip(texts, words, weights_of(words))]
        return [list(c) for c in zip(*made)] if made else [[]] * 7

    return work


def learn(docs: DataFrame, labels: DataFrame, rows=SAMPLE_ROWS) -> dict:
    """The model of at most `rows` documents with a quality label outside the held-out fold."""
    return fit_in_task(labelled_sample(docs, labels, "quality", rows), fit)


def rules(docs: DataFrame, model: dict, keep=("doc_id",), least=LEAST_PROBABILITY) -> DataFrame:
    """Columns `keep`, counts, base_failed, probability and kept of every document.

    Null texts count as empty: no words, base_failed.  Repeated rows are judged one by one; ids may be null; columns
    other than `keep` and `text` are not looked at.
    """
    return per_text(docs, list(keep), lambda: scorer(model), OUTPUT).withColumn(
        "kept", ~F.col("base_failed") & (F.col("probability") >= least))


def quality(docs: DataFrame, labels: DataFrame, rows=SAMPLE_ROWS) -> DataFrame:
    """The rules for every document, with the classifier of the labels."""
    return rules(docs, learn(docs, labels, rows))
