"""Language of words and texts: a linear-chain conditional random field over affixes, n-grams and a lexicon."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import fit_in_task, held_out, per_text, sample_by_hash

#: Documents that the model is fitted on, at most, and the words that are taken of one of them in training.
SAMPLE_ROWS = 2000
#: Training chains have this many words: pieces of documents, some of them of two documents one after the other.
CHAIN = 24
CHAINS_OF_A_DOCUMENT = 4
PLACES = 1 << 16
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Words whose emissions a worker keeps, and rows of a batch that are labelled together.
KEPT_WORDS, ROWS = 400_000, 512
EPOCHS = 3
#: Probability, before training, that a word has another language than the one before.
SWITCH = 0.02
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
OUTPUT = "lang_pred string, score double, words bigint, switches bigint"


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places, owners): hash places of all features of lower-case words, and the number of the word that has each.

    Features are 1- to 3-grams of the word between end marks, so those at an end are affixes of up to two letters, the
    affixes of three letters, and the word itself.  All words are hashed together as one array of code points.
    """
    codes = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first, last = np.flatnonzero(codes == ord("<")), np.flatnonzero(codes == ord(">"))
    owner = np.cumsum(codes == ord("<")) - 1
    room = last[owner] - np.arange(len(codes)) + 1
    padded = np.append(codes, np.zeros(4, np.uint64))
    places, owners, mixed = [], [], np.full(len(codes), 11, np.uint64)
    for n in (1, 2, 3, 4):
        mixed = (mixed ^ padded[n - 1:n - 1 + len(codes)]) * MULTIPLIER
        mixed ^= mixed >> np.uint64(31)
        at = np.flatnonzero(room >= n) if n < 4 else np.concatenate([first[room[first] >= 4], last[room[first] >= 4] - 3])
        places.append(mixed[at] >> np.uint64(48))
        owners.append(owner[at])
    inside = (np.arange(len(codes)) - first[owner] + 1).astype(np.uint64)
    whole = np.add.reduceat((codes * MULTIPLIER ^ inside) * MULTIPLIER, first)
    places.append((whole ^ whole >> np.uint64(29)) * MULTIPLIER >> np.uint64(48))
    owners.append(np.arange(len(words)))
    return np.concatenate(places).astype(np.int64), np.concatenate(owners)


def messages(emissions: np.ndarray, transitions: np.ndarray, lengths: np.ndarray, learning=False):
    """Forward-backward over chains: (marginals, expected transitions where the weights are being learned).

    `emissions` is (words, chains, states), chains by falling length; at step t only the first chains that are long
    enough take part.  Messages are scaled at each step.
    """
    steps, chains, states = emissions.shape
    move = np.exp(transitions)
    own = np.exp(emissions - emissions.max(axis=2, keepdims=True))
    active = np.searchsorted(-lengths, -np.arange(steps), "left")
    ahead, scale = np.zeros_like(own), np.ones((steps, chains))
    ahead[0] = own[0] / states
    for t in range(steps):
        n = active[t]
        if t:
            ahead[t, :n] = (ahead[t - 1, :n] @ move) * own[t, :n]
        scale[t, :n] = ahead[t, :n].sum(axis=1)
        ahead[t, :n] /= scale[t, :n, None]
    back = np.ones_like(own)
    pairs = np.zeros((states, states))
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        onward = own[t + 1, :n] * back[t + 1, :n] / scale[t + 1, :n, None]
        back[t, :n] = onward @ move.T
        if learning:
            pairs += (ahead[t, :n].T @ onward) * move
    marginals = ahead * back
    return marginals / np.maximum(marginals.sum(axis=2, keepdims=True), 1e-300), pairs


def fit(texts: list[str], labels: list[str]) -> dict:
    """Weights of features and transitions by Adagrad on the conditional likelihood of word labels.

    A word's label is that of its document.  Every fourth chain is the end of one document and the beginning of
    another, so that the transitions learn how languages change within a text.  The lexicon feature of a word is the
    smoothed log share of its documents' languages, with a weight of its own; counts leave the chain's own document out.
    """
    languages = sorted(set(labels))
    if not languages:
        return {"languages": []}
    place = {x: i for i, x in enumerate(languages)}
    states = len(languages)
    words = [WORD.findall(t.lower()) for t in texts]
    known = Counter()
    for own, label in zip(words, labels):
        known.update((w, place[label]) for w in set(own))
    lexicon = {}
    for (word, k), n in known.items():
        lexicon.setdefault(word, np.zeros(states))[k] += n
    lexicon = {w: n for w, n in lexicon.items() if n.sum() >= 3}

    draw = np.random.default_rng(4)
    chains = []
    for own, label in zip(words, labels):
        starts = list(range(0, len(own), CHAIN))
        for s in (starts if len(starts) <= CHAINS_OF_A_DOCUMENT else draw.choice(starts, CHAINS_OF_A_DOCUMENT, replace=False)):
            chains.append([(w, place[label]) for w in own[s:s + CHAIN]])
    order = draw.permutation(len(chains))
    chains = [chains[i] for i in order]
    for i in range(0, len(chains) - 1, 4):
        cut = int(draw.integers(1, CHAIN))
        chains[i] = chains[i][:cut] + chains[i + 1][:CHAIN - cut]

    table = features_by_word(sorted({w for chain in chains for w, _ in chain}))
    weight, seen = np.zeros((PLACES, states)), np.full((PLACES, states), 1e-6)
    move = np.full((states, states), np.log(SWITCH / max(1, states - 1)))
    np.fill_diagonal(move, np.log(1 - SWITCH))
    seen_move = np.full((states, states), 1e-6)
    trust, seen_trust = 0.5, 1e-6
    for _ in range(EPOCHS):
        for at in range(0, len(chains), 128):
            batch = sorted(chains[at:at + 128], key=len, reverse=True)
            lengths = np.array([len(c) for c in batch])
            steps, at_word = int(lengths[0]), []
            emissions, gold = np.zeros((steps, len(batch), states)), np.zeros((steps, len(batch), states))
            prior = np.zeros_like(emissions)
            for c, chain in enumerate(batch):
                for t, (w, k) in enumerate(chain):
                    at_word.append((t, c, w))
                    gold[t, c, k] = 1
                    if w in lexicon:
                        n = lexicon[w].copy()
                        n[k] = max(0.0, n[k] - 1)
                        prior[t, c] = np.log((n + 0.2) / (n.sum() + 0.2 * states))
            sizes = np.array([len(table[w]) for *_, w in at_word])
            places = np.concatenate([table[w] for *_, w in at_word])
            t_of, c_of = np.array([t for t, *_ in at_word]), np.array([c for _, c, _ in at_word])
            starts = np.append(0, np.cumsum(sizes)[:-1])
            emissions[t_of, c_of] = np.add.reduceat(weight[places], starts, axis=0) / sizes[:, None] * 3
            emissions += trust * prior
            marginals, pairs = messages(emissions, move, lengths, True)
            present = (np.arange(steps)[:, None] < lengths[None])[..., None]
            pull = (marginals - gold) * present
            touched, which = np.unique(places, return_inverse=True)
            each = np.repeat(pull[t_of, c_of] / sizes[:, None] * 3, sizes, axis=0)
            slope = np.stack([np.bincount(which, each[:, k], len(touched)) for k in range(states)], axis=1)
            slope += 1e-4 * weight[touched]
            seen[touched] += slope ** 2
            weight[touched] -= 0.3 * slope / np.sqrt(seen[touched])
            gold_pairs = np.einsum("tci,tcj->ij", gold[:-1], gold[1:])
            slope = pairs - gold_pairs + 0.1 * move
            seen_move += slope ** 2
            move -= 0.05 * slope / np.sqrt(seen_move)
            slope = float((pull * prior).sum())
            seen_trust += slope ** 2
            trust = max(0.0, trust - 0.05 * slope / np.sqrt(seen_trust))
    lexicon = {w: (trust * np.log((n + 0.2) / (n.sum() + 0.2 * states))).astype(np.float32) for w, n in lexicon.items()}
    return {"languages": languages, "weight": (3 * weight).astype(np.float32), "move": move, "lexicon": lexicon}


def features_by_word(words: list[str]) -> dict:
    """Places of each word of a bounded training sample."""
    if not words:
        return {}
    places, owners = features(words)
    order = np.argsort(owners, kind="stable")
    return dict(zip(words, np.split(places[order], np.cumsum(np.bincount(owners))[:-1])))


class Emissions:
    """A worker's bounded table of words: row numbers of a matrix of their emissions, filled for many at once."""

    def __init__(self, model: dict):
        self.weight, self.lexicon = model["weight"].astype(float), model["lexicon"]
        self.forget()

    def forget(self):
        self.rows, self.values = {}, np.zeros((0, self.weight.shape[1]))

    def __call__(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.rows) > KEPT_WORDS:
            self.forget()
        new = list({w for words in texts for w in words}.difference(self.rows))
        if new:
            places, owners = features(new)
            count = np.bincount(owners, minlength=len(new))[:, None]
            made = np.stack([np.bincount(owners, column[places], len(new)) for column in self.weight.T], axis=1) / count
            for at, word in enumerate(new):
                if word in self.lexicon:
                    made[at] += self.lexicon[word]
            self.rows.update(zip(new, range(len(self.values), len(self.values) + len(new))))
            self.values = np.concatenate([self.values, made])
        return [self.values[list(map(self.rows.__getitem__, words))] for words in texts]


def labeller(model: dict):
    """Function from texts to a list of (words, marginals) of each text, in words by languages."""
    move, states, emissions_of = model["move"], len(model["languages"]), Emissions(model)

    def work(texts):
        words = [WORD.findall(t.lower()) for t in texts]
        lengths = np.array([len(w) for w in words])
        order = np.argsort(-lengths, kind="stable")
        found = emissions_of(words)
        out, at = [None] * len(texts), 0
        while at < len(order):
            # Chains of like length together, so that padding stays below the words themselves.
            longest, last = int(lengths[order[at]]), at + 1
            while last < len(order) and 2 * lengths[order[last]] >= longest:
                last += 1
            batch = order[at:last]
            emissions = np.zeros((longest, len(batch), states))
            for c, i in enumerate(batch):
                if lengths[i]:
                    emissions[:lengths[i], c] = found[i]
            marginals = messages(emissions, move, lengths[batch])[0] if longest else emissions
            for c, i in enumerate(batch):
                out[i] = words[i], marginals[:lengths[i], c]
            at = last
        return out

    return work


def predictor(model: dict):
    """Function from texts to [language, score, words, switches], for `per_text`."""
    label = labeller(model) if model["languages"] else None

    def work(texts):
        fine = [i for i, t in enumerate(texts) if label and t and any(map(str.isalpha, t))]
        made = [(UNKNOWN, 0.0, 0, 0)] * len(texts)
        for i, (words, marginals) in zip(fine, label([texts[i] for i in fine]) if fine else []):
            if words:
                share = marginals.mean(axis=0)
                best = marginals.argmax(axis=1)
                k = int(share.argmax())
                made[i] = model["languages"][k], float(min(1.0, share[k])), len(words), int((best[1:] != best[:-1]).sum())
        return [list(c) for c in zip(*made)] if made else [[]] * 4

    return work


def learn(docs: DataFrame, rows=SAMPLE_ROWS) -> dict:
    """The model of at most `rows` documents with a language, outside the held-out fold, first by hash of their ids."""
    known = (docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.min("lang").alias("label")))
    return fit_in_task(sample_by_hash(docs, known, rows), fit)


def predict(docs: DataFrame, model: dict, keep=("doc_id",)) -> DataFrame:
    """Columns `keep` with lang_pred, score (mean marginal of that language), words and switches of language.

    `und` with score 0 for null texts and those without a letter, and for all without a learned language.  Repeated
    rows are judged one by one; ids may be null; columns other than `keep` and `text` are not looked at.
    """
    return per_text(docs, list(keep), lambda: predictor(model), OUTPUT, ROWS)


def word_labels(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and `spans` (language, first word, words) of every document: runs of words of one language."""
    fields = "spans array<struct<lang:string,first:int,words:int>>"

    def start():
        label = labeller(model)

        def work(texts):
            rows = []
            for _, marginals in label([t or "" for t in texts]):
                best, spans = marginals.argmax(axis=1) if len(marginals) else [], []
                for at, k in enumerate(best):
                    if not spans or spans[-1]["lang"] != model["languages"][k]:
                        spans.append({"lang": model["languages"][k], "first": at, "words": 0})
                    spans[-1]["words"] += 1
                rows.append(spans)
            return [rows]
        return work

    return per_text(docs, ["doc_id"], start, fields, ROWS)


def languages(docs: DataFrame, rows=SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    found = predict(docs, learn(docs, rows))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "words", "switches")
