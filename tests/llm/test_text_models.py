"""Toxicity, language, quality and secrets: brute force, held-out accuracy and odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuelake.llm import common, credentials, langid, quality, toxicity

FOLDER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, words long"
ODD = [(1, None, "en", "s", 0, 1.0, "x", 1), (2, "", "en", "s", 0, 1.0, "x", 1), (None, "no id here", None, None, 1, 1.0, "x", 1),
       (3, "12 34 !!", "de", "s", 1, 1.0, "x", 1), (4, "same row", "en", "s", 1, 1.0, "x", 1), (4, "same row", "en", "s", 1, 1.0, "x", 1),
       (5, "long " * 60_000, "en", "s", 1, 1.0, "x", 1), (6, "\x0b \x1c x\n\n", "fr", "s", 1, 1.0, "x", 1)]


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels")}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int, text string")


def test_fold_is_crc32(spark):
    import zlib
    rows = spark.range(50).select("id", common.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_toxicity_held_out(tables):
    found = toxicity.toxicity(tables["documents"], tables["labels"]).join(tables["labels"], "doc_id").where("held_out").toPandas()
    toxic, clean = found[found.toxic == 1], found[found.toxic == 0]
    assert (toxic.predicted == 1).mean() > 0.5
    assert (clean.predicted == 1).mean() < 0.05
    assert ((found.score >= 0) & (found.score <= 1)).all()


def test_toxicity_learns_words_from_documents_and_finds_sentences():
    clean = [f"tree number{i} stands. birds sing{i} here." for i in range(60)]
    bad = [f"tree number{i} stands. you zorgling{i % 7} thing{i}. birds sing{i} here." for i in range(60)]
    model = toxicity.fit(clean + bad, [0] * 60 + [1] * 60)
    score, spans = toxicity.scorer(model)(["birds sing. what a zorglish day! the end", "birds sing. the end", None, ""])
    assert score[0] > 0.3 and score[1] == score[2] == score[3] == toxicity.LEAK
    text = "birds sing. what a zorglish day! the end"
    assert [text[s["start"]:s["end"]].strip() for s in spans[0]] == ["what a zorglish day!"] and spans[1:] == [[], [], []]


def test_noisy_or_of_two_sentences():
    model = {"bias": -1.0, "weights": {"bad": 1.5}}
    score, _ = toxicity.scorer(model)(["bad. bad. good."])
    p = 1 / (1 + 2.718281828459045 ** -0.5)
    assert abs(score[0] - (1 - (1 - toxicity.LEAK) * (1 - p) ** 2)) < 1e-9


def test_language_held_out(tables):
    found = langid.languages(tables["documents"]).join(tables["documents"].select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all()


def test_language_of_switched_words(tables):
    rows = tables["documents"].where("length(text) > 600 AND lang IN ('de', 'es')").limit(300).collect()
    model = langid.fit([r.text for r in rows], [r.lang for r in rows])
    parts = {r.lang: langid.WORD.findall(r.text)[:60] for r in rows}
    words, marginals = langid.labeller(model)([" ".join(parts["de"] + parts["es"])])[0]
    best = [model["languages"][k] for k in marginals.argmax(axis=1)]
    assert sum(b == "de" for b in best[:60]) > 54 and sum(b == "es" for b in best[60:]) > 54
    assert abs(marginals.sum(axis=1) - 1).max() < 1e-9


def test_forward_backward_against_all_paths():
    import itertools

    import numpy as np
    draw = np.random.default_rng(3)
    emissions, move = draw.normal(size=(4, 2, 3)), draw.normal(size=(3, 3))
    lengths = np.array([4, 2])
    marginals, pairs = langid.messages(emissions, move, lengths, True)
    want, want_pairs = np.zeros_like(emissions), np.zeros((3, 3))
    for c, n in enumerate(lengths):
        total = 0
        for path in itertools.product(range(3), repeat=int(n)):
            weight = np.exp(sum(emissions[t, c, k] for t, k in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            total += weight
        for path in itertools.product(range(3), repeat=int(n)):
            weight = np.exp(sum(emissions[t, c, k] for t, k in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:]))) / total
            for t, k in enumerate(path):
                want[t, c, k] += weight
            for a, b in zip(path, path[1:]):
                want_pairs[a, b] += weight
        assert np.allclose(marginals[:n, c], want[:n, c])
    assert np.allclose(pairs, want_pairs)


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    doubled = sum(1 for i, line in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", line) and line in lines[:i])
    often, covered = Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if often[tuple(words[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), doubled, len(covered)


def test_quality_counts(tables, odd):
    texts = [r.text for r in tables["documents"].select("text").limit(400).collect() if len(r.text) < 8000]
    texts += [r[1] or "" for r in ODD if r[0] != 5] + ["a b c a b c a b", "x\ny\nx\n \n \nx", "a\x1cb \x85 c d"]
    for text in texts:
        assert quality.counts(text, quality.split(text)) == brute_counts(text)


def test_quality_sees_the_order_of_words():
    """Good and bad texts hold the same words; only which follows which tells them apart."""
    ring = [f"word{k}" for k in range(40)]
    good = [" ".join(ring[k:] + ring[:k]) for k in range(40)]
    bad = [" ".join(reversed(t.split())) for t in good]
    model = quality.fit(good[::2] + bad[::2], [1] * 20 + [0] * 20)
    found = quality.scorer(model)(good[1::2] + bad[1::2])[-1]
    assert min(found[:20]) > 0.9 and max(found[20:]) < 0.1
    alone = [quality.scorer(model)([t])[-1][0] for t in good[1::2] + bad[1::2]]
    assert alone == pytest.approx(found)
    assert quality.scorer(model)(["", "word1", None])[0] == [0, 1, 0]


def test_quality_held_out(tables):
    found = quality.quality(tables["documents"], tables["labels"]).join(tables["labels"], "doc_id").withColumn(
        "held_out", common.held_out()).where("held_out").toPandas()
    good, bad = found[found.quality == 1], found[found.quality == 0]
    assert good[~good.base_failed].kept.mean() > 0.97
    assert bad.kept.mean() < 0.3


def brute_spans(text):
    key = "|".join("".join(f"[{c}{c.upper()}]" for c in k) for k in ("password", "passwd", "secret", "token"))
    key += "|[aA][pP][iI]_?[kK][eE][yY]"
    rules = [("assign", rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    found = [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for i, (kind, p, g, least) in enumerate(rules)
             for m in re.finditer(p, text) if len(m[g]) >= least]
    return ",".join(s for *_, s in sorted(found))


SECRETS = ["token=secret=abcdef", "API_KEY: 'abc123' ſecret=abcdefg toKen=abcdefg", "AKIAAKIA" + "A" * 14, "é" * 3 + " password \"= " + "f" * 40,
           "passwd:\n12345678", "0123456789abcdef01234567x0123456789abcdef0123456", "secret = short"]


def test_secrets_base(spark, tables):
    extra = spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(SECRETS)], "doc_id long, text string")
    docs = tables["documents"].select("doc_id", "text").union(extra)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in credentials.secrets(docs).collect():
        want = brute_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        base = [s for s in r.spans.split(",") if s and not s.startswith("format")]
        assert ",".join(base) == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
FORMATS = {"hex": ("", "0123456789abcdef", 40), "forge": ("ghp_", LETTERS, 36), "shop": ("sk_live_", LETTERS, 24),
           "upper": ("", "0123456789ABCDEF", 32), "mixed": ("", LETTERS + "+/", 40)}
ORDINARY = ["0123456789012345", "192.168.10.24", "mail7.example.com", "2024-01-05T12", "some_snake_case", "Straightforwardness", "a/path/to/file_2.txt"]


def credential(draw, name):
    start, letters, length = FORMATS[name]
    return start + "".join(draw.choices(letters, k=length))


def secret_texts(draw, names, copies=30):
    """Texts with labelled credentials, and texts of ordinary tokens only."""
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(3, 12))) for _ in range(3000)]
    filled = lambda: " ".join(draw.choices(words, k=40) + draw.choices(ORDINARY, k=3) + [str(draw.randint(10**6, 10**15))])
    return ([f'{filled()} token = "{credential(draw, name)}" {filled()}' for name in names for _ in range(copies)],
            [filled() for _ in range(200)])


def test_learned_formats_find_unlabelled_credentials():
    draw = random.Random(5)
    with_some, without = secret_texts(draw, FORMATS)
    model = credentials.fit(with_some + without, [])
    for name in FORMATS:
        assert sum(credentials.is_secret(model, credentials.symbols(credential(draw, name))) for _ in range(100)) >= 97, name
    assert not any(credentials.is_secret(model, credentials.symbols(w)) for w in ORDINARY)
    assert all(not s for s in credentials.scanner(model)(secret_texts(draw, [])[1])[3])
    # Lengths are learned: parts of credentials are not of the format.
    assert not any(credentials.is_secret(model, credentials.symbols(credential(draw, "hex")[:n])) for n in (12, 20, 39))
    # A format that no label shows is not found.
    other = credentials.fit(secret_texts(draw, ["hex"])[0] + without, [])
    assert not credentials.is_secret(other, credentials.symbols(credential(draw, "forge")))


def test_automata_keep_lengths_and_make_loops():
    draw = random.Random(6)
    fixed = credentials.Automaton(["".join(draw.choices("0a", k=40)) for _ in range(130)]).table
    assert len(fixed) == 41 and "" in fixed[-1] and not any("" in row for row in fixed[:-1])
    loop = credentials.Automaton(["z" * (1 + int(draw.expovariate(0.2))) for _ in range(2000)]).table
    assert len(loop) < 6
    for table in (fixed, loop):
        assert all(sum(math.exp(x) for k, (_, x) in row.items() if k is not None) <= 1 + 1e-9 for row in table)
    two = credentials.Automaton(["0" * 8] * 50 + ["a" * 12] * 50).table
    assert credentials.likelihood(two, "0" * 8) > -1 > credentials.likelihood(two, "0" * 12)
    assert credentials.likelihood(two, "0" * 12, must_end=True) < credentials.likelihood(two, "a" * 12, must_end=True) - 3
    assert len(credentials.Automaton([]).table) == 1
    long = credentials.Automaton(["0a" * 256] * 20).table
    # 513 events that all 20 strings share, smoothed by 0.1 of 1.2.
    assert math.isclose(credentials.likelihood(long, "0a" * 256, True), 513 * math.log(20.1 / 21.2)) and credentials.likelihood(long, "0a" * 200, True) == -math.inf


def test_learned_spans_of_documents(spark):
    draw = random.Random(7)
    with_some, without = secret_texts(draw, ["forge", "mixed"])
    bare = [f"see {credential(draw, n)}. and {credential(draw, n)}, then" for n in ("forge", "mixed") for _ in range(10)]
    texts = with_some + without + bare
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = credentials.learn(docs)
    found = {r.doc_id: r for r in credentials.secrets(docs).collect()}
    for i, text in enumerate(texts):
        base = credentials.base_spans(text)
        want = base + [(m.start(), m.end(), "format") for m in credentials.CANDIDATE.finditer(text)
                       if credentials.is_secret(model, credentials.symbols(m.group())) and not any(s < m.end() and m.start() < e for s, e, _ in base)]
        assert found[i].spans == ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(want))
        assert found[i].spans.count("format") == (2 if text in bare else 0)
    clean = {r.doc_id: r.text for r in credentials.redact(docs, model).collect()}
    assert all(clean[i] == "see [secret]. and [secret], then" for i, t in enumerate(texts) if t in bare)
    assert all(clean[i] == t for i, t in enumerate(texts) if t in without)


def test_redacted_texts(spark):
    docs = spark.createDataFrame([(1, "a password=abcdef012345678901234567 b", "en", "s", 40), (2, None, None, None, None)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    rows = {r.doc_id: r for r in credentials.redact(docs, credentials.fit([], [])).collect()}
    assert rows[1].text == "a [secret] b" and rows[1].n_chars == len(rows[1].text) and rows[2].text is None


def test_odd_rows(odd, no_labels):
    tox = toxicity.toxicity(odd, no_labels).collect()
    assert len(tox) == len(ODD) and all(r.score == toxicity.LEAK and r.predicted == 0 for r in tox)
    assert {r.held_out for r in tox if r.doc_id is None} == {False}
    lang = langid.languages(odd).collect()
    assert len(lang) == len(ODD)
    assert {(r.doc_id, r.lang_pred) for r in lang if r.doc_id in (1, 2, 3)} == {(1, "und"), (2, "und"), (3, "und")}
    rules = quality.quality(odd, no_labels).collect()
    assert {r.doc_id: r.n_words for r in rules if r.doc_id} == {1: 0, 2: 0, 3: 3, 4: 2, 5: 60_000, 6: 1}
    assert len(credentials.secrets(odd).collect()) == len(ODD)
    assert credentials.redact(odd, credentials.fit([], [])).columns == odd.columns
    assert toxicity.accepted(odd, toxicity.fit([], [])).count() == len(ODD)


def test_empty_tables(spark, no_labels):
    empty = spark.createDataFrame([], DOCS)
    for found in (toxicity.toxicity(empty, no_labels), langid.languages(empty), quality.quality(empty, no_labels), credentials.secrets(empty)):
        assert found.count() == 0


def test_sample_is_bounded_and_leaves_the_held_out_fold(tables):
    sample = common.labelled_sample(tables["documents"], tables["labels"], "toxic", 50)
    assert sample.count() == 50 and sample.where(common.held_out()).count() == 0
    assert sample.select(F.countDistinct("doc_id")).first()[0] == 50
