"""Packing, top-k, WARC, mixing, near duplicates, tool calls and the pipeline."""

import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelake.llm import mixing, neardup, packing, queries, toolcalls, topk, warc
from cuelake.llm.components import components
from compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, length long, size long, rank int"
ODD = [(1, None, "en", "b", 0, 1, 1, 1), (2, "", "en", "b", 0, 1, 1, 1), (None, "no id at all in here", None, None, 1, 1, 1, 1),
       (4, "same row twice over", "en", "a", 1, 1, 1, 1), (4, "same row twice over", "en", "a", 1, 1, 1, 1), (5, "one", "en", "c", 1, 1, 1, 1),
       (6, "one", "en", None, 1, 1, 1, 1), (7, "long words " * 40_000, "en", "a", 1, 1, 1, 1), (8, "ONE", None, "a", None, 1, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.mark.parametrize("name", ["op3_maxscore", "op5_warc", "op10_toolcalls"])
def test_query_equals_sql(spark, name):
    from __spark_entry__ import oracle_sql, queries
    assert difference(spark, connect(FOLDER), queries()[name], oracle_sql()[name], FOLDER) is None


# Packing

TEXTS = ["", " ", "one", "one two\n three", " a  b", "a\n\n  b \tc", "it's 'S we'll", "x y  z  w", "tail  ", "<|endoftext|> a b", "1 22 3.4 &&& *** ", "é è\r\n ü ", "a \x1c b\x85 c", "a   b    c"]


def test_chunks_give_the_ids_of_whole_texts(docs):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(packing.tokenizer_path())
    texts = TEXTS + [r.text for r in docs.select("text").collect()]
    found = packing.ChunkEncoder(packing.tokenizer_path()).encode_all(texts)
    for text, ids in zip(texts, found):
        assert ids == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text[:80]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab' \n\t\x1c é1.&"), max_size=24))
def test_chunks_of_any_text(text):
    encoder = CHUNKS.setdefault("own", packing.ChunkEncoder(packing.tokenizer_path()))
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.encode_all([text])[0] == np.array(want, "<u4").tobytes()


CHUNKS = {}


def test_runs_that_cannot_be_divided_are_encoded_by_chunks():
    texts = ["some words, é and\nlines 12 x's", " lead", "", "same words same"]
    encoder = packing.ChunkEncoder(packing.tokenizer_path())
    want = [packing.little_endian(t.ids) for t in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode_all(texts) == want
    encoder.forget()
    encoder.widths = encoder.widths * 0 + 1
    assert encoder.encode_all(texts) == want


def test_a_small_table_of_chunks_changes_nothing(monkeypatch):
    texts = [f"w{i} x{i % 3} same" for i in range(50)]
    want = packing.ChunkEncoder(packing.tokenizer_path()).encode_all(texts)
    monkeypatch.setattr(packing, "KEPT_CHUNKS", 5)
    encoder = packing.ChunkEncoder(packing.tokenizer_path())
    assert [encoder.encode_all([t])[0] for t in texts] == want


def check_packed(rows, capacity=1024):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_documents(docs):
    rows = [r.asDict() for r in packing.best_fit(docs, with_ids=True).collect()]
    total = sum(r["length"] for r in rows)
    assert check_packed(rows) <= 1.03 * -(-total // 1024) + 1
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(packing.tokenizer_path())
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert len(by) == docs.count()
    for d in docs.collect():
        ids = whole.encode(d.text or "", add_special_tokens=False).ids + [2]
        own, at = sorted(by[d.doc_id], key=lambda r: r["piece"]), 0
        for k, r in enumerate(own):
            part = np.array(ids[at:at + r["length"]], "<u4").tobytes()
            assert (r["piece"], r["start"], r["ids_crc32"], bytes(r["ids"])) == (k, at, zlib.crc32(part), part)
            assert k == 0 or r["length"] == 1024
            at += r["length"]
        assert at == len(ids) and (len(own) == 1 or len(ids) > 1024)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_fullest_combination_against_all_subsets(lengths):
    import itertools
    counts, first = dict(Counter(lengths)), max(lengths)
    rest = sorted(lengths)[:-1]
    best = max(first + sum(c) for n in range(len(rest) + 1) for c in itertools.combinations(rest, n) if first + sum(c) <= 12)
    found = packing.fullest(counts, 12)
    assert sum(k * n for k, n in found) == best and all(n <= counts[k] for k, n in found) and dict(found)[first] >= 1


def test_plan_uses_every_piece_once():
    counts = {1024: 7, 1000: 900, 24: 350, 500: 1001, 3: 5000, 1: 1}
    runs = packing.plan(dict(counts))
    for k, own in runs.items():
        own.sort()
        assert own[0][0] == 0 and all(a[0] + a[1] * a[3] == b[0] for a, b in zip(own, own[1:]))
        assert own[-1][0] + own[-1][1] * own[-1][3] == counts[k]


def test_packing_odd_rows(odd):
    rows = [r.asDict() for r in packing.best_fit(odd).collect()]
    check_packed(rows)
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r[0] for r in ODD)
    assert packing.best_fit(odd.limit(0)).count() == 0


# Top-k

def test_top_k_odd_vectors(spark):
    rows = [(0, [1.0, -1.0]), (50, [0.5, 0.25]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [1.0, -1.0]), (5, []), (6, [float("inf"), 0.0]),
            (7, [1.0]), (None, [1.0, 1.0]), (4, [1.0, -1.0]), (100, [0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    fine = {i: [int(np.floor(256 * x)) for x in v] + [0] * (2 - len(v)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(table).collect()}
    want = {}
    for q in (0, 50, 100):
        best = sorted(((-sum(a * b for a, b in zip(fine[q], v)), i) for i, v in fine.items() if i != q))[:5]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    assert topk.search(table.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 60), st.integers(1, 6))
def test_shard_against_brute_force(seed, rows, width):
    draw = np.random.default_rng(seed)
    vectors = draw.integers(-4, 5, (rows, width)).tolist()
    ids = draw.permutation(rows * 2)[:rows].tolist()
    shard = topk.Shard(ids, vectors)
    query, out = draw.integers(-4, 5, width).tolist(), int(ids[0])
    want = sorted((-int(np.dot(v, query)), i) for i, v in zip(ids, vectors) if i != out)[:5]
    assert [(s, i) for s, i in shard.best(query, 5, out)] == [(-s, i) for s, i in want]


# WARC

def test_records_of_split_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "<p>" + "body " * 30 * (i % 5) + str(i // 10)) for i in range(200)] + [(None, None, None), (7, "u\r\nv", "é" * 60)],
                                  "page_id long, url string, html string").withColumn("path", F.lit(1))
    files = warc.write(warc.record_types(pages), f"file://{tmp_path}/a")
    sizes = [warc.read(files, n).select("record_id", "record_type", "start", "path").collect() for n in (97, 1000, 1 << 20)]
    assert sorted(map(str, sizes[0])) == sorted(map(str, sizes[1])) == sorted(map(str, sizes[2])) and len(sizes[0]) == 202
    back = {r.record_id: bytes(r.payload).decode() for r in warc.read(files).where("record_type = 'response' AND record_id <> '<urn:page:7>'").collect()}
    want = {f"<urn:page:{'' if r.page_id is None else r.page_id}>": r.html or "" for r in pages.collect()}
    assert all(want[k] == v for k, v in back.items())


def test_magic_inside_data_is_no_record(spark, tmp_path):
    data = warc.MAGIC * 40 + zlib.compress(b"x") + warc.MAGIC
    row = {"html": "", "url": "u", "page_id": 1, "payload_digest": "0" * 64, "record_type": "response", "refers_to": None}
    good = warc.member(warc.record_bytes(row))
    (tmp_path / "a.warc.gz").write_bytes(data + good + warc.member(b"no record") + data + good + good[:-9])
    size = (tmp_path / "a.warc.gz").stat().st_size
    files = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", size)], "path string, bytes long")
    for n in (50, 4096):
        assert sorted(r.start for r in warc.read(files, n).collect()) == [len(data), 2 * len(data) + len(good) + len(warc.member(b"no record"))]


def test_warc_of_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# Mixing

def brute_targets(sizes, weights=(3, 1, 2), percent=150, limit=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = percent * sum(sizes.values()) / 100, set()
    while True:
        open_names = [s for s in names if s not in capped]
        rest = total - sum(limit * sizes[s] for s in capped)
        share = {s: rest * weigh[s] / sum(weigh[x] for x in open_names) for s in open_names}
        over = {s for s in open_names if share[s] > limit * sizes[s]}
        if not over:
            return share | {s: float(limit * sizes[s]) for s in capped}
        capped |= over


@pytest.mark.parametrize("seed", range(6))
def test_targets_against_reshares(spark, seed):
    draw = np.random.default_rng(seed)
    sizes = {(None if i == 3 else f"s{i}"): int(draw.integers(0, 10 ** draw.integers(1, 5))) for i in range(int(draw.integers(1, 9)))}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(table).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mix(spark):
    table = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('s', id % 5) END AS source",
                                         "repeat('w ', cast(1 + pmod(hash(id), 300) AS int)) AS text", "1 AS size", "2 AS taken")
    rows = mixing.mix(table).collect()
    assert len(rows) == 6000 and sorted(rows) == sorted(mixing.mix(table.repartition(5)).collect())
    by, aims = Counter(), {}
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size) and r.taken == r.copies * r.size
        by[r.source_size] += r.taken
        aims[r.source_size] = r.target
    assert all(abs(by[s] - t) <= 0.01 * t for s, t in aims.items()) and abs(sum(aims.values()) - 1.5 * sum(aims)) < 1e-3


def test_mixed_rows_are_copies_of_documents(docs):
    rows = mixing.mixed(docs)
    taken = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    assert rows.columns == docs.columns
    assert Counter(r.doc_id for r in rows.collect()) == Counter({k: n for k, n in taken.items() if n})


def test_mix_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ODD)
    assert {r.doc_id: r["size"] for r in rows if r.doc_id in (1, 2, 7)} == {1: 0, 2: 0, 7: 80_000}
    assert mixing.mixed(odd).columns == odd.columns and mixing.mix(odd.limit(0)).count() == 0


# Near duplicates

def test_similarities_below_the_bands_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    for percent in (79, 101):
        for operator in (neardup.near_duplicates, neardup.distinct_documents):
            with pytest.raises(ValueError):
                operator(docs, width=2, percent=percent)


def test_near_copies_under_one_id_are_kept_by_the_query(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (1, " ".join(words + ["x"])), (2, " ".join(words)), (None, "no id"), (3, None), (3, "other words here")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op9_minhash(spark, str(tmp_path)).collect()
    assert len(found) == len(rows) and {(r.doc_id, r.kept) for r in found} == {(1, True), (2, False), (3, True), (None, True)}


def brute_components(rows, width, percent=80):
    sets = {}
    for i, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        n = min(width, len(words))
        sets[i] = {tuple(words[k:k + n]) for k in range(len(words) - n + 1)} if n else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    names = sorted(sets)
    for k, i in enumerate(names):
        for j in names[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in names}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_against_all_pairs(spark, docs, width):
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], width)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, width).collect()}
    assert got == want


def test_families_split_over_blocks(spark, monkeypatch):
    """Copies with several edits, so that some link only through others; small tiles and blocks."""
    monkeypatch.setattr(neardup, "TILE", 4)
    monkeypatch.setattr(neardup, "ASKED_ROWS", 3)
    draw, rows = np.random.default_rng(1), []
    for family in range(4):
        base = [f"f{family}w{k}" for k in range(60)]
        for copy in range(25):
            words = list(base)
            for at in draw.choice(60, int(draw.integers(0, 9)), replace=False):
                words[at] = f"x{draw.integers(1 << 30)}"
            rows.append((len(rows) * 7 % 101 + 1000 * family, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 2).collect()}
    want = brute_components(rows, 2)
    assert got == want and len({c for _, c in want.values()}) > 8


def test_near_duplicates_odd_rows(odd):
    rows = neardup.near_duplicates(odd, 2).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ODD)
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_shingles, by[1].component_id, by[1].kept) == (0, 1, True)
    assert by[8].component_id == by[6].component_id == 5 and not by[6].kept and by[7].n_shingles == 2
    assert by[None].component_id is None and by[None].kept
    kept = neardup.distinct_documents(odd, 2)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 5, 7]
    assert neardup.near_duplicates(odd.limit(0), 2).count() == 0


def test_texts_under_one_id_are_judged_apart(spark):
    """Id 7 has a text of its own, a copy of id 3's and twice the same row; id 9 has two near copies of one text."""
    base, other, third = ([f"{c}{k}" for k in range(40)] for c in "abc")
    near = third[:-1] + ["end"]
    rows = [(3, base), (7, base[:-1] + ["x"]), (7, other), (7, other), (9, third), (9, near), (11, near + ["more"])]
    table = spark.createDataFrame([(i, " ".join(words)) for i, words in rows], "doc_id long, text string")
    found = neardup.near_duplicates(table, 2).collect()
    assert Counter((r.doc_id, r.component_id) for r in found) == Counter({(3, 3): 1, (7, 3): 1, (7, 7): 2, (9, 9): 2, (11, 9): 1})
    stay = neardup.distinct_documents(table, 2).collect()
    assert sorted(r.doc_id for r in stay) == [3, 7, 9]
    assert [r.text for r in stay if r.doc_id == 7] == [" ".join(other)]


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99}


# Tool calls

def test_link_statuses(spark):
    calls = [(1, 0, "a", "search", '{"query":"x","limit":3}', []), (1, 2, "b", "search", '{"limit":"3","z":1}', ["a", "nowhere"]),
             (1, 4, "c", "count", "{", ["b"]), (1, 6, "d", "count", '{"text":"t"}', ["e"]), (1, 8, "e", "count", '{"text":"t"}', ["d"]),
             (1, 10, "f", "guess", "{}", []), (1, 12, None, "count", "{}", []), (1, 14, "g", "count", '{"text":null}', []),
             (1, 16, "a", "search", '{"query":"later"}', []), (1, 18, "h", "translate", '{"to":"é\\"","text":"t"}', ["c", "a"])]
    results = [(1, 1, "a", "r1"), (1, 3, "q", "lost"), (1, 5, None, None), (1, 7, "a", "r0"), (1, 19, "h", None)]
    schemas = spark.createDataFrame(toolcalls.SCHEMAS, "tool string, param string, type string, required boolean")
    rows = toolcalls.link(spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>"),
                          spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"), schemas).collect()
    by = {r.call_id: r for r in rows if r.call_id}
    assert {k: r.status for k, r in by.items()} == {"a": "ok", "b": "invalid arguments", "c": "bad json", "d": "circle", "e": "circle", "f": "unknown tool",
                                                     "g": "invalid arguments", "h": "ok", "q": "orphan result"}
    assert {k: by[k].level for k in "abch"} == {"a": 0, "b": 1, "c": 2, "h": 3} and by["a"].repeats == 1
    assert by["b"].errors == "missing query,type limit,unknown z"
    assert by["a"].line == '{"arguments":{"limit":3,"query":"x"},"errors":[],"id":"a","level":0,"name":"search","result":"r1","status":"ok"}'
    assert by["h"].line.startswith('{"arguments":{"text":"t","to":"é\\""},"errors":[],"id":"h","level":3,"name":"translate","result":null')
    assert sorted(r.status for r in rows if r.call_id is None) == ["no id", "orphan result"] and len(rows) == 11


def test_ids_name_calls_inside_their_conversation(spark):
    """Two conversations, and one without an id, use the same names; needs and results stay in their own."""
    calls = [(c, 0, "call_0", "count", '{"text":"t"}', []) for c in (1, 2, None)] + [(1, 2, "call_1", "count", '{"text":"u"}', ["call_0"]),
                                                                                    (2, 2, "call_2", "count", '{"text":"v"}', ["call_1"])]
    results = [(1, 1, "call_0", "first"), (2, 1, "call_0", "second"), (3, 1, "call_0", "lost"), (None, 1, "call_0", "none")]
    schemas = spark.createDataFrame(toolcalls.SCHEMAS, "tool string, param string, type string, required boolean")
    rows = toolcalls.link(spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>"),
                          spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"), schemas).collect()
    got = {(r.conv_id, r.call_id): (r.status, r.level, r.repeats, json.loads(r.line)["result"]) for r in rows}
    assert got == {(1, "call_0"): ("ok", 0, 0, "first"), (2, "call_0"): ("ok", 0, 0, "second"), (None, "call_0"): ("ok", 0, 0, "none"),
                   (3, "call_0"): ("orphan result", None, 0, "lost"), (1, "call_1"): ("no result", 1, 0, None), (2, "call_2"): ("no result", 0, 0, None)}


def test_tool_calls_of_odd_turns(spark):
    schema = "conv_id long, turn long, role string, text string, level int"
    rows = [(1, 0, "user", None, 1), (1, 1, "assistant", "", 1), (None, 0, "user", "x", 1), (1, None, "user", "x", 1), (1, 0, "user", None, 1), (2, 0, None, None, 1)]
    found = toolcalls.tool_calls(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == 3 and {r.call_id: r.repeats for r in found if r.call_id} == {"1-0": 1}
    assert toolcalls.tool_calls(spark.createDataFrame([], schema)).count() == 0


def test_tool_calls_stay_in_the_jvm(spark):
    found = toolcalls.tool_calls(spark.read.parquet(f"{FOLDER}/conversations.parquet"))
    plan = found._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "MapInArrow"))


# Pipeline

def test_pipeline(spark):
    import corpus_pipeline as pipeline
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id for r in docs.collect()}
    assert len(pipeline.STAGES) == 5
    results = {}
    for name, stage in pipeline.STAGES:
        docs = results[name] = stage(spark, docs, FOLDER).cache()
        if name != "packing":
            assert docs.columns == columns
    clean = results["toxicity"]
    assert kept - {r.doc_id for r in clean.collect()} < kept
    want = brute_components([(r.doc_id, r.text) for r in clean.collect()], 5)
    assert {r.doc_id for r in results["near duplicates"].collect()} == {i for i, (_, c) in want.items() if i == c}
    assert results["secrets"].count() == results["near duplicates"].count()
    assert results["secrets"].where("text RLIKE '[0-9a-f]{24}'").count() == 0
    rows = [r.asDict() for r in results["packing"].collect()]
    check_packed(rows)
    assert sum(r["piece"] == 0 for r in rows) == results["source mix"].count()
    whole = pipeline.run(spark, FOLDER)
    assert whole.count() == len(rows) and whole.columns == results["packing"].columns
