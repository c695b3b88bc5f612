"""Shape of the plans: no cross joins, and row data is never gathered by track alone."""

import re

import pytest

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def batch_names():
    from cuelake.plans.queries import QUERIES
    return [n for n in QUERIES if not n.startswith("stream_")]


@pytest.mark.parametrize("name", batch_names())
def test_no_cross_join(spark, name):
    from cuelake.plans.queries import QUERIES
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "SinglePartition" not in re.sub(r"Exchange SinglePartition[^\n]*\n[^\n]*partial_max", "", text)


def test_texts_are_hashed_once(spark):
    from cuelake.plans.queries import QUERIES
    text = plan(QUERIES["export_srt"](spark, FOLDER))
    assert text.count("Exchange") == 1 and "REPARTITION_BY_COL" in text


def test_pushdown_reads_two_columns(spark):
    from cuelake.plans.queries import QUERIES
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(QUERIES["cue_shape"](spark, FOLDER)))[1]
    assert schema == "doc_id:bigint,text:string"


@pytest.mark.parametrize("name", ["text_key", "drop_empty", "body_normalise", "weak_fragment", "needs_translation", "chunk_assign"])
def test_rules_on_single_rows_move_nothing(spark, name):
    from cuelake.plans.queries import QUERIES
    assert "Exchange" not in plan(QUERIES[name](spark, FOLDER))


def test_shapes_move_counts_only(spark):
    from cuelake.plans.queries import QUERIES
    text = plan(QUERIES["cue_shape"](spark, FOLDER))
    assert text.count("Exchange") == 1 and "REPARTITION" not in text and "partial_sum" in text


def test_softmax_binds_its_maximum_and_sum_once(spark):
    from cuelake.plans.queries import QUERIES
    text = plan(QUERIES["score_normalise"](spark, FOLDER))
    assert text.count("EXP(") == len(re.findall(r"EXP\(\(lambda \S+ - lambda \S+\)\)", text)) > 0
    assert text.count(" / ") == len(re.findall(r"\(lambda \S+ / lambda \S+\)", text)) > 0


def test_steps_are_not_shuffled_by_class(spark, monkeypatch):
    from cuelake.operators import recognise
    steps = spark.range(1000).selectExpr("id DIV 10 AS crop_id", "id AS step", "id % 3 AS class")
    symbols = recognise.dictionary(spark, ["a", "b"]).where("class < 2")
    want = [(i // 10, i, None if i % 3 == 2 else ["", "a"][i % 3]) for i in range(1000)]
    for most, keyed in ((10, "Exchange hashpartitioning"), (0, "hashpartitioning(class")):
        monkeypatch.setattr(recognise, "COPIED_CLASSES", most)
        found, lost = recognise.dictionary_decode(steps, symbols)
        if most:
            assert keyed not in plan(found)
        else:
            assert "_salt" in plan(found)
        rows = [tuple(r) for df in (found, lost) for r in df.select("crop_id", "step", "symbol").collect()]
        assert sorted(rows, key=lambda r: r[1]) == want and lost.where("class < 2").isEmpty()


def test_only_weak_cues_are_put_in_order(spark):
    from cuelake.plans.queries import QUERIES
    found = QUERIES["strong_prefilter"](spark, FOLDER)
    below = plan(found).split("Sort [track_id", 1)[1].split("Exchange", 1)[0]
    assert re.search(r"Filter .*RLIKE\([^)]*\{5\}", below)


def test_texts_are_dealt_by_the_size_of_their_table(spark, monkeypatch):
    from cuelake.sources import tables
    few = tables.tokens_v(spark, FOLDER).rdd.getNumPartitions()
    monkeypatch.setattr(tables, "TASKS_PER_SPLIT", 50)
    assert tables.tokens_v(spark, FOLDER).rdd.getNumPartitions() >= 50 > few


def test_reports_are_read_in_two_passes_and_spread(spark):
    from cuelake.plans.queries import QUERIES
    text = plan(QUERIES["metrics_flatten"](spark, FOLDER))
    assert text.count("try_variant_get(") == 2 and "REPARTITION_BY_COL" in text


@pytest.mark.parametrize("name", ["json_repair", "response_explode"])
def test_replies_are_read_once(spark, name):
    from cuelake.plans.queries import QUERIES
    assert plan(QUERIES[name](spark, FOLDER)).count("ArrowEvalPython") == 1


def test_chunks_meet_their_samples_in_place(spark):
    from cuelake.plans.queries import QUERIES
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["prompt_rows"](spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Texts by document for chunks, samples and what blocks carry, and the few carried rows themselves.
    assert text.count("REPARTITION_BY_COL") == 3 and text.count("Exchange") <= 6


def test_rounds_of_the_model_move_nothing(spark, monkeypatch):
    from cuelake.operators import responses
    from cuelake.plans.queries import QUERIES
    seen, durable = [], responses.durable

    def kept(df):
        seen.append((plan(df), df.rdd.getNumPartitions()))
        return durable(df)
    monkeypatch.setattr(responses, "durable", kept)
    monkeypatch.setattr(responses, "TASKS_PER_CORE", 1)
    found = QUERIES["model_loop"](spark, FOLDER)
    (chunks, _), *rounds = seen
    assert chunks.count("Exchange") == 1 and len(rounds) >= 5
    for text, tasks in rounds:
        assert "Exchange" not in text and "Join" not in text and text.count("ArrowEvalPython") == 2 and tasks <= 8
    # Cues meet their decisions in one join, and no other one tells undecided tracks.
    assert "LeftAnti" not in plan(found)
    # Below both shuffles of the texts stands the same, so one of them is used twice.
    assert plan(found).count("REPARTITION_BY_COL") == plan(found).count("Filter isnotnull(doc_id") == 2


def test_ranges_find_their_context_in_their_chunk(spark):
    from pyspark.sql import functions as F

    from cuelake.operators import planning
    from cuelake.operators.ordered import with_blocks
    rows = [(1, i, "7" if i in (3, 20) else f"cue {i}") for i in range(1, 22)]
    cues = with_blocks(spark.createDataFrame(rows, "track_id long, pos long, text string"), "pos")
    chunks = planning.near_rows(planning.work_split(cues, "translate"), "translate")
    assert [(r.first, r.past, [c.id for c in r.near], [c.id for c in r.decided]) for r in chunks.orderBy("first").collect()] == [
        (0, 8, list(range(1, 13)), [3]), (8, 16, list(range(5, 21)), []), (16, 21, list(range(13, 22)), [20])]
    half = chunks.where("first = 8").withColumns({"first": F.lit(10).cast("long"), "past": F.lit(12).cast("long")})
    row = planning.range_rows(half.withColumn("near", planning.near_range())).first()
    assert [[c.id for c in row[name]] for name in ("near", "before", "targets", "after")] == [
        list(range(7, 17)), [7, 8, 9, 10], [11, 12], [13, 14, 15, 16]]
    # A range without a cue for the model asks nothing.
    none = chunks.where("first = 0").withColumns({"first": F.lit(2).cast("long"), "past": F.lit(3).cast("long")})
    assert planning.range_rows(none).isEmpty()
