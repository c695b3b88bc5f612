"""Fixed cases with known results."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.functions import timecode
from cuelake.functions.replies import join_sums, read_reply
from cuelake.functions.text import norm_body_value, text_key
from cuelake.functions.thumbnails import changed
from cuelake.operators import (cues, export, integrity, planning, quality, recognise, regions, responses, runs,
                               sampling)
from cuelake.operators.ordered import with_blocks
from cuelake.sources import cuefiles, cuestore

SECOND = 1_000_000


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def cue_table(spark, rows, size=16384):
    return with_blocks(spark.createDataFrame(
        [(1, i, i, *r) for i, r in enumerate(rows, 1)],
        "track_id long, pos long, cue_no long, start_ms long, end_ms long, text string"), "pos", size)


def test_timestamp(spark):
    assert one(spark, timecode.format_ms(timecode.seconds_to_ms(F.col("s"))), s=3661.25) == "01:01:01,250"
    assert one(spark, timecode.parse_ms(F.col("s")), s="100:01:01,250") == 360_061_250
    assert one(spark, timecode.parse_ms(F.col("s")), s="00:60:01,250") is None


def test_thresholds(spark):
    rows = spark.createDataFrame([("中",), ("12",), ("hello",)], "t string")
    assert [r.x for r in rows.select(recognise.confidence_threshold(F.col("t")).alias("x")).collect()] == [.78, .78, .45]


def collapse(spark, scores, symbols):
    df = with_blocks(spark.createDataFrame([(1, i, s) for i, s in enumerate(scores, 1)],
                                           "crop_id long, step long, scores array<double>"), "step")
    best = recognise.step_argmax(recognise.score_normalise(df))
    found, lost = recognise.dictionary_decode(best, recognise.dictionary(spark, symbols))
    assert lost.count() == 0
    return recognise.ctc_collapse(found, 0, "symbol").first()


def test_collapse_ties_and_logits(spark):
    row = collapse(spark, [[.005, .99, .005], [.01, .98, .01], [.99, .005, .005], [.005, .005, .99]], ["A", "B"])
    assert row.text == "AB" and row.confidence > .95
    row = collapse(spark, [[.10, .45, .45], [.10, .80, .10], [.90, .05, .05], [.10, .10, .80]], ["A", "B"])
    assert row.text == "AB" and row.confidence == pytest.approx((.45 + .80) / 2)
    row = collapse(spark, [[0.0, 2.0, 0.0]], ["A", "B"])
    assert row.text == "A" and row.confidence == pytest.approx(np.e ** 2 / (np.e ** 2 + 2))


def test_reading_order(spark):
    df = spark.createDataFrame([(1, 0, 60.0, 20.0, 100.0, "later"), (1, 1, 10.0, 5.0, 100.0, "first")],
                               "frame long, seq long, y1 double, x1 double, height double, text string")
    assert recognise.reading_order(df).first().text == "first\nlater"


def pictures(spark, frames, fps, pts=None, texts=None):
    """Stride, time repair, gate and cues of a list of grey pictures."""
    pts = pts or [i * 1000 / fps for i in range(len(frames))]
    table = with_blocks(spark.createDataFrame(
        [(1, i, i + 1, float(p), float(fps), f.flatten().tolist(), *f.shape) for i, (f, p) in enumerate(zip(frames, pts))],
        "track_id long, idx long, n long, pts_ms double, fps double, gray array<int>, height int, width int"), "n")
    sampled = sampling.stride_sample(table)
    timed = sampling.pts_repair(sampled)
    changed = sampling.frame_change_gate(sampled).select("track_id", "idx", "n", "changed")
    samples = (timed.join(changed, ["track_id", "idx"]).withColumn("text", F.lit("")))
    context = sampling.gate_context(sampling.ocr_interval_gate(samples, SECOND))
    kept = [r.n for r in context.where("kept").orderBy("n").collect()]
    metrics = sampling.gate_metrics(context, SECOND).first()
    answer = dict(zip(kept, texts)) if isinstance(texts, list) else {n: texts for n in kept}
    words = spark.createDataFrame(list(answer.items()), "n long, word string")
    named = samples.join(words, "n", "left").withColumn("text", F.coalesce("word", F.lit("")))
    context = sampling.gate_context(sampling.ocr_interval_gate(named, SECOND))
    durations = sampling.track_duration(table, timed)
    duration = durations.first().duration_us
    events = cues.transition_backdate(context)
    built = cues.cue_build(cues.event_intervals(events, durations=durations)).orderBy("start_us").collect()
    backdates = events.where("backdated").count()
    return len(kept), metrics, [(c.start_us / SECOND, c.end_us / SECOND) for c in built], backdates, duration / SECOND


def test_gate_counts(spark):
    frames = [np.zeros((8, 10), int)] * 2 + [np.full((8, 10), 40 + i) for i in range(4)]
    calls, m, spans, backdates, _ = pictures(spark, frames, 4, texts="A subtitle")
    assert (calls, m.samples, m.skipped, m.checks, m.triggers, m.forced_checks, m.forced_only) == (2, 3, 1, 2, 1, 1, 0)
    assert spans == [(0, 1.5)] and backdates == 0


def test_variable_times(spark):
    frames = [np.zeros((8, 8), int)] * 6
    frames[2] = np.full((8, 8), 40)
    _, _, spans, _, _ = pictures(spark, frames, 4, [0, 250, 600, 900, 2100, 2350], ["First", "Second", "Second"])
    assert spans == [(0, .6), (.6, 2.6)]


def test_disappearance(spark):
    calls, m, spans, backdates, _ = pictures(spark, [np.zeros((8, 8), int)] * 12, 2,
                                             texts=["Visible subtitle", "", "", "", "", ""])
    assert (calls, m.forced_checks, backdates, spans) == (6, 6, 1, [(0, .75)]) and m.forced_only > 0


def test_short_glyph_and_duration(spark):
    plain = drawn(120, 320)
    figure = drawn(120, 320, (90, 104, 155, 157), (90, 92, 157, 165), (96, 98, 157, 165), (102, 104, 157, 165))
    frames = [plain, plain, figure, plain, plain, plain]
    _, m, spans, _, _ = pictures(spark, frames, 4, texts=["", "1", ""])
    assert m.triggers == 2 and spans == [(.5, 1.0)]
    _, _, spans, _, duration = pictures(spark, [np.full((8, 8), 80)] * 8, 4, [0, 100, 250, 500, 750, 1000, 1300, 2400], "Subtitle")
    assert duration == 2.65 and spans[-1][1] == 2.65


#: Pictures of 100 x 300: what is drawn on the ground of 80, as (top, bottom, left, right), and whether that is a change.
BAND_CASES = [
    ([(58, 70, 60, 240)], True),  # a bar of writing
    ([(58, 70, 2, 298)], False),  # as wide as the picture
    ([(20, 60, 60, 240)], False),  # far too high
    ([(58, 70, 150, 152)], False),  # a speck
    ([(58, 70, 150, 152), (58, 60, 152, 164), (68, 70, 152, 164)], True),  # one letter
    ([(10, 16, 60, 240), (80, 86, 60, 240)], True),  # two lines
    ([], False),
]


def drawn(height, width, *boxes, ground=80, ink=230):
    picture = np.full((height, width), ground)
    for top, bottom, left, right in boxes:
        picture[top:bottom, left:right] = ink
    return picture


def test_change_bands():
    before = np.stack([drawn(100, 300)] * len(BAND_CASES))
    now = np.stack([drawn(100, 300, *boxes) for boxes, _ in BAND_CASES])
    assert changed(before, now).tolist() == changed(now, before).tolist() == [want for _, want in BAND_CASES]


def test_change_of_the_whole_picture():
    still, half = drawn(100, 300), drawn(100, 300, (0, 100, 0, 150), ink=120)
    assert changed(still[None], half[None]).tolist() == [False]
    assert changed(still[None], drawn(100, 300, ground=220)[None]).tolist() == [True]
    slope = np.add.outer(np.zeros(100, int), np.arange(300) * 2 // 5 + 30)
    slid = np.roll(slope, 4, axis=1)
    assert changed(slope[None], slid[None]).tolist() == [False]
    assert changed(slid[None], np.maximum(slid, drawn(100, 300, (58, 70, 60, 180), ground=0))[None]).tolist() == [True]
    assert changed(np.zeros((2, 1, 4), int), np.array([np.full((1, 4), 60), np.zeros((1, 4))], int)).tolist() == [True, False]


def test_thumbnail(spark):
    rows = [(1, 4, 700, 3, [c for i in range(4 * 700) for c in (i % 250, i % 250 + 3, i % 250 + 2)])]
    df = spark.createDataFrame(rows, "n long, height int, width int, channels int, pixels array<int>")
    row = sampling.thumbnail_downsample(df).first()
    image = np.array(rows[0][4]).reshape(4, 700, 3)[::3, ::3].mean(axis=2).astype(np.uint8)
    assert (row.height, row.width) == image.shape and row.gray == image.flatten().tolist()


def test_normalise(spark):
    table = cue_table(spark, [(1000, 2000, "Same text"), (2300, 3000, "Same   text"), (4000, 5000, " ")])
    row = quality.normalize_track(table).first()
    assert (row.status, row.cue_count, row.empty_dropped, row.duplicates_merged) == ("OK", 1, 1, 1)
    broken = cue_table(spark, [(1000, 2000, "a"), (500, 3000, "b")])
    assert quality.normalize_track(broken).first().status == "INVALID_ORDER"
    assert quality.normalize_cues(broken).count() == 0
    assert quality.normalize_track(cue_table(spark, [(0, 9, " ")])).first().status == "NO_TEXT"


def test_statuses_of_parsed_files(spark):
    block = "1\n00:00:01,000 --> 00:00:02,000\nword\n\n"
    files = {1: block, 2: "no cues", 3: "1\n00:61:01,000 --> 00:62:02,000\nword\n", 4: block.replace("word", " "),
             5: block + "2\n00:00:03,000 --> 00:00:02,500\nx\n\n3\n00:99:00,000 --> 00:99:01,000\ny\n",
             6: block + "2\n00:00:03,000 --> 00:99:02,500\nx\n\n3\n00:00:09,000 --> 00:00:01,000\ny\n", 7: "words first\n" + block}
    table = spark.createDataFrame(list(files.items()), "track_id long, content string")
    rows = quality.normalize_track(cuefiles.srt_parse_strict(table)).collect()
    assert {r.track_id: r.status for r in rows} == {1: "OK", 2: "INVALID_FORMAT", 3: "INVALID_TIMECODE", 4: "NO_TEXT", 5: "INVALID_ORDER",
                                                   6: "INVALID_TIMECODE", 7: "INVALID_FORMAT"}
    assert {r.track_id for r in quality.normalize_cues(cuefiles.srt_parse_strict(table)).collect()} == {1}


def test_undecided_cues_hold_their_track_back(spark):
    table = cue_table(spark, [(1000, 2000, "a"), (3000, 4000, "b")])
    some = spark.createDataFrame([(1, 1, "A")], "track_id long, pos long, text string")
    whole = spark.createDataFrame([(1, 1, "A"), (1, 2, " ")], "track_id long, pos long, text string")
    assert responses.decided_cues(table, some).count() == 0 and responses.decided_cues(table, whole).count() == 1
    row = responses.result_summary(table, some).first()
    assert (row.cue_count, row.source_cue_count, row.dropped_cue_count, row.undecided_cue_count) == (1, 2, 0, 1)


@pytest.mark.parametrize("fps", [23.976, 25.0, 29.97, 59.94])
def test_repaired_times_do_not_depend_on_blocks(spark, fps):
    draw = np.random.default_rng(int(fps))
    rows = []
    for track in range(30):
        for i in range(40):
            kind = draw.integers(0, 5)
            pts = -1.0 if kind == 0 else float(draw.uniform(0, 40_000 / fps)) if kind == 1 else i * 1000 / fps
            rows.append((track, i, i + 1, pts, fps))
    table = spark.createDataFrame(rows, "track_id long, idx long, n long, pts_ms double, fps double")
    whole, split = (sorted(sampling.pts_repair(with_blocks(table, "n", size)).select("track_id", "idx", "ts_us", "repaired").collect())
                    for size in (16384, 4))
    assert whole == split and any(r.repaired for r in whole)


def test_line_breaks_of_bodies(spark):
    stats = quality.quality_stats(spark.createDataFrame([(1, 0, "ab\u2028cdef\x0bg\r\nh\x85i", 1)], "track_id long, cue_pos long, body string, parts long")).first()
    assert (stats.max_lines, stats.max_line_chars) == (5, 4)


def test_collapse_trims_blanks(spark):
    steps = [(1, i, c, .9, s) for i, (c, s) in enumerate([(2, " "), (1, "A"), (2, " "), (1, "A"), (0, ""), (2, " ")], 1)]
    df = with_blocks(spark.createDataFrame(steps, "crop_id long, step long, class long, score double, symbol string"), "step")
    assert recognise.ctc_collapse(df, 0, "symbol").first().text == "A A"


def test_custom_region_without_a_bound(spark):
    asked = spark.createDataFrame([("custom", None, .1, .1, .9), ("nonsense", .9, .1, .1, .9)], "profile string, top double, bottom double, left double, right double")
    assert {r.profile: r.reason for r in regions.region_resolve(asked, 100, 100).collect()} == {"custom": "BOUNDS", "nonsense": "PROFILE"}


def test_reply_with_a_lone_surrogate_or_many_merged_cues():
    assert read_reply('[{"id":1,"text":"a\\ud83d"}]') is None
    merged = ",".join(f'"id":{i},"text":"t{i}"' for i in range(200))
    assert read_reply("[{" + merged + "}]") == [(i, f"t{i}") for i in range(200)]


def test_unicode_forms(spark):
    df = cue_table(spark, [(0, 900, "Stra\u00dfe"), (1000, 1900, "STRASSE"), (2000, 2900, "e\u0301te\u0301"), (3000, 3900, "\u00e9t\u00e9")])
    assert quality.duplicate_merge(quality.body_normalise(df)).count() == 2
    keys = [r.k for r in df.orderBy("pos").select(text_key(F.col("text")).alias("k")).collect()]
    assert keys[0] == keys[1] == "strasse" and keys[2] == keys[3]
    assert one(spark, text_key(F.col("t")), t="\uff21\u00b2 b\u2460!") == "a2b1"


def test_regions(spark):
    df = spark.createDataFrame([(.88, .12, .15, .91), (.5, .45, 0.0, 1.0), (float("nan"), 0.0, 0.0, 1.0), (1.0, 0.0, .5, .55)],
                               "top double, bottom double, left double, right double")
    rows = regions.region_validate(df).collect()
    assert [r.reason for r in rows] == [None, "HEIGHT", "BOUNDS", "WIDTH"]
    assert [rows[0][f"{b}_text"] for b in regions.BOUNDS] == ["0.88", "0.12", "0.15", "0.91"]
    box = spark.createDataFrame([(1920.0, 1080.0, 0.0, 0.0, 1.0, 1.0), (1080.0, 1920.0, 0.0, 0.0, 1.0, 1.0), (1920.0, 1080.0, .1, .2, .8, .6)],
                                "video_width double, video_height double, x double, y double, w double, h double")
    a, b, c = regions.region_frame_map(box, 400.0, 400.0).collect()
    assert (a.out_x, a.out_y, a.out_w, a.out_h) == (0, .21875, 1, .5625)
    assert (b.out_x, b.out_y, b.out_w, b.out_h) == (.21875, 0, .5625, 1)
    assert (c.out_y, c.out_h) == pytest.approx((.33125, .3375))


def test_save_and_export(spark):
    df = spark.createDataFrame([(1, "1\r\n00:00:00,000 --> 00:00:01,000\r\nHi")], "track_id long, content string")
    assert export.srt_for_save(df).first().saved == "1\n00:00:00,000 --> 00:00:01,000\nHi\n"
    assert export.export_verbatim(df).first().saved == df.first().content
    table = cue_table(spark, [(1000, 2500, "A & B\nSecond line")])
    ttml = export.export_ttml(table).first().content
    assert 'begin="00:00:01.000"' in ttml and "A &amp; B<br/>Second line" in ttml
    assert export.export_txt(table).first().content == "A & B Second line\n"
    assert "## 00:00:01,000 → 00:00:02,500\n\nA & B  \nSecond line\n\n" in export.export_md(table).first().content


def test_parse_files(spark):
    good = "\ufeff 1 \r\n00:00:01,000 --> 00:00:02,000 \r\nOne\r\ntwo\r\n\r\n5\n00:61:01,000 --> 00:00:02,000\n\n"
    df = spark.createDataFrame([(1, good), (2, "x\n1\n00:00:01,000 --> 00:00:02,000\nOne"), (3, "nothing")],
                               "track_id long, content string")
    rows = cuefiles.srt_parse_strict(df).orderBy("track_id", "pos").collect()
    assert [(r.track_id, r.cue_no, r.text, r.status) for r in rows] == [
        (1, 1, "One\r\ntwo", "OK"), (1, 5, "", "INVALID_TIMECODE"), (2, None, None, "INVALID_FORMAT"), (3, None, None, "INVALID_FORMAT")]
    loose = spark.createDataFrame([(1, "7\n00:00:01,000 --> 00:00:02,000\nOne\ntwo\n\nno time\n\n")], "track_id long, content string")
    rows = cuefiles.srt_parse_lenient(loose).orderBy("pos").collect()
    assert (rows[0].start, rows[0].end, rows[0].lines, rows[0].status) == ("00:00:01,000", "00:00:02,000", ["One", "two"], "OK")
    assert rows[1].status == "NO_TIMECODE"


def test_parts_of_a_file_are_one_file(spark):
    table = spark.createDataFrame([(t, p, 1000 * p, 1000 * p + 500, f"cue {p} ") for t in (1, 2) for p in range(1, 12 if t == 1 else 4)],
                                  "track_id long, pos long, start_ms long, end_ms long, text string")
    for parse in (cuefiles.srt_parse_strict, cuefiles.srt_parse_lenient):
        whole = parse(export.export_srt(table).drop("part_no")).orderBy("track_id", "pos").collect()
        assert [r.pos for r in whole] == [*range(1, 12), 1, 2, 3]
        assert parse(export.export_srt(table, part_cues=4)).orderBy("track_id", "pos").collect() == whole
    block = "1\n00:00:01,000 --> 00:00:02,000\nword\n\n"
    cut = spark.createDataFrame([(1, 0, block), (1, 1, "more\n"), (1, 2, "and more\n\n" + block), (2, 0, "no header"), (2, 1, block)],
                                "track_id long, part_no long, content string")
    rows = cuefiles.srt_parse_strict(cut).orderBy("track_id", "pos").collect()
    assert [(r.track_id, r.pos, r.text, r.status) for r in rows] == [
        (1, 1, "word\n\nmore\nand more", "OK"), (1, 2, "word", "OK"), (2, 1, None, "INVALID_FORMAT")]


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes(b"1\n00:00:01,000 --> 00:00:02,000\nHi\n")
    (tmp_path / "b.SRT").write_bytes(b"\xff --> ")
    (tmp_path / "c.txt").write_bytes(b"x")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "d.srt").write_bytes(b"")
    (tmp_path / "_hidden.srt").write_bytes(b"x")
    for options in ({}, {"partitionFiles": 1}, {"partitionBytes": 5}):
        files = cuestore.read_cue_files(spark, str(tmp_path), **options)
        got = {r.path.rsplit("/")[-1]: r.reason for r in cuefiles.subtitle_file_guard(files).collect()}
        assert got == {"a.srt": None, "b.SRT": "UTF8", "c.txt": "EXTENSION", "d.srt": "SIZE"}
        assert options == {} or files.rdd.getNumPartitions() > 1
    table = cue_table(spark, [(0, 1000, "A"), (1000, 2000, "B"), (2000, 3000, "C")])
    parts, out = export.export_srt(table, part_cues=2), tmp_path / "out"
    cuestore.write_cue_files(parts, str(out), F.lit("one.srt"))
    assert [f.name for f in out.iterdir()] == ["one.srt"] and (out / "one.srt").read_text() == export.export_srt(table).first().content
    cuestore.write_cue_files(parts, str(out), F.lit("two.srt"))
    assert sorted(f.name for f in out.iterdir()) == ["one.srt", "two.srt"]
    cuestore.write_cue_files(parts, str(out), F.lit("three.srt"), "overwrite")
    assert [f.name for f in out.iterdir()] == ["three.srt"]


def test_files_by_folders_keep_the_driver_small(spark, tmp_path):
    import pickle
    rows = spark.range(400).selectExpr("concat(id, '.srt') AS name", "0L AS part_no", "cast(id AS string) AS content")
    for mode in ("append", "overwrite"):
        cuestore.write_cue_files(rows, str(tmp_path), F.col("name"), mode, folders=True)
    assert all(f.is_dir() for f in tmp_path.iterdir())
    planned = cuestore._Reader({"path": str(tmp_path)}).partitions()
    assert len(pickle.dumps(planned)) < 400 * 20
    found = cuestore.read_cue_files(spark, str(tmp_path), partitionFiles="30")
    assert found.rdd.getNumPartitions() == 14 and sorted(int(bytes(r.content)) for r in found.collect()) == list(range(400))
    twice = rows.repartition(2).unionByName(rows.limit(1))
    with pytest.raises(Exception):
        twice.write.format(cuestore.FORMAT).option("folders", "true").mode("append").save(str(tmp_path))


def test_failed_writes_leave_no_files(spark, tmp_path):
    rows = spark.createDataFrame([("a.srt", 0, "x"), ("b/c.srt", 0, "y"), ("a.srt", 1, "z")], "name string, part_no long, content string")
    spark.dataSource.register(cuestore.CueFiles)
    for bad in (rows, rows.where("name = 'a.srt'").repartition(2, "part_no")):
        if bad is not rows and bad.rdd.glom().map(len).filter(bool).count() < 2:
            continue
        with pytest.raises(Exception):
            bad.write.format(cuestore.FORMAT).mode("append").save(str(tmp_path / "out"))
        # A task that still ran when the job was given up may leave its staging folder, which no reader looks into.
        assert not (tmp_path / "out").exists() or all(f.name.startswith("_staging") for f in (tmp_path / "out").iterdir())
    assert cuestore.read_cue_files(spark, str(tmp_path)).collect() == []


REPLIES = [
    ('<think>private</think>\n[{"id":1,"text":"Clean text"}]', [(1, "Clean text")]),
    ('[{"id":1,"text":"First"},{"id":2,"text":"Second"}', [(1, "First"), (2, "Second")]),
    ('[{"id":1,"text":"partial"', None),
    ('{"id":1,"text":"One"}', [(1, "One")]),
    ('[{"id":1,"text":"First\nline"},{"id":2,"text":"Second"}]', [(1, "First\nline"), (2, "Second")]),
    ('[{"id":159,"text":"Bir."+"\\nIki."},{"id":160,"text":"Son"}]', [(159, "Bir.\nIki."), (160, "Son")]),
    ('[{"id":23,"text":"","id":24,"text":"Ready.","id":25,"text":"Done"}]', [(23, ""), (24, "Ready."), (25, "Done")]),
    ('[{"id":23,"text":"The literal ,\\"id\\": marker"}]', [(23, 'The literal ,"id": marker')]),
    ('[{"id":23,"text":"","id":24}]', None),
    ('[{"id":66,"text":"槽！”}]', [(66, "槽！”")]),
    ('[{"id":66,"text":"槽！”"}]', [(66, "槽！”")]),
    ('[{"id":1,"text":"a"}, {"id":2}]', None),
    ('note [x] then [{"id":3,"text":"b"}] bye', [(3, "b")]),
    ('[{"id":-1,"text":"a"}]', None),
    ('[{"id":4,"text":"a","more":[1]}]', [(4, "a")]),
    ('[]', []),
    ('nothing', None),
]


def test_replies(spark):
    assert [read_reply(r) for r, _ in REPLIES] == [w for _, w in REPLIES]
    assert join_sums('[{"id":1,"text":"normal"}]') == '[{"id":1,"text":"normal"}]'
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "i long, raw string")
    got = df.select("i", responses.json_repair(F.col("raw")).alias("c")).orderBy("i").collect()
    assert [None if r.c is None else [tuple(c) for c in r.c] for r in got] == [w for _, w in REPLIES]


def test_only_plain_replies_skip_the_repair(spark):
    plain = [json.dumps([{"id": i, "text": t}], separators=(",", ":")) for i, t in enumerate(["a", 'q " \\ \n', "", "[x] {y}"])]
    rows = spark.createDataFrame([(r,) for r in plain + [r for r, _ in REPLIES]], "raw string")
    flags = [r.x for r in rows.select(F.col("raw").rlike(responses.PLAIN_REPLY).alias("x")).collect()]
    assert all(flags[:len(plain)])
    assert [r for (r, _), f in zip(REPLIES, flags[len(plain):]) if f] == [REPLIES[7][0], REPLIES[10][0], "[]"]


def test_single_answers(spark):
    cases = [("User:\nSubtitle:\nHello\n\nAssistant:\nMerhaba", 194, "translate", "Merhaba"),
             ('Assistant:\n{"id":194,"text":"Birinci\nIkinci"}', 194, "translate", "Birinci\nIkinci"),
             ('{"id":194,"text":"x"}', 195, "translate", None), ("Assistant:\n", 194, "translate", None),
             ("Subtitle:\nHello", 1, "translate", None), ("```x", 1, "clean", None),
             ("Merhaba!", 12, "clean", "Merhaba!"), ("[[REMOVE]]", 12, "clean", ""), ("[[REMOVE]]", 12, "translate", None),
             ('{"id":12,"text":"Merhaba"}', 12, "clean", "Merhaba"), ("[]", 12, "clean", None),
             ('{"id":11,"text":"Merhaba"}', 12, "clean", None), ('{"id":12,"text":" "}', 12, "clean", ""),
             ('{"id":12,"text":" "}', 12, "translate", None)]
    df = spark.createDataFrame([(i, raw, n, "Hello", m) for i, (raw, n, m, _) in enumerate(cases)],
                               "i long, raw string, id long, source string, mode string")
    assert [r.answer for r in responses.single_parse(df).orderBy("i").collect()] == [c[3] for c in cases]


def test_target_verdicts(spark):
    def verdict(ids, empty=None, allow=False):
        cues_ = [(i, "" if i == empty else "t") for i in ids]
        df = spark.createDataFrame([(cues_, [13, 14])], "c array<struct<id:bigint,text:string>>, t array<bigint>")
        return df.select(responses.target_verdict(F.col("c"), F.col("t"), allow).alias("x")).first().x
    assert [verdict([13]), verdict([13, 13, 14]), verdict([14, 13]), verdict([13, 14, 99]), verdict([13, 14], 14),
            verdict([13, 14], 14, True), verdict(range(205, 213)), verdict([14, 13], 14)] == [
                "COUNT", "DUPLICATE", "ORDER", "OK", "EMPTY", "OK", "COUNT", "ORDER"]


def test_retry_actions(spark):
    rows = [("The model returned invalid subtitle data. Log: x", 12, "split"), ("The model failed", 1, "retry"),
            ("The local AI engine failed to start.", 12, "stop"), ("Local AI request failed: x", 1, "stop"), ("AI task cancelled.", 1, "stop")]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, m string, n int")
    got = df.orderBy("i").select(responses.retry_action(F.col("m"), F.col("n")).alias("a")).collect()
    assert [r.a for r in got] == [r[2] for r in rows]


def test_prefilter_and_translation(spark):
    def removed(*texts):
        df = cue_table(spark, [(0, 1, t) for t in texts])
        return [r.remove for r in planning.strong_prefilter(df).orderBy("pos").collect()]
    assert removed(".") == [True] and removed("1", "0", "R.") == [True, True, False]
    assert removed("7", "7", "x") == [True, True, False] and removed("I", "Understand.") == [False, False]
    assert removed("7", "Understand.") == [False, False]
    needed = planning.needs_translation(cue_table(spark, [(0, 1, "169"), (0, 1, "Hello, 169")])).orderBy("pos").collect()
    assert [r.needed for r in needed] == [False, True]


def test_render(spark):
    table = cue_table(spark, [(0, 500, "a"), (1000, 1500, "b"), (2000, 2500, "c")])
    decisions = spark.createDataFrame([(1, 1, "First"), (1, 2, ""), (1, 3, "Second")], "track_id long, pos long, text string")
    assert responses.result_render(table, decisions).first().content == (
        "1\n00:00:00,000 --> 00:00:00,500\nFirst\n\n2\n00:00:02,000 --> 00:00:02,500\nSecond\n\n")
    row = responses.result_summary(table, decisions).first()
    assert (row.cue_count, row.source_cue_count, row.dropped_cue_count) == (2, 3, 1)


def lines_table(spark, lines):
    return with_blocks(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines, 1)], "run_id long, line_no long, line string"), "line_no")


def test_run_lines(spark):
    table = lines_table(spark, ["noise=1", "--- A PIPELINE 2 RESULT START ---", "Pipeline=COMPLETE", r"SRT=C:\Video=One\result.srt",
                                "--- A PIPELINE 2 RESULT END ---", "Late=1"])
    assert {r.key: r.value for r in runs.summary_parse(table).collect()} == {"Pipeline": "COMPLETE", "SRT": r"C:\Video=One\result.srt"}
    stages = lines_table(spark, ["OCRProgress=67", "OCRProgress=100", "1/2 Native engine: go", "x", "Pipeline=COMPLETE"])
    got = [(r.stage, r.percent) for r in runs.stage_classify(stages).orderBy("line_no").collect()]
    assert got == [("ocr", 67), (None, None), ("ocr", None), (None, None), ("complete", 100)]
    assert runs.failure_message(lines_table(spark, ["a", "ERROR: x", "b", " "]), 1).first().message == "x (pipeline code: 1)"
    assert runs.failure_message(lines_table(spark, ["a", " "]), 1).first().message == "a (pipeline code: 1)"
    assert runs.failure_message(lines_table(spark, [" "]), 3).first().message == "Pipeline exited with code 3"
    row = runs.telemetry_extract(lines_table(spark, ["offloaded x/65 layers to GPU", "load: Offloaded 61/65 layers to GPU", "100, 200", "12288, 11000"])).first()
    assert (row.layers, row.layer_total, row.memory_total, row.memory_free) == (61, 65, 12288, 11000)


def test_log_bytes(spark):
    raw = "warn\r\n".encode("utf-16-le") + b"\x1b[32mOCRProgress=12\x1b[0m\n"
    df = spark.createDataFrame([(1, i, bytearray(x)) for i, x in enumerate(raw.split(b"\n")) if x] + [(1, 9, bytearray(b"a\xffb"))],
                               "run_id long, line_no long, line binary")
    got = [r.line for r in runs.log_sanitise(df).orderBy("line_no").collect()]
    assert got == ["warn", "OCRProgress=12", "a\ufffdb"]


def test_quality_verdicts(spark):
    df = spark.createDataFrame([("COMPLETE", "", 0), ("COMPLETE", None, 2), ("FAILED", "", 0), ("COMPLETE", "x", 0), (None, None, None)],
                               "pipeline string, error string, suspect_cues long")
    assert [r.verdict for r in quality.summary_quality(df).collect()] == ["good", "review", "error", "error", "error"]


def test_integrity(spark):
    import hashlib
    a, b = b"same-size-a", b"same-size-b"
    assets = spark.createDataFrame([("x", 11, 5, bytearray(b)), ("y", 11, 5, bytearray(b))], "path string, size long, mtime long, content binary")
    good = hashlib.sha256(a).hexdigest()
    manifest = spark.createDataFrame([("x", good, 100), ("y", good, 100)], "path string, sha256 string, max_bytes long")
    checked = spark.createDataFrame([("x", 11, 4, good), ("y", 11, 5, good.upper())], "path string, size long, mtime long, sha256 string")
    got = {r.path: (r.verdict, r.cached) for r in integrity.incremental_verify(assets, manifest, checked).collect()}
    assert got == {"x": ("MISMATCH", False), "y": ("OK", True)}


def test_norm_body_value():
    assert norm_body_value(" A\u00a0 b ") == "a b"


def test_idle_tracks_close_by_event_time(spark):
    """Track 1 stops, tracks 2 and 3 pause and go on, track 3 is open at the end; no row says that a track closes."""
    from cuelake.streaming import tracks
    from cuelake.streaming.replay import replay
    second = 1_000_000
    rows = [(1, 1, 0, "a"), (1, 2, second, "a"), (2, 1, 0, "b"), (3, 1, 30 * second, "c"), (2, 2, 60 * second, "b"), (3, 2, 89 * second, "c"), (4, None, 90 * second, None)]
    table = spark.createDataFrame([(t, n, 1000 * second + at, text, False) for t, n, at, text in rows],
                                  "track_id long, n long, ts_us long, text string, changed boolean")
    found = replay(table, "ts_us", lambda s: tracks.stream_cues(s, second, idle_us=20 * second), slices=3).collect()
    assert sorted((r.track_id, r.cue_n, r.start_us - 1000 * second, r.end_us - 1000 * second, r.text) for r in found) == [
        (1, 1, 0, second + 500_000, "a"), (2, 1, 0, 500_000, "b"), (2, 2, 60 * second, 60 * second + 500_000, "b"),
        (3, 1, 30 * second, 30 * second + 500_000, "c")]


STREAM = "track_id long, n long, ts_us long, pts_ms double, fps double, changed boolean, arrival int"


def test_streams_of_empty_tables(spark):
    from cuelake.streaming import tracks
    from cuelake.streaming.replay import replay
    none = spark.createDataFrame([], STREAM + ", text string")
    assert replay(none, "ts_us", lambda s: tracks.stream_ocr_gate(s, 10)).collect() == []
    assert replay(none, "ts_us", lambda s: tracks.stream_cues(s, 10, idle_us=10), slices=3).collect() == []


def test_gate_takes_rows_in_event_order_and_drops_none(spark):
    """Five late rows of 40 come after all others: they alone are re-timed, and rows without time or pts stay rows."""
    from cuelake.operators.sampling import gate_walk, repair_times
    from cuelake.streaming import tracks
    from cuelake.streaming.replay import replay
    late = {7, 12, 13, 25, 38}
    rows = [(1, n, n * 250_000, (n - 1) * 250.0, 4.0, n % 5 == 0, 3 if n in late else (n * 3) % 2) for n in range(1, 41)]
    odd = [(2, 1, None, None, 4.0, None, 0), (2, 2, 500_000, None, 4.0, True, 0)]
    clock = [(None, None, at, None, None, None, slice_) for at, slice_ in ((100_000_000, 2), (200_000_000, 4))]
    found = replay(spark.createDataFrame(rows + odd + clock, STREAM), "ts_us",
                   lambda s: tracks.stream_ocr_gate(s, 1_000_000, "60 seconds"), slices=5, arrival=F.col("arrival")).collect()
    taken = [r for r in rows if r[1] not in late] + [r for r in rows if r[1] in late]
    times, repaired, _ = repair_times([(r[1] - 1, r[3], r[4]) for r in taken])
    kept, _ = gate_walk(zip(times, (r[5] for r in taken)), None, 1_000_000)
    want = {(r[1], t, p, k, r[1] in late) for r, t, p, k in zip(taken, times, repaired, kept)}
    assert {(r.n, r.ts_us, r.repaired, r.kept, r.late) for r in found if r.track_id == 1} == want and len(want) == 40
    assert all(p == late for _, _, p, _, late in want)
    assert sorted((r.n, r.ts_us, r.repaired) for r in found if r.track_id == 2) == [(1, 0, True), (2, 250_000, True)]


def test_tracks_share_keys_of_the_state_store(spark, tmp_path):
    """6,000 tracks keep fewer rows of state than there are tracks; large ids and rows without a track stay as they are."""
    from cuelake.streaming import tracks
    first, count = 1 << 60, 6000
    odd = [(None, 2, 900_000, 9.0, 4.0, True), (None, 1, 100_000, 5.0, 4.0, None), (None, None, 9_000_000, None, None, None)]
    kind = "track_id long, n long, ts_us long, pts_ms double, fps double, changed boolean"
    rows = spark.range(first, first + count).select(F.col("id").alias("track_id"), F.lit(1).cast("long").alias("n"), F.lit(7_000_000).cast("long").alias("ts_us"),
                                                    F.lit(1.0).alias("pts_ms"), F.lit(4.0).alias("fps"), F.lit(False).alias("changed"))
    rows.unionByName(spark.createDataFrame(odd, kind)).write.parquet(f"{tmp_path}/in")
    own = spark.newSession()
    tracks.use_rocksdb(own)
    own.conf.set("spark.sql.shuffle.partitions", 8)
    gated = tracks.stream_ocr_gate(own.readStream.schema(kind).parquet(f"{tmp_path}/in"), 1_000_000)
    run = (gated.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
           .trigger(availableNow=True).start())
    run.awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.track_id for r in found if r.track_id is not None) == list(range(first, first + count))
    assert sorted((r.n, r.ts_us, r.kept) for r in found if r.track_id is None) == [(1, 5000, True), (2, 9000, True)]
    assert 0 < run.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < count


@pytest.mark.parametrize("name", ["stream_cues", "stream_late_samples", "stream_late_audit"])
def test_streams_of_few_groups_equal_sql(spark, monkeypatch, name):
    """Tracks that share a key of the store stay apart, also where their rows are cut into pieces."""
    from __spark_entry__ import oracle_sql, queries
    from compare import connect, difference
    from cuelake.streaming import tracks
    monkeypatch.setattr(tracks, "GROUPS", 3)
    monkeypatch.setattr(tracks, "PIECE_ROWS", 7)
    folder = "/root/testdata/sf0.001"
    assert difference(spark, connect(folder), queries()[name], oracle_sql()[name], folder) is None


def test_separators_are_blanks_of_bodies(spark):
    """U+001C to U+001F go at the ends of bodies and between words, as every blank does; answers of models keep them."""
    from cuelake.functions import text as X
    samples = ["\x1c a \x1d\x1e b\x1f", "\x1f", "ab\x1c", " x", "\x85y\u3000"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(samples)], "i int, text string")
    got = rows.select(X.strip_body(F.col("text")).alias("b"), X.squeeze(F.col("text")).alias("s"), X.strip(F.col("text")).alias("t"),
                      X.at_most_two(F.col("text"), 1).alias("two")).collect()
    assert [(r.b, r.s, r.two) for r in got] == [(t.strip(), " ".join(t.split()), 0 < len(" ".join(t.split())) <= 2) for t in samples]
    assert [r.t for r in got] == ["\x1c a \x1d\x1e b\x1f", "\x1f", "ab\x1c", "x", "y"]
    assert [r.text for r in quality.drop_empty(rows.withColumn("blk", F.lit(0))).orderBy("i").collect()] == [t.strip() for t in samples if t.strip()]


def test_reported_frames_stand_in_for_counted_ones(spark):
    frames = spark.createDataFrame([(1, 9, 2250.0, 4.0), (3, 0, -1.0, 4.0)], "track_id long, idx long, pts_ms double, fps double")
    timed = spark.createDataFrame([(1, 2_300_000), (3, 0)], "track_id long, ts_us long")
    reported = spark.createDataFrame([(1, 4.0, 99), (2, 5.0, 20), (4, 5.0, None)], "track_id long, fps double, reported_frames long")
    got = {r.track_id: r.duration_us for r in sampling.track_duration(frames, timed, reported).collect()}
    assert got == {1: 2_550_000, 2: 4_000_000, 3: 250_000, 4: 0}


def test_the_last_event_ends_with_its_track(spark):
    rows = [(t, 0, n, n * 1_000_000, f"w{n}", False, 9_000_000) for t in (1, 2) for n in (1, 2, 3)]
    events = spark.createDataFrame(rows, "track_id long, blk long, n long, event_us long, text string, backdated boolean, last_us long")
    durations = spark.createDataFrame([(1, 12_345_678)], "track_id long, duration_us long")
    got = {(r.track_id, r.n): r.end_us for r in cues.event_intervals(events, durations=durations).collect()}
    assert got == {(1, 1): 2_000_000, (1, 2): 3_000_000, (1, 3): 12_345_678, (2, 1): 2_000_000, (2, 2): 3_000_000, (2, 3): 9_500_000}


def test_handoff_names(spark):
    cases = [("out/a.srt", "v.mp4", "a.srt"), (None, "c:\\\\x\\\\clip.v2.mkv", "clip.v2.srt"), ("", "dir/", "dir.srt"), (" /".strip(), ".mp4", "subtitles.srt"), (None, "", "subtitles.srt")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = df.select("i", export.handoff_name(F.col("a"), F.col("b")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [n for _, _, n in cases]
