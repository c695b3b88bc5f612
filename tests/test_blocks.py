"""Block-wise operators against plain loops, with blocks of a few rows and one huge track."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cuelake.operators import cues as cue_ops
from cuelake.operators import ordered, planning, quality, recognise, runs, sampling

SIZES = [3, 7, 10_000]
SECOND = 1_000_000


def tracks(rng, many=12, huge=150):
    """Track lengths: mostly short ones and one with most of the rows."""
    return {t: (huge if t == 0 else rng.randint(1, 14)) for t in range(many)}


def blocked(df, size, position="pos"):
    return ordered.with_blocks(df, position, size)


@pytest.mark.parametrize("size", SIZES)
def test_scan_equals_plain_windows(spark, size):
    rng = random.Random(size)
    rows = [(t, p, rng.choice([None, *range(9)])) for t, n in tracks(rng).items() for p in range(1, n + 1)]
    df = blocked(spark.createDataFrame(rows, "track_id long, pos long, v long"), size)
    v, w = F.col("v"), Window.partitionBy("track_id").orderBy("pos")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("track_id")
    got = ordered.scan(df, ["track_id"], ["pos"], a=ordered.lag(v), b=ordered.lead(v), c=ordered.running_sum(F.coalesce(v, F.lit(0))),
                       d=ordered.earlier_max(v), e=ordered.last_set(v), f=ordered.last_before(v), g=ordered.total(v),
                       h=ordered.total_max(v))
    want = df.select("*", F.lag(v).over(w).alias("a"), F.lead(v).over(w).alias("b"),
                     F.sum(F.coalesce(v, F.lit(0))).over(upto).alias("c"), F.max(v).over(before).alias("d"),
                     F.last(v, ignorenulls=True).over(upto).alias("e"), F.last(v, ignorenulls=True).over(before).alias("f"),
                     F.coalesce(F.sum(v).over(whole), F.lit(0)).alias("g"), F.max(v).over(whole).alias("h"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_blocks_of_numbered_rows(spark):
    """A track with half of the rows at few times has several blocks, the others none that carry anything."""
    rng = random.Random(5)
    rows = [(0 if rng.random() < 0.5 else rng.randint(1, 60), rng.randint(0, 4) * SECOND, i) for i in range(800)]
    df = spark.createDataFrame(rows, "track_id long, ts_us long, id long")
    got = ordered.in_blocks(df, ["track_id"], ["ts_us", "id"], "n", "length", 16).collect()
    assert len({r.blk for r in got if r.track_id == 0}) > 20 and {r.blk for r in got if r.track_id and r.length <= 16} == {-1}
    for track in range(61):
        mine = sorted((ts, i) for t, ts, i in rows if t == track)
        own = {r.id: r for r in got if r.track_id == track}
        assert [own[i].n for _, i in mine] == list(range(1, len(mine) + 1)) and {r.length for r in own.values()} <= {len(mine)}


def merge_loop(rows, gap=750):
    done = []
    for pos, start, end, norm in rows:
        last = done[-1] if done else None
        if last and last["norm"] == norm and start <= last["end"] + gap:
            last["end"] = max(last["end"], end)
            last["parts"] += 1
        else:
            done.append({"pos": pos, "start": start, "end": end, "norm": norm, "parts": 1})
    return [(d["pos"], d["start"], d["end"], d["norm"], d["parts"]) for d in done]


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("words", ["a", "ab", "abcd"])
def test_duplicate_merge(spark, size, words):
    rng = random.Random(f"{size}{words}")
    rows, want = [], []
    for track, count in tracks(rng, huge=200).items():
        start, mine = 0, []
        for pos in range(1, count + 1):
            start += rng.choice([0, 300, 900, 2500])
            length = rng.choice([100, 500, 2000, 9000])
            mine.append((pos * 2, start, start + length, rng.choice(words)))
        rows += [(track, *r) for r in mine]
        want += [(track, *m) for m in merge_loop(mine)]
    df = blocked(spark.createDataFrame(rows, "track_id long, pos long, start_ms long, end_ms long, norm string"), size)
    got = quality.duplicate_merge(df.withColumn("body", F.col("norm")))
    assert sorted(map(tuple, got.select("track_id", "cue_pos", "start_ms", "end_ms", "body", "parts").collect())) == sorted(want)


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("share", [0.0, 0.15, 0.7])
def test_gate(spark, size, share):
    rng = random.Random(f"{size}{share}")
    rows, want = [], []
    for track, count in tracks(rng, huge=250).items():
        time, last = 0, None
        for n in range(1, count + 1):
            time += rng.choice([0, 1, 200_000, 500_000, 2_600_000])
            changed = rng.random() < share
            kept = last is None or changed or time - last >= SECOND
            last = time if kept else last
            rows.append((track, n, time, "x", changed))
            want.append((track, n, kept))
    df = blocked(spark.createDataFrame(rows, "track_id long, n long, ts_us long, text string, changed boolean"), size, "n")
    got = sampling.ocr_interval_gate(df, SECOND).select("track_id", "n", "kept")
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("noise", [100, 900, 5000])
def test_pts_repair(spark, size, noise):
    rng = random.Random(f"{size}{noise}")
    rows, want = [], []
    for track, count in tracks(rng, huge=250).items():
        last = -1.0
        for idx in range(count):
            pts = rng.choice([idx * 250.0, idx * 250.0 + rng.randint(-noise, noise), -5.0, 7 * 86_400_000.0 + 1])
            keep = pts >= 0 and last < pts / 1000 <= 7 * 86_400
            last = pts / 1000 if keep else max(idx / 4, last + 0.25)
            rows.append((track, idx, pts, 4.0))
            want.append((track, idx, round(last * 1e6), not keep))
    df = spark.createDataFrame(rows, "track_id long, idx long, pts_ms double, fps double")
    df = ordered.with_blocks(df.withColumn("p", F.col("idx") + 1), "p", size)
    got = sampling.pts_repair(df).select("track_id", "idx", "ts_us", "repaired")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_dense_track_of_a_hundred_blocks(spark):
    """Three rounds of eight; functions of blocks stay small once they are combined."""
    rng, rows, want, time, last, at = random.Random(9), [], [], 0, None, -1.0
    for n in range(1, 1601):
        time += rng.choice([1000, 20_000, 90_000])
        changed = rng.random() < 0.01
        kept = last is None or changed or time - last >= SECOND
        last = time if kept else last
        pts = rng.choice([n * 40.0, n * 40.0 - rng.randint(0, 400), -1.0])
        keep = pts >= 0 and at < pts / 1000
        at = pts / 1000 if keep else max((n - 1) / 25, at + 0.04)
        rows.append((1, n, n - 1, time, "x", changed, pts, 25.0))
        want.append((n, kept, round(at * 1e6), not keep))
    df = blocked(spark.createDataFrame(rows, "track_id long, n long, idx long, ts_us long, text string, changed boolean, pts_ms double, fps double"), 16, "n")
    assert df.select("blk").distinct().count() == 100
    kept = {r.n: r.kept for r in sampling.ocr_interval_gate(df, SECOND).collect()}
    repaired = {r.idx: (r.ts_us, r.repaired) for r in sampling.pts_repair(df).collect()}
    assert [(n, kept[n], *repaired[n - 1]) for n in range(1, 1601)] == want


def test_functions_of_blocks_compose(spark):
    """f then g equals the function of both blocks at every entry."""
    import pandas as pd
    rng = random.Random(4)
    for _ in range(300):
        sizes, time, rows = (rng.randint(1, 6), rng.randint(1, 6)), 0, []
        for n in range(sum(sizes)):
            time += rng.choice([0, 1, 3, 7])
            rows.append({"track_id": 1, "blk": 0, "n": n, "ts_us": time, "changed": rng.random() < 0.2, "idx": n, "pts_ms": rng.choice([n * 2.0, n * 2.0 - 7, -1.0, 30.0]), "fps": 500.0})
        pieces = [pd.DataFrame(rows[:sizes[0]]), pd.DataFrame(rows[sizes[0]:]), pd.DataFrame(rows)]
        f, g, both = (sampling._gate_summary(5)(p)["fn"][0] for p in pieces)
        leave = sampling._gate_exit(5)
        # The last row kept before a block is not after the block's first row.
        for x in (sampling.NEVER, *range(-6, rows[0]["ts_us"] + 1)):
            assert leave(sampling._gate_both(5)(f, g), x) == leave(both, x) == leave(g, leave(f, x))
        f, g, both = (sampling._repair_summary(p)["fn"][0] for p in pieces)
        leave = sampling._repair_exit
        for x in [sampling.BEFORE_FIRST, *(rng.randint(-1, 60) * 10 ** 9 for _ in range(40))]:
            assert leave(sampling._repair_both(f, g), x) == leave(both, x) == leave(g, leave(f, x))


@pytest.mark.parametrize("size", SIZES)
def test_cues_from_samples(spark, size):
    rng = random.Random(size)
    rows, want = [], []
    for track, count in tracks(rng, huge=220).items():
        mine, time = [], 0
        for n in range(1, count + 1):
            time += rng.choice([500_000, 500_000, 1_500_000])
            mine.append((n, time, rng.choice(["", "A", "a!", "B", "?"]), n > 1 and rng.random() < 0.2))
        rows += [(track, *m) for m in mine]
        want += [(track, *c) for c in cue_loop(mine)]
    df = blocked(spark.createDataFrame(rows, "track_id long, n long, ts_us long, text string, changed boolean"), size, "n")
    events = cue_ops.transition_backdate(sampling.gate_context(sampling.ocr_interval_gate(df, SECOND)))
    got = cue_ops.cue_build(cue_ops.event_intervals(events)).select("track_id", "cue_n", "start_us", "end_us", "text")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def cue_loop(samples):
    from cuelake.functions.text import fold_text
    events, clock, prior, word = [], None, None, None
    for n, time, text, changed in samples:
        if clock is None or changed or time - clock >= SECOND:
            at = time
            if word is not None and fold_text(text) != fold_text(word) and not changed:
                at = max(clock, round((prior + time) / 2))
            events.append((n, at, text))
            clock, word = time, text
        prior = time
    end_of_track, cues = samples[-1][1] + 500_000, []
    for i, (n, at, text) in enumerate(events):
        if not text:
            continue
        end = events[i + 1][1] if i + 1 < len(events) else end_of_track
        end = at + 500_000 if end <= at else end
        if i and events[i - 1][2] and cues and fold_text(cues[-1][3]) == fold_text(text):
            cues[-1][2] = end
        else:
            cues.append([n, at, end, text])
    return cues


@pytest.mark.parametrize("size", SIZES)
def test_length_bucket_pack(spark, size):
    rng = random.Random(size)
    rows, want = [], []
    for source, count in tracks(rng, many=4, huge=300).items():
        mine = sorted((min(2048, max(32, -(-w // 8) * 8)), seq, w) for seq, w in
                      ((i, rng.choice([20, 90, 95, 100, 400, 900, 5000, rng.randint(1, 3000)])) for i in range(1, count + 1)))
        batch, group = -1, []
        for target, seq, width in mine:
            if not group or len(group) == 8 or target > group[0] * 1.25:
                batch, group = batch + 1, []
            group.append(target)
            rows.append((str(source), seq, width, 48))
            want.append((str(source), seq, target, batch))
    df = blocked(spark.createDataFrame(rows, "source string, seq long, width long, height long"), size, "seq")
    assert sorted(map(tuple, recognise.length_bucket_pack(df).collect())) == sorted(want)


@pytest.mark.parametrize("size", SIZES)
def test_document_samples(spark, size):
    rng = random.Random(size)
    rows, want = [], []
    for track, count in {0: 200, 1: 24, 2: 25, 3: 47, 4: 1, 5: 60}.items():
        mine = [(p, rng.choice(["ab", "abc d"]) if track != 5 else "1") for p in range(1, count + 1)]
        good = [m for m in mine if sum(c.isalpha() for c in m[1]) >= 3] or mine
        if len(good) > 24:
            good = [good[s * (len(good) - 1) // 23] for s in range(24)]
        rows += [(track, *m) for m in mine]
        want += [(track, *m) for m in good]
    df = blocked(spark.createDataFrame(rows, "track_id long, pos long, text string"), size)
    assert sorted(map(tuple, planning.document_samples(df).collect())) == sorted(want)


@pytest.mark.parametrize("size", SIZES)
def test_summary_and_collapse_and_order(spark, size):
    rng = random.Random(size)
    start, end = "--- X PIPELINE 2 RESULT START ---", "--- X PIPELINE 2 RESULT END ---"
    rows, want = [], {}
    for run, count in tracks(rng).items():
        inside = over = False
        for line_no in range(1, count + 1):
            line = rng.choice([start, end, "K1=a=b", "K2=", "=no", "plain", f"K3={line_no}"])
            rows.append((run, line_no, line))
            if over:
                continue
            if line == start:
                inside = True
            elif inside and line == end:
                over = True
            elif inside and line.find("=") > 0:
                key, _, value = line.partition("=")
                want[run, key] = value
    df = blocked(spark.createDataFrame(rows, "run_id long, line_no long, line string"), size, "line_no")
    assert {(r.run_id, r.key): r.value for r in runs.summary_parse(df).collect()} == want

    steps = [(t, p, rng.choice("_ab"), rng.random()) for t, n in tracks(rng).items() for p in range(1, n + 1)]
    df = blocked(spark.createDataFrame(steps, "crop_id long, step long, class string, score double"), size, "step")
    got = {r.crop_id: (r.text, r.confidence) for r in recognise.ctc_collapse(df, "_").collect()}
    for crop in {s[0] for s in steps}:
        mine = [s for s in steps if s[0] == crop]
        kept = [s for i, s in enumerate(mine) if s[2] != "_" and (i == 0 or mine[i - 1][2] != s[2])]
        text, confidence = got[crop]
        assert text == "".join(s[2] for s in kept)
        assert confidence == pytest.approx(sum(s[3] for s in kept) / len(kept) if kept else 0.0)


def test_parts_keep_whole_files(spark):
    from cuelake.operators import export
    rows = [(1, p, p * 1000, p * 1000 + 500, f"t{p}") for p in range(1, 24)]
    df = blocked(spark.createDataFrame(rows, "track_id long, pos long, start_ms long, end_ms long, text string"), 7)
    for fn in (export.export_srt, export.export_txt, export.export_md, export.export_ttml):
        whole = fn(df).first().content
        parts = fn(df, part_cues=5).orderBy("part_no").collect()
        assert len(parts) == 5 and "".join(p.content for p in parts) == whole


def test_reading_order_of_a_crowded_frame(spark):
    rng = random.Random(1)
    rows = [(0 if i % 3 else i, i, float(rng.randint(0, 99)), float(rng.randint(0, 5000)), 100.0, f"t{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "frame long, seq long, y1 double, x1 double, height double, text string")
    want = {}
    for frame, seq, y, x, h, text in sorted(rows, key=lambda r: (r[0], round(r[2] / 6), r[3], r[1])):
        want.setdefault(frame, []).append(text)
    assert {r.frame: r.text.split("\n") for r in recognise.reading_order(df).collect()} == want


@pytest.mark.parametrize("size", SIZES)
def test_decided_cues_do_not_depend_on_blocks(spark, size):
    from cuelake.operators import responses
    rng = random.Random(size)
    cues = [(t, p, 100 * p, 100 * p + 50, "x") for t, n in tracks(rng, many=30).items() for p in range(1, n + 1)]
    # Track 1 and every third other one lack a decision or have an empty one; the huge track is whole.
    said = [(t, p, None if t % 3 == 1 and p == 1 and t % 2 else rng.choice(["a", " b\t", "", "　"])) for t, p, *_ in cues if not (t % 3 == 1 and p == 1 and t % 2 == 0)]
    table = blocked(spark.createDataFrame(cues, "track_id long, pos long, start_ms long, end_ms long, text string"), size)
    found = responses.decided_cues(table, spark.createDataFrame(said, "track_id long, pos long, text string"))
    want, seen = [], {}
    for t, p, text in sorted(said, key=lambda r: r[:2]):
        if t % 3 != 1 and text.strip():
            seen[t] = seen.get(t, 0) + 1
            want.append((t, seen[t], 100 * p, text))
    assert sorted(tuple(r) for r in found.select("track_id", "pos", "start_ms", "text").collect()) == want


def test_trimmed_equals_strip(spark):
    from cuelake.functions.text import BLANK_CHARS, is_blank, strip, trimmed
    rng = random.Random(5)
    texts = ["".join(rng.choice([*BLANK_CHARS, *"ab槽ࠀ\x1c\x00\xe9", "\U0001d49c"]) for _ in range(rng.randint(0, 5))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    same = trimmed(F.col("t")).eqNullSafe(strip(F.col("t"))) & is_blank(F.col("t")).eqNullSafe(strip(F.col("t")) == "")
    assert df.where(~same).isEmpty()
