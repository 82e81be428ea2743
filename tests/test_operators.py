import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoal.functions import numbers, text
from shoal.operators import layout, ledger, library, report, selection, signal, timeline, website
from shoal.plans import profiles
from shoal.sources import files
from shoal.streaming import live


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_profiles(spark):
    p = profiles.profiles(spark)
    assert p.count() == 13 and p.where("size(palette_hex) <> 6").count() == 0
    with pytest.raises(ValueError):
        profiles.profiles(spark, [profiles.rows()[0]])


@pytest.mark.parametrize("bpm", [85, 100, 120, 150])
def test_tempo_of_clicks(spark, bpm):
    fps = signal.RATE / signal.HOP
    n = int(12 * fps)
    env = np.full(n, 0.01)
    for k in range(int(12 * bpm / 60)):
        env[min(n - 1, int(round(k * 60 / bpm * fps)))] = 1.0
    df = spark.createDataFrame(pd.DataFrame({"track": 1, "i": range(n), "value": env}))
    df = signal.smooth(df, "track", "i", "value")
    low, high = max(2, int(fps * 60 / 180)), int(fps * 60 / 60)
    got = signal.tempo(signal.autocorrelation(df, "track", "i", "value", low, high), "track", fps).first()
    assert got["bpm"] == pytest.approx(bpm, rel=0.02) and got["confidence"] > 0.2


def test_onset_envelope_rises_with_clicks(spark):
    n = signal.RATE // 2
    x = np.zeros(n)
    at = n // 2
    x[at : at + 400] = np.sin(np.arange(400))
    df = spark.createDataFrame(pd.DataFrame({"track": 1, "n": range(n), "value": x}))
    env = signal.onset_envelope(df).orderBy("i").toPandas()
    assert env["value"].min() == 0 and env["value"].max() == 1
    assert abs(env["value"].idxmax() * signal.HOP - at) < 6 * signal.HOP


def test_goertzel_is_a_dft_bin():
    x = np.random.default_rng(0).normal(size=256)
    assert signal.goertzel(x, 9) == pytest.approx(abs(np.fft.fft(x)[9]) ** 2 / 256)


@pytest.mark.parametrize("place", [2, 20, 40])
def test_best_window_finds_the_subject(spark, place):
    df = spark.createDataFrame([("f", i, 20.0 if place <= i < place + 12 else 1.0) for i in range(64)], "f string, i int, v double")
    got = signal.best_window(df, "f", "i", "v", 16).first()
    assert abs(got["centre"] - (place + 6) / 64) < 0.14 and got["confidence"] > 0.5
    flat = signal.best_window(df.withColumn("v", F.lit(1.0)), "f", "i", "v", 16).first()
    assert (flat["centre"], flat["confidence"]) == (0.5, 0.0)



def test_focus_of_a_frame(spark):
    rows = [("f", r, c, 200.0 if 40 <= c < 52 and 10 <= r < 26 and (r + c) % 2 else 90.0, 0.0) for r in range(36) for c in range(64)]
    px = signal.interest(spark.createDataFrame(rows, "f string, row int, col int, luma double, saturation double"), ["f"])
    got = signal.frame_focus(signal.profiles(px, ["f"]), "f", 64, 36, 9 / 16).first()
    assert abs(got["x"] - 46 / 64) < 0.14 and got["y"] == 0.5
    crop = one(spark, signal.crop_position(F.lit(0.7), F.lit(0.5), F.lit(0.8), F.lit(64), F.lit(36), 9 / 16))
    assert crop["axis"] == "x" and 0.5 < crop["fraction"] < 1
    assert one(spark, signal.crop_offset(F.lit(0.9), F.lit(100), F.lit(40))) == 60


def test_kmeans_recovers_planted_clusters(spark):
    rng = np.random.default_rng(1)
    planted = [(230, 40, 40), (30, 200, 60), (20, 30, 220)]
    rows = [("a", *(int(v) for v in np.clip(rng.normal(c, 4), 0, 255))) for c in planted for _ in range(60)]
    got = signal.palettes(spark.createDataFrame(rows, "f string, r int, g int, b int"), "f", k=3).toPandas()
    for c in planted:
        assert min(((got[["r", "g", "b"]] - c) ** 2).sum(axis=1)) < 60
    assert got["weight"].sum() == pytest.approx(1)


def stepped(total, n, options):
    """Beats by buying one step at a time."""
    levels = sorted(set(options or [2]))
    if total < n * levels[0]:
        base = max(1, total // n)
        return [base + (p < total - base * n) for p in range(n)]
    own, left = [levels[0]] * n, total - n * levels[0]
    while left:
        bought = 0
        for p in range(n):
            above = [x for x in levels if x > own[p]]
            price = above[0] - own[p] if above else 1
            if price <= left:
                own[p], left, bought = own[p] + price, left - price, bought + 1
        if not bought:
            return [x + (p < left) for p, x in enumerate(own)]
    return own


def test_allocated_beats(spark):
    cases = [(f"b{k}", total, n, options) for k, (total, n, options) in enumerate((t, n, o) for t in (1, 5, 9, 16, 17, 24, 40, 200) for n in (1, 2, 6, 9) for o in ([1, 2, 4], [2], [4, 2, 2], [1, 8], [], None))]
    df = spark.createDataFrame(cases + [("none", 9, 0, [1])], "board string, total int, shots int, options array<int>")
    got = {}
    for r in timeline.allocate_beats(df).collect():
        got.setdefault(r["board"], {})[r["index"]] = r["beats"]
    assert len(got) == len(cases)
    import hashlib

    for board, total, n, options in cases:
        order = sorted(range(n), key=lambda k: (0 if k == 0 else 1 if k == n - 1 else 2, hashlib.sha256(f"{board}:{k}".encode()).hexdigest()))
        assert [got[board][k] for k in order] == stepped(total, n, options), (total, n, options)


def test_timeline_holds_and_breaks(spark):
    rng = random.Random(2)
    rows = [(b, k, rng.choice([1, 2, 4])) for b in range(5) for k in range(9)]
    cuts = timeline.plan_cuts(spark.createDataFrame(rows, "board int, index int, beats int"), "board", "index", "beats", F.lit(60 / 104))
    shots = timeline.shot_spans(timeline.transition_lengths(cuts, "board", "index", F.lit(0.3)), "board", "index")
    assert timeline.verify(shots, "board", "index").count() == 0
    bad = shots.withColumn("length", F.col("length") + F.when((F.col("board") == 2) & (F.col("index") == 4), 0.5).otherwise(0.0))
    assert {r["what"] for r in timeline.verify(bad, "board", "index").collect()} == {"sum", "chain"}


@pytest.mark.parametrize("tracking", [0, 6])
def test_fitted_text_holds_the_safe_width(tracking):
    for t in ("quiet mornings", "SLOW " * 12, "x" * 80, "a", ""):
        lines, size, width = layout.fit(t, 68, 1080, 3, tracking)
        assert len(lines) <= 3 and size >= 14 and (width <= 1080 * layout.SAFE_WIDTH or size == round(68 * layout.MIN_SCALE))
    assert layout.fit("quiet", 68, 1080)[1] == 68 and layout.fit("", 68, 1080) == ([], 68, 0.0)
    two = "wide open spaces at dusk"  # on one line at most: the size goes straight to where it fits, less two hundredths
    assert layout.fit(two, 68, 600, 1)[1] == round(max(68 * 0.62, 68 * 0.98 * 600 * 0.84 / layout.measure(two, 68)))


@pytest.mark.parametrize("tracking", [0, 6])
def test_split_words_fit_and_are_as_long_as_can_be(tracking):
    for word in ("x" * 80, "Mississippi" * 5, "W"):
        parts = layout.split_word(word, 60, 300, tracking)
        assert "".join(parts) == word
        fits = lambda p: len(p) == 1 or layout.measure(layout.spaced(p, tracking), 60) <= 300
        assert all(map(fits, parts)) and not any(fits(a + b[0]) for a, b in zip(parts, parts[1:], strict=False))


def test_measures_agree(spark):
    for t in ("Mountain view, 24!", "il' WM|(x)"):
        assert one(spark, text.width(F.lit(t), 50.0)) == pytest.approx(layout.measure(t, 50.0))


def test_greedy_equals_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for preset in ("p", "q"):
        for k in range(25):
            base = rng.choice([0, 40, 80])
            labs = [[base + rng.random() * 3, rng.random() * 3, 0.0] for _ in range(3)]
            rows.append((preset, f"f/{k:02d}", labs, rng.choice(["f", "g"]), float(rng.choice([0, 1000, 1030, 9000])), f"stem{k}_long_name", rng.choice(["image", "video"]), round(rng.random(), 3)))
    cols = ["preset", "path", "labs", "folder", "mtime", "stem", "kind", "score"]
    got = selection.greedy_diverse(spark.createDataFrame(rows, "preset string, path string, labs array<array<double>>, folder string, mtime double, stem string, kind string, score double"), 5).collect()

    def sim(a, b):
        near = sum(min(math.dist(x, y) for y in b["labs"]) for x in a["labs"]) / 3
        s = 0.7 * max(0, min(1, 1 - near / 30)) + 0.18 * (a["folder"] == b["folder"]) + 0.22 * (abs(a["mtime"] - b["mtime"]) < 60 and a["mtime"] > 0)
        pre = next((i for i, (x, y) in enumerate(zip(a["stem"], b["stem"], strict=False)) if x != y), min(len(a["stem"]), len(b["stem"])))
        return min(1, s + 0.15 * (a["stem"] == b["stem"] or pre >= max(8, int(0.75 * min(len(a["stem"]), len(b["stem"]))))))

    for preset in ("p", "q"):
        pool = sorted((dict(zip(cols, r, strict=True)) for r in rows if r[0] == preset), key=lambda r: (-r["score"], r["path"]))
        chosen = []
        target = round(5 * 0.35)
        while len(chosen) < 5:
            left = [r for r in pool if r not in chosen]
            need, slots = max(0, target - sum(c["kind"] == "video" for c in chosen)), 5 - len(chosen)

            def value(r, chosen=chosen, need=need, slots=slots):
                worst = max((sim(r, c) for c in chosen), default=0)
                nudge = 0.12 * min(1, need / slots) if r["kind"] == "video" else -0.10 if need >= slots else 0
                return worst < 0.9, r["score"] - 0.55 * max(0, worst - 0.45) / 0.55 * 0.6 + nudge

            chosen.append(max(left, key=lambda r: value(r)))
        assert [r["path"] for r in sorted((g for g in got if g["preset"] == preset), key=lambda g: g["place"])] == [c["path"] for c in chosen]


def test_ledger(spark):
    now = 1_700_000_000.0
    posts = spark.createDataFrame([("a", "p", now - 21 * ledger.DAY, ["x", "x", "y"], "o", 1.0), ("b", "q", now - 22 * ledger.DAY, ["z"], "o", 1.0), ("c", "p", now, [], "o", 1.0)], ledger.SCHEMA)
    assert {r["asset"] for r in ledger.cooling(posts, 21, F.lit(now)).collect()} == {"x", "y"}
    assert ledger.cooling(posts, 0, F.lit(now)).count() == 0
    assert {r["asset"]: r["uses"] for r in ledger.usage_counts(ledger.uses(posts)).collect()} == {"x": 2, "y": 1, "z": 1}
    new = spark.createDataFrame([("a", "r", now, ["n"], "o", 2.0)], ledger.SCHEMA)
    assert {(r["slug"], r["preset"]) for r in ledger.upsert(posts, new).collect()} == {("a", "r"), ("b", "q"), ("c", "p")}
    assert tuple(ledger.summary(posts, ledger.uses(posts), F.lit(now)).first()) == (3, 1, 3)
    assert [r["slug"] for r in ledger.recent(posts, 2, "p").collect()] == ["c", "a"]


def test_incremental_refresh(spark):
    cached = spark.createDataFrame([("a", 1, 10.0, "f", "old"), ("b", 1, 10.0, "f", "old"), ("c", 1, 10.0, "", "old"), ("gone", 1, 1.0, "f", "old")], "path string, bytes long, mtime double, fingerprint string, note string")
    found = spark.createDataFrame([("a", 1, 10.9), ("b", 2, 10.0), ("c", 1, 10.0), ("d", 5, 1.0)], "path string, bytes long, mtime double")
    got = library.refresh(found, cached, lambda df: df.select("*", F.lit("f").alias("fingerprint"), F.lit("new").alias("note")))
    assert {(r["path"], r["note"]) for r in got.collect()} == {("a", "old"), ("b", "new"), ("c", "new"), ("d", "new")}


def test_listing_and_fingerprints(spark, tmp_path):
    for name in ("a.JPG", "b/c.mov", "b/._x.jpg", ".cache/d.png", "b/e_thumb.png", "b/f.txt", "Library/g.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 200_000)
    got = files.candidates(spark, [str(tmp_path), str(tmp_path / "b")])
    assert {r["path"].removeprefix(str(tmp_path)) for r in got.collect()} == {"/a.JPG", "/b/c.mov"}
    prints = {r["path"]: r["fingerprint"] for r in files.fingerprints(got).collect()}
    import hashlib

    name = f"{tmp_path}/a.JPG"
    second = str(int((tmp_path / "a.JPG").stat().st_mtime))
    assert len(prints) == 2 and prints[name] == hashlib.sha1(b"200000" + second.encode() + b"x" * 131_072).hexdigest()
    gone = spark.createDataFrame([(f"{tmp_path}/none.jpg", 5, 1.0)], "path string, bytes long, mtime double")
    assert files.fingerprints(gone).first()["fingerprint"] == ""


def test_probe(spark):
    payload = {"format": {"duration": "7.5", "tags": {"Creation_Time": "2024"}}, "streams": [{"codec_type": "audio"}, {"codec_type": "video", "codec_name": "h264", "width": 1920, "height": 1080, "avg_frame_rate": "30000/1001", "side_data_list": [{"rotation": -90}]}]}
    v = one(spark, files.probe_info(F.lit(json.dumps(payload))))
    assert (v["width"], v["height"], v["duration"], v["codec"], v["has_audio"], v["created"]) == (1080, 1920, 7.5, "h264", True, "2024") and v["fps"] == pytest.approx(29.97, abs=0.01)
    v = one(spark, files.probe_info(F.lit('{"streams": []}')))
    assert (v["width"], v["height"], v["duration"], v["has_audio"]) == (0, 0, 0.0, False)


def test_seek_points_and_pixels(spark):
    assert one(spark, files.seek_points(F.lit(10.0), F.lit(3))) == pytest.approx([0.5, 5.0, 9.5]) and one(spark, files.seek_points(F.lit(0.1), F.lit(3))) == [None]
    frames = spark.createDataFrame([("p", 0, 2, bytearray(range(14)))], "path string, frame int, columns int, data binary")
    assert [tuple(r)[2:] for r in files.unpack_rgb(frames).orderBy("row", "col").collect()] == [(0, 0, 0, 1, 2), (0, 1, 3, 4, 5), (1, 0, 6, 7, 8), (1, 1, 9, 10, 11)]


def test_tables_json_and_front_matter(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    files.save_table(df, f"{tmp_path}/t", version=4)
    assert files.read_table(spark, f"{tmp_path}/t", "k int, v string, w double", 4).collect() == [(1, "a", None)]
    assert files.read_table(spark, f"{tmp_path}/t", "k int", 5).count() == 0 and files.read_table(spark, f"{tmp_path}/none", "k int").count() == 0
    (tmp_path / "ok.json").write_text('{"a": 1,\n "b": 2}')
    (tmp_path / "bad.json").write_text("{")
    assert files.read_json(spark, f"{tmp_path}/*.json", "a int").collect() == [(1,)]
    (tmp_path / "e.md").write_text("---\ntitle: \"Tuesdays\"\norder: 3\npublished: false\n---\nbody here\n")
    r = files.front_matter(spark, f"{tmp_path}/e.md", {"title": "string", "order": "int", "published": "boolean", "icon": "string"}).first()
    assert (r["title"], r["order"], r["published"], r["icon"], r["body"].strip()) == ("Tuesdays", 3, False, None, "body here")


def test_settings(tmp_path):
    p = str(tmp_path / "c.json")
    files.Settings.load(p).override(handle="me", preset=None).save(p)
    got = files.Settings.load(p)
    assert got["handle"] == "me" and got["cooldown_days"] == 21.0


def test_text_functions(spark):
    cases = [
        (text.slugify(F.lit("Crème Brûlée — 2!")), "creme-brulee-2"), (text.slug_ascii(F.lit("***")), "untitled"), (text.title_case(F.lit("a bC dE")), "A BC DE"),
        (text.rate(F.lit("30000/1001")), 30000 / 1001), (text.rate(F.lit("1/0")), 0.0), (text.safe_double(F.lit("x")), 0.0), (text.human_duration(F.lit(75.25)), "1:15.2"),
        (text.meter(F.lit(0.5)), "#" * 10 + "-" * 10), (text.tracked(F.lit("ab cd"), 6), "a b   c d"), (text.hashtag(F.lit("x")), "#x"), (text.clock_minutes(F.lit("09:30")), 570),
        (text.full_caption(F.lit("hi"), F.lit("go"), F.array(F.lit("#a"), F.lit("#b"))), "hi\n\ngo\n\n#a #b"), (text.shared_stem(F.lit("holiday_01"), F.lit("holiday_02")), True), (text.shared_stem(F.lit("abc"), F.lit("abd")), False),
        (text.first_truthy(F.lit(""), F.lit("b")), "b"), (numbers.rgb_to_hex(F.lit(300), F.lit(16), F.lit(0)), "#ff1000"), (numbers.hue_distance(F.lit(350.0), F.lit(10.0)), 20.0), (numbers.closeness(F.lit(1.0), F.lit(1.0), 0), 1.0),
        (website.short_day(F.lit("Monday")), "Mon"), (numbers.blend(F.array(F.lit(0.0)), F.array(F.lit(10.0)), 0.5), [5.0]),
    ]
    for column, want in cases:
        got = one(spark, column)
        assert got == pytest.approx(want) if isinstance(want, float) else got == want
    seed = one(spark, text.stable_seed(F.lit("a"), F.lit(1)))
    import hashlib

    assert int(seed) == int(hashlib.sha256(b"a\x1f1").hexdigest()[:16], 16)
    assert one(spark, text.seed31(F.lit("a"), F.lit(1))) == int(seed) % 2**31
    assert one(spark, numbers.hex_to_rgb(F.lit("#abc"))) == [170, 187, 204]


def test_website(spark):
    rows = spark.createDataFrame([(True, "x"), (True, ""), (False, "y"), (None, "z")], "enabled boolean, text string")
    assert website.announcement(rows).count() == 1
    hours = spark.createDataFrame(website.HOURS, "day int, open string, close string")
    doc = json.loads(website.business_document(spark.createDataFrame([("n",)], "name string"), hours).first()["document"])
    assert doc["name"] == "n" and len(doc["openingHours"]) == 7
    marks = website.loop_marks(spark.createDataFrame([(1, 2), (1, 5)], "m int, k int"), "m", "k").orderBy("k").collect()
    assert [(r["index"], r["last"]) for r in marks] == [(1, False), (2, True)]
    pages = spark.createDataFrame([("/a", False), ("/b", True), (None, False)], "url string, noindex boolean")
    assert [r["value"] for r in website.sitemap(pages, "https://h/").collect()] == ["<url><loc>https://h/a</loc></url>"]


def test_reports(spark):
    posts = spark.createDataFrame([("w", "b", "T", 3, ["x", "y"], "c"), ("w", "a", "S", 1, [], "d")], "plan string, slug string, title string, shots int, sources array<string>, caption string")
    assert report.posting_plan(posts, "slug").orderBy("n").first()["section"].startswith("## 1. S\n- shots: 1")
    shots = spark.createDataFrame([("b", "p", "camera", 1.0, 2.0, 2.5), ("b", "p", "camera", 0.0, 1.0, 1.5), ("b", "q", "new", 3.0, 1.0, 1.0)], "board string, path string, source string, start double, visible double, length double")
    got = {r["path"]: (r["note"], [tuple(u) for u in r["uses"]]) for r in report.provenance(shots, report.source_notes(spark)).collect()}
    assert got == {"p": ("own recording", [(0.0, 1.0), (1.0, 2.0)]), "q": (report.UNCLASSIFIED, [(3.0, 1.0)])}
    assert one(spark, report.suggested_window(F.lit(3))) in {f"{d} {h}" for d, h in report.WINDOWS}
    assert json.loads(report.sidecar(posts).first()["document"])["slug"] in "ab"


def test_streams_equal_batch(spark, tmp_path):
    rows = [(k, (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=7 * k)).to_pydatetime(), k % 5, ("click", "view")[k % 2], float(k)) for k in range(300)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    events.write.parquet(f"{tmp_path}/in")
    stream = live.event_source(spark, f"{tmp_path}/in", events.schema)
    for name, query, mode in (("clicks", live.click_counts(stream), "complete"), ("first", live.first_uses(stream, "user_id"), "append"), ("week", live.trailing_counts(stream), "complete")):
        q = query.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("clicks").collect())) == sorted(map(tuple, live.click_counts(events).collect()))
    assert spark.table("first").count() == 5 and spark.table("week").count() > 0
