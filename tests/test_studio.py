import pytest
from pyspark.sql import functions as F

from shoal.operators import ledger, library, report, timeline
from shoal.plans import studio
from shoal.sources import files


def asset(path, rgb, kind="image", mtime=1000.0, quality=0.8, error=None):
    swatches = [("#000000", list(rgb), 0.7), ("#111111", [min(255, c + 12) for c in rgb], 0.3)]
    bright = sum(rgb) / 765
    return (path, kind, "f", 1080, 1920, 8.0 if kind == "video" else 0.0, 30.0, "h264", False, 10, mtime, None, "local", (swatches, bright, 0.35, 0.2, 0.2, 0.12, 0.18), (0.5, 0.5, 0.0), quality, error)


@pytest.fixture(scope="module")
def assets(spark):
    rows = [asset(f"/lib/{'abcd'[k % 4]}/cream_item_{k:02d}.jpg", (230 - k * 5, 220 - k * 4, 205 - k * 6), mtime=1000.0 + 5000 * k) for k in range(16)]
    rows += [asset(f"/lib/v/clip_{k}.mp4", (225, 215 - 9 * k, 200), "video", 90_000.0 * k + 7) for k in range(6)]
    rows += [asset(f"/lib/n/night_{k}.jpg", (18, 26 + k, 54), mtime=7.0e6 + 900 * k) for k in range(6)] + [asset("/lib/bad.jpg", (1, 1, 1), error="decode")]
    return spark.createDataFrame(rows, library.SCHEMA)


def empty_posts(spark):
    return spark.createDataFrame([], ledger.SCHEMA)


def test_make_is_on_mood_timed_and_repeatable(spark, assets):
    r = studio.Request("clean-girl", "s1", duration=6.0, bpm=120.0, now=1e6, hooks=["a", "b"])
    board, again = studio.make(spark, r, assets, empty_posts(spark)), studio.make(spark, r, assets, empty_posts(spark))
    shots = board.shots.orderBy("place").collect()
    assert [s["path"] for s in shots] == [s["path"] for s in again.shots.orderBy("place").collect()]
    assert not any("/n/" in s["path"] or "bad" in s["path"] for s in shots)
    assert [s["place"] for s in shots] == list(range(1, len(shots) + 1)) and len(shots) >= 3
    assert shots[-1]["cut"] == pytest.approx(6.0, abs=0.5)
    assert timeline.verify(board.shots, "slug", "place").count() == 0
    assert board.copy.first()["hook"] in ("a", "b") and board.provenance.count() == len(shots)
    assert board.post.first()["assets"] == [s["path"] for s in shots]


def test_batch_shares_its_history(spark, assets):
    requests = [studio.Request("clean-girl", f"b{k}", duration=3.0, bpm=120.0, now=1e6) for k in range(2)] + [studio.Request("nope", "bad")]
    boards, errors, posts = studio.make_batch(spark, requests, assets, empty_posts(spark))
    used = [set(b.post.first()["assets"]) for b in boards]
    assert len(used) == 2 and used[0].isdisjoint(used[1]) and len(errors) == 1 and posts.count() == 2


def test_leaderboard_and_status(spark, assets):
    top = studio.leaderboard(spark, assets, empty_posts(spark), 1e6, shots=2).collect()
    assert len(top) == 13 and top[0]["mean_score"] >= top[-1]["mean_score"] > 0
    s = studio.status(assets, empty_posts(spark), 1e6).first()
    assert (s["posts"], s["available"]) == (0, assets.count())


def test_scan_analyses_only_what_changed(spark, tmp_path):
    root = tmp_path / "media"
    root.mkdir()
    (root / "a.jpg").write_bytes(b"1")
    (root / "b.mov").write_bytes(b"22")
    seen = []

    def analyse(df):
        rows = df.orderBy("path").collect()
        seen.append([r["path"].rsplit("/", 1)[1] for r in rows])
        made = [asset(r["path"], (9, 9, 9)) for r in rows]
        made = [(*m[:2], r["fingerprint"], *m[3:9], r["bytes"], r["mtime"], *m[11:]) for m, r in zip(made, rows, strict=True)]
        return spark.createDataFrame(made, library.SCHEMA)

    index = str(tmp_path / "index")
    assert studio.scan(spark, [str(root)], index, analyse).count() == 2
    (root / "b.mov").write_bytes(b"changed")
    (root / "c.png").write_bytes(b"3")
    assert studio.scan(spark, [str(root)], index, analyse).count() == 3
    assert seen == [["a.jpg", "b.mov"], ["b.mov", "c.png"]]


def test_scan_command_reads_probes(spark, tmp_path, capsys):
    import json

    from shoal import cli

    root, p = tmp_path / "media", str(tmp_path / "proj")
    root.mkdir()
    (root / "a.jpg").write_bytes(b"1")
    (root / "a.jpg.probe.json").write_text(json.dumps({"streams": [{"codec_type": "video", "codec_name": "mjpeg", "width": 1080, "height": 1920}]}))
    (root / "b.mov").write_bytes(b"22")
    assert cli.main(["--project", p, "init", str(root)]) == 0 and cli.main(["--project", p, "--verbose", "scan"]) == 0
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_table(spark, f"{p}/library", library.SCHEMA, studio.INDEX_VERSION).collect()}
    assert (got["a.jpg"]["width"], got["a.jpg"]["kind"], got["a.jpg"]["error"]) == (1080, "image", None) and 0.5 < got["a.jpg"]["quality"] <= 1
    assert got["b.mov"]["error"] == "no probe" and "no probe" in capsys.readouterr().out
    assert cli.missing_filters(" T.. xfade V->V x\n ... scale V->V y", ["scale", "eq"]) == ["eq"]


def test_default_roots(tmp_path):
    for name in ("Downloads", "Pictures/My.photoslibrary/originals", "Desktop.txt"):
        (tmp_path / name).mkdir(parents=True)
    assert [r.removeprefix(f"{tmp_path}/") for r in files.default_roots(str(tmp_path))] == ["Downloads", "Pictures", "Pictures/My.photoslibrary/originals"]


def test_copy_rotates_within_a_batch(spark):
    pools = spark.createDataFrame([("p", "T", "B", ["One", "two", "three"], [], ["go", "see"], "bye", ["a", "b", "c"], ["#d"], ["", "e"]), ("q", "T2", "B2", [], ["only"], [], "", [], [], [])], report.POOLS)
    posts = spark.createDataFrame([("p", k, f"s{k}") for k in range(5)] + [("q", 0, "x"), ("gone", 0, "y")], "preset string, pos long, slug string")
    got = {(r["preset"], r["pos"]): r for r in report.write_batch(posts, pools).collect()}
    hooks = [got["p", k]["hook"] for k in range(5)]
    assert sorted(hooks[:3]) == ["One", "three", "two"] and set(hooks[3:]) <= set(hooks[:3]) and len(got) == 6
    assert got["p", 0]["caption"] == "B" and got["p", 0]["cta"] in ("go", "see") and got["p", 0]["signoff"] == "bye"
    assert {"#d"} < set(got["p", 1]["hashtags"]) and len(got["p", 1]["hashtags"]) >= 4
    assert (got["q", 0]["hook"], got["q", 0]["caption"], got["q", 0]["cta"], got["q", 0]["hashtags"]) == ("T2", "only", "", [])
    again = {(r["preset"], r["pos"]): r["hook"] for r in report.write_batch(posts, pools).collect()}
    assert again == {k: r["hook"] for k, r in got.items()}


def test_grid_of_a_track(spark):
    import numpy as np
    import pandas as pd

    n = 22050 * 3
    x = np.zeros(n)
    for k in range(6):
        at = int(k * 0.5 * 22050)
        x[at : at + 300] = np.random.default_rng(k).normal(size=300)
    bpm, offset, _ = studio.grid(spark, spark.createDataFrame(pd.DataFrame({"track": 1, "n": range(n), "value": x})), 100, 3)
    assert bpm == pytest.approx(120, rel=0.06) and 0 <= offset < 1
    assert studio.grid(spark, None, 500, 1)[:2] == (300.0, 0.0)


def test_sheet_and_chunks(spark):
    assert studio.contact_grid(7) == (5, 2, 3) and studio.contact_grid(3) == (3, 1, 0)
    got = studio.chunked(spark.range(5), "id", 2).orderBy("id").collect()
    assert [r["chunk"] for r in got] == [0, 0, 1, 1, 2]


def test_cli(spark, assets, tmp_path, monkeypatch):
    from shoal import cli

    p = str(tmp_path / "proj")
    assert cli.main(["--project", p, "init", "/x", "--preset", "clean-girl"]) == 0
    files.save_table(assets, f"{p}/library", studio.INDEX_VERSION)
    for args in (["presets"], ["status"], ["make", "--duration", "3", "--bpm", "120"], ["preview", "--preset", "nope"]):
        assert cli.main(["--project", p, *args]) == int("nope" in args)
    assert files.read_table(spark, f"{p}/posts", ledger.SCHEMA).count() == 1
    assert F is not None
