"""Images and their pixels, data sets that appear whole or not at all, fits of many videos, and options of many jobs."""

import struct
import zlib

import numpy as np
import pytest

from pitchflow.functions.geometry import fit_homographies
from pitchflow.operators import tactics as A
from pitchflow.sources import dataset, files, images


def filtered_png(pixels, kinds, colour):
    """A PNG of rows of bytes, each by the filter of its kind."""
    h, w, n = pixels.shape
    out, before = b"", np.zeros(w * n + n, dtype=int)
    for y in range(h):
        row = np.concatenate([np.zeros(n, dtype=int), pixels[y].ravel().astype(int)])
        a, b, c = row[:-n], before[n:], before[:-n]
        p = a + b - c
        paeth = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
        guess = {0: 0 * a, 1: a, 2: b, 3: (a + b) // 2, 4: paeth}[kinds[y]]
        out += bytes([kinds[y]]) + ((row[n:] - guess) % 256).astype(np.uint8).tobytes()
        before = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = zlib.compress(out)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"tEXt", b"x") + chunk(b"IDAT", data[:20]) + chunk(b"IDAT", data[20:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("colour", "n"), [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_of_every_filter(colour, n):
    pixels = np.random.default_rng(n).integers(0, 256, (5, 7, n))
    got = images.decode(filtered_png(pixels, [0, 1, 2, 3, 4], colour))
    want = np.repeat(pixels[:, :, :1], 3, axis=2) if n < 3 else pixels[:, :, 2::-1]
    assert (got == want).all() and (images.decode(images.encode_png(want)) == want).all()
    assert (images.decode(filtered_png(pixels, [4, 3, 2, 1, 0], colour)) == want).all()


def test_other_formats():
    assert images.decode(b"P6\n# made by hand\n2 1\n255\n\x01\x02\x03\x04\x05\x06").tolist() == [[[3, 2, 1], [6, 5, 4]]]
    for bad in (b"GIF89a", b"P6 1 1 65535 x", images.encode_png(np.zeros((1, 1, 3)))[:8]):
        with pytest.raises(ValueError):
            images.decode(bad)


def test_pixels_and_crops(spark, monkeypatch):
    picture = np.arange(4 * 5 * 3).reshape(4, 5, 3)
    rows = spark.createDataFrame([("a", bytearray(images.encode_png(picture))), ("b", None), ("c", bytearray(images.encode_png(picture[:, :1])))], "name string, content binary")
    monkeypatch.setattr(images, "PIXELS", 7)
    got = sorted(map(tuple, images.image_pixels(rows, "name").collect()))
    assert got == sorted((n, x, y, *map(int, picture[y, x])) for n, w in (("a", 5), ("c", 1)) for y in range(4) for x in range(w))
    boxes = spark.createDataFrame([("a", 1, -2.0, 1.0, 2.0, 9.0), ("a", 2, 3.0, 0.0, 3.0, 4.0), ("z", 3, 0.0, 0.0, 1.0, 1.0), ("b", 4, 0.0, 0.0, 1.0, 1.0)], "name string, crop bigint, x1 double, y1 double, x2 double, y2 double")
    assert sorted(map(tuple, images.crop_pixels(rows, boxes, ["name"]).collect())) == sorted((1, *map(int, p)) for p in picture[1:, :2].reshape(-1, 3))


def test_hue_and_saturation(spark):
    named = {(255, 0, 0): (120, 255), (0, 255, 0): (60, 255), (0, 0, 255): (0, 255), (0, 0, 0): (0, 0), (9, 9, 9): (0, 0), (128, 0, 255): (165, 255), (0, 128, 128): (30, 255), (100, 200, 50): (70, 191), (10, 0, 200): (179, 255), (1, 0, 255): (0, 255)}
    rows = spark.createDataFrame([k for k in named], "b int, g int, r int")
    assert {(r.b, r.g, r.r): (r.h, r.s) for r in images.with_hue(rows).collect()} == named


def data(spark, *extra):
    png = bytearray(images.encode_png(np.zeros((2, 2, 3))))
    return spark.createDataFrame([("train", f"i{k}", png, ["0 1 2 3 4"] * (k % 3)) for k in range(9)] + [("valid", "j", png, None), ("valid", "j", png, None), *extra], dataset.ROWS)


def test_a_data_set_is_whole(spark, tmp_path):
    path = tmp_path / "set"
    for _ in range(2):  # the second time it replaces the first
        dataset.write_dataset(data(spark).repartition(4), str(path), ["ball", "player"])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["set"]
    assert sorted(p.name for p in path.rglob("*.png")) == sorted([*(f"i{k}.png" for k in range(9)), "j.png"]) and (path / "valid/labels/j.txt").read_text() == ""
    assert files.read_labels(spark, str(path)).count() == 9
    told = {r.key: r.value for r in dataset.read_description(spark, str(path)).collect()}
    assert told == {"train": "train/images", "valid": "valid/images", "nc": "2", "names": '["ball", "player"]', "train_images": "9", "train_lines": "9", "valid_images": "1", "valid_lines": "0"}


def test_a_failed_data_set_leaves_nothing(spark, tmp_path):
    dataset.write_dataset(data(spark), str(tmp_path / "old"), ["ball"])
    broken = data(spark, ("train", "bad", None, None)).repartition(4)  # a null image can't be written
    for target in ("new", "old"):
        with pytest.raises(Exception):  # noqa: B017
            dataset.write_dataset(broken, str(tmp_path / target), ["ball"])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["old"] and len([*(tmp_path / "old").rglob("*.png")]) == 10


def test_fits_of_many_videos(spark):
    points = [(0, 0), (500, 0), (500, 400), (0, 400), (250, 100)]
    rows = [(v, float(x), float(y), x / 10 + v, y / 10) for v in (1, 2) for x, y in points] + [(3, 1.0, 1.0, 1.0, 1.0)]
    got = {r.video: r for r in fit_homographies(spark.createDataFrame(rows, "video bigint, pixel_x double, pixel_y double, pitch_x double, pitch_y double")).collect()}
    assert got[1].n == 5 and got[1].max_error_m < 1e-9 and got[2].h2 == pytest.approx(2) and got[1].h0 == pytest.approx(0.1)
    assert got[3].n == 1 and got[3].mean_error_m is None and got[3].h0 is None


def test_options_of_many_jobs(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("max_coast_frames: 7  # frames\n\n# note\nother: x\n")
    (tmp_path / "b.yaml").write_text("ball_confidence: 0.4\nno colon here\n")
    got = {r.job: (r.max_coast_frames, r.ball_confidence, r.process_noise) for r in files.read_all_options(spark, str(tmp_path)).collect()}
    assert got == {"a": (7, 0.1, 5.0), "b": (15, 0.4, 5.0)}


def test_files_come_whole(spark, tmp_path):
    made = spark.createDataFrame([(f"f{k}.txt", bytearray(b"x" * k)) for k in range(1, 6)], "name string, content binary")
    assert sorted(map(tuple, images.write_files(made, str(tmp_path / "in")).collect())) == [(f"f{k}.txt", k) for k in range(1, 6)]
    assert sorted((r.name, r.length) for r in files.read_binary(spark, str(tmp_path / "in")).collect()) == [(f"f{k}.txt", k) for k in range(1, 6)]


def test_bands_close(spark):
    """Away from the grid's edge every end of a segment is that of another one of its level; several meet where a level is a centre's own density."""
    rows = [("c", 0, i, j, np.exp(-((i - 10) ** 2) / 8 - (j - 8) ** 2 / 5)) for i in range(21) for j in range(17)]
    df = spark.createDataFrame([(c, t, (i + 0.5) * 5.0, (j + 0.5) * 4.0, float(round(d, 9)), 0.0) for c, t, i, j, d in rows], "clip_id string, team int, gx double, gy double, density double, share double")
    got = A.level_bands(df).collect()
    assert {r.level for r in got} >= set(range(1, 95))
    for level in (1, 50, 90):
        ends = [p for r in got if r.level == level for p in ((r.x1, r.y1), (r.x2, r.y2))]
        inner = [p for p in ends if 2.5 < p[0] < 102.5 and 2.0 < p[1] < 66.0]
        assert inner and all(inner.count(p) % 2 == 0 for p in inner)
    assert A.level_bands(df.filter("false")).count() == 0


def test_messages(spark):
    from pitchflow.schema import POSITION_LOG

    log = spark.createDataFrame([("a", i, i, 1, "person", 0, 1.0, 1.0, 1.0, 1.0, 9.0, False) for i in range(4)], POSITION_LOG)
    got = A.quality_messages(log, mean_error_m=2.345).first()
    assert got.warnings == ["teams_not_separated", "no_ball", "calibration_error"] and len(got.messages) == 3 and "2.3" in got.messages[2]


def test_fits_of_many_groups_are_those_of_each_alone(spark, monkeypatch):
    """Groups of unlike sizes over several batches, outliers, numbers missing and a null key among them; whole groups aren't fitted one by one."""
    from pitchflow.functions import geometry

    r, rows, want = np.random.default_rng(3), [], {}
    for video in [*range(40), None]:
        n = 3 + (video or 0) % 9
        pixel, shift = r.uniform(0, 1000, (n, 2)), r.uniform(-5, 5, 2)
        pitch = pixel * 0.1 + shift
        if video in (8, 17):
            pitch[0] += 60.0
        if video == 5:
            pixel[1, 0] = np.nan
        rows += [(video, *map(float, p), *map(float, q)) for p, q in zip(pixel, pitch, strict=True)]
        want[video] = None if n < 4 or video == 5 else (n, shift)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {x.video: x for x in fit_homographies(spark.createDataFrame(rows, "video bigint, pixel_x double, pixel_y double, pitch_x double, pitch_y double")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert set(got) == set(want)
    for video, told in want.items():
        x = got[video]
        assert (x.h0 is None) == (told is None)
        if told:
            assert x.n == told[0] and np.allclose([x.h0, x.h2, x.h4, x.h5], [0.1, told[1][0], 0.1, told[1][1]], atol=1e-6)
    monkeypatch.setattr(geometry, "fit_homography", None)
    pixel = r.uniform(0, 1000, (50, 6, 2))
    assert geometry._fits(pixel, pixel * 0.1)[0].all()


def test_label_files_are_not_listed_one_by_one(spark, tmp_path, monkeypatch):
    dataset.write_dataset(data(spark), str(tmp_path / "set"), ["ball", "player"])
    asked = []
    text = type(spark.read).text
    monkeypatch.setattr(type(spark.read), "text", lambda self, path, **kw: asked.append(path) or text(self, path, **kw))
    rows = files.read_labels(spark, str(tmp_path / "set")).collect()
    assert rows and asked and not any(p.endswith(".txt") for p in asked)


def test_crops_of_many_images(spark):
    pictures = [np.arange(4 * 4 * 3).reshape(4, 4, 3) + i for i in range(50)]
    rows = spark.createDataFrame([(i, bytearray(images.encode_png(x))) for i, x in enumerate(pictures)], "frame bigint, content binary").coalesce(1)
    boxes = spark.createDataFrame([(i, 2 * i + k, k, 1, 3, 3) for i in range(50) for k in (0, 1)], "frame bigint, crop bigint, x1 int, y1 int, x2 int, y2 int")
    want = sorted((2 * i + k, *map(int, p)) for i, x in enumerate(pictures) for k in (0, 1) for p in x[1:3, k:3].reshape(-1, 3))
    assert sorted(map(tuple, images.crop_pixels(rows, boxes, ["frame"]).collect())) == want


def test_pictures_are_drawn_many_a_call_where_a_box_is_read(spark):
    from pitchflow.plans import catalog, media

    assert "div 256" in media._pictures(catalog.log_of(spark, "/root/testdata/sf0.01"))._jdf.queryExecution().analyzed().toString()
