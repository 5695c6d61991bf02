"""Sources, sinks, inference and the command line on tiny generated files."""

import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import cli
from corpusloom.operators import inference
from corpusloom.operators.detections import plain_annotations
from corpusloom.plans import exports, reports
from corpusloom.plans.prototype import build
from corpusloom.sources import files, sinks


def png(path, w, h, rgb):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    raw = b"".join(b"\0" + bytes(rgb) * w for _ in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def voc(kind, *boxes):
    corners = "".join(f"<object><{kind}>" + "".join(f"<{n}>{v}</{n}>" for n, v in zip(("xmin", "ymin", "xmax", "ymax"), b) if v is not None) + f"</{kind}></object>" for b in boxes)
    return f"<annotation>{corners}</annotation>"


def test_class_folders(spark, tmp_path):
    root = str(tmp_path / "train")
    for name in ("pug/b.PNG", "pug/a.jpg", "husky/c.webp", "husky/d.txt", "husky/deep/e.png", "f.png"):
        put(f"{root}/{name}", "x")
    got = sorted((r.label, r.path.rsplit("/", 1)[1]) for r in files.class_folders(spark, root).select("label", "path").collect())
    assert got == [("husky", "c.webp"), ("pug", "a.jpg"), ("pug", "b.PNG")]
    with pytest.raises(FileNotFoundError):
        files.class_folders(spark, str(tmp_path / "none"))


def test_scans(spark, tmp_path):
    root = str(tmp_path)
    for name, size in (("n1-Great-Dane/a", (40, 30)), ("n1-Great-Dane/b", (40, 30)), ("n1-Great-Dane/c", (40, 30))):
        png(f"{root}/s/Images/{name}.jpg", *size, (1, 2, 3))
    put(f"{root}/s/Images/n1-Great-Dane/d.jpg", "broken")
    put(f"{root}/s/Notes/n1-Great-Dane/a", voc("bndbox", (1, 2, 20, 20), (0, 0, 5, 5)))
    put(f"{root}/s/Notes/n1-Great-Dane/b", voc("bndbox", (9, 2, 5, 20)))
    put(f"{root}/s/Notes/n1-Great-Dane/d", voc("bndbox", (9, 2, 15, 20)))
    got = {r.image_id: r for r in files.scan_folders_by_id(spark, f"{root}/s/Images", f"{root}/s/Notes").collect()}
    a = got["stanford/n1-Great-Dane/a.jpg"]
    assert (a.original_breed, a.width, a.height, a.body_bbox, a.n_dogs, a.usable, len(a.md5)) == ("Great-Dane", 40, 30, [1.0, 2.0, 20.0, 20.0], 2, True, 32)
    assert {k[-5]: r.exclusion_reason for k, r in got.items()} == {"a": None, "b": "invalid_bbox_order", "c": "missing_annotation", "d": "corrupt_image:UnidentifiedImageError"}

    for name in ("Bengal_cat_1", "shiba_inu_2"):
        png(f"{root}/o/images/{name}.jpg", 10, 10, (9, 9, 9))
    put(f"{root}/o/xmls/shiba_inu_2.xml", voc("bndbox", (1, None, 200, 4)))
    got = {r.image_id: r for r in files.scan_flat(spark, f"{root}/o/images", f"{root}/o/xmls").collect()}
    cat, dog = got["oxford/Bengal_cat_1.jpg"], got["oxford/shiba_inu_2.jpg"]
    assert (cat.original_breed, cat.usable, cat.exclusion_reason, cat.n_dogs) == ("CAT_Bengal_cat", False, "cat_ood_only", 0)
    assert (dog.original_breed, dog.usable, dog.head_bbox, dog.body_bbox, dog.n_dogs) == ("shiba_inu", True, [1.0, 0.0, 200.0, 4.0], None, 1)

    png(f"{root}/t/low/200-n1-shiba-inu/x.jpg", 100, 100, (9, 9, 9))
    png(f"{root}/t/low/200-n1-shiba-inu/y.jpeg", 100, 100, (9, 9, 9))
    both = voc("bodybndbox", (1, 1, 50, 50)).replace("</annotation>", "") + "<object><headbndbox><xmin>1</xmin><ymin>1</ymin><xmax>{}</xmax><ymax>20</ymax></headbndbox></object></annotation>"
    put(f"{root}/t/notes/200-n1-shiba-inu/x.jpg.xml", both.format(20))
    put(f"{root}/t/notes/200-n1-shiba-inu/y.jpeg.xml", both.format(150))
    got = {r.image_id[-6:]: r for r in files.scan_folders_by_count(spark, f"{root}/t/low", f"{root}/t/notes").collect()}
    assert got["/x.jpg"].usable and got["/x.jpg"].original_breed == "shiba-inu" and got["/x.jpg"].head_bbox == [1.0, 1.0, 20.0, 20.0]
    assert got["y.jpeg"].exclusion_reason == "bbox_out_of_image"


def test_sizes_and_boxes(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 40) + b"\x03" + b"\0" * 10
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -5) + b"\0" * 8
    df = spark.createDataFrame([(bytearray(jpeg),), (bytearray(bmp),), (bytearray(b"\xff\xd8\xff"),), (bytearray(b""),), (None,)], "c binary").select(files.image_size("c").alias("s"))
    got = [tuple(r.s) for r in df.collect()]
    assert got[:2] == [(40, 30, None), (7, 5, None)] and all(g[:2] == (0, 0) and g[2].startswith("corrupt_image:") for g in got[2:])
    xml = spark.createDataFrame([("<a><object><part><bndbox><xmin>1</xmin></bndbox></part></object></a>",), ("<a",), (None,)], "x string").select(files.voc_boxes("x").alias("b"))
    got = [r.b for r in xml.collect()]
    assert got[0][0].box == [1.0, 0.0, 0.0, 0.0] and got[1] is None and got[2] is None


def test_coco(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "width": 5, "height": 6}], "annotations": [{"image_id": 1, "bbox": [1, 2, 3, 4], "IsGroupOf": True}, {"image_id": 1, "bbox": [0, 0, 1, 1]}, {"image_id": 1, "bbox": [0, 0, 1, 1], "IsDepiction": 1}]}
    put(str(tmp_path / "labels.json"), json.dumps(doc))
    images, notes = files.coco(spark, str(tmp_path / "labels.json"))
    assert [tuple(r) for r in images.collect()] == [(1, "a.jpg", 5, 6)] and notes.count() == 3
    assert [r.bbox for r in plain_annotations(notes).collect()] == [[0.0, 0.0, 1.0, 1.0]]


def test_pixels_and_models(spark, tmp_path):
    root = str(tmp_path / "img")
    png(f"{root}/x/red.png", 28, 14, (250, 10, 20))
    put(f"{root}/x/bad.png", "no image")
    images = files.pixels(spark, root).cache()
    rows = {r.path.rsplit("/", 1)[1]: r for r in images.collect()}
    assert rows["bad.png"].rgb is None and bytes(rows["red.png"].rgb[:3]) == bytes((250, 10, 20))
    found = inference.detect(images, inference.HashDetector).collect()
    assert [(r.class_id, r.bbox) for r in found] == [(16, [7.0, 3.5, 21.0, 10.5])]
    out = {r.path.rsplit("/", 1)[1]: r for r in inference.embed_best(images, inference.HashDetector, inference.MeanEncoder, size=28).collect()}
    assert out["bad.png"].embedding is None and abs(np.linalg.norm(out["red.png"].embedding) - 1) < 1e-6
    hashes = {r.path.rsplit("/", 1)[1]: r.phash_hex for r in inference.with_hashes(images).collect()}
    assert hashes["bad.png"] is None and len(hashes["red.png"]) == 16
    assert inference.prepared(np.zeros((4, 6, 3), np.uint8), 28).shape == (3, 28, 28)
    with pytest.raises(ValueError):
        inference.prepared(np.zeros((4, 6, 3), np.uint8), 30)
    window = {"ix1": 0, "iy1": 0, "ix2": 4, "iy2": 2, "side_px": 4, "off_x": 0, "off_y": 1}
    cut = inference.cut_out(np.zeros((4, 6, 3), np.uint8), window, 4)
    assert (cut[0] == inference.PADDING).all() and (cut[1:3] == 0).all()


def test_sinks(spark, tmp_path):
    manifest = spark.createDataFrame(
        [("s/d/a.jpg", "s", r"data\raw\s\d\a.jpg", 100, 100, [0.0, 0.0, 50.0, 50.0], None, True, "pug", True, "train"), ("s/d/b.jpg", "s", "data/raw/s/d/b.jpg", 100, 100, None, None, True, "__CAT_OOD__", False, "val")],
        "image_id string, source string, image_path string, width int, height int, body_bbox array<double>, head_bbox array<double>, usable boolean, canonical_breed string, in_mvp25 boolean, split string",
    )
    root = str(tmp_path)
    labels = exports.label_files(manifest)
    sinks.write_files(labels, f"{root}/tree")
    assert open(f"{root}/tree/s/labels/d/a.txt").read() == "0 0.250000 0.250000 0.500000 0.500000"
    assert sinks.remove_files(exports.removals(manifest), f"{root}/tree") == 1
    assert [r.target for r in exports.crops(manifest).collect()] == ["breed_body/train/pug/a.jpg"]
    assert [r.target for r in exports.cat_copies(manifest).collect()] == ["ood/val/cat/b.jpg"]
    images = spark.createDataFrame([("open_images/train", "a.jpg"), ("coco/validation", "b.jpg"), ("coco/validation", "c.jpg")], "corpus string, name string")
    kept = spark.createDataFrame([("open_images/train", "a"), ("coco/validation", "b")], "corpus string, stem string")
    assert sorted(r.split for r in exports.detection_files(images, kept).collect()) == ["test", "train"]
    sinks.write_splits(manifest, f"{root}/splits")
    assert os.listdir(f"{root}/splits") and "split=train" in os.listdir(f"{root}/splits")
    tax = spark.createDataFrame([("s", "b", "b", 1, "not_mvp", 1), ("s", "a", "a", 1, "drop", 1)], "source string, original_label string, canonical_label string, breed_id int, action string, n_images int")
    sinks.write_taxonomy(tax, f"{root}/tax")
    part = next(f for f in os.listdir(f"{root}/tax") if f.endswith(".csv"))
    assert [line.split(",")[4] for line in open(f"{root}/tax/{part}").read().split()[1:]] == ["drop", "not_mvp"]
    sinks.write_detection_config(f"{root}/det")
    assert "dog_head" in open(f"{root}/det/classes.txt").read()
    made = build(spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0])], "key int, label string, embedding array<float>"))
    sinks.write_prototypes(made, f"{root}/proto")
    assert sinks.read_prototypes(spark, f"{root}/proto").classes.count() == 2
    assert reports.markdown(tax.select("source", "action").orderBy("action")).splitlines()[2] == "| s | drop |"


def test_command_line(spark, tmp_path, capsys):
    root = str(tmp_path)
    for label, colour in (("red", (250, 5, 5)), ("blue", (5, 5, 250))):
        for i in range(3):
            png(f"{root}/train/{label}/{i}.png", 20 + i, 20, colour)
    png(f"{root}/cats/cat/1.png", 20, 20, (100, 100, 100))
    cli.main(["embed", "--split-dir", f"{root}/train", "--out", f"{root}/emb"])
    cli.main(["prototype", "--embeddings", f"{root}/emb", "--out", f"{root}/proto"])
    cli.main(["eval", "--split-dir", f"{root}/train", "--prototypes", f"{root}/proto"])
    cli.main(["eval-ood", "--dog-dir", f"{root}/train", "--cat-dir", f"{root}/cats", "--prototypes", f"{root}/proto"])
    cli.main(["infer", "--image", f"{root}/train/red", "--prototypes", f"{root}/proto"])
    cli.main(["detect", "--image", f"{root}/train/red", "--conf", "0.2"])
    out = capsys.readouterr().out
    assert "Top-1 1.0000 (6/6)" in out and "AUROC 1.0000" in out and "conf=" in out and "red" in out
    with pytest.raises(FileNotFoundError):
        cli.main(["embed", "--split-dir", f"{root}/none", "--out", f"{root}/x"])
    defaults = cli.parser().parse_args(["infer", "--image", "x"])
    assert (defaults.threshold, defaults.top_k, defaults.temperature) == (0.5, 3, 0.1)


def test_orientation():
    x = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    tiff = lambda order, value: (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}IHHHIHH", 8, 1, 0x0112, 3, 1, value, 0)
    for order in "<>":
        for value in (0, 1, 3, 6, 9):
            body = b"Exif\0\0" + tiff(order, value)
            jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"
            assert files.orientation(jpeg) == (value if 1 <= value <= 8 else 1)
    assert files.orientation(None) == files.orientation(b"\xff\xd8\xff\xe1\x00\x0aExif\0\0II") == files.orientation(b"PNG") == 1
    flat = lambda t: files.upright(x, t)[:, :, 0].tolist()
    assert flat(1) == [[0, 1, 2], [3, 4, 5]] and flat(2) == [[2, 1, 0], [5, 4, 3]] and flat(3) == [[5, 4, 3], [2, 1, 0]] and flat(4) == [[3, 4, 5], [0, 1, 2]]
    assert flat(5) == [[0, 3], [1, 4], [2, 5]] and flat(6) == [[3, 0], [4, 1], [5, 2]] and flat(7) == [[5, 2], [4, 1], [3, 0]] and flat(8) == [[2, 5], [1, 4], [0, 3]]


def test_arrays_links_and_crops(spark, tmp_path):
    from corpusloom.sources import npz

    root = str(tmp_path)
    np.savez_compressed(f"{root}/e.npz", embeddings=np.eye(2, dtype=np.float32), labels=np.array(["a", "b"]), paths=np.array(["p", "q"]))
    np.savez_compressed(f"{root}/p.npz", breeds=np.array(["a"]), prototypes=np.ones((1, 2)), global_mean=np.zeros(2))
    assert [tuple(r) for r in npz.embeddings(spark, f"{root}/e.npz").collect()] == [("p", "a", [1.0, 0.0]), ("q", "b", [0.0, 1.0])]
    assert npz.prototypes(spark, f"{root}/p.npz").classes.first().prototype == [1.0, 1.0]

    png(f"{root}/raw/x/a.png", 40, 20, (200, 10, 10))
    links = spark.createDataFrame([(r"x\a.png", "ood/val/cat/a.png"), ("x/none.png", "ood/val/cat/none.png"), (None, "z")], "image_path string, target string")
    assert sinks.link_files(links, f"{root}/raw", f"{root}/out") == 1 and os.path.samefile(f"{root}/raw/x/a.png", f"{root}/out/ood/val/cat/a.png")

    from corpusloom.functions import geometry

    images = files.pixels(spark, f"{root}/raw")
    box = F.array(F.lit(10.0), F.lit(5.0), F.lit(30.0), F.lit(15.0))
    crops = images.withColumn("target", F.lit("body/train/pug/a.jpg")).withColumn("crop", geometry.crop(box, F.col("width"), F.col("height")))
    broken = crops.withColumn("rgb", F.lit(None).cast("binary"))
    assert sinks.write_crops(crops.unionByName(broken), f"{root}/crops", 28) == (1, 1)
    row = files.pixels(spark, f"{root}/crops").first()
    assert row.path.endswith("body/train/pug/a.jpg") and (row.height, row.width) == (28, 28)
    assert np.abs(np.frombuffer(row.rgb, np.uint8)[14 * 28 * 3 + 42 : 14 * 28 * 3 + 45].astype(int) - (200, 10, 10)).max() <= 3


def test_jpeg(spark, tmp_path):
    from corpusloom.sources import jpeg

    rng = np.random.default_rng(3)
    yy, xx = np.mgrid[:50, :70]
    smooth = np.stack([127 + 100 * np.sin(xx / 17 + yy / 31), 127 + 90 * np.cos(yy / 13), 60 + xx], 2).clip(0, 255).astype(np.uint8)
    noise = rng.integers(0, 256, (33, 17, 3)).astype(np.uint8)
    images = {"smooth": smooth, "noise": noise, "grey": np.full((16, 16, 3), 200, np.uint8), "dot": np.zeros((1, 1, 3), np.uint8), "sparse": np.where(rng.random((64, 64, 1)) < 0.01, 255, 0).astype(np.uint8).repeat(3, 2)}
    for name, image in images.items():
        with open(tmp_path / f"{name}.jpg", "wb") as f:
            f.write(jpeg.encode(image))
    luma = lambda x: x.astype(float) @ [0.299, 0.587, 0.114]
    for row in files.pixels(spark, str(tmp_path)).collect():
        image = images[os.path.basename(row.path)[:-4]]
        got = np.frombuffer(row.rgb, np.uint8).reshape(row.height, row.width, 3)
        assert got.shape == image.shape and np.abs(luma(got) - luma(image)).mean() < 4
    assert len(jpeg.encode(noise, 20)) < len(jpeg.encode(noise, 92))
    counts = np.zeros(256, int)
    counts[:40] = [int(1.9**k) for k in range(40)]  # would need codes of 39 bits
    codes, lengths, _ = jpeg._table(counts)
    assert max(lengths) <= 16 and sum(2.0 ** -lengths[:40]) < 1
    texts = [f"{int(codes[k]):0{lengths[k]}b}" for k in range(40)]
    assert all("0" in t for t in texts) and not any(a != b and b.startswith(a) for a in texts for b in texts)


def test_root_named_like_a_folder_above(spark, tmp_path):
    root = str(tmp_path / "train" / "a.b (c)" / "train")
    put(f"{root}/pug/1.jpg", "x")
    put(f"{root}/train/2.jpg", "x")
    for spelled in (root, f"file:{root}", f"file://{root}/"):
        assert sorted(r.label for r in files.class_folders(spark, spelled).select("label").collect()) == ["pug", "train"]


def test_whole_images_are_verified(spark, tmp_path):
    png(f"{tmp_path}/a.png", 30, 20, (1, 2, 3))
    whole = open(f"{tmp_path}/a.png", "rb").read()
    broken = bytearray(whole)
    broken[45] ^= 1
    df = spark.createDataFrame([(0, bytearray(whole)), (1, bytearray(whole[:-20])), (2, broken)], "i int, c binary").select("i", files.image_size("c").alias("s"))
    assert [tuple(r.s) for r in df.orderBy("i").collect()] == [(30, 20, None), (0, 0, "corrupt_image:OSError"), (0, 0, "corrupt_image:SyntaxError")]


def test_orientation_far_into_a_file(spark, tmp_path):
    tags = b"Exif\0\0" + b"II*\0" + struct.pack("<IHHHIHH", 8, 1, 0x0112, 3, 1, 6, 0)
    filler = b"\xff\xe2\xff\xff" + b"\0" * 65533
    jpeg = b"\xff\xd8" + filler * 5 + b"\xff\xe1" + struct.pack(">H", len(tags) + 2) + tags + b"\xff\xda"
    with open(tmp_path / "x.jpg", "wb") as f:
        f.write(jpeg)
    assert files.orientation(jpeg) == 6
    with open(tmp_path / "x.jpg", "rb") as f:
        assert files.orientation(f) == 6


def test_filtered_resizing():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (40, 40, 3)).astype(np.uint8)
    assert (inference.filtered(x, 40) == x).all() and (inference.filtered(np.full((90, 70, 3), 7, np.uint8), 30) == 7).all()
    # to a half, the widened triangle weighs the four nearest 1, 3, 3, 1
    row = np.tile(np.arange(0, 80, 2, dtype=np.uint8)[None, :, None], (40, 1, 3))
    row[:, 20] = 200
    half = inference.filtered(row, 20)[5, :, 0].astype(int)
    line = row[0, :, 0].astype(float)
    want = [np.floor((line[2 * k - 1] + 3 * line[2 * k] + 3 * line[2 * k + 1] + line[2 * k + 2]) / 8 + 0.5) for k in range(1, 19)]
    assert np.abs(half[1:19] - want).max() <= 1
    # to the double, it is the ordinary bilinear
    assert np.abs(inference.filtered(x, 80).astype(int) - np.rint(inference.resize(x, 80))).max() <= 1


def test_crop_windows_agree(spark):
    from corpusloom.functions import geometry

    rng = np.random.default_rng(2)
    boxes = [[float(v) for v in np.round(rng.uniform(-20, 120, 4) * 2) / 2] for _ in range(200)] + [[1.0, 2.0, float("nan"), 3.0], [1.0, 2.0]]
    df = spark.createDataFrame([(i, b, 100, 80) for i, b in enumerate(boxes)], "i int, b array<double>, w int, h int")
    for r in df.select("i", geometry.crop(F.col("b"), F.col("w"), F.col("h")).alias("c")).collect():
        assert (r.c.asDict() if r.c else None) == geometry.crop_window(boxes[r.i], 100, 80)


class Poor:
    def __init__(self, scale=1.0):
        self.scale = scale

    def encode_batch(self, images):
        return np.ones((len(images), 4)) * self.scale


def test_encoders_are_checked():
    images = [np.zeros((4, 4, 3), np.uint8)] * 40
    assert len(inference._encoded(Poor(0.5), images, 28, 4)) == 40 and inference._encoded(Poor(0.5), [], 28, 4) == []
    for model, dim in ((Poor(1.0), 4), (Poor(0.5), 384)):
        with pytest.raises(ValueError):
            inference._encoded(model, images, 28, dim)
    seen = []
    model = Poor(0.5)
    model.takes_prepared = True
    model.encode_batch = lambda x: seen.append(x[0].shape) or np.full((len(x), 4), 0.5)
    inference._encoded(model, images[:1], 28, 4)
    assert seen == [(3, 28, 28)]


def test_curation_commands(spark, tmp_path, capsys):
    raw, out = str(tmp_path / "raw"), str(tmp_path)
    for k in range(8):
        png(f"{raw}/stanford/Images/n1-pug/{k}.jpg", 40 + k, 40, (30 * k, 9, 9))
        put(f"{raw}/stanford/Annotation/n1-pug/{k}", voc("bndbox", (5, 5, 20, 20)))
    png(f"{raw}/oxford/images/pug_1.jpg", 44, 40, (200, 9, 90))
    png(f"{raw}/oxford/images/Bengal_2.jpg", 30, 30, (1, 99, 90))
    png(f"{raw}/oxford/images/Bengal_3.jpg", 31, 30, (1, 99, 9))
    put(f"{raw}/oxford/annotations/xmls/pug_1.xml", voc("bndbox", (1, 1, 9, 9)))
    png(f"{raw}/tsinghua/Low-Annotations/x/y.jpg", 3, 3, (1, 1, 1))
    png(f"{raw}/tsinghua/low-resolution/9-n1-pug/z.jpg", 40, 40, (0, 9, 9))  # a copy of stanford's first
    put(f"{raw}/tsinghua/annotations/Low-Annotations/9-n1-pug/z.jpg.xml", voc("bodybndbox", (5, 5, 20, 20)))
    cli.main(["inventory", "--raw", raw, "--out", f"{out}/m1", "--report", f"{out}/r/inventory.md"])
    manifest = spark.read.parquet(f"{out}/m1")
    assert manifest.count() == 12 and manifest.filter("usable").count() == 10
    assert "| tsinghua | 1 |" in open(f"{out}/r/inventory.md").read()
    cli.main(["pairs", "--manifest", f"{out}/m1", "--raw", raw, "--out", f"{out}/p"])
    none = spark.createDataFrame([], "id_a string, id_b string, hamming int")
    none.write.parquet(f"{out}/none")
    cli.main(["dedup", "--manifest", f"{out}/m1", "--pairs", f"{out}/none", "--out", f"{out}/m2", "--report", f"{out}/r/dedup.md"])
    assert "dropped images: 1" in open(f"{out}/r/dedup.md").read()
    gone = spark.read.parquet(f"{out}/m2").filter("exclusion_reason = 'exact_duplicate'").first()
    assert (gone.image_id, gone.dup_keep_id) == ("tsinghua/9-n1-pug/z.jpg", "stanford/n1-pug/0.jpg")
    cli.main(["taxonomy", "--manifest", f"{out}/m2", "--out", f"{out}/m3", "--csv", f"{out}/tax"])
    cli.main(["split", "--manifest", f"{out}/m3", "--pairs", f"{out}/none", "--out", f"{out}/m4", "--splits", f"{out}/s", "--report", f"{out}/r/split.md"])
    made = spark.read.parquet(f"{out}/m4")
    assert made.filter("in_mvp25 AND split IS NULL").count() == 0 and {r.split for r in made.filter("canonical_breed = '__CAT_OOD__'").collect()} == {"val", "test"}
    assert "| pug |" in open(f"{out}/r/split.md").read()
    spark.createDataFrame([("oxford/pug_1.jpg", [2.0, 2.0, 22.0, 22.0], 0.9, 1, False)], "image_id string, pseudo_body_bbox array<double>, conf double, n_det int, needs_review boolean").write.parquet(f"{out}/pseudo")
    plain = made.withColumn("image_path", F.regexp_replace("image_path", "^file:/+", "/"))
    plain.write.parquet(f"{out}/m5")
    cli.main(["label", "--manifest", f"{out}/m5", "--pseudo", f"{out}/pseudo", "--tree", f"{out}/tree"])
    assert open(f"{out}/tree/oxford/labels/pug/pug_1.txt").read().splitlines()[0].startswith("0 0.272727") and len(open(f"{out}/tree/oxford/labels/pug/pug_1.txt").read().splitlines()) == 2
    assert os.path.exists(f"{out}/tree/stanford/images/n1-pug/3.jpg") and os.path.exists(f"{out}/tree/stanford/labels/n1-pug/3.txt")
    cli.main(["export", "--manifest", f"{out}/m4", "--raw", raw, "--out", f"{out}/crops"])
    said = capsys.readouterr().out
    assert "9 crops, 0 failed" in said
    with pytest.raises(KeyError):
        exports.pseudo_label_files(made, spark.read.parquet(f"{out}/pseudo").withColumn("image_id", F.lit("oxford/none.jpg")))


def test_labels_from_annotations(spark, tmp_path):
    base = str(tmp_path / "base")
    doc = {
        "images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 20}, {"id": 2, "file_name": "b.jpg", "width": 10, "height": 10}, {"id": 3, "file_name": "gone.jpg", "width": 9, "height": 9}],
        "annotations": [{"image_id": 1, "bbox": [5, 10, 5, 10]}, {"image_id": 2, "bbox": [0, 0, 5, 5], "IsGroupOf": True}, {"image_id": 1, "bbox": [0, 0, 5, 10]}, {"image_id": 3, "bbox": [0, 0, 5, 5]}],
    }
    put(f"{base}/labels.json", json.dumps(doc))
    png(f"{base}/data/a.jpg", 10, 20, (1, 2, 3))
    png(f"{base}/data/b.jpg", 10, 10, (1, 2, 3))
    cli.main(["label-coco", "--base", base, "--corpus", "open_images/train", "--tree", f"{tmp_path}/tree"])
    assert open(f"{tmp_path}/tree/open_images/train/labels/a.txt").read() == "0 0.750000 0.750000 0.500000 0.500000\n0 0.250000 0.250000 0.500000 0.500000"
    assert os.listdir(f"{tmp_path}/tree/open_images/train/labels") == ["a.txt"] and os.path.exists(f"{tmp_path}/tree/open_images/train/images/a.jpg")


def test_nothing_to_evaluate(spark, tmp_path):
    from corpusloom.plans import evaluation

    none = spark.createDataFrame([], "rank int, score double")
    with pytest.raises(ValueError):
        evaluation.some(evaluation.hit_rates(none).first(), "n")
    with pytest.raises(ValueError):
        evaluation.some(evaluation.auroc(none, spark.createDataFrame([(0.5,)], "score double")).first(), "n_pos", "n_neg")
