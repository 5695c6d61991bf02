"""Operators against plain versions of themselves, and their edge cases."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import geometry, names, vec
from corpusloom.operators import components as grid
from corpusloom.operators import dedup, detections, hamming, quality, skew, split, taxonomy
from corpusloom.operators.components import components
from corpusloom.operators.hamming import cost, hamming_pairs, hash_classes, layout, representatives
from corpusloom.operators.skew import ranked, skew_join, top_n
from corpusloom.session import Scratch


def groups_of(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_skew_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "SHARE", 75)
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [("cold", 1), (None, 2), ("lone", 3)], "k string, x int")
    right = spark.createDataFrame([("hot", "h"), ("cold", "c"), (None, "n")], "k string, y string")
    for how in ("inner", "left", "left_semi"):
        got = skew_join(left, right, "k", how, at_least=100)
        want = left.join(right, "k", how)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        assert skew_join(left.limit(0), right, "k", how).count() == 0


def test_ranked_and_top(spark):
    rows = spark.createDataFrame([("a", i) for i in range(500)] + [("b", 7), (None, 1), (None, 2)], "g string, x int")
    got = ranked(rows, ["g"], F.col("x"), buckets=8).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(r["rank"])
    assert {g: sorted(v) for g, v in by.items()} == {"a": list(range(500)), "b": [0], None: [0, 1]}
    # the same on every run, in whatever order rows come
    assert sorted(map(tuple, ranked(rows, ["g"], F.col("x"), buckets=8).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    top = top_n(rows, ["g"], [F.desc("x")], 3, F.col("x"))
    assert sorted((r.x for r in top.collect() if r.g == "a"), reverse=True) == [499, 498, 497]
    assert top.count() == 6


@pytest.mark.parametrize("shape", ["random", "chain", "star", "empty"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = {
        "random": [(f"v{rng.randrange(200):03}", f"v{rng.randrange(200):03}") for _ in range(150)],
        "chain": [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)],
        "star": [("hub", f"s{i:03}") for i in range(100)] * 2,
        "empty": [],
    }[shape]
    df = spark.createDataFrame([*edges, (None, "x"), ("y", None), ("z", "z")], "a string, b string")
    got = dict(map(tuple, components(df, Scratch(spark, "t")).collect()))
    assert got == groups_of([(a, b) for a, b in edges if a != b])


def test_a_third_of_the_rows_on_one_key(spark, monkeypatch):
    rows = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("k"), "id")
    right = rows.groupBy("k").agg(F.min("id").alias("least"))
    monkeypatch.setattr(skew, "SHARE", 1000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew_join(rows, right, "k", at_least=10_000)
        sizes = [r.n for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        plain = [r.n for r in rows.join(right, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 90_000 and max(plain) > 2 * sorted(plain)[len(plain) // 2]
    assert max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]  # no task has over twice the median


def chain_rounds(spark, ids):
    own = Scratch(spark, "chain")
    found = grid.connected(spark.createDataFrame(list(zip(ids, ids[1:])), "u bigint, v bigint"), own)
    assert {r.root for r in found.collect()} == {min(ids)} and found.count() == len(ids)
    return len([f for f in os.listdir(own.root.removeprefix("file:").replace("//", "/")) if f.startswith("met")])


def test_ordered_chains_take_no_more_rounds(spark, monkeypatch):
    monkeypatch.setattr(grid, "CELL_EDGES", 60)
    shuffled = list(range(3000))
    random.Random(3).shuffle(shuffled)
    ordered, permuted = chain_rounds(spark, list(range(3000))), chain_rounds(spark, shuffled)
    assert ordered <= permuted + 1 <= 12


def test_hamming_equals_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1, 1 << 63]
    rows = []
    for i, h in enumerate(base):
        for k, d in enumerate((0, 0, 1, 5, 6, 10, 11)):
            flipped = h
            for bit in rng.sample(range(64), d):
                flipped ^= 1 << bit
            text = f"{flipped:016x}"
            rows.append((f"i{i:02}-{k}", text.upper() if k == 1 else text))
    rows += [("n", None), (None, "0" * 16), ("bad", "xyz"), rows[0]]
    hashes = spark.createDataFrame(rows, "image_id string, phash_hex string")
    classes = hash_classes(hashes)
    least = {}
    for i, h in rows:
        if i and h and h != "xyz":
            least[int(h, 16)] = min(least.get(int(h, 16), i), i)
    assert {(r.image_id, r.representative) for r in classes.collect()} == {(i, least[int(h, 16)]) for i, h in rows if i and h and h != "xyz"}
    reps = sorted((i, h) for h, i in least.items())
    want = {(a, b, (x ^ y).bit_count()) for n, (a, x) in enumerate(reps) for b, y in reps[n + 1 :] if (x ^ y).bit_count() <= 10}
    own = representatives(hashes)
    got = hamming_pairs(own)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {tuple(r) for r in hamming_pairs(own, 5).collect()} == {w for w in want if w[2] <= 5}
    assert hamming_pairs(own.limit(0)).count() == 0
    for blocks in (2, 3, 5, 6):
        few = own.filter(F.col("bits") % 3 == 0) if blocks == 2 else own
        kept = {r.representative for r in few.collect()}
        assert sorted(map(tuple, hamming_pairs(few, 10, blocks).collect())) == sorted(w for w in want if w[0] in kept and w[1] in kept)


def test_hamming_blocks_cover_the_distance():
    for radius in (0, 3, 5, 10, 16):
        for blocks in range(2, 7):
            parts = layout(blocks, radius)
            assert sum(near + 1 for _, _, near in parts) == radius + 1 and sum(width for _, width, _ in parts) == 64
    # joined rows grow less than with the square of the hashes once wider blocks pay
    cheapest = lambda n: min(cost(m, 10, n) for m in range(2, 7))
    assert cheapest(36_000_000) < 3000 * cheapest(360_000)


def test_hamming_parts_equal_brute_force(spark, monkeypatch):
    """Several parts and shares, runs and tiles that end within a bucket, and a block that a third of all hashes share."""
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(200)]
    values = base + [h ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for h in base for _ in range(2)] + [rng.getrandbits(16) for _ in range(300)]
    values = sorted(set(values))
    want = {(a, b) for n, a in enumerate(values) for b in values[n + 1 :] if (a ^ b).bit_count() <= 10}
    rows = [(f"{h:016x}", f"{h:016x}") for h in values]
    monkeypatch.setattr(hamming, "PART", 150)
    monkeypatch.setattr(hamming, "TASK", 100_000)
    own = representatives(spark.createDataFrame(rows, "image_id string, phash_hex string"))
    assert sorted((r.id_a, r.id_b) for r in hamming_pairs(own).collect()) == sorted((f"{a:016x}", f"{b:016x}") for a, b in want)
    monkeypatch.setattr(hamming, "RUN", 7)
    monkeypatch.setattr(hamming, "TILE", 50)
    x, parts, found = np.array(values, np.uint64), layout(4, 10), []
    for at in range(4):
        for share in range(3):
            a, b = hamming.near_pairs(x, None, parts, at, 9, 10, share, 3)
            found += [(min(p), max(p)) for p in zip(a.tolist(), b.tolist())]
    assert sorted(found) == sorted(want)


def test_hamming_shuffles_in_proportion(spark):
    """What is looked up isn't shuffled: a few times the hashes and ids themselves."""
    rng = random.Random(6)
    rows = [(f"{i:08}", f"{rng.getrandbits(64):016x}") for i in range(20_000)]
    own = representatives(spark.createDataFrame(rows, "image_id string, phash_hex string"))
    written = lambda: spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before, most = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on tables too large for it
    try:
        hamming_pairs(own).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert 0 < written() - before < 200 * len(rows)


def test_greedy_equals_one_by_one():
    rng = random.Random(3)
    for _ in range(200):
        sizes = rng.sample(range(1, 30), rng.randint(1, 6))
        counts = [rng.randint(1, 30) for _ in sizes]
        shares, total = [0.7, 0.15, 0.15], sum(s * c for s, c in zip(sizes, counts))
        filled, want = np.zeros(3), np.zeros((len(sizes), 3), int)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            for _ in range(counts[i]):
                j = int(np.argmax(np.round(np.array(shares) - filled / total, 12)))
                filled[j] += sizes[i]
                want[i, j] += 1
        assert (split.greedy(sizes, counts, shares) == want).all()


def test_group_split(spark):
    rng = random.Random(4)
    rows = [(f"g{i}", rng.choice(["a", "b", None]), rng.choice([1, 1, 1, 2, 5])) for i in range(400)] + [("giant", "a", 300)]
    groups = spark.createDataFrame(rows, "dedup_group string, breed string, n bigint")
    got = dict(map(tuple, split.group_split(groups).collect()))
    assert len(got) == len(rows)
    for breed in ("b", None):
        total = sum(n for _, b, n in rows if b == breed)
        train = sum(n for g, b, n in rows if b == breed and got[g] == "train")
        assert abs(train / total - 0.7) < 0.05
    assert got["giant"] == "train"
    assert split.group_split(groups.limit(0)).count() == 0


def test_half_split(spark):
    rows = [(f"c{i}", "__CAT_OOD__") for i in range(7)] + [("d", "dog"), (None, "__CAT_OOD__"), ("c1", "__CAT_OOD__")]
    got = [r.split for r in split.half_split(spark.createDataFrame(rows, "image_id string, canonical_breed string")).collect()]
    assert sorted(got) == ["test"] * 4 + ["val"] * 3


def test_group_table_mode_ties(spark):
    rows = [("g", "b", True), ("g", "a", True), ("g", "c", False), ("h", "z", True), (None, "z", True)]
    got = split.group_table(spark.createDataFrame(rows, "dedup_group string, canonical_breed string, in_mvp25 boolean"))
    assert sorted(map(tuple, got.collect())) == [("g", "a", 2), ("h", "z", 1)]


def test_crop_geometry(spark):
    rng = random.Random(5)
    boxes = [[10.0, 10.0, 30.0, 20.0], [-5.0, -5.0, 700.0, 500.0], [0.5, 1.5, 2.5, 3.5], [639.0, 479.0, 640.0, 480.0], [0.0, 0.0, 0.0, 0.0]]
    boxes += [[float(rng.randint(-50, 700)) / 2 for _ in range(4)] for _ in range(100)]
    rows = [(i, b, 640, 480) for i, b in enumerate(boxes)] + [(-1, None, 640, 480), (-2, [1.0], 640, 480), (-3, [float("nan")] * 4, 640, 480)]
    df = spark.createDataFrame(rows, "i int, b array<double>, w int, h int").select("i", geometry.crop(F.col("b"), F.col("w"), F.col("h")).alias("c"))
    got = {r.i: r.c for r in df.collect()}
    for i, (x1, y1, x2, y2) in enumerate(boxes):
        bw, bh = x2 - x1, y2 - y1
        left, top, right, bottom = x1 - bw * 0.15, y1 - bh * 0.15, x2 + bw * 0.15, y2 + bh * 0.15
        half, cx, cy = max(right - left, bottom - top) / 2, (left + right) / 2, (top + bottom) / 2
        a, b, c, d = max(0, round(cx - half)), max(0, round(cy - half)), min(640, round(cx + half)), min(480, round(cy + half))
        side = max(c - a, d - b)
        assert tuple(got[i]) == (a, b, c, d, side, (side - (c - a)) // 2, (side - (d - b)) // 2)
    assert got[-1] is None and got[-2] is None and got[-3] is None


def test_boxes(spark):
    rows = [([0.0, 0.0, 10.0, 10.0],), ([5.0, 0.0, 5.0, 10.0],), ([0.0, 0.0, 102.1, 10.0],), ([0.0, 0.0, 101.9, 10.0],), ([-1.9, 0.0, 10.0, 10.0],), ([-2.1, 0.0, 10.0, 10.0],), (None,), ([],)]
    df = spark.createDataFrame(rows, "b array<double>").select(geometry.box_fault(F.col("b"), F.lit(100), F.lit(100)).alias("f"))
    assert [r.f for r in df.collect()] == [None, "invalid_bbox_order", "bbox_out_of_image", None, None, "bbox_out_of_image", None, None]
    line = spark.range(1).select(geometry.label_line(0, F.array(F.lit(-5.0), F.lit(0.0), F.lit(50.0), F.lit(100.0)), F.lit(100), F.lit(100)).alias("x"))
    assert line.first().x == "0 0.250000 0.500000 0.500000 1.000000"
    assert spark.range(1).select(geometry.label_line(0, F.array(*[F.lit(1.0)] * 4), F.lit(0), F.lit(0)).alias("x")).first().x is None


def test_names(spark):
    df = spark.createDataFrame([("Shih-Tzu",), ("Toy Poodle",), ("CAT_Bengal",), ("Chinese-rural_dog",), ("Basset-Hound",), ("pug",), (None,), ("",)], "x string")
    got = [r[0] for r in df.select(names.canonical(F.col("x"))).collect()]
    assert got == ["shih_tzu", "poodle", "__CAT_OOD__", "__DROP__", "basset", "pug", None, ""]
    row = spark.range(1).select(
        names.file_name(F.lit(r"a\b/c.x.jpg")).alias("f"), names.folder_name(F.lit(r"a\b/c.jpg")).alias("d"), names.folder_name(F.lit("c")).alias("n"), names.stem(F.lit("c.x.jpg")).alias("s"), names.stem(F.lit(".x")).alias("h"),
        names.after_dashes(F.lit("n02-great-dane"), 2).alias("a"), names.after_dashes(F.lit("200-n01-shiba-inu"), 3).alias("b"), names.before_last_underscore(F.lit("a_b_1")).alias("u"), names.before_last_underscore(F.lit("ab")).alias("v"),
    ).first()
    assert tuple(row) == ("c.x.jpg", "b", None, "c.x", ".x", "great-dane", "shiba-inu", "a_b", "ab")
    assert len(names.CANONICAL) == 25 and list(names.CANONICAL) == sorted(names.CANONICAL)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(vec.unit(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    assert df.filter("v IS NOT NULL").agg(vec.mean(F.col("v"))).first()[0] == [1.5, 2.0]


def test_status_and_keepers(spark):
    groups = spark.createDataFrame([("tsinghua/a", "g"), ("oxford/z", "g"), ("stanford/b", "g"), ("other/a", "h"), ("tsinghua/q", "h")], "image_id string, component string")
    keep = dict(map(tuple, dedup.keepers(groups).collect()))
    assert keep == {"tsinghua/a": "oxford/z", "stanford/b": "oxford/z", "other/a": "tsinghua/q"}
    manifest = spark.createDataFrame([("tsinghua/a", True, None, "old"), ("stanford/b", False, "corrupt_image", None), ("oxford/z", True, None, "old")], "image_id string, usable boolean, exclusion_reason string, dup_keep_id string")
    got = {r.image_id: (r.usable, r.exclusion_reason, r.dup_keep_id) for r in quality.mark_dropped(manifest, dedup.keepers(groups)).collect()}
    assert got == {"tsinghua/a": (False, "exact_duplicate", "oxford/z"), "stanford/b": (False, "corrupt_image", "oxford/z"), "oxford/z": (True, None, None)}


def test_exact_groups_bridge(spark):
    manifest = spark.createDataFrame([("a", "m1", True), ("b", "m1", True), ("c", "m2", True), ("d", "m2", False), ("e", None, True), ("f", None, True)], "image_id string, md5 string, usable boolean")
    pairs = spark.createDataFrame([("b", "c", 5), ("c", "f", 6), ("f", "e", 10)], "id_a string, id_b string, hamming int")
    assert dict(map(tuple, dedup.exact_groups(manifest, pairs, Scratch(spark, "t")).collect())) == {"a": "a", "b": "a", "c": "a"}
    assert dict(map(tuple, dedup.group_ids(manifest, pairs, Scratch(spark, "t")).collect())) == {"a": "a", "b": "b", "c": "b", "d": "d", "e": "b", "f": "b"}


def test_taxonomy(spark):
    rows = [("s", "Pug", True), ("s", "Pug", False), ("s", "Rare", True), ("s", "CAT_x", False), ("s", "chinese_rural_dog", True), ("s", None, True)]
    df = spark.createDataFrame(rows, "source string, original_breed string, usable boolean")
    got = {(r.original_label, r.canonical_label, r.action, r.n_images) for r in taxonomy.taxonomy(df).collect()}
    assert got == {("Pug", "pug", "mvp25", 2), ("Rare", "rare", "not_mvp", 1), ("chinese_rural_dog", "__DROP__", "drop", 1)}
    assert [r.in_mvp25 for r in taxonomy.with_taxonomy(df).collect()] == [True, False, False, False, False, False]


def test_detections(spark):
    rows = [("a", 16, 0, 0.9, [1.05, 2.0, 3.0, 4.0]), ("a", 16, 1, 0.9, [0.0] * 4), ("a", 16, 2, 0.3, [0.0] * 4), ("b", 16, 0, 0.2, [0.0] * 4), ("c", 1, 0, 0.9, [0.0] * 4)]
    df = spark.createDataFrame(rows, "image_id string, class_id int, idx int, conf double, bbox array<double>")
    images = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",)], "image_id string")
    assert [(r.image_id, r.n_det, r.bbox) for r in detections.best(detections.wanted(df)).collect()] == [("a", 3, [1.05, 2.0, 3.0, 4.0])]
    pseudo = detections.pseudo_boxes(images, df)
    got = {r.image_id: (r.conf, r.n_det, r.needs_review) for r in pseudo.collect()}
    assert got == {"a": (0.9, 3, False), "b": (0.2, 1, True), "c": (0.0, 0, True), "d": (0.0, 0, True)}
    assert [r.image_id for r in detections.accepted(pseudo).collect()] == ["a"]
    with pytest.raises(KeyError):
        detections.strict_join(pseudo, images.filter("image_id <> 'a'"), "image_id")


def test_unit_takes_linear_time(spark):
    def seconds(width):
        df = spark.range(0, 1500, 1, 4).select(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda x: x * F.lit(1.0)).alias("v"))
        took = []
        for _ in range(3):
            start = time.time()
            df.select(F.sum(vec.unit(F.col("v"))[0])).collect()
            took.append(time.time() - start)
        return min(took)

    assert seconds(1536) < 10 * seconds(384) + 1  # the square would be 16 times, 45 s
