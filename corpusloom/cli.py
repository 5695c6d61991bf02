"""Command line: python -m corpusloom.cli COMMAND. Models are given as module:factory."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable
from functools import partial

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.names import file_name
from corpusloom.operators import dedup, hamming, quality, split, taxonomy
from corpusloom.operators.detections import CONFIDENCE, by_confidence, wanted
from corpusloom.operators.inference import detect, embed_best, encode, with_hashes
from corpusloom.operators.skew import skew_join
from corpusloom.plans import evaluation, exports, reports, scoring
from corpusloom.plans.prototype import CAP, build, capped
from corpusloom.session import Scratch, let_workers_import, local_session
from corpusloom.sources.files import binary, class_folders, coco, pixels, scan_all
from corpusloom.sources.sinks import link_files, read_prototypes, remove_files, write_crops, write_detection_config, write_files, write_prototypes, write_report, write_splits, write_table, write_taxonomy

#: Paths of capped files that are collected at most; with more, the whole folder is read.
MAX_PATHS = 100_000
UNKNOWN = "no class is similar enough"
DETECTOR, ENCODER = "corpusloom.operators.inference:HashDetector", "corpusloom.operators.inference:MeanEncoder"


def _factory(name: str, weights: str | None = None) -> Callable:
    """The factory ``name`` (module:attribute), which gets the path of the weights if one is given."""
    module, _, attribute = name.partition(":")
    made = getattr(importlib.import_module(module), attribute)
    return made if weights is None else partial(made, weights)


def _split_vectors(spark: SparkSession, folder: str, cap: int | None, encoder: str):  # noqa: ANN202
    files = capped(class_folders(spark, folder).select("path", "label"), "label", "path", cap)
    if files.isEmpty():
        raise FileNotFoundError(f"no images in {folder}")
    # with a cap, only the capped files are read and decoded; their paths are bounded by it
    few = None if cap is None else [r.path for r in files.limit(MAX_PATHS + 1).select("path").collect()]
    images = pixels(spark, folder, few if few is None or len(few) <= MAX_PATHS else None)
    return encode(images, _factory(encoder)).join(files, "path").select(F.col("path").alias("key"), "path", "label", "embedding")


def cmd_detect(spark: SparkSession, a: argparse.Namespace) -> None:
    found = wanted(detect(pixels(spark, a.image), _factory(a.detector, a.weights)), a.conf).withColumnRenamed("path", "image_id")
    rows = by_confidence(found).collect()
    if not rows:
        print("no detection")
    for row in rows:
        print(row.image_id)
        for i, d in enumerate(row.detections, 1):
            print(f"  [{i}] bbox=({', '.join(f'{x:.1f}' for x in d.bbox)})  conf={d.conf:.3f}")


def cmd_embed(spark: SparkSession, a: argparse.Namespace) -> None:
    write_table(_split_vectors(spark, a.split_dir, a.cap, a.encoder), a.out)
    print(f"{spark.read.parquet(a.out).count()} embeddings in {a.out}")


def cmd_prototype(spark: SparkSession, a: argparse.Namespace) -> None:
    made = build(spark.read.parquet(a.embeddings), a.cap)
    write_prototypes(made, a.out)
    print(f"{read_prototypes(spark, a.out).classes.count()} classes in {a.out}")


def cmd_infer(spark: SparkSession, a: argparse.Namespace) -> None:
    scorer = scoring.Scorer.of(read_prototypes(spark, a.prototypes))
    vectors = embed_best(pixels(spark, a.image), _factory(a.detector, a.weights), _factory(a.encoder))
    out = scoring.predict(vectors, scorer, a.threshold, a.top_k, a.temperature).withColumn("other", scoring.other_share())
    for row in out.collect():
        print(row.path)
        if row.embedding is None:
            print("  no detection")
            continue
        print(f"  max similarity {row.max_sim:.3f} (threshold {a.threshold})")
        if row.unknown:
            print(f"  unknown: {UNKNOWN}")
        for label, pct in row.topk:
            print(f"  {label:<25s} {pct:5.1f}%")
        if row.other is not None:
            print(f"  {'Other':<25s} {row.other:5.1f}%")


def cmd_eval(spark: SparkSession, a: argparse.Namespace) -> None:
    scorer = scoring.Scorer.of(read_prototypes(spark, a.prototypes))
    scored = scoring.with_scores(_split_vectors(spark, a.split_dir, a.cap, a.encoder), scorer)
    r = evaluation.some(evaluation.hit_rates(scored.select(scoring.rank_of(F.col("label"), scorer).alias("rank"))).first(), "n")
    print(f"Top-1 {r.top1:.4f} ({r.top1_hit}/{r.n})\nTop-3 {r.top3:.4f} ({r.top3_hit}/{r.n})\npurebred sanity {r.purebred_sanity:.4f}")


def cmd_eval_ood(spark: SparkSession, a: argparse.Namespace) -> None:
    scorer = scoring.Scorer.of(read_prototypes(spark, a.prototypes))
    side = lambda folder: scoring.with_scores(_split_vectors(spark, folder, a.cap, a.encoder), scorer).select(scoring.best_score().alias("score"))
    r = evaluation.some(evaluation.auroc(side(a.dog_dir), side(a.cat_dir)).first(), "n_pos", "n_neg")
    print(f"dogs {r.n_pos}, cats {r.n_neg}, AUROC {r.auroc:.4f}")


def cmd_inventory(spark: SparkSession, a: argparse.Namespace) -> None:
    write_table(scan_all(spark, a.raw), a.out)
    manifest = spark.read.parquet(a.out)
    write_report(reports.inventory_report(manifest), a.report)
    print(f"{manifest.count()} images in {a.out}")


def cmd_pairs(spark: SparkSession, a: argparse.Namespace) -> None:
    images = quality.hash_targets(spark.read.parquet(a.manifest)).select("image_id", F.col("image_path").alias("path"))
    hashes = with_hashes(pixels(spark, a.raw)).join(images, "path").select("image_id", "phash_hex")
    write_table(hashes, f"{a.out}/phash")
    hashes = spark.read.parquet(f"{a.out}/phash")
    classes, own = hamming.hash_classes(hashes), F.col("representative")
    apart = hamming.hamming_pairs(hamming.representatives(hashes))
    # copies of one hash are paired with their representative; groups of them are linked all the same
    same = classes.filter(F.col("image_id") != own).select(own.alias("id_a"), F.col("image_id").alias("id_b"), F.lit(0).alias("hamming"))
    write_table(reports.with_sources(apart.unionByName(same)), f"{a.out}/pairs")
    print(f"{spark.read.parquet(f'{a.out}/pairs').count()} pairs in {a.out}/pairs")


def cmd_dedup(spark: SparkSession, a: argparse.Namespace) -> None:
    manifest, scratch = spark.read.parquet(a.manifest), Scratch(spark, "dedup")
    groups = scratch.put(dedup.exact_groups(manifest, spark.read.parquet(a.pairs), scratch), "groups")
    dropped = scratch.put(dedup.keepers(groups), "dropped")
    write_table(quality.mark_dropped(manifest, dropped), a.out)
    removed = remove_files(exports.removals(dropped), a.tree) if a.tree else None
    write_report(reports.dedup_report(groups, dropped, removed), a.report)
    print(f"{dropped.count()} images dropped")


def cmd_taxonomy(spark: SparkSession, a: argparse.Namespace) -> None:
    manifest = spark.read.parquet(a.manifest)
    write_table(taxonomy.with_taxonomy(manifest), a.out)
    write_taxonomy(taxonomy.taxonomy(manifest), a.csv)
    print(f"taxonomy in {a.csv}")


def cmd_split(spark: SparkSession, a: argparse.Namespace) -> None:
    manifest, scratch = spark.read.parquet(a.manifest).drop("dedup_group", "split"), Scratch(spark, "split")
    groups = scratch.put(dedup.group_ids(manifest, spark.read.parquet(a.pairs), scratch).withColumnRenamed("group_id", "dedup_group"), "groups")
    rows = scratch.put(skew_join(manifest, groups, "image_id", "left"), "rows")
    drawn = split.group_split(split.group_table(rows))
    rows = skew_join(rows, scratch.put(drawn, "drawn"), "dedup_group", "left")
    cats = split.half_split(manifest).withColumnRenamed("split", "cat_split")
    listed = F.when(F.col("in_mvp25"), F.col("split"))
    rows = skew_join(rows, scratch.put(cats, "cats"), "image_id", "left").withColumn("split", F.coalesce("cat_split", listed)).drop("cat_split")
    write_table(rows, a.out)
    made = spark.read.parquet(a.out)
    write_splits(made, a.splits)
    write_report(reports.split_report(made), a.report)
    for row in made.filter("in_mvp25").groupBy("split").count().orderBy("split").collect():
        print(f"{row['split']}: {row['count']}")


def cmd_label(spark: SparkSession, a: argparse.Namespace) -> None:
    manifest = spark.read.parquet(a.manifest)
    trees = [exports.label_files(manifest)]
    if a.pseudo:
        trees.append(exports.pseudo_label_files(manifest, spark.read.parquet(a.pseudo)))
    for tree in trees:
        write_files(tree, a.tree)
        print(f"{link_files(tree, a.raw, a.tree)} images linked")
    write_detection_config(a.tree)


def cmd_label_coco(spark: SparkSession, a: argparse.Namespace) -> None:
    images, notes = coco(spark, f"{a.base}/labels.json")
    present = binary(spark, f"{a.base}/data").select(file_name(F.col("path")).alias("file_name"))
    tree = exports.annotation_label_files(images, notes, a.corpus, present)
    write_files(tree, a.tree)
    print(f"{link_files(tree, a.base, a.tree)} images linked")


def cmd_export(spark: SparkSession, a: argparse.Namespace) -> None:
    manifest = spark.read.parquet(a.manifest)
    crops = exports.crops(manifest).withColumnRenamed("image_path", "path")
    written, failed = write_crops(pixels(spark, a.raw).join(crops, "path"), a.out)
    copied = link_files(exports.cat_copies(manifest), a.root, a.out)
    print(f"{written} crops, {failed} failed, {copied} cats")


def parser() -> argparse.ArgumentParser:
    """The commands and their defaults."""
    p = argparse.ArgumentParser(prog="corpusloom")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, *options: tuple[str, dict]) -> None:
        own = sub.add_parser(name)
        for option, how in options:
            own.add_argument(option, **how)
        own.set_defaults(run=run)

    image, cap = ("--image", {"required": True}), ("--cap", {"type": int, "default": None})
    detector, encoder = ("--detector", {"default": DETECTOR}), ("--encoder", {"default": ENCODER})
    prototypes = ("--prototypes", {"default": "artifacts/prototypes"})
    weights = ("--weights", {"default": None})
    manifest, out, raw = ("--manifest", {"required": True}), ("--out", {"required": True}), ("--raw", {"default": "data/raw"})
    pairs, report = ("--pairs", {"required": True}), lambda name: ("--report", {"default": f"data/reports/{name}.md"})
    command("inventory", cmd_inventory, raw, out, report("dataset_inventory"))
    command("pairs", cmd_pairs, manifest, raw, out)
    command("dedup", cmd_dedup, manifest, pairs, out, ("--tree", {"default": None}), report("exact_dedup_report"))
    command("taxonomy", cmd_taxonomy, manifest, out, ("--csv", {"required": True}))
    command("split", cmd_split, manifest, pairs, out, ("--splits", {"required": True}), report("split_report"))
    command("label", cmd_label, manifest, ("--raw", {"default": ""}), ("--tree", {"default": "data/labeled"}), ("--pseudo", {"default": None}))
    command("label-coco", cmd_label_coco, ("--base", {"required": True}), ("--corpus", {"required": True}), ("--tree", {"default": "data/labeled"}))
    command("export", cmd_export, manifest, raw, ("--root", {"default": ""}), out)
    command("detect", cmd_detect, image, detector, weights, ("--conf", {"type": float, "default": CONFIDENCE}))
    command("embed", cmd_embed, ("--split-dir", {"default": "data/processed/breed_body/train"}), ("--out", {"default": "artifacts/embeddings_train"}), cap, encoder)
    command("prototype", cmd_prototype, ("--embeddings", {"default": "artifacts/embeddings_train"}), ("--out", {"default": "artifacts/prototypes"}), ("--cap", {"type": int, "default": CAP}))
    command(
        "infer", cmd_infer, image, prototypes, detector, weights, encoder,
        ("--threshold", {"type": float, "default": scoring.THRESHOLD}), ("--top-k", {"type": int, "default": scoring.TOP_K}), ("--temperature", {"type": float, "default": scoring.TEMPERATURE}),
    )
    command("eval", cmd_eval, ("--split-dir", {"default": "data/processed/breed_body/val"}), prototypes, cap, encoder)
    command("eval-ood", cmd_eval_ood, ("--dog-dir", {"default": "data/processed/breed_body/val"}), ("--cat-dir", {"default": "data/processed/ood/val"}), prototypes, cap, encoder)
    return p


def main(args: list[str] | None = None) -> None:
    """Run a command."""
    a = parser().parse_args(args)
    spark = SparkSession.getActiveSession() or local_session()
    let_workers_import(spark)
    a.run(spark, a)


if __name__ == "__main__":
    main()
