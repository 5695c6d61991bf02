"""Problem 5: splits that keep related records together.

Method: the connected components of the bipartite graph of records and entities are the sets of
records that must stay together; they are then assigned to splits stratum by stratum, largest first,
so that the squared deviation from the target shares stays least. Sets of one stratum and one size
are interchangeable, so the assignment works on the (stratum, size, number of sets) table, which has
a few rows however many records there are; the sets are drawn into their splits by a distributed rank.
Sets of several strata go first, the others make up what those leave lacking.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.dirty import breed_name, group_name, split_name
from corpusloom.operators.components import connected
from corpusloom.operators.skew import ranked, skew_join
from corpusloom.session import Scratch, let_workers_import

#: Most splits that targets may name.
MAX_SPLITS = 1000


def propagate(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(entity, label) of each entity of ``links`` (record, entity): the smallest entity it is linked with through records.

    Only records with two or more entities link any, each its entities with their smallest; however long the
    chains are, they are followed to the end. Null records and entities link nothing. An entity without such a record is its own label.
    """
    pairs = links.filter("record IS NOT NULL AND entity IS NOT NULL").select("record", "entity").distinct()
    pairs = scratch.put(pairs, "pairs")
    least = pairs.groupBy("record").agg(F.min("entity").alias("lo"), F.max("entity").alias("hi")).filter("lo <> hi").select("record", "lo")
    bridge = scratch.put(skew_join(pairs, least, "record").filter("entity <> lo").select("entity", "lo").distinct(), "bridge")
    # sorted, so that the smallest number of a set is its smallest entity
    ends = bridge.select(F.explode(F.array("entity", "lo")).alias("entity")).distinct().orderBy("entity")
    ends = scratch.put(ends.withColumn("vid", F.monotonically_increasing_id()), "ends")
    edges = skew_join(bridge, ends.select("entity", F.col("vid").alias("u")), "entity")
    edges = skew_join(edges, ends.select(F.col("entity").alias("lo"), F.col("vid").alias("v")), "lo")
    roots = connected(edges.select("u", "v"), scratch).join(ends.withColumnRenamed("vid", "v"), "v")
    labels = skew_join(roots, ends.select(F.col("vid").alias("root"), F.col("entity").alias("label")), "root").select("entity", "label")
    every = pairs.select("entity").distinct()
    return every.join(labels, "entity", "left").select("entity", F.coalesce("label", "entity").alias("label"))


def allocate(sizes: pd.DataFrame, lack: list[float]) -> pd.DataFrame:
    """Of each row (size, sets) of one stratum, how many sets go to each split, in columns s0, s1, ...

    ``lack`` is what each split still wants. Largest sizes first; sets of one size fill the splits that
    lack most until all lack the same (the least sum of squares), and the last few go one by one to
    whichever split lacks most.
    """
    sizes = sizes.sort_values("size", ascending=False).reset_index(drop=True)
    lack = np.array(lack, float)
    out = np.zeros((len(sizes), len(lack)), np.int64)
    for i, (size, sets) in enumerate(zip(sizes["size"], sizes["sets"])):
        order = np.sort(lack)[::-1]
        for k in range(len(order), 0, -1):  # the level at which the k neediest splits lack the same
            level = (order[:k].sum() - size * sets) / k
            if k == 1 or order[k - 1] > level:
                break
        take = np.floor(np.maximum(lack - level, 0) / size).astype(np.int64)
        lack = lack - take * size
        for _ in range(int(sets - take.sum())):
            j = int(np.argmax(lack))
            take[j] += 1
            lack[j] -= size
        out[i] = take
    return sizes.assign(**{f"s{j}": out[:, j] for j in range(len(lack))})


def draw(sets: DataFrame, lacks: DataFrame, splits: list[str], scratch: Scratch, name: str) -> DataFrame:
    """(label, split) of ``sets`` (label, stratum, size); ``lacks`` has stratum and l0, l1, ... by split."""
    wants = [f"l{j}" for j in range(len(splits))]
    sizes = sets.groupBy("stratum", "size").agg(F.count(F.lit(1)).alias("sets")).join(lacks, "stratum")
    columns = ", ".join(f"s{j} bigint" for j in range(len(splits)))

    def per_stratum(pdf: pd.DataFrame) -> pd.DataFrame:
        return allocate(pdf[["stratum", "size", "sets"]], pdf[wants].iloc[0].tolist())

    plan = sizes.groupBy("stratum").applyInPandas(per_stratum, f"stratum string, size bigint, sets bigint, {columns}")
    plan = scratch.put(plan.select(F.xxhash64("stratum", "size").alias("cell"), *[f"s{j}" for j in range(len(splits))]), f"plan-{name}")
    split, upto, bounds = F.lit(splits[-1]), F.lit(0), []
    for j, own in enumerate(splits[:-1]):
        upto = upto + F.col(f"s{j}")
        bounds.append((own, upto))
    for own, bound in reversed(bounds):
        split = F.when(F.col("rank") < bound, own).otherwise(split)
    drawn = ranked(sets.withColumn("cell", F.xxhash64("stratum", "size")), ["cell"], F.col("label"))
    return scratch.put(skew_join(drawn, plan, "cell").select("label", split.alias("split")), f"drawn-{name}")


def assign(counts: DataFrame, targets: list[tuple[str, float]], scratch: Scratch) -> DataFrame:
    """(label, split) of each set of ``counts`` (label, stratum, n: rows of that stratum in the set; unique).

    ``targets`` are (split, share); shares are scaled to sum 1, splits without a positive share get nothing.
    Sets of several strata are drawn first, by their main stratum (the smallest name of equals); sets
    of one stratum then make up what that leaves each stratum lacking, and sets whose only stratum is
    null what all rows lack. The result is the same on every run.
    """
    targets = [(s, float(w)) for s, w in targets if s is not None and w is not None and w > 0]
    if not targets:
        raise ValueError("no split has a positive target share")
    splits, total = [s for s, _ in targets], sum(w for _, w in targets)
    shares = [w / total for _, w in targets]
    counts = scratch.put(counts, "counts")
    named = F.col("stratum").isNotNull()
    main = F.min(F.when(named, F.struct((-F.col("n")).alias("n"), F.col("stratum").alias("s"))))
    sets = counts.groupBy("label").agg(main.alias("main"), F.sum("n").alias("size"), F.count(F.when(named, True)).alias("kinds"))
    sets = scratch.put(sets.select("label", F.coalesce("main.s", F.lit("")).alias("stratum"), (-F.col("main.n")).alias("own"), "size", "kinds"), "sets")

    def lacking(wanted: DataFrame, got: DataFrame | None) -> DataFrame:
        lacks = wanted.select("stratum", *[(F.col("n") * w).alias(f"w{j}") for j, w in enumerate(shares)])
        if got is not None:
            lacks = lacks.join(got, "stratum", "left")
        given = lambda j: F.coalesce(F.col(f"g{j}"), F.lit(0)) if got is not None else F.lit(0)
        return lacks.select("stratum", *[(F.col(f"w{j}") - given(j)).alias(f"l{j}") for j in range(len(splits))])

    def gained(rows: DataFrame) -> DataFrame:
        return rows.groupBy("stratum").agg(*[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(f"g{j}") for j, s in enumerate(splits)])

    mixed, single, bare = (sets.filter(c) for c in ("kinds > 1", "kinds = 1", "kinds = 0"))
    first = draw(mixed.select("label", "stratum", "size"), lacking(mixed.groupBy("stratum").agg(F.sum("size").alias("n")), None), splits, scratch, "mixed")
    of_stratum = counts.filter(named).groupBy("stratum").agg(F.sum("n").alias("n"))
    got = gained(counts.filter(named).join(first, "label"))
    second = draw(single.select("label", "stratum", F.col("own").alias("size")), lacking(of_stratum, got), splits, scratch, "single")
    both = first.unionByName(second)
    everything = sets.agg(F.lit("").alias("stratum"), F.sum("size").alias("n"))
    got = gained(sets.join(both, "label").select(F.lit("").alias("stratum"), F.col("size").alias("n"), "split"))
    third = draw(bare.select("label", "stratum", "size"), lacking(everything, got), splits, scratch, "bare")
    return both.unionByName(third)


def leaking(manifest: DataFrame, scratch: Scratch) -> DataFrame:
    """(dedup_group) of each set of related rows whose old split values name more than one of train, val and test.

    Rows without a group or without a split that counts make no case; spellings are brought to one form.
    """
    rows = manifest.select(F.col("rec_id").alias("record"), group_name(F.col("dedup_group")).alias("entity"), split_name(F.col("split")).alias("split"))
    rows = rows.filter("entity IS NOT NULL")
    of = rows.groupBy("entity").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    labels = propagate(rows, scratch)
    # groups of rows without rec_id only are linked with nothing, but count
    labels = of.select("entity").join(labels, "entity", "left").select("entity", F.coalesce("label", "entity").alias("label"))
    torn = labels.join(of, "entity").groupBy("label").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi")
    return labels.join(torn, "label", "left_semi").select(F.col("entity").alias("dedup_group"))


def regroup(manifest: DataFrame, targets: list[tuple[str, float]], scratch: Scratch) -> DataFrame:
    """(rec_id, set_id, canonical_breed, split) of each row of ``manifest``.

    Rows of one dedup_group, and scans of one image, come out in one split. A row without a group is
    related to the scans of its image only; without an image_id, to nothing. Repeated rows stay. Rows
    without a breed count for the overall shares only.
    """
    rows = manifest.select(
        "rec_id",
        F.coalesce(F.concat(F.lit("image "), "image_id"), F.concat(F.lit("record "), "rec_id"), F.lit("nameless")).alias("record"),
        group_name(F.col("dedup_group")).alias("group"),
        breed_name(F.col("canonical_breed")).alias("canonical_breed"),
    )
    rows = scratch.put(rows.withColumn("entity", F.coalesce("group", "record")), "rows")
    labels = scratch.put(propagate(rows.select("record", "entity"), scratch), "labels")
    # the record links the scans of an image that have a group with those that have none
    rows = scratch.put(skew_join(rows, labels, "entity").select("rec_id", "canonical_breed", F.col("label").alias("set_id")), "labelled")
    counts = rows.groupBy(F.col("set_id").alias("label"), F.col("canonical_breed").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    split = assign(counts, targets, scratch)
    return skew_join(rows, split.select(F.col("label").alias("set_id"), "split"), "set_id").select("rec_id", "set_id", "canonical_breed", "split")


def _targets(spark: SparkSession, sf: str) -> list[tuple[str, float]]:
    rows = spark.read.parquet(f"{sf}/split_targets.parquet").select("split", "target_share").limit(MAX_SPLITS + 1).collect()
    if len(rows) > MAX_SPLITS:
        raise ValueError(f"there are more than {MAX_SPLITS} target splits")
    order = {"train": 0, "val": 1, "test": 2}
    return sorted(((r[0], r[1]) for r in rows), key=lambda r: (order.get(r[0], 9), r[0] or ""))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Groups that the split column at hand tears apart."""
    return leaking(spark.read.parquet(f"{sf}/master_manifest.parquet"), Scratch(spark, "p5"))


def p5_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of the manifest with its new split."""
    let_workers_import(spark)
    return regroup(spark.read.parquet(f"{sf}/master_manifest.parquet"), _targets(spark, sf), Scratch(spark, "p5"))


def p5_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and reached share of each split per canonical_breed, and over all rows (scope 'all')."""
    new = p5_splits(spark, sf)
    counts = new.groupBy("canonical_breed", "split").agg(F.count(F.lit(1)).alias("rows"))
    both = counts.select(F.lit("breed").alias("scope"), "canonical_breed", "split", "rows").unionByName(
        counts.groupBy("split").agg(F.sum("rows").alias("rows")).select(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("canonical_breed"), "split", "rows")
    )
    of = F.sum("rows").over(Window.partitionBy("scope", "canonical_breed"))
    return both.withColumn("share", F.round(F.col("rows") / of, 6))


def p5_kept(spark: SparkSession, sf: str) -> DataFrame:
    """What the new splits must keep, counted: rows, rows without one of the target splits, groups and images in more than one split, and splits that miss their overall share by a hundredth."""
    new, targets = p5_splits(spark, sf), _targets(spark, sf)
    manifest = spark.read.parquet(f"{sf}/master_manifest.parquet").select("rec_id", "image_id", group_name(F.col("dedup_group")).alias("group")).distinct()
    new = Scratch(spark, "p5-kept").put(new, "new")
    rows = skew_join(manifest, new.groupBy("rec_id").agg(F.min("split").alias("lo"), F.max("split").alias("hi")), "rec_id")
    torn = lambda key: rows.filter(f"`{key}` IS NOT NULL").groupBy(key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").agg(F.count(F.lit(1)).alias(f"torn_{key}s"))
    total = F.count(F.lit(1))
    whole = sum(w for _, w in targets)
    off = sum((F.abs(F.count(F.when(F.col("split") == s, True)) / total - w / whole) > 0.01).cast("bigint") for s, w in targets)
    counts = new.agg(total.alias("rows"), F.count(F.when(~F.coalesce(F.col("split").isin([s for s, _ in targets]), F.lit(False)), True)).alias("unassigned"), off.alias("off"))
    return counts.crossJoin(torn("group")).crossJoin(torn("image_id"))  # one row each


QUERIES = {"p5_found": p5_found, "p5_splits": p5_splits, "p5_shares": p5_shares, "p5_kept": p5_kept}

ORACLES = {
    "p5_kept": "SELECT count(*) AS rows, 0::BIGINT AS unassigned, 0::BIGINT AS off, 0::BIGINT AS torn_groups, 0::BIGINT AS torn_image_ids FROM master_manifest",
    "p5_found": r"""
WITH r AS (
  SELECT upper(regexp_replace(dedup_group, '^\s+|\s+$', '', 'g')) AS g, lower(regexp_replace(split, '^\s+|\s+$', '', 'g')) AS s FROM master_manifest),
n AS (
  SELECT CASE WHEN regexp_matches(g, '^DG[\s_-]*[0-9A-F]{1,8}$') THEN 'DG_' || lower(lpad(regexp_extract(g, '^DG[\s_-]*([0-9A-F]{1,8})$', 1), 8, '0'))
              WHEN regexp_matches(g, '^SG[\s_-]*[0-9]+$') THEN 'SG_' || CAST(CAST(regexp_extract(g, '^SG[\s_-]*([0-9]+)$', 1) AS BIGINT) AS VARCHAR) END AS dedup_group,
         CASE WHEN s IN ('train', 'training', 'trn') THEN 'train' WHEN s IN ('val', 'valid', 'validation') THEN 'val' WHEN s IN ('test', 'testing', 'tst') THEN 'test' END AS split
  FROM r)
SELECT dedup_group FROM n WHERE dedup_group IS NOT NULL AND split IS NOT NULL GROUP BY dedup_group HAVING count(DISTINCT split) > 1"""
}
