"""The engine's own queries over the driver's tables, each with the SQL it is checked against.

Vectors come from ``embeddings`` (labels 0 to 9 as strings), boxes, labels and groups from the manifest,
pairs and hashes from the phash tables, detections and annotations from ``events`` (user_id as image, value as
confidence). The table's cosines are low, so rejection is shown at 0.15 besides the default 0.5.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import geometry, names, vec
from corpusloom.operators import dedup, detections, hamming, inference, quality, split, taxonomy
from corpusloom.operators.components import components
from corpusloom.plans import evaluation, exports, reports, scoring
from corpusloom.plans.prototype import CAP, Prototypes, build, capped
from corpusloom.session import Scratch
from corpusloom.sources import files, sinks

QUERIES: dict = {}
ORACLES: dict = {}
#: Threshold at which both outcomes occur on the test vectors.
SHOWN_THRESHOLD = 0.15


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its name, with its SQL if it has one."""

    def register(run):  # noqa: ANN001, ANN202
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").cast("string").alias("label"), "embedding")


def _known(spark: SparkSession, sf: str) -> Prototypes:
    """Prototypes of the classes 0 to 7; 8 and 9 stand for what is no class."""
    return build(_vectors(spark, sf).filter(~F.col("label").isin("8", "9")))


def _six(c: str) -> Column:
    return (F.round(c, 6) + F.lit(0.0)).alias(c)


# ---------------------------------------------------------------- SQL building blocks


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / greatest(sqrt(list_inner_product({v}, {v})), 1e-12))"


_BASE = f"""
r0 AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
r AS (SELECT vec_id, label, e, {_unit("e")} AS u FROM r0),
c AS (SELECT vec_id, label, u FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM r {{where}}) WHERE rn <= 50),
l AS (SELECT vec_id, label, unnest(u) AS v, generate_subscripts(u, 1) AS p FROM c),
g AS (SELECT list(m ORDER BY p) AS gm FROM (SELECT p, avg(v) AS m FROM l GROUP BY p)),
c0 AS (SELECT label, list(m ORDER BY p) AS w FROM (SELECT label, p, avg(v) AS m FROM l GROUP BY label, p) GROUP BY label),
c1 AS (SELECT label, {_unit("w")} AS w FROM c0),
s AS (SELECT c.vec_id, c.label, c.u, list_inner_product(c.u, c1.w) AS cos, count(*) OVER (PARTITION BY c.label) AS n FROM c JOIN c1 USING (label)),
t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(cos, 12), vec_id) > floor(n * 0.05e0) AS kept FROM s),
l2 AS (SELECT label, unnest(u) AS v, generate_subscripts(u, 1) AS p FROM t WHERE kept),
c2 AS (SELECT label, list(m ORDER BY p) AS w FROM (SELECT label, p, avg(v) AS m FROM l2 GROUP BY label, p) GROUP BY label),
c3 AS (SELECT label, {_unit("w")} AS w FROM c2),
c4 AS (SELECT label, list_transform(list_zip(w, gm), lambda z: z[1] - z[2]) AS w FROM c3, g),
pr AS (SELECT label, {_unit("w")} AS prototype FROM c4)"""
_ALL = "WITH " + _BASE.format(where="")
_KNOWN = (
    "WITH "
    + _BASE.format(where="WHERE label NOT IN ('8', '9')")
    + f""",
q0 AS (SELECT vec_id, label, list_transform(list_zip(e, gm), lambda z: z[1] - z[2]) AS w FROM r, g),
q AS (SELECT vec_id, label, {_unit("w")} AS w FROM q0),
sc AS (SELECT q.vec_id, q.label AS own, pr.label, list_inner_product(q.w, pr.prototype) AS s FROM q, pr),
mx AS (SELECT vec_id, own, max(s) AS max_sim FROM sc GROUP BY vec_id, own),
sm AS (SELECT sc.*, max_sim, exp((s - max_sim) / 0.1e0) / sum(exp((s - max_sim) / 0.1e0)) OVER (PARTITION BY vec_id) AS p,
              row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12) DESC, sc.label) AS rk,
              row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, sc.label DESC) AS rank_down
       FROM sc JOIN mx USING (vec_id, own))"""
)
_R6 = "list_transform({0}, lambda x: round(x, 6) + 0.0)"

# ---------------------------------------------------------------- vectors and prototypes


@query(f"WITH r AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, {_R6.format(_unit('e'))} AS unit FROM r")
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector at length 1."""
    return _vectors(spark, sf).select(F.col("key").alias("vec_id"), vec.rounded(vec.unit(vec.doubles("embedding"))).alias("unit"))


@query("SELECT vec_id, label FROM (SELECT vec_id, CAST(label AS VARCHAR) AS label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= 50")
def class_cap(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 vectors of each class."""
    return capped(_vectors(spark, sf), "label", "key", CAP).select(F.col("key").alias("vec_id"), "label")


@query(_ALL + f" SELECT {_R6.format('gm')} AS global_mean FROM g")
def global_mean(spark: SparkSession, sf: str) -> DataFrame:
    """The mean of all capped vectors."""
    return build(_vectors(spark, sf)).global_mean.select(vec.rounded(F.col("global_mean")).alias("global_mean"))


@query(_ALL + f" SELECT label, {_R6.format('w')} AS centroid FROM c1")
def class_centroid(spark: SparkSession, sf: str) -> DataFrame:
    """The mean direction of each class before trimming."""
    rows = build(_vectors(spark, sf), trim=0.0).members
    return rows.groupBy("label").agg(vec.rounded(vec.unit(vec.mean(F.col("u")))).alias("centroid"))


@query(_ALL + " SELECT vec_id, label, round(cos, 6) + 0.0 AS cos, kept FROM t")
def outlier_trim(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of each capped vector to its class, and whether it stays."""
    return build(_vectors(spark, sf)).members.select(F.col("key").alias("vec_id"), "label", _six("cos"), "kept")


@query(_ALL + f" SELECT label, {_R6.format('prototype')} AS prototype FROM pr")
def prototypes(spark: SparkSession, sf: str) -> DataFrame:
    """The centred prototype of each class."""
    return build(_vectors(spark, sf)).classes.select("label", vec.rounded(F.col("prototype")).alias("prototype"))


def _scored(spark: SparkSession, sf: str) -> tuple[DataFrame, scoring.Scorer]:
    scorer = scoring.Scorer.of(_known(spark, sf))
    return scoring.with_scores(_vectors(spark, sf), scorer), scorer


@query(_KNOWN + " SELECT vec_id, label, round(s, 6) + 0.0 AS score FROM sc")
def similarity_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The cosine of every vector to every class."""
    scored, scorer = _scored(spark, sf)
    each = scored.select(F.col("key").alias("vec_id"), F.explode(F.arrays_zip(scoring.label_array(scorer).alias("label"), F.col("scores").alias("score"))).alias("c"))
    return each.select("vec_id", "c.label", _six("c.score").alias("score"))


@query(_KNOWN + " SELECT vec_id, round(max_sim, 6) + 0.0 AS max_sim FROM mx")
def max_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """The highest cosine of every vector."""
    return _scored(spark, sf)[0].select(F.col("key").alias("vec_id"), (F.round(scoring.best_score(), 6) + F.lit(0.0)).alias("max_sim"))


@query(_KNOWN + f" SELECT vec_id, max_sim < 0.5e0 AS unknown, max_sim < {SHOWN_THRESHOLD}e0 AS unknown_low FROM mx")
def unknown_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Rejected at the default threshold and at a low one."""
    best = scoring.best_score()
    return _scored(spark, sf)[0].select(F.col("key").alias("vec_id"), (best < scoring.THRESHOLD).alias("unknown"), (best < SHOWN_THRESHOLD).alias("unknown_low"))


@query(_KNOWN + " SELECT vec_id, label, round(p * 100, 6) AS pct FROM sm")
def softmax_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """The softmax over all classes at temperature 0.1, in per cent."""
    scored, scorer = _scored(spark, sf)
    each = scored.select(F.col("key").alias("vec_id"), F.explode(F.arrays_zip(scoring.label_array(scorer).alias("label"), scoring.probabilities().alias("p"))).alias("c"))
    return each.select("vec_id", "c.label", F.round(F.col("c.p") * 100, 6).alias("pct"))


def _predicted(spark: SparkSession, sf: str, threshold: float) -> DataFrame:
    return scoring.predict(_vectors(spark, sf), scoring.Scorer.of(_known(spark, sf)), threshold)


@query(
    _KNOWN
    + f""" SELECT mx.vec_id, max_sim < {SHOWN_THRESHOLD}e0 AS unknown, round(max_sim, 6) + 0.0 AS max_sim, CAST(x.rk AS INTEGER) AS rank, x.label, round(x.p * 100, 6) AS pct
FROM mx LEFT JOIN (SELECT vec_id, rk, label, p FROM sm WHERE rk <= 3 AND max_sim >= {SHOWN_THRESHOLD}e0) x USING (vec_id)"""
)
def topk_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector's best three classes, a row each; a rejected vector has one row without class."""
    out = _predicted(spark, sf, SHOWN_THRESHOLD).select(F.col("key").alias("vec_id"), "unknown", _six("max_sim"), F.posexplode_outer("topk").alias("pos", "t"))
    return out.select("vec_id", "unknown", "max_sim", (F.col("pos") + 1).alias("rank"), F.col("t.label").alias("label"), F.round("t.pct", 6).alias("pct"))


@query(_KNOWN + " SELECT vec_id, round(max_sim, 6) + 0.0 AS max_sim, max_sim < 0.5e0 AS unknown, 3 * CAST(max_sim >= 0.5e0 AS INTEGER) AS classes FROM mx")
def default_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions at the default threshold: how many classes are reported."""
    return _predicted(spark, sf, scoring.THRESHOLD).select(F.col("key").alias("vec_id"), _six("max_sim"), "unknown", F.size("topk").alias("classes"))


@query(_KNOWN + f" SELECT vec_id, round(100 - sum(p) * 100, 6) AS other FROM sm WHERE rk <= 3 AND max_sim >= {SHOWN_THRESHOLD}e0 GROUP BY vec_id HAVING 100 - sum(p) * 100 > 0.05e0")
def topk_other(spark: SparkSession, sf: str) -> DataFrame:
    """What the best three classes leave of 100, where it is worth reporting."""
    return _predicted(spark, sf, SHOWN_THRESHOLD).select(F.col("key").alias("vec_id"), F.round(scoring.other_share(), 6).alias("other")).filter("other IS NOT NULL")


@query(
    _KNOWN
    + """ SELECT count(*) AS n, round(avg(CAST(rank_down = 1 AS INTEGER)), 6) AS top1, round(avg(CAST(rank_down <= 3 AS INTEGER)), 6) AS top3,
  count(*) FILTER (WHERE rank_down = 1) AS top1_hit, count(*) FILTER (WHERE rank_down <= 3) AS top3_hit, round(avg(CAST(rank_down = 1 AS INTEGER)), 6) AS purebred_sanity
FROM sm WHERE own = label"""
)
def top1_top3(spark: SparkSession, sf: str) -> DataFrame:
    """Hit rates over the vectors of the known classes."""
    scored, scorer = _scored(spark, sf)
    ranks = scored.filter(~F.col("label").isin("8", "9")).select(scoring.rank_of(F.col("label"), scorer).alias("rank"))
    out = evaluation.hit_rates(ranks)
    return out.select("n", _six("top1"), _six("top3"), "top1_hit", "top3_hit", _six("purebred_sanity"))


@query("SELECT l_quantity AS score, count(*) AS n, min(rk) + (count(*) - 1) / 2.0e0 AS rank FROM (SELECT l_quantity, rank() OVER (ORDER BY l_quantity) AS rk FROM lineitem) GROUP BY l_quantity")
def average_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Average ranks of a column full of ties."""
    return evaluation.average_ranks(_read(spark, sf, "lineitem").select(F.col("l_quantity").alias("score")))


@query(
    _KNOWN
    + """, o AS (SELECT max_sim, own NOT IN ('8', '9') AS pos, rank() OVER (ORDER BY max_sim) + (count(*) OVER (PARTITION BY max_sim) - 1) / 2.0e0 AS rk FROM mx)
SELECT count(*) FILTER (WHERE pos) AS n_pos, count(*) FILTER (WHERE NOT pos) AS n_neg,
  round((sum(rk) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0e0) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 6) AS auroc FROM o"""
)
def auroc_ood(spark: SparkSession, sf: str) -> DataFrame:
    """How well the highest cosine tells the known classes from the others."""
    scores = _scored(spark, sf)[0].select(F.col("label").isin("8", "9").alias("strange"), scoring.best_score().alias("score"))
    out = evaluation.auroc(scores.filter("NOT strange"), scores.filter("strange"))
    return out.select("n_pos", "n_neg", _six("auroc"))


# ---------------------------------------------------------------- manifest: rows, boxes, labels


@query("SELECT image_id, split_part(image_id, '/', 1) AS source, count(*) AS rows FROM master_manifest GROUP BY image_id")
def source_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus every image id begins with."""
    rows = _read(spark, sf, "master_manifest").groupBy("image_id").agg(F.count(F.lit(1)).alias("rows"))
    return rows.select("image_id", names.source_of(F.col("image_id")).alias("source"), "rows")


@query(
    """SELECT source, count(image_id) AS images, count(DISTINCT original_breed) AS breeds, count(body_bbox) AS with_body_bbox, count(head_bbox) AS with_head_bbox,
  sum(CAST(usable AS INTEGER)) AS usable FROM master_manifest WHERE source IS NOT NULL GROUP BY source"""
)
def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Images, breeds, boxes and usable rows per corpus."""
    return reports.inventory(_read(spark, sf, "master_manifest"))


@query("SELECT source, exclusion_reason, count(*) AS n FROM master_manifest WHERE NOT usable AND source IS NOT NULL AND exclusion_reason IS NOT NULL GROUP BY ALL")
def exclusion_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """Unusable rows per corpus and reason."""
    return reports.exclusions(_read(spark, sf, "master_manifest"))


@query("SELECT source, original_breed, count(*) AS n FROM master_manifest WHERE usable AND source IS NOT NULL AND original_breed IS NOT NULL GROUP BY ALL ORDER BY n DESC, source, original_breed LIMIT 40")
def top_breeds(spark: SparkSession, sf: str) -> DataFrame:
    """The 40 largest groups of usable rows by corpus and breed."""
    return reports.top_breeds(_read(spark, sf, "master_manifest"))


_FAULT = """CASE WHEN {b}[1] >= {b}[3] OR {b}[2] >= {b}[4] THEN 'invalid_bbox_order'
  WHEN {b}[3] > width * 1.02e0 OR {b}[4] > height * 1.02e0 OR {b}[1] < -width * 0.02e0 OR {b}[2] < -height * 0.02e0 THEN 'bbox_out_of_image' END"""


@query(f"SELECT rec_id, {_FAULT.format(b='body_bbox')} AS body, {_FAULT.format(b='head_bbox')} AS head FROM master_manifest")
def bbox_validate(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with each box."""
    fault = lambda c: geometry.box_fault(F.col(f"{c}_bbox"), F.col("width"), F.col("height")).alias(c)
    return _read(spark, sf, "master_manifest").select("rec_id", fault("body"), fault("head"))


@query(
    f"""SELECT rec_id, reason, reason IS NULL AS usable FROM (SELECT rec_id, coalesce(CASE WHEN width = 0 OR height = 0 THEN 'corrupt_image' END,
  CASE WHEN body_bbox IS NULL OR len(body_bbox) = 0 THEN 'missing_annotation' END, {_FAULT.format(b="body_bbox")}, {_FAULT.format(b="head_bbox")}) AS reason FROM master_manifest)"""
)
def reason_precedence(spark: SparkSession, sf: str) -> DataFrame:
    """The first reason that makes a row unusable."""
    rows = _read(spark, sf, "master_manifest")
    error = F.when((F.col("width") == 0) | (F.col("height") == 0), "corrupt_image")
    reason = quality.first_reason(error, F.col("body_bbox"), F.col("head_bbox"), F.col("width"), F.col("height"))
    return rows.select("rec_id", reason.alias("reason"), reason.isNull().alias("usable"))


@query("SELECT rec_id, image_id FROM master_manifest WHERE usable OR exclusion_reason = 'cat_ood_only'")
def hash_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose image is hashed."""
    return quality.hash_targets(_read(spark, sf, "master_manifest")).select("rec_id", "image_id")


@query("SELECT rec_id, canonical_breed, split FROM master_manifest WHERE in_mvp25 AND split IS NOT NULL")
def listed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the frozen set with a split."""
    return quality.listed_rows(_read(spark, sf, "master_manifest")).select("rec_id", "canonical_breed", "split")


_CANON = "coalesce(m.name, translate(lower({0}), '- ', '__'))"
_RENAMED = """(VALUES ('toy_poodle', 'poodle'), ('miniature_poodle', 'poodle'), ('standard_poodle', 'poodle'), ('teddy', 'poodle'), ('shiba_dog', 'shiba_inu'), ('cardigan', 'corgi'), ('pembroke', 'corgi'),
  ('staffordshire_bull_terrier', 'staffordshire_bullterrier'), ('basset_hound', 'basset'), ('shih-tzu', 'shih_tzu'), ('maltese', 'maltese_dog'), ('chinese_rural_dog', '__DROP__'), ('english_cocker_spaniel', '__NOT_MVP__')) AS m(label, name)"""
_NUMBERS = "(VALUES " + ", ".join(f"('{n}', {i})" for i, n in enumerate(names.CANONICAL)) + ") AS k(name, id)"
_LABELLED = f"""
x AS (SELECT t.*, CASE WHEN starts_with(original_breed, 'CAT_') THEN '__CAT_OOD__' ELSE {_CANON.format("original_breed")} END AS canonical
      FROM master_manifest t LEFT JOIN {_RENAMED} ON m.label = translate(lower(original_breed), '- ', '__')),
y AS (SELECT x.*, k.id AS number FROM x LEFT JOIN {_NUMBERS} ON k.name = x.canonical)"""


@query(f"WITH {_LABELLED} SELECT rec_id, canonical AS canonical_breed, number AS breed_id, coalesce(number IS NOT NULL AND usable, false) AS in_mvp25 FROM y")
def canonical_label(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical breed, number and membership of the frozen set of each row."""
    return taxonomy.with_taxonomy(_read(spark, sf, "master_manifest")).select("rec_id", "canonical_breed", "breed_id", "in_mvp25")


@query(
    f"""WITH {_LABELLED} SELECT source, original_breed AS original_label, any_value(canonical) AS canonical_label, any_value(number) AS breed_id,
  CASE WHEN any_value(canonical) = '__DROP__' THEN 'drop' WHEN any_value(number) IS NULL THEN 'not_mvp' ELSE 'mvp25' END AS action, count(*) AS n_images
FROM y WHERE NOT starts_with(original_breed, 'CAT_') GROUP BY source, original_breed"""
)
def taxonomy_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every label with its canonical breed and rows."""
    return taxonomy.taxonomy(_read(spark, sf, "master_manifest"))


@query(
    f"""WITH x AS (SELECT p_partkey, CASE WHEN p_partkey IS NULL THEN NULL ELSE p_type END AS label, p_name FROM part)
SELECT p_partkey, {_CANON.format("p_name")} AS canonical FROM x LEFT JOIN {_RENAMED} ON m.label = translate(lower(p_name), '- ', '__')"""
)
def even_names(spark: SparkSession, sf: str) -> DataFrame:
    """Part names in the even spelling of labels."""
    return _read(spark, sf, "part").select("p_partkey", names.canonical(F.col("p_name")).alias("canonical"))


@query("SELECT canonical_breed, count(*) AS n FROM master_manifest WHERE in_mvp25 GROUP BY canonical_breed")
def listed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the frozen set by breed."""
    return _read(spark, sf, "master_manifest").filter("in_mvp25").groupBy("canonical_breed").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT *, test + train + val AS total, round_even(train / CAST(test + train + val AS DOUBLE) * 100, 1) AS train_pct FROM (
  SELECT canonical_breed, count(*) FILTER (WHERE split = 'test') AS test, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val
  FROM master_manifest WHERE in_mvp25 AND canonical_breed IS NOT NULL AND split IS NOT NULL GROUP BY canonical_breed) WHERE test + train + val > 0"""
)
def split_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by breed and split, and train's share."""
    return reports.split_table(_read(spark, sf, "master_manifest"))


_BASENAME, _FOLDER = "string_split_regex(image_path, '[/\\\\]')[-1]", "string_split_regex(image_path, '[/\\\\]')[-2]"


@query(
    f"""WITH f AS (SELECT DISTINCT image_path, {_BASENAME} AS file, {_FOLDER} AS folder FROM master_manifest)
SELECT image_path, file, folder, regexp_replace(file, '^(.+)\\.[^.]*$', '\\1') AS stem,
  coalesce(nullif(regexp_extract(regexp_replace(file, '^(.+)\\.[^.]*$', '\\1'), '^(.*)_[^_]*$', 1), ''), regexp_replace(file, '^(.+)\\.[^.]*$', '\\1')) AS flat_breed FROM f"""
)
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    """File, folder, stem and the breed in a flat file name, of paths with either separator."""
    file = names.file_name(F.col("image_path"))
    rows = _read(spark, sf, "master_manifest").select("image_path").distinct()
    return rows.select("image_path", file.alias("file"), names.folder_name(F.col("image_path")).alias("folder"), names.stem(file).alias("stem"), names.before_last_underscore(names.stem(file)).alias("flat_breed"))


_CROP = """
b AS (SELECT rec_id, width, height, {box}[1] - ({box}[3] - {box}[1]) * 0.15e0 AS l, {box}[2] - ({box}[4] - {box}[2]) * 0.15e0 AS t,
             {box}[3] + ({box}[3] - {box}[1]) * 0.15e0 AS r, {box}[4] + ({box}[4] - {box}[2]) * 0.15e0 AS d FROM {table} WHERE len({box}) = 4 AND len(list_filter({box}, lambda x: isfinite(x))) = 4),
h AS (SELECT *, greatest(r - l, d - t) / 2 AS half, (l + r) / 2 AS cx, (t + d) / 2 AS cy FROM b),
w AS (SELECT rec_id, greatest(0, CAST(round_even(cx - half, 0) AS INTEGER)) AS ix1, greatest(0, CAST(round_even(cy - half, 0) AS INTEGER)) AS iy1,
             least(width, CAST(round_even(cx + half, 0) AS INTEGER)) AS ix2, least(height, CAST(round_even(cy + half, 0) AS INTEGER)) AS iy2 FROM h),
z AS (SELECT *, greatest(ix2 - ix1, iy2 - iy1) AS side_px FROM w)
SELECT rec_id, ix1, iy1, ix2, iy2, side_px, CAST(floor((side_px - (ix2 - ix1)) / 2.0) AS INTEGER) AS off_x, CAST(floor((side_px - (iy2 - iy1)) / 2.0) AS INTEGER) AS off_y FROM z"""


@query("WITH " + _CROP.format(box="body_bbox", table="master_manifest"))
def crop_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """Window, side and offsets of the standard crop of each body box."""
    rows = _read(spark, sf, "master_manifest").select("rec_id", geometry.crop(F.col("body_bbox"), F.col("width"), F.col("height")).alias("c"))
    return rows.filter("c IS NOT NULL").select("rec_id", "c.*")


@query(
    "WITH li AS (SELECT l_orderkey * 10 + l_linenumber AS rec_id, [l_quantity * 7.5e0 - 20, l_tax * 900 - 10, l_quantity * 7.5e0 + 60 + l_discount * 999, l_tax * 900 + 200] AS box, 640 AS width, 480 AS height FROM lineitem), "
    + _CROP.format(box="box", table="li")
)
def crop_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    """The same over boxes made from order lines, which reach over every edge."""
    q, t, d = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    box = F.array(q * 7.5 - 20, t * 900 - 10, q * 7.5 + 60 + d * 999, t * 900 + 200)
    rows = _read(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rec_id"), geometry.crop(box, F.lit(640), F.lit(480)).alias("c"))
    return rows.select("rec_id", "c.*")


@query(
    """SELECT rec_id, round((greatest(0, b[1]) + least(width, b[3])) / 2 / width, 12) + 0.0 AS cx, round((greatest(0, b[2]) + least(height, b[4])) / 2 / height, 12) + 0.0 AS cy,
  round((least(width, b[3]) - greatest(0, b[1])) / width, 12) + 0.0 AS w, round((least(height, b[4]) - greatest(0, b[2])) / height, 12) + 0.0 AS h
FROM (SELECT rec_id, body_bbox AS b, width, height FROM master_manifest WHERE len(body_bbox) = 4 AND width > 0 AND height > 0)"""
)
def yolo_norm(spark: SparkSession, sf: str) -> DataFrame:
    """Centre and size of each body box as shares of the image."""
    rows = _read(spark, sf, "master_manifest").filter("size(body_bbox) = 4 AND width > 0 AND height > 0")
    rows = rows.select("rec_id", geometry.normalised(F.col("body_bbox"), F.col("width"), F.col("height")).alias("b"))
    return rows.select("rec_id", *[(F.round(f"b.{c}", 12) + F.lit(0.0)).alias(c) for c in ("cx", "cy", "w", "h")])


@query("SELECT l_orderkey, l_linenumber, [l_quantity, l_discount, l_quantity + l_tax, l_discount + l_extendedprice] AS box FROM lineitem")
def xywh_to_xyxy(spark: SparkSession, sf: str) -> DataFrame:
    """Corner and size to two corners."""
    box = geometry.xywh_to_xyxy(F.array("l_quantity", "l_discount", "l_tax", "l_extendedprice"))
    return _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", box.alias("box"))


@query(
    f"""SELECT rec_id, part, 'breed_' || part || '/' || split || '/' || canonical_breed || '/' || regexp_replace({_BASENAME}, '^(.+)\\.[^.]*$', '\\1') || '.jpg' AS target
FROM (SELECT *, 'body' AS part, body_bbox AS box FROM master_manifest UNION ALL SELECT *, 'head', head_bbox FROM master_manifest)
WHERE in_mvp25 AND split IS NOT NULL AND canonical_breed IS NOT NULL AND len(box) = 4"""
)
def export_crops(spark: SparkSession, sf: str) -> DataFrame:
    """Where each body and head crop goes."""
    rows = _read(spark, sf, "master_manifest").filter("canonical_breed IS NOT NULL")
    crops = exports.crops(rows.drop("image_id").withColumnRenamed("rec_id", "image_id"))
    return crops.select(F.col("image_id").alias("rec_id"), "part", "target")


@query(f"SELECT rec_id, 'ood/' || split || '/cat/' || {_BASENAME} AS target FROM master_manifest WHERE canonical_breed = '__CAT_OOD__' AND split IS NOT NULL")
def export_cats(spark: SparkSession, sf: str) -> DataFrame:
    """Where each cat's original goes."""
    rows = exports.cat_copies(_read(spark, sf, "master_manifest").drop("image_id").withColumnRenamed("rec_id", "image_id"))
    return rows.select(F.col("image_id").alias("rec_id"), "target")


# ---------------------------------------------------------------- hashes, pairs, duplicates


@query("SELECT image_id, CASE WHEN ('0x' || phash_hex)::UBIGINT >= 9223372036854775808 THEN CAST(('0x' || phash_hex)::UBIGINT::HUGEINT - 18446744073709551616 AS BIGINT) ELSE CAST(('0x' || phash_hex)::UBIGINT AS BIGINT) END AS bits FROM phash WHERE phash_hex IS NOT NULL")
def hash_values(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes as signed numbers; null hashes are left out."""
    return _read(spark, sf, "phash").select("image_id", names.hash_bits(F.col("phash_hex")).alias("bits")).filter("bits IS NOT NULL")


_CLASSES = "c AS (SELECT ('0x' || phash_hex)::UBIGINT AS bits, min(image_id) AS representative FROM phash WHERE phash_hex IS NOT NULL AND image_id IS NOT NULL GROUP BY 1)"


@query(f"WITH {_CLASSES} SELECT DISTINCT p.image_id, c.representative FROM phash p JOIN c ON ('0x' || p.phash_hex)::UBIGINT = c.bits WHERE p.image_id IS NOT NULL")
def hash_members(spark: SparkSession, sf: str) -> DataFrame:
    """The class of equal hashes that each image is in."""
    return hamming.hash_classes(_read(spark, sf, "phash")).select("image_id", "representative").distinct()


@query(f"WITH {_CLASSES} SELECT a.representative AS id_a, b.representative AS id_b, CAST(bit_count(xor(a.bits, b.bits)) AS INTEGER) AS hamming FROM c a JOIN c b ON a.representative < b.representative AND bit_count(xor(a.bits, b.bits)) <= 10")
def hamming_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of hash classes within distance 10, by multi-index hashing; see hash_members for the members."""
    return hamming.hamming_pairs(hamming.representatives(_read(spark, sf, "phash")))


@query("SELECT id_a, id_b, split_part(id_a, '/', 1) AS src_a, split_part(id_b, '/', 1) AS src_b, split_part(id_a, '/', 1) <> split_part(id_b, '/', 1) AS cross_dataset FROM phash_pairs")
def cross_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a pair crosses corpora, by its ids."""
    return reports.with_sources(_read(spark, sf, "phash_pairs")).select("id_a", "id_b", "src_a", "src_b", "cross_dataset")


@query(
    """SELECT count(*) AS total, count(*) FILTER (WHERE hamming <= 5) AS sure, count(*) FILTER (WHERE hamming BETWEEN 6 AND 8) AS likely,
  count(*) FILTER (WHERE hamming BETWEEN 9 AND 10) AS doubtful, count(*) FILTER (WHERE cross_dataset) AS crossing FROM phash_pairs WHERE hamming BETWEEN 0 AND 10"""
)
def pair_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs by range of distance."""
    return reports.pair_summary(_read(spark, sf, "phash_pairs"))


@query("SELECT src_a, src_b, count(*) AS n FROM phash_pairs WHERE cross_dataset GROUP BY src_a, src_b")
def pair_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Crossing pairs by corpora."""
    return reports.crossing_pairs(_read(spark, sf, "phash_pairs"))


@query("SELECT id_a AS a, id_b AS b FROM phash_pairs WHERE hamming <= 5")
def strict_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that count as exact duplicates."""
    return dedup.pair_edges(_read(spark, sf, "phash_pairs"), dedup.EXACT_DISTANCE)


_MD5_EDGES = """m AS (SELECT md5, min(image_id) AS a FROM master_manifest WHERE usable AND md5 IS NOT NULL AND image_id IS NOT NULL GROUP BY md5 HAVING min(image_id) <> max(image_id)),
me AS (SELECT DISTINCT m.a, x.image_id AS b FROM master_manifest x JOIN m USING (md5) WHERE x.usable AND x.image_id <> m.a)"""


@query(f"WITH {_MD5_EDGES} SELECT a, b FROM me")
def md5_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Usable images of one md5, linked with the smallest of them."""
    return dedup.md5_edges(_read(spark, sf, "master_manifest"))


def _closure(edges: str) -> str:
    return f"""ed AS (SELECT a, b FROM ({edges}) WHERE a <> b), bw AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
reach AS (SELECT a AS id, a AS other FROM bw UNION SELECT r.id, w.b FROM reach r JOIN bw w ON w.a = r.other),
comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""


@query(f"WITH RECURSIVE {_closure('SELECT id_a AS a, id_b AS b FROM phash_pairs WHERE hamming <= 10')} SELECT id, component FROM comp")
def pair_components(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components of the pairs, ids as they are spelled."""
    return components(dedup.pair_edges(_read(spark, sf, "phash_pairs"), dedup.GROUP_DISTANCE), Scratch(spark, "components"))


@query(
    f"WITH RECURSIVE {_closure('SELECT id_a AS a, id_b AS b FROM phash_pairs WHERE hamming <= 10')} SELECT DISTINCT m.image_id, coalesce(component, m.image_id) AS group_id FROM master_manifest m LEFT JOIN comp ON comp.id = m.image_id"
)
def dedup_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The group of every image of the manifest."""
    return dedup.group_ids(_read(spark, sf, "master_manifest"), _read(spark, sf, "phash_pairs"), Scratch(spark, "groups"))


_EXACT = f"{_MD5_EDGES}, {_closure('SELECT a, b FROM me UNION ALL SELECT id_a, id_b FROM phash_pairs WHERE hamming <= 5')}"
_KEEP = """, o AS (SELECT id, component, first_value(id) OVER (PARTITION BY component ORDER BY CASE split_part(id, '/', 1) WHEN 'oxford' THEN 0 WHEN 'stanford' THEN 1 WHEN 'tsinghua' THEN 2 ELSE 9 END, id) AS keep FROM comp)"""


def _exact(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.exact_groups(_read(spark, sf, "master_manifest"), _read(spark, sf, "phash_pairs"), Scratch(spark, "exact"))


@query(f"WITH RECURSIVE {_EXACT} SELECT id AS image_id, component FROM comp")
def exact_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of exact duplicates by md5 or distance."""
    return _exact(spark, sf)


@query(f"WITH RECURSIVE {_EXACT}{_KEEP} SELECT id AS image_id, keep AS dup_keep_id FROM o WHERE id <> keep")
def keep_one(spark: SparkSession, sf: str) -> DataFrame:
    """The keeper of each dropped image."""
    return dedup.keepers(_exact(spark, sf))


@query(
    f"""WITH RECURSIVE {_EXACT}{_KEEP} SELECT m.rec_id, m.usable AND d.keep IS NULL AS usable, CASE WHEN d.keep IS NOT NULL AND m.usable THEN 'exact_duplicate' ELSE exclusion_reason END AS exclusion_reason, d.keep AS dup_keep_id
FROM master_manifest m LEFT JOIN (SELECT id, keep FROM o WHERE id <> keep) d ON d.id = m.image_id"""
)
def dedup_status(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest's status columns once duplicates are dropped."""
    out = quality.mark_dropped(_read(spark, sf, "master_manifest"), dedup.keepers(_exact(spark, sf)))
    return out.select("rec_id", "usable", "exclusion_reason", "dup_keep_id")


@query(f"WITH RECURSIVE {_EXACT}{_KEEP} SELECT split_part(id, '/', 1) AS source, count(*) AS n FROM o WHERE id <> keep GROUP BY 1")
def dropped_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Dropped images by corpus."""
    return dedup.keepers(_exact(spark, sf)).groupBy(names.source_of(F.col("image_id")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH RECURSIVE {_EXACT}{_KEEP}, f AS (SELECT id, string_split(id, '/') AS p FROM o WHERE id <> keep),
n AS (SELECT id, p[1] AS src, p[-1] AS file, regexp_replace(p[-1], '^(.+)\\.[^.]*$', '\\1') AS st, len(p) AS k, p[2] AS second FROM f),
d AS (SELECT *, CASE WHEN k = 3 THEN second ELSE coalesce(nullif(regexp_extract(file, '^(.*)_[^_]*$', 1), ''), file) END AS folder FROM n)
SELECT id AS image_id, src || '/images/' || folder || '/' || file AS rel_path FROM d UNION ALL SELECT id, src || '/labels/' || folder || '/' || st || '.txt' FROM d"""
)
def removal_list(spark: SparkSession, sf: str) -> DataFrame:
    """Files of dropped images in the labelled tree."""
    return exports.removals(dedup.keepers(_exact(spark, sf)))


# ---------------------------------------------------------------- splits

_GROUPS = """e AS (SELECT dedup_group, canonical_breed, count(*) AS n FROM master_manifest WHERE in_mvp25 AND dedup_group IS NOT NULL GROUP BY ALL),
gt AS (SELECT dedup_group, first(canonical_breed ORDER BY n DESC, canonical_breed) AS breed, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY dedup_group)"""


@query(f"WITH {_GROUPS} SELECT dedup_group, breed, n FROM gt")
def group_breed_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and most frequent breed of each group."""
    return split.group_table(_read(spark, sf, "master_manifest"))


@query()
def group_split(spark: SparkSession, sf: str) -> DataFrame:
    """The split of each group: an order-dependent fold, checked against a sequential version in the tests."""
    return split.group_split(split.group_table(_read(spark, sf, "master_manifest")))


@query()
def half_split(spark: SparkSession, sf: str) -> DataFrame:
    """Cats, half val, half test, drawn by hash."""
    return split.half_split(_read(spark, sf, "master_manifest"))


@query(
    f"""WITH RECURSIVE {_GROUPS},
o AS (SELECT breed, n, row_number() OVER (PARTITION BY breed ORDER BY n DESC, dedup_group) AS k, CAST(sum(n) OVER (PARTITION BY breed) AS BIGINT) AS total FROM gt),
f AS (
  SELECT DISTINCT breed, 0::BIGINT AS k, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, 0::BIGINT AS n, '' AS split FROM gt
  UNION ALL
  SELECT breed, k, a + CASE split WHEN 'train' THEN n ELSE 0 END, b + CASE split WHEN 'val' THEN n ELSE 0 END, c + CASE split WHEN 'test' THEN n ELSE 0 END, n, split
  FROM (SELECT o.breed, o.k, f.a, f.b, f.c, o.n, CASE WHEN 14 * total - 20 * a >= 3 * total - 20 * b AND 14 * total - 20 * a >= 3 * total - 20 * c THEN 'train' WHEN b <= c THEN 'val' ELSE 'test' END AS split
        FROM f JOIN o ON o.breed IS NOT DISTINCT FROM f.breed AND o.k = f.k + 1))
SELECT breed, n, split, count(*) AS groups FROM f WHERE k > 0 GROUP BY ALL"""
)
def group_split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """How many groups of each breed and size went to each split, which the fold fixes; which ones is drawn."""
    groups = split.group_table(_read(spark, sf, "master_manifest"))
    return groups.join(split.group_split(groups), "dedup_group").groupBy("breed", "n", "split").agg(F.count(F.lit(1)).alias("groups"))


@query(
    """WITH c AS (SELECT count(DISTINCT image_id) AS n FROM master_manifest WHERE canonical_breed = '__CAT_OOD__')
SELECT * FROM (SELECT 'val' AS split, n // 2 AS images FROM c UNION ALL SELECT 'test', n - n // 2 FROM c) WHERE images > 0"""
)
def half_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Cats of either half."""
    return split.half_split(_read(spark, sf, "master_manifest")).groupBy("split").agg(F.count(F.lit(1)).alias("images"))


# ---------------------------------------------------------------- files (a few, written to the shared folder and read back)


def _tree(spark: SparkSession) -> str:
    """A folder of three tiny corpora, a class folder and an annotation document."""
    scratch = Scratch(spark, "files")
    box = lambda kind, *corners: f"<object><{kind}>" + "".join(f"<{n}>{v}</{n}>" for n, v in zip(("xmin", "ymin", "xmax", "ymax"), corners)) + f"</{kind}></object>"
    note = lambda *boxes: f"<annotation>{''.join(boxes)}</annotation>".encode()
    image = lambda w, h: sinks.png(np.zeros((h, w, 3), np.uint8))
    coco = {
        "images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 20}, {"id": 2, "file_name": "b.jpg", "width": 10, "height": 10}],
        "annotations": [{"image_id": 1, "bbox": [5, 10, 5, 10]}, {"image_id": 2, "bbox": [0, 0, 5, 5], "IsGroupOf": 1}, {"image_id": 1, "bbox": [0, 0, 5, 10], "IsDepiction": 0}],
    }
    files = {
        "raw/stanford/Images/n1-Great-Dane/a.jpg": image(40, 30), "raw/stanford/Annotation/n1-Great-Dane/a": note(box("bndbox", 4, 3, 20, 21), box("bndbox", 0, 0, 5, 5)),
        "raw/stanford/Images/n1-Great-Dane/b.jpg": image(40, 30), "raw/stanford/Annotation/n1-Great-Dane/b": note(box("bndbox", 9, 2, 5, 20)),
        "raw/stanford/Images/n1-Great-Dane/c.jpg": b"broken", "raw/stanford/Images/n1-Great-Dane/d.jpg": image(40, 30)[:-30], "raw/stanford/Images/n1-Great-Dane/e.jpg": image(40, 31),
        "raw/oxford/images/Bengal_cat_1.jpg": image(10, 10), "raw/oxford/images/shiba_inu_2.jpg": image(10, 12), "raw/oxford/annotations/xmls/shiba_inu_2.xml": note(box("bndbox", 1, 2, 5, 8)),
        "raw/tsinghua/Low-Annotations/none.txt": b"", "raw/tsinghua/low-resolution/9-n1-shiba-inu/x.jpg": image(100, 100),
        "raw/tsinghua/annotations/Low-Annotations/9-n1-shiba-inu/x.jpg.xml": note(box("bodybndbox", 0, 0, 50, 50), box("headbndbox", 10, 10, 20, 30)),
        "split/pug/1.PNG": b"x", "split/pug/split/2.png": b"x", "split/beagle/3.webp": b"x", "split/beagle/4.txt": b"x", "pictures/red.png": sinks.png(np.full((14, 28, 3), (250, 10, 20), np.uint8)), "pictures/bad.png": b"x", "labels.json": json.dumps(coco).encode(),
    }
    for name, data in files.items():
        sinks.put_file(spark, f"{scratch.root}/{name}", data)
    return scratch.root


_SCANNED = """('stanford/n1-Great-Dane/a.jpg', 'stanford', 'Great-Dane', 40, 30, '4.0 3.0 20.0 21.0', NULL, 2, NULL), ('stanford/n1-Great-Dane/b.jpg', 'stanford', 'Great-Dane', 40, 30, '9.0 2.0 5.0 20.0', NULL, 1, 'invalid_bbox_order'),
  ('stanford/n1-Great-Dane/c.jpg', 'stanford', 'Great-Dane', 0, 0, NULL, NULL, 0, 'corrupt_image:UnidentifiedImageError'), ('stanford/n1-Great-Dane/d.jpg', 'stanford', 'Great-Dane', 0, 0, NULL, NULL, 0, 'corrupt_image:OSError'),
  ('stanford/n1-Great-Dane/e.jpg', 'stanford', 'Great-Dane', 40, 31, NULL, NULL, 0, 'missing_annotation'), ('oxford/Bengal_cat_1.jpg', 'oxford', 'CAT_Bengal_cat', 10, 10, NULL, NULL, 0, 'cat_ood_only'),
  ('oxford/shiba_inu_2.jpg', 'oxford', 'shiba_inu', 10, 12, NULL, '1.0 2.0 5.0 8.0', 1, NULL), ('tsinghua/9-n1-shiba-inu/x.jpg', 'tsinghua', 'shiba-inu', 100, 100, '0.0 0.0 50.0 50.0', '10.0 10.0 20.0 30.0', 1, NULL)"""


@query(f"SELECT *, reason IS NULL AS usable, true AS hashed FROM (VALUES {_SCANNED}) AS t(image_id, source, breed, width, height, body, head, n_dogs, reason)")
def scanned_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest of three small corpora on disk."""
    rows = files.scan_all(spark, f"{_tree(spark)}/raw")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return rows.select(
        "image_id", "source", F.col("original_breed").alias("breed"), "width", "height", text("body_bbox").alias("body"), text("head_bbox").alias("head"), "n_dogs",
        F.col("exclusion_reason").alias("reason"), "usable", F.col("md5").rlike("^[0-9a-f]{32}$").alias("hashed"),
    )


@query("SELECT * FROM (VALUES ('pug', '1.PNG'), ('beagle', '3.webp')) AS t(label, name)")
def class_folder_files(spark: SparkSession, sf: str) -> DataFrame:
    """Images right below a class folder."""
    found = files.class_folders(spark, f"{_tree(spark)}/split")
    return found.select("label", names.file_name(F.col("path")).alias("name"))


_LABEL_FILES = """('stanford/labels/n1-Great-Dane/a.txt', 'stanford/images/n1-Great-Dane/a.jpg', '0 0.300000 0.400000 0.400000 0.600000'),
  ('tsinghua/labels/9-n1-shiba-inu/x.txt', 'tsinghua/images/9-n1-shiba-inu/x.jpg', '0 0.250000 0.250000 0.500000 0.500000' || chr(10) || '1 0.150000 0.200000 0.100000 0.200000'),
  ('oxford/labels/shiba_inu/shiba_inu_2.txt', 'oxford/images/shiba_inu/shiba_inu_2.jpg', '0 0.500000 0.500000 1.000000 1.000000' || chr(10) || '1 0.300000 0.416667 0.400000 0.500000'),
  ('coco/validation/labels/a.txt', 'coco/validation/images/a.jpg', '0 0.750000 0.750000 0.500000 0.500000' || chr(10) || '0 0.250000 0.250000 0.500000 0.500000')"""


@query(f"SELECT * FROM (VALUES {_LABEL_FILES}) AS t(rel_path, target, text)")
def label_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Label files from manifest boxes, pseudo boxes and annotations of those corpora."""
    root = _tree(spark)
    manifest = files.scan_all(spark, f"{root}/raw")
    pseudo = spark.createDataFrame([("oxford/shiba_inu_2.jpg", [-1.0, 0.0, 10.0, 12.5], False)], "image_id string, pseudo_body_bbox array<double>, needs_review boolean")
    trees = [exports.label_files(manifest), exports.pseudo_label_files(manifest, pseudo), exports.annotation_label_files(*files.coco(spark, f"{root}/labels.json"), "coco/validation")]
    columns = ["rel_path", "target", "text"]
    return trees[0].select(columns).unionByName(trees[1].select(columns)).unionByName(trees[2].select(columns))


@query("SELECT 'red.png' AS name, 28 AS width, 14 AS height, '250 10 20' AS first UNION ALL SELECT 'bad.png', NULL, NULL, NULL")
def decoded_files(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures decoded, with their first pixel."""
    first = F.concat_ws(" ", *[F.conv(F.hex(F.substring("rgb", i, 1)), 16, 10) for i in (1, 2, 3)])
    rows = files.pixels(spark, f"{_tree(spark)}/pictures")
    return rows.select(names.file_name(F.col("path")).alias("name"), "width", "height", F.when(F.col("rgb").isNotNull(), first).alias("first"))


@query("SELECT 'red.png' AS name, 16 AS class_id, 0.366013e0 AS conf, [7e0, 3.5e0, 21e0, 10.5e0] AS bbox")
def detected_files(spark: SparkSession, sf: str) -> DataFrame:
    """What the stand-in detector finds in the pictures."""
    found = detections.wanted(inference.detect(files.pixels(spark, f"{_tree(spark)}/pictures"), inference.HashDetector))
    return found.select(names.file_name(F.col("path")).alias("name"), "class_id", "conf", "bbox")


@query("SELECT 'red.png' AS name, 0.366013e0 AS conf, 192 AS numbers, 1e0 AS length UNION ALL SELECT 'bad.png', NULL, NULL, NULL")
def embedded_files(spark: SparkSession, sf: str) -> DataFrame:
    """The vector of the best crop of each picture, by the stand-in models: its numbers and length."""
    rows = inference.embed_best(files.pixels(spark, f"{_tree(spark)}/pictures"), inference.HashDetector, inference.MeanEncoder, size=28)
    known = F.col("embedding").isNotNull()
    return rows.select(
        names.file_name(F.col("path")).alias("name"), "conf", F.when(known, F.size("embedding")).alias("numbers"), F.round(vec.length(vec.doubles("embedding")), 4).alias("length")
    )


# ---------------------------------------------------------------- detections and annotations (events)


def _detections(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return _read(spark, sf, "events").select(
        F.col("user_id").alias("image_id"),
        F.when(F.col("event_type") == "click", detections.DOG_CLASS).otherwise(F.length("event_type")).alias("class_id"),
        F.col("event_id").alias("idx"),
        (v / 500).alias("conf"),
        F.array(v, v / 2, v + 10.25, v / 2 + 7.75).alias("bbox"),
    )


_EVENTS = "d AS (SELECT user_id AS image_id, CASE WHEN event_type = 'click' THEN 16 ELSE length(event_type) END AS class_id, event_id AS idx, value / 500 AS conf, [value, value / 2, value + 10.25e0, value / 2 + 7.75e0] AS bbox FROM events)"


@query(f"WITH {_EVENTS} SELECT image_id, idx, conf FROM d WHERE class_id = 16 AND conf >= 0.25e0")
def detection_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Detections of the class looked for."""
    return detections.wanted(_detections(spark, sf)).select("image_id", "idx", "conf")


@query(f"WITH {_EVENTS} SELECT image_id, list(idx ORDER BY conf DESC, idx) AS idx FROM d WHERE class_id = 16 AND conf >= 0.25e0 GROUP BY image_id")
def detections_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """Detections of an image, most confident first."""
    return detections.by_confidence(detections.wanted(_detections(spark, sf))).select("image_id", F.col("detections.idx").alias("idx"))


@query(f"WITH {_EVENTS} SELECT image_id, max(conf) AS conf, first(bbox ORDER BY conf DESC, idx) AS bbox, count(*) AS n_det FROM d WHERE class_id = 16 AND conf >= 0.25e0 GROUP BY image_id")
def detection_best(spark: SparkSession, sf: str) -> DataFrame:
    """The best detection of an image."""
    return detections.best(detections.wanted(_detections(spark, sf)))


_PSEUDO = f"""{_EVENTS}, f AS (SELECT image_id, max(conf) AS conf, first(bbox ORDER BY conf DESC, idx) AS bbox, CAST(count(*) AS INTEGER) AS n_det FROM d WHERE class_id = 16 AND conf >= 0.1e0 GROUP BY image_id),
ps AS (SELECT i.image_id, list_transform(bbox, lambda x: round_even(x, 1)) AS pseudo_body_bbox, coalesce(conf, 0.0e0) AS conf, coalesce(n_det, 0) AS n_det, coalesce(conf, 0.0e0) < 0.5e0 AS needs_review
       FROM (SELECT DISTINCT image_id FROM d) i LEFT JOIN f USING (image_id))"""


def _pseudo(spark: SparkSession, sf: str) -> DataFrame:
    found = _detections(spark, sf)
    return detections.pseudo_boxes(found.select("image_id"), found)


@query(f"WITH {_PSEUDO} SELECT image_id, conf, n_det, needs_review, pseudo_body_bbox FROM ps")
def pseudo_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Pseudo boxes of every image and whether they need review."""
    return _pseudo(spark, sf).select("image_id", "conf", "n_det", "needs_review", "pseudo_body_bbox")


@query(
    f"""WITH {_PSEUDO} SELECT count(*) AS total, count(*) FILTER (WHERE n_det > 0) AS detected, count(*) FILTER (WHERE n_det = 0) AS no_detection, count(*) FILTER (WHERE needs_review) AS needs_review,
  count(*) FILTER (WHERE n_det > 1) AS multi, round(avg(conf), 3) AS mean_conf FROM ps"""
)
def pseudo_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts over the pseudo boxes."""
    return detections.pseudo_summary(_pseudo(spark, sf))


@query(f"WITH {_PSEUDO} SELECT image_id, conf, count(*) AS events FROM ps JOIN (SELECT user_id AS image_id FROM events) USING (image_id) WHERE NOT needs_review AND pseudo_body_bbox IS NOT NULL GROUP BY ALL")
def pseudo_join(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted pseudo boxes with their image's events; an unknown image would be an error."""
    images = _read(spark, sf, "events").groupBy(F.col("user_id").alias("image_id")).agg(F.count(F.lit(1)).alias("events"))
    return detections.strict_join(detections.accepted(_pseudo(spark, sf)).select("image_id", "conf"), images, "image_id")


@query(
    """WITH a AS (SELECT user_id AS image_id, value, event_type = 'error' AS is_group, CAST(json_extract_string(props, '$.k') AS INTEGER) > 90 AS is_depiction FROM events)
SELECT image_id, count(*) AS boxes, max(value) AS largest FROM a WHERE NOT is_group AND NOT is_depiction GROUP BY image_id"""
)
def coco_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations that are neither group nor depiction, by image; an image without any disappears."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = _read(spark, sf, "events").select(F.col("user_id").alias("image_id"), "value", (F.col("event_type") == "error").alias("IsGroupOf"), F.when(k > 90, "true").alias("IsDepiction"))
    return detections.plain_annotations(rows).groupBy("image_id").agg(F.count(F.lit(1)).alias("boxes"), F.max("value").alias("largest"))


@query("SELECT DISTINCT m.image_id FROM master_manifest m WHERE EXISTS (SELECT 1 FROM image_vectors v WHERE v.image_id = m.image_id)")
def images_with_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Images of the manifest that have a vector."""
    return _read(spark, sf, "master_manifest").select("image_id").join(_read(spark, sf, "image_vectors").select("image_id"), "image_id", "left_semi").distinct()


@query("SELECT DISTINCT p.image_id FROM phash p WHERE NOT EXISTS (SELECT 1 FROM master_manifest m WHERE m.image_id = p.image_id) AND p.image_id IS NOT NULL")
def hashes_without_image(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed images that the manifest doesn't know."""
    rows = _read(spark, sf, "phash").select("image_id").filter("image_id IS NOT NULL").distinct()
    return rows.join(_read(spark, sf, "master_manifest").select("image_id"), "image_id", "left_anti")
