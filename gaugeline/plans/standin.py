"""The driver's tables in the roles of captures, measurements, severities and labels, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions import vocab

#: Concerns, signed directions, and how a region's measurements are combined.
DIRECTIONS = {"quantity": 1.0, "price": 1.0, "discount": -1.0}
METHODS = {"redness": "max", "texture": "median", "wrinkles": "max"}
CONCERNS = tuple(METHODS)
#: Floors at which one region is strong by itself; texture has none.
FLOORS = {"redness": {"quantity": 45.0, "price": 60000.0}, "texture": {}, "wrinkles": {"price": 80000.0}}
SALT = "cohort-1"
SLICES = ("segment", "nation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation")))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("segment"), "c_nationkey")
    return c.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("subject_id", "segment", "nation")


def captures(spark: SparkSession, sf_dir: str, slices: bool = False) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image"), F.col("o_custkey").alias("subject_id"), F.year("o_orderdate").cast("string").alias("session_id"), (F.col("o_orderstatus") != "P").alias("qc_passed"), F.col("o_orderpriority").alias("failure")
    )
    return o.join(subjects(spark, sf_dir), "subject_id") if slices else o


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each capture, concern and region, measurements as columns."""
    li = table(spark, sf_dir, "lineitem")
    concern = F.when(F.col("l_returnflag") == "A", "redness").when(F.col("l_returnflag") == "N", "texture").otherwise("wrinkles")
    roi = F.concat(F.lit("roi_"), F.col("l_linenumber").cast("string"))
    g = li.groupBy(F.col("l_orderkey").alias("image"), concern.alias("concern"), roi.alias("roi"))
    return g.agg(F.avg("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"))


def facts(spark: SparkSession, sf_dir: str, subject: bool = True) -> DataFrame:
    """(image, concern, roi, measurement, value) and the subject."""
    r = regions(spark, sf_dir)
    if subject:
        r = r.join(captures(spark, sf_dir).select("image", "subject_id"), "image")
    cols = ["image", "concern", "roi"] + ["subject_id"] * subject
    pairs = F.array(*[F.struct(F.lit(m).alias("measurement"), F.col(m).alias("value")) for m in DIRECTIONS])
    return r.select(*cols, F.explode(pairs).alias("m")).select(*cols, "m.measurement", "m.value")


def severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, concern, severity) of each capture's mean quantity; too small a discount is unmeasurable."""
    g = regions(spark, sf_dir).groupBy("image", "concern").agg(F.round(F.avg("quantity"), 6).alias("q"), F.round(F.avg("discount"), 6).alias("d"))
    return g.select("image", "concern", F.when(F.col("d") < 0.01, "unmeasurable").when(F.col("q") < 13, "not_detected").when(F.col("q") < 25, "mild").when(F.col("q") < 38, "moderate").otherwise("high").alias("severity"))


def directions(spark: SparkSession) -> DataFrame:
    return vocab.small_table(spark, "concern string,measurement string,direction double", [(c, m, d) for c in CONCERNS for m, d in DIRECTIONS.items()])


SUBJECTS_SQL = "subjects AS (SELECT c_custkey AS subject_id, c_mktsegment AS segment, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey)"
CAPTURES_SQL = "captures AS (SELECT o_orderkey AS image, o_custkey AS subject_id, year(o_orderdate)::VARCHAR AS session_id, o_orderstatus <> 'P' AS qc_passed, o_orderpriority AS failure FROM orders)"
REGIONS_SQL = """regions AS (
  SELECT l_orderkey AS image, CASE l_returnflag WHEN 'A' THEN 'redness' WHEN 'N' THEN 'texture' ELSE 'wrinkles' END AS concern, 'roi_' || l_linenumber AS roi,
    avg(l_quantity) AS quantity, avg(l_extendedprice) AS price, avg(l_discount) AS discount FROM lineitem GROUP BY 1, 2, 3)"""
FACTS_SQL = f"""{CAPTURES_SQL}, {REGIONS_SQL},
facts AS (SELECT r.image, c.subject_id, r.concern, r.roi, m.measurement, CASE m.measurement WHEN 'quantity' THEN quantity WHEN 'price' THEN price ELSE discount END AS value
  FROM regions r JOIN captures c USING (image), (VALUES ('quantity'), ('price'), ('discount')) m(measurement))"""
SEVERITIES_SQL = f"""{CAPTURES_SQL}, {REGIONS_SQL},
severities AS (SELECT image, concern, CASE WHEN d < 0.01 THEN 'unmeasurable' WHEN q < 13 THEN 'not_detected' WHEN q < 25 THEN 'mild' WHEN q < 38 THEN 'moderate' ELSE 'high' END AS severity
  FROM (SELECT image, concern, round(avg(quantity), 6) AS q, round(avg(discount), 6) AS d FROM regions GROUP BY 1, 2))"""
MEANS_SQL = f"{FACTS_SQL}, means AS (SELECT subject_id, concern, roi, measurement, avg(value) AS value, count(value) AS n FROM facts GROUP BY ALL)"
SPLIT_SQL = f"CASE WHEN ('0x' || substr(sha256('{SALT}:' || subject_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0::DOUBLE < {vocab.HOLDOUT}::DOUBLE THEN 'holdout' ELSE 'train' END"
REFERENCE_SQL = f"""{MEANS_SQL},
train AS (SELECT * FROM means WHERE {SPLIT_SQL} = 'train'),
reference AS (SELECT concern, roi, measurement, median(value) AS median, mad(value) AS mad FROM train GROUP BY ALL),
ref_n AS (SELECT concern, count(DISTINCT subject_id) AS n_subjects FROM train GROUP BY 1)"""
Z_SQL = f"""{REFERENCE_SQL},
zref AS (SELECT m.*, (m.value - r.median) / ({vocab.MAD_SCALE}::DOUBLE * r.mad + {vocab.EPS}::DOUBLE) AS z_ref FROM means m LEFT JOIN reference r USING (concern, roi, measurement))"""
ROI_SQL = f"""{Z_SQL},
roiz AS (
  SELECT subject_id, concern, roi, CASE WHEN concern = 'texture' THEN median(s) ELSE max(s) END AS z, max(CASE measurement WHEN 'quantity' THEN value END) AS quantity, max(CASE measurement WHEN 'price' THEN value END) AS price
  FROM (SELECT *, z_ref * CASE measurement WHEN 'discount' THEN -1 ELSE 1 END AS s FROM zref) GROUP BY subject_id, concern, roi),
bands AS (
  SELECT *, CASE WHEN z IS NULL THEN NULL WHEN z < 0.5 THEN 'not_detected' WHEN z < 1.5 THEN 'mild' WHEN z < 2.5 THEN 'moderate' ELSE 'high' END AS severity,
    CASE WHEN z IS NULL THEN -1 WHEN z < 0.5 THEN 0 WHEN z < 1.5 THEN 1 WHEN z < 2.5 THEN 2 ELSE 3 END AS rank,
    CASE concern WHEN 'redness' THEN quantity >= 45 AND price >= 60000 WHEN 'wrinkles' THEN price >= 80000 ELSE false END AS strong
  FROM roiz)"""
