"""The library's records shaped from a folder of order, event and vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripweave.functions.keys import dense_ids
from tripweave.functions.time import add_time_features
from tripweave.operators.graph import Graph
from tripweave.sources.shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_nationkey, n_name, r_name)."""
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of an order as a trip from the supplier's nation to the customer's, with all columns of trip records."""
    nation = nations(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = lines.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    lines = lines.join(nation.toDF("s_nationkey", "ORIGIN", "o_region"), "s_nationkey").join(nation.toDF("c_nationkey", "DEST", "d_region"), "c_nationkey")
    cancelled = F.col("l_returnflag") == "R"
    flown = lambda c: F.when(~cancelled, c)
    depart = (F.col("l_partkey") % 24) * 60 + F.col("l_orderkey") % 60
    arrive = (depart + F.col("l_quantity").cast("long") * 5) % 1440
    hhmm = lambda m: (F.floor(m / 60) * 100 + m % 60).cast("double")
    return lines.select(
        F.year("l_shipdate").alias("YEAR"), F.month("l_shipdate").alias("MONTH"), F.to_date("l_shipdate").alias("FL_DATE"), F.col("o_orderpriority").alias("OP_UNIQUE_CARRIER"), F.col("l_suppkey").cast("string").alias("TAIL_NUM"),
        F.col("l_orderkey").cast("int").alias("OP_CARRIER_FL_NUM"), F.col("s_nationkey").cast("int").alias("ORIGIN_AIRPORT_ID"), "ORIGIN", F.concat(F.lit("City of "), "ORIGIN").alias("ORIGIN_CITY_NAME"), F.col("o_region").alias("ORIGIN_STATE_NM"),
        "DEST", F.concat(F.lit("City of "), "DEST").alias("DEST_CITY_NAME"), F.col("d_region").alias("DEST_STATE_NM"), flown(hhmm(depart)).alias("DEP_TIME"), flown(F.col("l_quantity") - 25).alias("DEP_DELAY"),
        flown(hhmm(arrive)).alias("ARR_TIME"), flown(F.col("l_quantity") - 29 + F.col("l_linenumber")).alias("ARR_DELAY"), cancelled.cast("double").alias("CANCELLED"), flown(F.col("l_quantity") * 5).alias("AIR_TIME"), F.lit(1.0).alias("FLIGHTS"), F.col("l_extendedprice").alias("DISTANCE"),
    )


def timed_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_time_features(trips(spark, sf_dir))


def legs(spark: SparkSession, sf_dir: str, without: tuple[str, ...] = ()) -> DataFrame:
    """Each event as a flight: the user is the aircraft, the kinds of this and the user's next event are the airports. Columns that aren't needed can be left out."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("*", F.lead("event_type").over(by).alias("dest"))
    minutes = F.col("value").cast("long").cast("int")
    made = rows.select(
        F.col("event_id"), F.col("user_id").cast("string").alias("tail"), F.col("event_type").alias("origin"), "dest", F.concat(F.lit("C"), F.col("user_id") % 7).alias("carrier"),
        F.col("ts").cast("timestamp_ntz").alias("dep_ts"), (F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0))).alias("arr_ts"), (F.col("value") - 100).alias("arr_delay"), F.lit(0.0).alias("cancelled"),
    )
    return dense_ids(made.drop(*without), F.to_date("dep_ts"), "dep_ts", "event_id", name="flight_id")


def route_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers, linked when a customer's lines went from one to the next; the weight counts how often."""
    return Graph(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), steps(spark, sf_dir, "l_suppkey").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")))


def steps(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """(src, dst, month) of each step from one line of a customer to the next, between different suppliers or parts (the lines' key)."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    # An order's lines are ranked where they already lie together, so that the columns that only break ties aren't shuffled again.
    lines = lines.withColumn("_at", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))).select("o_custkey", "l_shipdate", "l_orderkey", "_at", key)
    by = Window.partitionBy("o_custkey").orderBy("l_shipdate", "l_orderkey", "_at")
    found = lines.select(F.col(key).alias("src"), F.lead(key).over(by).alias("dst"), F.month("l_shipdate").alias("month"))
    return found.filter("dst is not null and src <> dst")


def part_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps between parts as trips with MONTH, ORIGIN and DEST: many vertices for their edges, so that later months have new routes."""
    name = lambda c: F.lpad(F.col(c).cast("string"), 9, "0")
    return steps(spark, sf_dir, "l_partkey").select(F.col("month").alias("MONTH"), name("src").alias("ORIGIN"), name("dst").alias("DEST"))


def nation_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations with the number of trips between them; the first region is a community, and the others' nations are dealt over three."""
    edges = trips(spark, sf_dir).join(table(spark, sf_dir, "nation").select(F.col("n_name").alias("DEST"), F.col("n_nationkey").cast("long").alias("dst")), "DEST")
    return Graph(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("code"), F.when(F.col("n_regionkey") == 0, 0).otherwise(F.col("n_nationkey") % 3 + 1).cast("long").alias("community")), edges.groupBy(F.col("ORIGIN_AIRPORT_ID").cast("long").alias("src"), "dst").agg(F.sum("FLIGHTS").alias("weight")))


def kept(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)
