"""Networks derived from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcweave.network import Network
from arcweave.operators.nodal import OfEnds
from arcweave.plans.scratch import with_row_numbers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a day up to which it is one range; a larger day is cut into as many equal stretches of time as it needs.
RANGE_ROWS = 1_000_000


def time_ranges(rows: DataFrame, most: int = RANGE_ROWS) -> DataFrame:
    """Adds `cut`, which grows with ts: its day and, in days of more than `most` rows, a stretch of that day."""
    rows = rows.withColumn("day", F.to_date("ts"))
    sizes = rows.groupBy("day").agg(F.ceil(F.count("*") / most).alias("stretches"))
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    stretch = F.floor(second * F.col("stretches") / 86_400).alias("stretch")
    return rows.join(sizes, "day").withColumn("cut", F.struct("day", stretch)).drop("day", "stretches")


def successors(events: DataFrame, event_type: str) -> DataFrame:
    """(i, j, n): how often user j's event of the type comes next after user i's, in time order.

    The order is cut by ranges of time, of any day too large for one: a window sorts each range, and one row for each
    range carries the last user over."""
    own = events.filter(F.col("event_type") == event_type).select("user_id", F.struct("ts", "event_id").alias("at"), "ts")
    own = time_ranges(own)
    ranges = own.groupBy("cut").agg(F.max(F.struct("at", "user_id")).alias("last"))
    carry = ranges.select("cut", F.lag("last.user_id").over(Window.orderBy("cut")).alias("carried"))  # as many rows as ranges
    prev = F.lag("user_id").over(Window.partitionBy("cut").orderBy("at"))
    rows = own.withColumn("prev", prev).join(carry, "cut").select(F.coalesce("prev", "carried").alias("i"), F.col("user_id").alias("j"))
    return rows.filter("i is not null and i <> j").groupBy("i", "j").agg(F.count("*").alias("n"))


def users(events: DataFrame) -> DataFrame:
    """(v, kind, n_events, mean_value): each user with the most frequent event type (ties by name)."""
    each = events.filter("user_id is not null").groupBy("user_id", "event_type").agg(F.count("*").alias("c"), F.sum("value").alias("x"), F.count("value").alias("m"))
    # the greatest (count, then the least name) is found without a window
    best = F.min_by("event_type", F.struct((-F.col("c")).alias("c"), F.col("event_type").alias("t")))
    return each.groupBy(F.col("user_id").alias("v")).agg(best.alias("kind"), F.sum("c").alias("n_events"), (F.sum("x") / F.sum("m")).alias("mean_value"))


def user_network(spark: SparkSession, sf_dir: str, directed: bool = True) -> Network:
    """G1: users, joined where one's purchase follows the other's."""
    events = table(spark, sf_dir, "events")
    return Network(users(events), successors(events, "purchase"), directed)


#: Bits of a mask; users' types beyond that take another mask. Masks that are columns at most; more are a map.
MASK, COLUMNS = 63, 8


def shared_types(spark: SparkSession, sf_dir: str) -> OfEnds:
    """A covariate of vertex pairs: the number of event types that both users have. It is taken from bitmasks for each
    user, for the pairs asked for alone. A type's bit is its place among the sorted types, 63 to a mask. A few masks are
    columns; else the masks that a user needs are a map, so there may be any number of types."""
    events = table(spark, sf_dir, "events").filter("event_type is not null").select("user_id", "event_type").distinct()
    places = with_row_numbers(events.select("event_type").distinct(), ["event_type"])
    bits = events.join(places, "event_type").groupBy("user_id", F.floor(F.col("row") / MASK).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(row % {MASK} as int))")).alias("mask"))
    user, count = F.col("user_id").cast("long").alias("v"), lambda x, z: F.coalesce(F.bit_count(x.bitwiseAND(z)), F.lit(0))
    words = range(-(-places.count() // MASK))
    if len(words) <= COLUMNS:
        masks = bits.groupBy(user).agg(*[F.max(F.when(F.col("word") == k, F.col("mask"))).alias(f"mask{k}") for k in (words or [0])])
        return OfEnds(masks, sum((count(F.col(f"mask{k}_i"), F.col(f"mask{k}_j")) for k in words), F.lit(0)))
    masks = bits.groupBy(user).agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("masks"))
    return OfEnds(masks, F.aggregate(F.map_entries("masks_i"), F.lit(0), lambda n, m: n + count(m["value"], F.try_element_at("masks_j", m["key"]))))


def nation_network(spark: SparkSession, sf_dir: str, top: int = 5) -> Network:
    """G2: each customer nation and the `top` supplier nations it buys most from, by quantity."""
    t = lambda name: table(spark, sf_dir, name)
    buys = (
        t("lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
        .join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .groupBy("o_custkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
        .join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("i")), "o_custkey")
        .join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("j")), "l_suppkey")
        .filter("i <> j").groupBy("i", "j").agg(F.sum("q").alias("q"))
    )
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("q"), "j"))
    vertices = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("v"), F.col("r_name").alias("region"))
    return Network(vertices, buys.withColumn("k", rank).filter(F.col("k") <= top).select("i", "j", "q"), True)


def part_network(spark: SparkSession, sf_dir: str) -> Network:
    """G3: parts that an urgent order holds together; undirected."""
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(orders, "l_orderkey").distinct()
    pairs = lines.withColumnRenamed("l_partkey", "i").join(lines.withColumnRenamed("l_partkey", "j"), "l_orderkey").filter("i < j").select("i", "j").distinct()
    vertices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("v"), "p_size", "p_brand")
    return Network(vertices, pairs, False)
