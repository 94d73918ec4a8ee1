"""The driver's tables seen as trajectories, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(traj_id, step_num, goal, observation, response) of conversations; the last step may lack a response."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").where("role <> 'system'").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text"))
    return turns.where("role = 'user'").select(F.col("conv_id").alias("traj_id"), (F.row_number().over(w) - 1).cast("long").alias("step_num"), F.first("text").over(w).alias("goal"), F.col("text").alias("observation"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("response"))


STEPS = """
turns AS (
  SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
  FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), steps AS (
  SELECT conv_id AS traj_id, row_number() OVER w - 1 AS step_num, first_value(text) OVER w AS goal, text AS observation,
    CASE WHEN next_role = 'assistant' THEN next_text END AS response
  FROM turns WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
)"""


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with `raw`, a tagged response: without tags in every 7th, with a doubled action in every 5th trajectory."""
    n = F.col("step_num").cast("string")
    doubled = F.concat(F.lit("<think>first</think><action>noop()</action> then <think> "), "response", F.lit(" </think> <action> click("), n, F.lit(") </action> tail"))
    plain = F.concat(F.lit("<think>"), "response", F.lit("</think><memory>m"), n, F.lit("</memory><state>s"), n, F.lit("</state><action>click("), n, F.lit(")</action>"))
    raw = F.when(F.col("response").isNull(), None).when(F.col("traj_id") % 7 == 0, F.col("response")).when(F.col("traj_id") % 5 == 0, doubled).otherwise(plain)
    return steps(spark, sf_dir).withColumn("raw", raw)


TAGGED = (
    STEPS
    + """, tagged AS (
  SELECT *, CASE WHEN response IS NULL THEN NULL WHEN traj_id % 7 = 0 THEN response
    WHEN traj_id % 5 = 0 THEN '<think>first</think><action>noop()</action> then <think> ' || response || ' </think> <action> click(' || step_num || ') </action> tail'
    ELSE '<think>' || response || '</think><memory>m' || step_num || '</memory><state>s' || step_num || '</state><action>click(' || step_num || ')</action>' END AS raw
  FROM steps
)"""
)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step samples: groups of users, a user an episode, events in order as steps."""
    return table(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("group_index"), F.col("user_id").alias("index"), F.col("event_id").alias("ordinal"), F.col("value").alias("episode_reward"), F.lit(None).cast("double").alias("final_reward"), F.lit(None).cast("double").alias("sample_reward"), F.when(F.col("event_id") % 97 == 0, "aborted").otherwise("completed").alias("status"), F.length("props").alias("n_tokens"), (F.col("user_id") % 25).alias("task_id"))


SAMPLES = """samples AS (
  SELECT user_id % 25 AS group_index, user_id AS index, event_id AS ordinal, value AS episode_reward,
    CASE WHEN event_id % 97 = 0 THEN 'aborted' ELSE 'completed' END AS status, length(props) AS n_tokens, user_id % 25 AS task_id
  FROM events
), episodes AS (SELECT group_index, index, arg_max(episode_reward, ordinal) AS reward, bool_or(status = 'aborted') AS aborted FROM samples GROUP BY ALL)"""


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trajectories: the customer is the goal, line items are steps."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("num_steps"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("goal"), F.col("o_orderstatus").alias("domain"))
    return orders.join(n, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("ordinal"), "goal", "domain", "num_steps")


TRAJECTORIES = """trajectories AS (
  SELECT o_orderkey AS ordinal, o_custkey AS goal, o_orderstatus AS domain, num_steps
  FROM orders JOIN (SELECT l_orderkey, count(*) AS num_steps FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with n, from 1 within their order; line numbers repeat."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w).cast("long"))


LINES = "lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem)"
