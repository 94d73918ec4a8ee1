"""Episode rewards, group normalization and token statistics over step samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPISODE = ("group_index", "index")


def terminal_reward(required: bool = False) -> Column:
    """final_reward, else episode_reward, else the sample's own; with `required`, an error that names the episode without any."""
    found = F.coalesce("final_reward", "episode_reward", "sample_reward")
    if not required:
        return found
    told = F.concat(F.lit("no reward for index "), F.col("index").cast("string"), F.lit(" of group "), F.col("group_index").cast("string"))
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(told).cast("double"))


def episode_rewards(samples: DataFrame, reward: Column | None = None, ordinal: str = "ordinal", abort_override: bool = False) -> DataFrame:
    """(group_index, index, reward): the last sample's in input order; 0 if any step was aborted, where asked for."""
    value = F.max_by(terminal_reward() if reward is None else reward, ordinal)
    if abort_override:
        value = F.when(F.bool_or(F.col("status") == "aborted"), 0.0).otherwise(value)
    return samples.groupBy(*EPISODE).agg(value.alias("reward"))


def normalized(episodes: DataFrame, std: bool = True, normalize: bool = True) -> DataFrame:
    """`episodes` with `normalized`: less the group's mean, over its sample deviation; groups are small by construction."""
    if not normalize:
        return episodes.withColumn("normalized", F.col("reward"))
    w = Window.partitionBy("group_index")
    centred = F.col("reward") - F.avg("reward").over(w)
    single = F.count(F.lit(1)).over(w) == 1
    return episodes.withColumn("normalized", F.when(single, F.col("reward")).otherwise(centred / (F.stddev_samp("reward").over(w) + 1e-6) if std else centred))


def group_errors(samples: DataFrame, expected: int) -> DataFrame:
    """(group_index, error) of groups with a wrong number of episodes or without a reward."""
    episodes = episode_rewards(samples)
    sums = episodes.groupBy("group_index").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reward").isNull()).alias("missing"))
    error = F.when(F.col("missing") > 0, F.lit("missing reward")).when(F.col("n") != expected, F.concat(F.lit(f"expected {expected} got "), F.col("n").cast("string")))
    return sums.select("group_index", error.alias("error")).where("error IS NOT NULL")


def stamped(samples: DataFrame) -> DataFrame:
    """Every step with its group's map from episode to terminal reward; of large groups, `stamped_totals` keeps steps small."""
    maps = episode_rewards(samples).groupBy("group_index").agg(F.map_from_entries(F.collect_list(F.struct("index", "reward"))).alias("group_final_rewards"))  # a group has a few episodes
    return samples.drop("group_final_rewards").join(maps, "group_index")


def stamped_totals(samples: DataFrame) -> DataFrame:
    """Every step with `n` and `total`, the number and the sum of its group's terminal rewards; they are summed once a group, so groups
    may have any number of episodes."""
    totals = episode_rewards(samples).groupBy("group_index").agg(F.count(F.lit(1)).alias("n"), F.sum("reward").alias("total"))
    return samples.drop("n", "total").join(totals, "group_index")


def stored_maps(samples: DataFrame, expected: int | None = None) -> DataFrame:
    """(group_index, rewards) of groups with stored maps, as text keys; maps that differ within a group, or of another size
    than `expected`, are an error."""
    told = samples.where(F.col("group_final_rewards").isNotNull()).groupBy("group_index").agg(F.max(F.to_json("group_final_rewards")).alias("most"), F.min(F.to_json("group_final_rewards")).alias("least"))
    found = F.from_json("most", "map<string,double>")
    name = F.col("group_index").cast("string")
    checked = F.when(F.col("most") != F.col("least"), F.raise_error(F.concat(F.lit("stored rewards differ in group "), name)).cast("map<string,double>"))
    if expected is not None:
        checked = checked.when(F.size(found) != expected, F.raise_error(F.concat(F.lit(f"expected {expected} stored rewards in group "), name, F.lit(" got "), F.size(found).cast("string"))).cast("map<string,double>"))
    return told.select("group_index", checked.otherwise(found).alias("rewards"))


def stored_entries(stored: DataFrame, expected: int | None = None) -> DataFrame:
    """(group_index, index, reward) of stored maps that are given an entry a row, repeated or not; an episode with rewards that differ, or a
    group with another number of entries than `expected`, is an error."""
    told = stored.groupBy(*EPISODE).agg(F.min("reward").alias("reward"), F.max("reward").alias("_most"), F.count("reward").alias("_there"), F.count(F.lit(1)).alias("_all"))
    name = F.col("group_index").cast("string")
    differ = ~F.col("reward").eqNullSafe(F.col("_most")) | ((F.col("_there") > 0) & (F.col("_there") < F.col("_all")))
    reward = F.when(differ, F.raise_error(F.concat(F.lit("stored rewards differ in group "), name)).cast("double")).otherwise(F.col("reward"))
    found = told.select("group_index", F.col("index").cast("long").alias("index"), reward.alias("reward"))
    if expected is None:
        return found
    sizes = found.groupBy("group_index").agg(F.count(F.lit(1)).alias("_n"))
    wrong = F.raise_error(F.concat(F.lit(f"expected {expected} stored rewards in group "), name, F.lit(" got "), F.col("_n").cast("string"))).cast("double")
    return found.join(sizes, "group_index").select(*EPISODE, F.when(F.col("_n") != expected, wrong).otherwise(F.col("reward")).alias("reward"))


def from_stored(samples: DataFrame, std: bool = True, expected: int | None = None, stored: DataFrame | None = None) -> DataFrame:
    """(group_index, index, reward, normalized) of the episodes that are there.

    A stored group map, which may know episodes that were trimmed since, takes the place of the group's episodes; groups
    without one are normalized over their episodes. Maps are read from the samples or, as a map a step is large where groups are, from
    `stored`, (group_index, index, reward) an entry a row.
    """
    if stored is None:
        maps = stored_maps(samples, expected)
        known = maps.select("group_index", F.explode("rewards").alias("index", "reward")).select("group_index", F.col("index").cast("long").alias("index"), "reward")
    else:
        maps, known = stored.select("group_index").distinct(), stored_entries(stored, expected)
    rest = episode_rewards(samples).join(maps, "group_index", "left_anti").select("group_index", F.col("index").cast("long").alias("index"), "reward")
    there = samples.select(*EPISODE).distinct()
    return normalized(known.unionByName(rest), std).join(there, list(EPISODE))


def with_rewards(samples: DataFrame, episodes: DataFrame) -> DataFrame:
    """Every step sample with its episode's raw and normalized reward; groups of any size join on their episode."""
    told = episodes.select(*EPISODE, F.col("reward").alias("raw_reward"), "normalized")
    return samples.join(told, list(EPISODE))


def ordered_episodes(episodes: DataFrame) -> DataFrame:
    """(group_index, indexes): a group's episodes by index, a missing one first."""
    place = F.struct(F.coalesce("index", F.lit(-1)).alias("at"), F.col("index"))
    return episodes.groupBy("group_index").agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["index"]).alias("indexes"))  # a group has a few episodes


def accepted_groups(groups: DataFrame, target: int, arrival: str = "arrival", kept: str = "kept") -> DataFrame:
    """The first `target` groups that the filter kept, in order of arrival; sorted by their first sample's index."""
    return groups.where(kept).orderBy(arrival).limit(target).orderBy("first_index")


def drop_reasons(groups: DataFrame, reason: str = "reason") -> DataFrame:
    """(reason, n) of the groups that a filter dropped."""
    return groups.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


def success_counts(rollouts: DataFrame) -> DataFrame:
    """One row: finished (a reward is there), succeeded (it is positive), failed, unfinished."""
    return rollouts.agg(F.count_if(F.col("reward").isNotNull()).alias("finished"), F.count_if(F.col("reward") > 0).alias("succeeded"), F.count_if(F.col("reward") <= 0).alias("failed"), F.count_if(F.col("reward").isNull()).alias("unfinished"))


def all_samples(*parts: DataFrame) -> DataFrame:
    """Bag union by name of samples from several places; repeated rows stay."""
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole


def flat_samples(nested: Column, depth: int) -> Column:
    """The samples of arrays nested `depth` deep, in order."""
    for _ in range(depth - 1):
        nested = F.flatten(nested)
    return nested


def token_stats(samples: DataFrame, length: str = "n_tokens") -> DataFrame:
    """total, min, max, mean, n, aborted; zeros without rows."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return samples.agg(zero(F.sum(length)).cast("long").alias("total"), zero(F.min(length)).cast("long").alias("least"), zero(F.max(length)).cast("long").alias("most"), F.round(F.coalesce(F.avg(length), F.lit(0.0)), 6).alias("mean"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "aborted").alias("aborted"))


def usage_totals(usages: DataFrame, usage: str = "usage", as_json: bool = False) -> DataFrame:
    """(key, total) over maps of counters; with `as_json`, over JSON objects, of which whole numbers alone count."""
    if as_json:
        keyed = usages.select(F.explode(F.json_object_keys(usage)).alias("key"), F.from_json(usage, "map<string,string>").alias("_values"), F.try_parse_json(usage).alias("_json"))
        # a true and a text have other kinds than a whole number
        text = F.try_element_at("_values", F.col("key"))
        kinds = F.from_json(F.regexp_replace(F.to_json("_json"), r'"((?:[^"\\\\]|\\\\.)*)"\s*:\s*(-?\d+)(?=\s*[,}])', '"$1":"#$2"'), "map<string,string>")
        whole = F.startswith(F.try_element_at(kinds, F.col("key")), F.lit("#")) & ~F.startswith(text, F.lit("#"))
        return keyed.where(whole).groupBy("key").agg(F.sum(text.cast("long")).alias("total"))
    return usages.select(F.explode(usage).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


def step_status(finish_reasons: Column) -> Column:
    """abort before length before completed."""
    return F.when(F.array_contains(finish_reasons, "abort"), "aborted").when(F.array_contains(finish_reasons, "length"), "truncated").otherwise("completed")


def task_errors(samples: DataFrame) -> DataFrame:
    """Groups whose task id is not exactly one."""
    sums = samples.groupBy("group_index").agg(F.count_distinct("task_id").alias("tasks"), F.count_if(F.col("task_id").isNull()).alias("missing"))
    return sums.where("tasks <> 1 OR missing > 0")


def stopped_at(steps: DataFrame, most_errors: int = 2, memory: str | None = None) -> DataFrame:
    """Steps up to the one that ends its run: terminated, truncated, or more than `most_errors` parse errors.

    With `memory`, a flag for malformed memory, such a step ends its run at once, as it cannot seed the next prompt.
    """
    w = Window.partitionBy("traj_id").orderBy("step_num")
    ends = F.col("terminated") | F.col("truncated") | (F.sum(F.col("parse_error").cast("int")).over(w) > most_errors)
    if memory:
        ends = ends | F.col(memory)
    marked = steps.withColumn("_end", F.coalesce(ends, F.lit(False)))
    before = F.sum(F.col("_end").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return marked.withColumn("_before", F.coalesce(before, F.lit(0))).where("_before = 0").drop("_end", "_before")


def rollout_errors(samples: DataFrame, expected: int) -> DataFrame:
    """(rollout, error) of rollout groups that cannot be stamped: an empty episode; an episode whose terminal sample is of another group
    than the first one's, or has an index that an earlier one has (the first such episode tells); a wrong number of episodes.

    `samples` has rollout, episode, sample, group_index and index; an episode without samples is a row with a null sample.
    """
    last = F.max_by(F.struct("group_index", "index"), "sample")
    episodes = samples.groupBy("rollout", "episode").agg(F.count("sample").alias("n"), last.alias("last"))
    groups = episodes.groupBy("rollout").agg(F.array_sort(F.collect_list(F.struct("episode", "n", "last"))).alias("e"))  # a group has a few episodes
    first = F.get("e", F.lit(0))["last"]["group_index"]
    name = lambda c: F.coalesce(c.cast("string"), F.lit("null"))

    def wrong(x: Column, i: Column) -> Column:
        mine, before = x["last"], F.slice("e", F.lit(1), i)
        twice = F.exists(before, lambda y: y["last"]["index"].eqNullSafe(mine["index"]))
        mixed = F.concat(F.lit("mixes group "), name(first), F.lit(" and "), name(mine["group_index"]))
        return F.when(~mine["group_index"].eqNullSafe(first), mixed).when(twice, F.concat(F.lit("duplicate index "), name(mine["index"]), F.lit(" in group "), name(mine["group_index"])))

    found = F.get(F.filter(F.transform("e", wrong), lambda x: x.isNotNull()), F.lit(0))
    number = F.when(F.size("e") != expected, F.concat(F.lit(f"expected {expected} episodes in group "), name(first), F.lit(" got "), F.size("e").cast("string")))
    error = F.when(F.exists("e", lambda x: x["n"] == 0), F.lit("empty episode")).otherwise(F.coalesce(found, number))
    return groups.select("rollout", error.alias("error")).where("error IS NOT NULL")
