"""Readers and writers of trajectories, memory labels, crawls, tasks and training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBSERVATION = "axtree string, viewport_state struct<viewport_width:int,viewport_height:int,device_scale_factor:double,bbox_coordinate_space:string,bbox_scale_factor:double,scroll_x:double,scroll_y:double>, extra_element_properties map<string,struct<visibility:double,bbox:array<double>,clickable:boolean,set_of_marks:boolean>>, open_pages_urls array<string>, open_pages_titles array<string>, active_page_index array<int>, last_action_error string, screenshot string, use_axtree boolean, filter_viewport boolean, use_screenshot boolean, use_tabs_info boolean, axtree_max_tokens int"
RESPONSE = "model_full_response string, reasoning string, action string, response_token_ids array<int>, response_log_probs array<float>"
MEMORY = "model_full_response string, reasoning string, memory string, state string"


def _struct(fields: str) -> str:
    """DDL of columns as DDL of a struct's fields."""
    depth, out = 0, ""
    for k, c in enumerate(fields):
        depth += (c == "<") - (c == ">")
        out += ":" if c == " " and depth == 0 and fields[k - 1] != "," else "" if c == " " and depth == 0 else c
    return f"struct<{out}>"


STEP = f"struct<type:string,step_num:int,observation:{_struct(OBSERVATION)},response:{_struct(RESPONSE)},memory:string>"
TRAJECTORY = f"type string, goal string, calculator_url string, site_urls map<string,string>, reward double, terminated boolean, truncated boolean, steps array<{STEP}>"
CRAWL = "`__key__` string, json struct<traj_data:struct<traj_num:bigint,goal:string,success:boolean,reward:double>,step_data:struct<obs:struct<axtree_txt:string,last_action_error:string>,thought:string,parsed_action:string>,graph_data:struct<domain:string>>"
TASK = "task_id long, intent string, sites array<string>, start_url string, eval string"


def _stem(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1))


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """One row a JSON file; traj_id is the file's stem."""
    return _stem(spark.read.schema(TRAJECTORY).option("multiLine", True).json(path), "traj_id")


def read_steps(trajectories: DataFrame) -> DataFrame:
    """One row a step; flags that a file leaves out are false, as loaders take them."""
    rows = trajectories.select("traj_id", "goal", "reward", "terminated", "truncated", F.posexplode("steps").alias("place", "step"))
    flag = lambda name: F.coalesce(F.col(f"step.observation.{name}"), F.lit(False)).alias(name)
    return rows.select("traj_id", "goal", "reward", "terminated", "truncated", "place", "step.step_num", "step.observation", "step.response", "step.memory", flag("filter_viewport"), flag("use_tabs_info"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Every line of memory label files: task_id, line_num, step, memory, error (null if the line is sound).

    Sound lines are objects with exactly an integer step and a string memory. Lines are numbered within their file.
    """
    return label_lines(_stem(spark.read.text(path, wholetext=True), "task_id").select("task_id", "value"))


def label_lines(files: DataFrame) -> DataFrame:
    """The lines of whole files (task_id, value), as read_labels tells them."""
    lines = files.select("task_id", F.size(F.split("value", "\n", -1)).alias("_n"), F.posexplode(F.split("value", "\n", -1)).alias("line_num", "line")).where(~((F.col("line") == "") & (F.col("line_num") == F.col("_n") - 1) & (F.col("_n") > 1)))
    parsed = F.try_parse_json("line")
    keys = F.array_sort(F.json_object_keys("line"))
    kind = lambda k: F.schema_of_variant(F.try_variant_get(parsed, f"$.{k}", "variant"))
    error = F.when(F.trim("line") == "", "blank").when(parsed.isNull() | keys.isNull(), "invalid").when(keys != F.array(F.lit("memory"), F.lit("step")), "keys").when(kind("step") != "BIGINT", "step").when(kind("memory") != "STRING", "memory")
    return lines.select("task_id", "line_num", F.try_variant_get(parsed, "$.step", "int").alias("step"), F.try_variant_get(parsed, "$.memory", "string").alias("memory"), error.alias("error"))


def label_file_errors(labels: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(task_id, error) of label files: the first line that is not sound, a repeated step, steps out of order, or steps that
    are not just those of `expected` (task_id, step_num)."""
    line = F.when(F.col("error").isNotNull(), F.concat(F.lit("line "), (F.col("line_num") + 1).cast("string"), F.lit(": "), F.col("error")))
    files = labels.groupBy("task_id").agg(F.min_by(line, F.when(F.col("error").isNotNull(), F.col("line_num"))).alias("_line"), F.transform(F.array_sort(F.collect_list(F.struct("line_num", "step"))), lambda x: x["step"]).alias("_steps"))  # one file's own lines
    if expected is not None:
        files = files.join(expected.groupBy("task_id").agg(F.array_sort(F.collect_list(F.col("step_num").cast("int"))).alias("_expected")), "task_id", "left")
    sized = F.size(F.array_distinct("_steps")) < F.size("_steps")
    error = F.when(F.col("_line").isNotNull(), F.col("_line")).when(sized, F.lit("duplicate step")).when(F.array_sort("_steps") != F.col("_steps"), F.lit("steps out of order"))
    if expected is not None:
        error = error.when(F.coalesce(F.col("_steps") != F.col("_expected"), F.lit(True)), F.lit("unexpected steps"))
    return files.select("task_id", error.alias("error")).where("error IS NOT NULL")


def list_files(spark: SparkSession, path: str, suffix: str = ".json") -> list[str]:
    """The files of a folder with this ending, or the file itself, in order of their names; a missing path is an error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        raise FileNotFoundError(path)
    if store.getFileStatus(where).isFile():
        return [path]
    return sorted(f.getPath().toString() for f in store.listStatus(where) if f.isFile() and f.getPath().getName().endswith(suffix))


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    """Crawl lines with an ordinal struct(file, block, line) that sorts by file name and line, however files are dealt."""
    rows = spark.read.schema(CRAWL).json(path)
    return rows.withColumn("ordinal", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")))


def write_crawl(df: DataFrame, path: str) -> None:
    """Crawl rows as JSON lines, without pictures."""
    df.drop("png").write.json(path)


def compact_observation(raw: DataFrame, column: str = "observation") -> DataFrame:
    """`raw` with an observation as it is stored: lists for tuples, whole numbers in active_page_index, also for a single one."""
    o = F.col(column)
    active = o["active_page_index"]
    kind = raw.select(active.alias("a")).schema["a"].dataType.simpleString()
    listed = active.cast("array<int>") if kind.startswith("array") else F.array(active.cast("int"))
    return raw.withColumn(column, o.withField("active_page_index", listed))


def sampling_params(params: Column) -> Column:
    """map<string, string> for generation calls: max_tokens under its other name, without model, messages and nulls."""
    old, new = F.lit("max_tokens"), F.lit("max_new_tokens")
    renamed = F.when(F.map_contains_key(params, old) & ~F.map_contains_key(params, new), F.map_concat(F.map_filter(params, lambda k, v: k != old), F.map_from_arrays(F.array(new), F.array(F.element_at(params, old))))).otherwise(params)
    return F.map_filter(renamed, lambda k, v: ~k.isin("model", "messages") & v.isNotNull())


def read_tasks(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A JSON array of task configurations, or one a file or line; eval is its JSON text, as its values are texts, lists or objects."""
    return spark.read.schema(TASK).option("multiLine", multi_line).json(path)


def write_trajectories(df: DataFrame, path: str) -> None:
    """JSON, a folder a task and, where rows have a rollout_id, in it a folder a rollout."""
    df.write.partitionBy("task_id", *(["rollout_id"] if "rollout_id" in df.columns else [])).json(path)


def write_metadata(df: DataFrame, path: str) -> None:
    """(traj_id, num_steps, reward, success, domain, intent) as JSON lines."""
    df.select("traj_id", "num_steps", "reward", "success", "domain", "intent").write.json(path)


def write_labels(labels: DataFrame, path: str, expected: DataFrame) -> None:
    """Labels (task_id, step_num, memory) as JSON lines, a folder a task, if each task has just its expected steps.

    The rows are checked before anything is written, and Spark's committer makes the files appear once and whole.
    """
    a, b = (df.groupBy("task_id").agg(F.array_sort(F.collect_list(F.col("step_num").cast("int"))).alias(n)) for df, n in ((labels, "_a"), (expected, "_b")))  # a task's own steps
    wrong = [r[0] for r in a.join(b, "task_id", "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("task_id").limit(10).collect()]
    if wrong:
        raise ValueError(f"labels are not those of the steps of {wrong}")
    rows = labels.select("task_id", F.to_json(F.struct(F.col("step_num").cast("int").alias("step"), "memory")).alias("value"), "step_num")
    rows.repartition("task_id").sortWithinPartitions("task_id", "step_num").drop("step_num").write.partitionBy("task_id").text(path)


def write_training_rows(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Parquet; one file only where the reader of small exports asks for it."""
    (df.coalesce(1) if one_file else df).write.parquet(path)


def encode_screenshots(df: DataFrame, column: str = "screenshot") -> DataFrame:
    """Pictures' bytes as base64 text."""
    return df.withColumn(column, F.base64(F.col(column).cast("binary")))


def decode_screenshots(df: DataFrame, column: str = "screenshot") -> DataFrame:
    return df.withColumn(column, F.unbase64(column))
