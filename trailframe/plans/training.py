"""Queries over tagged text, prompts and loss masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailframe.functions import text
from trailframe.operators import history, masks, prompts, rewards, token_spans
from trailframe.plans import views
from trailframe.plans.catalog import query
from trailframe.plans.views import LINES, STEPS, TAGGED, lines, table

_BEFORE = "OVER (PARTITION BY traj_id ORDER BY step_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _quoted(s: str) -> str:
    """A text as SQL."""
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


# -- tagged text -----------------------------------------------------------------------------------------------------


@query(f"WITH {STEPS} SELECT traj_id, step_num, CASE WHEN step_num % 3 = 0 THEN NULL ELSE trim(observation) END AS memory FROM steps WHERE response IS NOT NULL")
def strict_two_blocks(spark, sf_dir):
    made = F.when(F.col("step_num") % 3 == 0, F.concat(F.lit("<memory>"), "observation", F.lit("</memory><think>t</think>"))).otherwise(F.concat(F.lit("<think>t</think>\n<memory> "), "observation", F.lit(" </memory>\n")))
    return views.steps(spark, sf_dir).where("response IS NOT NULL").select("traj_id", "step_num", text.strict_blocks(made, "think", "memory")["memory"].alias("memory"))


@query(f"WITH {STEPS} SELECT traj_id, step_num, CASE WHEN response IS NOT NULL AND step_num % 2 = 0 THEN '<think>' || response || '</think>' || chr(10) || '<memory>m</memory>' || chr(10) || '<state>' || step_num || '</state>' END AS made FROM steps")
def assembled_responses(spark, sf_dir):
    memory = F.when(F.col("step_num") % 2 == 0, F.lit("m")).otherwise(F.lit(" "))
    return views.steps(spark, sf_dir).select("traj_id", "step_num", text.assemble(F.col("response"), memory, F.col("step_num").cast("string")).alias("made"))


@query(f"WITH {TAGGED} SELECT traj_id, step_num, trim(list_extract(regexp_extract_all(raw, '(?s)<think>(.*?)</think>', 1), -1)) AS reasoning FROM tagged WHERE contains(raw, '<think>')")
def required_reasoning(spark, sf_dir):
    rows = views.tagged(spark, sf_dir).where(F.contains("raw", F.lit("<think>")))
    return rows.select("traj_id", "step_num", text.required(text.last_tag(F.col("raw"), "think"), "reasoning").alias("reasoning"))


_PARTS = "SELECT conv_id, list(struct_pack(turn := turn, kind := CASE WHEN conv_id % 3 = 0 AND role = 'user' THEN 'image' ELSE 'text' END, text := text) ORDER BY turn) AS parts FROM conversations GROUP BY 1"


def _parts(spark, sf_dir):
    kind = F.when((F.col("conv_id") % 3 == 0) & (F.col("role") == "user"), "image").otherwise("text")
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", kind.alias("type"), "text"))).alias("x"))
    return turns.select("conv_id", F.transform("x", lambda x: F.struct(x["type"].alias("type"), x["text"].alias("text"))).alias("parts"))


@query(f"WITH made AS ({_PARTS}) SELECT conv_id, CASE WHEN len(list_filter(parts, lambda p: p.kind <> 'text')) = 0 THEN array_to_string(list_transform(parts, lambda p: p.text), chr(10)) END AS content FROM made")
def flattened_parts(spark, sf_dir):
    return _parts(spark, sf_dir).select("conv_id", text.flatten_parts(F.col("parts")).alias("content"))


@query(f"WITH made AS ({_PARTS}), flat AS (SELECT conv_id, unnest(list_transform(parts, lambda p, i: struct_pack(place := i - 1, kind := p.kind, cached := i = len(parts))), recursive := true) FROM made) SELECT conv_id, place, kind AS type, cached FROM flat")
def cached_parts(spark, sf_dir):
    rows = _parts(spark, sf_dir).select("conv_id", F.posexplode(text.cached_last(F.col("parts"))).alias("place", "p"))
    return rows.select("conv_id", F.col("place").cast("long").alias("place"), "p.type", "p.cached")


# -- prompts -----------------------------------------------------------------------------------------------------------

_OBSERVED = """observed AS (
  SELECT *, event_id % 2 = 0 AS tabs, event_id % 3 = 0 AS filtered, CASE WHEN event_id % 5 = 0 THEN 'failed ' || event_type WHEN event_id % 5 = 1 THEN '' END AS error,
    '[1] root' || chr(10) || chr(9) || '[2] ' || event_type || chr(10) || chr(9) || '[3] hidden' AS full_tree FROM events
), trees AS (SELECT *, CASE WHEN filtered THEN '[1] root' || chr(10) || chr(9) || '[2] ' || event_type ELSE full_tree END AS tree FROM observed)"""


@query(
    f"""WITH {_OBSERVED} SELECT event_id, concat_ws(chr(10),
  CASE WHEN tabs THEN '# Open tabs' || chr(10) || 'Tab 0:' || chr(10) || '    Title: t0' || chr(10) || '    URL: u0' || chr(10) || 'Tab 1 (active tab):' || chr(10) || '    Title: t1' || chr(10) || '    URL: u1' END,
  '# Page' || chr(10) || CASE WHEN length(tree) > 24 THEN left(tree, 24) || chr(10) || '... (truncated)' ELSE tree END,
  CASE WHEN filtered THEN '# Viewport' || chr(10) || 'Width: 800' || chr(10) || 'Hight: 600' || chr(10) || 'Scroll X: 0.0' || chr(10) || 'Scroll Y: 1.5' END,
  CASE WHEN error <> '' THEN '# Error of the last action' || chr(10) || error END) AS content FROM trees"""
)
def observation_sections(spark, sf_dir):
    k = F.col("event_id")
    whole = F.concat(F.lit("[1] root\n\t[2] "), "event_type", F.lit("\n\t[3] hidden"))
    properties = F.from_json(F.lit('{"2":{"visibility":0.9},"3":{"visibility":0.1}}'), "map<string,struct<visibility:double>>")
    o = F.struct(
        whole.alias("axtree"), F.struct(F.lit(800).alias("viewport_width"), F.lit(600).alias("viewport_height"), F.lit(0.0).alias("scroll_x"), F.lit(1.5).alias("scroll_y")).alias("viewport_state"), properties.alias("extra_element_properties"),
        F.array(F.lit("u0"), F.lit("u1")).alias("open_pages_urls"), F.array(F.lit("t0"), F.lit("t1"), F.lit("t2")).alias("open_pages_titles"), F.array(F.lit(1)).alias("active_page_index"),
        F.when(k % 5 == 0, F.concat(F.lit("failed "), "event_type")).when(k % 5 == 1, "").alias("last_action_error"), F.lit(True).alias("use_axtree"), (k % 3 == 0).alias("filter_viewport"), F.lit(False).alias("use_screenshot"), (k % 2 == 0).alias("use_tabs_info"), F.lit(24).alias("axtree_max_tokens"),
    )
    return table(spark, sf_dir, "events").withColumn("o", o).select("event_id", prompts.observation_content(F.col("o")).alias("content"))


_ACTION_LINE = "'Step ' || step_num || ': click(' || step_num || ')'"


@query(f"WITH {STEPS} SELECT traj_id, step_num, coalesce(string_agg({_ACTION_LINE}, chr(10)) {_BEFORE}, '') AS actions FROM steps")
def past_actions(spark, sf_dir):
    action = F.concat(F.lit("click("), F.col("step_num").cast("string"), F.lit(")"))
    return views.steps(spark, sf_dir).select("traj_id", "step_num", prompts.append_actions(action).alias("actions"))


_STATE_LINE = "'## Step ' || step_num || chr(10) || '<action>' || chr(10) || 'click(' || step_num || ')' || chr(10) || '</action>'"
_SOUND = f"{STEPS}, sound AS (SELECT *, 'm' || length(observation) AS memory, left(observation, 30) AS state FROM steps), shown AS (SELECT *, string_agg({_STATE_LINE}, chr(10)) {_BEFORE} AS actions, lag(memory) OVER w AS before, lag(state) OVER w AS old FROM sound WINDOW w AS (PARTITION BY traj_id ORDER BY step_num))"
_STATE_USER = f"'system: ' || {_quoted(prompts.SYSTEM)} || chr(10) || 'user: # Goal' || chr(10) || goal || chr(10) || '# Page' || chr(10) || observation || chr(10) || {_quoted(prompts.ACTIONS)} || chr(10) || CASE WHEN step_num > 0 THEN '# History' || chr(10) || '# Past actions' || chr(10) || actions || chr(10) || '# Memory' || chr(10) || before || chr(10) || '# State after step ' || (step_num - 1) || chr(10) || old || chr(10) ELSE '' END || {_quoted(prompts.FINAL)}"


def _stateful(spark, sf_dir):
    action = F.concat(F.lit("click("), F.col("step_num").cast("string"), F.lit(")"))
    return views.steps(spark, sf_dir).withColumns({"action": action, "memory": F.concat(F.lit("m"), F.length("observation").cast("string")), "state": F.left("observation", F.lit(30))})


@query(f"WITH {_SOUND} SELECT traj_id, step_num, {_STATE_USER} AS prompt FROM shown")
def state_memory_action(spark, sf_dir):
    return prompts.state_memory_turn(_stateful(spark, sf_dir)).select("traj_id", "step_num", prompts.flatten_messages(F.col("prompt")).alias("prompt"))


@query(f"WITH {_SOUND} SELECT traj_id, step_num, {_STATE_USER} || chr(10) || 'assistant: ' || response || chr(10) || 'user: ' || {_quoted(prompts.COMPRESS)} AS prompt FROM shown WHERE response IS NOT NULL")
def state_memory_compression(spark, sf_dir):
    return prompts.state_memory_turn(_stateful(spark, sf_dir), "compression").select("traj_id", "step_num", prompts.flatten_messages(F.col("prompt")).alias("prompt"))


_LINE = "'Step ' || step_num || ': ' || coalesce(response, '')"
_TURNS = "'user: ' || observation || chr(10) || 'assistant: ' || coalesce(response, '')"


@query(f"WITH {STEPS} SELECT traj_id, step_num, 'system: ' || {_quoted(prompts.SYSTEM)} || chr(10) || 'user: # Goal' || chr(10) || goal || chr(10) || {_quoted(prompts.ACTIONS)} || chr(10) || coalesce(string_agg({_TURNS}, chr(10)) OVER (PARTITION BY traj_id ORDER BY step_num ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) || chr(10), '') || 'user: ' || observation AS prompt FROM steps")
def conversation_prompts(spark, sf_dir):
    return prompts.conversation(views.steps(spark, sf_dir), 2).select("traj_id", "step_num", prompts.flatten_messages(F.col("prompt")).alias("prompt"))


@query(f"WITH {STEPS}, shown AS (SELECT *, coalesce(string_agg({_LINE}, chr(10)) {_BEFORE}, '') AS history FROM steps) SELECT traj_id, step_num, 'system: ' || {_quoted(prompts.SYSTEM)} || chr(10) || 'user: # Goal' || chr(10) || goal || chr(10) || '# Page' || chr(10) || observation || chr(10) || 'Use tools.' || chr(10) || CASE WHEN step_num > 0 THEN '# History' || chr(10) || history || chr(10) ELSE '' END || 'Answer as JSON.' AS prompt FROM shown")
def api_prompts(spark, sf_dir):
    line = F.concat(F.lit("Step "), F.col("step_num").cast("string"), F.lit(": "), F.coalesce("response", F.lit("")))
    rows = prompts.api_turn(views.steps(spark, sf_dir), history.append_history(line), "Use tools.", "Answer as JSON.")
    return rows.select("traj_id", "step_num", prompts.flatten_messages(F.col("prompt")).alias("prompt"))


@query(f"WITH {STEPS} SELECT traj_id, step_num, 'system: Revise the candidate memory.' || chr(10) || 'user: # Goal' || chr(10) || goal || chr(10) || '# Memory before' || chr(10) || coalesce(lag(response) OVER (PARTITION BY traj_id ORDER BY step_num), '(none yet)') || chr(10) || '# Response' || chr(10) || coalesce(response, '(no response)') || chr(10) || '# Candidate memory' || chr(10) || CASE WHEN step_num % 2 = 0 THEN 'c' || step_num ELSE '(empty)' END || chr(10) || '# Feedback' || chr(10) || 'shorter' AS prompt FROM steps")
def revision_prompts(spark, sf_dir):
    shown = views.steps(spark, sf_dir).withColumn("before", history.overwrite_history(F.col("response")))
    candidate = F.when(F.col("step_num") % 2 == 0, F.concat(F.lit("c"), F.col("step_num").cast("string"))).otherwise(F.lit(""))
    made = prompts.label_request(F.col("goal"), F.col("before"), F.col("response"), candidate, F.lit("shorter"))
    return shown.select("traj_id", "step_num", prompts.flatten_messages(made).alias("prompt"))


@query("SELECT item_id, '# Examples' || chr(10) || 'Trajectory 0: a.json' || chr(10) || 'Trajectory 1: b.json' || chr(10) || '# Task' || chr(10) || text AS prompt FROM benchmark")
def few_shot_prompts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", prompts.few_shot_prompt(F.col("text"), ["a.json", "b.json"]).alias("prompt"))


# -- masks -------------------------------------------------------------------------------------------------------------


def _ids(c):
    return F.transform(F.split(c, " "), lambda w: (F.crc32(w) % 50_000).cast("int"))


def _words(c: str) -> str:
    return f"len(string_split({c}, ' '))"


@query(f"WITH {STEPS} SELECT traj_id, step_num, {_words('observation')} AS prompt, 2 + {_words('response')} + 3 + 1 AS response_length, '0x2,1x' || {_words('response')} || ',0x3,1x1' AS runs FROM steps WHERE response IS NOT NULL")
def prefix_spans(spark, sf_dir):
    opener = F.array(F.lit(7), F.lit(8))
    a = _ids(F.col("observation"))
    b = F.concat(a, opener, _ids(F.col("response")))
    c = F.concat(b, F.array(*map(F.lit, (1, 2, 3))))
    rows = views.steps(spark, sf_dir).where("response IS NOT NULL").select("traj_id", "step_num", masks.spans(F.array(a, b, c, F.concat(c, F.array(F.lit(9)))), opener).alias("m"))
    return rows.select("traj_id", "step_num", F.size("m.prompt").cast("long").alias("prompt"), F.col("m.response_length").cast("long").alias("response_length"), masks.run_lengths(F.col("m.mask")).alias("runs"))


@query(f"WITH {STEPS} SELECT traj_id, step_num, CASE WHEN step_num % 2 = 0 THEN '0x2,1x' || {_words('response')} ELSE '1x' || {_words('response')} END AS runs FROM steps WHERE response IS NOT NULL")
def opener_masks(spark, sf_dir):
    opener = F.array(F.lit(7), F.lit(8))
    ids = F.when(F.col("step_num") % 2 == 0, F.concat(opener, _ids(F.col("response")))).otherwise(_ids(F.col("response")))
    return views.steps(spark, sf_dir).where("response IS NOT NULL").select("traj_id", "step_num", masks.run_lengths(masks.opener_masked(ids, opener)).alias("runs"))


@query(f"WITH {STEPS} SELECT traj_id, step_num, CASE step_num % 4 WHEN 0 THEN '' WHEN 1 THEN 'length' WHEN 2 THEN 'no supervision' ELSE 'suffix' END AS errors FROM steps WHERE response IS NOT NULL")
def mask_checks(spark, sf_dir):
    k, ids = F.col("step_num") % 4, _ids(F.concat_ws(" ", "observation", "response"))
    mask = F.when(k == 1, masks.ones(F.size(ids) + 1)).when(k == 2, masks.zeros(F.size(ids))).otherwise(masks.ones(F.size(ids)))
    suffix = F.when(k == 3, F.array(F.lit(-1))).otherwise(_ids(F.col("response")))
    return views.steps(spark, sf_dir).where("response IS NOT NULL").select("traj_id", "step_num", F.array_join(masks.mask_errors(ids, mask, suffix), ",").alias("errors"))


@query(f"WITH {STEPS} SELECT traj_id, step_num, {_words('observation')} + {_words('response')} + 2 + 1 AS n_tokens, '1x' || {_words('response')} || ',0x2,1x1' AS runs, round(0.25 * {_words('response')} + 0.5, 6)::DOUBLE AS log_prob, {_words('response')} AS action_output_len, 2 AS inserted_compression_prompt_len, 1 AS memory_output_len FROM steps WHERE response IS NOT NULL")
def merged_step_samples(spark, sf_dir):
    prompt, output = _ids(F.col("observation")), _ids(F.col("response"))
    turn = lambda p, o, x: F.struct(p.alias("prompt"), o.alias("output"), F.array_repeat(F.lit(x), F.size(o)).alias("log_probs"))
    made = masks.merged_turns(turn(prompt, output, 0.25), turn(F.concat(prompt, output, F.array(F.lit(1), F.lit(2))), F.array(F.lit(3)), 0.5))
    rows = views.steps(spark, sf_dir).where("response IS NOT NULL").select("traj_id", "step_num", made.alias("m"))
    total = F.round(F.aggregate("m.log_probs", F.lit(0.0), lambda a, x: a + x), 6)
    return rows.select("traj_id", "step_num", F.size("m.tokens").cast("long").alias("n_tokens"), masks.run_lengths(F.col("m.mask")).alias("runs"), total.alias("log_prob"), *(F.col(f"m.segments.{c}").cast("long").alias(c) for c in ("action_output_len", "inserted_compression_prompt_len", "memory_output_len")))


@query(f"WITH {STEPS} SELECT traj_id, step_num, {_words('observation')} + {_words('response')} AS n_tokens, '1x' || {_words('response')} AS runs FROM steps WHERE response IS NOT NULL")
def reasoning_samples(spark, sf_dir):
    output = _ids(F.col("response"))
    made = masks.single_output(F.struct(_ids(F.col("observation")).alias("prompt"), output.alias("output"), F.array_repeat(F.lit(0.0), F.size(output)).alias("log_probs")))
    return views.steps(spark, sf_dir).where("response IS NOT NULL").select("traj_id", "step_num", F.size(made["tokens"]).cast("long").alias("n_tokens"), masks.run_lengths(made["mask"]).alias("runs"))


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", _ids(F.col("text")).alias("ids")))).alias("t"))


@query("SELECT conv_id, sum(len(string_split(text, ' ')))::BIGINT AS n, sum(CASE WHEN role = 'assistant' THEN len(string_split(text, ' ')) ELSE 0 END)::BIGINT AS trained FROM conversations GROUP BY 1")
def message_masks(spark, sf_dir):
    made = _turns(spark, sf_dir).select("conv_id", masks.by_message(F.col("t")).alias("m"))
    return made.select("conv_id", F.size("m.tokens").cast("long").alias("n"), F.aggregate("m.mask", F.lit(0).cast("long"), lambda a, b: a + b).alias("trained"))


@query(
    """WITH numbered AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
wrong AS (SELECT conv_id, min(k) AS k FROM numbered WHERE role = 'assistant' AND (k = 1 OR before = 'assistant') GROUP BY 1),
good AS (SELECT n.* FROM numbered n LEFT JOIN wrong w USING (conv_id) WHERE w.k IS NULL OR n.k < w.k)
SELECT c.conv_id, coalesce(sum(len(string_split(text, ' ')) + CASE WHEN role = 'assistant' THEN 1 WHEN good.k > 1 THEN 2 + CASE WHEN before = 'assistant' THEN 1 ELSE 0 END ELSE 0 END), 0)::BIGINT AS n,
  coalesce(sum(CASE WHEN role = 'assistant' THEN len(string_split(text, ' ')) + 1 ELSE 0 END), 0)::BIGINT AS trained, any_value(w.k) IS NOT NULL AS failed
FROM (SELECT DISTINCT conv_id FROM numbered) c LEFT JOIN good USING (conv_id) LEFT JOIN wrong w ON w.conv_id = c.conv_id GROUP BY 1"""
)
def accumulated_tokens(spark, sf_dir):
    end, newline = -1, -2
    rows = table(spark, sf_dir, "conversations").where("role <> 'system'")
    ids = F.when(F.col("role") == "assistant", F.concat(_ids(F.col("text")), F.array(F.lit(end)))).otherwise(_ids(F.col("text")))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", ids.alias("ids")))).alias("t"))
    made = turns.select("conv_id", masks.accumulated(F.col("t"), end, newline, F.array(F.lit(7), F.lit(8))).alias("m"))
    return made.select("conv_id", F.size("m.tokens").cast("long").alias("n"), F.aggregate("m.mask", F.lit(0).cast("long"), lambda a, b: a + b).alias("trained"), F.col("m.error").isNotNull().alias("failed"))


@query(f"WITH {LINES}, marked AS (SELECT l_orderkey AS traj_id, n AS step_num, sum((l_quantity > 25)::INT) OVER w > 2 OR l_tax > 0.07 AS done FROM lines WINDOW w AS (PARTITION BY l_orderkey ORDER BY n)) SELECT traj_id, step_num FROM marked QUALIFY coalesce(sum(done::INT) OVER (PARTITION BY traj_id ORDER BY step_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0")
def stopped_state_runs(spark, sf_dir):
    rows = lines(spark, sf_dir).select(F.col("l_orderkey").alias("traj_id"), F.col("n").alias("step_num"), (F.col("l_quantity") > 25).alias("parse_error"), F.lit(False).alias("terminated"), F.lit(False).alias("truncated"), (F.col("l_tax") > 0.07).alias("malformed"))
    return rewards.stopped_at(rows, memory="malformed").select("traj_id", "step_num")


# -- masks by a tokenizer's file; beyond SQL, tests/test_token_spans.py tokenizes every prefix ---------------------------


def _tokenizer():
    """The public byte-level vocabulary, whose `<|endoftext|>` ends an answer."""
    import public_tokenizers

    return token_spans.FileTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


@query(None)
def tokenizer_spans(spark, sf_dir):
    """Spans of an action and a memory turn; in every third step the prompt ends in two line feeds, which some answers change."""
    odd = F.col("step_num") % 3 == 1
    part = lambda on, *c: F.struct(F.concat(*c).alias("text"), F.lit(on).alias("trained"))
    end = F.lit("<|im_end|>\n")
    segments = F.array(
        part(False, F.lit("<|im_start|>user\n"), "observation", end, F.lit("<|im_start|>assistant\n"), F.when(odd, "\n").otherwise("")),
        part(True, F.when(odd, "").otherwise("<think>\n"), "response", end),
        part(False, F.lit("<|im_start|>user\nCompress.<|im_end|>\n<|im_start|>assistant\n")),
        part(True, F.lit("<memory>"), F.col("step_num").cast("string"), F.lit("</memory>"), end),
    )
    rows = views.steps(spark, sf_dir).where("response IS NOT NULL").select("traj_id", "step_num", segments.alias("segments"))
    made = token_spans.prefix_spans(rows, _tokenizer(), opener="<think>\n")
    n = F.when(F.col("spans.tokens").isNotNull(), F.size("spans.tokens"))
    runs = F.when(F.col("spans.mask").isNotNull(), masks.run_lengths(F.col("spans.mask")))
    return made.select("traj_id", "step_num", n.alias("n_tokens"), "spans.prompt_length", "spans.response_length", runs.alias("runs"), token_spans.ids_crc32(F.col("spans.tokens")).alias("ids_crc32"), "spans.error")


@query(None)
def tokenizer_turns(spark, sf_dir):
    """Conversations as an accumulator appends them, each turn tokenized once."""
    tokenizer = _tokenizer()
    end = tokenizer.id_of("<|endoftext|>")
    rows = table(spark, sf_dir, "conversations").where("role <> 'system'").select("conv_id", "turn", "role", "text")
    ids = token_spans.turn_ids(rows, tokenizer, end)
    turns = ids.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "ids"))).alias("t"))  # one conversation's own turns
    opener = F.array(*map(F.lit, tokenizer("<|im_start|>assistant\n<think>\n")))
    asked = F.transform("t", lambda t, i: F.when((i == 0) & (t["role"] != "assistant"), t.withField("ids", F.concat(t["ids"], opener))).otherwise(t))  # the first request ends in the opener, too
    made = turns.select("conv_id", masks.accumulated(asked, end, token_spans.newline_id(tokenizer), opener).alias("m"))
    trained = F.aggregate("m.mask", F.lit(0).cast("long"), lambda a, b: a + b)
    return made.select("conv_id", F.size("m.tokens").cast("long").alias("n"), trained.alias("trained"), token_spans.ids_crc32(F.col("m.tokens")).alias("ids_crc32"), F.col("m.error").isNotNull().alias("failed"))
