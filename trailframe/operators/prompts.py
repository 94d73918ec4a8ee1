"""Prompt rendering: observation sections, message lists and training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.functions import tree
from trailframe.functions.text import strip, truncate_chars
from trailframe.operators import history

SYSTEM = "You operate a web browser to reach the user's goal. Think first, then give one action."
ACTIONS = "# Actions\nReply with <think>...</think><action>...</action>."
FINAL = "# Next action\nDecide what to do next."
PRIVILEGED = "# Known about the task\n"
SITES = "# Sites that may be visited\n"
COMPRESS = "Summarise what has been learned so far inside <memory>...</memory>."


def tabs_section(urls: Column, titles: Column, active: Column) -> Column:
    """A line for each open tab; the shorter of the two lists decides."""
    n = F.least(F.size(urls), F.size(titles))
    tabs = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("Tab "), (i - 1).cast("string"), F.when(F.array_contains(active, i - 1), F.lit(" (active tab)")).otherwise(F.lit("")), F.lit(":\n    Title: "), F.element_at(titles, i), F.lit("\n    URL: "), F.element_at(urls, i)))
    return F.concat(F.lit("# Open tabs\n"), F.when(n > 0, F.array_join(tabs, "\n")).otherwise(F.lit("")))


def viewport_section(state: Column) -> Column:
    """Width, height (labelled "Hight") and scroll offsets."""
    return F.concat_ws("\n", F.lit("# Viewport"), *(F.concat(F.lit(f"{label}: "), state[key].cast("string")) for label, key in (("Width", "viewport_width"), ("Hight", "viewport_height"), ("Scroll X", "scroll_x"), ("Scroll Y", "scroll_y"))))


def tree_section(tree: Column, most: int | None = None) -> Column:
    return F.concat(F.lit("# Page\n"), tree if most is None else truncate_chars(tree, most))


def error_section(error: Column) -> Column:
    """Null for an empty or absent error."""
    return F.when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit("# Error of the last action\n"), error))


def joined(*parts: Column) -> Column:
    """Parts that are there, in order, newline between."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), "\n")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def flatten_messages(messages: Column) -> Column:
    """role: content, a line each."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def single_turn(steps: DataFrame, history_text: Column) -> DataFrame:
    """(traj_id, step_num, prompt): system and user message, and the answer where there is one."""
    shown = steps.withColumn("_history", history_text)
    prompt = F.filter(F.array(message("system", F.lit(SYSTEM)), message("user", user_content(F.col("_history"))), F.when(F.col("response").isNotNull(), message("assistant", F.col("response")))), lambda m: m.isNotNull())
    return shown.select("traj_id", "step_num", prompt.alias("prompt"))


def compression_turn(steps: DataFrame, history_text: Column, memory: Column) -> DataFrame:
    """Action and compression in one row: system, user, assistant, user, assistant. Steps without a response have none."""
    answered = steps.withColumns({"_history": history_text, "_memory": memory}).where(F.col("response").isNotNull())
    return answered.select("traj_id", "step_num", F.concat(F.array(message("system", F.lit(SYSTEM)), message("user", user_content(F.col("_history"))), message("assistant", F.col("response"))), F.array(message("user", F.lit(COMPRESS)), message("assistant", F.col("_memory")))).alias("prompt"))


def user_content(history_text: Column, observation: Column | None = None, sites: Column | None = None, privileged: Column | None = None, actions: str = ACTIONS, final: str = FINAL) -> Column:
    """The parts of a user turn in order: goal, observation, actions, history after the first step, sites, privileged, what next."""
    parts = [
        F.concat(F.lit("# Goal\n"), F.col("goal")), tree_section(F.col("observation")) if observation is None else observation, F.lit(actions),
        F.when(F.col("step_num") > 0, F.concat(F.lit("# History\n"), F.coalesce(history_text, F.lit("")))),
        None if sites is None else F.concat(F.lit(SITES), F.array_join(sites, "\n")), None if privileged is None else F.concat(F.lit(PRIVILEGED), privileged), F.lit(final),
    ]
    return joined(*(p for p in parts if p is not None))


def observation_content(o: Column) -> Column:
    """Sections of an observation in fixed order, as its flags ask: tabs, tree, viewport, error.

    With the viewport filter the tree keeps what is visible there; a tree of more than axtree_max_tokens characters is cut.
    A screenshot is an error.
    """
    filtered = F.when(F.coalesce(o["filter_viewport"], F.lit(False)), tree.keep_visible(o["axtree"], tree.visible_ids(o["extra_element_properties"]))).otherwise(o["axtree"])
    cut = F.when(F.length(filtered) > o["axtree_max_tokens"], F.concat(F.left(filtered, o["axtree_max_tokens"]), F.lit("\n... (truncated)"))).otherwise(filtered)
    return joined(
        F.when(F.coalesce(o["use_tabs_info"], F.lit(False)), tabs_section(o["open_pages_urls"], o["open_pages_titles"], F.slice(o["active_page_index"], 1, 1))),
        F.when(F.coalesce(o["use_axtree"], F.lit(True)), tree_section(cut)),
        F.when(F.coalesce(o["filter_viewport"], F.lit(False)), viewport_section(o["viewport_state"])),
        F.when(F.coalesce(o["use_screenshot"], F.lit(False)), F.raise_error(F.lit("screenshots are not supported")).cast("string")),
        error_section(o["last_action_error"]),
    )


def state_memory_turn(steps: DataFrame, mode: str = "action", action: str = "action", memory: str = "memory", state: str = "state") -> DataFrame:
    """(traj_id, step_num, prompt): prompts that show past actions, and the last step's long memory and short state.

    Mode `action` ends with the user turn; `compression` adds the answer and the request to compress, of answered steps. A
    step whose step before has no memory or no state is an error, as nothing sound can seed its prompt.
    """
    if mode not in ("action", "compression"):
        raise ValueError(f"unknown mode {mode}")
    line = F.concat(F.lit("## Step "), F.col("step_num").cast("string"), F.lit("\n"), F.coalesce(F.concat(F.lit("<action>\n"), F.col(action), F.lit("\n</action>")), F.col("response"), F.lit("")))
    shown = steps.withColumns({"_actions": history.append_history(line), "_before": history.state_history(F.col(memory), F.col(state))})
    known = F.col("_before.memory").isNotNull() & F.col("_before.state").isNotNull()
    told = F.concat(F.lit("# Past actions\n"), F.col("_actions"), F.lit("\n# Memory\n"), F.col("_before.memory"), F.lit("\n# State after step "), (F.col("step_num") - 1).cast("string"), F.lit("\n"), F.col("_before.state"))
    name = F.concat(F.lit("no memory before step "), F.col("step_num").cast("string"), F.lit(" of "), F.col("traj_id").cast("string"))
    history_text = F.when(F.col("step_num") == 0, F.lit("")).when(known, told).otherwise(F.raise_error(name).cast("string"))
    prompt = F.array(message("system", F.lit(SYSTEM)), message("user", user_content(history_text)))
    if mode == "compression":
        shown = shown.withColumn("_prompt", prompt).where(F.col("response").isNotNull())
        prompt = F.concat("_prompt", F.array(message("assistant", F.col("response")), message("user", F.lit(COMPRESS))))
    return shown.select("traj_id", "step_num", prompt.alias("prompt"))


def conversation(steps: DataFrame, window: int | None) -> DataFrame:
    """(traj_id, step_num, prompt): system turn, goal and actions, then the last `window` steps as turns."""
    turns = history.multi_turn(steps, window)
    goal = F.concat(F.lit("# Goal\n"), F.col("goal"), F.lit(f"\n{ACTIONS}"))
    return turns.select("traj_id", "step_num", F.concat(F.array(message("system", F.lit(SYSTEM)), message("user", goal)), F.col("messages")).alias("prompt"))


def api_turn(steps: DataFrame, history_text: Column, actions: str, final: str) -> DataFrame:
    """(traj_id, step_num, prompt) for models behind an API: the single turn with two texts of its own."""
    shown = steps.withColumn("_history", history_text)
    return shown.select("traj_id", "step_num", F.array(message("system", F.lit(SYSTEM)), message("user", user_content(F.col("_history"), actions=actions, final=final))).alias("prompt"))


def or_default(c: Column, default: str) -> Column:
    """The text, or a phrase where it is null or empty."""
    return F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(F.lit(default))


def label_request(goal: Column, before: Column, answer: Column, candidate: Column | None = None, feedback: Column | None = None) -> Column:
    """Messages that ask for a step's memory, for a judgement on a candidate, or for its revision after feedback."""
    parts = [F.concat(F.lit("# Goal\n"), goal), F.concat(F.lit("# Memory before\n"), or_default(before, "(none yet)")), F.concat(F.lit("# Response\n"), or_default(answer, "(no response)"))]
    if candidate is not None:
        parts.append(F.concat(F.lit("# Candidate memory\n"), or_default(candidate, "(empty)")))
    if feedback is not None:
        parts.append(F.concat(F.lit("# Feedback\n"), or_default(feedback, "(no feedback)")))
    task = COMPRESS if candidate is None else "Judge the candidate memory." if feedback is None else "Revise the candidate memory."
    return F.array(message("system", F.lit(task)), message("user", joined(*parts)))


def few_shot_prompt(task: Column, examples: list[str], template: str = "# Examples\n{examples}\n# Task\n") -> Column:
    """A prompt with numbered example files before the task."""
    told = "\n".join(f"Trajectory {n}: {x}" for n, x in enumerate(examples))
    return F.concat(F.lit(template.format(examples=told)), task)


def chat_template(messages: Column, prefill: bool = True, clear_thinking: bool = True) -> Column:
    """Text-only chat markup: stripped contents between start and end marks, and the opener of the next answer.

    An answer's reasoning, what stands between its think tags, is shown before it; with `clear_thinking` only in answers
    after the last user turn, others lose it. A system turn that is not the first, and any other role, is an error.
    """
    last_user = F.greatest(F.array_max(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i))), F.lit(-1))

    def turn(m: Column, i: Column) -> Column:
        content = strip(m["content"])
        parts = F.split(content, "</think>", -1)
        thought = F.when(F.size(parts) > 1, strip(F.element_at(F.split(F.get(parts, F.lit(0)), "<think>", -1), -1))).otherwise(F.lit(""))
        answer = F.regexp_replace(F.element_at(parts, -1), r"\A\n+", "")
        shown = F.concat(F.lit("<think>\n"), thought, F.lit("\n</think>\n\n"), answer)
        body = F.when(m["role"] == "assistant", F.when(i > last_user, shown).otherwise(answer) if clear_thinking else shown).otherwise(content)
        wrong = F.when((m["role"] == "system") & (i > 0), F.lit("a system turn that is not the first")).when(~m["role"].isin("system", "user", "assistant"), F.concat(F.lit("role "), m["role"]))
        return F.when(wrong.isNull(), F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), body, F.lit("<|im_end|>\n"))).otherwise(F.raise_error(wrong).cast("string"))

    turns = F.array_join(F.transform(messages, turn), "")
    return F.concat(turns, F.lit("<|im_start|>assistant\n<think>\n")) if prefill else turns


def role_sequence_ok(messages: Column, roles: tuple[str, ...]) -> Column:
    return F.transform(messages, lambda m: m["role"]) == F.array(*map(F.lit, roles))


def append_actions(action: Column) -> Column:
    """Numbered actions of earlier steps."""
    return history.append_history(F.concat(F.lit("Step "), F.col("step_num").cast("string"), F.lit(": "), action))
