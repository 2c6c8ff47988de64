"""Platform B rollout logs -> ``ev``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import prompts as P, text as X
from ..functions.timez import DayWindow, parse_instant
from ..operators.joins import carry_state, exit_code_for_output, file_plan, flag_subagent_files, tool_name_for_result
from ..operators.filters import in_window, nonzero_usage
from ..operators.scan import CHUNK_WIDTH
from ..operators.tokens import COUNTERS, token_deltas
from ..schema import STRIDE, as_ev
from ..session import stage
from .logs import flag_at, get, has_shape, kind_of, number_at, text_at
from .normalize_a import slot_of

SHELL_NAMES = ["exec_command", "local_shell_call", "shell"]
OUTPUT_TYPES = ["function_call_output", "local_shell_call_output", "custom_tool_call_output"]
USAGE_FIELDS = {"input": "input_tokens", "cached_input": "cached_input_tokens", "output": "output_tokens",
                "reasoning_output": "reasoning_output_tokens", "total": "total_tokens"}


def output_outcome(output: Column) -> tuple[Column, Column, Column]:
    """(exit code, text, interrupted) of an output text that may hold JSON."""
    v = F.try_parse_json(output)
    shaped = F.coalesce(F.rlike(kind_of(v), F.lit("^(OBJECT|ARRAY)")), F.lit(False))
    code = get(v, "$.metadata.exit_code", "variant")
    code = F.when(code.isNotNull(), code).otherwise(get(v, "$.exit_code", "variant"))
    exit_code = F.when(shaped & kind_of(code).isin("BIGINT", "DOUBLE"), code.cast("bigint"))
    text = F.when(shaped, F.coalesce(text_at(v, "$.output"), output)).otherwise(F.coalesce(output, F.lit("")))
    interrupted = shaped & (flag_at(v, "$.metadata.interrupted") | flag_at(v, "$.interrupted"))
    return exit_code, text, F.coalesce(interrupted, F.lit(False))


def project_records(good: DataFrame) -> DataFrame:
    """Typed header fields; the payload stays a variant."""
    r = F.col("rec")
    return good.select(
        "file_id", F.col("line_no").alias("seq"), text_at(r, "$.type").alias("type"),
        parse_instant(text_at(r, "$.timestamp")).alias("ts"), get(r, "$.payload", "variant").alias("payload"),
        text_at(r, "$.payload.type").alias("ptype"))


def explode_changes(records: DataFrame) -> DataFrame:
    """One row per changed file of a patch event with its line counts; paths are cut to base names."""
    changes = F.try_variant_get("payload", "$.changes", "map<string,variant>")
    rows = records.select("*", F.posexplode(F.map_entries(changes)).alias("block_no", "_c"))
    diff = F.coalesce(text_at(F.col("_c.value"), "$.unified_diff"), F.lit(""))
    base = X.base_name(F.col("_c.key"))
    base = F.when(base == "", F.col("_c.key")).otherwise(base)
    ext = F.when(F.instr(base, ".") > 0, F.lower(F.substring_index(base, ".", -1))).otherwise(F.lit(""))
    return rows.select("*", base.alias("file_base"), ext.alias("file_ext"), X.diff_added(diff).cast("bigint").alias("lines_added"),
                       X.diff_removed(diff).cast("bigint").alias("lines_removed")).drop("_c")


def user_text(payload: Column) -> Column:
    """Text of a user message: its content, text or message field, a string or a list of parts; white space becomes one space."""
    v = F.coalesce(*[get(payload, f"$.{f}", "variant") for f in ("content", "text", "message")])
    items = F.try_variant_get(v, "$", "array<variant>")
    parts = F.transform(items, lambda b: F.when(kind_of(b) == "STRING", b.cast("string")).otherwise(
        F.coalesce(*[text_at(b, f"$.{f}") for f in ("text", "input_text", "content", "message")])))
    text = F.when(kind_of(v) == "STRING", v.cast("string")).otherwise(F.array_join(F.array_compact(parts), " "))
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def carried_records(good: DataFrame, width: int = CHUNK_WIDTH) -> DataFrame:
    """Records with the carried session, repo, model and source of their file and its sub-agent flag."""
    rec = stage(project_records(good), "parsed-b")
    p = F.col("payload")
    meta, turn = F.col("type") == "session_meta", F.col("type") == "turn_context"
    cwd = text_at(p, "$.cwd")
    state = carry_state(rec.withColumns({
        "set_model": F.when(turn, text_at(p, "$.model")), "set_repo": F.when(meta & (cwd != ""), X.repo_name(cwd)),
        "set_session": F.when(meta, text_at(p, "$.id")),
        "set_source": F.when(meta & text_at(p, "$.source").isNotNull(), F.nullif(X.source_key(text_at(p, "$.source")), F.lit("(unknown)"))),
    }), width, flag_subagent_files(rec))
    return state.select(
        "file_id", "seq", "type", "ts", "payload", "ptype", F.coalesce("cur_session", F.lit("")).alias("session_id"),
        F.coalesce("cur_repo", F.lit("(unknown)")).alias("repo"), F.coalesce("cur_model", F.lit("")).alias("model"),
        F.coalesce("cur_source", F.lit("(unknown)")).alias("source"), F.coalesce("is_sidechain", F.lit(False)).alias("is_sidechain"))


def session_facts(good: DataFrame) -> DataFrame:
    """One row per main-chain file: session, folder or remote as repository key, source, branch, and the last model.

    The first non-empty value of a header field counts, since a resumed log repeats its header.
    """
    p, kind = F.col("payload"), F.col("type")
    rec = project_records(good).filter(kind.isin("session_meta", "turn_context"))
    fields = {"session_id": "id", "cwd": "cwd", "_source": "source", "origin": "git_origin_url", "branch": "git_branch"}

    def first(path: str) -> Column:
        value = F.when(kind == "session_meta", text_at(p, f"$.{path}"))
        return F.coalesce(F.min_by(value, F.when(value != "", F.col("seq"))), F.lit(""))

    model = F.when(kind == "turn_context", text_at(p, "$.model"))
    facts = rec.groupBy("file_id").agg(
        *[first(path).alias(name) for name, path in fields.items()], F.coalesce(F.max_by(model, F.when(model != "", F.col("seq"))), F.lit("")).alias("model"))
    own = facts.join(flag_subagent_files(project_records(good)).hint("merge"), "file_id", "left").filter(~F.coalesce(F.col("is_sidechain"), F.lit(False)))
    return own.select("file_id", "session_id", X.repo_key(F.col("origin"), F.col("cwd")).alias("repo"), X.source_key(F.col("_source")).alias("source"), "branch", "model")


def plan_of_file(good: DataFrame) -> DataFrame:
    """First plan label of each file, read from usage events of any day."""
    rec = project_records(good).filter((F.col("type") == "event_msg") & (F.col("ptype") == "token_count"))
    return file_plan(rec.withColumn("plan", text_at(F.col("payload"), "$.rate_limits.plan_type")))


def normalize_b(good: DataFrame, window: DayWindow | None = None, tz: str = "UTC", width: int = CHUNK_WIDTH) -> DataFrame:
    """Event rows of platform B. Carried state and counters see every record; the window only cuts what is emitted."""
    # Written once: every branch below reads only its record types from the Parquet table.
    rec = stage(carried_records(good, width), "carried-b")
    p, ptype = F.col("payload"), F.col("ptype")
    main = ~F.col("is_sidechain")

    def cut(df: DataFrame) -> DataFrame:
        timed = df.filter(F.col("ts").isNotNull())
        return in_window(timed, window, tz) if window else timed

    common = [F.lit("B").alias("platform"), "file_id", "ts", "session_id", "repo", "is_sidechain", "source", "model"]
    base = F.col("seq") * STRIDE
    no = F.lit(False).alias("is_boundary")
    message, response = F.col("type") == "event_msg", F.col("type") == "response_item"

    usage = rec.filter(message & (ptype == "token_count"))
    last = {f"last_{c}": number_at(p, f"$.info.last_token_usage.{f}") for c, f in USAGE_FIELDS.items()}
    total = {f"total_{c}": number_at(p, f"$.info.total_token_usage.{f}") for c, f in USAGE_FIELDS.items()}
    counters = usage.withColumns({
        **last, **total, "has_last": has_shape(p, "$.info.last_token_usage", "OBJECT"),
        "has_total": has_shape(p, "$.info.total_token_usage", "OBJECT"), "value": number_at(p, "$.info.model_context_window")}).drop("payload")
    token_rows = cut(nonzero_usage(token_deltas(counters, width))).select(
        *common, base.alias("seq"), F.lit("tokens").alias("kind"), no, "input", "cached_input", "output", "reasoning_output",
        F.lit(0).cast("bigint").alias("cache_creation"), "total", F.nullif("value", F.lit(0)).alias("value"))
    sub_rows = token_rows.filter(F.col("is_sidechain")).select(*common[1:], "platform", (F.col("seq") + 1).alias("seq"), F.lit("subagent").alias("kind"), no)

    # Turn starts with their enumerated settings.
    turns = cut(rec.filter(main & (F.col("type") == "turn_context")))
    sandbox = F.coalesce(text_at(p, "$.sandbox_policy.mode"), text_at(p, "$.sandbox_policy.type"))
    mode = F.coalesce(text_at(p, "$.collaboration_mode.mode"), text_at(p, "$.collaboration_mode"))
    settings = (("effort", text_at(p, "$.effort")), ("approval_policy", text_at(p, "$.approval_policy")), ("sandbox", sandbox),
                ("collaboration_mode", mode), ("personality", text_at(p, "$.personality")))
    entry = lambda slot, kind, field, label: F.struct(F.lit(slot).alias("slot"), F.lit(kind).alias("kind"), F.lit(field).cast("string").alias("label_field"), label.cast("string").alias("label"))
    entries = F.array_compact(F.array(entry(0, "turn", None, F.lit(None)), *[
        F.when(label != "", entry(i + 1, "label", field, label)) for i, (field, label) in enumerate(settings)]))
    turn_rows = turns.withColumn("_e", F.explode(entries)).select(
        *common, (base + F.col("_e.slot")).alias("seq"), "_e.kind", (F.col("_e.kind") == "turn").alias("is_boundary"), "_e.label_field", "_e.label")

    mark = (F.when((F.col("type") == "compacted") | (message & (ptype == "context_compacted")), F.lit("compaction"))
            .when(message & ptype.isin("error", "stream_error"), F.lit("api_error")).when(message & (ptype == "turn_aborted"), F.lit("abort")))
    mark_rows = cut(rec.filter(main).withColumn("kind", mark).filter(F.col("kind").isNotNull())).select(*common, base.alias("seq"), "kind", no)

    patches = explode_changes(cut(rec.filter(main & message & (ptype == "patch_apply_end"))))
    edit_rows = patches.select(*common, (base + slot_of(F.col("block_no"), 2)).alias("seq"), F.lit("edit").alias("kind"), no, "lines_added", "lines_removed",
                               F.lit(False).alias("user_modified"))
    patch_calls = patches.select(*common, (base + slot_of(F.col("block_no"), 2, 17)).alias("seq"), F.lit("tool_call").alias("kind"), no, F.lit("file").alias("tool_kind"),
                                 "file_base", "file_ext", F.lit(True).alias("is_edit"), F.lit(False).alias("long_run"))

    # Prompts: a person's messages in main files. Turns stay the episode boundaries of this platform.
    role = F.coalesce(text_at(p, "$.role"), text_at(p, "$.author.role"))
    said = cut(rec.filter(main & ((role == "user") | F.col("type").isin("user_message", "user_prompt", "input_message"))))
    said = said.withColumn("prompt_text", user_text(p)).filter(P.is_human_prompt(F.col("prompt_text"), F.lit(False)))
    prompt_rows = said.select(*common, (base + 6).alias("seq"), F.lit("prompt").alias("kind"), no, "prompt_text",
                              P.is_correction(F.col("prompt_text")).alias("is_correction"), P.is_thinking(F.col("prompt_text")).alias("is_thinking"))

    items = rec.filter(main & response)
    name = text_at(p, "$.name")
    is_call = (ptype == "function_call")
    shell = is_call & name.isin(SHELL_NAMES)
    command = X.unwrap_shell(X.command_from_args(text_at(p, "$.arguments")))
    tool = (F.when(shell | (ptype == "local_shell_call"), F.lit("shell")).when(ptype == "web_search_call", F.lit("web"))
            .when(is_call | ptype.isin("custom_tool_call", "image_generation_call"), F.lit("other")))
    calls = cut(items.withColumn("tool_kind", tool).filter(F.col("tool_kind").isNotNull())).withColumn("command", F.when(shell, command))
    call_rows = calls.select(*common, base.alias("seq"), F.lit("tool_call").alias("kind"), no, "tool_kind", "command", F.lit(False).alias("is_edit"),
                             P.is_long_run(F.col("command")).alias("long_run"))

    # Outputs: the exit code event wins over what the output text says.
    code, text, interrupted = output_outcome(text_at(p, "$.output"))
    is_exit = message & (ptype == "exec_command_end")
    is_output = response & ptype.isin(OUTPUT_TYPES)
    exits = rec.filter(main & (is_exit | is_output)).select(
        *common, "seq", F.coalesce(text_at(p, "$.call_id"), F.lit("")).alias("call_id"), is_output.alias("is_output"),
        F.when(is_exit & text_at(p, "$.call_id").isNotNull() & kind_of(get(p, "$.exit_code", "variant")).isin("BIGINT", "DOUBLE"),
               get(p, "$.exit_code", "bigint")).alias("event_exit"),
        F.when(is_output, code).alias("parsed_exit"), F.when(is_output, text).alias("_text"), F.when(is_output, interrupted).alias("_stop"))
    outcomes = cut(exit_code_for_output(exits, width)).withColumn("error_category", F.when(F.col("is_error"), X.classify_error(F.col("_text"))))
    uses = cut(items.filter(is_call)).select(F.concat_ws(":", "file_id", text_at(p, "$.call_id")).alias("call_id"), name.alias("tool_name"), "file_id", "seq")
    uses = uses.filter(F.col("call_id") != F.col("file_id"))
    named = tool_name_for_result(outcomes.withColumn("call_id", F.concat_ws(":", "file_id", "call_id")), uses)
    named = named.withColumn("tool_name", F.when(F.col("tool_name") == "(unknown)", F.lit("shell")).otherwise(F.col("tool_name")))
    result_rows = named.select(*common[1:], "platform", (F.col("seq") * STRIDE).alias("seq"), F.lit("tool_result").alias("kind"), no, "tool_name", "is_error", "error_category")
    stop_rows = outcomes.filter("_stop").select(*common[1:], "platform", (F.col("seq") * STRIDE + 1).alias("seq"), F.lit("interrupt").alias("kind"), no)

    # Client and repository identity, once per file with main-chain usage.
    meta = rec.filter(F.col("type") == "session_meta").groupBy("file_id").agg(
        F.max_by(text_at(p, "$.originator"), F.when(text_at(p, "$.originator") != "", F.col("seq"))).alias("originator"),
        F.bool_or(F.coalesce(get(p, "$.git.repository_url") != "", F.lit(False)) | F.coalesce(get(p, "$.git.commit_hash") != "", F.lit(False))).alias("git"),
        F.bool_or(F.coalesce(text_at(p, "$.model_provider") != "openai", F.lit(False)) & (F.coalesce(text_at(p, "$.model_provider"), F.lit("")) != "")).alias("other"))
    live = token_rows.filter(~F.col("is_sidechain")).groupBy("file_id").agg(
        F.min("ts").alias("ts"), F.min_by("session_id", "seq").alias("session_id"), F.min_by("repo", "seq").alias("repo"),
        F.min_by("source", "seq").alias("source"), F.min_by("model", "seq").alias("model"), F.max("seq").alias("seq"))
    seen = live.join(meta.hint("merge"), "file_id")
    tags = F.array_compact(F.array(
        F.when(F.col("originator") != "", entry(2, "label", "originator", F.col("originator"))),
        F.when(F.col("git"), entry(3, "label", "git_identity", F.lit("true"))),
        F.when(F.col("other"), entry(4, "label", "other_provider", F.lit("true")))))
    id_rows = seen.withColumn("is_sidechain", F.lit(False)).withColumn("_e", F.explode(tags)).select(
        *common, (F.col("seq") + F.col("_e.slot")).alias("seq"), "_e.kind", no, "_e.label_field", "_e.label")

    out = as_ev(token_rows)
    for part in (sub_rows, turn_rows, prompt_rows, mark_rows, edit_rows, patch_calls, call_rows, result_rows, stop_rows, id_rows):
        out = out.unionByName(as_ev(part))
    return out


def digest_items_b(good: DataFrame) -> DataFrame:
    """Assistant messages, call arguments and outputs; reasoning and other roles never appear."""
    rec = stage(project_records(good), "digest-b")
    p, ptype = F.col("payload"), F.col("ptype")
    sessions = rec.filter((F.col("type") == "session_meta") & text_at(p, "$.id").isNotNull()).groupBy("file_id").agg(
        F.max_by(text_at(p, "$.id"), "seq").alias("session_id"))
    parts = F.transform(F.try_variant_get(p, "$.content", "array<variant>"), lambda c: F.coalesce(get(c, "$.text"), get(c, "$.input_text"), F.lit("")))
    said = F.when((ptype == "message") & (text_at(p, "$.role") == "assistant"), F.array_join(parts, " "))
    args = F.when(kind_of(get(p, "$.arguments", "variant")) == "STRING", text_at(p, "$.arguments")).otherwise(
        F.coalesce(F.to_json(get(p, "$.arguments", "variant")), F.lit("{}")))
    called = F.when(ptype == "function_call", F.concat_ws(" ", F.coalesce(text_at(p, "$.name"), F.lit("")), args))
    raw = F.coalesce(text_at(p, "$.output"), F.to_json(get(p, "$.output", "variant")), F.lit('""'))
    output = F.when(ptype.isin(OUTPUT_TYPES), F.coalesce(text_at(F.try_parse_json(raw), "$.output"), raw))
    kind = F.when(said.isNotNull(), F.lit("ASSISTANT")).when(called.isNotNull(), F.lit("TOOL")).when(output.isNotNull(), F.lit("RESULT"))
    rows = rec.filter(F.col("type") == "response_item").select(
        "file_id", "seq", "ts", kind.alias("kind"), F.coalesce(said, called, output).alias("text")).filter(X.strip_ws(F.col("text")) != "")
    return rows.join(sessions, "file_id").select("session_id", "ts", "file_id", "seq", F.lit(0).alias("block_no"), "kind", "text")
