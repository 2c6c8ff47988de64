"""Platform A session logs -> ``ev``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import prompts as P, text as X
from ..functions.timez import DayWindow, parse_instant
from ..operators.filters import in_window
from ..operators.joins import dedup_key, dedup_with_max_usage, tool_name_for_result, with_session_source
from ..operators.usage import session_source
from ..schema import STRIDE, TOKEN_BUCKETS, as_ev
from ..session import stage
from .logs import flag_at, get, has_shape, kind_of, number_at, text_at


def slot_of(number: Column, step: int = 1, first: int = 16) -> Column:
    """Slot of a record's block; a record with more blocks than slots fails, it would run into the next line."""
    slot = F.lit(first) + number * step
    return F.when(slot < STRIDE - 2, slot).otherwise(F.raise_error(F.lit("a record has more blocks than slots")))


def block_text(v: Column) -> Column:
    """Text of a string, or of the string and text items of a list, joined by line breaks."""
    items = F.try_variant_get(v, "$", "array<variant>")
    texts = F.transform(items, lambda b: F.when(kind_of(b) == "STRING", b.cast("string")).when(
        text_at(b, "$.type") == "text", text_at(b, "$.text")))
    return F.when(kind_of(v) == "STRING", v.cast("string")).otherwise(F.coalesce(F.array_join(F.array_compact(texts), "\n"), F.lit("")))


def result_block_text(v: Column) -> Column:
    """Text of a result content: the string, or the item texts joined by spaces."""
    items = F.try_variant_get(v, "$", "array<variant>")
    texts = F.transform(items, lambda b: F.coalesce(text_at(b, "$.text"), F.lit("")))
    return F.when(kind_of(v) == "STRING", v.cast("string")).otherwise(F.coalesce(F.array_join(texts, " "), F.lit("")))


def project_records(good: DataFrame) -> DataFrame:
    """Typed record columns of every line with a readable time stamp; blocks stay variants."""
    r = F.col("rec")
    usage = {"input": "input_tokens", "cached_input": "cache_read_input_tokens", "output": "output_tokens",
             "cache_creation": "cache_creation_input_tokens"}
    is_assistant = text_at(r, "$.type") == "assistant"
    rows = good.select(
        "file_id", F.col("line_no").alias("seq"), text_at(r, "$.type").alias("type"), parse_instant(text_at(r, "$.timestamp")).alias("ts"),
        F.coalesce(text_at(r, "$.sessionId"), F.lit("")).alias("session_id"), X.repo_name(text_at(r, "$.cwd")).alias("repo"),
        F.coalesce(text_at(r, "$.gitBranch"), F.lit("")).alias("branch"), flag_at(r, "$.isSidechain").alias("is_sidechain"),
        flag_at(r, "$.isMeta").alias("is_meta"), flag_at(r, "$.isApiErrorMessage").alias("is_api_error"),
        F.trim(F.coalesce(text_at(r, "$.entrypoint"), F.lit(""))).alias("source"), text_at(r, "$.version").alias("version"),
        text_at(r, "$.permissionMode").alias("permission_mode"), text_at(r, "$.attributionSkill").alias("skill"),
        F.coalesce(text_at(r, "$.message.model"), F.lit("")).alias("model"),
        get(r, "$.message.content", "variant").alias("content"), get(r, "$.toolUseResult", "variant").alias("tool_result"),
        dedup_key(text_at(r, "$.message.id"), get(r, "$.requestId", "string"), text_at(r, "$.uuid")).alias("dedup_key"),
        *[F.when(is_assistant, number_at(r, f"$.message.usage.{path}")).alias(name) for name, path in usage.items()],
        F.when(is_assistant, F.lit(0)).cast("bigint").alias("reasoning_output"),
        number_at(r, "$.message.usage.server_tool_use.web_search_requests").alias("web_search_requests"),
        number_at(r, "$.message.usage.server_tool_use.web_fetch_requests").alias("web_fetch_requests"))
    total = F.col("input") + F.col("output") + F.col("cached_input") + F.col("cache_creation")
    return rows.withColumn("total", total)


def explode_blocks(records: DataFrame) -> DataFrame:
    """One row per content block with its position; records without a block list give none."""
    blocks = F.try_variant_get("content", "$", "array<variant>")
    return records.select("*", F.posexplode(blocks).alias("block_no", "block"))


def _patch_lines(sign: str) -> Column:
    hunks = F.try_variant_get("tool_result", "$.structuredPatch", "array<variant>")
    per = F.transform(hunks, lambda h: F.size(F.filter(
        F.coalesce(F.try_variant_get(h, "$.lines", "array<variant>"), F.array().cast("array<variant>")),
        lambda x: F.coalesce((kind_of(x) == "STRING") & F.startswith(x.cast("string"), F.lit(sign)), F.lit(False)))))
    return F.aggregate(per, F.lit(0), lambda a, b: a + b).cast("bigint")


def _use_rows(records: DataFrame) -> DataFrame:
    b = F.col("block")
    blocks = explode_blocks(records.filter(F.col("type") == "assistant")).filter(text_at(b, "$.type") == "tool_use")
    return blocks.select("*", F.coalesce(text_at(b, "$.name"), F.lit("")).alias("tool_name"), text_at(b, "$.id").alias("call_id"))


def normalize_a(good: DataFrame, window: DayWindow | None = None, tz: str = "UTC") -> DataFrame:
    """Deduplicated event rows of platform A.

    The window filter runs before the keep-first step, while the largest usage of a message, the tool names and
    the entry points are taken from all records.
    """
    # Parsed once; the kept records are written too because three branches read them.
    everything = stage(project_records(good), "parsed-a")
    timed = everything.filter(F.col("ts").isNotNull())
    kept = dedup_with_max_usage(in_window(timed, window, tz) if window else timed, everything)
    # A session's entry point is its first one in any record, also outside the window; one row per session.
    records = stage(with_session_source(kept, session_source(everything)).withColumn("source", F.coalesce("source", F.lit(""))), "kept-a")
    main = ~F.col("is_sidechain")
    user, assistant = F.col("type") == "user", F.col("type") == "assistant"
    common = [F.lit("A").alias("platform"), "file_id", "ts", "session_id", "repo", "branch", "is_sidechain", "source", "model"]
    base = F.col("seq") * STRIDE

    # Record-level rows: usage, prompt, marks and labels. One explode, one row per fact.
    text = block_text(F.col("content"))
    rec = records.withColumn("prompt_text", F.when(user & main, text))
    human = user & main & P.is_human_prompt(F.col("prompt_text"), F.col("is_meta"))
    patch = user & main & has_shape(F.col("tool_result"), "$.structuredPatch", "ARRAY")
    interrupted = user & main & flag_at(F.col("tool_result"), "$.interrupted")

    def fact(slot: int, kind: str, when: Column, field: str | None = None, label: Column | None = None) -> Column:
        return F.when(when, F.struct(
            F.lit(slot).alias("slot"), F.lit(kind).alias("kind"), F.lit(field).cast("string").alias("label_field"),
            (label if label is not None else F.lit(None)).cast("string").alias("label")))

    facts = F.array_compact(F.array(
        fact(0, "api_error", F.col("is_api_error") & main),
        fact(1, "label", F.col("version").isNotNull(), "version", F.col("version")),
        fact(2, "label", F.col("permission_mode").isNotNull(), "permission_mode", F.col("permission_mode")),
        fact(3, "label", F.col("skill").isNotNull(), "skill", F.col("skill")),
        fact(4, "attachment", F.col("type") == "attachment"), fact(5, "subagent", F.col("is_sidechain")),
        fact(6, "prompt", human), fact(7, "touch", user & main & ~human), fact(8, "tokens", assistant),
        fact(STRIDE - 2, "interrupt", interrupted), fact(STRIDE - 1, "edit", patch)))
    rows = rec.withColumn("_f", F.explode(facts)).select("*", "_f.*")
    kind = F.col("kind")
    only = lambda name, c: F.when(kind == name, c)
    record_rows = rows.select(
        *common, (base + F.col("slot")).alias("seq"), "kind", (kind == "prompt").alias("is_boundary"),
        *[only("tokens", F.col(c)).alias(c) for c in (*TOKEN_BUCKETS, "web_search_requests", "web_fetch_requests")],
        only("prompt", F.col("prompt_text")).alias("prompt_text"),
        only("prompt", P.is_correction(F.col("prompt_text"))).alias("is_correction"),
        only("prompt", P.is_thinking(F.col("prompt_text"))).alias("is_thinking"), "label_field", "label",
        only("edit", _patch_lines("+")).alias("lines_added"), only("edit", _patch_lines("-")).alias("lines_removed"),
        only("edit", flag_at(F.col("tool_result"), "$.userModified")).alias("user_modified"))

    b = F.col("block")
    at = (base + slot_of(F.col("block_no"))).alias("seq")
    calls = _use_rows(records.filter(main))
    name = F.col("tool_name")
    path = F.coalesce(text_at(b, "$.input.file_path"), F.lit(""))
    command = F.coalesce(text_at(b, "$.input.command"), F.lit(""))
    is_file, is_shell = X.tool_kind(name) == "file", name == "Bash"
    call_rows = calls.select(
        *common, at, F.lit("tool_call").alias("kind"), F.lit(False).alias("is_boundary"), "tool_name", X.tool_kind(name).alias("tool_kind"),
        F.when(is_shell, command).alias("command"), F.when(is_file & (path != ""), X.base_name(path)).alias("file_base"),
        F.when(is_file, X.ext_of(path)).alias("file_ext"), (is_file & (name != "Read")).alias("is_edit"),
        (is_shell & P.is_long_run(command)).alias("long_run"))

    results = explode_blocks(records.filter(user & main)).filter(text_at(b, "$.type") == "tool_result").select(
        *common, at, F.lit("tool_result").alias("kind"), F.lit(False).alias("is_boundary"), text_at(b, "$.tool_use_id").alias("call_id"),
        flag_at(b, "$.is_error").alias("is_error"),
        F.when(flag_at(b, "$.is_error"), X.classify_error(result_block_text(get(b, "$.content", "variant")))).alias("error_category"))
    uses = _use_rows(everything).select("call_id", "tool_name", "file_id", "seq", "block_no")
    result_rows = tool_name_for_result(results, uses, "file_id", "seq", "block_no")
    return as_ev(record_rows).unionByName(as_ev(call_rows)).unionByName(as_ev(result_rows))


def digest_items_a(good: DataFrame) -> DataFrame:
    """(session_id, pos keys, kind, text) of assistant texts, tool inputs and results; thinking blocks never appear.

    Rows are ordered by time, missing time first, then file and line; use ``number_items`` before packing.
    """
    from ..operators.content import tool_input_summary
    r = F.col("rec")
    base = stage(good.select(
        flag_at(r, "$.isSidechain").alias("is_sidechain"), "file_id", F.col("line_no").alias("seq"), F.coalesce(text_at(r, "$.sessionId"), F.lit("")).alias("session_id"),
        parse_instant(text_at(r, "$.timestamp")).alias("ts"), text_at(r, "$.type").alias("type"),
        get(r, "$.message.content", "variant").alias("content"), get(r, "$.toolUseResult", "variant").alias("tool_result")
    ), "digest-a").filter(~F.col("is_sidechain") & (F.col("session_id") != "")).drop("is_sidechain")
    b = F.col("block")
    blocks = explode_blocks(base.filter(F.col("type") == "assistant"))
    name = F.coalesce(text_at(b, "$.name"), F.lit(""))
    field = lambda key: get(b, "$.input" if key is None else f"$.input.{key}", "string") if key else F.to_json(get(b, "$.input", "variant"))
    said = text_at(b, "$.type") == "text"
    used = text_at(b, "$.type") == "tool_use"
    spoken = blocks.filter(said | used).select(
        "session_id", "ts", "file_id", "seq", "block_no", F.when(said, F.lit("ASSISTANT")).otherwise(F.lit("TOOL")).alias("kind"),
        F.when(said, text_at(b, "$.text")).otherwise(F.concat(name, F.lit(" "), F.when(
            has_shape(b, "$.input", "OBJECT"), tool_input_summary(name, field)).otherwise(F.lit("")))).alias("text")).filter(
        (F.col("kind") == "TOOL") | (F.col("text") != ""))

    t = F.col("tool_result")
    items = F.try_variant_get("content", "$", "array<variant>")
    found = F.filter(items, lambda x: F.coalesce(text_at(x, "$.type") == "tool_result", F.lit(False)))
    nonempty = lambda c: F.when(c != "", c)
    parts = F.array(
        F.when(kind_of(t) == "STRING", t.cast("string")), nonempty(get(t, "$.stdout")),
        F.concat(F.lit("[stderr] "), nonempty(get(t, "$.stderr"))),
        F.when(get(t, "$.content", "variant").isNotNull(), result_block_text(get(t, "$.content", "variant"))),
        F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda x: result_block_text(get(x, "$.content", "variant"))), " ")))
    text = X.strip_ws(F.array_join(F.array_compact(parts), " "))
    failed = flag_at(t, "$.is_error") | F.coalesce(F.exists(found, lambda x: flag_at(x, "$.is_error")), F.lit(False))
    results = base.filter(F.col("type") == "user").select(
        "session_id", "ts", "file_id", "seq", F.lit(0).alias("block_no"),
        F.when(failed, F.lit("RESULT_ERR")).otherwise(F.lit("RESULT")).alias("kind"), text.alias("text")).filter(F.col("text") != "")
    return spoken.unionByName(results)
