"""What was done: tools, commands, version control, files, errors, rework, skills, labels, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import models as M, prompts as P, text as T
from ..functions.numbers import count_true, or_unknown, ratio, ratio4, round_to
from ..functions.timez import epoch_micros
from .filters import main_only, scope_key
from .topk import top_counts, top_per_group
from .usage import weight

TOOL_KINDS = ("shell", "web", "file", "search", "mcp", "other")


def tool_calls(ev: DataFrame) -> DataFrame:
    return main_only(ev).filter(F.col("kind") == "tool_call")


def tool_categories(ev: DataFrame, *keys: str) -> DataFrame:
    return tool_calls(ev).groupBy(*keys, "tool_kind").agg(F.count(F.lit(1)).alias("calls"))


def tool_totals(ev: DataFrame, *keys: str) -> DataFrame:
    k = F.col("tool_kind")
    return tool_calls(ev).groupBy(*keys).agg(
        count_true(k == "shell").alias("shell_calls"), count_true(k == "web").alias("web_searches"),
        count_true(k == "file").alias("file_changes"), F.count(F.lit(1)).alias("total_calls"))


def tools_by_name(ev: DataFrame, n: int = 15) -> DataFrame:
    named = tool_calls(ev).filter(F.col("tool_name") != "")
    return top_counts(named.groupBy(F.col("tool_name").alias("name")).agg(F.count(F.lit(1)).alias("calls")), n, "calls", "name")


def mcp_usage(ev: DataFrame) -> DataFrame:
    """Calls per (server, tool), per server and in total, from one scan."""
    name = F.col("tool_name")
    calls = tool_calls(ev).filter(F.startswith(name, F.lit("mcp__"))).select(
        T.mcp_server(name).alias("server"), T.mcp_tool(name).alias("tool"))
    per_tool = calls.groupBy("server", "tool").agg(F.count(F.lit(1)).alias("n"))
    return per_tool.rollup("server", "tool").agg(F.sum("n").alias("calls"), F.grouping_id().alias("g")).select(
        F.when(F.col("g") == 0, F.lit("tool")).when(F.col("g") == 1, F.lit("server")).otherwise(F.lit("total")).alias("level"),
        "server", "tool", "calls")


def command_counts(ev: DataFrame, *keys: str) -> DataFrame:
    shell = tool_calls(ev).filter((F.col("tool_kind") == "shell") & (F.col("command") != ""))
    named = shell.select(*keys, T.first_token(F.col("command")).alias("command")).filter(F.col("command") != "")
    return named.groupBy(*keys, "command").agg(F.count(F.lit(1)).alias("calls"))


def top_commands(ev: DataFrame, n: int = 12) -> DataFrame:
    return top_counts(command_counts(ev), n, "calls", "command")


def git_counts(ev: DataFrame, *keys: str) -> DataFrame:
    shell = tool_calls(ev).filter(F.col("tool_kind") == "shell")
    # The cheap substring test keeps most commands away from word splitting.
    subs = shell.filter(F.contains("command", F.lit("git"))).select(*keys, T.git_subcommand(F.col("command")).alias("command"))
    return subs.filter(F.col("command").isNotNull()).groupBy(*keys, "command").agg(F.count(F.lit(1)).alias("calls"))


def git_habits(ev: DataFrame, branches: DataFrame) -> DataFrame:
    """One row: subcommand total, branch contexts, repositories with several branches, review and risk flags."""
    def n(*names: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("command").isin(*names), F.col("calls"))), F.lit(0))

    counts = git_counts(ev).agg(
        F.coalesce(F.sum("calls"), F.lit(0)).alias("command_count"),
        n("status").alias("status"), n("diff").alias("diff"), n("log", "show").alias("history"),
        n("commit").alias("commit"), n("push").alias("push"))
    per_repo = branches.groupBy("repo").agg(F.count(F.lit(1)).alias("b")).agg(
        F.coalesce(F.sum("b"), F.lit(0)).alias("branch_count"), count_true(F.col("b") > 1).alias("multi_branch_repos"))
    return counts.select(
        "command_count", *[per_repo.select(c).scalar().alias(c) for c in ("branch_count", "multi_branch_repos")],
        (F.col("status") > 0).alias("reviews_status"), (F.col("diff") > 0).alias("reviews_diff"),
        (F.col("history") > 0).alias("reviews_history"),
        ((F.col("commit") == 0) & ((F.col("diff") > 0) | (F.col("status") > 0))).alias("risk_no_commit"),
        (F.col("push") > 0).alias("risk_push"))


def file_languages(ev: DataFrame, n: int = 15) -> DataFrame:
    ext = F.col("file_ext")
    files = tool_calls(ev).filter((F.col("tool_kind") == "file") & (ext != ""))
    per_ext = files.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"))
    named = per_ext.groupBy(F.coalesce(T.language_of(F.col("ext")), F.upper("ext")).alias("name")).agg(F.sum("n").alias("files"))
    return top_counts(named, n, "files", "name")


def dominant_language(ev: DataFrame) -> DataFrame:
    """Most used programming language per repository: largest count, ties to the smallest extension."""
    files = tool_calls(ev).filter((F.col("tool_kind") == "file") & (F.col("file_ext") != ""))
    counts = files.groupBy(or_unknown(F.col("repo")).alias("repo"), F.lower("file_ext").alias("ext")).agg(F.count(F.lit(1)).alias("n"))
    coded = counts.withColumn("language", T.language_of(F.col("ext"))).filter(
        F.col("language").isNotNull() & ~F.col("language").isin(T.AUXILIARY_LANGUAGES))
    best = F.min(F.struct((-F.col("n")).alias("n"), "ext", "language"))
    return coded.groupBy("repo").agg(best["language"].alias("language"))


def error_signals(ev: DataFrame, *keys: str) -> DataFrame:
    rows, kind = main_only(ev), F.col("kind")
    result, err = kind == "tool_result", F.coalesce(F.col("is_error"), F.lit(False))

    def n(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, weight(ev))), F.lit(0))

    return rows.groupBy(*keys).agg(
        n(result).alias("results"), n(result & err).alias("errors"), ratio4(n(result & err), n(result)).alias("error_rate"),
        n(kind == "interrupt").alias("interrupted"), n(kind == "api_error").alias("api_errors"))


def errors_by(ev: DataFrame, what: str, n: int = 8) -> DataFrame:
    """Error counts by ``tool_name`` or ``error_category``."""
    errors = main_only(ev).filter((F.col("kind") == "tool_result") & F.col("is_error"))
    label = or_unknown(F.col(what)) if what == "tool_name" else F.col(what)
    counts = errors.groupBy(label.alias("name")).agg(F.count(F.lit(1)).alias("errors")).filter(F.col("name").isNotNull())
    return top_counts(counts, n, "errors", "name")


def rework_signals(ev: DataFrame, *keys: str) -> DataFrame:
    edits = main_only(ev).filter(F.col("kind") == "edit")
    touched = count_true(F.coalesce(F.col("user_modified"), F.lit(False)))
    return edits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("edits"), touched.alias("user_modified"),
        ratio4(touched, F.count(F.lit(1))).alias("user_modified_rate"),
        F.coalesce(F.sum("lines_added"), F.lit(0)).alias("lines_added"),
        F.coalesce(F.sum("lines_removed"), F.lit(0)).alias("lines_removed"))


def labels(ev: DataFrame, *fields: str) -> DataFrame:
    """Counts of (field, label)."""
    rows = ev.filter((F.col("kind") == "label") & (F.col("label") != ""))
    rows = rows.filter(F.col("label_field").isin(*fields)) if fields else rows
    return rows.groupBy(F.col("label_field").alias("field"), "label").agg(F.count(F.lit(1)).alias("n"))


def skill_usage(ev: DataFrame, n: int = 12) -> DataFrame:
    """Skill counts; skills are record metadata, so sub-agent records count too."""
    counts = labels(ev, "skill").select(F.col("label").alias("skill"), "n")
    return top_counts(counts, n, "n", "skill").select(
        "skill", T.plugin_of(F.col("skill")).alias("plugin"), T.skill_short(F.col("skill")).alias("short"), "n")


def environment(ev: DataFrame) -> DataFrame:
    """Attachments, sub-agent messages, and (version | permission mode) labels as rows."""
    marks = ev.filter(F.col("kind").isin("attachment", "subagent")).groupBy(F.col("kind").alias("field")).agg(
        F.count(F.lit(1)).alias("n")).select("field", F.lit("").alias("label"), "n")
    return labels(ev, "version", "permission_mode").unionByName(marks)


EXEC_FIELDS = ("effort", "approval_policy", "sandbox", "collaboration_mode", "personality", "originator")


def exec_profile(ev: DataFrame) -> DataFrame:
    """Label distributions of execution settings plus compaction and abort counts, main chain only."""
    rows = main_only(ev)
    marks = rows.filter(F.col("kind").isin("compaction", "abort")).groupBy(F.col("kind").alias("field")).agg(
        F.count(F.lit(1)).alias("n")).select("field", F.lit("").alias("label"), "n")
    return labels(rows, *EXEC_FIELDS).unionByName(marks)


def git_identity(ev: DataFrame, *keys: str) -> DataFrame:
    """Whether any log came with a repository identity."""
    flag = F.coalesce(F.bool_or((F.col("kind") == "label") & (F.col("label_field") == "git_identity")), F.lit(False))
    return main_only(ev).groupBy(*keys).agg(flag.alias("git_repo_identity"))


def context_window(ev: DataFrame) -> DataFrame:
    """Most frequent context-window size, ties to the smallest."""
    sizes = main_only(ev).filter((F.col("kind") == "tokens") & (F.col("value") > 0))
    counts = sizes.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min(F.struct((-F.col("n")).alias("n"), "value"))["value"].alias("context_window"))


def _signal_columns(n: Column) -> list[Column]:
    def share(c: str) -> Column:
        return round_to(ratio(F.sum(c), n), 4)

    return [
        n.alias("prompts"),
        round_to(ratio(F.sum("len"), n), 1).alias("avg_len"),
        share("structured").alias("structured_ratio"), share("file_ref").alias("file_ref_ratio"),
        share("constraint").alias("constraint_ratio"), share("correction").alias("correction_rate"),
    ]


def prompt_flag_rows(prompts: DataFrame, text: str, *keep: str) -> DataFrame:
    """Length and 0/1 flags of each non-blank prompt; the text itself is dropped."""
    clean = prompts.withColumn("_t", T.strip_ws(F.col(text))).filter(F.col("_t") != "").withColumn("_low", F.lower("_t"))
    flags = P.prompt_flags(F.col("_t"), F.col("_low"))
    return clean.select(*keep, *[c.cast("bigint").alias(name) for name, c in flags.items()])


def prompt_signals(prompts: DataFrame, text: str, *keys: str) -> DataFrame:
    return prompt_flag_rows(prompts, text, *keys).groupBy(*keys).agg(*_signal_columns(F.count(F.lit(1))))


def ev_prompt_signals(ev: DataFrame, *keys: str) -> DataFrame:
    return prompt_signals(main_only(ev).filter(F.col("kind") == "prompt"), "prompt_text", *keys)


def scope_buckets(ev: DataFrame, scope: str) -> DataFrame:
    """Tokens, calls, cache rate, sessions, span and prompt signals per project or per session."""
    rows = ev.withColumn("scope_key", scope_key(scope)).filter(F.col("scope_key").isNotNull())
    used = F.col("total").isNotNull()
    call = (F.col("kind") == "tool_call") & ~F.col("is_sidechain")
    fresh = M.fresh_input(F.col("model"), F.col("input"), F.col("cached_input"))
    micros = epoch_micros(F.col("ts"))
    named = F.when(~F.col("is_sidechain") & (F.col("session_id") != ""), F.col("session_id"))
    base = rows.groupBy("scope_key").agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("tokens"), count_true(call).alias("tool_calls"),
        round_to(ratio(F.coalesce(F.sum("cached_input"), F.lit(0)),
                       F.coalesce(F.sum("cached_input"), F.lit(0)) + F.coalesce(F.sum(F.when(used, fresh)), F.lit(0))), 4)
        .alias("cache_hit_rate"),
        F.count_distinct(named).alias("sessions"),
        F.floor((F.max(micros) - F.min(micros)) / 1000000).alias("duration_seconds"),
        *[count_true(call & (F.col("tool_kind") == k)).alias(f"{k}_calls") for k in TOOL_KINDS])
    signals = ev_prompt_signals(rows, "scope_key")
    filled = [F.coalesce(c, F.lit(0)).alias(c) if c == "prompts" else F.coalesce(c, F.lit(0.0)).alias(c)
              for c in signals.columns if c != "scope_key"]
    return base.join(signals, "scope_key", "left").select(*base.columns, *filled)


def scope_git_top(ev: DataFrame, scope: str, n: int = 6) -> DataFrame:
    rows = ev.withColumn("scope_key", scope_key(scope)).filter(F.col("scope_key").isNotNull())
    return top_per_group(git_counts(rows, "scope_key"), n, ["scope_key"], "calls", "command")


def churn_counts(ev: DataFrame) -> DataFrame:
    """Edits and sessions per (repository, file base name)."""
    edits = tool_calls(ev).filter(F.col("is_edit") & (F.col("file_base") != ""))
    return edits.groupBy(or_unknown(F.col("repo")).alias("repo"), F.col("file_base").alias("file")).agg(
        F.count(F.lit(1)).alias("edits"), F.count_distinct(F.when(F.col("session_id") != "", F.col("session_id"))).alias("sessions"))


def file_churn_top(ev: DataFrame, n: int = 8) -> DataFrame:
    return top_per_group(churn_counts(ev), n, ["repo"], "edits", "file")


def file_churn(ev: DataFrame) -> DataFrame:
    """Distinct files, edits and the share of the three most edited files per repository."""
    counts = churn_counts(ev)
    totals = counts.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum("edits").alias("edits"))
    top3 = top_per_group(counts, 3, ["repo"], "edits", "file").groupBy("repo").agg(F.sum("edits").alias("top3"))
    return totals.join(top3, "repo").select("repo", "files", "edits", ratio4(F.col("top3"), F.col("edits")).alias("top3_share"))


def project_facts(facts: DataFrame) -> DataFrame:
    """Repositories with tests, a build system and continuous integration; input has repo and three flags."""
    per_repo = facts.groupBy("repo").agg(*[F.bool_or(c).alias(c) for c in ("has_tests", "has_build", "has_ci")])
    return per_repo.agg(
        F.count(F.lit(1)).alias("repos"), count_true(F.col("has_tests")).alias("repos_with_tests"),
        count_true(F.col("has_build")).alias("repos_with_build_system"), count_true(F.col("has_ci")).alias("repos_with_ci"))
