"""Platform B rollouts from disk to result tables; all expectations are worked out by hand."""

import datetime as dt
import json

from sessionloom.functions.timez import DayWindow
from sessionloom.operators import behavior as B, content as D, episodes as E, usage as U
from sessionloom.session import new_path
from sessionloom.sources.sinks import land_ev
from sessionloom.sources.logs import parse_json, read_logs_b
from sessionloom.sources.normalize_b import digest_items_b, normalize_b, plan_of_file

DAY = dt.date(2026, 3, 4)


def rec(sec, kind, **payload):
    return {"timestamp": f"2026-03-04T10:{sec // 60:02d}:{sec % 60:02d}.000Z", "type": kind, "payload": payload}


def usage(i, o, c=0, r=0, total=None):
    return {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "reasoning_output_tokens": r, "total_tokens": i + o if total is None else total}


def count(sec, last=None, total=None, **extra):
    info = {k: v for k, v in (("last_token_usage", last), ("total_token_usage", total), ("model_context_window", extra.pop("window", None))) if v is not None}
    return rec(sec, "event_msg", type="token_count", info=info, **extra)


def main_log():
    return [
        rec(0, "session_meta", id="S1", cwd="/work/subagent-repo", source="vscode", originator="app_x", git={"commit_hash": "abc"}, model_provider="relay"),
        rec(1, "turn_context", model="gpt-5.1-codex", effort="high", approval_policy="never", sandbox_policy={"mode": "read-only"}, collaboration_mode={"mode": "pair"}),
        count(2, last=usage(10, 5), window=272000, rate_limits={"plan_type": "plus"}),
        rec(3, "response_item", type="function_call", name="exec_command", call_id="c1", arguments=json.dumps({"command": ["bash", "-lc", "git status"]})),
        rec(4, "event_msg", type="exec_command_end", call_id="c1", exit_code=128),
        rec(5, "response_item", type="function_call_output", call_id="c1", output=json.dumps({"output": "fatal: not a git repository", "metadata": {"exit_code": 0}})),
        count(6, total=usage(110, 40, c=60)),      # cumulative after a per-turn value: 100 new input, 35 new output
        rec(7, "event_msg", type="patch_apply_end", changes={"/x/a.ts": {"type": "update", "unified_diff": "--- a\n+++ b\n+1\n+2\n-3"}, "b.md": {"type": "add", "unified_diff": "+x"}}),
        rec(8, "compacted"),
        rec(9, "turn_context", model="gpt-5.1-codex", effort="low"),
        count(10, last=usage(4, 1), total=usage(114, 41, c=60)),
        rec(11, "response_item", type="function_call_output", call_id="c9", output=json.dumps({"output": "x", "metadata": {"interrupted": True}})),
        rec(12, "event_msg", type="turn_aborted"),
        rec(13, "event_msg", type="stream_error"),
        {"timestamp": "2026-03-05T10:00:00Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": usage(120, 50, c=60)}}},
    ]


def sub_log():
    return [
        rec(0, "session_meta", id="S2", cwd="/work/app", source={"subagent": "review"}),
        rec(1, "turn_context", model="gpt-5.1-codex"),
        count(2, total=usage(1000, 0)),
        rec(3, "response_item", type="web_search_call"),
    ]


def load(spark, path, window=DayWindow(DAY, DAY)):
    good, _ = parse_json(read_logs_b(spark, str(path)))
    return good, land_ev(normalize_b(good, window), new_path(spark, "ev"))


def test_rollouts(spark, tmp_path, lines):
    lines(tmp_path / "sessions" / "2026" / "rollout-main.jsonl", main_log())
    lines(tmp_path / "sessions" / "2026" / "rollout-sub.jsonl", sub_log())
    lines(tmp_path / "sessions" / "2026" / "notes.jsonl", main_log())
    good, ev = load(spark, tmp_path)
    t = U.token_totals(ev).first()
    # main: 10+5, 100+35, 4+1; sub-agent: 1000.
    assert (t.input, t.output, t.cached_input, t.total) == (1114, 41, 60, 1155)
    assert U.activity(ev).first().sessions == 1
    bill = {r.plan: r.tokens for r in U.billing(ev, plan_of_file(good)).collect()}
    assert bill == {"plus": 155, "(unclassified)": 1000}
    labels = {(r.field, r.label): r.n for r in B.exec_profile(ev).collect()}
    assert labels == {("effort", "high"): 1, ("effort", "low"): 1, ("approval_policy", "never"): 1, ("sandbox", "read-only"): 1,
                      ("collaboration_mode", "pair"): 1, ("originator", "app_x"): 1, ("compaction", ""): 1, ("abort", ""): 1}
    assert B.git_identity(ev).first().git_repo_identity
    assert B.context_window(ev).first().context_window == 272000
    e = B.error_signals(ev).first()
    assert (e.results, e.errors, e.interrupted, e.api_errors) == (2, 1, 1, 1)
    assert [tuple(r) for r in B.errors_by(ev, "error_category").collect()] == [("git", 1)]
    assert [tuple(r) for r in B.errors_by(ev, "tool_name").collect()] == [("exec_command", 1)]
    w = B.rework_signals(ev).first()
    assert (w.edits, w.lines_added, w.lines_removed) == (2, 3, 1)
    assert {(r.tool_kind, r.calls) for r in B.tool_categories(ev).collect()} == {("shell", 1), ("file", 2)}
    assert [tuple(r) for r in B.git_counts(ev).collect()] == [("status", 1)]
    assert {r.repo for r in ev.filter("not is_sidechain").select("repo").distinct().collect()} == {"subagent-repo"}
    assert {r.source for r in ev.filter("not is_sidechain").select("source").distinct().collect()} == {"plugin"}
    eps = E.episode_detail(ev).orderBy("index").collect()
    assert [(x.effort, x.compacted, x.end_type, x.total) for x in eps] == [("high", True, "natural", 150), ("low", False, "interrupted", 5)]
    # Everything in the window of the second day: the delta still knows the counters of the first.
    _, late = load(spark, tmp_path, DayWindow(dt.date(2026, 3, 5), dt.date(2026, 3, 5)))
    assert U.token_totals(late).first().total == 15


def test_digest(spark, tmp_path, lines):
    lines(tmp_path / "rollout-d.jsonl", [
        rec(0, "session_meta", id="S9"),
        rec(1, "response_item", type="reasoning", content=[{"text": "HIDDEN"}]),
        rec(2, "response_item", type="message", role="developer", content=[{"text": "HIDDEN"}]),
        rec(3, "response_item", type="message", role="assistant", content=[{"text": "hello"}, {"input_text": "there"}]),
        rec(4, "response_item", type="function_call", name="shell", arguments='{"cmd":"ls"}'),
        rec(5, "response_item", type="function_call_output", output='{"output":"two files"}'),
        rec(6, "response_item", type="custom_tool_call_output", output="   "),
    ])
    good, _ = parse_json(read_logs_b(spark, str(tmp_path)))
    packed = D.pack_items(D.number_items(digest_items_b(good)), ["session_id"], "pos")
    assert [(r.kind, r.preview) for r in D.digest_items(packed).orderBy("pos").collect()] == [
        ("ASSISTANT", "hello there"), ("TOOL", 'shell {"cmd":"ls"}'), ("RESULT", "two files")]


def test_prompts_of_user_messages(spark, tmp_path, lines):
    lines(tmp_path / "rollout-a.jsonl", [
        rec(0, "session_meta", id="S1", cwd="/w/r"),
        rec(1, "response_item", type="message", role="user", content=[{"type": "input_text", "text": "you must\n fix  src/a.py"}, "now"]),
        rec(2, "response_item", type="message", role="assistant", content=[{"type": "output_text", "text": "done"}]),
        rec(3, "response_item", type="message", role="user", content="actually, not that"),
        rec(4, "response_item", type="message", role="user", content="<command-name>x</command-name>"), rec(5, "response_item", type="message", role="user", content=[])])
    lines(tmp_path / "rollout-sub.jsonl", [
        rec(0, "session_meta", id="S2", cwd="/w/r", source={"subagent": "x"}), rec(1, "response_item", type="message", role="user", content="a task of an agent")])
    good, _ = parse_json(read_logs_b(spark, str(tmp_path)))
    ev = normalize_b(good)
    got = sorted((r.session_id, r.prompt_text, r.is_correction, r.is_boundary) for r in ev.filter("kind = 'prompt' and not is_sidechain").collect())
    assert [g for g in got if g[0] == "S1"] == [("S1", "actually, not that", True, False), ("S1", "you must fix src/a.py now", False, False)]
