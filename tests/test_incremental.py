"""A report that reads only changed files equals a full run."""

from sessionloom.operators import behavior as B, incremental as I, usage as U
from sessionloom.session import stage
from sessionloom.sources.logs import parse_json, read_logs_a
from sessionloom.sources.normalize_a import normalize_a
from test_logs_a import assistant, result, use, user

MEASURES = {
    "totals": lambda r: U.token_totals(r, "platform"), "cost": lambda r: U.estimate_cost(r), "cache": lambda r: U.cache_rates(r, "repo"),
    "repos": lambda r: U.by_repo(r), "hours": lambda r: U.by_hour(r, "Asia/Kolkata"), "sources": lambda r: U.by_source(r),
    "timeline": lambda r: U.models_timeline(r, "Asia/Kolkata"), "models": lambda r: U.model_tokens(r), "errors": lambda r: B.error_signals(r, "repo")}


def same(spark, report, folder, collect):
    good, _ = parse_json(read_logs_a(spark, str(folder)))
    ev, rows = stage(normalize_a(good), "full"), stage(report.rows(), "folded")
    for name, measure in MEASURES.items():
        assert collect(measure(rows)) == collect(measure(ev)), name
    assert collect(I.prompt_signals(rows, "session_id")) == collect(B.ev_prompt_signals(ev, "session_id"))


def names(paths):
    return sorted(p.rsplit("/", 1)[-1] for p in paths)


def test_incremental_report(spark, tmp_path, lines, collect):
    logs = tmp_path / "logs"
    a = [user("2026-03-04T10:00:00Z", "please fix src/app.py", "u1", entrypoint="cli"), assistant("2026-03-04T10:10:00Z", "m1", (10, 5, 2, 1), [use("Bash", "c1", command="ls")]),
         user("2026-03-04T10:20:00Z", None, "u2", message={"content": [result("c1", True, "EACCES")]}), assistant("2026-03-04T10:40:00Z", "m2", (7, 3, 0, 0), model="claude-haiku-4")]
    b = [user("2026-03-05T23:50:00Z", "no, that is wrong", "u3", session="s2"), assistant("2026-03-05T23:55:00Z", "m3", (100, 9, 50, 0), session="s2")]
    c = [user("2026-03-06T01:00:00Z", "write docs", "u4", session="s3", entrypoint="vscode"), assistant("2026-03-06T01:01:00Z", "m4", (1, 1, 1, 1), session="s3", isSidechain=True)]
    for name, records in (("a.jsonl", a), ("b.jsonl", b), ("c.jsonl", c)):
        lines(logs / name, records)
    report = I.report_of_logs_a(spark, str(tmp_path / "state"))
    assert names(report.update(str(logs))) == ["a.jsonl", "b.jsonl", "c.jsonl"]
    same(spark, report, logs, collect)
    assert report.update(str(logs)) == []

    # b grows; d resumes a's session with a larger fragment of m2 and repeats of its own; c is not touched
    lines(logs / "b.jsonl", [*b, assistant("2026-03-06T00:05:00Z", "m5", (20, 2, 0, 0), session="s2", model="gpt-5")])
    lines(logs / "d.jsonl", [user("2026-03-04T10:00:00Z", "please fix src/app.py", "u1"), assistant("2026-03-04T10:40:00Z", "m2", (7, 300, 0, 0), model="claude-haiku-4"),
                             assistant("2026-03-07T08:00:00Z", "m6", (4, 4, 4, 4))])
    assert names(report.update(str(logs))) == ["a.jsonl", "b.jsonl", "d.jsonl"]
    same(spark, report, logs, collect)

    # e joins d by one key, so a is read again through d; then a file goes
    lines(logs / "e.jsonl", [assistant("2026-03-07T08:00:00Z", "m6", (4, 44, 4, 4)), assistant("2026-03-08T08:00:00Z", "m7", (1, 2, 3, 4))])
    assert names(report.update(str(logs))) == ["a.jsonl", "d.jsonl", "e.jsonl"]
    (logs / "a.jsonl").unlink()
    assert names(report.update(str(logs))) == ["d.jsonl", "e.jsonl"]
    same(spark, report, logs, collect)
