"""Episodes of growing files as keyed state: one open episode per file, closed by its next start or by silence.

Rows wait in the file's buffer until the watermark has passed them, then they are folded in line order; so lines may come out of
order within the lateness. The state of a file holds the counters of its open episode, one number for each file it touched and
one row of sums for each model. A timer folds what waits and closes an episode after ``close_after`` of event-time silence,
which drops the file's state. That bound must exceed the longest silence inside a file: lines that come after it count
their episodes anew.

Files are many and have few rows in a step, while a call for a key and an access to the state are messages between processes. So
files share ``buckets`` keys by hash, and a bucket's state is read and written at once; the files in it know nothing of each other.
"""

from __future__ import annotations

import json
import pickle
import sys
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import models as M
from ..functions.numbers import ratio
from ..functions.timez import epoch_micros
from ..operators import episodes as E
from ..operators.filters import main_only, nonempty_episodes
from ..schema import TOKEN_BUCKETS
from .windows import with_event_time

# the processor travels with its code: the workers of a cluster need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State partitions of one core: each one opens a state store, and for episodes a Python worker, in every step, whatever the rows.
PARTITIONS_PER_CORE = 2
#: Whole numbers that are summed over an episode's rows.
SUMMED = ["tool_calls", "reads", "edits", "searches", "shells", "others", "doc_files", "code_files", "file_calls", "results", "errors",
          "test_results", "long_runs", "lines", "interrupts", "compactions"]
SUMS = [*TOKEN_BUCKETS, "uncached"]
ROW = (
    "file_id string, seq bigint, us bigint, boundary boolean, correction boolean, thinking boolean, platform string, session_id string, repo string, "
    "facet string, facet_key string, call boolean, is_edit boolean, failed boolean, "
    + ", ".join(f"{c} bigint" for c in [*SUMS, *SUMMED]))
# running values of the open episode; active_us and active_seq belong to the file
RUNNING = ["error_now", "error_run", "quiet_now", "quiet_run", "files_touched", "max_edits_per_file", "gap_micros", "last_us", "effort_seq"]
OPEN = (
    "ep bigint, start_seq bigint, start_us bigint, platform string, session_id string, repo string, correction boolean, thinking boolean, "
    "effort string, active_us bigint, active_seq bigint, folded_seq bigint, seen_us bigint, timer_ms bigint, "
    + ", ".join(f"{c} bigint" for c in [*RUNNING, *SUMMED]))
OPEN_FIELDS = [f.split()[0] for f in OPEN.split(", ")]
TIMER = OPEN_FIELDS.index("timer_ms")
PACKED = [f.split()[0] for f in ROW.split(", ")][3:]
OUT = (
    "file_id string, ep bigint, start_seq bigint, start_us bigint, last_us bigint, platform string, session_id string, repo string, "
    "is_correction boolean, thinking_directive boolean, corrected_by_next boolean, effort string, error_run bigint, quiet_run bigint, "
    "files_touched bigint, max_edits_per_file bigint, gap_micros bigint, "
    + ", ".join(f"{c} bigint" for c in SUMMED) + ", models array<struct<model: string, " + ", ".join(f"{c}: bigint" for c in SUMS) + ">>")


#: Keys that files are dealt over by hash; a checkpoint keeps its number.
BUCKETS = 1_024
#: Bytes of one state entry.
PART = 4 << 20


def settings(spark: SparkSession) -> dict[str, str]:
    """Settings of the session while a stream with state starts; its checkpoint keeps the number of partitions."""
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTITIONS_PER_CORE * spark.sparkContext.defaultParallelism)
    return {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.shuffle.partitions": str(partitions)}


@contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """``settings`` of the session for a while."""
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def fold_rows(ev: DataFrame) -> DataFrame:
    """What the fold needs of each main-chain row: flags as whole numbers, its facet and key."""
    kind, base = F.col("kind"), F.coalesce(F.col("file_base"), F.lit(""))
    call = kind == "tool_call"
    on_file = call & (F.col("tool_kind") == "file") & (base != "")
    used, result = F.col("total").isNotNull(), kind == "tool_result"
    edit = F.coalesce(F.col("is_edit"), F.lit(False))
    error = result & F.coalesce(F.col("is_error"), F.lit(False))
    doc = F.col("file_ext").isin(E.DOC_EXTENSIONS)
    effort = (kind == "label") & (F.col("label_field") == "effort")
    tool_kind = F.col("tool_kind")
    flags = {
        "tool_calls": call, "reads": on_file & ~edit, "edits": on_file & edit, "searches": call & (tool_kind == "search"),
        "shells": call & (tool_kind == "shell"), "others": call & ~on_file & ~tool_kind.isin("shell", "search", "web"),
        "doc_files": on_file & doc, "code_files": on_file & ~doc & (F.coalesce(F.col("file_ext"), F.lit("")) != ""), "file_calls": on_file,
        "results": result, "errors": error, "test_results": error & (F.col("error_category") == "test"),
        "long_runs": call & F.coalesce(F.col("long_run"), F.lit(False)), "interrupts": kind == "interrupt", "compactions": kind == "compaction"}
    ones = {name: F.when(flag, F.lit(1)).otherwise(F.lit(0)).cast("bigint") for name, flag in flags.items()}
    ones["lines"] = F.coalesce(F.col("lines_added") + F.col("lines_removed"), F.lit(0))
    facet = F.when(used, F.lit("model")).when(on_file, F.lit("file")).when(result, F.lit("run")).when(effort, F.lit("effort")).otherwise(F.lit("rest"))
    key = F.when(used, M.normalize_model(F.col("model"))).when(on_file, base).when(effort, F.col("label"))
    known = {c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit("(unknown)")).otherwise(F.col(c)) for c in ("session_id", "repo")}
    return main_only(ev).select(
        "file_id", "ts", "seq", epoch_micros(F.col("ts")).alias("us"), F.coalesce("is_boundary", F.lit(False)).alias("boundary"),
        F.coalesce("is_correction", F.lit(False)).alias("correction"), F.coalesce("is_thinking", F.lit(False)).alias("thinking"), "platform",
        known["session_id"].alias("session_id"), known["repo"].alias("repo"), facet.alias("facet"), key.alias("facet_key"), call.alias("call"),
        edit.alias("is_edit"), error.alias("failed"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in TOKEN_BUCKETS],
        F.coalesce(M.uncached_input(F.col("input"), F.col("cached_input")), F.lit(0)).alias("uncached"), *[ones[c].alias(c) for c in SUMMED])


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` with all but file, position and time in one text, which leaves out zeros: every cell of a row costs the worker a call."""
    kinds = dict(f.split() for f in ROW.split(", "))
    none = {"bigint": F.lit(0).cast("bigint"), "boolean": F.lit(False)}
    cells = [(F.nullif(F.col(c), none[kinds[c]]) if kinds[c] in none else F.col(c)).alias(c) for c in PACKED]
    rest = [c for c in rows.columns if c not in PACKED]
    return rows.select(*rest, F.to_json(F.struct(*cells), {"ignoreNullFields": "true"}).alias("line"))


class EpisodeProcessor(StatefulProcessor):
    """Folds the rows of each file of a bucket in line order."""

    def __init__(self, cap_seconds: int, close_seconds: int) -> None:
        self.cap, self.close_micros = cap_seconds * 1_000_000, close_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a bucket's files with their rows as bytes, in entries of bounded size: the first one here, further ones by number
        self.open = handle.getValueState("open", "held binary, parts bigint, timer_ms bigint")
        self.further = handle.getMapState("waiting", "part bigint", "held binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        files, parts, timer_ms = self._read()
        take, fresh = None, {}
        for r in rows:
            if take is None:
                known = r.__fields__
                take = itemgetter(*[known.index(c) for c in ("file_id", "seq", "us", *(["line"] if "line" in known else PACKED))])
            file_id, seq, us, *line = take(r)
            fresh.setdefault(file_id, []).append((seq, us, line[0] if "line" in known else json.dumps(dict(zip(PACKED, line)))))
        yield from self._advance(files, fresh, timerValues.getCurrentWatermarkInMs())
        self._write(files, parts, timer_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        files, parts, _ = self._read()
        yield from self._advance(files, {}, timerValues.getCurrentWatermarkInMs())
        self._write(files, parts, 0)

    def close(self) -> None:
        pass

    def _read(self) -> tuple[dict, int, int]:
        """The bucket's files, the number of its further entries, and its timer."""
        kept = self.open.get()
        if kept is None:
            return {}, 0, 0
        held, parts, timer_ms = kept
        if parts:
            more = {part[0]: value[0] for part, value in self.further.iterator()}
            held = b"".join([bytes(held), *(bytes(more[n]) for n in range(parts))])
        return pickle.loads(zlib.decompress(held)), parts, timer_ms

    def _write(self, files: dict, parts: int, timer_ms: int) -> None:
        """Write what is left of the bucket; its timer is the first of its files."""
        due = min((head[TIMER] for head, *_ in files.values()), default=0)
        if due != timer_ms:
            if timer_ms:
                self.handle.deleteTimer(timer_ms)
            if due:
                self.handle.registerTimer(due)
        held = zlib.compress(pickle.dumps(files, pickle.HIGHEST_PROTOCOL), 1) if files else b""
        now = range(max(0, -(-len(held) // PART) - 1))
        for n in now:
            self.further.updateValue((n,), (held[(n + 1) * PART:(n + 2) * PART],))
        for n in range(len(now), parts):
            self.further.removeKey((n,))
        if files:
            self.open.update((held[:PART], len(now), due))
        else:
            if parts:
                self.further.clear()
            self.open.clear()

    def _advance(self, files: dict, fresh: dict[str, list[tuple]], watermark_ms: int) -> Iterator[Row]:
        """Fold the files that have new rows or whose timer is over."""
        for file_id in [f for f, kept in files.items() if f in fresh or kept[0][TIMER] <= watermark_ms] + [f for f in fresh if f not in files]:
            kept = files.pop(file_id, None)
            if kept is None:
                head, rows, self.touched, self.models = self._head(), [], {}, {}
            else:
                head, rows, self.touched, self.models = dict(zip(OPEN_FIELDS, kept[0])), *kept[1:]
            if head["timer_ms"] <= watermark_ms:
                head["timer_ms"] = 0
            waiting, folded = {row[0]: row for row in rows}, head["folded_seq"]
            for row in fresh.get(file_id, ()):
                if row[0] > folded:  # a line whose turn is over stays out
                    waiting[row[0]] = row
                    head["seen_us"] = max(head["seen_us"], row[1])
            left = yield from self._folded(file_id, head, waiting, watermark_ms)
            if left is not None:
                files[file_id] = (tuple(head[c] for c in OPEN_FIELDS), left, self.touched, self.models)

    def _head(self) -> dict:
        head = {c: 0 for c in OPEN_FIELDS}
        head.update(platform=None, session_id=None, repo=None, effort=None, correction=False, thinking=False, active_us=-1, active_seq=-1,
                    folded_seq=-1, seen_us=-1, last_us=-1, effort_seq=-1)
        return head

    def _folded(self, file_id: str, head: dict, waiting: dict[int, tuple], watermark_ms: int):
        """Fold the rows of a file that the watermark has passed; gives the rows that wait on, or None when the file is closed."""
        passed = watermark_ms * 1000
        order = sorted(waiting)
        done = 0
        for seq in order:
            _, us, line = waiting[seq]
            if us > passed:
                break  # a line keeps the lines behind it waiting
            row = json.loads(line)
            row["seq"], row["us"] = seq, us
            if row.get("boundary"):
                if head["ep"]:
                    yield self._closed(file_id, head, row.get("correction", False))
                self._start(head, row)
            self._fold(head, row)
            done += 1
        left = [waiting[seq] for seq in order[done:]]
        if not left and passed >= head["seen_us"] + self.close_micros:
            if head["ep"]:
                yield self._closed(file_id, head, False)
            return None
        if not head["timer_ms"]:
            due = max(row[1] for row in left) if left else head["seen_us"] + self.close_micros
            head["timer_ms"] = max(due // 1000 + 1, watermark_ms + 1)
        return left

    def _start(self, head: dict, row: dict) -> None:
        self.touched, self.models = {}, {}
        head.update({c: 0 for c in [*RUNNING, *SUMMED]})
        head.update(ep=head["ep"] + 1, start_seq=row["seq"], start_us=row["us"], platform=row.get("platform"), session_id=row.get("session_id"),
                    repo=row.get("repo"), correction=row.get("correction", False), thinking=row.get("thinking", False), effort=None, last_us=-1, effort_seq=-1)

    def _fold(self, head: dict, row: dict) -> None:
        head["folded_seq"] = row["seq"]
        used = row["facet"] == "model"
        before_us, before_seq = head["active_us"], head["active_seq"]
        if used:
            head["active_us"], head["active_seq"] = row["us"], row["seq"]
        if not head["ep"]:
            return  # rows before the first start belong to no episode
        for c in SUMMED:
            if c in row:
                head[c] += row[c]
        if used:
            gap = row["us"] - before_us
            if before_seq >= head["start_seq"] and 0 < gap <= self.cap:
                head["gap_micros"] += gap
            head["last_us"] = max(head["last_us"], row["us"])
            sums = self.models.setdefault(row.get("facet_key"), [0] * len(SUMS))
            for i, c in enumerate(SUMS):
                sums[i] += row.get(c, 0)
        elif row["facet"] == "run":
            head["error_now"] = head["error_now"] + 1 if row.get("failed") else 0
            head["error_run"] = max(head["error_run"], head["error_now"])
        elif row["facet"] == "effort":
            head["effort"], head["effort_seq"] = row.get("facet_key"), row["seq"]
        if row.get("call"):
            self._call(head, row)

    def _call(self, head: dict, row: dict) -> None:
        fresh = False
        if row["facet"] == "file":
            name, files = row.get("facet_key"), self.touched
            fresh = name not in files
            files[name] = files.get(name, 0) + row.get("is_edit", False)
            head["files_touched"] += fresh
            head["max_edits_per_file"] = max(head["max_edits_per_file"], files[name])
        head["quiet_now"] = 0 if fresh else head["quiet_now"] + 1
        head["quiet_run"] = max(head["quiet_run"], head["quiet_now"])

    def _closed(self, file_id: str, head: dict, corrected: bool) -> Row:
        return Row(
            file_id=file_id, ep=head["ep"], start_seq=head["start_seq"], start_us=head["start_us"],
            last_us=None if head["last_us"] < 0 else head["last_us"], platform=head["platform"], session_id=head["session_id"], repo=head["repo"],
            is_correction=head["correction"], thinking_directive=head["thinking"], corrected_by_next=corrected, effort=head["effort"],
            error_run=head["error_run"], quiet_run=head["quiet_run"], files_touched=head["files_touched"],
            max_edits_per_file=head["max_edits_per_file"], gap_micros=head["gap_micros"], **{c: head[c] for c in SUMMED},
            models=[(name, *sums) for name, sums in sorted(self.models.items())])


def _features(closed: DataFrame) -> DataFrame:
    """The batch operator's episode columns from one closed episode a row."""
    models = F.col("models")

    def total(bucket: str) -> Column:
        return F.aggregate(models, F.lit(0).cast("bigint"), lambda a, m: a + m[bucket])

    def nano(m: Column) -> Column:
        return M.cost_nano(M.price_of(m["model"]), m["input"], m["cached_input"], m["cache_creation"], m["output"], m["uncached"])

    cost = F.aggregate(models, F.lit(0).cast("decimal(36,0)"), lambda a, m: (a + nano(m)).cast("decimal(36,0)"))
    ranked = F.array_min(F.transform(F.filter(models, lambda m: m["model"] != ""), lambda m: F.struct((-m["total"]).alias("t"), m["model"].alias("model"))))
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    out = closed.withColumns({**{c: total(c) for c in TOKEN_BUCKETS}, "nano": cost, "model": ranked["model"]}).drop("models")
    return out.withColumns({
        "start_ts": F.timestamp_add("MICROSECOND", F.col("start_us"), start), "last_ts": F.timestamp_add("MICROSECOND", F.col("last_us"), start),
        "active_ms": F.floor(F.col("gap_micros") / 1000).cast("bigint"), "has_test": F.col("test_results") > 0, "long_run": F.col("long_runs") > 0,
        "doc_ratio": ratio(F.col("doc_files"), F.col("file_calls")), "code_ratio": ratio(F.col("code_files"), F.col("file_calls")),
        "error_rate_raw": ratio(F.col("errors"), F.col("results")), "interrupted": F.col("interrupts") > 0, "compacted": F.col("compactions") > 0,
        "cost_usd": M.nano_to_usd(F.col("nano"))}).drop("start_us", "last_us")


def stream_episodes(ev: DataFrame, cap_seconds: int = E.IDLE_CAP_SECONDS, close_seconds: int = 7 * 86_400, lateness: str = "1 day",
                    buckets: int = BUCKETS) -> DataFrame:
    """Stream of closed episodes with the columns of the batch table before episodes are compared with each other.

    The session index and the comparison of durations look at other files; they are batch steps over the written rows.
    The session must keep its state in RocksDB; ``settings`` gives what to set.
    """
    rows = packed(with_event_time(fold_rows(ev), lateness).drop("ts")).withColumn("bucket", F.pmod(F.xxhash64("file_id"), F.lit(buckets)))
    closed = rows.groupBy("bucket").transformWithState(EpisodeProcessor(cap_seconds, close_seconds), OUT, "append", "eventTime")
    return E.with_end_type(E.with_spiral(E.with_task_type(nonempty_episodes(_features(closed)))))
