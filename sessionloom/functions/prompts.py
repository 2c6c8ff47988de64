"""Signals of a prompt text; only lengths and booleans leave these expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import WS, strip_ws

# Constraint words, correction openings and patterns.
CONSTRAINT_WORDS_EN = [
    "must", "should", "don't", "do not", "only", "never", "ensure", "require", "avoid", "without", "acceptance",
]
CONSTRAINT_WORDS_ZH = ["必须", "应该", "不要", "不能", "只", "确保", "需要", "避免", "禁止", "验收", "务必"]
CORRECTION_STARTS_EN = ["actually", "instead", "wait", "no,", "no ", "not ", "sorry", "oops", "rather"]
CORRECTION_STARTS_ZH = ["不对", "重来", "不是", "错了", "应该是", "改成", "其实", "等等", "算了"]
CORRECTION_PATTERN = (
    r"(?i)(?<!\w)(actually|sorry|wait|wrong|instead|nope)(?!\w)|(?<!\w)no,(?=\w)|不对|不是|错了|重来|撤销|改成"
)
LONG_RUN_PATTERN = r"(?i)(?<!\w)(train|fit|pytest|jest|vitest|benchmark|bench|notebook|jupyter)(?!\w)"
THINKING_PATTERN = (
    rf"(?i)(?<!\w)(ultrathink|megathink|think{WS}+(hard|harder|deeply|intensely|longer))(?!\w)"
)
LIST_PATTERN = rf"(^|\n){WS}*([-*•]|[0-9]+[.)]){WS}+"
FILE_EXTENSIONS = (
    "(?:py|go|js|jsx|ts|tsx|rs|java|kt|swift|c|h|cc|cpp|cxx|hpp|rb|php|cs|sh|bash|zsh|html|htm|css|scss|less|md|"
    "json|yaml|yml|toml|xml|sql|vue|svelte|dart|scala|lua|ipynb|cfg|ini|env|gradle|proto|txt|lock|mod)"
)
# Only existence matters: one path part before the last slash, or one word character before the dot, is enough.
FILE_REF_PATTERN = (
    rf"(?i)@[\w\-]*[./][\w./\-]|\w-*\.{FILE_EXTENSIONS}(?!\w)|[\w\-]/[\w\-.]*\.{FILE_EXTENSIONS}(?!\w)"
)
COMMAND_STUB_PATTERN = (
    r"(?i)</?(command-name|command-message|command-args|local-command-stdout|local-command-stderr)>"
)
INTERRUPT_PATTERN = r"(?i)\[Request interrupted by user"


def is_correction(text: Column) -> Column:
    return F.rlike(text, F.lit(CORRECTION_PATTERN))


def is_long_run(command: Column) -> Column:
    return F.rlike(F.coalesce(command, F.lit("")), F.lit(LONG_RUN_PATTERN))


def is_thinking(text: Column) -> Column:
    return F.rlike(text, F.lit(THINKING_PATTERN))


def is_human_prompt(text: Column, is_meta: Column) -> Column:
    """A person's instruction: not marked as machine text, no command stub, no interrupt mark, not blank."""
    return (
        ~F.coalesce(is_meta, F.lit(False))
        & text.isNotNull()
        & ~F.rlike(text, F.lit(COMMAND_STUB_PATTERN))
        & ~F.rlike(text, F.lit(INTERRUPT_PATTERN))
        & (strip_ws(text) != "")
    )


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def structured(text: Column) -> Column:
    return F.contains(text, F.lit("```")) | F.rlike(text, F.lit(LIST_PATTERN))


def file_ref(text: Column) -> Column:
    return F.rlike(text, F.lit(FILE_REF_PATTERN))


def constraint(text: Column, low: Column) -> Column:
    return _any(
        [F.contains(low, F.lit(w)) for w in CONSTRAINT_WORDS_EN]
        + [F.contains(text, F.lit(w)) for w in CONSTRAINT_WORDS_ZH]
    )


def correction_start(text: Column) -> Column:
    low = F.lower(F.substring(text, 1, 16))
    return _any(
        [F.startswith(low, F.lit(w)) for w in CORRECTION_STARTS_EN]
        + [F.startswith(text, F.lit(w)) for w in CORRECTION_STARTS_ZH]
    )


def prompt_flags(text: Column, low: Column | None = None) -> dict[str, Column]:
    """Length in code points and the four flags of a trimmed prompt; ``low`` is its lower-case column if there is one."""
    return {
        "len": F.length(text).cast("bigint"),
        "structured": structured(text),
        "file_ref": file_ref(text),
        "constraint": constraint(text, F.lower(text) if low is None else low),
        "correction": correction_start(text),
    }
