"""Commands, paths, names and error texts reduced to safe labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# White space as log writers define it: wider than the regex engine's own class.
WS = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
NOT_WS = WS.replace("[", "[^", 1)

# Version-control subcommands that may appear in a report.
GIT_SUBCOMMANDS = [
    "add", "commit", "push", "pull", "fetch", "diff", "status", "log", "checkout", "branch", "merge", "rebase",
    "stash", "show", "reset", "clone", "switch", "restore", "tag", "cherry-pick", "revert", "rev-parse", "remote",
    "init", "blame",
]

# Words in front of a command that only start a shell.
SHELL_WRAPPERS = ["bash", "sh", "zsh", "fish", "-lc", "-c", "env"]

# Error categories and their patterns, first match wins.
# (?<!\w) and (?!\w) stand for an ASCII word boundary.
ERROR_PATTERNS = [
    ("not-read", r"(?i)not been read|read it first before"),
    ("permission", r"(?i)permission denied|EACCES|not permitted|operation not permitted"),
    ("timeout", r"(?i)ETIMEDOUT|timed out|deadline exceeded"),
    ("network", r"(?i)ECONNREFUSED|ENOTFOUND|EAI_AGAIN|getaddrinfo|fetch failed|network is unreachable"),
    ("test", r"(?i)(?<!\w)FAIL(?!\w)|tests? failed|assertionerror|✗ "),
    ("git", r"(?i)fatal:|not a git repository|exit code 128"),
    ("build", r"(?i)npm (err|error)|cannot find module|(?<!\w)tsc(?!\w)|build failed|cargo |compil(e|ation)|(?<!\w)go: "),
]

# File extension -> language label.
EXT_LANGUAGE = {
    "py": "Python", "go": "Go", "js": "JavaScript", "jsx": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript",
    "rs": "Rust", "java": "Java", "kt": "Kotlin", "swift": "Swift", "c": "C", "h": "C/C++ Header", "cc": "C++",
    "cpp": "C++", "cxx": "C++", "hpp": "C++ Header", "rb": "Ruby", "php": "PHP", "cs": "C#", "sh": "Shell",
    "bash": "Shell", "zsh": "Shell", "fish": "Shell", "html": "HTML", "htm": "HTML", "css": "CSS", "scss": "CSS",
    "less": "CSS", "md": "Markdown", "json": "JSON", "yaml": "YAML", "yml": "YAML", "toml": "TOML", "xml": "XML",
    "sql": "SQL", "vue": "Vue", "svelte": "Svelte", "dart": "Dart", "scala": "Scala", "lua": "Lua", "r": "R",
    "ipynb": "Jupyter", "txt": "Text", "cfg": "Config", "ini": "Config", "env": "Config", "gradle": "Gradle",
    "proto": "Protobuf",
}
# Labels that never count as the main language of a repository.
AUXILIARY_LANGUAGES = ["Markdown", "Config", "Text", "JSON", "YAML", "TOML", "XML"]

# Hosts run by the model vendors themselves.
OFFICIAL_HOSTS = ["api.anthropic.com", "api.openai.com", "chatgpt.com"]


# The same characters one by one, for trimming without a pattern.
WS_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def strip_ws(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def collapse_ws(text: Column) -> Column:
    return F.regexp_replace(text, rf"{WS}+", " ")


def words(text: Column) -> Column:
    """Non-empty words of a text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"{WS}+"), lambda w: w != "")


def base_name(path: Column) -> Column:
    r"""Part after the last ``/`` or ``\``."""
    return F.regexp_extract(path, r"([^\\/]*)\z", 1)


def ext_of(path: Column) -> Column:
    base = base_name(F.coalesce(path, F.lit("")))
    return F.when(F.contains(base, F.lit(".")), F.lower(F.substring_index(base, ".", -1))).otherwise(F.lit(""))


def repo_name(cwd: Column) -> Column:
    name = base_name(F.regexp_replace(F.coalesce(cwd, F.lit("")), r"[\\/]+\z", ""))
    return F.when(name == "", F.lit("(unknown)")).otherwise(name)


def repo_key(origin: Column, cwd: Column) -> Column:
    """Last part of a remote URL without ``.git``, else the folder name."""
    url = F.regexp_replace(F.regexp_replace(F.coalesce(origin, F.lit("")), r"/+\z", ""), r"\.git\z", "")
    last = F.regexp_extract(url, r"([^/ :]*)\z", 1)
    return (
        F.when(url == "", repo_name(cwd)).when(last == "", F.lit("(unknown)")).otherwise(last)
    )


def first_token(command: Column) -> Column:
    """Base name of the first word that is not a ``NAME=value`` assignment; empty when there is none."""
    real = F.filter(words(command), lambda w: ~F.rlike(w, F.lit(r"^[A-Za-z_][A-Za-z0-9_]*=")))
    return base_name(F.coalesce(F.get(real, F.lit(0)), F.lit("")))


def git_subcommand(command: Column) -> Column:
    """First non-flag word after the first ``git`` word when it is a known subcommand, else null."""
    parts = words(command)
    at = F.array_position(F.transform(parts, base_name), "git")
    rest = F.when(at > 0, F.slice(parts, at.cast("int") + 1, F.size(parts)))
    sub = F.lower(base_name(F.get(F.filter(rest, lambda w: ~F.startswith(w, F.lit("-"))), F.lit(0))))
    return F.when(sub.isin(GIT_SUBCOMMANDS), sub)


def unwrap_shell(command: Column) -> Column:
    """Drop leading shell-starting words, join the rest with single spaces."""
    parts = words(command)
    wrapped = F.transform(parts, lambda w: F.regexp_replace(w, "^[\"'`]+|[\"'`]+\\z", "").isin(SHELL_WRAPPERS))
    at = F.array_position(wrapped, False)
    return F.when(at > 0, F.array_join(F.slice(parts, at.cast("int"), F.size(parts)), " ")).otherwise(F.lit(""))


def command_from_args(args: Column) -> Column:
    """Command of a JSON argument text: ``cmd`` string or ``command`` word list."""
    v = F.try_parse_json(args)
    cmd = F.when(
        F.schema_of_variant(F.try_variant_get(v, "$.cmd", "variant")) == "STRING", F.try_variant_get(v, "$.cmd", "string")
    )
    listed = F.array_join(F.try_variant_get(v, "$.command", "array<string>"), " ")
    return F.coalesce(strip_ws(cmd), strip_ws(listed), F.lit(""))


def mcp_server(name: Column) -> Column:
    rest = F.substring(name, F.lit(6), F.length(name))
    return F.when(F.startswith(name, F.lit("mcp__")), F.substring_index(rest, "__", 1))


def mcp_tool(name: Column) -> Column:
    rest = F.substring(name, F.lit(6), F.length(name))
    at = F.instr(rest, "__")
    return F.when(
        F.startswith(name, F.lit("mcp__")),
        F.when(at > 0, F.substring(rest, at + F.lit(2), F.length(rest))).otherwise(F.lit("")),
    )


def tool_kind(name: Column) -> Column:
    return (
        F.when(name == "Bash", F.lit("shell"))
        .when(name.isin("WebFetch", "WebSearch"), F.lit("web"))
        .when(name.isin("Edit", "Write", "Read", "NotebookEdit"), F.lit("file"))
        .when(name.isin("Glob", "Grep", "ToolSearch"), F.lit("search"))
        .when(F.startswith(name, F.lit("mcp__")), F.lit("mcp"))
        .otherwise(F.lit("other"))
    )


def plugin_of(skill: Column) -> Column:
    """Text before the first ``:``; null when there is no plugin part."""
    return F.when(F.instr(skill, ":") > 1, F.substring_index(skill, ":", 1))


def skill_short(skill: Column) -> Column:
    at = F.instr(skill, ":")
    return F.when(at > 1, F.substring(skill, at + F.lit(1), F.length(skill))).otherwise(skill)


def source_key(source: Column) -> Column:
    s = F.lower(strip_ws(F.coalesce(source, F.lit(""))))
    return (
        F.when(s == "", F.lit("(unknown)"))
        .when(F.contains(s, F.lit("vscode")) | F.contains(s, F.lit("ide")), F.lit("plugin"))
        .when(F.contains(s, F.lit("codex-app")) | F.contains(s, F.lit("desktop")) | (s == "app"), F.lit("codex-app"))
        .when(F.contains(s, F.lit("cli")) | F.contains(s, F.lit("terminal")), F.lit("cli"))
        .otherwise(s)
    )


def classify_error(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    out = None
    for label, pattern in ERROR_PATTERNS:
        hit = F.rlike(t, F.lit(pattern))
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit("other"))


def language_of(ext: Column) -> Column:
    """Language label of an extension, null when unmapped."""
    table = F.create_map(*[F.lit(x) for pair in EXT_LANGUAGE.items() for x in pair])
    return F.try_element_at(table, F.lower(ext))


def diff_added(diff: Column) -> Column:
    return F.size(F.filter(F.split(diff, "\n"), lambda x: F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++"))))


def diff_removed(diff: Column) -> Column:
    return F.size(F.filter(F.split(diff, "\n"), lambda x: F.startswith(x, F.lit("-")) & ~F.startswith(x, F.lit("---"))))


def hunk_added(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda x: F.startswith(x, F.lit("+"))))


def hunk_removed(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda x: F.startswith(x, F.lit("-"))))


def url_host(url: Column) -> Column:
    """Lower-case host of a URL or a bare host, empty when it cannot be read."""
    u = strip_ws(F.coalesce(url, F.lit("")))
    full = F.when(F.rlike(u, F.lit("(?i)^[a-z]+://")), u).otherwise(F.concat(F.lit("https://"), u))
    return F.when(u == "", F.lit("")).otherwise(F.coalesce(F.lower(F.try_parse_url(full, F.lit("HOST"))), F.lit("")))


def host_class(host: Column) -> Column:
    return (
        F.when(host == "", F.lit("unknown")).when(host.isin(OFFICIAL_HOSTS), F.lit("official")).otherwise(F.lit("custom"))
    )
