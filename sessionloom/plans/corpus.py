"""Short label and text lists used to dress the rows of the ``events`` table as session records."""

COMMANDS = [
    "git status", "FOO=1 git -C /tmp/x commit -m wip", "npm test", "TOKEN=abc python3 train.py --epochs 3",
    "/usr/bin/git push origin main", "ls -la", "pytest -q tests", "bash run.sh", "git frobnicate now",
    "env A=b cargo build", "git diff HEAD~1", "make",
]
ERRORS = [
    "File has not been read yet", "EACCES: permission denied", "operation timed out", "getaddrinfo ENOTFOUND host",
    "2 tests failed", "fatal: not a git repository", "npm ERR! code 1", "something odd", "FAIL src/a.test.ts",
]
PROMPTS = [
    "Please fix the parser in src/app.py", "no,that is wrong; use the other file", "think harder about this design",
    "- must keep the tests\n- never touch the db", "Actually revert the change", "why does it crash?",
    "不对，应该是另一个", "Write docs for README.md only", "<command-name>clear</command-name>",
    "[Request interrupted by user]", "1) add a login page\n2) ensure it works", "Show me the plan",
]
SOURCES = ["cli", "vscode", "desktop"]
RAW_SOURCES = ["cli", "vscode-ext", "JetBrains IDE", "codex-app", "Terminal ", "", "web", "app", "my desktop"]
MODELS = ["claude-opus-4-8", "claude-sonnet-4-6", "gpt-5.1-codex", "GPT5.4-mini", "mystery"]
LABEL_FIELDS = ["version", "permission_mode", "skill", "effort", "approval_policy", "sandbox"]
LABELS = {
    "version": ["2.1.0", "2.1.1", "2.2.0"],
    "permission_mode": ["default", "plan", "acceptEdits"],
    "skill": ["tools:review", "tools:plan", "notes"],
    "effort": ["low", "medium", "high"],
    "approval_policy": ["never", "on-request", "untrusted"],
    "sandbox": ["read-only", "workspace-write", "full"],
}
EXTENSIONS = ["py", "ts", "md", "sql"]
RESULT_TOOLS = ["Bash", "Edit", "Grep"]
SHELL_ARGS = [
    '{"cmd":"  git   status "}', '{"command":["bash","-lc","git push"]}', '{"command":["zsh","-c","env","ls","-l"]}',
    "not json", '{"cmd":5}', '{"other":1}', '{"cmd":"\'bash\' -c pytest"}',
]
OUTPUTS = [
    '{"output":"ok","metadata":{"exit_code":0}}', '{"output":"fatal: bad","metadata":{"exit_code":128}}',
    '{"output":"x","exit_code":2,"interrupted":true}', "plain text", '{"metadata":{"interrupted":true}}', "[1,2]", "7",
]
DIFFS = [
    "--- a\n+++ b\n@@ -1 +1,2 @@\n-old\n+new\n+more", "", "+only\n+++skip\n-gone\n---skip", " context\n unchanged",
]
