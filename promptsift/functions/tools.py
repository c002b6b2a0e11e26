"""Predicates and rewrites for an agent's tool calls, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SHELL_TOOLS = ("bash", "shell", "powershell", "read_powershell")
VIEW_TOOLS = ("view", "read", "read_file", "str_replace_based_edit_tool")
SHELL_LIMIT, VIEW_LIMIT, REMOTE_LIMIT, OTHER_LIMIT = 2000, 500, 1000, 1500
SKIPPED_TOOLS = ("report_intent", "sql", "notification")
SHELL_NAME = r"(?i)(^|[_.-])(bash|shell|powershell|sh|zsh|fish)$"
NOISY = (
    "kubectl|oc|helm|psql|mysql|sqlite3|az|gcloud|aws|curl|wget|Invoke-WebRequest|Invoke-RestMethod|iwr|irm|gh api|journalctl|dmesg|ps |"
    "netstat|lsof|iptables|systemctl|docker (ps|inspect|logs)|terraform (show|plan)"
)
SPILL_FILE = r"copilot-tool-output-[A-Za-z0-9_-]+\.txt"
PROFILES_BY_COMMAND = {"k8s": ("kubectl", "oc", "helm"), "postgres": ("psql", "mysql", "sqlite3"), "azure": ("az", "gcloud", "aws")}
WRAPPER = "promptsift"
NUDGE = " small reads this session. For bulk pattern analysis, prefer bash like `grep -A 5 PATTERN file` or `cat file | head -N` — bash outputs auto-funnel via promptsift (often 90%+ savings on logs).]"
SUMMARY_LEAD = " (file is dedup-able; consider asking for the pattern rather than line-by-line reads):\n"
SUMMARY_END = "\n--- requested slice below ---]"
#: Why a result isn't looked at.
DISABLED, FAILED, PASSED, BOOKKEEPING, LISTED, REDUCED = "disabled", "unexpected-error", "passed", "internal-bookkeeping", "user-skip-list", "already-funneled"
FETCH_HINT = "[promptsift] web_fetch bypasses postToolUse; consider Invoke-RestMethod via powershell for funneling"


def threshold(tool: Column, override: int | None = None) -> Column:
    """Tokens from which a tool's result is reduced."""
    if override is not None:
        return F.lit(override)
    remote = tool.startswith("mcp:") | tool.contains("__")
    return F.when(tool.isin(*SHELL_TOOLS), SHELL_LIMIT).when(tool.isin(*VIEW_TOOLS), VIEW_LIMIT).when(remote, REMOTE_LIMIT).otherwise(OTHER_LIMIT)


def is_view(tool: Column) -> Column:
    return tool.isin(*VIEW_TOOLS)


def is_bookkeeping(tool: Column) -> Column:
    return tool.isin(*SKIPPED_TOOLS) | tool.startswith("todo_")


def is_skipped(tool: Column, more: Sequence[str] = ()) -> Column:
    """Bookkeeping tools, and those that a user lists."""
    return is_bookkeeping(tool) | tool.isin(*(m.replace(" ", "") for m in more))


def is_reduced(text: Column) -> Column:
    """The first 200 bytes have a line that only reduced texts have."""
    marks = r"(?md)^(### |\[" + WRAPPER + ")"
    at = F.regexp_instr(text, F.lit(marks))
    size = F.octet_length(F.substring(text, F.lit(1), at - 1)) + F.length(F.regexp_extract(text, marks, 1))
    return (at > 0) & (size <= 200)


def guard(tool: Column, result_type: Column, result: Column, more: Sequence[str] = (), disabled: bool = False, broken: Column | None = None) -> Column:
    """Why a result passes as it is, whatever its session; empty where the session decides.

    broken: whether the payload can't be read, which is an error of its own row only.
    """
    silent = (tool == "") | (result == "") | (result_type != "success")
    listed = tool.isin(*(m.replace(" ", "") for m in more))
    found = F.when(silent, PASSED).when(is_bookkeeping(tool), BOOKKEEPING).when(listed, LISTED).when(is_reduced(result), REDUCED).otherwise("")
    if disabled:
        return F.lit(DISABLED)
    return found if broken is None else F.when(broken, FAILED).otherwise(found)


def is_noisy(command: Column, more: str = "") -> Column:
    """The command begins with one whose output is long as a rule."""
    left = F.regexp_replace(command, r"(?U)\A\s+", "")
    found = left.rlike(f"(?i)^({NOISY}) ")
    return found | left.rlike(f"(?i)^({more}) ") if more else found


def profile_of(command: Column) -> Column:
    """By how the command begins, with no word's end asked for."""
    left = F.regexp_replace(command, r"(?U)\A\s+", "")
    out = F.lit("passthrough")
    for name, starts in reversed(PROFILES_BY_COMMAND.items()):
        out = F.when(left.rlike("^(" + "|".join(starts) + ")"), name).otherwise(out)
    return out


def is_rewritten(tool: Column, command: Column, more: str = "") -> Column:
    """A noisy shell command that isn't wrapped and doesn't read a spill file."""
    wrapped = command.rlike(r"\| ?" + WRAPPER + "( |$)") | command.rlike(SPILL_FILE)
    return tool.rlike(SHELL_NAME) & (command != "") & ~wrapped & is_noisy(command, more)


def rewritten(tool: Column, command: Column, query: str = "", budget: int = 2000, keep: int = 5) -> Column:
    """The command with its output sent through the funnel."""
    inner = F.when(tool == "powershell", F.concat(F.lit("& { "), command, F.lit(" } 2>&1"))).otherwise(F.concat(F.lit("( "), command, F.lit(" ) 2>&1")))
    asked = "--query '" + query.replace("'", "'\\''") + "' " if query else ""
    return F.concat(inner, F.lit(f" | {WRAPPER} {asked}--profile "), profile_of(command), F.lit(f" --budget {budget} --keep {keep}"))


def is_muted(setting: str) -> bool:
    """What users write to turn a log or a hint off. Fixed values."""
    return setting in ("off", "OFF", "disabled", "DISABLED", "0")


def hint(tool: Column, setting: str = "on") -> Column:
    return F.when((tool == "web_fetch") & F.lit(not is_muted(setting)), F.lit(FETCH_HINT))


def allowed(tool: Column, args: Column, query: str = "", budget: int = 2000, keep: int = 5, more: str = "", hints: str = "on", disabled: bool = False) -> Column:
    """What a hook says before a tool runs, as JSON: to go on, with a hint or with the command rewritten.

    args: the tool's arguments as JSON; all but the command stay as they are.
    """
    fields = F.from_json(args, "map<string, variant>")
    command = F.coalesce(F.get_json_object(args, "$.command"), F.lit(""))
    new = rewritten(tool, command, query, budget, keep)
    changed = F.transform_values(fields, lambda k, v: F.when(k == "command", new.cast("variant")).otherwise(v))
    plain = F.lit('{"permissionDecision":"allow"}')
    if disabled:
        return plain
    go_on = F.lit("allow").alias("permissionDecision")
    said = F.to_json(F.struct(go_on, hint(tool, hints).alias("additionalContext")))
    wrapped = F.to_json(F.struct(go_on, changed.alias("modifiedArgs"), F.concat(F.lit(f"[{WRAPPER}:pre-bash:"), profile_of(command), F.lit("]")).alias("additionalContext")))
    return F.when(hint(tool, hints).isNotNull(), said).when(is_rewritten(tool, command, more), wrapped).otherwise(plain)
