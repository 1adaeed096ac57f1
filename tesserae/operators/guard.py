"""Which tool calls a search engine should answer instead: decisions over JSON rows, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tool names and command words, patterns that both engines read.
GREP, GLOB, SEMANTIC, SHELL = "grep|grep_search", "glob|glob_file_search", "semanticsearch|codebase_search", "shell|bash|execute_bash"
BUILD_WORDS = "git|npm|bun|pnpm|yarn|cargo|go|make|cmake|docker|kubectl|pytest|jest|vitest"
SEARCH_WORDS = "rg|ripgrep|grep|find|ag|ack|fd|locate"
LITERALS = (r"^[`'\"][^`'\"]+[`'\"]$", r"^[A-Z][A-Z0-9_]{2,}$", r"^[A-Fa-f0-9-]{36}$")
NAME = r"^[a-zA-Z_][a-zA-Z0-9_.]*$"
GREP_FIELDS = ("pattern", "query", "regex", "needle", "search_term")
GLOB_FIELDS = ("glob_pattern", "pattern", "glob", "path")


def word(words: str) -> str:
    """Any of the words, bounded by other than ASCII word characters or the ends."""
    return rf"(^|[^A-Za-z0-9_])({words})([^A-Za-z0-9_]|$)"


def field(payload: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.get_json_object(payload, f"$.tool_input.{n}") for n in names], F.lit(""))


def is_literal(pattern: Column) -> Column:
    p = F.trim(pattern)
    out = p.rlike(NAME) & (F.length(p) <= 48)
    for x in LITERALS:
        out |= p.rlike(x)
    return out


def is_exploration(command: Column) -> Column:
    return ~command.rlike(word(BUILD_WORDS)) & command.rlike(word(SEARCH_WORDS))


def is_descriptor_glob(pattern: Column) -> Column:
    p = F.lower(F.replace(pattern, F.lit("\\"), F.lit("/")))
    return p.contains("/mcps/") | p.contains("mcps/**/tools")


def blocked(payload: Column, own_name: str = "tesserae") -> Column:
    """Whether the call (JSON with tool_name and tool_input) is an exploratory search; the engine's own tools pass."""
    tool = F.lower(F.coalesce(F.get_json_object(payload, "$.tool_name"), F.lit("")))
    named = lambda names: tool.rlike(f"^({names})$")
    out = F.when((tool == "") | tool.contains(own_name), False).when(named(GREP), ~is_literal(field(payload, GREP_FIELDS)))
    out = out.when(named(GLOB), ~is_descriptor_glob(field(payload, GLOB_FIELDS))).when(named(SEMANTIC), True)
    return out.when(named(SHELL), is_exploration(field(payload, ("command", "cmd")))).otherwise(False)


def response_format(payload: Column) -> Column:
    event = F.coalesce(F.get_json_object(payload, "$.hook_event_name"), F.lit(""))
    return F.when(event == "PreToolUse", "claude").when(event == "BeforeTool", "gemini").when(event.isin("preToolUse", "windsurf_pre_run_command"), "stderr").otherwise("cursor")
