"""Questions in words to operations of the engine, by rules; a model-backed planner has the same shape."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Protocol


@dataclass
class Step:
    operation: str
    args: tuple = ()
    kwargs: dict = field(default_factory=dict)


class SqlPlanner(Protocol):
    """Turns a question and the tables' schema into SQL for Engine.execute_query."""

    def plan(self, question: str, schema: str) -> str: ...


def _quoted(q: str) -> str | None:
    m = re.search(r"""["'“”‘’](.+?)["'“”‘’]""", q)
    return m[1] if m else None


def _window(q: str) -> str | None:
    m = re.search(r"(\d+)\s*(second|minute|hour|day|week|s|m|h|d|w)s?\b", q, re.I)
    return f"{m[1]}{m[2][0].lower()}" if m else None


def plan(question: str) -> Step:
    """The first rule that fits; ValueError if none does."""
    q, text, window = question.lower(), _quoted(question), _window(question)
    if re.match(r"\s*(select|with)\b", q):
        return Step("execute_query", (question,))
    more = {"window": window} if window else {}
    rules = [
        (r"\b(why|caus)", text is not None, Step("analyze_causality", (text,), more)),
        (r"\bcompare\b", len(re.findall(r"[\"'](.+?)[\"']", question)) >= 2, Step("compare_events", tuple(re.findall(r"[\"'](.+?)[\"']", question)[:2]))),
        (r"\b(users?|customers?)\b.*\b(affected|impact)|\bimpact", text is not None, Step("analyze_user_impact", (text,))),
        (r"\b(depend|services?)\b", True, Step("analyze_service_dependencies")),
        (r"\b(around|context)\b.*?(\d+)", True, Step("get_event_context", (int((re.search(r"(?:event|id|around|context)\D*(\d+)", q) or [0, "0"])[1]),), more)),
        (r"\bhow (many|often)\b|\bcount\b", text is not None, Step("count_occurrences", (text,), {"group_by": "level"} if "level" in q else {})),
        (r"\b(trend|frequent|common|top)", True, Step("get_trending_patterns", (), more)),
        (r"\b(time range|time span|first and last|when do)", True, Step("get_time_range")),
        (r"\b(similar|like)\b", text is not None, Step("search_similar_templates", (text,))),
        (r"\b(summar|overview|per level|by level)", True, Step("summarize_logs")),
        (r"\bstatistic", True, Step("calculate_statistics")),
        (r"\b(errors?|warnings?)\b", text is None, Step("filter_by_level", ([x for w, x in (("error", "ERROR"), ("warn", "WARN")) if w in q],))),
        (r"\b(latest|recent|last)\b", text is None, Step("latest_logs")),
        (r"\b(find|search|show|grep)\b", text is not None, Step("search_logs", (text,))),
    ]
    for pattern, ok, step in rules:
        if ok and re.search(pattern, q):
            return step
    raise ValueError(f"no operation fits the question: {question!r}")
