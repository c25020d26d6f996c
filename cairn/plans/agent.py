"""A tool loop over the query functions: decisions come from outside, every step is a query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

STEPS, ROWS = 10, 8


@dataclass
class Step:
    tool: str
    args: dict = field(default_factory=dict)
    rows: list[dict] = field(default_factory=list)
    error: str = ""


def run(question: str, tools: dict[str, Callable[..., DataFrame]], decide: Callable[[str, list[Step]], tuple[str, dict]], steps: int = STEPS) -> tuple[str, list[Step]]:
    """(answer, steps): ``decide`` names a tool and its arguments, or ('finish', {"answer": ...}). A call that was made
    before ends the loop, as nothing new would come of it; an unknown tool or one that fails is a step with an error."""
    done: list[Step] = []
    seen: set[str] = set()
    for _ in range(steps):
        tool, args = decide(question, done)
        if tool == "finish":
            return str(args.get("answer", "")), done
        call = f"{tool} {sorted(args.items())}"
        if call in seen:
            break
        seen.add(call)
        step = Step(tool, args)
        done.append(step)
        if tool not in tools:
            step.error = "no such tool"
            continue
        try:
            step.rows = [r.asDict(recursive=True) for r in tools[tool](**args).limit(ROWS).collect()]
        except Exception as e:  # noqa: BLE001  arguments are foreign
            step.error = f"{type(e).__name__}"
    return "", done
