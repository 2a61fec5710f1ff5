"""From a request in words to a plan: parsing a model's answer, rules that overrule it, and the steps of a workflow."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.targeting import canonical_city, match_industry
from ..functions.text import col, placeholder_to_null, strip
from ..schema import UNDERSTANDING

WORKFLOWS: dict[str, list[str]] = {"lead_generation": ["search", "enrichment", "validation", "contact", "export"]}
DEFAULT_WORKFLOW = "lead_generation"


def without_fence(c: Column | str) -> Column:
    """A Markdown code block's content, other text as it is."""
    text = strip(col(c))
    body = F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*(?:\n|$)", ""), r"(?:^|\n)[ \t]*```[ \t]*$", "")
    return strip(F.when(text.startswith("```"), body).otherwise(text))


def parsed_answer(c: Column | str) -> Column:
    """A struct of the answer's fields; null if it is no JSON object or lacks intent or confidence."""
    parsed = F.from_json(without_fence(c), UNDERSTANDING)
    return F.when(parsed["intent"].isNotNull() & parsed["confidence"].isNotNull(), parsed)


def planned(df: DataFrame, query: str = "user_query") -> DataFrame:
    """workflow, industry, location and buyer_persona after the rules: what the request names wins over the model's fields."""
    workflow = placeholder_to_null("workflow")
    return df.withColumns(
        {
            "workflow": F.when(workflow.isin(*WORKFLOWS), workflow).otherwise(DEFAULT_WORKFLOW),
            "industry": F.coalesce(match_industry(query), placeholder_to_null("industry")),
            "location": F.coalesce(canonical_city(query), placeholder_to_null("location")),
            "buyer_persona": placeholder_to_null("buyer_persona"),
        }
    )


def request_of(plan: dict[str, Any], max_results: int = 100) -> dict[str, Any]:
    """The search request of a plan."""
    persona = plan.get("buyer_persona")
    return {"industry": plan.get("industry"), "location": plan.get("location"), "keywords": [persona] if persona else [], "max_results": max_results}


Step = Callable[[DataFrame, "Context"], DataFrame]


@dataclass
class Context:
    """What steps may read, and what they report."""

    plan: dict[str, Any]
    tables: dict[str, DataFrame] = field(default_factory=dict)
    listener: Callable[[str, str], None] | None = None
    events: list[tuple[str, str]] = field(default_factory=list)

    def tell(self, step: str, status: str) -> None:
        self.events.append((step, status))
        if self.listener:
            self.listener(step, status)


def run_workflow(companies: DataFrame, context: Context, steps: dict[str, Step]) -> DataFrame:
    """The plan's steps in order, one lazy plan in the end; a step without a function leaves the rows as they are."""
    for name in WORKFLOWS[context.plan.get("workflow", DEFAULT_WORKFLOW)]:
        context.tell(name, "running")
        try:
            companies = companies.transform(steps[name], context) if name in steps else companies
        except Exception:
            context.tell(name, "failed")
            raise
        context.tell(name, "completed")
    return companies


class JobFailed(RuntimeError):
    """A remote job ended without a result."""


def endpoint(base: str, mode: str = "sync") -> str:
    """Where a request goes; async mode replaces a trailing runsync by run."""
    root = base.strip().rstrip("/")
    if not root:
        raise ValueError("a base address is needed")
    if mode == "sync":
        return root
    return root.removesuffix("/runsync").removesuffix("/run") + "/run"


def status_endpoint(base: str, job_id: str) -> str:
    if not job_id:
        raise ValueError("a job id is needed")
    return f"{base.strip().rstrip('/').removesuffix('/runsync').removesuffix('/run')}/status/{job_id}"


def request_payload(system: str, user: str, temperature: float, max_tokens: int, mode: str = "prompt") -> dict[str, Any]:
    """A worker's input: one prompt, or a list of messages."""
    if mode == "messages":
        asked: dict[str, Any] = {"messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
    else:
        asked = {"prompt": f"{system}\n\nUser: {user}\n\nAssistant:"}
    return {"input": asked | {"sampling_params": {"temperature": temperature, "max_tokens": max_tokens}}}


def job_id_of(payload: Any) -> str | None:
    if not isinstance(payload, dict):
        return None
    nested = payload["data"] if isinstance(payload.get("data"), dict) else {}
    ids = [payload.get(k) for k in ("id", "run_id", "run_key", "job_id")] + [nested.get(k) for k in ("id", "run_id")]
    return next((i for i in ids if i), None)


def poll(ask: Callable[[], Any], text_of: Callable[[Any], str | None], tries: int = 12, deadline: float = 120.0, first_wait: float = 1.0, longest_wait: float = 8.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> str:
    """Ask until a job is done: waits double up to a limit; a failed job raises at once."""
    wait, end = first_wait, clock() + deadline
    for _ in range(tries):
        payload = ask()
        state = str(payload.get("status", "")).upper() if isinstance(payload, dict) else ""
        if state in ("FAILED", "CANCELLED", "TIMED_OUT"):
            message = next((payload[k].strip() for k in ("error", "message", "detail") if isinstance(payload.get(k), str) and payload[k].strip()), state)
            raise JobFailed(message)
        if state in ("", "COMPLETED") and (text := text_of(payload)):
            return text
        if clock() + wait > end:
            break
        sleep(wait)
        wait = min(2 * wait, longest_wait)
    raise JobFailed("no result in time")


def parse_answer(text: str) -> dict[str, Any]:
    """The driver-side form of ``parsed_answer``; raises ValueError."""
    lines = text.strip().splitlines()
    if lines and lines[0].strip().startswith("```"):
        lines = lines[1:]
        if lines and lines[-1].strip() == "```":
            lines = lines[:-1]
    try:
        fields = json.loads("\n".join(lines))
    except json.JSONDecodeError as e:
        raise ValueError("the answer is no JSON") from e
    if not isinstance(fields, dict) or not isinstance(fields.get("intent"), str) or not isinstance(fields.get("confidence"), (int, float)):
        raise ValueError("the answer lacks intent or confidence")
    return fields
