"""Replay of recorded verdicts: patches applied to a text, and the bounded loop of check and retry. No model is called."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARROW = re.compile(r"[`'\"“]?(.+?)[`'\"”]?\s*(?:->|→|=>)\s*[`'\"“]?(.+?)[`'\"”]?\.?$")
CHANGE = re.compile(r"(?i)\b(?:change|replace)\s+['\"“`](.+?)['\"”`]\s+(?:to|with|by)\s+['\"“`](.+?)['\"”`]")
REMOVE = re.compile(r"(?i)\bremove\s+(?:the\s+)?(?:line\s+)?['\"“`](.+?)['\"”`]")


def patch_of(issue: dict) -> tuple[str, str] | None:
    """(old, new) of an issue: its own texts, or what its suggested fix says."""
    old, new = issue.get("current_text") or "", issue.get("expected_text")
    if old and new is not None:
        return old, new
    fix = (issue.get("suggested_fix") or "").strip()
    for rx in (CHANGE, ARROW):
        if m := rx.search(fix):
            return m[1], m[2]
    if m := REMOVE.search(fix):
        return m[1], ""
    return None


def replace_once(text: str, old: str, new: str) -> str | None:
    return text.replace(old, new) if old and text.count(old) == 1 else None


def apply_patches(text: str, issues: list[dict]) -> tuple[str, int]:
    """Patches in order, in their line where one is named; a line left empty is removed, which moves later lines up."""
    lines, done = text.split("\n"), 0
    for issue in issues:
        got = patch_of(issue)
        if got is None:
            continue
        old, new = got
        k = issue.get("line_index")
        if k is not None and 0 <= k < len(lines):
            t = replace_once(lines[k], old, new)
            if t is None:
                continue
            lines[k : k + 1] = [t] if t.strip() else []
            done += 1
            continue
        t = replace_once("\n".join(lines), old, new)
        if t is not None:
            lines = [x for x, y in zip(t.split("\n"), t.split("\n")) if x.strip() or y == ""]
            done += 1
    return "\n".join(lines), done


def outcome(attempts: list[dict], most: int = 3, confident: float = 0.7) -> dict:
    """How a loop over recorded verdicts ends: accepted, rejected, low_confidence, vague, repeated, unchanged or max_attempts."""
    before: tuple | None = None
    for k, a in enumerate(attempts[:most], 1):
        decision, sure = a.get("decision"), a.get("confidence")
        issues = [dict(x) for x in (a.get("issues") if a.get("issues") is not None else [])]
        sign = tuple(x.get("type") for x in issues)
        if decision == "accept":
            return {"outcome": "accepted", "attempts": k}
        if decision == "reject":
            return {"outcome": "rejected", "attempts": k}
        if sure is not None and sure < confident:
            return {"outcome": "low_confidence", "attempts": k}
        if not any((x.get("evidence") or "").strip() or patch_of(x) for x in issues):
            return {"outcome": "vague", "attempts": k}
        if sign and sign == before:
            return {"outcome": "repeated", "attempts": k}
        if a.get("text_before") is not None and a.get("text_before") == a.get("text_after"):
            return {"outcome": "unchanged", "attempts": k}
        before = sign
    return {"outcome": "max_attempts", "attempts": min(len(attempts), most)}


def replay(attempts: DataFrame, run: str = "run_id", order: str = "attempt") -> DataFrame:
    """run, outcome, attempts of each run's recorded verdicts (decision, confidence, issues, text_before, text_after)."""
    cols = [c for c in ("decision", "confidence", "issues", "text_before", "text_after") if c in attempts.columns]
    runs = attempts.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(order, *cols)), lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)).alias("a"))
    schema = T.StructType([attempts.schema[run], T.StructField("outcome", T.StringType()), T.StructField("attempts", T.IntegerType())])

    def go(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = []
            for k, a in zip(pdf[run], pdf["a"]):
                r = outcome([dict(x) for x in a])
                rows.append((k, r["outcome"], r["attempts"]))
            yield pd.DataFrame(rows, columns=[f.name for f in schema])

    return runs.mapInPandas(go, schema)
