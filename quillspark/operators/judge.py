"""Judging: an injected model's answers become verdicts, and every check ends in one bucket."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verdicts a model may give, and what is said without a passage.
VERDICTS = ("supported", "partially", "overstated", "unsupported")
NO_PASSAGE = "no relevant passage retrieved from the cited source"
RAW_CHARS, RATIONALE_CHARS = 200, 300


#: What stands before the claim and before its passages in a question to the model.
ASKED = ("Claim to check: ", "\n\nPassages of the source it cites:\n")


@runtime_checkable
class Model(Protocol):
    """A local model. One is made in each Python worker by the factory that is passed in."""

    def complete(self, system: str, user: str) -> str: ...


def fenced(raw: str) -> str:
    """The inside of a code fence if there is one."""
    m = re.search(r"```(?:json)?\s*(.+?)```", raw, re.DOTALL)
    return m.group(1) if m else raw


def verdict_of(raw: str | None) -> tuple[str, str, float]:
    """A model's answer as verdict, rationale, confidence. What can't be read needs a reviewer: unsupported."""
    raw = raw or ""
    try:
        data = json.loads(fenced(raw))
    except ValueError:
        return "unsupported", raw[:RAW_CHARS], 0.0
    if not isinstance(data, dict):
        return "unsupported", "", 0.0
    said, why, sure = data.get("verdict"), data.get("rationale"), data.get("confidence", 0.0)
    try:
        number = float(sure)
        confidence = 1.0 if math.isnan(number) else min(1.0, max(0.0, number))
    except (TypeError, ValueError):
        confidence = 0.0
    return said if isinstance(said, str) and said in VERDICTS else "unsupported", ("" if why is None else str(why))[:RATIONALE_CHARS], confidence


def parse_verdicts(rows: DataFrame, raw_col: str = "raw") -> DataFrame:
    """rows with verdict, rationale, confidence: strict JSON, which no built-in parser checks."""

    @F.pandas_udf("verdict string, rationale string, confidence double")
    def parse(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([verdict_of(x) for x in raw], columns=["verdict", "rationale", "confidence"])

    return rows.withColumn("parsed", parse(F.col(raw_col))).select(*rows.columns, "parsed.*")


def judge(checks: DataFrame, make_model: Callable[[], Model], system: str) -> DataFrame:
    """check_id, raw, failed: the model's answer to claim and snippets (array). Checks without a passage never reach the model, and one failure spoils one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            out = []
            for check_id, claim, snippets in zip(batch["check_id"], batch["claim"], batch["snippets"], strict=True):
                try:
                    out.append((check_id, model.complete(system, ASKED[0] + claim + ASKED[1] + "\n".join(f"- {s}" for s in snippets)), False))
                except Exception:  # the row says so
                    out.append((check_id, None, True))
            yield pd.DataFrame(out, columns=["check_id", "raw", "failed"])

    asked = checks.where(F.size("snippets") > 0).select(F.col("check_id").cast("string").alias("check_id"), "claim", "snippets")
    return asked.mapInPandas(run, "check_id string, raw string, failed boolean")


def settle(kind: Column, resolution: Column, has_path: Column, read_failed: Column, n_passages: Column, verdict: Column) -> tuple[Column, Column]:
    """Verdict and resolution of a check after the run; the first rule that holds decides."""
    open_ = (resolution != "resolved") | ~has_path
    said = F.when(kind == "non_checkable", "not_a_claim").when(open_ | read_failed, "unchecked").when(n_passages == 0, "not_found").otherwise(F.coalesce(verdict, F.lit("unchecked")))
    outcome = F.when((kind != "non_checkable") & ~open_ & read_failed, "unreadable_source").otherwise(resolution)
    return said, outcome


def bucket(verdict: Column, resolution: Column) -> Column:
    return F.when(verdict != "unchecked", verdict).otherwise(resolution)
