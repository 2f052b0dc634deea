"""Answers carry a verdict and the coverage behind it: an empty result is EMPTY only if all in scope was read."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUND, EMPTY, PARTIAL, NOT_VERIFIED = "FOUND", "EMPTY", "PARTIAL", "NOT VERIFIED"
CODES = ("Io", "Malformed", "NotFound", "Unsupported", "Mismatch", "Database", "Usage", "Limit", "Internal")


class Refusal(Exception):
    """The instrument could not look, or looked and failed: one line says what, why and what to do."""

    def __init__(self, code: str, operation: str, subject: str, reason: str, action: str = "", verified: bool = False):
        self.code, self.operation, self.subject, self.reason, self.action, self.verified = code, operation, subject, reason, action, verified
        super().__init__(f"{'Failed' if verified else 'NotVerified'} {code} {operation} [{subject}]: {reason}" + (f"; {action}" if action else ""))


@dataclass(frozen=True)
class Verdict:
    kind: str
    count: int = 0
    why: str = ""
    read: int = 0
    total: int = 0

    @property
    def incomplete(self) -> bool:
        return self.kind == EMPTY and self.read != self.total

    @property
    def effective(self) -> str:
        return PARTIAL if self.incomplete else self.kind

    @property
    def exit_code(self) -> int:
        return {NOT_VERIFIED: 2, PARTIAL: 3}.get(self.effective, 0)

    def line(self) -> str:
        if self.kind == NOT_VERIFIED:
            return f"verdict: NOT VERIFIED {self.why}"
        what = {PARTIAL: f"PARTIAL {'coverage incomplete' if self.incomplete else self.why}", FOUND: f"FOUND {self.count}"}.get(self.effective, EMPTY)
        return f"verdict: {what}  coverage {self.read}/{self.total}"


@dataclass
class Answer:
    """Rows to show, the verdict, and lines of text."""

    verdict: Verdict
    rows: DataFrame | None = None
    output: list[str] = field(default_factory=list)
    #: Lines to print before the output, as they come.
    stream: Iterator[str] | None = None

    def to_json(self) -> str:
        v = self.verdict
        return json.dumps({"verdict": v.effective, "count": v.count, "coverage": {"read": v.read, "total": v.total}, "reason": v.why, "output": self.output})


def judged(count: Column, read: Column, total: Column) -> Column:
    """The effective verdict of a count with its coverage."""
    return F.when(count > 0, FOUND).when(read == total, EMPTY).otherwise(PARTIAL)


def counted(rows: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row: verdict, count, read, total, from all rows and a one-row coverage (read, total)."""
    one = rows.agg(F.count("*").alias("count")).join(F.broadcast(coverage.select("read", "total")), F.lit(True))
    return one.select(judged(F.col("count"), F.col("read"), F.col("total")).alias("verdict"), "count", "read", "total")
