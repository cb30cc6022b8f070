"""Pluggable quality control: what computes flags, derives a status and sums up can be exchanged; the flow is the same."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quality as ql


class FlagComputer(Protocol):
    def flags(self, df: DataFrame) -> dict[str, Column]:
        """Named conditions over the columns of ``df``; null counts as false."""


class StatusDeriver(Protocol):
    def status(self, flags: list[str]) -> Column:
        """The status of a row whose flags stand in columns of these names."""


class AuditSummary(Protocol):
    def summary(self, flagged: DataFrame, flags: list[str], status: str) -> DataFrame:
        """Counts only: no text may be in it."""


@dataclass
class SideFlags:
    """The flags of ``quality.side_flags`` that hold if either side has them."""

    ko: str = "ko_text_analysis"
    en: str = "en_text_analysis"
    names: dict[str, str] = field(default_factory=lambda: {"empty_text_flag": "empty", "decode_integrity_flag": "decode", "markup_dominant_flag": "markup", "control_char_excess_flag": "control"})

    def flags(self, df: DataFrame) -> dict[str, Column]:
        k, e = ql.side_flags(self.ko, self.ko, "ko"), ql.side_flags(self.en, self.en, "en")
        return {n: k[c] | e[c] for n, c in self.names.items()}


@dataclass
class FirstFlag:
    """The first true flag, in the order given, else ``accepted``."""

    accepted: str = "accepted"

    def status(self, flags: list[str]) -> Column:
        return F.coalesce(*(F.when(F.col(f), F.lit(f)) for f in flags), F.lit(self.accepted))


@dataclass
class FlagCounts:
    """``status, n`` and how many rows of each status have each flag."""

    def summary(self, flagged: DataFrame, flags: list[str], status: str) -> DataFrame:
        return flagged.groupBy(status).agg(F.count("*").alias("n"), *(F.count_if(F.col(f)).alias(f) for f in flags))


def run(df: DataFrame, computer: FlagComputer, deriver: StatusDeriver, audit: AuditSummary, status: str = "status") -> tuple[DataFrame, DataFrame]:
    """``df`` with flags and status, existing columns of the same names replaced, and the audit's summary."""
    flags = computer.flags(df)
    flagged = df.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in flags.items()})
    flagged = flagged.withColumn(status, deriver.status(list(flags)))
    return flagged, audit.summary(flagged, list(flags), status)
