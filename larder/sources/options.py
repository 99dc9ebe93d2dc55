"""Driver-side options (P-21, P-22), error classes (O-12), prompts (F-37) and the boundary to external models (S-12 to S-15)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Defaults and what is allowed.
POLICIES, FEATURES = ("skip", "raise"), ("DOCUMENT_TEXT_DETECTION", "TEXT_DETECTION")
TIMEOUT, SIDE = 30.0, 1500
#: Error classes, the most telling first.
ERRORS = ("auth_error", "quota_exceeded", "timeout", "generic_error")
LEVELS = ("simples", "padrão", "técnico")
KINDS = ("type1", "type2", "dmg")


@dataclass(frozen=True)
class Service:
    on_failure: str = "skip"
    cache: bool = True
    per_minute: int | None = None
    timeout: float = TIMEOUT
    warnings: tuple[str, ...] = field(default=())


def service(declared: dict[str, Any] | None) -> Service:
    """P-21: what isn't valid becomes the default; a bad policy or rate leaves a warning, a bad timeout doesn't."""
    given, warnings = declared or {}, []
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    policy, rate, timeout = given.get("on_failure", "skip"), given.get("max_requests_per_minute"), given.get("request_timeout_seconds")
    if policy not in POLICIES:
        warnings.append(f"on_failure: {policy!r} is neither of {POLICIES}")
        policy = "skip"
    if "max_requests_per_minute" in given and not (number(rate) and isinstance(rate, int) and rate > 0):
        warnings.append(f"max_requests_per_minute: {rate!r} is no positive whole number, so there is no limit")
        rate = None
    return Service(policy, bool(given.get("cache_enabled", True)), rate, float(timeout) if number(timeout) and timeout > 0 else TIMEOUT, tuple(warnings))


@dataclass(frozen=True)
class Detection:
    feature: str = FEATURES[0]
    hints: tuple[str, ...] = ("pt",)
    side: int = SIDE
    reconstruct: bool = False
    invalid: str | None = None


def detection(declared: dict[str, Any] | None) -> Detection:
    """P-22: a feature that is declared but unknown is marked and replaced by the default; an absent one is the default."""
    given = declared or {}
    feature = given.get("feature", FEATURES[0])
    known = isinstance(feature, str) and feature in FEATURES
    try:
        side = max(0, int(given.get("max_image_dimension", SIDE)))
    except (TypeError, ValueError):
        side = SIDE
    return Detection(feature if known else FEATURES[0], tuple(given.get("language_hints", ("pt",))), side, bool(given.get("table_reconstruction", False)), None if known else str(feature))


def error_of(classes: Column) -> Column:
    """O-12: struct (error, secondary): of an error's classes the one that tells most, then the others in that order."""
    order = F.array(*[F.lit(e) for e in ERRORS])
    known = F.filter(order, lambda e: F.array_contains(F.coalesce(classes, F.array().cast("array<string>")), e))
    found = F.when(F.size(known) > 0, known).otherwise(F.array(F.lit(ERRORS[-1])))
    return F.struct(found[0].alias("error"), F.slice(found, 2, F.size(found)).alias("secondary"))


def prompt(label: Column, body: Column, table: Column) -> Column:
    """F-37: a product's label if there is one, its analysis, and its table if there is one."""
    head = F.when(F.coalesce(label, F.lit("")) != "", F.concat(F.lit('Produto: "'), label, F.lit('"\n'))).otherwise("")
    tail = F.when(F.coalesce(table, F.lit("")) != "", F.concat(F.lit("\n\n--- Tabela Nutricional (apoio) ---\n"), table)).otherwise("")
    return F.concat(head, body, tail)


def is_refusal(text: Column) -> Column:
    """P-15: an explanation where a list was asked for: a marker, or over 60 characters without a comma; blank: no."""
    low = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""))
    marked = low.rlike("não há|nao ha|nenhum ingrediente|texto fornecido")
    return (low != "") & (marked | ((F.length(low) > 60) & ~F.contains(low, F.lit(","))))


def external(df: DataFrame, column: str, call: Callable[[list[str]], list[str | None]] | None = None) -> DataFrame:
    """S-12 to S-15: a column through an outside model in batches; without one, or if it fails or gives nothing, the
    original text stays."""
    if call is None:
        return df

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            given = texts.to_pylist()
            try:
                out = call(given)
            except Exception:  # whatever an outside model raises, the texts stay
                out = given
            yield pa.array([b or a for a, b in zip(given, out)], pa.string())

    return df.withColumn(column, F.arrow_udf(run, "string")(F.col(column)))
