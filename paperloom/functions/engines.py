"""Engines as functions over batches of pages: a registry, rule-based ones, a mock, and their contract."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layout, tables

CAPABILITIES = ("extract_native", "layout", "ocr", "table", "formula", "quality")
ALIASES = {"text": "ocr", "tables": "table", "formulas": "formula"}


@dataclass(frozen=True)
class Engine:
    """``execute`` maps pages to evidence rows ``key, ordinal, kind, text`` without collecting them."""

    engine_id: str
    capabilities: tuple[str, ...]
    execute: Callable[[DataFrame, str], DataFrame]
    ram: int | None = None
    millis: int | None = None
    devices: tuple[str, ...] = ("cpu",)
    network_use: str = "none"


@dataclass
class Registry:
    engines: dict[str, Engine] = field(default_factory=dict)

    def register(self, engine: Engine) -> None:
        if engine.engine_id in self.engines:
            raise ValueError(f"engine {engine.engine_id} is registered already")
        if not engine.capabilities or set(engine.capabilities) - set(CAPABILITIES):
            raise ValueError(f"engine {engine.engine_id} has no or unknown capabilities")
        self.engines[engine.engine_id] = engine

    def able(self, capability: str) -> list[Engine]:
        name = ALIASES.get(capability, capability)
        return [e for _, e in sorted(self.engines.items()) if name in e.capabilities]


def mocked(pages: DataFrame, key: str) -> DataFrame:
    return pages.select(key, F.lit(0).alias("ordinal"), F.lit("paragraph").alias("kind"), F.concat(F.lit("mock:"), F.coalesce("text", F.lit(""))).alias("text"))


def table_rows(pages: DataFrame, key: str) -> DataFrame:
    found = tables.tables(pages, key)
    return found.select(key, F.posexplode("cells").alias("ordinal", "row")).select(key, "ordinal", F.lit("table").alias("kind"), F.array_join(F.transform("row", lambda c: c["text"]), " | ").alias("text"))


def standard() -> Registry:
    registry = Registry()
    registry.register(Engine("rules.layout", ("layout",), layout.text_blocks, 16 << 20, 10))
    registry.register(Engine("rules.table", ("table",), table_rows, 32 << 20, 5))
    registry.register(Engine("mock", ("ocr",), mocked, 1 << 20, 1))
    return registry


def violations(engine: Engine, pages: DataFrame, key: str) -> list[str]:
    """What an engine breaks of its contract on some pages: its columns, and the same rows twice."""
    found = engine.execute(pages, key)
    broken = [] if found.columns == [key, "ordinal", "kind", "text"] else ["columns"]
    if found.exceptAll(engine.execute(pages, key)).limit(1).count():
        broken.append("not_deterministic")
    if engine.ram is None:
        broken.append("ram_unsourced")
    return broken
