"""Model catalogues: prices and speeds out of a gateway's JSON. Fetching is the caller's; a catalogue arrives as text."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions.text import per_million


@dataclass(frozen=True)
class Gateway:
    """Where a gateway keeps what in its JSON."""

    id: str
    base_url: str
    model: str
    key_env: str | None
    kind: str
    price: tuple[str, str, str, str] = ("input", "output", "input_cache_read", "input_cache_write")
    latency: str = ""
    throughput: str = ""


# The gateways' addresses, default models and JSON fields.
GATEWAYS = {
    g.id: g
    for g in (
        Gateway("vercel", "https://ai-gateway.vercel.sh/v1", "google/gemini-embedding-2", "AI_GATEWAY_API_KEY", "live", latency="latency_last_1h", throughput="throughput_last_1h"),
        Gateway(
            "openrouter", "https://openrouter.ai/api/v1", "google/gemini-embedding-001", "OPENROUTER_API_KEY", "live",
            ("prompt", "completion", "input_cache_read", "input_cache_write"), "latency_last_30m", "throughput_last_30m",
        ),
        Gateway("ollama", "http://localhost:11434/v1", "nomic-embed-text", None, "local"),
    )
}


class PricingError(Exception):
    def __init__(self, reason: str, gateway: str):
        super().__init__(f"{reason}: {gateway}")
        self.reason, self.gateway = reason, gateway


class ModelNotFound(PricingError):
    pass


def find(gateway: str) -> Gateway:
    if gateway not in GATEWAYS:
        raise PricingError("unknown-gateway", gateway)
    return GATEWAYS[gateway]


def api_key(gateway: Gateway, overrides: dict[str, str] | None = None, env: dict[str, str] | None = None) -> tuple[str | None, str | None]:
    """The key and the variable that it came from."""
    name = (overrides or {}).get(gateway.id) or gateway.key_env
    value = (os.environ if env is None else env).get(name or "", "").strip()
    return (value or None), name


def _text(row: Column, path: str) -> Column:
    return F.get_json_object(row, path)


def models(catalog: DataFrame, gateway: Gateway) -> DataFrame:
    """catalog (body) -> one row a model: id, prices for a million tokens, whether it reasons."""
    rows = catalog.select(F.explode(F.from_json(_text(F.col("body"), "$.data"), "array<string>")).alias("m"))
    names = ("price_in", "price_out", "price_cache_read", "price_cache_write")
    prices = [per_million(_text(F.col("m"), f"$.pricing.{field}")).alias(n) for n, field in zip(names, gateway.price, strict=True)]
    tags = F.from_json(_text(F.col("m"), "$.tags"), "array<string>")
    return rows.select(_text(F.col("m"), "$.id").alias("id"), *prices, F.coalesce(F.array_contains(tags, "reasoning"), F.lit(False)).alias("is_reasoning"))


def speeds(endpoints: DataFrame, gateway: Gateway) -> DataFrame:
    """endpoints (id, body) -> (id, seconds to the first token, tokens a second) of the first endpoint; null where not told."""
    at = "$.data.endpoints[0]"
    latency, rate = (_text(F.col("body"), f"{at}.{f}.p50").try_cast("double") for f in (gateway.latency or "none", gateway.throughput or "none"))
    told = latency.isNotNull() & rate.isNotNull()
    return endpoints.select("id", F.when(told, latency / 1000).alias("first_token_seconds"), F.when(told, rate).alias("tokens_per_second"))


def resolve(catalog: DataFrame | None, gateway: str, model: str) -> dict:
    """A model's prices; a local gateway is free."""
    g = find(gateway)
    if g.kind == "local":
        return {"price_in": 0.0, "price_out": 0.0, "price_cache_read": 0.0, "price_cache_write": 0.0, "source": "local", "source_label": f"{g.id} local (no billing)"}
    if catalog is None:
        raise PricingError("catalog-unavailable", gateway)
    row = models(catalog, g).where(F.col("id") == model).first()
    if row is None:
        raise ModelNotFound("model-not-found", gateway)
    return row.asDict() | {"source": "live", "source_label": f"{g.id} catalog"}
