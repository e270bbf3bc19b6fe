"""Which model endpoint a request goes to: two decision tables as column expressions.

Endpoints are named by role: "primary", "hosted" (runs the primary's large model) and "gateway" (any model).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOSTED_MODELS = ("deepseek-v4-pro", "deepseek-ai/deepseek-v4-pro")
HOSTED_NAME = "deepseek-ai/deepseek-v4-pro"


def _overridden(provider: Column, rest: Column) -> Column:
    return F.when(provider.isin("hosted", "gateway", "primary"), provider).otherwise(rest)


def gateway_model(model: Column) -> Column:
    """A bare model name with the prefix that the gateway files it under."""
    low = F.lower(model)
    return F.when(F.contains(model, F.lit("/")), model).when(F.contains(low, F.lit("minimax")), F.concat(F.lit("mn/"), model)).when(F.contains(low, F.lit("deepseek")), F.concat(F.lit("deepseek/"), model)).otherwise(model)


def chat_endpoint(provider: Column, model: Column, has_primary_key: Column, has_gateway_key: Column) -> Column:
    """The endpoint of a chat request: an override, else by the model's name, else by the keys at hand."""
    named = F.contains(model, F.lit("/")) | F.contains(F.lower(model), F.lit("minimax")) | F.startswith(model, F.lit("mn/"))
    auto = F.when(model.isin(*HOSTED_MODELS), "hosted").when(named | (~has_primary_key & has_gateway_key), "gateway").otherwise("primary")
    return _overridden(provider, auto)


def annotator_endpoint(provider: Column, model: Column, has_primary_key: Column, has_gateway_key: Column) -> Column:
    """The annotator's: no ``mn/`` test, and a request without model goes by keys; null where no key is at hand."""
    name = F.coalesce(model, F.lit(""))
    by_key = F.when(has_primary_key, "primary").when(has_gateway_key, "gateway")
    named = F.contains(name, F.lit("/")) | F.contains(F.lower(name), F.lit("minimax"))
    auto = F.when(name.isin(*HOSTED_MODELS), "hosted").when(name == "", by_key).when(named | (~has_primary_key & has_gateway_key), "gateway").otherwise("primary")
    return _overridden(provider, auto)


def target_model(endpoint: Column, model: Column) -> Column:
    return F.when(endpoint == "hosted", F.when(model.isin(*HOSTED_MODELS), HOSTED_NAME).otherwise(model)).when(endpoint == "gateway", gateway_model(model)).otherwise(model)
