"""Model capabilities out of the shapes that backends report them in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxloom.functions.text import positive_integer

#: Names of the two limits; the first that holds a positive whole number wins.
INFO_WINDOW = ["context.contextWindow", "context.maxContextTokens", "contextWindow", "maxContextTokens", "maxInputTokens", "max_model_len", "maxModelLen"]
INFO_OUTPUT = ["defaultMaxTokens", "output.maxTokens", "output.maxOutputTokens", "maxOutputTokens", "context.maxOutputTokens", "maxTokens", "max_tokens"]
ROW_WINDOW = ["contextWindow", "context_window", "context_length", "max_input_tokens", "max_model_len", "maxModelLen", "limit.context"]
ROW_OUTPUT = ["maxTokens", "max_tokens", "maxOutputTokens", "max_output_tokens", "limit.output", "top_provider.max_completion_tokens"]


def _limits(json: Column, windows: list[str], outputs: list[str]) -> Column:
    first = lambda names: F.coalesce(*(positive_integer(F.get_json_object(json, f"$.{n}")) for n in names))
    window = first(windows)
    return F.when(window.isNotNull(), F.struct(window.alias("context_window"), F.coalesce(first(outputs), F.lit(0)).alias("max_tokens")))


def capability(info: Column) -> Column:
    """(context_window, max_tokens) of an adapter's JSON; null without a window, 0 for an unknown output."""
    return _limits(info, INFO_WINDOW, INFO_OUTPUT)


def listed_capability(body: Column, model: Column) -> Column:
    """The same for one model of a backend's listing, by id or name: {"data": [...]} or {"models": {...}}."""
    rows = F.coalesce(F.from_json(F.get_json_object(body, "$.data"), "array<string>"), F.array().cast("array<string>"))
    named = F.from_json(F.get_json_object(body, "$.models"), "map<string,string>")
    is_it = lambda row: (F.get_json_object(row, "$.id") == model) | (F.get_json_object(row, "$.name") == model)
    by_key = F.when(named.isNotNull(), F.try_element_at(named, model))
    return _limits(F.coalesce(F.get(F.filter(rows, is_it), 0), by_key), ROW_WINDOW, ROW_OUTPUT)
