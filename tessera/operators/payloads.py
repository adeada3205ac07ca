"""Checks of JSON payloads that people and other programs write. They are read as VARIANT, so a number, a string of digits and a boolean are
told apart as JSON tells them apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as X

# Settings of a run that must agree for a comparison, and the metrics that a report leads with.
COMPARED, METRICS = ("query_set", "mode", "k", "limit", "reranking_enabled", "embedding_model"), ("ndcg_cut_10", "recall_5", "recall_10", "recip_rank")
# The keys of an expected recipe at its levels, and its markers.
TIMES = ("prep_time", "cook_time", "total_time")
RECIPE_KEYS, STRUCTURED_KEYS, STEP_KEYS = ("item_type", "title", "source_span_ids", "structured_data"), ("schema", "yield", *TIMES, "ingredients", "steps"), ("text",)
INGREDIENT_KEYS = ("raw_text", "quantity_value", "unit_normalized", "item_normalized", "preparation")
ITEM_TYPE, SCHEMA = "recipe", "recipe.v1"
MAP, LIST = "map<string,variant>", "array<variant>"


def get(value: Column, path: str, kind: str = "variant") -> Column:
    """What stands at a path, null where it is missing or of another kind."""
    return F.try_variant_get(value, path, kind)


def kind_of(value: Column) -> Column:
    """BIGINT, DECIMAL(...), DOUBLE, STRING, BOOLEAN, VOID (JSON's null), ARRAY<...> or OBJECT<...>; '' where nothing is there."""
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once however often f names it: a payload is parsed once, and each part of it is looked at once."""
    return F.get(F.transform(F.array(value), f), 0)


def node(value: Column) -> Column:
    """A value with its kind; the checks below are on such."""
    return once(value, lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))


def nodes(value: Column, names: tuple[str, ...]) -> Column:
    """The nodes of an object's fields by name."""
    return F.struct(*[node(get(value, f"$.{name}")).alias(name) for name in names])


def absent(at: Column) -> Column:
    """Missing or null."""
    return at["kind"].isin("", "VOID")


def is_number(at: Column) -> Column:
    return at["kind"].rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)")


def is_positive_whole(at: Column) -> Column:
    return (at["kind"] == "BIGINT") & F.coalesce(get(at["value"], "$", "bigint") > 0, F.lit(False))


def is_text(at: Column) -> Column:
    """A string with more than white space."""
    return (at["kind"] == "STRING") & X.is_present(get(at["value"], "$", "string"))


def is_object(at: Column) -> Column:
    return at["kind"].startswith("OBJECT")


def members(at: Column) -> Column:
    """The entries of an object, empty for all else."""
    return F.when(is_object(at), F.map_entries(get(at["value"], "$", MAP))).otherwise(F.array().cast("array<struct<key:string,value:variant>>"))


def elements(at: Column) -> Column:
    """The elements of an array, empty for all else."""
    return F.when(at["kind"].startswith("ARRAY"), get(at["value"], "$", LIST)).otherwise(F.array().cast(LIST))


def _told(checks: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(c, message) for c, message in checks]))


def _bad_query(query: Column) -> Column:
    """What is wrong with one query of a report: its metric, its ranks, one of them."""
    parts = F.struct(node(get(query, "$.metrics.ndcg_cut_10")).alias("metric"), node(get(query, "$.expected_item_ranks")).alias("ranks"))
    bad_rank = lambda e: once(node(e["value"]), lambda r: ~absent(r) & ~is_positive_whole(r))
    return once(parts, lambda p: F.struct((~is_number(p["metric"])).alias("metric"), (~is_object(p["ranks"])).alias("ranks"), F.exists(members(p["ranks"]), bad_rank).alias("rank")))


def report_problems(report: Column) -> Column:
    """What is wrong with a retrieval report (JSON text), as an array of messages; empty for one that can be compared."""
    whole = lambda v: nodes(v, ("run", "aggregate", "per_query"))
    parts = lambda t: F.struct(*[is_object(t[k]).alias(f"has_{k}") for k in ("run", "aggregate")], nodes(t["run"]["value"], COMPARED).alias("run"), nodes(t["aggregate"]["value"], METRICS).alias("aggregate"), F.transform(members(t["per_query"]), lambda e: _bad_query(e["value"])).alias("queries"))

    def told(p: Column) -> Column:
        run, aggregate, queries = p["run"], p["aggregate"], p["queries"]
        return _told([
            (~p["has_run"], "run is missing"), *[(p["has_run"] & absent(run[k]), f"run.{k} is missing") for k in COMPARED], *[(p["has_run"] & ~absent(run[k]) & ~is_positive_whole(run[k]), f"run.{k} is no positive whole number") for k in ("k", "limit")],
            (~p["has_aggregate"], "aggregate is missing"), *[(p["has_aggregate"] & ~is_number(aggregate[m]), f"aggregate.{m} is no finite number") for m in METRICS],
            (F.size(queries) == 0, "per_query is missing or empty"),
            (F.exists(queries, lambda q: q["metric"]), "a query's ndcg_cut_10 is no finite number"),
            (F.exists(queries, lambda q: q["ranks"]), "a query has no expected_item_ranks"),
            (F.exists(queries, lambda q: q["rank"]), "a rank is no positive whole number"),
        ])

    return once(F.try_parse_json(report), lambda v: once(whole(v), lambda t: once(parts(t), told)))


def _wrong_keys(at: Column, want: tuple[str, ...]) -> Column:
    """Whether an object lacks keys, and whether it has others."""
    wanted = F.array(*map(F.lit, want))
    wrong = lambda found: F.struct((F.size(F.array_except(wanted, found)) > 0).alias("missing"), (F.size(F.array_except(found, wanted)) > 0).alias("unknown"))
    return once(F.transform(members(at), lambda e: e["key"]), wrong)


def _bad_ingredient(value: Column) -> Column:
    """What is wrong with one ingredient: its keys, its names, its quantity, the kind of a text."""
    no_text = lambda at: ~absent(at) & (at["kind"] != "STRING")
    told = lambda i: F.struct(
        (~is_text(i["item_normalized"]) & ~is_text(i["raw_text"])).alias("nameless"), (~absent(i["quantity_value"]) & ~is_number(i["quantity_value"])).alias("quantity"),
        (no_text(i["raw_text"]) | no_text(i["unit_normalized"]) | no_text(i["item_normalized"]) | no_text(i["preparation"])).alias("text"),
    )
    return F.struct(once(node(value), lambda n: _wrong_keys(n, INGREDIENT_KEYS)).alias("keys"), once(nodes(value, INGREDIENT_KEYS), told).alias("fields"))


def _bad_step(value: Column) -> Column:
    """What is wrong with one step: its keys, its text."""
    return F.struct(once(node(value), lambda n: _wrong_keys(n, STEP_KEYS)).alias("keys"), once(node(get(value, "$.text")), lambda t: ~is_text(t)).alias("empty"))


def golden_problems(text: Column, span_id: Column) -> Column:
    """What is wrong with an expected recipe (JSON text), as an array of messages: unknown and missing keys at every level, values of other kinds than they
    must be, empty names, times that can't be read, ingredients that nothing can be matched to, other spans than span_id."""
    whole = lambda v: F.struct(node(v).alias("recipe"), nodes(v, RECIPE_KEYS).alias("at"))
    plain = ("schema", "yield", *TIMES)

    def parts(t: Column) -> Column:
        data = t["at"]["structured_data"]
        listed = lambda name, bad: once(node(get(data["value"], f"$.{name}")), lambda n: F.transform(elements(n), bad)).alias(name)
        return F.struct(
            _wrong_keys(t["recipe"], RECIPE_KEYS).alias("recipe_keys"), _wrong_keys(data, STRUCTURED_KEYS).alias("data_keys"), t["at"].alias("at"), nodes(data["value"], plain).alias("data"), F.transform(elements(t["at"]["source_span_ids"]), node).alias("spans"),
            listed("ingredients", _bad_ingredient), listed("steps", _bad_step),
        )

    def told(p: Column) -> Column:
        at, data, spans, ingredients, steps = (p[k] for k in ("at", "data", "spans", "ingredients", "steps"))
        string = lambda n: get(n["value"], "$", "string")
        keys = lambda k, where: [(p[k]["missing"], f"{where}: missing keys"), (p[k]["unknown"], f"{where}: unknown keys")]
        wrong = lambda x: x["keys"]["missing"] | x["keys"]["unknown"]
        return _told([
            *keys("recipe_keys", "recipe"), *keys("data_keys", "structured_data"),
            (~F.coalesce(string(at["item_type"]) == ITEM_TYPE, F.lit(False)), "item_type: must be recipe"), (~is_text(at["title"]), "title: must not be empty"), (~F.coalesce(string(data["schema"]) == SCHEMA, F.lit(False)), "schema: must be recipe.v1"),
            (~F.coalesce((F.size(spans) == 1) & (F.get(spans, 0)["kind"] == "STRING") & (string(F.get(spans, 0)) == span_id), F.lit(False)), "source_span_ids: must be the one span"),
            (~absent(data["yield"]) & ~is_text(data["yield"]), "yield: must not be empty"),
            *[(~absent(data[k]) & ((data[k]["kind"] != "STRING") | X.parse_minutes(string(data[k])).isNull()), f"{k}: no duration") for k in TIMES],
            (F.size(ingredients) == 0, "ingredients: must not be empty"), (F.size(steps) == 0, "steps: must not be empty"),
            (F.exists(ingredients, wrong), "ingredients: missing or unknown keys"), (F.exists(steps, wrong), "steps: missing or unknown keys"),
            (F.exists(ingredients, lambda i: i["fields"]["nameless"]), "ingredients: one has neither item nor line"),
            (F.exists(ingredients, lambda i: i["fields"]["quantity"]), "ingredients: a quantity is no number"),
            (F.exists(ingredients, lambda i: i["fields"]["text"]), "ingredients: a text is no string"),
            (F.exists(steps, lambda s: s["empty"]), "steps: one is empty"),
        ])

    return once(F.try_parse_json(text), lambda v: once(whole(v), lambda t: once(parts(t), told)))
