"""Query understanding and chat history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as X


def term_list(query: Column, most: int = DEFAULTS.align_max_terms, aliases: int = 3) -> Column:
    """Dictionary terms that a query holds, in dictionary order, each with its aliases found: array of structs."""
    low = F.lower(query)
    terms = F.array(*[F.struct(F.lit(c).alias("canonical"), F.slice(F.filter(F.array(*[F.lit(a) for a in names]), lambda a: F.contains(low, a)), 1, aliases).alias("aliases")) for c, names in X.TERMS])
    return F.slice(F.filter(terms, lambda t: F.size(t["aliases"]) > 0), 1, most)


def expansion_list(payload: Column) -> Column:
    """The expansions of a model's reply (variant): a list, or the values of a map of texts and lists of texts."""
    raw = F.try_variant_get(payload, "$.expansions", "variant")
    kind = F.schema_of_variant(raw)
    text = lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x))
    listed = F.transform(F.try_variant_get(raw, "$", "array<variant>"), text)
    values = F.map_values(F.try_variant_get(raw, "$", "map<string,variant>"))
    none = F.array().cast("array<string>")
    spread = F.flatten(F.transform(values, lambda x: F.when(F.schema_of_variant(x).startswith("ARRAY"), F.transform(F.try_variant_get(x, "$", "array<variant>"), text)).when(F.schema_of_variant(x) == "STRING", F.array(F.try_variant_get(x, "$", "string"))).otherwise(none)))
    return F.when(kind.startswith("ARRAY"), listed).when(kind.startswith("OBJECT"), spread).otherwise(none)


def align_prompt(query: Column, most: int = DEFAULTS.align_max_expansions) -> Column:
    """What an aligner model is asked: the query, the terms found in it, and the form of the reply."""
    form = '{"should_expand": true, "confidence": 0.0, "search_query": "", "expansions": [""], "reason": ""}'
    return F.concat(
        F.lit("Align the terms of a search query between Chinese and English; keep its intent, add only what is needed.\nquery: "), query,
        F.lit("\ncandidate terms: "), F.to_json(term_list(query)), F.lit(f"\nReply with JSON of this form only, {most} expansions at most, confidence from 0 to 1:\n{form}"),
    )


def align_result(query: Column, gate: Column, payload: Column, early: Column, most: int = DEFAULTS.align_max_expansions, least: float = DEFAULTS.align_min_confidence) -> Column:
    """The alignment as a struct of nine fields.  ``early`` is why there is no usable reply, or null.

    A fallback searches with the query itself, at confidence 0 and for the reason ``fallback``, and tells the terms
    found even where the gate did not look for them; the language is that of queries that got as far as the terms.
    """
    got = lambda name, kind: F.try_variant_get(payload, f"$.{name}", kind)
    clean = sanitize_expansions(expansion_list(payload), query, most)
    confidence = F.coalesce(got("confidence", "double"), F.lit(0.0))
    own = X.strip(F.coalesce(got("search_query", "string"), F.lit("")))
    search = F.when(own != "", own).when(F.size(clean) == 0, query).otherwise(F.concat_ws(" ", query, F.array_join(clean, " ")))
    declined = ~F.coalesce(got("should_expand", "boolean"), F.lit(True))
    why = F.coalesce(early, F.when(declined, "model_declined").when(confidence < least, "low_confidence").when(F.size(clean) == 0, "empty_expansion"))
    used = why.isNull()
    reason = F.coalesce(F.when(got("reason", "string") != "", got("reason", "string")), F.lit("aligned"))
    language = F.when(gate.isin("empty_query", "too_short", "code_or_path_query"), "unknown").otherwise(X.language_class(query))
    return F.struct(
        query.alias("original_query"), F.when(used, search).otherwise(query).alias("search_query"), used.alias("should_expand"),
        F.when(used, confidence).otherwise(F.lit(0.0)).alias("confidence"), F.when(used, reason).otherwise(F.lit("fallback")).alias("reason"),
        why.alias("fallback_reason"), term_list(query).alias("detected_terms"),
        F.when(used, clean).otherwise(F.array().cast("array<string>")).alias("expansions"), language.alias("language"),
    )


def detected_terms(queries: DataFrame, id_col: str, query_col: str, most: int = DEFAULTS.align_max_terms, aliases: int = 3) -> DataFrame:
    """(id, canonical, aliases): dictionary terms that a query holds, in dictionary order."""
    rows = queries.select(id_col, F.explode(term_list(F.col(query_col), most, aliases)).alias("t"))
    return rows.select(id_col, "t.canonical", F.array_join("t.aliases", ",").alias("aliases"))


def sanitize_expansions(expansions: Column, query: Column, most: int = DEFAULTS.align_max_expansions) -> Column:
    """Trimmed, not blank, not the query itself, each once, at most ``most``."""
    clean = F.filter(F.transform(F.coalesce(expansions, F.array().cast("array<string>")), X.strip), lambda x: (x != "") & (x != query))
    return F.slice(F.array_distinct(clean), 1, most)


def align_decide(query: Column, should_expand: Column, confidence: Column, expansions: Column, least: float = DEFAULTS.align_min_confidence) -> Column:
    """Why the model's alignment is not used, or null; and the query to search with."""
    why = F.when(~F.coalesce(should_expand, F.lit(False)), "model_declined").when(F.coalesce(confidence, F.lit(0.0)) < least, "low_confidence").when(F.size(expansions) == 0, "empty_expansion")
    return F.struct(why.alias("fallback_reason"), F.when(why.isNull(), F.concat_ws(" ", query, F.array_join(expansions, " "))).otherwise(query).alias("search_query"))


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.where(F.col("role").isin("user", "assistant"))


def last_turns(conversations: DataFrame, turns: int = DEFAULTS.history_turns) -> DataFrame:
    """The last two messages of each of ``turns`` turns."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return _turns(conversations).withColumn("__n", n).where(F.col("__n") <= 2 * turns).drop("__n")


def last_whole_turns(conversations: DataFrame, turns: int = DEFAULTS.history_turns) -> DataFrame:
    """As many whole turns as there are, ``turns`` at most."""
    w = Window.partitionBy("conv_id")
    rows = _turns(conversations).withColumn("__all", F.count("*").over(w)).withColumn("__n", F.row_number().over(w.orderBy(F.desc("turn"))))
    return rows.where(F.col("__n") <= 2 * F.least(F.floor(F.col("__all") / 2), F.lit(turns))).drop("__n", "__all")


def costed(rows: DataFrame) -> DataFrame:
    """Messages with ``body``, without what the answers' display added, and ``cost``; blank ones go."""
    body = F.when(F.col("role") == "assistant", X.clean_assistant(F.col("text"))).otherwise(F.col("text"))
    return rows.withColumn("body", body).where(X.strip(F.col("body")) != "").withColumn("cost", X.token_estimate(F.col("body")))


def budgeted_history(conversations: DataFrame, budget: int = DEFAULTS.history_budget, turns: int = DEFAULTS.history_turns) -> DataFrame:
    """The newest messages whose estimated tokens fit the budget; blank ones cost nothing and go."""
    rows = costed(last_turns(conversations, turns))
    used = F.sum("cost").over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return rows.withColumn("__used", used).where(F.col("__used") <= budget).drop("__used")


def pipeline_status(route: Column, mode: Column, aligned: Column, reranked: Column) -> Column:
    """The labels of a request's path."""
    label = F.when(mode == "hybrid", "🔀 异构召回").when(mode == "vector", "🔭 向量召回").when(mode == "bm25", "🔤 关键词召回")
    first = F.when(route == "local", "Local").otherwise(F.initcap(route))
    whole = F.concat_ws(" ｜ ", F.lit("Global"), F.when(aligned, "🌐 语义对齐"), F.lit("📝 摘要合成"))
    return F.when(F.lower(route) == "global", whole).otherwise(F.concat_ws(" ｜ ", first, label, F.when(aligned, "🌐 语义对齐"), F.when(reranked, "⚖️ 精排介入")))
