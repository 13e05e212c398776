"""From contexts to an answer: prompt messages under a token budget, answers, and traces of requests."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as X
from . import models as M
from . import understand as U

#: What stands before the evidence and the question, and between contexts.
BEFORE_EVIDENCE, BEFORE_QUESTION, BETWEEN = "上下文证据链：\n", "\n\n问题: ", "\n\n---\n\n"
SYSTEM = "Answer from the given contexts only, name the source files you rely on, and say so where the contexts do not tell."
NO_ANSWER = "The contexts do not tell."
MESSAGE = "array<struct<role:string,content:string>>"
#: The fields of a trace, in order, with their types and what stands for a missing value.
TRACE = [
    ("route_decision", "string", "local"), ("mode", "string", "vector"), ("rewrite_triggered", "boolean", False), ("original_query", "string", ""),
    ("rewritten_query", "string", ""), ("rewrite_ms", "double", 0.0), ("align_triggered", "boolean", False), ("aligned_query", "string", ""),
    ("query_alignment", "variant", "{}"), ("align_ms", "double", 0.0), ("rerank_active", "boolean", False), ("rerank_ms", "double", 0.0), ("embed_ms", "double", 0.0),
    ("pure_search_ms", "double", 0.0), ("route_info", "variant", "{}"), ("kg_ms", "double", 0.0), ("parent_child_active", "boolean", False),
    ("parent_child_child_hits", "int", 0), ("parent_child_unique_parents", "int", 0),
]


def prompt_messages(questions: DataFrame, contexts: DataFrame, history: DataFrame | None = None, system: str = SYSTEM, total: int = DEFAULTS.prompt_tokens, output: int = DEFAULTS.output_tokens, margin: int = DEFAULTS.token_margin, turns: int = DEFAULTS.history_turns) -> DataFrame:
    """(query_id, query, history_budget, messages) for questions (query_id, query): the system text, as much of the
    newest history (query_id, turn, role, text) as the budget leaves room for, and the evidence (query_id, ctx_pos,
    evidence) with the question.

    The budget is what ``total`` leaves after the fixed messages, the output and the margin; where nothing is left, no
    history goes in.  A question without contexts has empty evidence.
    """
    told = contexts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ctx_pos", "evidence"))).alias("c"))  # a request's few contexts
    asked = questions.join(told.select("query_id", F.array_join(F.transform("c", lambda c: c["evidence"]), BETWEEN).alias("told")), "query_id", "left")
    last = F.concat(F.lit(BEFORE_EVIDENCE), F.coalesce("told", F.lit("")), F.lit(BEFORE_QUESTION), F.coalesce("query", F.lit("")))
    asked = asked.select("query_id", "query", last.alias("last"))
    budget = F.lit(total - output - margin) - X.token_estimate(F.lit(system)) - X.token_estimate(F.col("last"))
    asked = asked.withColumn("history_budget", budget)
    one = lambda role, content: F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))
    kept = F.array().cast(MESSAGE)
    if history is not None and turns > 0:
        rows = U.costed(U.last_turns(history.withColumnRenamed("query_id", "conv_id"), turns))
        rows = rows.join(asked.select(F.col("query_id").alias("conv_id"), "history_budget"), "conv_id")
        used = F.sum("cost").over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
        fits = rows.withColumn("used", used).where(F.col("used") <= F.col("history_budget"))
        listed = fits.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("body").alias("content")))).alias("m"))  # twice ``turns``
        listed = listed.select(F.col("conv_id").alias("query_id"), F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("kept"))
        asked = asked.join(listed, "query_id", "left")
        kept = F.coalesce(F.col("kept"), kept)
    return asked.select("query_id", "query", "history_budget", F.concat(one("system", F.lit(system)), kept, one("user", F.col("last"))).alias("messages"))


def generate(prompts: DataFrame, model: M.Batch, wait: float = 1.0) -> DataFrame:
    """``prompts`` (with ``messages``) and the model's ``answer``, or its ``error``; the model gets the messages as JSON."""
    got = M.ask(prompts, F.to_json("messages"), model, wait)
    return got.withColumnRenamed("reply", "answer")


def growing(deltas: Callable[[str], Iterator[str]], least: int = 10):
    """A table function of a prompt: (seq, shown, error), a row each time ``least`` characters more have come from the
    generator ``deltas``, with all that has come by then, and one for what is left at the end.

    A generator that raises leaves what was shown; a last row has all that came and the error.  A null prompt gives no
    row.  Rows leave the task as they come, so an answer of any length is held once.
    """

    class Growing:
        def eval(self, prompt: str):
            if prompt is None:
                return
            shown, held, seq, error = "", "", 0, None
            try:
                for delta in deltas(prompt):
                    held += delta or ""
                    if len(held) >= least:
                        shown, held, seq = shown + held, "", seq + 1
                        yield seq, shown, None
            except Exception as e:  # whatever the caller's generator raises
                error = str(e) or type(e).__name__
            if held or error is not None:
                yield seq + 1, shown + held, error

    return F.udtf(Growing, returnType="seq int, shown string, error string")


def stream_answers(prompts: DataFrame, prompt_col: str, deltas: Callable[[str], Iterator[str]], least: int = 10) -> DataFrame:
    """``prompts`` with (seq, shown, error) of their growing answers; a prompt without an answer has no row."""
    name = f"growing_{uuid.uuid4().hex}"
    spark = prompts.sparkSession
    spark.udtf.register(name, growing(deltas, least))
    return spark.sql(f"SELECT p.*, g.seq, g.shown, g.error FROM {{prompts}} p, LATERAL {name}(p.`{prompt_col}`) g", prompts=prompts)


def extract_answers(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query_id, answer, source): without a model, the sentence of the contexts (query_id, ctx_pos, source, text) that
    has most of the question's words, the first of equal ones; a fixed text where none has any."""
    asked = questions.select("query_id", F.array_distinct(X.tokens(F.col("query"))).alias("asked"))
    said = contexts.select("query_id", "ctx_pos", "source", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence")).join(asked, "query_id")
    hits = said.withColumn("hits", F.size(F.array_intersect("asked", X.tokens(F.col("sentence"))))).where("hits > 0")
    best = hits.groupBy("query_id").agg(F.max_by(F.struct("sentence", "source"), F.struct("hits", -F.col("ctx_pos"), -F.col("pos"))).alias("b"))
    return questions.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("b.sentence", F.lit(NO_ANSWER)).alias("answer"), F.col("b.source").alias("source"))


def flush_points(deltas: Column, least: int = 10) -> Column:
    """Texts shown while an answer streams in: what has come, each time ``least`` characters more are there."""
    start = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, d: Column) -> Column:
        now = F.concat(acc["held"], d)
        full = F.length(now) >= least
        return F.struct(F.when(full, "").otherwise(now).alias("held"), F.when(full, F.concat(acc["out"], F.array(now))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(deltas, start, step, lambda acc: F.when(acc["held"] != "", F.concat(acc["out"], F.array(acc["held"]))).otherwise(acc["out"]))


def trace(**given: Column) -> Column:
    """A trace struct from some of its fields; the others have their defaults."""
    default = lambda kind, v: F.parse_json(F.lit(v)) if kind == "variant" else F.lit(v).cast(kind)
    return F.struct(*[F.coalesce(given[n].cast(kind) if kind != "variant" else given[n], default(kind, v)).alias(n) if n in given else default(kind, v).alias(n) for n, kind, v in TRACE])


def trace_to_json(t: Column) -> Column:
    """JSON of a trace, with ``route`` for older readers."""
    return F.to_json(F.struct(*[t[n].alias(n) for n, _, _ in TRACE], t["route_decision"].alias("route")))


def trace_from_json(c: Column) -> Column:
    """A trace from JSON with any of its fields: missing, null and empty ones have their defaults, and the route follows
    from ``route`` or ``mode`` where it is not given itself."""
    v = F.try_parse_json(c)

    def get(name: str, kind: str) -> Column:
        x = F.try_variant_get(v, f"$.{name}", kind)
        return F.when(x != "", x) if kind == "string" else x

    given = {n: get(n, kind) for n, kind, _ in TRACE}
    given["route_decision"] = F.coalesce(given["route_decision"], get("route", "string"), get("mode", "string"))
    return trace(**given)


def flatten_content(v: Column) -> Column:
    """The text of a message's content (variant): text as it is, the texts of a list of parts joined, none for null."""
    kind = F.schema_of_variant(v)
    parts = F.try_variant_get(v, "$", "array<variant>")

    def part(x: Column) -> Column:
        inner = F.schema_of_variant(x)
        return F.when(inner.startswith("OBJECT"), F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit(""))).otherwise(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")))

    return F.when(v.isNull() | (kind == "VOID"), "").when(kind.startswith("ARRAY"), F.array_join(F.transform(parts, part), "")).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))
