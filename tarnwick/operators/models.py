"""Places where a caller's model plugs in: batch functions called from Arrow batches, with gates, parsers and guards
around them as expressions.  No model is bundled; a failing or missing reply has a defined result everywhere."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import DEFAULTS
from ..functions import text as X
from . import graph as G
from . import understand as U
from .retrieval import ranked

Batch = Callable[[list[str]], list[str | None]]
TRIES = 3
#: Texts handed to an embedder or a text model at a time.
BATCH = 64

#: What follows the reasoning of a reply that has no content.
FOLLOW = '\n\nFrom this reasoning, return only JSON: a list, or {"triples": [...]}, of objects with head, relation and tail.'

_ITEM = "array<struct<head:string,h:string,entity1:string,relation:string,rel:string,predicate:string,tail:string,t:string,entity2:string>>"
_SCORES = ("retrieval_relevance", "faithfulness", "completeness")


def _attempt(model: Batch, prompts: list[str], wait: float) -> tuple[list[str | None], list[str | None]]:
    """Replies and errors.  A batch that raises is tried again whole, then text by text, so one bad text costs itself only."""
    replies: list[str | None] = [None] * len(prompts)
    errors: list[str | None] = [None] * len(prompts)
    open_ = list(range(len(prompts)))
    for attempt in range(TRIES):
        groups = [open_] if attempt == 0 else [[i] for i in open_]
        left = []
        for group in groups:
            try:
                answers = model([prompts[i] for i in group])
                if len(answers) != len(group):
                    raise ValueError("the model must give a reply for each text")
                for i, a in zip(group, answers, strict=True):
                    replies[i], errors[i] = a, None if a and a.strip() else "empty reply"
            except Exception as e:  # whatever the caller's model raises becomes the row's error
                for i in group:
                    errors[i] = str(e) or type(e).__name__
            left += [i for i in group if errors[i] is not None]
        open_ = left
        if not open_:
            break
        if attempt + 1 < TRIES:
            time.sleep(wait * 2**attempt)
    return replies, errors


def _with(rows: DataFrame, more: str) -> StructType:
    return StructType([*rows.schema.fields, *StructType.fromDDL(more).fields])


def ask(rows: DataFrame, prompt: Column, model: Batch, wait: float = 1.0) -> DataFrame:
    """``rows`` with ``reply`` and ``error``; null prompts are not sent and have neither.  Existing columns of these
    names are replaced."""
    kept = rows.drop("reply", "error", "__prompt")
    names = [*kept.columns, "reply", "error"]
    asked = kept.withColumn("__prompt", prompt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH):
                batch = whole.slice(a, BATCH)
                prompts = batch.column("__prompt").to_pylist()
                sent = [i for i, p in enumerate(prompts) if p is not None]
                got, failed = _attempt(model, [prompts[i] for i in sent], wait) if sent else ([], [])
                replies, errors = [None] * len(prompts), [None] * len(prompts)
                for i, r, e in zip(sent, got, failed, strict=True):
                    replies[i], errors[i] = r, e
                cols = [batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=names)

    return asked.mapInArrow(run, _with(kept, "reply string, error string"))


def extract_triples(chunks: DataFrame, model: Batch, prompt: Callable[[Column], Column] = lambda t: t, wait: float = 1.0) -> DataFrame:
    """(seq, head, relation, tail, source, chunk_id) from chunks (chunk_id, source, text, is_code).

    Code chunks are not asked about.  A reply may be a list or an object with ``triples``; one that fails or does not
    parse gives no triples.  A reply of the form ``{"content": "", "reasoning": ...}`` is followed by a request for the
    JSON alone, from its reasoning.
    """
    prose = chunks.where(~F.coalesce("is_code", F.lit(False)))
    first = ask(prose.select("chunk_id", "source", "text"), prompt(F.col("text")), model, wait).withColumnRenamed("reply", "__first").drop("error", "text")
    whole = X.json_payload(F.col("__first"))
    content, reasoning = F.try_variant_get(whole, "$.content", "string"), F.try_variant_get(whole, "$.reasoning", "string")
    only = (F.coalesce(X.strip(content), F.lit("")) == "") & (F.coalesce(reasoning, F.lit("")) != "")
    again = ask(first, F.when(only, F.concat(reasoning, F.lit(FOLLOW))), model, wait)
    payload = X.json_payload(F.coalesce(F.col("reply"), F.when(~F.coalesce(only, F.lit(False)), F.col("__first"))))
    listed = F.coalesce(F.to_json(F.try_variant_get(payload, "$.triples", "variant")), F.to_json(payload))
    items = again.select("chunk_id", "source", F.posexplode(F.from_json(listed, _ITEM)).alias("seq", "i")).where("i is not null").select("seq", "chunk_id", "source", "i.*")
    return G.postprocess_triples(G.normalize_triples(items)).select("seq", "head", "relation", "tail", "source", "chunk_id")


def paced(model: Batch, per_second: float) -> Batch:
    """``model``, called so that a task sends no more than so many texts a second: each call waits for its turn."""
    due = 0.0

    def call(texts: list[str]) -> list[str | None]:
        nonlocal due
        now = time.monotonic()
        if due > now:
            time.sleep(due - now)
        due = max(due, time.monotonic()) + len(texts) / per_second
        return model(texts)

    return call


def compare_prompts(chunks: DataFrame, model: Batch, variants: dict[str, Callable[[Column], Column]], per_second: float | None = None, wait: float = 1.0) -> DataFrame:
    """(variant, chunk columns, reply, error, outcome): every chunk (with ``text``) worded in every way, by one model.

    A chunk's variants stand in one task, one after the other, so that they meet the model alike.  ``per_second`` bounds
    the texts that each task sends.  ``outcome`` says what became of the reply as an extraction; a reply of the form
    ``{"content": ..., "reasoning": ...}`` is read as such.
    """
    worded = F.array(*[F.struct(F.lit(name).alias("variant"), make(F.col("text")).alias("prompt")) for name, make in sorted(variants.items())])
    rows = chunks.select("*", F.explode(worded).alias("__v")).select(F.col("__v.variant").alias("variant"), *chunks.columns, F.col("__v.prompt").alias("__sent"))
    got = ask(rows, F.coalesce("__sent", F.lit("")), model if per_second is None else paced(model, per_second), wait).drop("__sent")
    failed = F.when(F.col("error") != "empty reply", F.col("error"))

    def told(v: Column) -> Column:
        return F.struct(F.try_variant_get(v, "$.content", "string").alias("content"), F.try_variant_get(v, "$.reasoning", "string").alias("reasoning"))

    def judged(t: Column) -> Column:
        shaped = t["content"].isNotNull() | t["reasoning"].isNotNull()
        return _once(F.when(shaped, t["content"]).otherwise(F.col("reply")), lambda c: X.outcome(failed, c, t["reasoning"]))

    return got.withColumn("outcome", _once(X.json_payload(F.col("reply")), lambda v: _once(told(v), judged)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often it occurs there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def prompt_summary(compared: DataFrame, ident: str, first: int = 5) -> DataFrame:
    """(variant, outcome, n, examples) of ``compare_prompts``: how often, and the ``first`` ids of what is no success."""
    place = F.row_number().over(Window.partitionBy("variant", "outcome").orderBy(ident))
    shown = compared.where("outcome <> 'success'").withColumn("__n", place).where(F.col("__n") <= first)
    listed = shown.groupBy("variant", "outcome").agg(F.sort_array(F.collect_list(ident)).alias("examples"))  # ``first`` ids
    counts = compared.groupBy("variant", "outcome").agg(F.count("*").alias("n"))
    none = F.array().cast(listed.schema["examples"].dataType)
    return counts.join(listed, ["variant", "outcome"], "left").select("variant", "outcome", "n", F.coalesce("examples", none).alias("examples"))


def judge(cases: DataFrame, model: Batch, wait: float = 1.0) -> DataFrame:
    """(case columns, retrieval_relevance, faithfulness, completeness, reason) for cases (query, contexts array, answer):
    contexts and answer are cut to their limits; a reply that fails or does not parse gives nulls and its reason."""
    d = DEFAULTS
    body = F.concat_ws(
        "\n", F.concat(F.lit("query: "), F.coalesce("query", F.lit(""))),
        F.concat(F.lit("contexts: "), X.truncate(F.array_join("contexts", "\n---\n"), d.judge_context_chars, "\n...")),
        F.concat(F.lit("answer: "), X.truncate(F.coalesce("answer", F.lit("")), d.judge_answer_chars, "...")),
        F.lit("Reply with a JSON object of retrieval_relevance, faithfulness and completeness (1 to 5) and reason."),
    )
    got = ask(cases.drop(*_SCORES, "reason"), body, model, wait)
    payload = X.json_payload(F.col("reply"))
    scores = [F.try_variant_get(payload, f"$.{n}", "int").alias(n) for n in _SCORES]
    why = F.when(F.col("error").isNotNull(), F.concat(F.lit("failed: "), F.col("error"))).when(payload.isNull(), "failed: no JSON").otherwise(F.try_variant_get(payload, "$.reason", "string"))
    return got.select(*[c for c in got.columns if c not in ("reply", "error")], *scores, why.alias("reason"))


def align(queries: DataFrame, model: Batch, prompt: Callable[[Column], Column] = lambda q: q, wait: float = 1.0) -> DataFrame:
    """``queries`` (query_id, query) with ``triggered``, ``fallback_reason`` (null where the alignment is used),
    ``search_query`` and the whole result as ``alignment``.  Only queries that pass the gate reach the model, as
    ``prompt`` (``understand.align_prompt``, say) words them.

    A reply of the form ``{"content": ..., "reasoning": ...}`` without content is read from its reasoning.
    """
    gate = X.align_gate(F.col("query"))
    got = ask(queries.withColumn("__gate", gate), F.when(gate == "gate_passed", prompt(F.col("query"))), model, wait)
    passed = F.col("__gate") == "gate_passed"
    whole = X.json_payload(F.col("reply"))
    content, reasoning = F.try_variant_get(whole, "$.content", "string"), F.try_variant_get(whole, "$.reasoning", "string")
    only = (F.coalesce(X.strip(content), F.lit("")) == "") & (F.coalesce(reasoning, F.lit("")) != "")
    payload = F.when(only, X.json_payload(reasoning)).when(content.isNotNull(), X.json_payload(content)).otherwise(whole)
    early = (
        F.when(~passed, F.col("__gate")).when(F.col("error") == "empty reply", "empty_response").when(F.col("error").isNotNull(), "llm_error")
        .when(only & F.col("__v").isNull(), "reasoning_only_no_json")
        .when(F.col("__v").isNull() | ~F.schema_of_variant(F.col("__v")).startswith("OBJECT"), "invalid_payload")
    )
    got = got.withColumn("__v", payload)
    done = got.withColumn("alignment", U.align_result(F.col("query"), F.col("__gate"), F.col("__v"), early))
    return done.select(*queries.columns, passed.alias("triggered"), F.col("alignment.fallback_reason").alias("fallback_reason"), F.col("alignment.search_query").alias("search_query"), "alignment")


def rewrite(queries: DataFrame, history: DataFrame, model: Batch, wait: float = 1.0) -> DataFrame:
    """``queries`` (conv_id, query) with ``rewritten``: by the model where the conversation (conv_id, turn, role, text) has
    a whole turn before it, guarded against answers; otherwise, and on failure, the query itself."""
    kept = U.last_whole_turns(history)
    body = F.when(F.col("role") == "assistant", X.clean_assistant(F.col("text"))).otherwise(F.col("text"))
    lines = kept.select("conv_id", F.struct("turn", F.concat(F.col("role"), F.lit(": "), F.coalesce(body, F.lit(""))).alias("line")).alias("m"))
    told = lines.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["line"]), "\n").alias("__told"))  # a few messages
    joined = queries.join(told, "conv_id", "left")
    got = ask(joined, F.when(F.col("__told").isNotNull(), F.concat_ws("\n", "__told", "query")), model, wait)
    return got.select(*queries.columns, F.when(F.col("error").isNull() & F.col("reply").isNotNull(), X.rewrite_guard(F.col("query"), F.col("reply"))).otherwise(F.col("query")).alias("rewritten"))


def embed(rows: DataFrame, text_col: str, embedder: Callable[[list[str]], list[list[float]]], wait: float = 1.0) -> DataFrame:
    """``rows`` with ``vec`` from an embedder called on 64 texts at a time; blank texts are sent as one space.  Unlike
    the text models, an embedder that keeps failing fails the job: a hole in an index would go unseen."""
    kept = rows.drop("vec", "__text")
    names = [*kept.columns, "vec"]
    sent = kept.withColumn("__text", F.when(X.strip(F.coalesce(text_col, F.lit(""))) == "", " ").otherwise(F.col(text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH):
                batch = whole.slice(a, BATCH)
                for attempt in range(TRIES):
                    try:
                        vectors = embedder(batch.column("__text").to_pylist())
                        break
                    except Exception:
                        if attempt + 1 == TRIES:
                            raise
                        time.sleep(wait * 2**attempt)
                cols = [batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float64()))], names=names)

    return sent.mapInArrow(run, _with(kept, "vec array<double>"))


def rerank(candidates: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]], final_k: int = DEFAULTS.final_k, cache: DataFrame | None = None) -> DataFrame:
    """The first ``final_k`` candidates (query_id, id, rank, query, text) in the order of a scorer's logits.

    Equal pairs are scored once.  ``cache`` (query, id, logit) has the pairs scored before; only the others are sent.
    """
    cut = candidates.where(F.col("rank") <= final_k)
    pairs = cut.select("query", "id", "text").dropDuplicates(["query", "id"])
    if cache is not None:
        pairs = pairs.join(cache.select("query", "id"), ["query", "id"], "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = list(zip(batch.column("query").to_pylist(), batch.column("text").to_pylist(), strict=True))
            scores = [float(x) for a in range(0, len(both), BATCH) for x in scorer(both[a : a + BATCH])]
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("id"), pa.array(scores, pa.float64())], names=["query", "id", "logit"])

    scored = pairs.mapInArrow(run, _with(cut.select("query", "id"), "logit double"))
    if cache is not None:
        scored = scored.unionByName(cache.select("query", "id", "logit"))
    joined = cut.drop("logit", "score", "rank").join(scored, ["query", "id"])
    return ranked(joined.withColumn("score", F.round(1 / (1 + F.exp(-F.col("logit"))), 6)), "score", "id")

def remember(cache: DataFrame, scored: DataFrame, at: int, most: int = DEFAULTS.rerank_cache) -> DataFrame:
    """The cache (query, id, logit, used) after a request at time ``at`` used the pairs ``scored`` (query, id, logit):
    the ``most`` pairs used last stay."""
    fresh = scored.select("query", "id", "logit").dropDuplicates(["query", "id"]).withColumn("used", F.lit(at).cast("long"))
    both = cache.join(fresh.select("query", "id"), ["query", "id"], "left_anti").select("query", "id", "logit", "used").unionByName(fresh)
    return both.orderBy(F.desc("used"), "query", "id").limit(most)
