"""Text expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS

#: Where a sentence ends or a block begins.
SENTENCE_CUT = r"(?<=[。！？!?])|(?<=\n\n)|(?<=\n)(?=#{1,6} )|(?<=[.!?])(?=[ \t][A-Z])"
FENCE = r"(?s)```[a-zA-Z0-9+#.\-]*\n.*?```"
HEADING_CUT = r"(?m)(?=^#{1,3}\s+)"
WORD = r"[\p{L}\p{N}]+"
#: Term dictionary for query alignment, in order.
TERMS = [
    ("RAG", ["rag", "检索增强生成", "检索增强", "retrieval augmented generation"]),
    ("vector database", ["向量数据库", "向量库", "vector database", "vector store", "chromadb", "chroma db"]),
    ("embedding", ["embedding", "向量表示", "嵌入", "词向量"]),
    ("BM25", ["bm25", "关键词检索", "词项检索"]),
    ("reranker", ["reranker", "重排序", "rerank", "重排"]),
    ("knowledge graph", ["知识图谱", "knowledge graph", "kg", "graph retrieval"]),
    ("intent router", ["意图路由", "intent router", "routing"]),
    ("chunking", ["chunking", "分块", "切分", "文本切分"]),
    ("tokenization", ["tokenization", "分词", "词元化"]),
    ("prompt engineering", ["prompt engineering", "提示词", "提示工程"]),
    ("transformer", ["transformer", "注意力机制", "自注意力"]),
    ("retrieval", ["retrieval", "检索", "召回"]),
]
#: Prefixes that a rewritten query may carry.
REWRITE_PREFIX = "^(重写后查询：|重写后的查询：|重写后：|重写：|重写后查询:|重写后的查询:)"


def strip(c: Column) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Lower-cased words; runs of CJK ideographs are taken character by character."""
    spaced = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"([\x{4e00}-\x{9fff}])", " $1 ")
    return F.regexp_extract_all(spaced, F.lit(WORD), F.lit(0))


def normalize(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", " ")


def sentences(c: Column, least: int = 5) -> Column:
    """Trimmed sentences of at least ``least`` characters; shorter pieces are noise and go."""
    return F.filter(F.transform(F.split(c, SENTENCE_CUT, -1), strip), lambda s: F.length(s) >= least)


def code_aware_sentences(c: Column, least: int = 5) -> Column:
    """Sentences as struct(text, is_code, code_language); a fenced block stays one piece whatever its length."""
    fences = F.regexp_extract_all(c, F.lit(FENCE), F.lit(0))
    prose = F.split(c, FENCE, -1)

    def piece(text: Column, code: bool, language: Column) -> Column:
        return F.struct(text.alias("text"), F.lit(code).alias("is_code"), language.cast("string").alias("code_language"))

    plain = lambda t: F.transform(sentences(t, least), lambda s: piece(s, False, F.lit(None)))
    block = lambda t: F.when(t.isNotNull(), F.array(piece(strip(t), True, strip(F.regexp_extract(t, r"^```([^\n]*)\n", 1))))).otherwise(F.array().cast("array<struct<text:string,is_code:boolean,code_language:string>>"))
    zipped = F.arrays_zip(prose.alias("p"), fences.alias("f"))
    return F.flatten(F.transform(zipped, lambda z: F.concat(plain(z["p"]), block(z["f"]))))


def heading_sections(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, HEADING_CUT, -1), strip), lambda s: F.length(s) > 0)


def token_estimate(c: Column) -> Column:
    """0.3 a character of ASCII, 1.5 of others, rounded down, at least 1; 0 for no text."""
    wide = F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))
    cost = F.floor((F.length(c) - wide) * F.lit(0.3) + wide * F.lit(1.5))
    return F.when(c.isNull() | (c == ""), F.lit(0)).otherwise(F.greatest(F.lit(1), cost)).cast("long")


def language_class(c: Column) -> Column:
    zh, en = c.rlike(r"[\x{4e00}-\x{9fff}]"), c.rlike("[A-Za-z]")
    return F.when(zh & en, "mixed").when(zh, "zh").when(en, "en").otherwise("unknown")


def code_or_path(c: Column) -> Column:
    low = F.lower(c)
    found = low.rlike(r"https?://|\\|/|::")
    for word in ("def ", "class ", "import ", "lambda ", "function("):
        found = found | low.contains(word)
    return found


def has_term(c: Column) -> Column:
    found = F.lit(False)
    for _, aliases in TERMS:
        for a in aliases:
            found = found | F.lower(c).contains(a)
    return found


def align_gate(c: Column, least: int = DEFAULTS.align_min_length) -> Column:
    """The first reason that applies; only ``gate_passed`` lets a query on to a model."""
    q = strip(F.coalesce(c, F.lit("")))
    return (
        F.when(q == "", "empty_query").when(F.length(q) < least, "too_short").when(code_or_path(q), "code_or_path_query")
        .when(~has_term(q) & (language_class(q) != "mixed"), "no_alignment_signal").otherwise("gate_passed")
    )


def rewrite_guard(query: Column, rewritten: Column) -> Column:
    """The rewritten query without its prefix, or the query where that is empty or looks like an answer."""
    clean = strip(F.regexp_replace(strip(F.coalesce(rewritten, F.lit(""))), REWRITE_PREFIX, ""))
    answer = (F.length(clean) > F.greatest(F.length(query) * 3, F.lit(50))) & ~clean.rlike("[？?]")
    return F.when((strip(F.coalesce(rewritten, F.lit(""))) == "") | answer, query).otherwise(clean)


def clean_assistant(c: Column) -> Column:
    """Without the source block to the end and without folded trace blocks."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?s)\n*---\n📎 \*\*参考来源\*\*.*", ""), r"(?s)\n*<details>.*?</details>", ""), r"(?U)\s+$", "")


def truncate(c: Column, most: int, mark: str) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def unfence(c: Column) -> Column:
    """Content of the first fenced block, or the whole text."""
    body = strip(F.split(c, "```", -1)[1])
    return F.when(c.contains("```"), F.when(body.startswith("json"), strip(F.substring(body, 5, 2**30))).otherwise(body)).otherwise(strip(c))


def json_payload(c: Column) -> Column:
    """The JSON text of a model's reply as a variant: whole, or the widest object or list inside; null if neither parses."""
    text = unfence(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{feff}]", ""))
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}|\[.*\]", 0)))


def outcome(error: Column, content: Column, reasoning: Column) -> Column:
    """What became of an extraction reply."""
    payload = json_payload(content)
    kind = F.schema_of_variant(payload)
    inner = F.coalesce(F.try_variant_get(payload, "$.triples", "variant"), payload)
    listed = F.schema_of_variant(inner).startswith("ARRAY")
    return (
        F.when(error.isNotNull(), "exception").when((F.coalesce(content, F.lit("")) == "") & (F.coalesce(reasoning, F.lit("")) != ""), "reasoning_only")
        .when(F.coalesce(content, F.lit("")) == "", "empty_content").when(payload.isNull() | kind.isNull(), "json_parse_error")
        .when(~listed, "non_list_payload").when(F.to_json(inner) == "[]", "empty_triples_list").otherwise("success")
    )


def chunk_id(path: Column, index: Column) -> Column:
    """Path parts joined by underscores, the last suffix dropped, and the index."""
    return F.concat_ws("_", F.regexp_replace(F.translate(path, "/", "_"), r"(?<=.)\.[^._]+$", ""), index.cast("string"))


#: Metadata that the lines of an evidence show already, or that is not for a reader.
SHOWN = ("source", "channel_metadata", "score_type", "raw_rerank_logit", "scope", "is_global_summary_block")


def evidence(source: Column, channels: Column, scores: Column, score_type: Column, score: Column, text: Column, logit: Column | None = None, metadata: Column | None = None) -> Column:
    """A context as header lines, the channels' scores in name order, the reranker's logit and what else its metadata
    (map of texts, in order) tells, and its text."""
    logit = F.lit(None).cast("double") if logit is None else logit
    rest = F.filter(F.map_entries(metadata), lambda e: ~e["key"].isin(*SHOWN)) if metadata is not None else F.array().cast("array<struct<key:string,value:string>>")
    shown = lambda v: F.when(v.rlike(r"^(-?\d+(\.\d+)?|True|False|None)$"), v).otherwise(F.concat(F.lit("'"), v, F.lit("'")))
    residual = F.array_join(F.transform(rest, lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), shown(e["value"]))), ", ")
    four = lambda x: F.format_string("%.4f", x)
    chain = F.array_join(F.transform(F.array_sort(F.map_entries(scores)), lambda e: F.concat(e["key"], F.lit("="), four(e["value"]))), ", ")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("[来源: "), F.coalesce(source, F.lit("unknown")), F.lit("]")),
        F.when(F.size(channels) > 0, F.concat(F.lit("[通道: "), F.array_join(channels, ", "), F.lit("]"))),
        F.when(F.size(scores) > 0, F.concat(F.lit("[raw_scores: "), chain, F.lit("]"))),
        F.when(score.isNotNull(), F.concat(F.lit("["), F.coalesce(score_type, F.lit("fused_score")), F.lit(": "), four(score), F.lit("]"))),
        F.when(logit.isNotNull(), F.concat(F.lit("[raw_rerank_logit: "), four(logit), F.lit("]"))),
        F.when(F.size(rest) > 0, F.concat(F.lit("[metadata: {"), residual, F.lit("}]"))),
        F.coalesce(text, F.lit("")),
    )
