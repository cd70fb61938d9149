"""Answers from the final chunks: the listing kernel, and prompts for a language model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.errors import QueryExecutionError
from brindle.functions.text import snippet

#: The listing's first line, the message without contexts, and the prompt around contexts.
LISTING = "基于检索到的上下文，给出一个最小可用回答（Day2占位）：\n"
NOTHING = "未检索到相关上下文。query="
PROMPT = ("你是一个严谨的企业级RAG助手。请仅根据给定上下文回答问题。\n\n问题：", "\n\n上下文：\n", "\n\n回答：")


def _joined(final: DataFrame, queries: DataFrame, line, between: str, most: int) -> DataFrame:
    lines = final.where(F.col("rank") <= most).select("query_id", F.struct("rank", line.alias("line")).alias("x"))
    body = lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), between).alias("body"))
    return queries.select("query_id", "query").join(body, "query_id", "left")


def listing(final: DataFrame, queries: DataFrame, most: int = 3) -> DataFrame:
    """``query_id, answer``: a line for each of the first chunks, or that nothing was found."""
    line = F.format_string("- [%s] %s/%s score=%.3f: %s", "source", "doc_id", "chunk_id", "score", snippet(F.col("text")))
    body = _joined(final, queries, line, "\n", most)
    return body.select("query_id", F.when(F.col("body").isNull(), F.concat(F.lit(NOTHING), "query")).otherwise(F.concat(F.lit(LISTING), "body")).alias("answer"))


def prompts(final: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """``query_id, prompt`` with the first chunks as contexts."""
    line = F.format_string("[%s:%s|%s|score=%.4f]\n%s", "doc_id", "chunk_id", "source", "score", "text")
    body = _joined(final, queries, line, "\n\n", most)
    return body.select("query_id", F.concat(F.lit(PROMPT[0]), "query", F.lit(PROMPT[1]), F.coalesce("body", F.lit("")), F.lit(PROMPT[2])).alias("prompt"))


class FakeModel:
    """Always the same reply; remembers what it was asked last."""

    def __init__(self, reply: str = "fake-answer"):
        self.reply, self.last_prompt = reply, ""

    def __call__(self, prompt: str) -> str:
        self.last_prompt = prompt
        return self.reply


def http_model(url: str, body: Callable[[str], dict], reply: Callable[[dict], str], headers: dict[str, str] | None = None, timeout: float = 60) -> Callable[[str], str]:
    """A model behind HTTP: ``body`` makes the JSON of a prompt, ``reply`` takes the text from the JSON answer."""
    import json
    import urllib.request

    def ask(prompt: str) -> str:
        request = urllib.request.Request(url, json.dumps(body(prompt)).encode(), {"Content-Type": "application/json", **(headers or {})})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return reply(json.load(answer))

    return ask


def ollama(model: str, host: str = "http://localhost:11434") -> Callable[[str], str]:
    return http_model(f"{host}/api/generate", lambda p: {"model": model, "prompt": p, "stream": False}, lambda x: x.get("response", ""))


def openai_responses(model: str, key: str, host: str = "https://api.openai.com") -> Callable[[str], str]:
    texts = lambda x: "".join(c.get("text", "") for o in x.get("output", []) for c in o.get("content", []))
    return http_model(f"{host}/v1/responses", lambda p: {"model": model, "input": p}, texts, {"Authorization": f"Bearer {key}"})


def generate(final: DataFrame, queries: DataFrame, model: Callable[[str], str]) -> list[tuple[str, str]]:
    """(query_id, answer) of each query, on the driver: a row for each query, never a distributed stage."""
    rows = prompts(final, queries).orderBy("query_id").collect()
    try:
        return [(r["query_id"], model(r["prompt"])) for r in rows]
    except Exception as e:
        raise QueryExecutionError("generation", str(e), e) from e
