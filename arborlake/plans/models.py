"""Model hooks: a protocol for chat models, a registry, message formats of the known APIs, retries, and the UDFs that call a model for each row.

No model is called unless one is registered; without one the heuristics stand alone. Columns of prompts go to the model in Arrow batches.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Response:
    content: str
    input_tokens: int = 0
    output_tokens: int = 0
    tool_calls: list[dict] = field(default_factory=list)

    @property
    def tokens_used(self) -> int:
        return self.input_tokens + self.output_tokens


@dataclass(frozen=True)
class Capabilities:
    vision: bool
    tools: bool
    context: int
    streaming: bool


class Provider(Protocol):
    name: str

    def chat(self, messages: list[dict], tools: list[dict] | None = None) -> Response: ...

    def chat_stream(self, messages: list[dict], tools: list[dict] | None = None) -> Generator[str, None, Response]:
        """Tokens as they come; what the generator returns is the whole response."""
        ...


# --- Fixed values: provider names and what they can do. ---
CAPABILITIES = {
    "ollama": Capabilities(False, False, 8192, False), "groq": Capabilities(False, True, 131072, True), "google": Capabilities(True, True, 1048576, True), "openrouter": Capabilities(True, True, 128000, True),
    "agentrouter": Capabilities(True, True, 200000, True), "anthropic": Capabilities(True, True, 200000, True), "openai": Capabilities(True, True, 128000, True), "deepseek": Capabilities(False, True, 65536, True),
    "xai": Capabilities(True, True, 131072, True), "qwen": Capabilities(True, True, 131072, True), "openai-compat": Capabilities(True, True, 128000, True),
}

_REGISTRY: dict[str, Callable[..., Provider]] = {}


def register(name: str, make: Callable[..., Provider]) -> None:
    if name not in CAPABILITIES:
        raise ValueError(f"Unknown provider: {name}")
    _REGISTRY[name] = make


class Echo:
    """A deterministic stand-in: answers with the last user message and counts words as tokens."""

    name = "echo"

    def chat(self, messages: list[dict], tools: list[dict] | None = None) -> Response:
        last = next((m["content"] for m in reversed(messages) if m["role"] == "user"), "")
        return Response(last, sum(len(m["content"].split()) for m in messages), len(last.split()))

    def chat_stream(self, messages: list[dict], tools: list[dict] | None = None) -> Generator[str, None, Response]:
        whole = self.chat(messages, tools)
        yield from re.findall(r"\s*\S+|\s+$", whole.content)
        return whole


_RETRYABLE = re.compile(r"429|500|502|503|529|rate limit|overloaded|(?i:connection|timed? ?out)")


class Retry:
    """Calls again up to three times, after the time that the error names (30 s at most) or 0.3 s doubled each time."""

    def __init__(self, inner: Provider, most: int = 3, sleep: Callable[[float], None] = time.sleep):
        self.inner, self.name, self.most, self.sleep = inner, inner.name, most, sleep

    def _wait(self, attempt: int, e: Exception) -> None:
        if attempt == self.most or not _RETRYABLE.search(str(e)):
            raise e
        told = re.search(r"retry-after.[^0-9]*([0-9]+)", str(e), re.IGNORECASE | re.DOTALL)
        self.sleep(min(30, int(told[1])) if told else 0.3 * 2**attempt)

    def chat(self, messages: list[dict], tools: list[dict] | None = None) -> Response:
        for attempt in range(self.most + 1):
            try:
                return self.inner.chat(messages, tools)
            except Exception as e:
                self._wait(attempt, e)
        raise AssertionError

    def chat_stream(self, messages: list[dict], tools: list[dict] | None = None) -> Generator[str, None, Response]:
        """A stream that fails before its first token is asked for again; once tokens went out, its error does too."""
        for attempt in range(self.most + 1):
            given = False
            try:
                tokens = self.inner.chat_stream(messages, tools)
                while True:
                    try:
                        token = next(tokens)
                    except StopIteration as end:
                        return end.value
                    given = True
                    yield token
            except Exception as e:
                if given:
                    raise
                self._wait(attempt, e)
        raise AssertionError


def provider(name: str, **options) -> Provider:
    if name == "echo":
        return Echo()
    if name not in CAPABILITIES:
        raise ValueError(f"Unknown provider: {name}")
    if name not in _REGISTRY:
        raise ValueError(f"No client is registered for {name}")
    return Retry(_REGISTRY[name](**options))


def capability_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, c.vision, c.tools, c.context, c.streaming) for k, c in CAPABILITIES.items()], "provider string, vision boolean, tools boolean, context int, streaming boolean")


def _merged(messages: list[dict], is_result: Callable[[dict], bool], role: str, key: str, block: Callable[[dict], dict]) -> list[dict]:
    """Runs of tool results as one message."""
    out: list[dict] = []
    for m in messages:
        if is_result(m):
            if out and out[-1].get("_results"):
                out[-1][key].append(block(m))
            else:
                out.append({"role": role, key: [block(m)], "_results": True})
        else:
            out.append(m)
    return [{k: v for k, v in m.items() if k != "_results"} for m in out]


def openai_messages(messages: list[dict]) -> list[dict]:
    keep = ("role", "content", "tool_calls", "tool_call_id", "name")
    return [{k: m[k] for k in keep if m.get(k) is not None} for m in messages]


def anthropic_messages(messages: list[dict], merge_results: bool = False) -> tuple[str | None, list[dict]]:
    """System texts apart, tool results as blocks of user messages."""
    system = "\n\n".join(m["content"] for m in messages if m["role"] == "system") or None
    block = lambda m: {"type": "tool_result", "tool_use_id": m.get("tool_call_id"), "content": m["content"]}
    rest = [m for m in messages if m["role"] != "system"]
    if merge_results:
        rest = _merged(rest, lambda m: m["role"] == "tool", "user", "content", block)
    return system, [{"role": "user", "content": [block(m)]} if m["role"] == "tool" else {"role": m["role"], "content": m["content"]} for m in rest]


def google_messages(messages: list[dict]) -> tuple[dict | None, list[dict]]:
    """System instruction apart, consecutive tool results in one turn, `model` for the assistant."""
    system = "\n\n".join(m["content"] for m in messages if m["role"] == "system")
    result = lambda m: {"functionResponse": {"name": m.get("tool_name") or "", "response": {"result": m["content"]}}}
    rest = _merged([m for m in messages if m["role"] != "system"], lambda m: m["role"] == "tool", "user", "parts", result)
    turns = [m if "parts" in m else {"role": "model" if m["role"] == "assistant" else "user", "parts": [{"text": m["content"]}]} for m in rest]
    return ({"parts": [{"text": system}]} if system else None), turns


RESPONSE = T.StructType([T.StructField("content", T.StringType()), T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType())])


def chat_udf(name: str, system: str | None = None, **options):
    """A UDF from a prompt to a RESPONSE."""

    @F.pandas_udf(RESPONSE)
    def call(prompts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = provider(name, **options)
        for batch in prompts:
            rows = []
            for p in batch:
                r = model.chat(([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": p or ""}])
                rows.append((r.content, r.input_tokens, r.output_tokens))
            yield pd.DataFrame(rows, columns=["content", "input_tokens", "output_tokens"])

    return call


TOKENS = "stream_id string, k int, token string, done boolean, input_tokens long, output_tokens long, error string"


def forward_tokens(prompts: DataFrame, name: str, system: str | None = None, **options) -> DataFrame:
    """TOKENS of a model's answers to prompts (stream_id, text), as they come: k counts from 1; the last row of each stream is done, without a token, with what was used, or with the error that ended it.

    Works on batches and on streams; tokens leave a task in small batches, and no answer is held whole. A stream's offsets are those of its prompts: with a sink that
    saves a batch once, as stream_to() does, a restart gives each token once. A null text is an empty prompt; a null stream_id is carried; rows that repeat are answered as often.
    """
    schema = pa.schema([("stream_id", pa.string()), ("k", pa.int32()), ("token", pa.string()), ("done", pa.bool_()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = provider(name, **options)
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        held: list[tuple] = []
        for b in batches:
            for stream, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens = model.chat_stream(([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": text or ""}])
                k, used, error = 0, Response(""), None
                try:
                    while True:
                        token = next(tokens)
                        k += 1
                        held.append((stream, k, token, False, None, None, None))
                        if len(held) >= 1000:
                            yield give(held)
                            held = []
                except StopIteration as end:
                    used = end.value or used
                except Exception as e:  # the stream ends with its error, the others go on
                    error = str(e)
                held.append((stream, k + 1, "", True, used.input_tokens, used.output_tokens, error))
        if held:
            yield give(held)

    return prompts.select(F.col("stream_id").cast("string").alias("stream_id"), "text").mapInArrow(run, TOKENS)


def text_udf(name: str, instruction: str, **options):
    """A UDF from a text to the model's text: for summaries, rewritten queries and image descriptions."""
    call = chat_udf(name, instruction, **options)
    return lambda column: call(column)["content"]


def list_udf(name: str, instruction: str, **options):
    """The same to the items of a comma list, for entities and topics."""
    from ..functions.text import comma_list

    call = text_udf(name, instruction, **options)
    return lambda column: comma_list(call(column))


def validate_chat(message: str, doc_ids: list[str], provider_name: str) -> None:
    if not message.strip():
        raise ValueError("Message must not be empty")
    if not doc_ids:
        raise ValueError("At least one document is required")
    if not provider_name.strip():
        raise ValueError("Provider must not be empty")


def validate_provider(name: str, base_url: str, model: str, api_key: str | None = None) -> None:
    for label, value in (("Provider name", name), ("Model name", model)):
        if not value.strip():
            raise ValueError(f"{label} is required.")
    if name.lower() != "ollama" and not (api_key or "").strip():
        raise ValueError("API key is required for this provider.")
    if base_url and not re.match(r"https?://", base_url):
        raise ValueError("Base URL must start with http:// or https://")
