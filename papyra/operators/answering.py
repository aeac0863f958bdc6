"""Answers by an injected chat model: prompt, JSON, refusal, error, verification; many questions at once.

A model is a function (system, user, max_tokens) -> text. It is called inside partitions; what comes back is
parsed with SQL functions, so a stored raw answer can be read again without the model.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .citations import fragments, verify
from .remote import Transport, with_retries

#: Tokens of the first and of the second attempt, and what is told where both fail.
BUDGETS = (8000, 16_000)
UNREADABLE = "no readable JSON, not with the larger budget either"
FENCE = re.compile(r"\A\s*```(?:json)?\s*|\s*```\s*\Z")
SYSTEM = (
    "Answer from the fragments only. Every statement cites its place as [[doc_id:start-end]] within a given fragment. "
    'Return JSON: {"answer": text, "quotes": {citation: words of the fragment}, "refused": true or false, "reason": text}. Refuse if the fragments do not answer.'
)

Model = Callable[[str, str, int], str]


def chat_model(transport: Transport, model: str, temperature: float = 0.0, tries: int = 5, **options) -> Model:
    """A Model over a chat service; JSON mode; transient errors are tried again (remote.with_retries)."""

    def complete(system: str, user: str, max_tokens: int) -> str:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        payload = {"model": model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens, "response_format": {"type": "json_object"}}
        return with_retries(transport, payload, tries, **options)["choices"][0]["message"]["content"] or ""

    return complete


def readable(text: str) -> dict | None:
    """The JSON object of a model's answer, a fence around it or not; None if there is none."""
    try:
        got = json.loads(FENCE.sub("", text))
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def prompts(queries: DataFrame, hits: DataFrame, limit: int = 2200) -> DataFrame:
    """(answer_id, prompt) of queries(query_id, query, as_of) and their hits with breadcrumb and text."""
    dated = F.when(F.col("as_of").isNotNull(), F.concat(F.lit("As of: "), F.col("as_of").cast("string"), F.lit("\n"))).otherwise("")
    rows = queries.join(fragments(hits, limit), "query_id", "left")
    return rows.select(F.col("query_id").alias("answer_id"), F.concat(F.lit("Question: "), "query", F.lit("\n"), dated, F.lit("\nFragments:\n\n"), F.coalesce("prompt", F.lit("none"))).alias("prompt"))


def ask(asked: DataFrame, model: Model, system: str = SYSTEM, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """(answer_id, answer, quotes, refused, reason, error) of asked(answer_id, prompt).

    The second budget is used where the first gave no JSON. An unreadable answer is an error, not a refusal.
    Quotes that are no object are none; repeated and null ids each have a row; no rows, no calls.
    """

    def one(prompt: str) -> tuple:
        got = next((x for x in (readable(model(system, prompt, n)) for n in budgets) if x is not None), None)
        if got is None:
            return "", {}, False, "", UNREADABLE
        quotes = got.get("quotes")
        quotes = {str(k): str(v) for k, v in quotes.items() if v is not None} if isinstance(quotes, dict) else {}
        return str(got.get("answer") or ""), quotes, bool(got.get("refused")), str(got.get("reason") or ""), None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(p or "") for p in b.column("prompt").to_pylist()]
            text, quotes, refused, reason, error = zip(*rows, strict=True) if rows else [()] * 5
            kinds = [pa.string(), pa.map_(pa.string(), pa.string()), pa.bool_(), pa.string(), pa.string()]
            columns = [pa.array([list(x.items()) for x in c] if t == kinds[1] else c, t) for c, t in zip((text, quotes, refused, reason, error), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("answer_id"), *columns], ["answer_id", "answer", "quotes", "refused", "reason", "error"])

    key = dict(asked.dtypes)["answer_id"]
    return asked.select("answer_id", "prompt").mapInArrow(run, f"answer_id {key}, answer string, quotes map<string,string>, refused boolean, reason string, error string")


def answered(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """answers with the verification of those that are neither refused nor failed (citations.verify)."""
    checked = verify(answers.where(~F.col("refused") & F.col("error").isNull()).select("answer_id", "answer", "quotes"), docs)
    return answers.join(checked, "answer_id", "left")
