"""Model replies as columns: text, reasoning, token counts, errors, steps for display.

A reply is the JSON text of a chat completion. Its parts come in many shapes (a string, a
list of parts, nested parts), which variants hold; lists and parts are followed DEPTH deep.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH = 3
#: Keys of a part that may hold its text, the first that does counts.
PART_KEYS = ("text", "content", "summary")


def _stripped(c: Column) -> Column:
    c = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(c != "", c)


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def text_of(v: Column, depth: int = DEPTH) -> Column:
    """The text of a variant: strings stripped, lists joined by line ends, of parts the first key that has text; null without any."""
    kind = F.schema_of_variant(v)
    plain = _stripped(_at(v, "$", "string"))
    if not depth:
        return plain
    parts = F.filter(F.transform(_at(v, "$", "array<variant>"), lambda x: text_of(x, depth - 1)), lambda x: x.isNotNull())
    several = F.when(F.size(parts) > 0, F.array_join(parts, "\n"))
    part = F.coalesce(*(text_of(_at(v, f"$.{k}"), depth - 1) for k in PART_KEYS))
    return F.when(kind.startswith("ARRAY"), several).when(kind.startswith("OBJECT"), part).when(kind != "VOID", plain)


def _message(reply: Column) -> Column:
    return _at(F.try_parse_json(reply), "$.choices[0].message")


def output(reply: Column) -> Column:
    """The first choice's text."""
    return text_of(_at(_message(reply), "$.content"))


def thinking(reply: Column) -> Column:
    """The reasoning, or else what its details say: summaries, texts, and a note for what is encrypted."""
    m = _message(reply)

    def detail(d: Column) -> Column:
        kind = _at(d, "$.type", "string")
        summary, text = text_of(_at(d, "$.summary"), 2), text_of(_at(d, "$.text"), 2)
        return F.when(kind == "reasoning.summary", F.concat(F.lit("Summary: "), summary)).when(kind == "reasoning.text", text).when(kind == "reasoning.encrypted", F.lit("[Encrypted reasoning block]"))

    told = F.filter(F.transform(_at(m, "$.reasoning_details", "array<variant>"), detail), lambda x: x.isNotNull())
    return F.coalesce(text_of(_at(m, "$.reasoning")), F.when(F.size(told) > 0, F.array_join(told, "\n\n")))


def parts(reply: Column) -> Column:
    """(output, thinking, reasoning_details, error) of a reply; null parts and an error where it has none of them."""
    details = F.get_json_object(reply, "$.choices[0].message.reasoning_details")
    o, t = output(reply), thinking(reply)
    none = o.isNull() & t.isNull() & (details.isNull() | details.isin("[]", "{}", "", "null"))
    return F.struct(o.alias("output"), t.alias("thinking"), details.alias("reasoning_details"), F.when(none, F.lit("OpenAI client returned an empty completion payload")).alias("error"))


def failed(error: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(none.alias("output"), none.alias("thinking"), none.alias("reasoning_details"), error.cast("string").alias("error"))


def token_count(reply: Column, name: str) -> Column:
    """A usage count, rounded half to even; null if it is no number."""
    v = _at(F.try_parse_json(reply), f"$.usage.{name}")
    number = F.expr("1") * F.coalesce(_at(v, "$", "double"), _at(v, "$", "boolean").cast("double"))
    return F.bround(number).cast("long")


def payload(provider: Column, model: Column, system: Column, prompt: Column) -> Column:
    """The JSON of a request, as token estimates count it."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    beside = F.to_json(F.struct(model.alias("model"), F.lit(4096).alias("max_tokens"), system.alias("system"), F.array(turn("user", prompt)).alias("messages")))
    among = F.to_json(F.struct(model.alias("model"), F.lit(4096).alias("max_tokens"), F.array(turn("system", system), turn("user", prompt)).alias("messages")))
    return F.when(provider == "anthropic", beside).otherwise(among)


#: What users are told.
UNAVAILABLE = "The selected OpenRouter model is temporarily unavailable or overloaded. Please try again later, or switch to a different model."
LIMITED = "OpenRouter rate limit reached or quota exceeded for this model or API key. Please wait and try again, or switch model or API key."


def friendly(error: Column) -> Column:
    """An error as users see it; null without one."""
    return F.when(error.contains("503") | error.contains("502"), F.lit(UNAVAILABLE)).when(error.contains("429"), F.lit(LIMITED)).when(error != "", error)


def base_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "/+$", ""), "/chat/completions$", "")


def configured(url: Column, model: Column) -> Column:
    """Whether there is an endpoint and a model to ask."""
    return F.coalesce(_stripped(url).isNotNull() & _stripped(model).isNotNull(), F.lit(False))


def slug(model: Column) -> Column:
    return F.translate(model, "/:", "__")


def display_path(path: Column, base: str) -> Column:
    return F.when(path.startswith(base.rstrip("/") + "/"), F.substr(path, F.lit(len(base.rstrip("/")) + 2))).otherwise(path)


def steps(thinking: Column, output: Column, answer: Column) -> Column:
    step = lambda name, c: F.struct(F.lit(name).alias("step"), c.alias("content"))
    return F.array(step("thinking", thinking), step("output", F.coalesce(F.when(output != "", output), answer)))


#: Columns of an answer that its debug view shows first, as they are.
SHOWN = ("route", "llm_configured", "used_external_llm", "deterministic_answer")


def debug(answers_columns: list[str]) -> Column:
    """JSON of what led to an answer, from its columns (those there are): routing, failure, evidence, prompt, the model's steps."""
    have = lambda c, kind="string": F.col(c) if c in answers_columns else F.lit(None).cast(kind)
    model = F.col("model_response") if "model_response" in answers_columns else failed(F.lit(None))
    error = model["error"]
    rest = [have(c).alias(name) for c, name in (("subqueries", "subqueries"), ("answer_scaffold", "answer_scaffold"), ("evidence", "retrieved_reference_evidence_excerpts"), ("draft_hits", "draft_hits"), ("prompt", "full_final_prompt"))]
    first = [*(have(c).alias(c) for c in SHOWN), F.coalesce(error != "", F.lit(False)).alias("request_failed"), error.alias("request_error")]
    told = steps(model["thinking"], model["output"], F.coalesce(have("answer"), F.lit("")))
    return F.to_json(F.struct(*first, *rest, told.alias("model_response_steps"), model["reasoning_details"].alias("model_response_reasoning_details")), {"ignoreNullFields": "false", "pretty": "true"})
