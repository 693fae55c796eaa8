"""Endpoints, retries, replies and grids, with a transport that answers from a list."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import providers, replies, tasks


def made(answers, name="openrouter", model="m:free", **options):
    sent, slept, now = [], [], [0.0]

    def send(url, headers, body):
        sent.append((url, headers, body))
        now[0] += 1
        return answers.pop(0)

    def sleep(s):
        slept.append(s)
        now[0] += s

    return providers.provider(name, model, key="k", send=send, sleep=sleep, clock=lambda: now[0], **options), sent, slept


def chat(content, **usage):
    return providers.Reply(200, json.dumps({"choices": [{"message": {"content": content}}], "usage": usage}))


def test_retries_pause_and_counts():
    busy = providers.Reply(429, "", {"Retry-After": "7"})
    m, sent, slept = made([busy, providers.Reply(429, "", {"retry-after": "soon"}), chat([{"text": "a"}, {"text": "b"}], prompt_tokens="3.6", completion_tokens=2)])
    done = m.complete("s", "p")
    assert (done.text, done.input_tokens, done.output_tokens, done.total_tokens, done.token_source) == ("ab", 4, 2, 6, "provider")
    assert slept == [7.0, 3.1] and len(sent) == 3  # the pauses between requests were over by then
    assert sent[0][1] == {"Authorization": "Bearer k"} and sent[0][2]["messages"][0] == {"role": "system", "content": "s"}
    m, _, slept = made([chat("x"), chat("y")])
    assert m.complete("s", "p").token_source == "estimated" and m.complete("s", "p").output_tokens == 1
    assert slept == [pytest.approx(2.1)]


def test_failures():
    for reply, said in (
        (providers.Reply(500, '{"error":{"message":"no"}}'), "(500) for m: no"), (providers.Reply(400, '{"error":"bad"}'), "bad"), (providers.Reply(400, '{"a":1}'), '{"a": 1}'),
        (providers.Reply(404, " ", reason="Not Found"), "Not Found"), (providers.Reply(400, "x" * 600), "x" * 500 + "..."), (providers.Reply(200, '{"error":"late"}'), "openrouter error: late"),
    ):
        with pytest.raises(RuntimeError) as e:
            made([reply], model="m")[0].complete("s", "p")
        assert str(e.value).endswith(said)
    with pytest.raises(RuntimeError):
        made([providers.Reply(429, "")] * 3, retries=2)[0].complete("s", "p")
    with pytest.raises(ValueError):
        providers.provider("none", "m")
    with pytest.raises(ValueError):
        providers.from_config({"base_url": "https://example.org", "model": "m"})
    m = providers.from_config({"base_url": "https://openrouter.ai/x", "model": "m", "api_key": "k", "reasoning_enabled": True})
    assert m.url == "https://openrouter.ai/x" and m.payload("s", "p")["reasoning"] == {"enabled": True}


def test_system_prompt_beside_messages():
    m, sent, _ = made([providers.Reply(200, '{"content":[{"text":"t"}],"usage":{"input_tokens":5,"output_tokens":1}}')], "anthropic", "m")
    assert m.complete("s", "p").total_tokens == 6
    assert sent[0][2] == {"model": "m", "max_tokens": 4096, "system": "s", "messages": [{"role": "user", "content": "p"}]}


def test_tokens_and_text():
    assert [providers.tokens(x) for x in (None, True, 2.5, "7", "x", 3)] == [None, 1, 2, 7, None, 3]
    assert [providers.flat(x) for x in ("a", [{"text": "a"}, {"x": 1}, "b"], {"text": "c"}, None)] == ["a", "a", "c", "None"]


def test_reply_shapes(spark):
    content = ["  plain ", [{"text": "a"}, "b", {"content": {"summary": " c "}}], {"text": " ", "content": ["d"]}, [], None, 5]
    rows = [(k, json.dumps({"choices": [{"message": {"content": c}}]})) for k, c in enumerate(content)] + [(6, '{"choices":[]}'), (7, "no json"), (8, None)]
    got = spark.createDataFrame(rows, "k int, reply string").withColumn("p", replies.parts(F.col("reply"))).orderBy("k").collect()
    assert [r["p"]["output"] for r in got] == ["plain", "a\nb\nc", "d", None, None, "5", None, None, None]
    assert [r["p"]["error"] is None for r in got] == [True, True, True, False, False, True, False, False, False]


def test_grid(spark):
    work = spark.createDataFrame([("d1", "r1", 0, "one"), ("d1", "r2", 0, "bad"), ("d2", "r1", 0, "two")], "doc_id string, rule_name string, task int, prompt string")
    finding = '[{"section_path":["a","b"],"issue":"i","severity":"low","suggestion":"s"}]'

    def complete(provider, model):
        def ask(prompt):
            if prompt == "bad" and model == "x/y:free":
                raise RuntimeError("429")
            return providers.Completion(finding, 3, 2, 5, "provider")

        return ask

    runs = tasks.grid_runs(tasks.grid(work, [("p", "x/y:free"), ("p", "z")], complete))
    by = {(r["doc_id"], r["model"]): r for r in runs.collect()}
    assert by["d1", "x/y:free"]["status"] == "error" and by["d1", "x/y:free"]["errors"][0]["error"] == "RuntimeError: 429"
    assert by["d1", "z"]["status"] == "success" and by["d1", "z"]["results_path"] == "d1/p__z.json" and by["d2", "x/y:free"]["meta_path"] == "d2/p__x_y_free_meta.json"
    total = tasks.grid_summary(runs).head()
    assert (total["documents"], total["models"], total["runs_attempted"], total["runs_failed"], total["rules_attempted"], total["total_findings"]) == (2, 2, 4, 1, 6, 5)
    assert tasks.calls(work).where("doc_id = 'd1'").head()["calls"] == 2


def test_debug_and_settings(spark):
    row = spark.createDataFrame([("a", "hybrid_rag", "p")], "answer string, route string, prompt string")
    shown = json.loads(row.select(replies.debug(row.columns).alias("j")).head()["j"])
    assert shown["route"] == "hybrid_rag" and shown["full_final_prompt"] == "p" and shown["request_failed"] is False
    assert shown["model_response_steps"] == [{"step": "thinking", "content": None}, {"step": "output", "content": "a"}]
    s = spark.createDataFrame([("https://x/v1/chat/completions/", "m"), ("https://x/v1", " "), (None, "m")], "u string, m string")
    assert [tuple(r) for r in s.select(replies.base_url(F.col("u")), replies.configured(F.col("u"), F.col("m"))).collect()] == [("https://x/v1", True), ("https://x/v1", False), (None, False)]
    assert s.select(replies.display_path(F.lit("/a/b/c.json"), "/a")).head()[0] == "b/c.json"
