"""Injected services: batches under limits, halving, retries, order; answers; gate figures; stemming."""

import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from papyra.functions.stemming import russian
from papyra.functions.text import tokens
from papyra.operators import answering, embedding, gate, remote, retrieval

# Pairs of the algorithm's published sample vocabulary.
STEMS = """вагнера вагнер|вагон вагон|вагона вагон|вагонов вагон|вагоном вагон|вагоны вагон|важная важн|важнее важн|важнейшие важн|важнейшими важн|важничал важнича|важно важн|важного важн
важной важн|важность важност|важностью важност|важную важн|важны важн|важных важн|вазах ваз|вазы ваз|вакса вакс|вал вал|валандался валанда|валентина валентин|валериановых валерианов|валерию валер|валетами валет
вали вал|валился вал|валится вал|п п|павел павел|павильон павильон|павлиний павлин|падает пада|падай пада|падал пада|падаль падал|падать пада|падение паден|падением паден|падшая падш|пакет пакет"""


def test_russian_stems(spark):
    pairs = [tuple(x.split()) for x in STEMS.replace("\n", "|").split("|")]
    got = spark.createDataFrame(pairs, "w string, s string").select("w", russian(F.col("w")).alias("g"), "s").collect()
    assert [(r.w, r.g) for r in got] == [(r.w, r.s) for r in got]
    assert spark.range(1).select(russian(F.lit("act")), russian(F.lit(""))).first()[:] == ("act", "")


def test_stemmed_tokens_leave_codes(spark):
    df = spark.createDataFrame([("Важнейшие вагоны и 311-РП",)], "t string")
    assert df.select(tokens(F.col("t"), stem=russian)).first()[0] == ["важн", "вагон", "рп", "311-рп"]


class Service:
    """A transport that embeds a text as [its length], out of order, within limits."""

    def __init__(self, most_tokens=10**9, most_window=10**9, failures=()):
        self.most_tokens, self.most_window, self.failures = most_tokens, most_window, list(failures)
        self.sent, self.lock = [], threading.Lock()

    def __call__(self, payload):
        with self.lock:
            self.sent.append(payload)
            if self.failures:
                raise remote.ServiceError(self.failures.pop(0), "try later")
        time.sleep(random.random() / 200)
        if "inputs" in payload:
            if sum(len(t) for w in payload["inputs"] for t in w) > self.most_tokens:
                raise remote.ServiceError(400, "TOO_MANY_TOKENS_IN_BATCH")
            if any(sum(map(len, w)) > self.most_window for w in payload["inputs"]):
                raise remote.ServiceError(400, "longer than the context window")
            rows = [{"index": k, "data": [{"index": j, "embedding": [float(len(t))]} for j, t in enumerate(w)][::-1]} for k, w in enumerate(payload["inputs"])]
            return {"data": rows[::-1], "usage": {"total_tokens": 1}}
        return {"data": [{"index": k, "embedding": [float(len(t))]} for k, t in enumerate(payload["input"])][::-1]}


WINDOWS = [["a" * n for n in range(k, k + 5)] for k in range(1, 40, 5)]
WANT = [[[float(len(t))] for t in w] for w in WINDOWS]


def test_requests_keep_to_limits(monkeypatch):
    monkeypatch.setattr(remote, "REQUEST_INPUTS", 3)
    service = Service()
    e = remote.ContextualEmbedder(service, "m", 1)
    assert e.embed_documents(WINDOWS) == WANT
    assert sorted(len(p["inputs"]) for p in service.sent) == [2, 3, 3] and {p["input_type"] for p in service.sent} == {"document"}
    monkeypatch.setattr(remote, "REQUEST_CHUNKS", 5)
    service.sent.clear()
    assert e.embed_documents(WINDOWS) == WANT and len(service.sent) == len(WINDOWS)
    assert e.embed_queries(["ab", "c"]) == [[2.0], [1.0]]


def test_long_windows_are_split_before_sending(monkeypatch):
    monkeypatch.setattr(remote, "WINDOW_TOKENS", 20)
    service = Service()
    e = remote.ContextualEmbedder(service, "m", 1)
    assert e.embed_documents([["x" * 22] * 5]) == [[[22.0]] * 5] and e.narrowed == 1
    assert [len(w) for p in service.sent for w in p["inputs"]] == [2, 2, 1]


def test_refused_requests_are_halved():
    service = Service(most_tokens=60)
    e = remote.ContextualEmbedder(service, "m", 1)
    assert e.embed_documents([w for w in WINDOWS if sum(map(len, w)) <= 60]) == [x for x, w in zip(WANT, WINDOWS) if sum(map(len, w)) <= 60]
    service = Service(most_window=50)
    e = remote.ContextualEmbedder(service, "m", 1)
    assert e.embed_documents(WINDOWS) == WANT and e.narrowed > 0
    with pytest.raises(remote.ServiceError):
        e.embed_documents([["y" * 51]])


def test_transient_errors_are_tried_again():
    waits = []
    service = Service(failures=[429, 503, 0])
    e = remote.PointwiseEmbedder(service, "m", 1, threads=1, sleep=waits.append)
    assert e.embed_queries(["a", "bb"]) == [[1.0], [2.0]] and waits == [2.0, 4.0, 8.0]
    for failures in ([400], [500] * 5):
        with pytest.raises(remote.ServiceError):
            remote.PointwiseEmbedder(Service(failures=failures), "m", 1, sleep=waits.append).embed_queries(["a"])


def test_pointwise_batches_are_in_order():
    service = Service()
    texts = ["z" * k for k in range(1, 48)]
    assert remote.PointwiseEmbedder(service, "m", 1).embed_documents([texts[:20], texts[20:]]) == [[[float(k)] for k in range(1, 21)], [[float(k)] for k in range(21, 48)]]
    assert sorted(len(p["input"]) for p in service.sent) == [7, 10, 10, 10, 10]


def local(payload):
    assert payload["truncate"] is False and payload["options"]["num_ctx"] > 0
    if len(payload["input"]) > payload["options"]["num_ctx"]:
        raise remote.ServiceError(400, "the input length exceeds the context length")
    return {"embeddings": [[3.0, 4.0, float(len(payload["input"]) % 7)]], "prompt_eval_count": len(payload["input"])}


def test_local_server_overflow_cut_and_prefix():
    e = remote.LocalEmbedder(local, "m", dim=2, context=100, prefix="query: ")
    assert e.embed_documents([["a"]]) == [[[0.6, 0.8]]]
    assert gate.overflow_is_an_error(e, "x" * 101) and not gate.overflow_is_an_error(e, "x")
    whole = remote.LocalEmbedder(local, "m", context=100, prefix="query: ")
    assert whole.embed_queries(["ab"])[0][2] == (len("query: ab") % 7)
    with pytest.raises(remote.ServiceError):
        remote.LocalEmbedder(lambda p: (_ for _ in ()).throw(remote.ServiceError(500)), "m").one("a")


def test_gate_figures(spark):
    ticks = iter([0, 1, 1, 4, 4, 6])
    row, vectors = gate.report(spark, ["warm", "ab", "abcd", "abcdef"], remote.LocalEmbedder(local, "m"), clock=lambda: next(ticks))
    r = row.first()
    assert (r.chunks, r.chunks_per_s, r.tokens_per_s, r.median_s, r.least_s, r.most_s, r.chars_per_token) == (3, 0.5, 2.0, 2, 1, 3, 1.0)
    assert r.hours_for_10000 == round(10_000 * 2 / 3600, 1)
    assert retrieval.truncation_geometry(vectors, 2).first().pairs == 3
    with pytest.raises(ValueError):
        gate.pace(["one"], lambda t: ([1.0], 1))


def test_context_verdict():
    class Seeing:
        def embed_documents(self, windows):
            return [[[1.0, float(len(w) - 1)] for _ in w] for w in windows]

    assert gate.context_verdict(Seeing(), ["a", "b"], 0) == (0.7071, True)
    assert gate.context_verdict(embedding.HashEmbedder(8), ["a b", "b"], 0) == (1.0, False)


def test_answers_refusals_and_errors(spark):
    def model(system, user, max_tokens):
        if "refuse" in user:
            return '```json\n{"refused": true, "reason": "not there", "answer": ""}\n```'
        if "long" in user:
            return json.dumps({"answer": "See [[1:0-3]].", "quotes": ["no", "object"]}) if max_tokens > 8000 else '{"answer": "cut o'
        if "never" in user:
            return "[1, 2]"
        return json.dumps({"answer": "See [[1:0-3]] and [[9:0-1]].", "quotes": {"[[1:0-3]]": "abc", "x": None}})

    docs = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "plain"), (2, "refuse"), (3, "long"), (4, "never"), (5, None)], "answer_id long, prompt string")
    rows = {r.answer_id: r for r in answering.answered(answering.ask(asked, model), docs).collect()}
    assert (rows[1].resolvable, rows[1].references_total, rows[1].quote_verbatim, rows[1].quotes) == (1, 2, 1, {"[[1:0-3]]": "abc"})
    assert rows[2].refused and rows[2].reason == "not there" and rows[2].citations is None and rows[2].error is None
    assert rows[3].answer == "See [[1:0-3]]." and rows[3].quotes == {} and rows[3].resolvable == 1
    assert rows[4].error == answering.UNREADABLE and not rows[4].refused and rows[5].resolvable == 1
    assert answering.ask(asked.limit(0), model).count() == 0


def test_prompts_and_chat_model(spark):
    q = spark.createDataFrame([(1, "What?", 20110601), (2, "Why?", None)], "query_id long, query string, as_of int")
    hits = spark.createDataFrame([(1, 1, "7:0-3", "T", "abc")], "query_id long, rank int, chunk_id string, breadcrumb string, text string")
    got = {r.answer_id: r.prompt for r in answering.prompts(q, hits).collect()}
    assert "As of: 20110601" in got[1] and "[7:0-3] T\nabc" in got[1] and "As of" not in got[2] and got[2].endswith("none")
    tries, sent = [0], []

    def transport(payload):
        tries[0] += 1
        if tries[0] == 1:
            raise remote.ServiceError(502)
        sent.append(payload)
        return {"choices": [{"message": {"content": "{}"}}]}

    assert answering.chat_model(transport, "m", sleep=lambda _: None)("s", "u", 9) == "{}"
    assert sent[0]["max_tokens"] == 9 and sent[0]["response_format"] == {"type": "json_object"} and [m["role"] for m in sent[0]["messages"]] == ["system", "user"]
