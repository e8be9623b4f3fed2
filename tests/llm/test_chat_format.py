import hashlib
import json
import random

from hypothesis import given
from hypothesis import strategies as st

from kvlake.llm import chat_format as C

TEXT = st.lists(st.sampled_from(["<", "\\", "|", "<|im_end|>", "<|im_start|>", "\n", "é", "assistant", "%0A", "%", "<\\|", "a"]), max_size=12).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), TEXT), TEXT), max_size=6))
def test_round_trip(turns):
    f, spans = C.format_turns(turns)
    assert C.parse(f) == turns
    assert C.under_mask(f, spans) == "".join(t for r, t in turns if r == "assistant")
    assert f.count(C.START) == f.count(C.END) == len(turns)


def test_layouts(spark):
    a, b = "Q?", "A <|im_end|>"
    two = [("user", a), ("assistant", b)]
    records = [
        ({"messages": [{"role": "user", "content": a}, {"role": "assistant", "content": b}]}, "messages", two),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": a}]}, {"role": "model", "content": [{"type": "text", "text": b}]}]}, "messages_parts", two),
        ({"id": "x", "conversations": [{"from": "human", "value": a}, {"from": "gpt", "value": b}]}, "conversations", two),
        ({"instruction": a, "input": "in", "output": b}, "instruction_input", [("user", "Q?\n\nin"), ("assistant", b)]),
        ({"instruction": a, "input": "", "output": b}, "instruction_input", two),
        ({"instruction": a, "output": b}, "instruction", two),
        ({"prompt": a, "completion": b, "meta": {"k": [1, 2]}}, "prompt_completion", two),
        ({"system": "s", "prompt": a, "response": b}, "system_prompt_response", [("system", "s"), *two]),
        ({"question": a, "answer": None}, "question_answer", [("user", a), ("assistant", "")]),
        ({"something": 1}, None, []),
    ]
    rows = [(k, json.dumps(r)) for k, (r, _, _) in enumerate(records)] + [(97, None), (98, "not json"), (99, "[1]")]
    df = spark.createDataFrame(rows, "layout_id long, record string")
    out = {r.layout_id: r for r in C.formatted(C.canonical_records(df, "record")).collect()}
    for k, (_, layout, turns) in enumerate(records):
        assert out[k].layout == layout and C.parse(out[k].formatted) == turns
    assert all(out[k].layout is None and out[k].formatted == "" for k in (97, 98, 99))


def test_fingerprint_ignores_order_and_length():
    p = lambda s: C.fingerprint(C.field_paths(json.loads(s)))
    assert p('{"a":[{"b":1},{"b":2}],"c":3}') == p('{"c":0,"a":[{"b":1}]}') != p('{"a":[{"b":1,"d":2}],"c":3}')


def test_rows(spark):
    rows = [(1, 1, "assistant", "two"), (1, 0, "user", "one"), (2, None, None, None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 5, "user", "n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    out = {r.conv_id: r for r in C.read_back(C.formatted(C.canonical_rows(df))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert out[1].turns_sha256 == sha("user\none\nassistant\ntwo\n") and out[1].loss_sha256 == sha("two")
    assert (out[2].n_turns, out[2].loss_chars) == (3, 2) and out[None].n_turns == 1
    assert C.read_back(C.formatted(C.canonical_rows(df.limit(0)))).count() == 0
    both = C.with_probe(C.canonical_rows(df)).where("conv_id = -1").collect()[0]
    assert [t.text for t in both.turns] == [C.PROBE, C.PROBE]


def test_rows_in_another_layout(spark):
    df = spark.createDataFrame([("k", 1, "assistant", "b"), ("k", 0, "user", None)], "conversation_id string, message_index int, role string, content string")
    (r,) = C.canonical_rows(df).collect()
    assert r.conv_id == "k" and [tuple(t) for t in r.turns] == [("user", ""), ("assistant", "b")]
    assert C.with_probe(C.canonical_rows(df)).where("conv_id = '-1'").count() == 1


def test_records_keep_every_turn(spark):
    """Through JSON records of many layouts, each found by its own fingerprint."""
    rnd = random.Random(5)
    texts = ["", "<|im_end|>", 'q"\n\\', "é\u2028\U0001f600", "\x00\x1f", "x" * 100_000]
    roles = [["user", "assistant"], ["system", "user", "assistant"], ["human", "gpt"], ["", "tool", "user"], ["user"] * 9]
    rows = [(k, [(r, rnd.choice(texts)) for r in rnd.choice(roles)]) for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turns array<struct<role string, text string>>")
    records = C.as_records(df)
    out = {r.conv_id: r for r in C.canonical_records(records, "record").collect()}
    assert {k: [tuple(t) for t in r.turns] for k, r in out.items()} == dict(rows)
    assert len({r.layout for r in out.values()}) >= 10
    for r in records.collect():
        assert out[r.conv_id].layout == C.choose(C.field_paths(json.loads(r.record))).name
    # the same text under other field names takes another mapping
    moved = records.selectExpr("conv_id", "replace(replace(record, 'prompt', 'question'), 'completion', 'answer') record")
    now = {r.conv_id: r.layout for r in C.canonical_records(moved, "record").collect()}
    was = {k: r.layout for k, r in out.items() if r.layout == "prompt_completion"}
    assert was and all(now[k] == "question_answer" for k in was)
