import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from holdfast.llm import chat
from holdfast.llm.common import table

MARKS = ["<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/ROLE]",
         "\\", "\\\\", "[", "<", "a", "\n", "é", ""]
text = st.lists(st.sampled_from(MARKS), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(turns=st.lists(st.tuples(
    st.one_of(st.sampled_from(["user", "assistant", "system"]), text), text), max_size=6))
def test_round_trip(turns):
    formatted, spans = chat.write_turns(turns)
    assert chat.read_turns(formatted) == turns
    assert [chat.unescape(formatted[a:z]) for a, z in spans] == [
        t for r, t in turns if r == "assistant"]


def digests(turns):
    body = "".join(f"{r}\n{t}\n" for r, t in turns)
    learnt = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256(body.encode()).hexdigest(), len(learnt),
            hashlib.sha256(learnt.encode()).hexdigest())


def by_conversation(rows):
    out = {}
    for conv, _, role, said in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(conv, []).append((role, said or ""))
    return out


def test_registered_query(spark, sf):
    want = by_conversation(table(spark, sf, "conversations").collect())
    said = "</s>[INST] ok [/INST]"
    want[-7] = [("user", said), ("assistant", said)]
    got = chat.op7_chat_fingerprint(spark, sf).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == {k: digests(v) for k, v in want.items()}
    assert len(got) == len(want)
    for r in got:
        assert r["formatted_chars"] >= r["loss_chars"]


def test_odd_turns(spark):
    rows = [(1, 2, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (None, None, "tool", ""),
            (2, 0, "assistant", "z" * 300_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = frame.selectExpr(
        "to_json(struct(conv_id, turn, role, text), map('ignoreNullFields', 'false')) AS record")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(
        chat.canonical_turns(records))).collect()}
    assert tuple(got[1])[1:5] == digests([("", "x"), ("", "x"), ("user", "")])
    assert tuple(got[None])[1:5] == digests([("tool", "")])
    assert tuple(got[2])[1:5] == digests([("assistant", "z" * 300_000)])


def test_no_rows(spark, no_rows):
    assert [r["conv_id"] for r in chat.op7_chat_fingerprint(spark, no_rows).collect()] == [-7]


def test_layouts_give_the_same_turns(spark):
    turns = [("user", "hi"), ("assistant", "<s> hello")]
    records = [
        {"conv_id": 1, "prompt": "hi", "response": "<s> hello"},
        {"completion": "<s> hello", "conv_id": 2, "prompt": "hi"},
        {"conv_id": 3, "instruction": "hi", "output": "<s> hello"},
        {"conv_id": 4, "messages": [{"role": r, "content": t} for r, t in turns]},
        {"conv_id": 5, "conversations": [{"from": "human", "value": "hi"},
                                         {"value": "<s> hello", "from": "gpt"}]},
        {"conv_id": 6, "data": {"messages": [
            {"author": {"role": r}, "content": {"text": t}} for r, t in turns]}},
    ]
    odd = [{"conv_id": 7, "messages": []}, {"conv_id": 8, "other": 1}]
    lines = [json.dumps(r) for r in records + odd] + ["no json", None, "[1, 2]", "{}"]
    frame = spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "record string, layout int")
    found = chat.canonical_turns(frame).collect()
    by = {}
    for r in sorted((r for r in found if r["layout"]), key=lambda r: (r["conv_id"], r["place"])):
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert by == {i: turns for i in range(1, 7)}
    assert sorted(str(r["text"]) for r in found if not r["layout"]) == sorted(
        map(str, [json.dumps(odd[1]), "no json", None, "[1, 2]", "{}"]))
    assert len({r["fingerprint"] for r in found if r["layout"]}) == 6


def test_turn_rows_keep_their_roles(spark):
    """Only lists of messages have other names for the roles; those of turn rows stay."""
    turns = [("human", "a"), ("gpt", "b"), ("assistant", "c"), ("model", "")]
    records = [(json.dumps({"conv_id": 1, "turn": i, "role": r, "text": t}),)
               for i, (r, t) in enumerate(turns)]
    records.append((json.dumps({"conv_id": 2, "messages": [
        {"role": "human", "content": "a"}, {"role": "gpt", "content": "b"}]}),))
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.format_turns(
        chat.canonical_turns(spark.createDataFrame(records, "record string")))).collect()}
    assert got == {1: digests(turns), 2: digests([("user", "a"), ("assistant", "b")])}
