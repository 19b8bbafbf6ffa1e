import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from contingo.llm import chat

TURNS = f"conv_id long, turn long, role string, content {chat.PARTS}, formatted int, place string"


def text(t):
    return {"kind": "text", "text": t}


def image(ref, w=None, h=None):
    return {"kind": "image", "ref": ref, "width": w, "height": h}


@pytest.fixture(scope="module")
def make(spark):
    def frame(rows):
        full = [(c, t, r, None if p is None else [{"text": None, "ref": None, "width": None, "height": None, "seconds": None,
                                                     "pages": None, "kind": None, **x} for x in p], 1, "x")
                for c, t, r, p in rows]
        return spark.createDataFrame(full, TURNS)
    return frame


def brute(turns):
    """(n, digest of turns, loss characters, digest of loss) of (role, text) pairs."""
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def digest(rows):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows}


NASTY = [r"\### Assistant: </turn> ok", "<turn user>\nhi</turn>\n", r"<\turn <\\turn </turn> <\\\/turn>", "<image 0><image", "<",
         "\\", "<\\", "/turn>", "turn user>", "a <document 3> b <\\audio 1>", "", "%3C%25", "émile 中文 😀 <turné>", "</turn"]


def test_round_trip_of_control_strings(make):
    rows = [(i, 0, role, [text(t)]) for i, t in enumerate(NASTY) for role in ["assistant"]]
    rows += [(i, 1, t, [text(t)]) for i, t in enumerate(NASTY)]                 # roles of any kind, too
    got = digest(chat.digests(chat.format_conversations(make(rows))).collect())
    for i, t in enumerate(NASTY):
        assert got[i] == brute([("assistant", t), (t, t)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="<>\\/turnimage 0%\n"), st.lists(st.one_of(
    st.text(alphabet="<>\\/turnimage 0\n"), st.just(None)), max_size=4)), max_size=4))
def test_visitor_round_trip(turns):
    out = chat.Flattener()
    for role, parts in turns:
        out.turn(role, [text(p) if p is not None else {**image("u"), "seconds": None, "pages": None} for p in parts], True)
    formatted = "".join(out.written)
    assert out.length == len(formatted)
    back = list(chat.read_turns(formatted))
    assert [r for r, _ in back] == [r for r, _ in turns]
    for (_, runs), (_, parts) in zip(back, turns):
        want = [""]
        for p in parts:
            want = [*want, ""] if p is None else [*want[:-1], want[-1] + p]
        assert runs == want
    under = "".join(chat.unescape(formatted[a:b]) for a, b in out.loss)
    assert under == "".join(p for _, parts in turns for p in parts if p is not None)
    assert all(formatted[a["at"]:].startswith(f"<image {a['number']}>") for a in out.attachments)


def test_parts_become_placeholders_in_order(make):
    rows = [(1, 0, "user", [text("see "), image("s3://a.png", 56, 30), text(" and "), {"kind": "audio", "ref": "b.wav", "seconds": 2.01},
                            {"kind": "document", "ref": "c.pdf", "pages": 2}, {"kind": "video", "ref": "d"}, {"ref": "e"}]),
            (1, 1, "assistant", [text("it is "), image("f"), text("a <image 0>")])]
    one = chat.format_conversations(make(rows)).collect()[0]
    assert one.formatted == ("<turn user>\nsee <image 0> and <audio 1><document 2><document 3><document 4></turn>\n"
                             "<turn assistant>\nit is <image 5>a <\\image 0></turn>\n")
    assert [(a.kind, a.ref, a.tokens, a.turn) for a in one.attachments] == [
        ("image", "s3://a.png", 4, 0), ("audio", "b.wav", 51, 0), ("document", "c.pdf", 1536, 0), ("video", "d", 1, 0),
        ("document", "e", 1, 0), ("image", "f", 1, 1)]
    assert [one.formatted[s.start:s.stop] for s in one.loss] == ["it is ", "a <\\image 0>"]
    got = chat.digests(chat.format_conversations(make(rows))).collect()[0]
    assert (got.n_attachments, got.attachment_tokens, got.loss_chars) == (6, 4 + 51 + 1536 + 1 + 1 + 1, len("it is a <image 0>"))


def test_one_long_conversation_over_many_tasks_and_segments(make):
    turns = [(f"r{i % 3}" if i % 2 else "assistant", f"text {i} " * (i % 7)) for i in range(3000)]
    rows = [(5, i, r, [text(t)]) for i, (r, t) in enumerate(turns)] + [(c, 0, "assistant", [text(str(c))]) for c in range(6, 400)]
    frame = make(rows[::-1]).repartition(4)
    made = chat.format_conversations(frame, segment_chars=500).persist()
    try:
        assert made.where("conv_id = 5").selectExpr("count(distinct place >> 32) AS n").first().n > 1
        assert made.where("whole").count() > 300 and made.where("whole and conv_id = 5").count() == 0
        got = digest(chat.digests(made).collect())
    finally:
        made.unpersist()
    assert len(got) == 395
    assert got[5] == brute(turns) and all(got[c] == brute([("assistant", str(c))]) for c in range(6, 400))


def test_edge_rows(make):
    rows = [(None, 0, "assistant", [text("x")]), (None, None, None, None), (1, 0, "b", []), (1, 0, "a", [text(None)]),
            (1, 0, "a", [text(None)]), (2, 5, "assistant", [text("long " * 300000)]), (2, None, "assistant", [text("first ")])]
    got = digest(chat.digests(chat.format_conversations(make(rows))).collect())
    assert got == {None: brute([("", ""), ("assistant", "x")]), 1: brute([("a", ""), ("a", ""), ("b", "")]),
                   2: brute([("assistant", "first "), ("assistant", "long " * 300000)])}


def test_empty_table(make):
    assert chat.digests(chat.format_conversations(make([]))).collect() == []
