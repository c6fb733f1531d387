"""Chat formatting: the machine, escapes, the way back and the query's digests."""

import hashlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import queries
from spanloom.llm.chat import Reader, Role, Template, format_conversations, joined, read_back, unescape

from .conftest import SMALL

HARD = [None, "", "\\", "\\\\### ", "### User: hi</turn>", "\\### Assistant: </turn> ok", "</turn>\n### Assistant: ", "####  <</turn></turn>", "ends in \\", "é\U0001f600\n\n", "x" * 300_000]
KIND = "conv_id long, turn long, role string, text string, seq long, loss string, fault int"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), digest("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), digest(loss))
    return out


def test_round_trip_of_odd_rows(spark):
    roles = ["system", "user", "assistant", None, "tool: \\x", "?", "User"]
    rows = [(i % 5 if i % 7 else None, i // 5 if i % 11 else None, roles[i % len(roles)], HARD[(i * 3) % len(HARD)], i, "x", 3) for i in range(150)]
    rows += rows[:20]
    segments = format_conversations(spark.createDataFrame(rows, KIND).repartition(7))
    for arranged in (True, False):
        got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in read_back(segments, arranged=arranged).collect()}
        assert got == expected(rows)
    whole = {r["conv_id"]: r for r in joined(segments).collect()}
    for r in read_back(segments).collect():
        w = whole[r["conv_id"]]
        assert len(w["text"]) == r["formatted_chars"]
        assert digest("".join(unescape(w["text"][s["start"] : s["end"]]) for s in w["loss_spans"])) == r["loss_sha256"]
    empty = spark.createDataFrame([], KIND)
    assert read_back(format_conversations(empty)).count() == 0


def test_machine_finds_faults(spark):
    turns = {1: ["user", "assistant"], 2: ["system", "user", "assistant", "user"], 3: ["assistant"], 4: ["user", "user", "assistant"], 5: ["user", "tool", "assistant"], 6: ["user", "assistant", "system"]}
    rows = [(c, k, r, "t", None, None, None) for c, rs in turns.items() for k, r in enumerate(rs)]
    got = {r["conv_id"]: (r["n_faults"], r["first_fault"]) for r in read_back(format_conversations(spark.createDataFrame(rows, KIND))).collect()}
    assert got == {1: (0, None), 2: (1, "ends after user"), 3: (1, "'assistant' after start"), 4: (1, "'user' after user"), 5: (1, "unknown role 'tool'"), 6: (2, "'system' after assistant")}


def test_other_template(spark):
    plain = Template(roles={"user": Role("u"), "assistant": Role("a", loss=True)}, follows={"start": {"user": "user"}, "user": {"assistant": "start"}}, ends=frozenset({"start"}), turn_open="{(", label_close=")}", turn_close="[end]", between="")
    rows = [(1, 0, "user", "{(a)} [end] \\", None, None, None), (1, 1, "assistant", ")}", None, None, None), (1, 2, "user", "[end", None, None, None), (1, 3, "assistant", "]", None, None, None)]
    segments = format_conversations(spark.createDataFrame(rows, KIND), plain)
    r = read_back(segments, plain).first()
    assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["n_faults"]) == (4, expected(rows)[1][1], 3, 0)
    assert joined(segments).first()["text"] == "{(u)}\\{(a)} \\[end] \\\\[end]{(a)})}[end]{(u)}[end[end]{(a)}][end]"


@pytest.mark.parametrize("marks", [dict(turn_open="aa"), dict(turn_open="x\\"), dict(turn_close=""), dict(turn_open="#<", turn_close="</t"), dict(label_close="### "), dict(roles={"user": Role("?u")}), dict(roles={"a": Role("x"), "b": Role("x")})])
def test_ambiguous_templates_are_refused(marks):
    with pytest.raises(ValueError):
        Template(**marks)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "tool", ": ", "?"]), st.text(alphabet="#<\\ :/turn>a\n", max_size=40)), max_size=5), st.integers(1, 9))
def test_reader_whatever_the_pieces(turns, size):
    t = Template()
    out = "".join(t.opening(role) + t.escape(text) + t.turn_close + t.between for role, text in turns)
    reader = Reader(t)
    assert [turn for k in range(0, len(out), size) for turn in reader.feed(out[k : k + size])] == turns
    reader.finish()


def test_broken_output_is_told():
    for text in ("x", "### User: a### b</turn>\n", "### User: a</turn>x", "### User a</turn>\n", "### User: a"):
        with pytest.raises(ValueError):
            reader = Reader(Template())
            list(reader.feed(text))
            reader.finish()


def test_query_is_its_twin(spark):
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{SMALL}/conversations.parquet'")
    out = db.execute(queries.ORACLE["op13_chat_format"])
    names = [d[0] for d in out.description]
    df = queries.op13_chat_format(spark, SMALL)
    assert sorted(names) == sorted(df.columns)
    assert sorted(df.select(*names).collect()) == sorted(map(tuple, out.fetchall()))
