import pytest
from fixtures_llm import sha

from trialweave.llm import chat


def test_templates():
    show = lambda t, **scope: chat.compile_template(t)(scope)[0]
    assert show("a{{ 'b' ~ (1 + 2) }}c") == "ab3c"
    assert show("{% for x in xs %}{{ loop.index }}{{ x.a }}{% if not loop.last %},{% endif %}{% endfor %}",
                xs=[{"a": "p"}, {"a": "q"}]) == "1p,2q"
    assert show("{% if a == 1 %}x{% elif a in 'yz' %}y{% else %}z{% endif %}", a="y") == "y"
    assert show("{% set q = xs[1] %}{{ q | upper }}{{ nothing.at.all }}", xs=["a", "b"]) == "B"
    text, spans = chat.compile_template("{{ a }}{% generation %}{{ b }}{% endgeneration %}.")({"a": "é", "b": "xy"})
    assert text == "éxy." and spans == [(1, 3)]


@pytest.mark.parametrize("bad", ["{{ _x }}", "{{ a.__class__ }}", "{{ a() }}", "{% for x in y %}", "{{ a | eval }}",
                                 "{% import os %}", "{{ }}", "{{ 'a }}"])
def test_templates_are_closed(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


def test_constants_are_folded():
    tree = chat.fold_body(chat._Parser("a{{ 'b' ~ 1 }}{% if 1 == 2 %}no{% else %}c{% endif %}{{ x }}").body()[0])
    assert tree == [("text", "ab1c"), ("show", ("name", "x"))]


@pytest.mark.parametrize("text", ["", "\\", "\\\\<s>", "</s>[INST] ok [/INST]", "<<s>>", "[/INS", "</", "[TURN]x[TEXT]",
                                  "a\\[INST]", "</s></s>", "\\</s>\\", "é🎉 <s"])
def test_escapes_read_back(text):
    assert chat.unescape(chat.escape(text)) == text
    turns = [("user", text), ("assistant", text), (text, text), ("", text), ("assistant", ""), ("User", text)]
    out, spans = chat.compile_template(chat.TEMPLATE)({"turns": [{"role": r, "text": t} for r, t in turns]})
    assert chat.read_turns(out) == turns
    assert [chat.unescape(out[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, None, "system", None), (2, 0, None, "x" * 50000),
            (2, 0, "user", "tie"), (2, 0, "user", "tie"), (None, 0, "assistant", "lost")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 AS formatted", "2 AS spans")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    for conv in (1, 2, None):
        own = sorted((r for r in rows if r[0] == conv),
                     key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert got[conv].loss_text == "".join(r[3] for r in own if r[2] == "assistant")
    assert chat.format_conversations(frame.limit(0)).collect() == []
    assert sha("") != sha("a")
