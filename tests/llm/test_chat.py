"""Chat formatting: escapes, template language, round trip per conversation."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skytrace.llm import chat

TEXT = st.lists(st.sampled_from([*chat.CONTROL, "<", "|", "\\", "[", "INST]", "turn|>", "/s>", "a", "\n", "é\U0001f600", "<\\|end|>"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_escapes_are_exact(text):
    shown = chat.escape(text)
    assert not any(c in shown for c in chat.CONTROL)
    assert chat.unescape(shown) == text
    line = chat.escape_line(text)
    assert "\n" not in line and not any(c in line for c in chat.CONTROL) and chat.unescape_line(line) == text


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "'mine' AS formatted", "'mine' AS spans")


def slow(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda m: (str(m[0]), m[1] is not None, m[1] or 0, m[2] or "", m[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    model = {}
    for c, said in out.items():
        loss = "".join(x for r, x in said if r == "assistant")
        model[c] = (len(said), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return model


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, 1, 2, 3]), st.sampled_from([None, 0, 1, 2]), st.sampled_from([None, "user", "assistant", "a\nb", "<|end|>"]), st.one_of(st.none(), TEXT)), min_size=1, max_size=30))
def test_round_trip(rows):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    got = {r["conv_id"]: tuple(r[1:5]) for r in chat.digests(chat.format_conversations(conversations(spark, rows))).collect()}
    assert got == slow(rows)


def test_long_and_repeated(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURN_ROWS", 7)
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"text {i} </s>") for i in range(500)] + [(2, 0, "assistant", "y" * 200_000)] * 2
    got = {r["conv_id"]: tuple(r[1:5]) for r in chat.digests(chat.format_conversations(conversations(spark, rows))).collect()}
    assert got == slow(rows)
    assert chat.digests(chat.format_conversations(conversations(spark, rows).limit(0))).count() == 0


def shown(template, messages):
    compiled = chat.compile_template(template)
    outs = [compiled.message(m, i, i == len(messages) - 1) for i, m in enumerate(messages)]
    return "".join(p for o in outs for p in o.parts), [["".join(o.parts)[a:b] for a, b in o.spans] for o in outs]


def test_template_language():
    said = [{"role": "system", "text": " be kind "}, {"role": "user", "text": "hi"}, {"role": "assistant", "text": "[INST]"}]
    template = (
        "{{ 'a' + 'b' }}{% for m in messages %}{% if m.role == 'system' and not loop.last %}<<{{ m.text | trim | upper }}>>{% elif m.role != 'assistant' or loop.first %}"
        "[{{ loop.index }}]{{ m.text }}{% else %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% if loop.last %}.{% endif %}{% endif %}{% endfor %}end{{ missing }}"
    )
    text, spans = shown(template, said)
    assert text == "ab<<BE KIND>>[2]hi[\\INST].end"
    assert spans == [[], [], ["[\\INST]"]]


def test_folding():
    tree = chat.fold(chat.parse("x{{ 'a' + 'b' | upper }}{% if 1 < 2 %}y{% else %}{{ m }}{% endif %}{% if not 'a' %}{{ m }}{% endif %}z"))
    assert tree == [("emit", ("const", "xaBy")), ("emit", ("const", "z"))] or "".join(n[1][1] for n in tree) == "xaByz"


@pytest.mark.parametrize("bad", [
    "{{ m.__class__ }}", "{{ open('x') }}", "{% import os %}", "{{ m.text | eval }}", "{% for m in messages %}", "{% if x %}{% for m in messages %}{% endfor %}{% endif %}", "{{ 'a }}", "plain", "{{ m[0] }}"])
def test_sandbox(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)
