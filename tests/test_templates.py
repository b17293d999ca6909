"""Templates against plain renderers, and masks against a re-encoding of every prefix."""

import json
import random

import pytest
from pyspark.sql import functions as F

from talkweft.operators import masks as K
from talkweft.operators import templates as T
from talkweft.plans.trained import TOOLS, vocabulary


def plain_lines(messages, generation):
    out = []
    for m in messages:
        if m["role"] == "assistant" and m["tool_calls"]:
            calls = [{"id": c["id"], "index": c["index"], "type": c["type"], "function": {"name": c["function"]["name"], "arguments": json.loads(c["function"]["arguments"])}} for c in m["tool_calls"]]
            out.append("assistant:" + json.dumps({"tool_calls": calls}, ensure_ascii=False, separators=(",", ":"), sort_keys=True))
        elif m["role"] == "tool":
            out.append(f"tool {m['name']}[{m['tool_call_id']}]:{m['content'] or ''}")
        else:
            out.append(f"{m['role']}:{m['content'] or ''}")
    return "\n".join(out) + ("\nassistant:" if generation else "")


def drawn(rng, n):
    say = lambda: rng.choice(["Hello", "", None, " two  words ", 'a "quoted" \\ line\nand more', "é漢😀", "?!", "<tool_call>", "tab\there"])
    rows = []
    for i in range(n):
        messages = [dict(role="system", content="Be kind.", tool_calls=None, tool_call_id=None, name=None, loss=None)] * rng.randrange(2)
        for k in range(rng.randrange(5)):
            messages.append(dict(role="user", content=say(), tool_calls=None, tool_call_id="no", name="no", loss=True))
            if rng.random() < 0.4:
                args = json.dumps({"a": say() or "", "n": k}, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
                call = dict(id=f"c{k}", index=0, type="function", function=dict(name="pay", arguments=args))
                messages.append(dict(role="assistant", content=None, tool_calls=[call], tool_call_id=None, name=None, loss=rng.choice([True, None, False])))
                messages.append(dict(role="tool", content=say(), tool_calls=None, tool_call_id=f"c{k}", name="pay", loss=None))
            messages.append(dict(role="assistant", content=say(), tool_calls=[], tool_call_id=None, name=None, loss=rng.choice([True, None, False])))
        rows.append((i, messages))
    return [*rows, (n, None)]


@pytest.fixture(scope="module")
def stored(spark):
    rows = drawn(random.Random(4), 40)
    return rows, spark.createDataFrame(rows, f"id int, m array<{T.MESSAGE}>").withColumn("m", T.template_messages(F.col("m")))


@pytest.mark.parametrize("generation", [False, True])
def test_plain_template(stored, generation):
    rows, df = stored
    got = {r.id: r.t for r in df.select("id", T.Template.read(T.PLAIN).render(F.col("m"), df.schema["m"].dataType, generation).alias("t")).collect()}
    assert got == {i: plain_lines(m or [], generation) for i, m in rows}


def test_template_notation(spark):
    source = """{# a note #}
{%- if tools | length == 2 %}never{% endif %}{% for m in messages[1:] %}
  {% if loop.first and not m.name is defined %}
<{{ m['role'] | upper ~ ':' + m.content | trim }}>{{ loop.index }}
  {% elif m.role in ['user', 'tool'] or m.content == 'x' %}
({{ m.name }}|{{ m.content | tojson }}|{{ m.loss }})
  {%- else -%}
    -{{ loop.last }}
  {% endif %}
{% endfor %}{{ messages[0].content }}"""
    row = [("system", "S", None, None, None, None), ("user", "  Hi ", None, None, None, None), ("tool", 'q"', None, "c", "n", True), ("assistant", "y", None, None, None, None)]
    df = spark.createDataFrame([(row,)], f"m array<{T.MESSAGE}>")
    got = df.select(T.Template.read(source).render(F.col("m"), df.schema["m"].dataType, tools=TOOLS).alias("t")).first().t
    assert got == '<USER:Hi>1\n(n|"q\\""|True)-True\nS'


@pytest.mark.parametrize("bad", ["{% macro x %}", "{% if a %}", "{{ a | shout }}", "{{ a < b }}", "{% endfor %}", "{{ messages }}", "{{ f(x) }}"])
def test_template_refuses(spark, bad):
    df = spark.createDataFrame([], f"m array<{T.MESSAGE}>")
    with pytest.raises(T.TemplateError):
        T.Template.read(bad).render(F.col("m"), df.schema["m"].dataType)


def test_template_hash():
    assert T.template_hash(None, "f", "C") != T.template_hash("None", "f", "C") and len(T.template_hash("é", "f", "C")) == 64


@pytest.mark.parametrize("source", [T.PLAIN, T.MARKED])
def test_masks_equal_prefix_encodings(stored, source):
    """Labels are those of encoding every prefix by itself; rows where that can't be shown have none and say why."""
    from tokenizers import Tokenizer

    rows, df = stored
    kind, template = df.schema["m"].dataType, T.Template.read(source)
    upto = lambda n, g: template.render(F.slice("m", 1, n), kind, g)
    texts = {r.id: r for r in df.select("id", F.coalesce(template.render(F.col("m"), kind), F.lit("")).alias("t"), F.transform(F.sequence(F.lit(0), F.lit(20)), lambda n: F.struct(upto(n, True).alias("a"), upto(n + 1, False).alias("b"))).alias("p")).collect()}
    tokenizer = Tokenizer.from_file(vocabulary())
    tokenizer.encode_special_tokens = True
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    got = {r.id: r for r in K.training_rows(df, template, "m", vocabulary()).collect()}
    failures = 0
    for i, messages in rows:
        full, labels, spans = encode(texts[i].t), None, []
        labels = [-100] * len(full)
        failure = None
        for k, m in enumerate(messages or []):
            if m["role"] != "assistant" or m["loss"] is False:
                continue
            a, b = encode(texts[i].p[k].a), encode(texts[i].p[k].b)
            holds = lambda: full[: len(a)] == a and full[: len(b)] == b and len(b) > len(a)
            if not holds():
                t, head = texts[i].t, len(texts[i].p[k].a)
                ends = [t.find(x, head) + len(x) for x in K.END_MARKS if t.find(x, head) >= 0]
                failure = None if t.startswith(texts[i].p[k].a) else K.UNSTABLE
                failure = failure or (None if ends else K.NO_END)
                b = encode(t[: min(ends)]) if ends else b
                failure = failure or (None if holds() else K.UNSTABLE)
                if failure:
                    break
            if m["tool_calls"] and "<tool_call>" in texts[i].t and "<tool_call>" not in tokenizer.decode(b[len(a) :]):
                failure = K.NO_CALL
                break
            labels[len(a) : len(b)] = b[len(a) :]
            spans.append((k, len(a), len(b)))
        r = got[i]
        assert r.input_ids == full
        if failure or not spans:
            failures += 1
            assert r.failure == (failure or K.NO_TARGET) and r.labels == []
        else:
            assert (r.failure, r.labels, [tuple(s) for s in r.spans]) == (None, labels, spans)
    assert 0 < failures < len(rows) - 10


def test_chains_that_fit(stored):
    """The first run of whole exchanges within the budget, in tokens, with message numbers of the whole conversation."""
    rows, df = stored
    made = {r.id: r for r in K.training_rows(df, T.Template.read(T.MARKED), "m", vocabulary(), budget=60).collect()}
    whole = {r.id: r for r in K.training_rows(df, T.Template.read(T.MARKED), "m", vocabulary()).collect()}
    cut = [i for i in whole if len(whole[i].input_ids) > 60]
    assert cut and {made[i].failure for i in made} >= {None, K.TOO_LONG}
    for i in whole:
        r = made[i]
        if i not in cut:
            assert (r.input_ids, r.labels) == (whole[i].input_ids, whole[i].labels)
        elif r.failure is None:
            messages = rows[i][1]
            assert len(r.input_ids) <= 60 and r.offset > 0
            assert all(messages[s.message]["role"] == "assistant" for s in r.spans)
