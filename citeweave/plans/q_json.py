"""Structured answers of a model: isolating the JSON object."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.functions.json_repair import repaired_object
from citeweave.plans.registry import query
from citeweave.sources.tables import table

# Event properties dressed as a model's answers: plain, fenced, in prose, after a think block, cut off, braces in prose alone.
FORMS = [
    "{0}", "Here it is:\n```json\n{0}\n```\nDone.", "The result is {0} as asked.", "<think>maybe {{x}}</think>{0}", "{0}#cut",
    "no {{object}} here",
]
FORM_SQL = "CASE event_id % 6 " + " ".join(
    f"WHEN {i} THEN " + " || ".join(
        "props" if p == "{0}" else "'" + p.replace("\n", "' || chr(10) || '").replace("{{", "{").replace("}}", "}") + "'"
        for p in f.replace("{0}", "\x00{0}\x00").split("\x00") if p)
    for i, f in enumerate(FORMS)) + " END"


def _answers(spark, base):
    parts = F.lit(None).cast("string")
    for i, form in enumerate(FORMS):
        pieces = [p for p in form.replace("{0}", "\x00{0}\x00").split("\x00") if p]
        made = F.concat(*[F.col("props") if p == "{0}" else F.lit(p.replace("{{", "{").replace("}}", "}")) for p in pieces])
        parts = F.when(F.col("event_id") % 6 == i, made).otherwise(parts)
    answer = F.when(F.col("event_id") % 6 == 4, F.expr("substring(props, 1, length(props) - 1)")).otherwise(parts)
    return table(spark, base, "events").select("event_id", answer.alias("answer"))


@query("json_objects", f"""
WITH a AS (SELECT event_id, CASE WHEN event_id % 6 = 4 THEN substr(props, 1, length(props) - 1) ELSE {FORM_SQL} END AS answer FROM events),
b AS (SELECT event_id, trim(regexp_replace(answer, '(?s)<think>.*?</think>', '', 'g'), ' ' || chr(10)) AS t FROM a),
c AS (SELECT event_id, list_concat([t], list_transform(string_split(t, '```'), lambda s: trim(regexp_replace(trim(s, ' ' || chr(10)), '^(?i:json)', ''), ' ' || chr(10))),
  [CASE WHEN contains(t, '{{') AND contains(t, '}}') THEN
    substr(t, strpos(t, '{{'), length(t) - strpos(reverse(t), '}}') + 2 - strpos(t, '{{')) END]) AS tries FROM b)
SELECT event_id, coalesce(list_filter(tries, lambda s: starts_with(s, '{{') AND json_valid(s))[1],
  CASE WHEN event_id % 6 = 4 THEN props ELSE '' END) AS object FROM c JOIN (SELECT event_id, props FROM events) USING (event_id)
""")
def json_objects(spark, base):
    """The JSON object in each answer, mended where it was cut off, empty where none can be read."""
    read = _answers(spark, base).select("event_id", "answer", T.json_object(F.col("answer")).alias("object"))
    mended = F.when(F.col("object").isNull() & F.contains("answer", F.lit("{")), repaired_object(F.col("answer")))
    return read.select("event_id", F.coalesce("object", mended, F.lit("")).alias("object"))


# Careless answers and what they mean; {0} is an event's properties.
BROKEN = [
    ("{{'id': 7, 'ok': tru", '{{"id": 7, "ok": true}}'), ('{{"items": [{0}, {{"t": "cut he', '{{"items": [{0}, {{"t": "cut he"}}]}}'),
    ('Sure: {{"a": [1, 2,], "b": {0},}} bye', '{{"a": [1, 2], "b": {0}}}'), ('{{"a": {0}, "key', '{{"a": {0}, "key": null}}'),
    ('{{"a": {0}, "n": -1.5e', '{{"a": {0}, "n": -1.5}}'), ('{{"a": {0}] wrong', ""), ('{{"a": {0}, "n":', '{{"a": {0}, "n": null}}'),
]


def _filled_sql(text: str) -> str:
    parts = text.replace("{{", "{").replace("}}", "}").split("{0}")
    return "(" + " || props || ".join("'" + p.replace("'", "''") + "'" for p in parts) + ")"


@query("json_repaired", f"""
SELECT event_id, CASE event_id % {len(BROKEN)} {" ".join(f"WHEN {i} THEN {_filled_sql(want)}" for i, (_, want) in enumerate(BROKEN))} END AS object FROM events
""")
def json_repaired(spark, base):
    """Objects of answers that were cut off, quoted wrongly or left with commas."""
    text = F.lit(None).cast("string")
    for i, (form, _) in enumerate(BROKEN):
        parts = form.replace("{{", "{").replace("}}", "}").split("{0}")
        made = F.concat(*[x for p in parts for x in (F.col("props"), F.lit(p))][1:])
        text = F.when(F.col("event_id") % len(BROKEN) == i, made).otherwise(text)
    return table(spark, base, "events").select("event_id", F.coalesce(repaired_object(text), F.lit("")).alias("object"))
