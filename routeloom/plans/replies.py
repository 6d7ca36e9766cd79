"""Queries over generated replies, made of events: sound ones and each kind of broken one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.operators import replies, validate
from routeloom.operators.decide import ARRAY
from routeloom.plans.checks import _ERRORS, TEXTS, _PICK, written_lines
from routeloom.sources.tables import table

#: Replies by event: %t stands for a text, %k for a number.
SHAPES = [
    '{"paraphrases": [{"text": "%t", "variant": "plain"}, {"text": " %t now ", "variant": "hinglish"}]}', '{"paraphrases": [{"text": "%t", "variant": "plain"}', '[{"text": "%t"}]', '{"paraphrases": {"text": "%t"}}',
    '{"paraphrases": ["%t", {"text": "%t", "variant": "plain"}, {"variant": "plain"}]}', '{"lines": []}', '{"paraphrases": [{"text": %k, "variant": 4}, {"text": null}, null, [%k]]}', '{"paraphrases": []}', "%t", '"%t"', '{"paraphrases": [{"text": "%t"}, {"text": "", "variant": %k}]}',
]


def _replies(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda xs, i: F.element_at(ARRAY(xs), (i % len(xs) + 1).cast("int"))
    shape = F.replace(pick(SHAPES, F.col("event_id")), F.lit("%t"), pick([t for t in TEXTS if t], F.col("user_id")))
    return table(spark, d, "events").select("event_id", F.replace(shape, F.lit("%k"), F.get_json_object("props", "$.k")).alias("reply"))


def reply_faults(spark: SparkSession, d: str) -> DataFrame:
    """Structural faults of replies with their paths."""
    return replies.faults(replies.items_of(_replies(spark, d), ["event_id"]), ["event_id"])


def reply_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the sound replies."""
    return replies.lines_of(replies.items_of(_replies(spark, d), ["event_id"]), ["event_id"])


def retry_texts(spark: SparkSession, d: str) -> DataFrame:
    """Second requests for seeds whose lines have errors."""
    lines, seeds = written_lines(spark, d)
    asked = seeds.select(F.concat_ws("/", "intent", F.col("seed_index").cast("string")).alias("item"), F.concat(F.lit("write lines for: "), "text").alias("prompt"), F.to_json(F.struct(F.col("style"))).alias("reply"))
    out = replies.retry_texts(asked, validate.line_errors(lines, seeds, strict=True))
    return out.select("item", F.length("text").alias("n"), F.md5("text").alias("text"))


_ALL = (reply_faults, reply_lines, retry_texts)
QUERIES = {f.__name__: f for f in _ALL}

_R = f"""r AS (SELECT event_id, replace(replace({_PICK(SHAPES, 'event_id')}, '%t', {_PICK([t for t in TEXTS if t], 'user_id')}), '%k', json_extract_string(props, '$.k')) AS reply FROM events),
    p AS (SELECT event_id, json_valid(reply) AS ok, CASE WHEN json_valid(reply) THEN reply::JSON END AS j FROM r),
    t AS (SELECT *, json_type(j) AS top, json_type(j, '$.paraphrases') AS list FROM p),
    x AS (SELECT event_id, unnest(range(json_array_length(j, '$.paraphrases')::BIGINT)) AS i, j FROM t WHERE top = 'OBJECT' AND list = 'ARRAY'),
    items AS (SELECT event_id, i, json_extract(j, '$.paraphrases[' || i || ']') AS item FROM x),
    faults AS (SELECT event_id, CASE WHEN NOT ok OR top <> 'OBJECT' THEN '$' ELSE '$.paraphrases' END AS path, CASE WHEN NOT ok THEN 'no_json' WHEN top <> 'OBJECT' THEN 'no_object' ELSE 'no_list' END AS code FROM t WHERE NOT ok OR top <> 'OBJECT' OR list IS NULL OR list <> 'ARRAY'
        UNION ALL SELECT event_id, '$.paraphrases[' || i || ']', 'no_object' FROM items WHERE json_type(item) <> 'OBJECT'
        UNION ALL SELECT event_id, '$.paraphrases[' || i || '].text', 'no_text' FROM items WHERE json_type(item) = 'OBJECT' AND coalesce(json_type(item, '$.text'), '') <> 'VARCHAR')"""
_SAID = "'- item ' || line || ': ' || code || CASE detail WHEN '' THEN '' ELSE ' ' || detail END"
ORACLE = {
    "reply_faults": f"WITH {_R} SELECT * FROM faults",
    "reply_lines": f"WITH {_R} SELECT event_id, (i + 1)::INT AS line, trim(json_extract_string(item, '$.text')) AS text, coalesce(json_extract_string(item, '$.variant'), 'None') AS variant FROM items ANTI JOIN faults USING (event_id)",
    "retry_texts": f"""{_ERRORS}, every AS (SELECT item, line, code, detail FROM e UNION ALL SELECT intent || '/' || seed_index, 0, 'quota', short FROM quotas WHERE short <> ''),
        listed AS (SELECT item, string_agg({_SAID}, chr(10) ORDER BY line, code, detail) AS listed FROM every GROUP BY item), asked AS (SELECT intent || '/' || seed_index AS item, 'write lines for: ' || text AS prompt, '{{"style":"' || style || '"}}' AS reply FROM seeds),
        made AS (SELECT item, prompt || chr(10) || chr(10) || '{replies.RETRY_HEAD}' || chr(10) || chr(10) || listed || chr(10) || chr(10) || '{replies.RETRY_ANSWER}' || chr(10) || chr(10) || '```json' || chr(10) || reply || chr(10) || '```' || chr(10) || chr(10) || '{replies.RETRY_TAIL}' AS text FROM asked JOIN listed USING (item))
        SELECT item, length(text)::INT AS n, md5(text) AS text FROM made""",
}
