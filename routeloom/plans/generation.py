"""Queries over row generation and replay: noise copies, epochs of training rows, numbered texts, range joins, deferred requests."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.functions import noise
from routeloom.functions import text as X
from routeloom.operators import epochs, noise_spread, numbering, ranges
from routeloom.plans.checks import _LINES, written_lines
from routeloom.plans.routing import REQUESTS, decided
from routeloom.plans.texts import _norm
from routeloom.plans.utterances import _HEARD, _LIST, _U, OBJECTS, OPENERS, _utterances
from routeloom.sources.tables import requests, spread, table
from routeloom.streaming import deferred

NUMBERS = "[0-9][0-9 .-]{3,}[0-9]"
NAMES = "[0-9]+|[A-Z][a-z]+"
EPOCHS, WORD_DROPOUT, CONTEXT_DROPOUT = 3, 0.3, 0.25
COPIES, LINE_COPIES = 6, 2


def span_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tags of the words that runs of digits touch, by a join of spans and words in rows of their own."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    # words of texts with runs alone; outer, as a plain explode would have the words computed again to filter by their number
    words = X.token_spans(F.when(F.col("text").rlike(NUMBERS), F.col("text")), r"\S+")
    tokens = docs.select("doc_id", F.posexplode_outer(words).alias("pos", "t")).where("pos IS NOT NULL").select("doc_id", "pos", "t.start", "t.end")
    spans = X.rows_of(docs, "doc_id", s=X.token_spans(F.col("text"), NUMBERS)).select("doc_id", "s.start", "s.end", F.lit("number").alias("label"))
    return ranges.tagged(tokens, spans, "doc_id")


def _seed_lines(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("seed_id"))
    return _utterances(spark, d).join(users, "id").groupBy("seed_id", "text").agg(F.min("id").alias("k"))


def spread_noise(spark: SparkSession, d: str) -> DataFrame:
    """Noise copies spread over the utterances of each user."""
    lines = _seed_lines(spark, d)
    return noise_spread.spread(lines, lines.select("seed_id", "text"), COPIES)


def epoch_rows(spark: SparkSession, d: str) -> DataFrame:
    """Turns as training rows of three epochs, their spans and tags moved."""
    found = X.token_spans(F.col("text"), NAMES)
    spans = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["text"].rlike("^[0-9]"), "otp").otherwise("contact").alias("label")))
    rows = spread(table(spark, d, "conversations").select("conv_id", "turn", "text")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", spans.alias("spans"))
    made = epochs.augmented(rows, EPOCHS, word_dropout=WORD_DROPOUT, context_dropout=CONTEXT_DROPOUT)
    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["label"])), ",")
    return made.select("id", "epoch", "keep_context", F.md5("text").alias("text"), shown.alias("spans"), F.array_join("tags", " ").alias("tags"))


def _generated(spark: SparkSession, d: str) -> DataFrame:
    lines, seeds = written_lines(spark, d)
    seed_id = F.concat_ws("/", "intent", F.col("seed_index").cast("string"))
    seeds = seeds.withColumn("seed_id", seed_id)
    splits = seeds.select("seed_id", F.when(F.col("seed_index") == 0, "test").otherwise("train").alias("split"))
    plain = lines.where("variant = 'plain'").withColumn("seed_id", seed_id)
    known = seeds.select("seed_id", "text").unionByName(lines.withColumn("seed_id", seed_id).select("seed_id", "text"))
    return numbering.texts(seeds, lines, splits, noise_spread.spread(plain, known, LINE_COPIES))


TEXT_COLUMNS = ["seed_id", "k", "copy", "text", "variant", "source", "split"]


def generated_texts(spark: SparkSession, d: str) -> DataFrame:
    """Seeds, their lines and noise copies of these, with splits, as numbered rows."""
    return _generated(spark, d).select("n", *TEXT_COLUMNS)


def appended_digests(spark: SparkSession, d: str) -> DataFrame:
    """The digest of the rows before more were appended, of the same rows after, and of all."""
    before = _generated(spark, d).select("n", *TEXT_COLUMNS)
    goals = table(spark, d, "part").groupBy(F.col("p_name").alias("text")).agg(F.min("p_size").alias("k"))
    more = goals.select(F.lit(None).cast("string").alias("seed_id"), "k", F.lit(-1).alias("copy"), "text", F.lit("plain").alias("variant"), F.lit("synthetic_goal").alias("source"), F.lit("train").alias("split"))
    after = numbering.appended(before, more, ["text"])
    whole = numbering.digest(before, TEXT_COLUMNS)
    parts = [whole.withColumn("part", F.lit("before")), numbering.digest(after.where("source <> 'synthetic_goal'"), TEXT_COLUMNS).withColumn("part", F.lit("prefix")), numbering.digest(after, TEXT_COLUMNS).withColumn("part", F.lit("all"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def settled_requests(spark: SparkSession, d: str) -> DataFrame:
    """Deferred requests decided again when the connection returns within thirty hours."""
    users = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = deferred.settled_table(requests(spark, d).join(users, "event_id"), "user_id", "ts", timedelta(hours=30))
    return out.select("event_id", "user_id", "connectivity", "settled_at", "outcome", "route", "reason")


_ALL = (settled_requests, span_tokens, spread_noise, epoch_rows, generated_texts, appended_digests)
QUERIES = {f.__name__: f for f in _ALL}

#: Offsets of a pattern's matches in the rows of c (id, text): id, i, start, stop, w, gap (before) and last (after the last one).
_AT = lambda name, p: f"""{name}_m AS (SELECT id, regexp_extract_all(text, '{p}') AS h, string_split_regex(text, '{p}') AS g FROM c),
    {name}_u AS (SELECT id, h[i] AS w, g[i] AS gap, g[len(h) + 1] AS last, i FROM {name}_m, range(1, len(h) + 1) r(i)),
    {name} AS (SELECT id, i - 1 AS i, w, gap, last, sum(length(gap) + length(w)) OVER o - length(w) AS start, sum(length(gap) + length(w)) OVER o AS stop FROM {name}_u WINDOW o AS (PARTITION BY id ORDER BY i))"""  # noqa: E731


def _spread_sql(n: int, tries: int = 3) -> str:
    """copies of lines (seed_id, k, text), forms of avoid (seed_id, text) left out."""
    return f"""held AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY md5('0/' || seed_id || '/' || k), k) - 1 AS turn, count(*) OVER (PARTITION BY seed_id) AS size FROM plain),
        tries AS (SELECT seed_id, k, p * size + turn AS try, text FROM held, range({tries * n}) r(p)),
        u AS (SELECT seed_id || '/' || try AS id, text FROM tries), {_HEARD[len(_U) + 2:]},
        f AS (SELECT t.seed_id, t.k, t.try, m.heard AS text, {_norm('m.heard')} AS norm FROM m JOIN tries t ON m.id = t.seed_id || '/' || t.try),
        known AS (SELECT DISTINCT seed_id, {_norm('text')} AS norm FROM avoid),
        firsts AS (SELECT * FROM f ANTI JOIN known USING (seed_id, norm) QUALIFY row_number() OVER (PARTITION BY seed_id, norm ORDER BY try) = 1),
        enough AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY try) <= {n}),
        copies AS (SELECT seed_id, k, row_number() OVER (PARTITION BY seed_id, k ORDER BY try) - 1 AS copy, try, text FROM enough)"""


_GENERATED = f"""WITH {_LINES}, sd AS (SELECT *, intent || '/' || seed_index AS seed_id FROM seeds), ln AS (SELECT *, intent || '/' || seed_index AS seed_id FROM lines),
    plain AS (SELECT seed_id, line AS k, text FROM ln WHERE variant = 'plain'), avoid AS (SELECT seed_id, text FROM sd UNION ALL SELECT seed_id, text FROM ln), {_spread_sql(LINE_COPIES)},
    told AS (SELECT intent, seed_index, seed_id, -1 AS k, -1 AS copy, text, 'plain' AS variant, 'seed' AS source, 0 AS o FROM sd
        UNION ALL SELECT intent, seed_index, seed_id, line, -1, ln.text, variant, 'paraphrase', 1 FROM ln SEMI JOIN sd USING (seed_id)
        UNION ALL SELECT sd.intent, sd.seed_index, seed_id, k, copy, copies.text, 'asr', 'asr', 2 FROM copies JOIN sd USING (seed_id)),
    rows_ AS (SELECT row_number() OVER (ORDER BY intent, seed_index, o, k, copy) - 1 AS n, seed_id, k::INT AS k, copy::INT AS copy, text, variant, source, CASE seed_index WHEN 0 THEN 'test' ELSE 'train' END AS split FROM told)"""
_HASH = "('0x' || substr(md5('=' || n || '|' || " + " || '|' || ".join(f"coalesce('=' || {c}, '-')" for c in TEXT_COLUMNS) + "), 1, 15))::BIGINT::HUGEINT"
ORACLE = {
    "settled_requests": f"""WITH {REQUESTS}, {decided('r', 'f')}, w AS (SELECT f.* EXCLUDE (route, reason, demand), f.route AS first, user_id, epoch_us(ts) AS us FROM f JOIN events USING (event_id)),
        b AS (SELECT w.event_id, arg_min(c.connectivity, c.us) AS link, min(c.us) AS back FROM w JOIN w c ON c.user_id = w.user_id AND c.connectivity <> 'none' AND c.us > w.us AND c.us <= w.us + 108000000000 WHERE w.first = 'DEFER' GROUP BY w.event_id),
        s AS (SELECT w.* EXCLUDE (connectivity, first), coalesce(link, w.connectivity) AS connectivity, coalesce(back, us + 108000000000) AS settled_at, CASE WHEN back IS NULL THEN 'expired' ELSE 'returned' END AS outcome FROM w LEFT JOIN b USING (event_id) WHERE first = 'DEFER'),
        {decided('s')} SELECT event_id, user_id, connectivity, settled_at, outcome, route, reason FROM d""",
    "span_tokens": "WITH c AS (SELECT doc_id AS id, text FROM documents), " + _AT("t", r"\S+") + ", " + _AT("s", NUMBERS) + """,
        hit AS (SELECT t.id, t.i, min(s.start) AS span FROM t JOIN s ON s.id = t.id AND t.start < s.stop AND t.stop > s.start GROUP BY ALL)
        SELECT id AS doc_id, i::INT AS pos, CASE WHEN row_number() OVER (PARTITION BY id, span ORDER BY i) = 1 THEN 'B-number' ELSE 'I-number' END AS tag FROM hit""",
    "spread_noise": f"""WITH plain AS (SELECT user_id AS seed_id, ({_LIST(OPENERS)})[event_id % {len(OPENERS)} + 1] || ' ' || ({_LIST(OBJECTS)})[user_id % {len(OBJECTS)} + 1] || CASE WHEN event_id % 3 = 0 THEN ' ?' ELSE '' END AS text, min(event_id) AS k FROM events GROUP BY ALL),
        avoid AS (SELECT seed_id, text FROM plain), {_spread_sql(COPIES)} SELECT seed_id, k, copy::INT AS copy, try, text FROM copies""",
    "epoch_rows": "WITH c AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations), " + _AT("t", r"\S+") + ", " + _AT("s", NAMES) + f""",
        guarded AS (SELECT t.id, t.i, min(s.i) AS hit FROM t LEFT JOIN s ON s.id = t.id AND t.start < s.stop AND t.stop > s.start GROUP BY ALL),
        e AS (SELECT t.*, hit, epoch, hit IS NULL AND ('0x' || substr(md5('0/' || epoch || '/' || id || '/' || i), 1, 8))::BIGINT < {int(WORD_DROPOUT * 2**32)} AS gone FROM t JOIN guarded USING (id, i), range({EPOCHS}) r(epoch)),
        w AS (SELECT *, bool_or(gone) OVER p AND NOT bool_and(gone) OVER p AS cuts, max(i) FILTER (NOT gone) OVER p AS stay, lead(start) OVER (PARTITION BY id, epoch ORDER BY i) AS next, lead(gap) OVER (PARTITION BY id, epoch ORDER BY i) AS after,
            lag(stop) OVER (PARTITION BY id, epoch ORDER BY i) AS before, max(stop) FILTER (NOT gone) OVER p AS stay_end FROM e WINDOW p AS (PARTITION BY id, epoch)),
        cut AS (SELECT id, epoch, CASE WHEN i < stay THEN start ELSE greatest(stay_end, before) END AS a, CASE WHEN i < stay THEN next ELSE stop END AS b FROM w WHERE cuts AND gone),
        kept AS (SELECT *, lag(hit) OVER (PARTITION BY id, epoch ORDER BY i) AS prior FROM w WHERE NOT (cuts AND gone)),
        body AS (SELECT id, epoch, string_agg(w || CASE WHEN i < stay OR NOT cuts THEN coalesce(after, '') ELSE '' END, '' ORDER BY i) || any_value(last) AS body,
            string_agg(CASE WHEN hit IS NULL THEN 'O' WHEN prior = hit THEN 'I-' ELSE 'B-' END || CASE WHEN hit IS NULL THEN '' ELSE (SELECT CASE WHEN regexp_matches(s.w, '^[0-9]') THEN 'otp' ELSE 'contact' END FROM s WHERE s.id = kept.id AND s.i = hit) END, ' ' ORDER BY i) AS tags FROM kept GROUP BY id, epoch),
        lead_ AS (SELECT id, gap FROM t WHERE i = 0),
        moved AS (SELECT s.id, x.epoch, s.i, s.w, s.start - coalesce(sum(greatest(0, least(b, s.start) - a)), 0) AS start, s.stop - coalesce(sum(greatest(0, least(b, s.stop) - a)), 0) AS stop
            FROM s CROSS JOIN range({EPOCHS}) x(epoch) LEFT JOIN cut ON cut.id = s.id AND cut.epoch = x.epoch GROUP BY s.id, x.epoch, s.i, s.w, s.start, s.stop),
        places AS (SELECT id, epoch, string_agg(start::BIGINT || ':' || stop::BIGINT || ':' || CASE WHEN regexp_matches(w, '^[0-9]') THEN 'otp' ELSE 'contact' END, ',' ORDER BY i) AS spans FROM moved GROUP BY ALL)
        SELECT c.id, r.epoch::INT AS epoch, ('0x' || substr(md5('0/' || r.epoch || '/' || c.id || '/context'), 1, 8))::BIGINT >= {int(CONTEXT_DROPOUT * 2**32)} AS keep_context,
            md5(coalesce(lead_.gap || body.body, c.text)) AS text, coalesce(places.spans, '') AS spans, coalesce(body.tags, '') AS tags
        FROM c CROSS JOIN range({EPOCHS}) r(epoch) LEFT JOIN body ON body.id = c.id AND body.epoch = r.epoch LEFT JOIN lead_ ON lead_.id = c.id LEFT JOIN places ON places.id = c.id AND places.epoch = r.epoch""",
    "generated_texts": f"{_GENERATED} SELECT * FROM rows_",
    "appended_digests": f"""{_GENERATED}, more AS (SELECT p_name AS text, min(p_size) AS k FROM part GROUP BY p_name),
        every AS (SELECT * FROM rows_ UNION ALL SELECT (SELECT count(*) FROM rows_) + row_number() OVER (ORDER BY text) - 1, NULL, k::INT, -1, text, 'plain', 'synthetic_goal', 'train' FROM more)
        SELECT part, count(*) AS rows, sum(h)::VARCHAR AS digest FROM (SELECT unnest(CASE source WHEN 'synthetic_goal' THEN ['all'] ELSE ['all', 'before', 'prefix'] END) AS part, {_HASH} AS h FROM every) GROUP BY part""",
}
