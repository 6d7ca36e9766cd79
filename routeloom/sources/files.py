"""Stored seeds, lines, goals, pairs, predictions and settings, and their writers (SC5-SC12, SK1-SK6, SK9).

YAML files are read as whole files, one small file a task row, and parsed where they lie; keys that repeat and
items of a wrong shape fail the read with the file and the line.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.operators.policy import Policy
from routeloom.vocab import PREDICTION

UTTERANCE = "struct<text:string,style:string,variant:string,line:int>"
SIDE = "struct<intent:string,text:string,style:string,variant:string,line:int>"
GOAL_KEYS = ["name", "description", "rationale", "group", "capability", "distraction", "actuation", "consequence"]


def _whole(spark: SparkSession, path: str, parse: Callable[[str], list[tuple]], schema: str, files: str = "*.yaml") -> DataFrame:
    """Rows that ``parse`` makes of each file's text, with the file's name without its ending; no file: no rows."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [c.split()[0] for c in schema.split(", ")]
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], f"file string, {schema}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["file"], frame["content"], strict=True):
                try:
                    rows = [(name, *r) for r in parse(bytes(content).decode("utf-8"))]
                except ValueError as e:
                    raise ValueError(f"{name}: {e}") from e
                yield pd.DataFrame(rows, columns=["file", *names])

    source = spark.read.format("binaryFile").option("pathGlobFilter", files).load(path)
    return source.select(F.regexp_extract("path", r"([^/]+?)(?:\.[a-z]+)?$", 1).alias("file"), "content").mapInPandas(run, f"file string, {schema}")


def _nodes(text: str, shape: str):
    import yaml

    node = yaml.compose(text, Loader=yaml.SafeLoader)
    if node is None:
        return []
    if node.id != shape:
        raise ValueError(f"line {node.start_mark.line + 1}: a {shape} is wanted")
    if shape == "sequence":
        return node.value
    seen = [k.value for k, _ in node.value]
    for k, _ in node.value:
        if seen.count(k.value) > 1:
            raise ValueError(f"line {k.start_mark.line + 1}: key {k.value!r} repeats")
    return node.value


def _item(node, keys: list[str]) -> tuple[dict[str, object], int]:
    """An item's nodes by key, exactly ``keys``, and its line."""
    line = node.start_mark.line + 1
    got = {k.value: v for k, v in node.value} if node.id == "mapping" else {}
    if sorted(got) != sorted(keys) or node.id == "mapping" and len(node.value) != len(keys):
        raise ValueError(f"line {line}: keys {', '.join(keys)} are wanted")
    return got, line


def _string(node) -> str:
    if node.id != "scalar":
        raise ValueError(f"line {node.start_mark.line + 1}: a text is wanted")
    return node.value


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """intent, seed_index, text, style of a mapping of intents to lists (SC6); ``ord`` is the intent's place."""

    def parse(text: str) -> list[tuple]:
        out = []
        for place, (intent, items) in enumerate(_nodes(text, "mapping")):
            for i, node in enumerate(items.value):
                got, line = _item(node, ["text", "style"])
                seed = _string(got["text"])
                if seed.count("{") != seed.count("}"):
                    raise ValueError(f"line {line}: unbalanced brace")
                out.append((place, intent.value, i, seed, _string(got["style"])))
        return out

    return _whole(spark, path, parse, "ord int, intent string, seed_index int, text string, style string").drop("file")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """intent (the file's name), seed_index, k, text, variant, line of a folder of files (SC7, SC8)."""

    def parse(text: str) -> list[tuple]:
        out = []
        for index, items in _nodes(text, "mapping"):
            if not index.value.isdigit():
                raise ValueError(f"line {index.start_mark.line + 1}: {index.value!r} is no seed's number")
            for k, node in enumerate(items.value):
                got, line = _item(node, ["text", "variant"])
                out.append((int(index.value), k, _string(got["text"]), _string(got["variant"]), line))
        return out

    return _whole(spark, path, parse, "seed_index int, k int, text string, variant string, line int").withColumnRenamed("file", "intent")


def read_goals(spark: SparkSession, path: str) -> DataFrame:
    """Goals with their utterances, keys exact (SC9)."""

    def parse(text: str) -> list[tuple]:
        out = []
        for node in _nodes(text, "sequence"):
            got, line = _item(node, [*GOAL_KEYS, "utterances"])
            said = []
            for u in got["utterances"].value:
                x, at = _item(u, ["text", "style", "variant"])
                said.append({**{k: _string(v) for k, v in x.items()}, "line": at})
            out.append((*[_string(got[k]) for k in GOAL_KEYS], line, said))
        return out

    schema = ", ".join(f"{'grp' if k == 'group' else k} string" for k in GOAL_KEYS)
    return _whole(spark, path, parse, f"{schema}, line int, utterances array<{UTTERANCE}>").drop("file")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs with their two sides, keys exact (SC9)."""

    def side(node) -> dict:
        x, at = _item(node, ["intent", "text", "style", "variant"])
        return {**{k: _string(v) for k, v in x.items()}, "line": at}

    def parse(text: str) -> list[tuple]:
        out = []
        for node in _nodes(text, "sequence"):
            got, line = _item(node, ["id", "differs_in", "a", "b", "note"])
            out.append((_string(got["id"]), [_string(x) for x in got["differs_in"].value], side(got["a"]), side(got["b"]), _string(got["note"]), line))
        return out

    return _whole(spark, path, parse, f"id string, differs_in array<string>, a {SIDE}, b {SIDE}, note string, line int").drop("file")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of predictions; keys a line lacks are null, a broken line fails (SC5)."""
    return spark.read.schema(PREDICTION).option("mode", "FAILFAST").json(path)


def write_predictions(preds: DataFrame, path: str, by_source: bool = False) -> None:
    """JSON lines; with ``by_source`` a folder for each route source (SK4, SK5)."""
    (preds.write.partitionBy("route_source") if by_source else preds.write).option("ignoreNullFields", "false").json(path)


def with_route_sources(preds: DataFrame) -> DataFrame:
    """A row for each of the sources e2e, tags and combined, that source's route as the route (SK5)."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("route_source"), F.col(f"route_{s}").alias("route")) for s in ("e2e", "tags", "combined")]))
    return preds.withColumn("_s", each).drop("route").select("*", "_s.*").drop("_s")


def _stored(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def read_policy(spark: SparkSession, path: str) -> Policy:
    """A stored policy (SC10)."""
    return Policy.from_json(json.dumps(_stored(spark, path)))


def read_costs(spark: SparkSession, path: str) -> dict[str, dict[str, float]]:
    """The cells of a stored cost matrix (SC11)."""
    return _stored(spark, path)["costs"]


def read_labels(spark: SparkSession, path: str, defaults: dict[str, list[str]]) -> dict[str, list[str]]:
    """Ordered label lists; files from before a list existed get its default (SC12)."""
    return defaults | _stored(spark, path)


def line_files(lines: DataFrame) -> DataFrame:
    """(intent, text): the lines of each intent as its canonical file, to be written one file a row (SK6, O6)."""
    order = F.array_position(F.array(*map(F.lit, ("plain", "hinglish", "kannada_english", "disfluent"))), F.col("variant"))
    quoted = F.concat(F.lit('  - {text: "'), F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('", variant: '), F.col("variant"), F.lit("}\n"))
    # the lines of one seed, and the seeds of one intent: some dozens each
    seeds = lines.select("intent", "seed_index", F.struct(order.alias("o"), "k", quoted.alias("row")).alias("r")).groupBy("intent", "seed_index").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    blocks = seeds.select("intent", F.struct("seed_index", F.concat(F.lit('"'), F.col("seed_index").cast("string"), F.lit('":\n'), F.array_join("rs.row", "")).alias("block")).alias("b"))
    return blocks.groupBy("intent").agg(F.array_join(F.sort_array(F.collect_list("b"))["block"], "\n").alias("text"))


def manifest(rows: DataFrame, args: dict) -> dict:
    """What a written set holds: its arguments, a digest of its rows that no order changes, and counts (SK3, SUM1)."""
    at = rows.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).cast("string").alias("digest")).first()
    by = {c: {r[0]: r[1] for r in rows.groupBy(c).count().orderBy(c).collect()} for c in ("split", "route", "source") if c in rows.columns}
    return {"args": args, "rows": at["rows"], "digest": at["digest"], "counts": by}


def review_rows(risks: DataFrame, texts: DataFrame, issues: DataFrame) -> DataFrame:
    """A row for each text of an item, with the item's risk and issues and the text's nearest known one (SK9); readers sort
    by risk, highest first."""
    near = F.coalesce(F.concat_ws(" ", F.format_number("known.score", 2), "known.near_intent", "known.near_text"), F.lit("-"))
    said = texts.select("source", "item", "at", "side", "pos", "text", F.when(F.col("known").isNotNull(), near).otherwise("-").alias("near"), F.array_join("differ", ", ").alias("differ"))
    levels = issues.groupBy("source", "item").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    return said.join(risks, ["source", "item"]).join(levels, ["source", "item"], "left").fillna(0, ["errors", "warnings"])
