"""Personal data by candidate gradient boosting, in DataFrame functions throughout.

Base kinds (email, ip, card, phone) come from patterns with checks on the match and
always stay. High-recall generators propose further, overlapping spans: digit groups
with any common separators, and addresses written out to hide them. Boosted trees
score each proposal from its format and the words before it, and a threshold
calibrated on held-out examples selects; a chosen span that overlaps a base span or
an earlier chosen one is left out.

The trees are trained here (gradient boosting of the ML library) on examples that
SQL functions write from row numbers, and then compiled to CASE expressions over the
candidates, so scanning is one projection of the texts: no shuffle, no Python.

Patterns are written so that matching is linear: runs begin at their first character
only and loops do not backtrack. Offsets are code points, end exclusive. Null or
empty text: no spans. Repeated rows: scanned each. Empty table: no rows. A very long
text is one row of one task. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns, each equal to its plain form's leftmost matches.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
GROUPS = r"(?<![0-9A-Za-z.+-])\(?[0-9][0-9().\x20-]{5,}[0-9]"
HIDDEN = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[(\[{]at[)\]}] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[{]dot[)\]}]) ?[A-Za-z0-9-]++)++"
BASE = ("email", "ip", "card", "phone")
PHONE_WORDS = "(?i)(?:phone|tel|call|mobile|cell|fax|whatsapp|tél|teléfono|telefon|anruf|appel)"
NUMBER_WORDS = "(?i)(?:ssn|social|passport|account|iban|tax|licen[cs]e|insurance|konto|compte|cuenta)"
PLAIN_WORDS = "(?i)(?:version|isbn|order|page|section|chapter|fig|pp|date|build|release|invoice|total|price|model)"
CONTEXT = 24
FEATURES = ("digits", "length", "groups", "longest", "parens", "hyphens", "dots", "spaces", "phone_word", "number_word", "plain_word", "dated", "hidden")


def _placed(text: Column, pattern: str, gate: Column) -> Column:
    """array of (start, end, match) of a pattern's matches."""
    none = F.array().cast("array<string>")
    found = F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    between = F.when(gate, F.split(text, pattern, -1)).otherwise(none)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))

    def add(acc: Column, pair: Column) -> Column:
        a = acc["at"] + F.length(pair["gap"])
        b = a + F.length(pair["hit"])
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"), pair["hit"].alias("match")))).alias("out"))

    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda hit, gap: F.struct(F.coalesce(gap, F.lit("")).alias("gap"), hit.alias("hit")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, add, lambda acc: acc["out"])).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    at = F.sequence(F.lit(1), n)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(at, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _part_ok(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(short) <= 3) & (F.when(F.length(short) <= 3, short).otherwise("999").cast("int") <= 255)


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _part_ok),
    "card": lambda m: F.length(_digits(m)).between(14, 19) & F.when(F.length(_digits(m)).between(14, 19), luhn(_digits(m))).otherwise(False),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}


def _gates(text: Column) -> dict[str, Column]:
    return {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}+"), "phone": F.contains(text, F.lit("+"))}


def candidate_features(match: Column, before: Column, hidden: Column) -> list[Column]:
    """In the order of FEATURES, as doubles."""
    parts = F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0))
    count = lambda c: F.length(match) - F.length(F.replace(match, F.lit(c)))
    cols = [
        F.length(_digits(match)), F.length(match), F.size(parts), F.coalesce(F.array_max(F.transform(parts, lambda p: F.length(p))), F.lit(0)), count("("), count("-"), count("."), count(" "),
        before.rlike(PHONE_WORDS), before.rlike(NUMBER_WORDS), before.rlike(PLAIN_WORDS), match.rlike(r"^\(?(?:(?:19|20)[0-9]{2}[-. ][0-9]{1,2}[-. ][0-9]{1,2}|[0-9]{1,2}[-. ][0-9]{1,2}[-. ](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2} ?- ?(?:19|20)[0-9]{2})$"), hidden,
    ]
    return [c.cast("double") for c in cols]


def examples(spark: SparkSession, n: int = 4000, seed: int = 3) -> DataFrame:
    """(label, fold, match, before, hidden): candidates written from row numbers."""
    draw = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(k))
    d = lambda salt, k: F.lpad(draw(salt, 10**k).cast("string"), k, "0")
    cat = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    year = F.concat(F.element_at(F.array(F.lit("19"), F.lit("20")), (draw("y", 2) + 1).cast("int")), d("yy", 2))
    personal = [
        cat("(", d(1, 3), ") ", d(2, 3), "-", d(3, 4)), cat(d(1, 3), "-", d(2, 3), "-", d(3, 4)), cat(d(1, 3), ".", d(2, 3), ".", d(3, 4)), cat(d(1, 3), " ", d(2, 3), " ", d(3, 4)),
        cat(d(1, 3), "-", d(2, 2), "-", d(3, 4)), cat("0", d(1, 2), " ", d(2, 2), " ", d(3, 2), " ", d(4, 2), " ", d(5, 2)), cat("0", d(1, 3), " ", d(2, 7)),
    ]
    plain = [
        cat(year, "-", d(1, 2), "-", d(2, 2)), cat(d(1, 2), ".", d(2, 2), ".", year), cat(d(1, 1), ".", d(2, 1), ".", d(3, 4)), d(1, 8), d(1, 16), cat(d(1, 3), "-", d(2, 1), "-", d(3, 2), "-", d(4, 6), "-", d(5, 1)),
        cat(year, "-", year), cat(d(1, 2), " ", d(2, 2), " ", d(3, 3), " ", d(4, 1)), cat(d(1, 6), ".", d(2, 4)), cat(d(1, 1), " ", d(2, 1), " ", d(3, 1), " ", d(4, 1)), cat(d(1, 3), ".", d(2, 3), ".", d(3, 3), ".", d(4, 3)),
    ]
    written = cat("user", d(1, 2), " (at) mail", d(2, 1), " (dot) example")
    context = [["", "the of and ", "phone: ", "call me at ", "ssn ", "account no. "], ["", "the of and ", "version ", "isbn ", "order ", "page "]]
    choose = lambda xs, salt: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]), (draw(salt, len(xs)) + 1).cast("int"))
    label = draw("label", 2)
    hidden = draw("hidden", 8) == 0
    rows = spark.range(n).select(label.alias("label"), draw("fold", 4).alias("fold"), ((label == 1) & hidden).alias("hidden"), choose(personal, "p").alias("p"), choose(plain, "n").alias("n"), written.alias("w"), choose(context[0], "c").alias("c1"), choose(context[1], "c").alias("c0"))
    return rows.select(F.col("label").cast("double"), "fold", F.when(F.col("hidden"), F.col("w")).when(F.col("label") == 1, F.col("p")).otherwise(F.col("n")).alias("match"), F.when(F.col("label") == 1, F.col("c1")).otherwise(F.col("c0")).alias("before"), "hidden")


Tree = tuple  # (feature, threshold, left, right) or (value,)


def _tree(node) -> Tree:
    if node.numDescendants() == 0:
        return (float(node.prediction()),)
    split = node.split()
    return (int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild()))


def train_trees(spark: SparkSession, *, n: int = 4000, rounds: int = 10, depth: int = 3, precision: float = 0.97, seed: int = 3) -> tuple[list[tuple[float, Tree]], float]:
    """((weight, tree) of each round, threshold on the sum): the least threshold with the precision on held-out examples."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = examples(spark, n, seed)
    rows = rows.select("label", "fold", *[c.alias(f) for c, f in zip(candidate_features(F.col("match"), F.col("before"), F.col("hidden")), FEATURES, strict=True)]).coalesce(1).cache()
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows.where("fold > 0"))
    model = GBTClassifier(labelCol="label", featuresCol="x", maxIter=rounds, maxDepth=depth, seed=seed).fit(data)
    trees = [(float(w), _tree(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees, strict=True)]
    held = rows.where("fold = 0").groupBy(margin([F.col(f) for f in FEATURES], trees).alias("s")).agg(F.sum("label").alias("hits"), F.count("*").alias("n")).orderBy(F.desc("s")).collect()
    rows.unpersist()
    threshold, hits, seen = float("inf"), 0.0, 0
    for r in held:
        hits, seen = hits + r["hits"], seen + r["n"]
        if hits >= precision * seen:
            threshold = r["s"]
    return trees, threshold


def margin(x: list[Column], trees: list[tuple[float, Tree]]) -> Column:
    """The trees' weighted sum as one expression."""

    def compiled(tree: Tree) -> Column:
        if len(tree) == 1:
            return F.lit(tree[0])
        feature, threshold, left, right = tree
        return F.when(x[feature] <= threshold, compiled(left)).otherwise(compiled(right))

    return F.round(reduce(lambda a, b: a + b, [F.lit(w) * compiled(t) for w, t in trees]), 9)


_trained: dict[str, tuple[list[tuple[float, Tree]], float]] = {}


def trained(spark: SparkSession) -> tuple[list[tuple[float, Tree]], float]:
    key = spark.sparkContext.applicationId
    if key not in _trained:
        _trained[key] = train_trees(spark)
    return _trained[key]


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_<base kind>, base_sha256, spans, found (array of kind, start, end)."""
    trees, threshold = trained(docs.sparkSession)
    kinds = {k: i for i, k in enumerate((*BASE, "number", "hidden"))}
    t = F.col("text")
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    gates = _gates(t)
    numbers = t.rlike(r"[0-9][0-9().\x20-]{5,}[0-9]")
    at_word = F.contains(t, F.lit("at)")) | F.contains(t, F.lit("at]")) | F.contains(t, F.lit("at}"))
    rows = rows.select(id_col, "text", *[_placed(t, PATTERNS[k], gates[k]).alias(f"_{k}") for k in BASE], _placed(t, GROUPS, numbers).alias("_number"), _placed(t, HIDDEN, at_word).alias("_hidden"))

    def spans(k: str, keep) -> Column:
        return F.transform(F.filter(F.col(f"_{k}"), keep), lambda s: F.struct(s["start"].alias("start"), F.lit(kinds[k]).alias("order"), s["end"].alias("end"), F.lit(k).alias("kind")))

    def checked(k: str):
        return lambda s: CHECKS[k](s["match"])

    def is_kind(k: str):
        return lambda s: s["kind"] == k

    def chosen(k: str):
        def keep(s: Column) -> Column:
            begin = F.greatest(s["start"] - CONTEXT, F.lit(0))
            before = F.substring(t, begin + 1, s["start"] - begin)
            return margin(candidate_features(s["match"], before, F.lit(k == "hidden")), trees) >= threshold

        return keep

    base = F.array_sort(F.concat(*[spans(k, checked(k)) for k in BASE]))
    extra = F.array_sort(F.concat(spans("number", chosen("number")), spans("hidden", chosen("hidden"))))
    rows = rows.select(id_col, base.alias("base"), extra.alias("extra"))
    free = F.filter("extra", lambda s: ~F.exists("base", lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    # proposals are in order of start: keep one if it begins after the last kept ends
    apart = F.aggregate(free, none, lambda acc, s: F.when((F.size(acc) == 0) | (F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)) <= s["start"]), F.concat(acc, F.array(s))).otherwise(acc))
    rows = rows.select(id_col, "base", F.array_sort(F.concat("base", apart)).alias("every"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select(
        id_col, *[F.size(F.filter("base", is_kind(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(text("base"), 256).alias("base_sha256"), text("every").alias("spans"), F.transform("every", lambda s: F.struct(s["kind"].alias("kind"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))).alias("found"),
    )
