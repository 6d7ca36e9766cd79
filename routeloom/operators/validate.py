"""Checks of written lines, goals and pairs, as issue rows.

An issue is (level, source, item, line, code, detail). Inputs:

* seeds: intent, seed_index, text, style
* lines: intent, seed_index, k, text, variant, line (k: the place in its seed's list)
* intents: intent, grp, capability, distraction, actuation, consequence
* goals: name, description, rationale, grp, the four tags, line, utterances (array of text, style, variant, line)
* pairs: id, differs_in (array), a and b (intent, text, style, variant, line), note, line
* refs: ref (a number, in order), intent, split, kind, text: seeds and lines that exist
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.functions import text as X
from routeloom.operators import similarity
from routeloom.operators.contexts import CONTEXT, route_map
from routeloom.operators.nearest import nearest
from routeloom.sources.scratch import saved
from routeloom.vocab import TAGS

# Fixed values.
QUOTA = {"plain": 24, "hinglish": 6, "kannada_english": 4, "disfluent": 6}
STYLES = ["command", "outcome", "question", "indirect", "fragment"]
GROUPS = ["vehicle_control", "navigation", "communication", "media", "information", "planning", "productivity"]
CODE_MIXED = ["hinglish", "kannada_english"]
NEAR_DUPLICATE, OOD_MOST, VALTEST_MOST, PAIR_LEAST, CONFLICT = 0.6, 0.5, 0.7, 0.4, 0.5
LEAST_UTTERANCES, MOST_UTTERANCES, LEAST_STYLES, LEAST_FIRST_WORDS, LEAST_SHARED = 8, 12, 3, 4, 2
OOD_KEYWORDS = {
    "set_ambient_lighting": [["ambient"], ["mood", "light"]],
    "fog_lights_on": [["fog"]],
    "open_fuel_door": [["fuel", "door"], ["fuel", "flap"], ["fuel", "lid"], ["fuel", "cap"], ["petrol", "flap"], ["petrol", "lid"], ["tank", "flap"], ["tank", "lid"], ["filler"]],
    "route_avoiding_tolls": [["toll"]],
    "compose_long_email": [["long", "email"], ["compose", "email"], ["draft", "email"], ["write", "email"]],
    "read_news_headlines": [["news"], ["headline"]],
    "estimate_trip_cost": [["trip", "cost"], ["journey", "cost"], ["drive", "cost"]],
    "pair_bluetooth_device": [["bluetooth"], ["pair"]],
}
ISSUE = ["level", "source", "item", "line", "code", "detail"]


def issue(df: DataFrame, level: str | Column, source: str | Column, item: Column, line: Column | int, code: str | Column, detail: Column | str = "") -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(lit(level).alias("level"), lit(source).alias("source"), item.cast("string").alias("item"), lit(line).cast("long").alias("line"), lit(code).alias("code"), lit(detail).cast("string").alias("detail"))


def judged(df: DataFrame, source: str | Column, item: Column, line: Column, rules: list[tuple]) -> DataFrame:
    """Issues of rows by rules (level, code, condition, detail), all in one pass."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    each = [F.when(cond, F.struct(lit(level).alias("level"), lit(code).alias("code"), F.coalesce(lit(detail).cast("string"), F.lit("")).alias("detail"))) for level, code, cond, detail in rules]
    return issue(df.withColumn("_i", F.explode(F.array_compact(F.array(*each)))), F.col("_i.level"), source, item, line, F.col("_i.code"), F.col("_i.detail"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def formatted(issues: DataFrame) -> DataFrame:
    """source:item:line: level: code detail."""
    place = F.concat_ws(":", "source", "item", F.when(F.col("line") > 0, F.col("line").cast("string")))
    return issues.select("*", F.concat(place, F.lit(": "), F.concat_ws(": ", "level", F.trim(F.concat_ws(" ", "code", "detail")))).alias("message"))


def rolled_up(issues: DataFrame, items: list[str] | None = None) -> DataFrame:
    """Issues by level, of all or of some items."""
    return (issues.where(F.col("item").isin(items)) if items is not None else issues).groupBy("level").agg(F.count("*").alias("n"))


def require_valid(issues: DataFrame, shown: int = 20) -> None:
    """Refuse to go on where there are errors; the first ``shown`` of them are named."""
    first = formatted(issues.where("level = 'error'")).orderBy("source", "item", "line", "code", "detail").limit(shown).select("message").collect()
    if first:
        raise ValueError("\n".join(r["message"] for r in first))


def _item(intent: str = "intent", index: str = "seed_index") -> Column:
    return F.concat_ws("/", intent, F.col(index).cast("string"))


def line_errors(lines: DataFrame, seeds: DataFrame, strict: bool = False) -> DataFrame:
    """What is wrong with lines, whatever a reader thinks of them (V1)."""
    err = lambda df, code, detail="", line=F.col("line"): issue(df, "error", "lines", _item(), line, code, detail)
    known = lines.join(seeds.select("intent").distinct(), "intent", "left_semi")
    stray = lines.join(seeds.select("intent").distinct(), "intent", "left_anti").select("intent").distinct()
    places = known.select("intent", "seed_index").distinct().join(seeds, ["intent", "seed_index"], "left_anti")
    own = lines.join(seeds.select("intent", "seed_index", F.col("text").alias("seed"), "style"), ["intent", "seed_index"]).withColumn("norm", X.normalize(F.col("text")))
    first = own.groupBy("intent", "norm").agg(F.min(F.struct("seed_index", "k", "line")).alias("first"), F.count("*").alias("n")).where("n > 1")
    of_seed = seeds.groupBy(X.normalize(F.col("text")).alias("norm")).agg(F.min(F.struct("intent", "seed_index")).alias("owner"))
    # as many intents as there are, whatever the lines of each
    users = lines.select(X.normalize(F.col("text")).alias("norm"), "intent").distinct().groupBy("norm").agg(F.sort_array(F.collect_list("intent")).alias("users")).where(F.size("users") > 1)
    full = own.join(users, "norm", "left").join(of_seed, "norm", "left").join(first, ["intent", "norm"], "left")
    others = F.array_remove("users", F.col("intent"))
    parts = [
        issue(stray, "error", "lines", F.col("intent"), 0, "unknown_intent"), err(places, "unknown_index", line=0),
        err(X.rows_of(own, "*", code=X.format_errors(F.col("text"), F.col("seed"))), F.col("code")),
        judged(full, "lines", _item(), F.col("line"), [
            ("error", "variant_asr", F.col("variant") == "asr", ""), ("error", "unknown_variant", ~F.col("variant").isin("asr", *QUOTA), F.col("variant")),
            ("error", "duplicate", F.struct("seed_index", "k", "line") > F.col("first"), F.concat(F.lit("of line "), F.col("first.line").cast("string"))),
            ("error", "same_as_seed", F.col("owner").isNotNull(), F.concat(F.lit("of "), F.col("owner.intent"))),
            ("error", "same_as_other_intent", F.size(others) > 0, F.concat(F.lit("of "), F.array_join(others, ", "))),
        ]),
    ]
    if strict:
        short = quota_shortfall(lines, seeds).where("short <> ''")
        parts.append(err(short, "quota", F.col("short"), line=0))
    return union(parts)


def quota_shortfall(lines: DataFrame, seeds: DataFrame) -> DataFrame:
    """Lines of each seed and variant, and those variants whose number is not the quota's."""
    counts = lines.groupBy("intent", "seed_index").agg(*[F.count_if(F.col("variant") == v).alias(v) for v in QUOTA])
    every = seeds.select("intent", "seed_index").join(counts, ["intent", "seed_index"], "left").fillna(0, list(QUOTA))
    short = F.array_join(F.array_compact(F.array(*[F.when(F.col(v) != q, F.concat(F.lit(f"{v} "), F.col(v).cast("string"), F.lit(f"/{q}"))) for v, q in QUOTA.items()])), ", ")
    to_go = sum((F.greatest(F.lit(q) - F.col(v), F.lit(0)) for v, q in QUOTA.items()), F.lit(0))
    return every.withColumns({"short": short, "to_go": to_go})


def line_warnings(lines: DataFrame, seeds: DataFrame) -> DataFrame:
    """What a reader should look at (V2)."""
    warn = lambda df, code, detail="": issue(df, "warning", "lines", _item(), F.col("line"), code, detail)
    score = lambda c="score": F.format_number(c, 2)
    own = lines.join(seeds.select("intent", "seed_index", F.col("text").alias("seed"), "style"), ["intent", "seed_index"])
    own = own.withColumns({"norm": X.normalize(F.col("text")), "toks": X.word_set(F.col("text"))})
    to_seed = own.withColumn("score", F.round(X.jaccard(F.col("toks"), X.word_set(F.col("seed"))), 9)).where(F.col("score") > NEAR_DUPLICATE)
    # places in a seed's list follow k, then the file
    spot = F.struct("k", "line")
    grouped = own.select("intent", "seed_index", _item().alias("g"), spot.alias("spot"), "norm", "toks")
    pairs = similarity.near_in_group(grouped, "g", "spot", NEAR_DUPLICATE)
    pairs = pairs.join(own.select("intent", "seed_index", _item().alias("g"), spot.alias("second")), ["g", "second"]).withColumn("line", F.col("second.line"))
    slips = X.rows_of(own, "*", code=X.style_slips(F.col("text"), F.col("style"), F.col("variant")))
    keyed = own.select(F.struct("intent", "seed_index", "k", "line").alias("id"), "intent", X.content_tokens(F.col("text")).alias("toks"))
    refs = seeds.select(F.struct("intent", "seed_index").alias("ref"), "intent", X.content_tokens(F.col("text")).alias("toks"))
    far = similarity.drift(keyed, refs, LEAST_SHARED).select("id.*", "closer", "score", "own")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    plain = own.where("variant = 'plain'").groupBy("intent", "seed_index").agg(
        F.count("*").alias("n"), F.countDistinct(F.get(words, F.lit(0))).alias("firsts"), F.min(F.struct("k", "line")).alias("first")
    ).where((F.col("n") >= LEAST_FIRST_WORDS) & (F.col("firsts") < LEAST_FIRST_WORDS)).withColumn("line", F.col("first.line"))
    return union([
        warn(to_seed, "near_seed", score()), warn(pairs, "near_line", F.concat(F.col("first.line").cast("string"), F.lit(" "), score())), warn(slips, F.col("code")),
        warn(far, "drift", F.concat_ws(" ", "closer", score(), score("own"))), warn(plain, "few_first_words", F.col("firsts").cast("string")),
    ])


def invariants(acts: Column, vehicle: Column) -> dict[str, Column]:
    """Tag combinations that no intent may have, by rule."""
    return {
        "a vehicle command has a side effect": acts & (F.col("consequence") == "none"), "only vehicle_control has an actuation": acts & ~vehicle,
        "vehicle_control needs an actuation": vehicle & ~acts, "vehicle commands are local_ok": acts & (F.col("capability") != "local_ok"),
    }


def intent_violations(intents: DataFrame) -> DataFrame:
    """(intent, rule) of each broken invariant."""
    rules = invariants(F.col("actuation") != "none", F.col("grp") == "vehicle_control")
    return intents.select("intent", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))).alias("rule"))


def _utterances(goals: DataFrame, pairs: DataFrame) -> DataFrame:
    """All texts of an augmentation: source, item, owner's line, side, pos, text, style, variant, line, intent."""
    of_goals = goals.select(F.lit("goals").alias("source"), F.col("name").alias("item"), F.col("line").alias("at"), F.lit("").alias("side"), F.posexplode("utterances").alias("pos", "u"))
    of_goals = of_goals.select("source", "item", "at", "side", "pos", "u.text", "u.style", "u.variant", "u.line", F.lit(None).cast("string").alias("intent"))
    sides = F.posexplode(F.array(*[F.struct(F.lit(s).alias("side"), *[F.col(f"{s}.{c}").alias(c) for c in ("intent", "text", "style", "variant", "line")]) for s in "ab"])).alias("pos", "u")
    of_pairs = pairs.select(F.lit("pairs").alias("source"), F.col("id").alias("item"), F.col("line").alias("at"), sides)
    return of_goals.unionByName(of_pairs.select("source", "item", "at", "u.side", "pos", "u.text", "u.style", "u.variant", "u.line", "u.intent"))


def reviewed(goals: DataFrame, pairs: DataFrame, refs: DataFrame, intents: DataFrame) -> DataFrame:
    """Each text with its nearest known, val/test and OOD text, and the tags in which the nearest differs."""
    u = _utterances(goals, pairs).withColumns({"id": F.xxhash64("source", "item", "at", "side", "pos"), "toks": X.content_tokens(F.col("text"))})
    index = refs.select("ref", F.col("intent").alias("near_intent"), "split", "kind", F.col("text").alias("near_text"), X.content_tokens(F.col("text")).alias("toks"))
    sets = {"known": F.col("split") != "ood", "valtest": F.col("split").isin("val", "test"), "ood": F.col("split") == "ood"}
    u = u.join(nearest(u.select("id", "toks"), index, sets, keep=["near_intent", "near_text", "split", "kind"]), "id")
    tags = list(TAGS)
    theirs = intents.select(F.col("intent").alias("near_intent"), *[F.col(t).alias(f"_{t}") for t in tags])
    own = goals.select(F.lit("goals").alias("source"), F.col("name").alias("item"), F.col("line").alias("at"), *tags)
    u = u.join(theirs, F.col("known.near_intent") == F.col("near_intent"), "left").join(own, ["source", "item", "at"], "left")
    differ = F.array_compact(F.array(*[F.when(F.col(t) != F.col(f"_{t}"), F.lit(t)) for t in tags]))
    differ = F.when(F.col("known").isNull(), F.array().cast("array<string>")).when(F.col("source") == "goals", differ).otherwise(F.array_compact(F.array(F.when(F.col("near_intent") != F.col("intent"), F.lit("intent")))))
    # written once: its readers pass over it many times
    return saved(u.withColumn("differ", differ).drop("near_intent", *tags, *[f"_{t}" for t in tags]), "reviewed")


def augmentation_issues(goals: DataFrame, pairs: DataFrame, refs: DataFrame, intents: DataFrame, ood_intents: list[str], strict: bool = False, texts: DataFrame | None = None) -> DataFrame:
    """What is wrong, or worth a look, with goals and pairs (V3, V4). texts: their reviewed texts, where the caller has them."""
    u = texts if texts is not None else reviewed(goals, pairs, refs, intents)
    here = lambda df, level, code, detail="", line=F.col("line"): issue(df, level, F.col("source"), F.col("item"), line, code, detail)
    p = lambda df, code, detail="": issue(df, "error", "pairs", F.col("id"), F.col("line"), code, detail)
    outside = lambda c, known: ~F.coalesce(F.col(c), F.lit("")).isin(*known)
    num = lambda c: F.format_number(c, 2)

    # texts of both
    u = u.withColumn("norm", X.normalize(F.col("text")))
    existing = refs.groupBy(X.normalize(F.col("text")).alias("norm")).agg(F.min_by("intent", "ref").alias("of"))
    spot = F.struct("source", "at", "item", "pos")
    first = u.groupBy("norm").agg(F.min(spot).alias("first"), F.count("*").alias("n")).where("n > 1")
    owned = u.join(existing, "norm", "left").join(first, "norm", "left").join(intents.select("intent", F.lit(True).alias("is_known")), "intent", "left")
    of_pair, is_ood = F.col("source") == "pairs", F.coalesce(F.col("intent").isin(ood_intents), F.lit(False))
    texts = judged(owned, F.col("source"), F.col("item"), F.col("line"), [
        ("error", "unknown_style", outside("style", STYLES), F.col("style")), ("error", "unknown_variant", outside("variant", QUOTA), F.col("variant")),
        ("error", "same_as_existing", F.col("of").isNotNull(), F.col("of")), ("error", "duplicate", spot > F.col("first"), F.col("first.item")),
        ("error", "like_val_or_test", F.col("valtest.score") > VALTEST_MOST, F.concat_ws(" ", num("valtest.score"), "valtest.near_intent")),
        (F.when(of_pair, "warning").otherwise("error"), "like_ood", F.col("ood.score") > OOD_MOST, F.concat_ws(" ", num("ood.score"), "ood.near_intent")),
        ("error", "unknown_intent", of_pair & F.col("is_known").isNull(), F.col("intent")), ("error", "ood_intent", of_pair & is_ood, F.col("intent")),
        ("warning", "nearer_to_other_intent", of_pair & F.col("is_known") & ~is_ood & (F.size("differ") > 0) & (F.col("known.shared") >= LEAST_SHARED), F.col("known.near_intent")),
    ])
    parts = [texts, here(X.rows_of(u, "*", code=X.text_errors(F.col("text"))), "error", F.col("code"))]

    # goals
    enums = {"grp": GROUPS, **TAGS}
    acts, vehicle = F.col("actuation") != "none", F.col("grp") == "vehicle_control"
    sound = ~reduce(lambda x, y: x | y, [outside(c, vs) for c, vs in enums.items()])
    quota = "error" if strict else "warning"
    n = F.size("utterances")
    nth = F.row_number().over(Window.partitionBy("name").orderBy("line"))
    named = goals.withColumns({"nth": nth, "hits": X.keyword_hits(F.concat_ws(" ", "name", "description"), OOD_KEYWORDS)})
    named = named.join(intents.select(F.col("intent").alias("name"), F.lit(True).alias("taken")), "name", "left")
    parts.append(judged(named, "goals", F.col("name"), F.col("line"), [
        ("error", "not_snake_case", ~X.is_snake(F.col("name")), ""), ("error", "existing_intent", F.col("taken"), ""), ("error", "repeated_name", F.col("nth") > 1, ""),
        *[("error", f"empty_{c}", F.trim(c) == "", "") for c in ("description", "rationale")], *[("error", "unknown_value", outside(c, vs), c) for c, vs in enums.items()],
        *[("error", "broken_invariant", sound & cond, rule) for rule, cond in invariants(acts, vehicle).items()], ("error", "vehicle_not_low_distraction", sound & acts & (F.col("distraction") != "low"), ""),
        ("error", "names_ood_goal", F.size("hits") > 0, F.array_join("hits", "; ")), (quota, "utterances", ~n.between(LEAST_UTTERANCES, MOST_UTTERANCES), n),
        (quota, "few_styles", F.size(F.array_distinct("utterances.style")) < LEAST_STYLES, ""), (quota, "no_code_mixed", ~F.exists("utterances", lambda x: x["variant"].isin(*CODE_MIXED)), ""), ("error", "no_utterances", n == 0, ""),
    ]))
    of_goal = u.where("source = 'goals'")
    rows = of_goal.select(F.concat_ws("/", "item", F.col("at").cast("string")).alias("g"), "pos", "norm", X.word_set(F.col("text")).alias("toks"))
    near = similarity.near_in_group(rows, "g", "pos", NEAR_DUPLICATE).join(of_goal.select(F.concat_ws("/", "item", F.col("at").cast("string")).alias("g"), F.col("pos").alias("second"), "source", "item", "line"), ["g", "second"])
    routing = F.array(*map(F.lit, ("capability", "distraction", "actuation")))
    broken = reduce(lambda x, y: x | y, invariants(acts, vehicle).values()) | acts & (F.col("distraction") != "low")
    free = goals.where(sound & ~broken).select(F.col("name").alias("item"), F.col("line").alias("at"))
    conflict = of_goal.join(free, ["item", "at"], "left_semi").where((F.col("known.score") >= CONFLICT) & (F.col("known.shared") >= LEAST_SHARED) & (F.size(F.array_intersect("differ", routing)) > 0))
    parts += [here(near, "warning", "near_line", num("score")), here(conflict, "warning", "conflicting_tags", F.concat_ws(" ", "known.near_intent", num("known.score"), F.array_join(F.array_intersect("differ", routing), ",")))]

    # pairs
    nth = F.row_number().over(Window.partitionBy("id").orderBy("line"))
    alike = X.token_jaccard(X.content_tokens(F.col("a.text")), X.content_tokens(F.col("b.text")))
    parts.append(judged(pairs.withColumns({"nth": nth, "alike": alike}), "pairs", F.col("id"), F.col("line"), [
        ("error", "not_snake_case", ~X.is_snake(F.col("id")), ""), ("error", "repeated_id", F.col("nth") > 1, ""), ("error", "empty_note", F.trim("note") == "", ""),
        ("error", "unknown_tag", F.size(F.array_except("differs_in", F.array(*map(F.lit, TAGS)))) > 0, ""), ("error", "same_intent", F.col("a.intent") == F.col("b.intent"), F.col("a.intent")),
        ("error", "texts_differ", F.col("alike") < PAIR_LEAST, num("alike")),
    ]))
    tagged = lambda s: intents.select(F.col("intent").alias(f"i{s}"), F.struct(*TAGS).alias(f"t{s}"))
    both = pairs.where("a.intent <> b.intent").withColumns({"ia": F.col("a.intent"), "ib": F.col("b.intent")}).where(~F.col("ia").isin(ood_intents) & ~F.col("ib").isin(ood_intents))
    both = both.join(tagged("a"), "ia").join(tagged("b"), "ib")
    actual = F.array_compact(F.array(*[F.when(F.col(f"ta.{t}") != F.col(f"tb.{t}"), F.lit(t)) for t in TAGS]))
    mapped = route_map(pairs.sparkSession)  # 96 x 288 rows, whatever the data
    keys = ["sensitive", *CONTEXT]
    routed = lambda s: mapped.select(F.struct("capability", "distraction", "actuation").alias(f"k{s}"), *keys, F.col("route").alias(f"r{s}"))
    wanted = both.select(*[F.struct(f"t{s}.capability", f"t{s}.distraction", f"t{s}.actuation").alias(f"k{s}") for s in "ab"]).distinct()
    apart = wanted.join(routed("a"), "ka").join(routed("b"), ["kb", *keys]).where("ra <> rb").select("ka", "kb").distinct()
    keyed = both.withColumns({f"k{s}": F.struct(f"t{s}.capability", f"t{s}.distraction", f"t{s}.actuation") for s in "ab"})
    wrong = (F.array_sort(F.array_distinct("differs_in")) != F.array_sort("actual")) | (F.size(F.array_distinct("differs_in")) != F.size("differs_in"))
    parts += [p(both.withColumn("actual", actual).where(wrong), "differs_in_is_wrong", F.array_join("actual", ",")), p(keyed.join(apart, ["ka", "kb"], "left_anti"), "routes_never_differ")]
    return union(parts)


def item_risk(texts: DataFrame, issues: DataFrame) -> DataFrame:
    """reviewed texts and their issues: (source, item, risk, nearest): the closest call of an item's texts, one more
    for each error (A30), and the intent most of its texts are nearest to, the first on ties (A31)."""
    score = lambda c: F.coalesce(F.col(f"{c}.score"), F.lit(0.0))
    call = F.greatest(score("ood") / OOD_MOST, score("valtest") / VALTEST_MOST, F.when(F.size("differ") > 0, score("known") / CONFLICT).otherwise(0.0))
    risk = texts.groupBy("source", "item").agg(F.max(call).alias("call"))
    errors = issues.where("level = 'error'").groupBy("source", "item").agg(F.count("*").alias("errors"))
    votes = texts.where("known is not null").groupBy("source", "item", "known.near_intent").agg(F.count("*").alias("n"), F.min("pos").alias("at"))
    modal = votes.groupBy("source", "item").agg(F.max(F.struct("n", (-F.col("at")).alias("minus"), "near_intent")).alias("m")).select("source", "item", F.col("m.near_intent").alias("nearest"))
    out = risk.join(errors, ["source", "item"], "left").join(modal, ["source", "item"], "left")
    return out.select("source", "item", F.round(F.col("call") + F.coalesce("errors", F.lit(0)), 6).alias("risk"), "nearest")
