"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
STOPWORDS = """a an the to me my i you your can could please for of on in at it its is are am be
and or so this that from with just do does will would there here we us our im ill ive
id dont some""".split()
MAX_WORDS = 24
FRAGMENT_WORDS, FRAGMENT_WORDS_DISFLUENT = 6, 9
FIRST_NAMES = """anil kavya ravi deepa suresh meghana karthik divya arun lakshmi senthil priya vignesh
rahul neha amit pooja vikas sunita rohit nikhil anjali vishnu sreeja joseph arjun reshma
sourav moumita arindam tanushree debashis riya harpreet gurpreet manjeet simran jaspreet
navjot farah""".split()
SENSITIVE_SLOTS = ["contact", "phone", "address", "otp", "card"]
SLOTS = SENSITIVE_SLOTS + """place city temperature fan_level song artist station podcast time date duration team topic
note_text message_text event_title drive_mode color speed seat window number""".split()
PHONE = r"\+91|(?:^|[^0-9])(?:[0-9][\s-]?){9}[0-9](?:[^0-9]|$)"
SHORT_NUMBER = r"(?:^|[^0-9.:])[0-9]{4,6}(?:[^0-9.:]|$)"
CARD = r"(?i)\bcard ending\b|\bending\s+[0-9]+"
WORD_TOKEN = r"[\p{L}\p{N}_]+(?:[.:][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]"
OPENER = r"^(?:(?:uh|um|er|so|hey|okay|ok)\s+)*(?:(?:can|could|would|will|shall)\s+(?:you|we|i)|is\s+there|are\s+there|do\s+you)\b"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rows_of(df: DataFrame, *columns: str | Column, **values: Column) -> DataFrame:
    """``columns`` with one row for each element of the array named in ``values``, none for an empty or null one.

    Outer, because for a plain explode the optimizer infers a filter on the array's size that
    computes the array's expression twice more for every row, below any repartition."""
    ((name, value),) = values.items()
    return df.select(*columns, F.explode_outer(value).alias(name)).where(F.col(name).isNotNull())


def normalize(text: Column) -> Column:
    """Lower case, apostrophes dropped, white space collapsed, one final question mark removed."""
    t = F.regexp_replace(F.lower(text), "['‘’]", "")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.rtrim(F.regexp_replace(t, r"\?$", ""))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalize(text), " "), lambda w: w != ""))


def content_tokens(text: Column) -> Column:
    """Distinct lower-case words without slots and stop words; a word with a digit is <num>."""
    t = F.translate(F.regexp_replace(F.lower(text), r"\{[^{}]*\}", " "), "'‘’", "")
    words = F.array_distinct(F.split(t, "[^a-z0-9<>]+"))
    words = F.transform(words, lambda w: F.when(w.rlike("[0-9]"), "<num>").otherwise(w))
    return F.array_except(words, F.array(*map(F.lit, ["", *STOPWORDS])))


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def jaccard(a: Column, b: Column) -> Column:
    """1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.try_divide(_shared(a, b), union.cast("double")))


def token_jaccard(a: Column, b: Column) -> Column:
    """0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.try_divide(_shared(a, b), F.size(F.array_union(a, b)).cast("double")))


def overlap(a: Column, b: Column) -> Column:
    """The share of b that is in a; 0 where b is empty."""
    return F.coalesce(F.try_divide(_shared(a, b), F.size(b).cast("double")), F.lit(0.0))


def slots(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\{([^{}]*)\}"), F.lit(1))


def asks(text: Column) -> Column:
    return text.rlike(OPENER)


def has_sensitive_slot(text: Column) -> Column:
    return F.arrays_overlap(slots(text), F.array(*map(F.lit, SENSITIVE_SLOTS)))


#: Before a capitalised word that starts no sentence and is not I: the white space after a word that ends none.
AFTER_WORD = r"(?<=[^\s.!?])(?<![.!?][\u0085\u2028\u2029])\s++(?!I(?!\S))(?=\p{Lu})"


def sensitive_parts(text: Column) -> dict[str, Column]:
    """What makes a text sensitive: a phone number, a short number, a card phrase, or a capitalised word that starts
    no sentence and is not I."""
    return {"phone": text.rlike(PHONE), "short_number": text.rlike(SHORT_NUMBER), "card": text.rlike(CARD), "named": text.rlike(AFTER_WORD)}


def detect_sensitive(text: Column) -> Column:
    """Whether any of ``sensitive_parts`` is in the text."""
    return reduce(or_, sensitive_parts(text).values())


def _without_slots(text: Column) -> Column:
    return F.regexp_replace(text, r"\{[^{}]*\}", " ")


def format_errors(text: Column, seed: Column | None = None) -> Column:
    """Codes of the hard line rules a text breaks; an empty text breaks only that one. With the
    text of the seed it belongs to, the slots are compared."""
    bare = _without_slots(text)
    body = F.lower(F.regexp_replace(bare, r"\?$", ""))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    ascii_only = ~text.rlike(r"[^\x00-\x7F]")
    rules = {
        "unbalanced_brace": bare.rlike("[{}]"), "too_many_words": words > MAX_WORDS, "non_ascii": ~ascii_only, "uppercase": text != F.lower(text),
        "bad_space": text.rlike(r"^\s|\s$") | F.contains(text, F.lit("  ")), "punctuation": ascii_only & body.rlike("[^a-z0-9' ]"),
        "space_before_mark": F.endswith(text, F.lit(" ?")), "long_number": bare.rlike("[0-9]{4}"),
        "literal_name": F.arrays_overlap(F.split(normalize(bare), " "), F.array(*map(F.lit, FIRST_NAMES))),
    }
    if seed is not None:
        names = lambda t: F.array_sort(F.array_distinct(slots(t)))
        rules["slots_differ"] = names(text) != names(seed)
    every = F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules.items()]))
    return F.when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", F.array(F.lit("empty"))).otherwise(every)


def text_errors(text: Column) -> Column:
    """The line rules for a text without a seed, and slots that do not exist."""
    unknown = F.size(F.array_except(slots(text), F.array(*map(F.lit, SLOTS)))) > 0
    return F.concat(format_errors(text), F.when(unknown, F.array(F.lit("unknown_slot"))).otherwise(F.array().cast("array<string>")))


def style_slips(text: Column, style: Column, variant: Column) -> Column:
    """Codes of a line that does not suit its seed's style."""
    marked = F.endswith(text, F.lit("?"))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    most = F.when(variant == "disfluent", FRAGMENT_WORDS_DISFLUENT).otherwise(FRAGMENT_WORDS)
    slips = {
        "question_mark": (style != "question") & marked, "reads_as_question": (style != "question") & ~marked & asks(text),
        "long_fragment": (style == "fragment") & (words > most), "literal_digit": _without_slots(text).rlike("[0-9]") & ~text.rlike("[0-9]{4}"),
    }
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in slips.items()]))


def is_snake(name: Column) -> Column:
    return name.rlike("^[a-z][a-z0-9]*(?:_[a-z0-9]+)*$")


def keyword_hits(text: Column, entries: dict[str, list[list[str]]]) -> Column:
    """name: keywords of every entry whose keywords all begin some word of the text."""
    words = F.split(F.lower(text), "[^a-z0-9]+")
    begins = lambda ws, k: F.exists(ws, lambda w: F.startswith(w, F.lit(k)))

    def hits(ws: Column) -> Column:
        found = []
        for name, alternatives in entries.items():
            for keys in alternatives:
                every = F.lit(True)
                for k in keys:
                    every = every & begins(ws, k)
                found.append(F.when(every, F.lit(f"{name}: {' '.join(keys)}")))
        return F.array_compact(F.array(*found))

    return bound(words, hits)


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_TOKEN), F.lit(0))


#: Matches whose offsets are summed up in one array; beyond that, blocks of as many.
SPAN_BLOCK = 128


def token_spans(text: Column, pattern: str) -> Column:
    """(start, end, text) of a pattern's matches, in code points: one pass over matches and the gaps before them.

    Offsets are made in two levels, within blocks of matches and over the blocks, so that a text with very many
    matches takes time in proportion to their number, not to its square."""
    kind = "array<struct<start:int,end:int,text:string>>"
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def add(acc: Column, pair: Column) -> Column:
        a = acc["at"] + F.length(pair["gap"])
        b = a + F.length(pair["hit"])
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"), pair["hit"].alias("text")))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    pairs = F.filter(F.zip_with(hits, gaps, lambda h, g: F.struct(g.alias("gap"), h.alias("hit"))), lambda p: p["hit"].isNotNull())

    def blocks(ps: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / SPAN_BLOCK).cast("int")), lambda i: F.aggregate(F.slice(ps, i * SPAN_BLOCK + 1, F.lit(SPAN_BLOCK)), start, add))

    def placed(made: Column) -> Column:
        bases = F.aggregate(made, F.array(F.lit(0)), lambda acc, m: F.concat(acc, F.array(F.element_at(acc, -1) + m["at"])))
        moved = lambda bs: F.flatten(F.transform(made, lambda m, i: F.transform(m["out"], lambda s: F.struct((s["start"] + F.get(bs, i)).alias("start"), (s["end"] + F.get(bs, i)).alias("end"), s["text"].alias("text")))))
        return bound(bases, moved)

    found = bound(pairs, lambda ps: F.when(F.size(ps) <= SPAN_BLOCK, F.aggregate(ps, start, add, lambda acc: acc["out"])).otherwise(bound(blocks(ps), placed)))
    return F.when(text.rlike(pattern), found).otherwise(F.when(text.isNotNull(), F.array().cast(kind)))


def bio_tags(tokens: Column, spans: Column) -> Column:
    """Tags of tokens (start, end) by the first span (start, end, label) each overlaps."""
    hit = F.transform(tokens, lambda t: F.coalesce(F.get(F.filter(F.transform(spans, lambda s, i: F.when((s["start"] < t["end"]) & (s["end"] > t["start"]), i)), lambda i: i.isNotNull()), F.lit(0)), F.lit(-1)))
    tag = lambda hs: F.transform(hs, lambda h, i: F.when(h < 0, "O").otherwise(F.concat(F.when((i > 0) & (F.coalesce(F.get(hs, i - 1), F.lit(-2)) == h), "I-").otherwise("B-"), F.get(spans, h)["label"])))
    # bound, else every token would find the hits of all tokens again
    return bound(hit, tag)


def softmax(x: Column, temperature: float | Column = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    scaled = bound(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp((v - m) / t)))
    return bound(scaled, lambda e: bound(F.aggregate(e, F.lit(0.0), lambda a, y: a + y), lambda total: F.transform(e, lambda v: v / total)))
