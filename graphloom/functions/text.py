"""Column functions over text, with the word lists they use as defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists.
HEADERS = (("decision", ("decision", "chose", "selected")), ("pattern", ("pattern", "approach", "implementation", "strategy")), ("failure", ("failure", "issue", "problem", "error", "fix")))
ALTERNATIVE_LINES = ("instead of", "rather than", "vs", "versus", "alternative")
LESSON_LINES = ("learned", "lesson", "solution", "fix")
ORDERED_A = (("decision", ("chose", "decided", "selected")), ("pattern", ("pattern", "approach", "implementation")), ("failure", ("failed", "error", "problem")))
ORDERED_B = (("decision", ("chose", "decided", "selected", "went with")), ("pattern", ("pattern", "approach", "implementation", "how to")), ("failure", ("failed", "error", "problem", "didn't work")))
SCORED = (
    ("decision", ("chose", "decided", "selected", "went with", "picked", "opted for", "settled on", "committed to", "instead of", "rather than", "over", "vs", "versus")),
    ("pattern", ("pattern", "approach", "strategy", "methodology", "how to", "implementation", "best practice", "workflow", "process for", "way to")),
    ("failure", ("failed", "didn't work", "broken", "issue with", "problem", "tried but", "attempted", "didn't help", "made it worse", "abandoned", "gave up on")),
)
ALTERNATIVE_MARKERS = ("instead of", "rather than", "vs", "versus", "over", "or")
LESSON_MARKERS = ("learned", "lesson", "discovered", "realized", "found out")
WINDOWED = (
    ("decision", ("decided to", "chose to", "selected", "went with", "decision was to", "architecture is to"), 200, 300),
    ("pattern", ("pattern is", "approach is", "strategy for", "always", "consistently", "best practice"), 100, 500),
    ("failure", ("failed", "broke", "error", "bug", "lesson learned", "don't", "avoid"), 200, 400),
)
STOP_QUERY = ("what", "when", "where", "why", "how", "in", "the", "a", "an", "about", "were", "was", "made")
STOP_A = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "is", "was", "are", "were")
STOP_B = ("that", "this", "with", "from", "have", "will", "your", "about", "there")
STOP_C = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "should", "could", "may", "might", "this", "that", "these", "those", "with", "from", "by", "as", "of",
)
REFERENCES = (
    (r"(?:relates? to|references?)", "REFERENCES", 1.0),
    (r"(?:depends? on|requires?|needs)", "DEPENDS_ON", 1.0),
    (r"(?:similar to|like)", "SIMILAR_TO", 0.9),
    (r"(?:implements?|follows?)", "IMPLEMENTS", 0.9),
    (r"(?:alternative to|instead of)", "ALTERNATIVE_TO", 0.9),
    (r"(?:addresses|solves)", "ADDRESSES", 0.8),
)
#: Source and collection of the two kinds of conversation stores.
TAGS = (("claude_code", "alpha"), ("claude_desktop", "beta"))
WORD4 = r"[\p{L}\p{N}_]{4,}"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def has_any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def ordered_class(c: Column, lexicon=ORDERED_A, other: str | None = None) -> Column:
    """The first class any of whose words stands in the lower-cased text."""
    low, out = F.lower(c), F.lit(other)
    for name, words in reversed(lexicon):
        out = F.when(has_any(low, words), F.lit(name)).otherwise(out)
    return out


def scored_class(c: Column, lexicon=SCORED) -> Column:
    """The class with most different words in the text; ties to the first, none without any."""
    low = F.lower(c)
    scores = [(name, sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))) for name, words in lexicon]
    best = F.greatest(*(s for _, s in scores))
    out = F.lit(None).cast("string")
    for name, s in reversed(scores):
        out = F.when(s == best, F.lit(name)).otherwise(out)
    return F.when(best > 0, out)


def first_sentence_with(c: Column, words) -> Column:
    """The first stretch between full stops that holds a word, else the text; 200 characters, lower case."""
    low = F.lower(c)
    hit = F.try_element_at(F.filter(F.split(low, r"\."), lambda s: has_any(s, words)), F.lit(1))
    return F.coalesce(F.substring(strip(hit), 1, 200), F.substring(low, 1, 200))


def alternatives(c: Column, markers=ALTERNATIVE_MARKERS, most: int = 3) -> Column:
    """What follows the first place of each marker, up to its next place or the full stop, 50 characters; the first three that are not blank."""
    low = F.lower(c)
    after = lambda m: F.when(F.contains(low, F.lit(m)), F.substring(strip(F.substring_index(F.split_part(low, F.lit(m), F.lit(2)), ".", 1)), 1, 50))
    return F.slice(F.filter(F.array(*map(after, markers)), lambda x: x.isNotNull() & (x != "")), 1, most)


def title(c: Column) -> Column:
    """The first sentence, 80 characters."""
    head = F.substring(strip(F.substring_index(c, ".", 1)), 1, 80)
    return F.when(head == "", F.lit("Pattern")).otherwise(head)


def lesson(c: Column, markers=LESSON_MARKERS) -> Column:
    """200 characters from the first marker (in the order of the list) that the text holds, else its first 200."""
    low, out = F.lower(c), F.substring(c, 1, 200)
    for m in reversed(markers):
        out = F.when(F.contains(low, F.lit(m)), F.substring(c, F.locate(m, low), F.lit(200))).otherwise(out)
    return out


def _words(c: Column) -> Column:
    return F.split(strip(F.lower(c)), r"\s+")


def keywords_a(c: Column) -> Column:
    """Different words of more than four letters, no stop words, in order, five."""
    return F.slice(F.array_distinct(F.filter(_words(c), lambda w: (F.char_length(w) > 4) & ~w.isin(*STOP_A))), 1, 5)


def keywords_b(c: Column) -> Column:
    """Different words of four or more letters a to z alone, no stop words, sorted, five. A word is a run of letters and digits of any script, and underscores."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.slice(F.array_sort(F.array_distinct(F.filter(found, lambda w: w.rlike(r"\A[a-z]{4,}\z") & ~w.isin(*STOP_B)))), 1, 5)


def keywords_c(c: Column) -> Column:
    """Words of more than four characters, no stop words, punctuation at the ends gone, ten; repeats stay."""
    found = F.filter(_words(c), lambda w: (F.char_length(w) > 4) & ~w.isin(*STOP_C))
    return F.slice(F.transform(found, lambda w: F.regexp_replace(w, r'^[.,;:!?()\[\]{}"]+|[.,;:!?()\[\]{}"]+$', "")), 1, 10)


def query_words(c: Column) -> Column:
    """Keywords of a question: words without stop words, ten, repeats stay; time phrases are taken out first."""
    plain = F.regexp_replace(F.regexp_replace(c, r"(?i)in\s+Q[1-4]\s*\d{4}", ""), r"(?i)in\s+(timeframe|period)", "")
    return F.slice(F.filter(F.regexp_extract_all(F.lower(plain), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: ~w.isin(*STOP_QUERY)), 1, 10)


def quarter_bounds(c: Column) -> tuple[Column, Column]:
    """First and last day of the quarter named in a text (as dates); null without one."""
    q = F.nullif(F.regexp_extract(c, r"(?i)Q([1-4])\s*(\d{4})", 1), F.lit("")).cast("int")
    year = F.nullif(F.regexp_extract(c, r"(?i)Q([1-4])\s*(\d{4})", 2), F.lit("")).cast("int")
    start = F.make_date(year, q * 3 - 2, F.lit(1))
    return start, F.last_day(F.add_months(start, 2))


def normalised_hash(c: Column) -> Column:
    """md5 of the lower-cased text with single blanks."""
    return F.md5(strip(F.regexp_replace(F.lower(c), r"\s+", " ")))


def normalised_path(c: Column) -> Column:
    """/mnt/d/x as d:/x; lower case, forward slashes."""
    slashed = F.regexp_replace(c, r"\\", "/")
    return F.lower(F.regexp_replace(slashed, r"^/mnt/([A-Za-z])/", "$1:/"))


def repaired_json(c: Column) -> Column:
    """A model's answer as JSON text: thoughts, code fences and what stands around the outer braces gone; null if it is no JSON object or of another type than the three."""
    plain = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    plain = F.regexp_replace(plain, r"```(?:json)?", "")
    outer = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    ok = F.get_json_object(outer, "$.type").isin("decision", "pattern", "failure")
    return F.when(ok, outer)


def balanced_objects(c: Column) -> Column:
    """The texts between balanced braces that stand in no other such text, in their order: one pass over the characters with the open braces' places."""
    none = F.array().cast("array<struct<a:int,b:int>>")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("open"), none.alias("found"))

    def step(s, ch):
        at, last = s["at"] + 1, F.try_element_at(s["open"], F.lit(-1))
        rest = F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0)))
        closed = F.array_append(F.filter(s["found"], lambda x: x["a"] < last), F.struct(last.alias("a"), at.alias("b")))
        opened = F.when(ch == "{", F.array_append(s["open"], at)).when(ch == "}", rest).otherwise(s["open"])
        return F.struct(at.alias("at"), opened.alias("open"), F.when((ch == "}") & last.isNotNull(), closed).otherwise(s["found"]).alias("found"))

    spans = F.aggregate(F.regexp_extract_all(c, F.lit(r"(?s)."), F.lit(0)), begin, step)["found"]
    return F.transform(spans, lambda x: F.substr(c, x["a"], x["b"] - x["a"] + 1))


def answer_object(c: Column) -> Column:
    """A model's answer as the JSON object it means: the repaired whole, or else the last balanced object in it of one of the three types; null without one, or where the whole says none."""
    plain = F.regexp_replace(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?i)```json\s*", ""), r"`+\s*", "")
    outer = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    # in brackets, as what follows a whole value would pass unseen
    listed = lambda x: F.try_parse_json(F.concat(F.lit("["), x, F.lit("]")))
    kind = lambda x: F.when(F.try_variant_get(listed(x), "$[1]", "variant").isNull(), F.try_variant_get(listed(x), "$[0].type", "string"))
    typed = lambda x: kind(x).isin("decision", "pattern", "failure")
    last = F.try_element_at(F.filter(balanced_objects(c), lambda x: F.coalesce(typed(x), F.lit(False))), F.lit(-1))
    return F.when(typed(outer), outer).when(kind(outer) == "none", F.lit(None)).otherwise(last)


def source_tags(c: Column) -> tuple[Column, Column]:
    """(source, collection) by a collection's name."""
    alpha = F.contains(c, F.lit("alpha"))
    return F.when(alpha, TAGS[0][0]).otherwise(TAGS[1][0]), F.when(alpha, TAGS[0][1]).otherwise(TAGS[1][1])
