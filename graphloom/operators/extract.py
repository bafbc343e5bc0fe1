"""Knowledge from text: sections of Markdown, messages and whole conversations."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ALTERNATIVE_LINES, HEADERS, LESSON_LINES, WINDOWED, has_any, strip
from ..session import ship


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, headers=HEADERS) -> DataFrame:
    """doc id, place, class, text of the sections that start with a header line (#) of a known class and have more than `least` characters.

    A text is cut before every header line by one look-ahead split, so nothing is shuffled. The first class whose words the header holds counts.
    """
    parts = F.posexplode(F.split(F.col(text_col), r"(?m)(?=^#)")).alias("place", "text")
    head = F.lower(F.substring_index("text", "\n", 1))
    kind = F.lit(None).cast("string")
    for name, words in reversed(headers):
        kind = F.when(has_any(head, words), F.lit(name)).otherwise(kind)
    found = docs.select(id_col, parts).withColumn("class", F.when(F.col("text").startswith("#"), kind))
    found = found.withColumn("text", strip(F.col("text"))).where(F.col("class").isNotNull() & (F.char_length("text") > least))
    return found.select(id_col, "place", "class", "text")


def section_nodes(found: DataFrame, file: str | None = None) -> DataFrame:
    """The sections with the fields of their class; null elsewhere."""
    lines = F.filter(F.transform(F.split("text", "\n"), strip), lambda x: (x != "") & ~x.startswith("#"))
    line = lambda k: F.try_element_at(lines, F.lit(k + 1))
    of = lambda t, c: F.when(F.col("class") == t, c)
    two = F.nullif(F.array_join(F.slice(lines, 2, 2), " "), F.lit(""))
    head = F.regexp_extract("text", r"(?m)^#+\s+(.+)$", 1)
    first_lesson = F.try_element_at(F.filter(lines, lambda x: has_any(F.lower(x), LESSON_LINES)), F.lit(1))
    place = F.array_position(lines, first_lesson)
    return found.withColumns({
        "description": of("decision", F.concat(F.substring(line(0), 1, 200), F.lit("" if file is None else f" (from {file})"))),
        "rationale": of("decision", F.coalesce(F.substring(two, 1, 300), F.substring(line(0), 1, 200))),
        "alternatives": of("decision", F.slice(F.transform(F.filter(lines, lambda x: has_any(F.lower(x), ALTERNATIVE_LINES)), lambda x: F.substring(x, 1, 100)), 1, 3)),
        "name": of("pattern", F.substring(F.coalesce(F.nullif(head, F.lit("")), line(0)), 1, 80)),
        "context": of("pattern", F.substring(F.array_join(F.slice(lines, 1, 2), " "), 1, 300)),
        "implementation": of("pattern", F.substring(F.array_join(lines, " "), 1, 500)),
        "use_cases": of("pattern", F.array(F.substring(line(0), 1, 100))),
        "attempt": of("failure", F.substring(line(0), 1, 200)),
        "reason_failed": of("failure", F.coalesce(F.substring(line(1), 1, 300), F.lit("See documentation"))),
        "lesson_learned": of("failure", F.substring(first_lesson, 1, 300)),
        "alternative_solution": of("failure", F.substring(F.when(place > 0, F.try_element_at(lines, (place + 1).cast("int"))), 1, 200)),
    })


def second_level_patterns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A pattern for each part after a ## header with 100 characters or more; the whole text if there is none and it has over 100."""
    long_ = docs.where(F.char_length(text_col) >= 50)
    parts = F.filter(F.slice(F.split(F.col(text_col), r"\n##\s+"), 2, 1 << 20), lambda p: F.char_length(p) >= 100)
    whole = F.when(F.char_length(text_col) > 100, F.array(F.col(text_col))).otherwise(F.array().cast("array<string>"))
    rows = long_.select(id_col, F.posexplode(F.when(F.size(parts) > 0, parts).otherwise(whole)).alias("place", "part"))
    return rows.select(id_col, "place", F.substring(strip(F.substring_index(strip(F.col("part")), "\n", 1)), 1, 80).alias("name"), F.substring("part", 1, 1000).alias("implementation"))


def message_patterns(messages: DataFrame) -> DataFrame:
    """A pattern for each assistant message of more than 100 characters."""
    name = strip(F.substring("text", 1, 80))
    cut = F.when(F.char_length(name) > 70, F.concat(F.substring(name, 1, 70), F.lit("..."))).otherwise(name)
    return messages.where((F.col("role") == "assistant") & (F.char_length("text") > 100)).select("conv_id", "turn", cut.alias("name"), F.substring("text", 1, 1000).alias("implementation"))


def conversations(messages: DataFrame, role: str | None = None) -> DataFrame:
    """conv_id, turns, text: messages in order, one on a line; those without a conversation under unknown."""
    rows = messages if role is None else messages.where(F.col("role") == role)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda m: m["text"])
    return rows.groupBy(F.coalesce(F.col("conv_id").cast("string"), F.lit("unknown")).alias("conv_id")).agg(F.count(F.lit(1)).alias("turns"), F.array_join(texts, "\n").alias("text"))


def windowed(convs: DataFrame, rules=WINDOWED) -> DataFrame:
    """conv_id, class, marker, capture, context: every place of every marker, 10 to 200 characters after it and the text around.

    Places of matches are not to be had from SQL functions, so this reads batches in Python.
    """
    ship(convs.sparkSession)
    compiled = [(name, m, re.compile(rf"{re.escape(m)}\s+(.{{10,200}})", re.I), before, after) for name, markers, before, after in rules for m in markers]

    def run(frames):
        for frame in frames:
            rows = []
            for conv, text in zip(frame["conv_id"], frame["text"]):
                for name, marker, pattern, before, after in compiled:
                    for m in pattern.finditer(text or ""):
                        if len(m[1].strip()) >= 10:
                            rows.append((conv, name, marker, m[1].strip(), text[max(0, m.start() - before) : m.end() + after]))
            yield pd.DataFrame(rows, columns=["conv_id", "class", "marker", "capture", "context"])

    return convs.select("conv_id", "text").mapInPandas(run, "conv_id string, class string, marker string, capture string, context string")


def captures(df: DataFrame, id_col: str, text_col: str, markers, low: int = 10, high: int = 200) -> DataFrame:
    """id, marker, capture by SQL functions alone: what follows each marker on its line."""
    rows = None
    for m in markers:
        part = df.select(id_col, F.lit(m).alias("marker"), F.explode(F.regexp_extract_all(text_col, F.lit(rf"(?d){re.escape(m)}\s+(.{{{low},{high}}})"), F.lit(1))).alias("capture"))
        rows = part if rows is None else rows.union(part)
    return rows.withColumn("capture", strip(F.col("capture"))).where(F.char_length("capture") >= low)


# How first-match rules begin, and what ends their capture.
STOP = r"\.|,|;|$"
FIRST = {
    "decision": (("decided to ", r"\.|,|;|because|$"), ("chose ", r"\.|,|;|because|over|$"), ("selected ", r"\.|,|;|for|$"), ("went with ", r"\.|,|;|instead|$"), ("picked ", STOP), ("using ", " (?:for|because|instead)")),
    "pattern": (("always ", STOP), ("pattern (?:of |is )?", STOP), ("approach (?:is |involves )?", STOP), ("strategy (?:is |for )?", STOP), ("convention (?:of |is )?", STOP)),
    "failure": (("failed to ", STOP), ("didn't work ", STOP), ("broke ", STOP), ("error (?:in |with )?", STOP), ("bug (?:in |with )?", STOP), ("issue (?:with |in )?", STOP)),
}
CAPS = {"decision": 200, "pattern": 100, "failure": 200}


def first_match(df: DataFrame, text_col: str, rules=FIRST, caps=CAPS) -> DataFrame:
    """df with class and capture: the first rule of the first class that matches; a text of more than 50 characters without any is a pattern by its first 80; under 10 none."""
    t = F.regexp_replace(F.col(text_col), r"\n$", "")
    out = F.when(F.char_length(t) > 50, F.struct(F.lit("pattern").alias("class"), F.concat(F.substring(t, 1, 80), F.lit("...")).alias("capture")))
    for name in reversed(list(rules)):
        for begin, end in reversed(rules[name]):
            got = F.regexp_extract(t, rf"(?id){begin}(.+?)(?:{end})", 1)
            out = F.when(got != "", F.struct(F.lit(name).alias("class"), strip(F.substring(got, 1, caps[name])).alias("capture"))).otherwise(out)
    found = F.when(F.char_length(t) >= 10, out)
    return df.withColumn("_found", found).withColumn("class", F.col("_found.class")).withColumn("capture", F.col("_found.capture")).drop("_found")


def quality(hits: DataFrame, least: int = 30, relevance: float = 0.05, most: int = 21, chars: int = 200) -> DataFrame:
    """hits (id, content, relevance_score) with reason: too_short, low_relevance, duplicate_pattern or accepted."""
    ok = (F.char_length("content") >= least) & (F.col("relevance_score") >= relevance)
    rank = F.row_number().over(Window.partitionBy(ok, F.substring("content", 1, chars)).orderBy("id"))
    reason = F.when(F.char_length("content") < least, "too_short").when(F.col("relevance_score") < relevance, "low_relevance").when(rank > most, "duplicate_pattern").otherwise("accepted")
    return hits.withColumn("reason", reason)


def gather(hits: DataFrame, done: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """hits (query_no, rank, id, relevance_score) of many queries: each id once, where it came first; ids in done go; the most relevant first if ordered."""
    first = Window.partitionBy("id").orderBy("query_no", "rank")
    out = hits.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    out = out if done is None else out.join(done.select("id"), "id", "left_anti")
    return out.orderBy(F.col("relevance_score").desc(), "id") if ordered else out


def capped(df: DataFrame) -> DataFrame:
    """Extracted fields cut to what a node takes."""
    sizes = {"description": 200, "rationale": 500, "name": 100, "context": 200, "implementation": 1000, "attempt": 200, "reason_failed": 500, "lesson_learned": 500}
    out = df.withColumns({c: F.substring(c, 1, n) for c, n in sizes.items() if c in df.columns})
    return out.withColumn("alternatives", F.slice("alternatives", 1, 5)) if "alternatives" in df.columns else out


def by_model(df: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", batch: int = 20, chars: int = 1000, schema: str = "doc_id long, answer string") -> DataFrame:
    """Answers of a model (a function of a list of texts to a list of answers or None), so many texts a call; without a model use first_match."""

    def run(frames):
        for frame in frames:
            ids, texts = frame[id_col].tolist(), [(t or "")[:chars] for t in frame[text_col]]
            for at in range(0, len(ids), batch):
                answers = model(texts[at : at + batch])
                answers = [*answers, *[None] * batch][: len(ids[at : at + batch])]
                yield pd.DataFrame({id_col: ids[at : at + batch], "answer": answers})

    return df.select(id_col, text_col).where(F.char_length(text_col) >= 100).mapInPandas(run, schema)


def by_model_each(df: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", schema: str = "doc_id long, answer string") -> DataFrame:
    """As by_model, one text a call and more of it."""
    return by_model(df, model, id_col, text_col, batch=1, chars=2000, schema=schema)


def structured_records(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Records under ## headers with fields such as **ID:**; a row for each record that has an id."""
    fields = {"record_id": ("ID", None), "decision": ("Decision", 200), "breakthrough": ("Breakthrough", 200), "context": ("Context", 500), "technical_details": ("Technical Details", 1000), "tags": ("Tags", None), "priority": ("Priority", None), "difficulty": ("Difficulty", None)}
    rows = df.select(F.explode(F.split(F.concat(F.lit("\n"), F.col(text_col)), r"\n## ")).alias("part"))
    def one(label, size):
        got = F.nullif(strip(F.regexp_extract("part", rf"\*\*{label}:\*\*\s*(.+)", 1)), F.lit(""))
        return got if size is None else F.substring(got, 1, size)
    out = rows.select(F.substring_index("part", "\n", 1).alias("title"), *(one(label, size).alias(name) for name, (label, size) in fields.items()))
    return out.where("record_id is not null").withColumn("tags", F.filter(F.transform(F.split("tags", ","), strip), lambda x: x != ""))


def record_nodes(records: DataFrame) -> DataFrame:
    """Records of structured_records as nodes: type, description, rationale, alternatives of decisions; name, implementation, context, use_cases of breakthroughs, which become patterns.

    A record with both is what stands last in it by its columns: a breakthrough. Decisions tagged typescript get the two usual ways out as alternatives.
    """
    broken = F.col("breakthrough").isNotNull()
    what = F.coalesce(F.substring(F.coalesce("breakthrough", "decision"), 1, 200), F.when(broken, "Unknown breakthrough").otherwise("Unknown decision"))
    typed = F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.contains(F.lower(t), F.lit("typescript")))
    none = F.array().cast("array<string>")
    of = lambda t, c: F.when(broken if t == "Pattern" else ~broken, c)
    return records.where(F.coalesce("breakthrough", "decision").isNotNull()).select(
        "record_id", F.when(broken, "Pattern").otherwise("Decision").alias("type"),
        of("Decision", what).alias("description"), of("Decision", F.substring(F.coalesce("context", F.lit("")), 1, 500)).alias("rationale"),
        of("Decision", F.when(typed, F.array(F.lit("Continue with errors"), F.lit("Systematic fix approach"))).otherwise(none)).alias("alternatives"),
        of("Pattern", F.substring(what, 1, 100)).alias("name"), of("Pattern", F.substring(F.coalesce("technical_details", F.lit("")), 1, 1000)).alias("implementation"),
        of("Pattern", F.concat(F.lit("Breakthrough difficulty: "), F.coalesce("difficulty", F.lit("medium")))).alias("context"), of("Pattern", F.array(what)).alias("use_cases"),
    )
