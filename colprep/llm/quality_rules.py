"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition over measures of one text. A sample of the table is written once; every rule is timed alone
over it, from the raw text, and one count by the set of failed rules gives all selectivities. The next rule is always
the one with the most rejections, among sampled texts that passed the rules before it, per second. The cascade is a
CASE expression in that order: a text that fails a rule is not looked at by the later ones. The order changes the
cost alone: a text is kept if it fails no rule.

The sample bounds the planning only (``SAMPLE_ROWS`` rows in expectation); measures and verdicts cover every row.

A text's 3-word windows are compared as 64-bit hashes first: without two equal hashes no window repeats. Otherwise
the windows themselves are sorted and neighbours compared, so the count is exact.

Cases: a null text counts as empty and fails ``few_words``; texts are measured whole, whatever their length; repeated
rows and null or repeated ids give one row each; an empty table gives no rows (the rules then keep their given order);
other columns are ignored by ``audit`` and kept by ``drop_failing``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprep.llm.common import written

SAMPLE_ROWS = 2000
SAMPLE_SEED = 11
LEAST_COST = 1e-4  # seconds a sample; below this a clock says nothing
WINDOW = 3

# Word separators, symbols, bounds of the base rules.
SPACES, SOLID, SYMBOLS = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]", r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEATED = 50, 50
# Bounds of the other rules: percent, except for the characters of a mean word.
MAX_SYMBOLS, MIN_MEAN, MAX_MEAN, MAX_CAPITALS, MIN_LETTERED, MAX_DUP_LINES, MAX_BULLETS = 10, 3, 10, 30, 80, 30, 90

Measures = Callable[[str], Column]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " "), "")


def repeated_words(words: Column) -> Column:
    """Number of words in windows of three that stand in the text twice or more."""
    def window(of: Column, keyed: Callable[[Column, Column], Column]) -> Column:
        return F.slice(F.transform(of, keyed), 1, F.greatest(F.size(of) - (WINDOW - 1), F.lit(0)))

    def places(s: Column) -> Column:
        same = F.filter(s, lambda x, k: (x["g"] == F.get(s, k - 1)["g"]) | (x["g"] == F.get(s, k + 1)["g"]))
        return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(*[x["i"] + k for k in range(WINDOW)])))))

    def count(w: Column) -> Column:
        hashes = window(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        keys = window(w, lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")))
        return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(F.sort_array(keys), places)))

    return _let(words, count)


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(SOLID))


# Each measure of a text as a long; ``words`` and ``lines`` are arrays that others share.
MEASURES: dict[str, Callable[[Column, Measures], Column]] = {
    "words": lambda text, m: words_of(text),
    "lines": lambda text, m: worded_lines(text),
    "n_words": lambda text, m: F.size(m("words")),
    "word_chars": lambda text, m: F.length(F.replace(F.regexp_replace(text, r"[\x09-\x0D]", " "), F.lit(" "), F.lit(""))),
    "n_symbols": lambda text, m: F.regexp_count(text, F.lit(SYMBOLS)),
    "n_lines": lambda text, m: F.size(m("lines")),
    "n_dup_lines": lambda text, m: _let(m("lines"), lambda x: F.size(x) - F.size(F.array_distinct(x))),
    "n_repeat_words": lambda text, m: repeated_words(m("words")),
    "n_capitals": lambda text, m: F.regexp_count(text, F.lit("[A-Z]")),
    "n_lettered": lambda text, m: F.regexp_count(text, F.lit(rf"(?<!{SOLID})[^\x20\x09-\x0D\p{{L}}]*\p{{L}}")),
    "n_bullets": lambda text, m: F.regexp_count(text, F.lit(r"(?m)^[\x20\x09]*[-*•]")),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A text fails if the condition over its measures is true."""

    name: str
    fails: Callable[[Measures], Column]


RULES = (
    Rule("few_words", lambda m: m("n_words") < MIN_WORDS),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > MAX_REPEATED * m("n_words")),
    Rule("symbols", lambda m: 100 * m("n_symbols") > MAX_SYMBOLS * m("n_words")),
    Rule("short_words", lambda m: m("word_chars") < MIN_MEAN * m("n_words")),
    Rule("long_words", lambda m: m("word_chars") > MAX_MEAN * m("n_words")),
    Rule("capitals", lambda m: 100 * m("n_capitals") > MAX_CAPITALS * m("word_chars")),
    Rule("letterless_words", lambda m: 100 * m("n_lettered") < MIN_LETTERED * m("n_words")),
    Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > MAX_DUP_LINES * m("n_lines")),
    Rule("bullets", lambda m: 100 * m("n_bullets") > MAX_BULLETS * m("n_lines")),
)
BASE_RULES = RULES[:2]


@dataclass(frozen=True)
class Step:
    """A rule's place in the cascade with what the sample says of it."""

    rule: Rule
    seconds: float  # alone over the sample, beyond reading it
    rejected: int  # sampled texts failing it, whatever the other rules say
    newly_rejected: int  # of those, texts that passed the rules before it


def measures_of(text: Column, present: Sequence[str] = ()) -> Measures:
    """Measures by name: a column where ``present`` has it, else an expression of the text."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def measure(name: str) -> Column:
        if name in present:
            return F.col(name)
        found = MEASURES[name](text, measure)
        return found if name in ("words", "lines") else found.cast("long")

    return measure


def _seconds(df: DataFrame, condition: Column) -> float:
    """The shorter of two timed counts; the first one also compiles."""
    def once() -> float:
        start = time.perf_counter()
        df.agg(F.count_if(condition)).collect()
        return time.perf_counter() - start

    return min(once(), once())


def plan(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Step]:
    """The rules in the order of rejections per second on a sample, each among what the ones before let pass."""
    texts = docs.select(F.col(text_col).alias("text"))
    total = texts.count()
    share = min(1.0, sample_rows / total) if total else 1.0
    sample = written(texts.sample(fraction=share, seed=SAMPLE_SEED), "rule-sample")
    measure = measures_of(F.col("text"))
    reading = _seconds(sample, F.octet_length("text") < 0)
    seconds = [max(_seconds(sample, rule.fails(measure)) - reading, LEAST_COST) for rule in rules]
    failed = F.concat(*[F.when(rule.fails(measure), "1").otherwise("0") for rule in rules])
    sets = {row["failed"]: row["n"] for row in sample.groupBy(failed.alias("failed")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 2 ** rules at most

    left, passing, steps = list(range(len(rules))), dict(sets), []
    while left:
        newly = {k: sum(n for s, n in passing.items() if s[k] == "1") for k in left}
        best = max(left, key=lambda k: (newly[k] / seconds[k], -seconds[k]))
        steps.append(Step(rules[best], seconds[best], sum(n for s, n in sets.items() if s[best] == "1"), newly[best]))
        passing = {s: n for s, n in passing.items() if s[best] == "0"}
        left.remove(best)
    return steps


def first_failed(steps: Sequence[Step], measure: Measures) -> Column:
    """Name of the first rule of the cascade that a text fails, else null; later rules are not evaluated."""
    if not steps:
        return F.lit(None).cast("string")
    chain = F
    for step in steps:
        chain = chain.when(step.rule.fails(measure), F.lit(step.rule.name))
    return chain.otherwise(F.lit(None).cast("string"))


def drop_failing(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The rows, with their columns, whose text fails no rule."""
    return docs.where(first_failed(plan(docs, rules, text_col), measures_of(F.col(f"`{text_col}`"))).isNull())


def audit(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the base measures, whether a base rule fails, and the verdict of the cascade."""
    steps = plan(docs, rules, text_col)
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    arrays = texts.select("doc_id", "text", words_of(text).alias("words"), worded_lines(text).alias("lines"))
    measure = measures_of(F.col("text"), ("words", "lines"))
    measured = arrays.select("doc_id", "text", "words", "lines", *[measure(name).alias(name) for name in BASE])
    known = measures_of(F.col("text"), ("words", "lines", *BASE))
    base_failed = F.lit(False)
    for rule in BASE_RULES:
        base_failed = base_failed | rule.fails(known)
    rows = measured.select("doc_id", *BASE, base_failed.alias("base_failed"), first_failed(steps, known).isNull().alias("passed"))
    return rows.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & F.col("passed")).alias("kept"))
