"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

A rule compares two counts of a text by whole numbers: low/100 <= numerator/denominator <= high/100. All counts come from
built-in string, regular-expression and array functions, so the whole operator is one narrow JVM projection without a shuffle.

Defined results: null text counts as no words, symbols or lines and fails the length rule. Whitespace-only lines are not
lines. Texts of any length are read whole: repeated windows are found by sorting hashes of the windows, not by comparing pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import WORD_RE

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages served; a parameter of quality().
STOP_WORDS = (
    "the of and to in is that it for on with as was be by this are from or at an not have a",
    "le la les de des du et un une en que qui dans pour sur par au est pas avec",
    "der die das und von zu den mit ist ein eine im auf dem nicht auch für als",
    "el los las del y que en un una por con para se no su al es como",
)


@dataclass(frozen=True)
class Rule:
    """low/100 <= numerator/denominator <= high/100; a missing bound is open, a zero denominator passes."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None

    def passes(self, counts: dict[str, Column]) -> Column:
        num, den = counts[self.numerator] * 100, counts[self.denominator]
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (num >= den * self.low)
        if self.high is not None:
            ok = ok & (num <= den * self.high)
        return ok


RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("exclamations", "n_exclamations", "n_words", high=30),
    Rule("capitals", "n_capitals", "word_chars", high=40),
    Rule("stop_words", "n_stop_words", "n_words", low=3),
    Rule("dup_lines", "n_dup_lines", "n_lines", high=45),
)


def _bind(value: Column, use) -> Column:
    """use(value) with value evaluated once for each row: a lambda variable instead of a copied expression."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column, window: int) -> Column:
    """Words that lie in a window of `window` words found twice or more in the text."""

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[w[i + j] for j in range(window)]))
        return _bind(hashes, of_hashes)

    def of_hashes(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bind(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted))

    def of_sorted(s: Column) -> Column:
        same = lambda x, at: F.coalesce(F.get(s, at)["h"] == x["h"], F.lit(False))
        hits = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return _bind(F.array_sort(F.transform(hits, lambda x: x["i"])), covered)

    def covered(p: Column) -> Column:
        # each window adds what reaches beyond the one before it
        added = lambda x, k: F.when(k == 0, F.lit(window)).otherwise(F.least(F.lit(window), x - F.get(p, k - 1)))
        return F.aggregate(F.transform(p, added), F.lit(0), lambda acc, x: acc + x)

    return F.when(F.size(words) < window + 1, F.lit(0)).otherwise(_bind(words, of_words))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text: str = "text", stop_words: tuple[str, ...] = STOP_WORDS, min_words: int = 50, max_repeat: int = 50, window: int = 3) -> DataFrame:
    """docs with the counts, one boolean pass_<rule> for each rule, base_failed and kept. Existing columns of these names are replaced."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    without = lambda t, chars: F.translate(t, chars, "")
    count_of = lambda chars: (F.length(body) - F.length(without(body, chars))).cast("long")
    lists = sorted({w for line in stop_words for w in line.split()})
    temp = "__weft_words"
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.length(without(x, SPACES)) > 0)
    out = docs.withColumn(temp, F.regexp_extract_all(body, F.lit(WORD_RE), F.lit(0)))
    counts = {
        "n_words": F.size(temp).cast("long"),
        "word_chars": F.length(without(body, SPACES)).cast("long"),
        "n_symbols": count_of(SYMBOLS),
        "n_exclamations": count_of("!"),
        "n_capitals": F.length(F.regexp_replace(body, r"[^\p{Lu}]+", "")).cast("long"),
        "n_stop_words": F.size(F.filter(F.col(temp), lambda w: w.isin(lists))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(F.col(temp), window).cast("long"),
    }
    out = out.withColumns(counts).drop(temp)
    have = {c: F.col(c) for c in counts}
    failed = (have["n_words"] < min_words) | (have["n_repeat_words"] * 100 > have["n_words"] * max_repeat)
    out = out.withColumns({f"pass_{r.name}": r.passes(have) for r in rules} | {"base_failed": failed})
    verdict = ~F.col("base_failed")
    for r in rules:
        verdict = verdict & F.col(f"pass_{r.name}")
    return out.withColumn("kept", verdict)


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def quality_sql(rules: tuple[Rule, ...] = RULES, stop_words: tuple[str, ...] = STOP_WORDS) -> str:
    lists = sorted({w for line in stop_words for w in line.split()})
    checks = []
    for r in rules:
        if r.low is not None:
            checks.append(f"100 * {r.numerator} >= {r.low} * {r.denominator}")
        if r.high is not None:
            checks.append(f"100 * {r.numerator} <= {r.high} * {r.denominator}")
    return rf"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM b),
p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclamations,
        length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals, len(list_filter(w, lambda x: list_contains({_sql_list(lists)}, x))) AS n_stop_words,
        len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(checks)} AS kept
FROM f
"""
