"""Quality rules combined by weak supervision, in DataFrame functions only.

Every rule looks at one statistic of the text and votes good, votes bad or abstains. Which votes mean how much is not
set by hand: expectation-maximisation over the vote patterns estimates each rule's accuracy from its agreement with the
others, and a document is kept if its posterior probability of being good is a half or more. EM looks at the documents
that pass the base rules: those that fail them are decided already.

What EM needs is the number of rows with each vote pattern: at most 3 ** len(RULES) counts whatever the corpus size,
summed before the shuffle over all rows. EM itself is one SQL expression over that array. Statistics are made once and
written with the columns asked for.

Good and bad are held to be equally likely beforehand (``PRIOR`` is fixed, not estimated: with few votes a document, EM
would move it to one side). So a document on which all rules abstain has a posterior of one half, and is kept: nothing
speaks against it.

Repeated three-word windows are found inside the row: window hashes (64 bits, compared only within one text) are
sorted, neighbours that are equal are repeats. No row leaves its partition for that.

Defined results: null and empty texts have no words, are failed by the base rules and not kept; repeated rows are
judged alike; an empty table gives an empty result; input columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import ASCII_SPACES, cut_lineage, let, text_column

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
EM_ROUNDS = 40
#: A rule's accuracy before any row is seen, and the number of rows that this counts for.
START, PSEUDO = 0.8, 2.0
#: The probability of good before any vote; the odds below begin with it.
PRIOR = 0.5

#: name -> (what it looks at, what makes it vote: 0 bad, 2 good; it abstains otherwise).
RULES: dict[str, tuple[str, int]] = {
    "symbols": ("n_symbols >= 0.10D * n_words", 0),
    "duplicate_lines": ("n_dup_lines >= 0.20D * n_lines", 0),
    "repeats": ("n_repeat_words >= 0.40D * n_words", 0),
    "capitals": ("n_capitals >= 0.30D * word_chars", 0),
    "exclamations": ("n_exclamations >= 0.20D * n_words", 0),
    "digits": ("n_digits >= 0.20D * word_chars", 0),
    "long_words": ("word_chars >= 16D * n_words", 0),
    "short_words": ("word_chars <= 2D * n_words", 0),
    "plain_prose": ("n_symbols <= 0.02D * n_words AND n_capitals <= 0.12D * word_chars AND n_exclamations <= 0.05D * n_words AND n_digits <= 0.05D * word_chars", 2),
    "usual_words": ("n_symbols <= 0.05D * n_words AND word_chars BETWEEN 3 * n_words AND 10 * n_words AND n_repeat_words <= 0.20D * n_words", 2),
}
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _less(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def words_of(text: Column) -> Column:
    flat = F.btrim(F.translate(text, ASCII_SPACES, " " * len(ASCII_SPACES)))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " +"))


def _repeat_words(words: Column) -> Column:
    """Number of words that lie in a three-word window which the text has twice or more."""

    def covered(starts: Column) -> Column:
        steps = F.zip_with(starts, F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.when(b.isNull(), 3).otherwise(F.least(b - a, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def starts(hashes: Column) -> Column:
        placed = F.sort_array(F.zip_with(hashes, F.sequence(F.lit(1), F.size(hashes)), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def pairs(p: Column) -> Column:
            both = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
            return F.sort_array(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))

        return let(placed, pairs)

    def has_repeat(hashes: Column) -> Column:
        return F.size(F.array_distinct(hashes)) < F.size(hashes)

    def from_hashes(hashes: Column) -> Column:
        return F.when(has_repeat(hashes), let(starts(hashes), covered)).otherwise(0)

    def from_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))
        return F.when(F.size(w) >= 4, let(hashes, from_hashes)).otherwise(0)

    return let(words, from_words)


def text_features(text: Column) -> Column:
    """A struct of all statistics that the base and the rules use."""
    t = F.coalesce(text, F.lit(""))

    def with_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words"))

    def with_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    def all_of(w: Column, lines: Column) -> Column:
        return F.struct(
            w["n_words"].alias("n_words"),
            _less(t, ASCII_SPACES).cast("long").alias("word_chars"),
            (F.length(t) - _less(t, SYMBOLS)).cast("long").alias("n_symbols"),
            lines["n_dup_lines"].alias("n_dup_lines"),
            w["n_repeat_words"].alias("n_repeat_words"),
            lines["n_lines"].alias("n_lines"),
            (F.length(t) - _less(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_capitals"),
            (F.length(t) - _less(t, "!")).cast("long").alias("n_exclamations"),
            (F.length(t) - _less(t, "0123456789")).cast("long").alias("n_digits"),
        )

    lines = F.filter(F.split(t, "\n"), lambda x: _less(x, ASCII_SPACES) > 0)
    return let(let(words_of(t), with_words), lambda w: let(let(lines, with_lines), lambda n: all_of(w, n)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def votes(rules: dict[str, tuple[str, int]]) -> Column:
    """One array element per rule: 2 good, 1 abstains, 0 bad. Texts without words: all abstain."""
    return F.array(*[F.expr(f"IF(n_words > 0 AND ({when}), {vote}, 1)") for when, vote in rules.values()])


def estimate(patterns: DataFrame, n_rules: int, rounds: int = EM_ROUNDS) -> list[float]:
    """EM over (v, n) rows, one per vote pattern, as one SQL expression: each rule's accuracy when it votes.

    Both classes are alike beforehand, an abstention says nothing, a vote of a rule with accuracy a multiplies the odds
    of the class voted for by a / (1 - a). E: the posterior of each pattern; M: a rule's accuracy is the mean posterior
    of the class it voted for, over the rows on which it voted.
    """
    k = n_rules - 1
    odds = f"aggregate(sequence(0, {k}), 0D, (s, j) -> s + (p.v[j] - 1) * ln(a[j] / (1D - a[j])))"
    e_step = f"transform(hist, p -> struct(p.v AS v, p.n AS n, 1D / (1D + exp(-({odds}))) AS g))"
    hits = "aggregate(post, 0D, (s, p) -> s + p.n * CASE p.v[j] WHEN 2 THEN p.g WHEN 0 THEN 1D - p.g ELSE 0D END)"
    cast = "aggregate(post, 0D, (s, p) -> s + IF(p.v[j] = 1, 0D, p.n))"
    m_step = f"transform(array({e_step}), post -> transform(sequence(0, {k}), j -> ({hits} + {START * PSEUDO}D) / ({cast} + {PSEUDO}D)))[0]"
    start = f"transform(sequence(0, {k}), j -> {START}D)"
    gathered = patterns.agg(F.array_sort(F.collect_list(F.struct("v", F.col("n").cast("double").alias("n")))).alias("hist"))
    return gathered.select(F.expr(f"aggregate(sequence(1, {rounds}), {start}, (a, i) -> {m_step})").alias("a")).first()["a"]


def judge_quality(docs: DataFrame, *, text_col: str = "text", keep: Sequence[str] | None = None, rules: dict[str, tuple[str, int]] | None = None, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """Rows of ``docs`` with the statistics, base_failed, quality (posterior of good) and kept.

    ``keep`` names the input columns to carry (all by default). ``cut`` writes the statistics with them: who carries texts
    gives one that compresses them.
    """
    rules = RULES if rules is None else rules
    kept = list(docs.columns if keep is None else keep)
    made = [*FEATURES, "base_failed", "quality", "kept"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), text_features(text_column(docs, text_col)).alias("f"))
    rows = cut(rows.select("row", *[F.col("f").getField(c).alias(c) for c in [*FEATURES, "n_lines", "n_capitals", "n_exclamations", "n_digits"]]).withColumn("v", votes(rules)))
    accuracy = estimate(rows.filter(~base_failed()).groupBy("v").agg(F.count("*").alias("n")), len(rules))

    odds = sum(((F.element_at("v", j + 1) - 1) * F.lit(log(a / (1 - a))) for j, a in enumerate(accuracy)), F.lit(log(PRIOR / (1 - PRIOR))))
    judged = rows.withColumn("base_failed", base_failed()).withColumn("quality", 1 / (1 + F.exp(-odds)))
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
    return judged.select(*[F.col("row").getField(c).alias(c) for c in kept if c not in made], *made)
