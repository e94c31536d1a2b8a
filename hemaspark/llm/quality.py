"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of, trimmed, words, written

PLAIN = r"""\A[\p{Ps}\p{Pi}"']*+[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}'’.,:/@_+-]*+[\p{Pe}\p{Pf}"'’.,;:!?…]*+\z"""
ENDED = r"""[.!?…。！？]["'’”»)\]]*\z"""
SYMBOLS = r"[#*$%&|<>]"
Vote = Callable[[Column], Column] | None
#: Rules: (value, votes bad where, votes good where). Else a rule abstains; one that looks for a single defect says
#: nothing where the defect is absent, as that hardly speaks for a text.
RULES: dict[str, tuple[str, Vote, Vote]] = {
    "length": ("n_words", lambda v: v < 20, lambda v: v >= 100),
    "symbols": ("n_symbols / nullif(n_words, 0)", lambda v: v > 0.15, None),
    "repeated_lines": ("n_dup_lines / nullif(n_lines, 0)", lambda v: v > 0.4, None),
    "repeated_words": ("n_repeat_words / nullif(n_words, 0)", lambda v: v > 0.4, None),
    "word_length": ("word_chars / nullif(n_words, 0)", lambda v: (v < 2.5) | (v > 12), None),
    "distinct_words": ("n_distinct / sqrt(nullif(n_words, 0))", lambda v: v < 2.5, lambda v: v > 6),
    "sentences": ("n_words / greatest(n_ended, 1)", lambda v: v > 100, lambda v: v < 60),
    "plain_words": ("n_plain / nullif(n_words, 0)", lambda v: v < 0.75, lambda v: v > 0.97),
}
THRESHOLD = 0.5
#: Prior belief: the share of good documents; how often a bad and a good vote are right; the prior's weight as a share of the documents.
PRIOR_GOOD, BAD_RIGHT, GOOD_RIGHT, PRIOR_SHARE = 0.85, 0.95, 0.9, 0.1


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _th, counts) of each whole text, in one pass: see the contract's names, and n_lines (lines with a word),
    n_distinct (different words), n_ended (words that end a sentence), n_plain (words of letters and digits between
    ordinary punctuation).

    Repeated words come from a sort of the text's 3-word windows by XXH64: a window equals its neighbour in that order or
    none. (Two different windows of a text of 100,000 words share a hash with a chance of 3 in ten thousand million.)
    """
    t = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    t = t.select("_id", "_th", "_t", words("_t").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: trimmed(x) != "").alias("_l"))
    n = F.size("_w")
    at = lambda i: F.get(F.col("_w"), i)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("i")))
    t = t.withColumn("_s", F.when(n >= 3, F.sort_array(windows)))
    h = lambda i: F.get(F.col("_s"), i)["h"]
    again = F.filter(F.transform("_s", lambda e, j: F.when((e["h"] == h(j + 1)) | ((j > 0) & (e["h"] == h(F.greatest(j - 1, F.lit(0))))), e["i"])), lambda i: i.isNotNull())
    t = t.withColumn("_p", F.when(n >= 3, F.sort_array(again)))
    cover = F.aggregate(F.transform("_p", lambda i, j: F.least(F.lit(3), F.coalesce(F.get(F.col("_p"), j + 1) - i, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    long = lambda c: c.cast("long")
    return t.select(
        "_id", "_th", long(n).alias("n_words"), long(F.length(F.array_join("_w", ""))).alias("word_chars"), long(F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"), long(F.coalesce(cover, F.lit(0))).alias("n_repeat_words"), long(F.size("_l")).alias("n_lines"),
        long(F.size(F.array_distinct("_w"))).alias("n_distinct"), long(F.size(F.filter("_w", lambda w: w.rlike(ENDED)))).alias("n_ended"), long(F.size(F.filter("_w", lambda w: w.rlike(PLAIN)))).alias("n_plain"),
    )


def votes(rules: dict[str, tuple[str, Vote, Vote]] = RULES) -> dict[str, Column]:
    """Each rule's vote: -1 bad, 1 good, 0 abstains (also where its value is null)."""
    never = lambda v: F.lit(False)
    return {name: F.when((bad or never)(F.expr(value)), -1).when((good or never)(F.expr(value)), 1).otherwise(0) for name, (value, bad, good) in rules.items()}


def fit(patterns: list[tuple[tuple[int, ...], int]], share: float = PRIOR_SHARE, rounds: int = 100) -> dict:
    """Expectation-maximisation over vote patterns with counts: {"prior": P(good), "rules": [{vote: (P(vote|good), P(vote|bad))}]}.

    Dawid and Skene's model with abstentions as a third outcome. A rule's outcome rates have a prior of `share` of all
    documents: its own rates of voting, of which BAD_RIGHT and GOOD_RIGHT are right, so that classes can't change places
    and a rule that votes rarely still counts. At most 3 to the power of the number of rules patterns come here, whatever
    the input.
    """
    total = sum(n for _, n in patterns) or 1
    m = len(patterns[0][0]) if patterns else 0
    first = []
    for j in range(m):
        bad, good = (sum(n for v, n in patterns if v[j] == g) / total for g in (-1, 1))
        # votes of either class as if the rule were right so often; what is left abstains
        sides = []
        for is_good, size in ((True, PRIOR_GOOD), (False, 1 - PRIOR_GOOD)):
            b = bad * ((1 - BAD_RIGHT) if is_good else BAD_RIGHT) / size
            g = good * (GOOD_RIGHT if is_good else 1 - GOOD_RIGHT) / size
            scale = 0.98 / max(0.98, b + g)
            sides.append({-1: b * scale, 1: g * scale, 0: 1 - (b + g) * scale})
        first += sides
    tables, prior, strength = [(first[2 * j], first[2 * j + 1]) for j in range(m)], PRIOR_GOOD, share * total
    floor = 1e-4
    last = None
    for _ in range(rounds):
        good = []
        for v, _ in patterns:
            score = math.log(prior / (1 - prior)) + sum(math.log(max(tables[j][0][x], floor) / max(tables[j][1][x], floor)) for j, x in enumerate(v))
            good.append(1 / (1 + math.exp(-max(-60.0, min(60.0, score)))))
        weight = [sum(n * p for (_, n), p in zip(patterns, good, strict=True)), sum(n * (1 - p) for (_, n), p in zip(patterns, good, strict=True))]
        prior = min(0.99, max(0.01, (weight[0] + PRIOR_GOOD * strength) / (total + strength)))
        new = []
        for j in range(m):
            sides = []
            for y, share_of in ((0, lambda p: p), (1, lambda p: 1 - p)):
                seen = dict.fromkeys((-1, 0, 1), 0.0)
                for (v, n), p in zip(patterns, good, strict=True):
                    seen[v[j]] += n * share_of(p)
                sides.append({g: (seen[g] + strength * first[2 * j + y][g]) / (weight[y] + strength) for g in seen})
            new.append(tuple(sides))
        tables = new
        state = [prior, *(x for pair in tables for side in pair for x in side.values())]
        if last and max(abs(a - b) for a, b in zip(state, last, strict=True)) < 1e-9:
            break
        last = state
    return {"prior": prior, "rules": [{g: (max(a[g], floor), max(b[g], floor)) for g in (-1, 0, 1)} for a, b in tables]}


def posterior(model: dict, names: list[str]) -> Column:
    """P(good | votes) as a column over the vote columns: a sum of log ratios, so no lookup table is joined."""
    score = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for name, table in zip(names, model["rules"], strict=False):  # no rules were fitted to no rows
        ratio = {g: math.log(a / b) for g, (a, b) in table.items()}
        score = score + F.when(F.col(name) == -1, ratio[-1]).when(F.col(name) == 1, ratio[1]).otherwise(ratio[0])
    return 1 / (1 + F.exp(-score))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, tuple[str, Vote, Vote]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: id_col, _th (xxhash64 of the text), counts, vote_<rule>, posterior, base_failed, kept.

    kept is false where base_failed (under 50 words, or over half of the words in repeated 3-word windows), else
    posterior >= threshold. Votes of all documents are counted by pattern (at most 3 ** rules rows reach the driver) and
    fit there. Texts are read once; their counts are written. Null and empty texts have no words and fail the base rule;
    null and repeated ids are judged row by row; an empty table gives an empty result; other columns are ignored.
    """
    names = [f"vote_{k}" for k in rules]
    table = written(features(docs, id_col, text_col), "quality").withColumns(dict(zip(names, votes(rules).values(), strict=True)))
    patterns = [(tuple(r[n] for n in names), r["count"]) for r in table.groupBy(*names).count().collect()]
    out = table.withColumn("posterior", posterior(fit(patterns), names)).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)).withColumnRenamed("_id", id_col)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose verdict is kept, all columns, whatever their names, as they were (see judged); repeated rows stay or go together, ids may be null."""
    good = judged(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("_id"), "_th").dropDuplicates()
    return rows_of(docs, id_col, text_col).join(good, F.expr("id <=> _id and th = _th"), "left_semi").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all documents, production parameters."""
    rows = judged(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
