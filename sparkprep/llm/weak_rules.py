"""Quality rules as weak supervision.

Each rule reads a document's statistics and votes good (1), bad (-1) or abstains (0).
Votes are counted by pattern, at most ``3 ** rules`` rows however large the corpus;
expectation-maximisation over these patterns estimates how often each rule votes
each way on good and on bad documents, and a document's posterior probability of
being good replaces the demand that all rules pass.

Statistics come from one pass over whole texts within each row: no exchange, so a
hot source or a very long text moves nothing. Everything is DataFrame functions; the
driver sees the estimates only.

A null, empty or blank text has all statistics 0. Repeated rows are scored alike. An
empty table gives an empty result. Extra columns are ignored but for the id. A posterior of
exactly one half counts as good. A text may be as long as a row can hold; windows are
known by 64-bit digests and all their positions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.llm import common as c

#: Characters that count as symbols; fixed by the contract of the statistic.
SYMBOLS = "#*$%&|<>"


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 5) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_shouts, n_lines, n_distinct_words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.trim(line, F.lit(c.BLANKS)) != "")
    rows = rows.withColumns({"words": F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+", -1), ""), "lines": lines})

    def found(pattern: str) -> Column:
        return F.regexp_count("text", F.lit(pattern)).cast("long")

    rows = rows.select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        found(f"[{SYMBOLS}]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        found("[A-Z]").alias("n_capitals"),
        found("[!?]").alias("n_shouts"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("codes"),
    )
    at = F.when(F.size("codes") >= window, F.sequence(F.lit(1), F.size("codes") - (window - 1))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("grams", F.transform(at, lambda i: F.xxhash64(F.slice("codes", i, window)))).drop("codes")
    # texts in which every window is found once, most of them, need no order
    repeated = F.size(F.array_distinct("grams")) < F.size("grams")
    rows = rows.withColumn("ordered", F.when(repeated, F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))).drop("grams")

    def gram(i: Column) -> Column:
        return F.get("ordered", i)["g"]

    # in order of (window, position) equal windows are neighbours: then both repeat
    repeats = F.filter("ordered", lambda p, i: F.coalesce(gram(i - 1) == p["g"], F.lit(False)) | F.coalesce(gram(i + 1) == p["g"], F.lit(False)))
    rows = rows.withColumn("starts", F.sort_array(F.transform(repeats, lambda p: p["i"]))).drop("ordered")
    covered = F.aggregate(F.transform("starts", lambda s, i: F.least(F.lit(window), F.coalesce(F.get("starts", i + 1) - s, F.lit(window)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("starts")


def default_rules() -> dict[str, Column]:
    """name -> vote. Between its two limits a rule abstains."""
    words = F.greatest(F.col("n_words"), F.lit(1))

    def above(x: Column, bad: float, good: float) -> Column:
        """Low is good."""
        return F.when(x > bad, -1).when(x < good, 1).otherwise(0)

    mean_length = F.col("word_chars") / words
    return {
        "symbols": above(F.col("n_symbols") / words, 0.10, 0.02),
        "symbol_share": above(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)), 0.04, 0.01),
        "shouts": above(F.col("n_shouts") / words, 0.30, 0.05),
        "repeats": above(F.col("n_repeat_words") / words, 0.20, 0.05),
        "lines": above(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), 0.30, 0.05),
        "capitals": above(F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)), 0.25, 0.08),
        "word_length": F.when((mean_length < 2.5) | (mean_length > 12), -1).when((mean_length > 3.5) & (mean_length < 9), 1).otherwise(0),
        "length": F.when(F.col("n_words") < 10, -1).when(F.col("n_words") >= 50, 1).otherwise(0),
        "variety": F.when(F.col("n_words") < 30, 0).when(F.col("n_distinct_words") / words < 0.2, -1).when(F.col("n_distinct_words") / words > 0.35, 1).otherwise(0),
    }


#: Fixed starting beliefs, (class, vote) -> probability of the vote where the rule votes: a bad vote is rare on good documents, and most rules see nothing wrong in most bad documents.
START = {(1, 1): 0.99, (1, -1): 0.01, (-1, 1): 0.75, (-1, -1): 0.25}


def fit_votes(patterns: DataFrame, rules: list[str], rounds: int = 12, prior: float = 0.8, start: dict[tuple[int, int], float] = START, smooth: float = 1.0) -> tuple[float, dict[str, dict[tuple[int, int], float]]]:
    """(share of good documents, rule -> (class, vote) -> probability of the vote in the class where the rule votes), from (rules..., n).

    ``start`` decides which of the two classes is called good. An abstention is no evidence either way.
    """
    table = {r: dict(start) for r in rules}
    for _ in range(rounds):
        post = posterior(prior, table)
        sums = [F.sum("n").alias("n"), F.sum(F.col("n") * post).alias("good")]
        for r in rules:
            for v in (1, -1):
                hit = F.when(F.col(r) == v, F.col("n")).otherwise(0)
                sums += [F.sum(hit * post).alias(f"{r}_{v}_g"), F.sum(hit).alias(f"{r}_{v}_a")]
        e = patterns.agg(*sums).first()  # one row of 4 numbers a rule
        if not e["n"]:
            break
        prior = min(0.999, max(0.001, e["good"] / e["n"]))
        for r in rules:
            good = {v: e[f"{r}_{v}_g"] + smooth * start[1, v] for v in (1, -1)}
            bad = {v: e[f"{r}_{v}_a"] - e[f"{r}_{v}_g"] + smooth * start[-1, v] for v in (1, -1)}
            table[r] = {(1, v): x / sum(good.values()) for v, x in good.items()} | {(-1, v): x / sum(bad.values()) for v, x in bad.items()}
    return prior, table


def posterior(prior: float, table: dict[str, dict[tuple[int, int], float]]) -> Column:
    """Probability that a row with these votes is good."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for r, t in table.items():
        odds = odds + F.when(F.col(r) == 1, math.log(t[1, 1] / t[-1, 1])).when(F.col(r) == -1, math.log(t[1, -1] / t[-1, -1])).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def weak_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Column] | None = None, rounds: int = 12) -> DataFrame:
    """(id, statistics, votes, posterior)."""
    rules = default_rules() if rules is None else rules
    stats = c.durable(statistics(docs, id_col, text_col))
    voted = stats.withColumns(rules)
    patterns = c.durable(voted.groupBy(*rules).agg(F.count(F.lit(1)).alias("n")))
    prior, table = fit_votes(patterns, list(rules), rounds)
    return voted.withColumn("posterior", posterior(prior, table)).withColumnRenamed("id", id_col)


def op8_weak_rules(spark, sf_dir: str) -> DataFrame:
    out = weak_quality(c.read(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(*base, failed.alias("base_failed"), (~failed & (F.col("posterior") >= 0.5)).alias("kept"), "posterior")
