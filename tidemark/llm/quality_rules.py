"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects a text whose statistic exceeds a cutoff. LEVELS are cutoffs of all rules together, from the loosest to the
strictest. A level is used in a stratum (a language) only if labelled good documents of that stratum prove, by an exact binomial
bound, that its rules together falsely reject at most `alpha` of them. The levels are tested in their order and
testing stops at the first that fails (fixed-sequence testing needs no correction along the sequence); across strata the error `delta` is
divided by their number (Bonferroni). So with probability 1 - delta no stratum loses more than alpha of its good documents
to the rules, all of them taken together. That takes ln(delta / strata) / ln(1 - alpha) good documents of a stratum at least (436 for
four strata); a stratum with fewer proves nothing, and only the base applies there.

Defined cases: a null or empty text has no words, all counts are 0 and it fails the base. A null language is the
stratum ''. Labels of one doc_id that
contradict each other count as not good. Repeated rows and ties are judged row by row, alike. Columns of the input
other than those named are left alone, whatever their names; `word_stats` puts its columns in place of any that are called alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import kept, let, small, staged

WORD = r"[^\x20\x09-\x0D]+"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rule: (statistic per word as SQL, its cutoff at each level).
RULES = {
    "symbols": ("n_symbols / n_words", [3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2]),
    "repeats": ("n_repeat_words / n_words", [0.45, 0.45, 0.4, 0.4, 0.35, 0.35, 0.3, 0.3]),
    "dup_lines": ("n_dup_lines / n_words", [0.2, 0.2, 0.1, 0.1, 0.05, 0.05, 0.03, 0.03]),
    "long_words": ("word_chars / n_words", [40.0, 40.0, 30.0, 30.0, 20.0, 20.0, 15.0, 12.0]),
}
LEVELS = list(zip(*(cuts for _, cuts in RULES.values()), strict=True))
ALPHA, DELTA, MIN_WORDS = 0.01, 0.05, 50


def _repeated(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more among `words`."""
    windows = lambda w: F.when(
        F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(
            s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        )
        spread = lambda d: F.size(F.array_distinct(F.flatten(F.transform(d, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, lambda s: let(twice(s), spread)))

    return let(windows(words), covered)


def word_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the columns STATS (long) of the whole text at its end, in place of columns of these names."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = lambda: F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stats = let(
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w).cast("long").alias("n_repeat_words")),
    )
    dup = let(lines(), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    sym = F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long")
    got = docs.withColumns({"__s": stats, "n_symbols": sym, "n_dup_lines": dup})
    return got.select(*[c for c in docs.columns if c not in STATS], F.col("__s.n_words"), F.col("__s.word_chars"), "n_symbols", "n_dup_lines", F.col("__s.n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exact: terms follow from one another in logarithms; 1 where k exceeds the mean n p."""
    ratio = F.log(F.lit(p / (1 - p)))
    step = lambda s, i: F.struct(
        (s["t"] + F.log((n - i).cast("double") / (i + 1)) + ratio).alias("t"), (s["sum"] + F.exp(s["t"])).alias("sum")
    )
    start = F.struct((n * F.log(F.lit(1 - p))).alias("t"), F.lit(0.0).alias("sum"))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, step, lambda s: s["sum"])))


def rejected(cuts: Sequence[float | str]) -> Column:
    """Whether any rule rejects at its cutoff, a number or a column; where there is none, a rule rejects nothing."""
    ratios = [sql.replace("/ n_words", "/ nullif(n_words, 0)") for sql, _ in RULES.values()]
    return F.expr(" or ".join(f"coalesce({x} > {c}, false)" for x, c in zip(ratios, cuts, strict=True)))


def calibrate(stats: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, level, cut_<rule>...): the strictest proven level of each stratum that has one.

    `stats` has doc_id, the stratum and STATS; the labelled documents that pass the base are the holdout. Counts are
    conditional sums, combined before the shuffle, so that one language may hold any share of the rows.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    held = stats.where(~base_failed()).join(good, "doc_id").select(F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), *STATS)
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(rejected([f"{c}D" for c in cuts])).alias(f"k{i}") for i, cuts in enumerate(LEVELS)])
    named = lambda cuts: [F.lit(c).alias(f"cut_{r}") for r, c in zip(RULES, cuts, strict=True)]
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"k{i}").alias("k"), *named(cuts)) for i, cuts in enumerate(LEVELS)])
    rows = counts.withColumn("x", F.explode(levels)).select("stratum", "n", "x.*")
    many = counts.agg(F.count("*").alias("m"))
    proven = rows.crossJoin(F.broadcast(many)).withColumn("ok", binomial_tail(F.col("n"), F.col("k"), alpha) <= delta / F.col("m"))
    stops = proven.groupBy("stratum").agg(F.min(F.when(~F.col("ok"), F.col("level"))).alias("stop"))
    found = proven.join(stops, "stratum").where("ok and (stop is null or level < stop)")
    names = ["level", *(f"cut_{r}" for r in RULES)]
    return found.groupBy("stratum").agg(F.max(F.struct(*names)).alias("x")).select("stratum", "x.*")


def verdicts(stats: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """`stats` with base_failed and kept. The cutoffs have a row a stratum and are broadcast if they are few."""
    cuts = small(staged(cutoffs, "cutoffs")).withColumnRenamed("stratum", "__of")
    got = stats.withColumn("__stratum", F.coalesce(F.col(stratum), F.lit(""))).join(cuts, F.col("__stratum") == F.col("__of"), "left")
    return got.select(*stats.columns, base_failed().alias("base_failed"), (~base_failed() & ~rejected([f"cut_{r}" for r in RULES])).alias("kept"))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, STATS, base_failed and kept, a row for each row of `docs`."""
    stats = kept(word_stats(docs.select("doc_id", "lang", "text")).drop("text"))
    return verdicts(stats, calibrate(stats, labels)).select("doc_id", *STATS, "base_failed", "kept")


def filter_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, with their own columns. Statistics of labelled documents are found first."""
    ids = small(labels.select("doc_id").where("doc_id is not null").distinct())
    labelled = word_stats(docs.select("doc_id", "lang", "text").join(ids, "doc_id", "left_semi")).drop("text")
    cutoffs = calibrate(labelled, labels)
    names = docs.columns
    place = {c: f"c{i}" for i, c in enumerate(names)}
    plain = docs.toDF(*place.values())  # names that no column of ours has
    kept_rows = verdicts(word_stats(plain, place["text"]), cutoffs, place["lang"]).where("kept")
    return kept_rows.select(*[F.col(place[c]).alias(c) for c in names])
