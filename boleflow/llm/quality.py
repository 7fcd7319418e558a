"""Quality rules as weak supervision, in DataFrame and SQL functions only.

Each rule votes good (1), bad (0) or abstains (-1). Expectation-maximisation over the
distinct vote patterns (at most 3^8 rows, whatever the corpus) estimates the accuracies of
every rule among good and among bad documents, and the share of good ones; the posterior
probability of good quality decides, not a conjunction of thresholds. One bad vote of a
rule that errs among good documents is outvoted; bad votes that go together are not.

Defined cases: null text counts as empty, which has no word and fails the base rules.
Repeated rows are judged one by one and alike. An empty table gives an empty result with
the initial model. Columns of the input that clash with a produced name are not read:
only the id and the text column are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialise, text_or_empty

SYMBOLS = "#*$%&|<>"
ENDS = ".!?"
WINDOW = 8
MIN_WORDS = 20
RULES = ("length", "word_length", "symbols", "lines", "repeats", "sentences", "digits", "marks")
EM_ROUNDS = 30

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ends", "n_digits")


def _marks(chars: str) -> Column:
    """How many of the kept marks (column m) are among chars."""
    return (F.length("m") - F.length(F.translate("m", chars, ""))).cast("long")


def text_stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep and the counts that the rules read, one row a document, without a shuffle.

    Repeated 8-word windows are found by sorting 64-bit hashes inside the row, and only
    in rows where the distinct hashes are fewer than the hashes.
    """
    own = F.struct(*keep, F.lit(0).alias("__")).alias("own")
    d = docs.select(own, text_or_empty(text_col).alias("t"))
    d = d.select("own", "t", F.filter(F.split("t", SPACE), lambda w: w != "").alias("w"))
    marks = "".join("\\" + c for c in SYMBOLS + ENDS)
    h = F.transform("w", lambda w: F.xxhash64(w))
    d = d.select(
        "own",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_replace("t", f"[^{marks}0-9]+", "").alias("m"),
        h.alias("h"),
    )
    for step in (1, 2, 4):  # hashes of 2, 4, then 8 words from each word on
        d = d.withColumn("h", F.expr(f"transform(h, (x, i) -> xxhash64(x, get(h, i + {step})))"))
    d = d.select(
        "own",
        "n_words",
        "word_chars",
        _marks(SYMBOLS).alias("n_symbols"),
        _marks(ENDS).alias("n_ends"),
        _marks("0123456789").alias("n_digits"),
        "lines",
        F.slice("h", F.lit(1), F.greatest(F.size("h") - (WINDOW - 1), F.lit(0))).alias("win"),
    )
    d = d.withColumns(
        {
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "win": F.when(F.size(F.array_distinct("win")) < F.size("win"), F.col("win")),
        }
    ).drop("lines")
    pairs = F.array_sort(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("pairs", F.when(F.col("win").isNotNull(), pairs)).drop("win")
    twice = F.filter(
        "pairs",
        lambda s, k: (F.get("pairs", k + 1)["h"] == s["h"]) | ((k > 0) & (F.get("pairs", k - 1)["h"] == s["h"])),
    )
    d = d.withColumn("starts", F.array_sort(F.transform(twice, lambda s: s["i"]))).drop("pairs")
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")),
    )["n"]
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return d.select(*[F.col(f"own.`{c}`").alias(c) for c in keep], *STATS)


def votes() -> Column:
    """One vote for each of RULES: 1 good, 0 bad, -1 abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    per_word = F.col("word_chars") / n
    marks = (F.col("n_symbols") + F.col("n_ends") + F.col("n_digits")) / F.greatest(F.col("word_chars"), F.lit(1))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, 0).when(good, 1).otherwise(-1)

    return F.array(
        vote(F.col("n_words").between(40, 100_000), F.col("n_words") < MIN_WORDS),
        vote(per_word.between(3, 9), (per_word < 2) | (per_word > 14)),
        vote(F.col("n_symbols") <= 0.02 * n, F.col("n_symbols") > 0.1 * n),
        vote((F.col("n_lines") > 1) & (F.col("n_dup_lines") == 0), 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        vote(F.col("n_repeat_words") == 0, 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        vote((F.col("n_ends") / n).between(0.02, 0.4), (F.col("n_ends") == 0) | (F.col("n_ends") > 0.8 * n)),
        vote(F.col("n_digits") <= 0.05 * F.col("word_chars"), F.col("n_digits") > 0.25 * F.col("word_chars")),
        vote(marks <= 0.04, marks > 0.08),
    )


_J = len(RULES)
#: Pseudo-counts of good and bad votes, by class (0 good, 1 bad): a good document's votes are
#: thought mostly right, of a bad one's nothing is presumed. Weak: as much as two documents.
PRIOR = ((1.8, 0.2), (1.0, 1.0))
_E_STEP = f"""transform(pats, p -> transform(array(transform(sequence(0, 1), c -> m.pi[c] *
    aggregate(sequence(0, {_J - 1}), 1D, (s, j) -> s * CASE p.v[j] WHEN 1 THEN m.g[c * {_J} + j] WHEN 0 THEN 1D - m.g[c * {_J} + j] ELSE 1D END))),
    w -> named_struct('v', p.v, 'n', p.n, 'q', transform(w, x -> x / (w[0] + w[1]))))[0])"""
_M_STEP = f"""named_struct(
  'pi', transform(sequence(0, 1), c -> (aggregate(e, 0D, (s, x) -> s + x.n * x.q[c]) + CASE c WHEN 0 THEN 8D ELSE 2D END) / (aggregate(e, 0D, (s, x) -> s + x.n) + 10D)),
  'g', transform(sequence(0, {2 * _J - 1}), k ->
      (aggregate(e, 0D, (s, x) -> s + CASE WHEN x.v[k % {_J}] = 1 THEN x.n * x.q[k div {_J}] ELSE 0D END) + CASE k div {_J} WHEN 0 THEN {PRIOR[0][0]}D ELSE {PRIOR[1][0]}D END) /
      (aggregate(e, 0D, (s, x) -> s + CASE WHEN x.v[k % {_J}] >= 0 THEN x.n * x.q[k div {_J}] ELSE 0D END) + CASE k div {_J} WHEN 0 THEN {sum(PRIOR[0])}D ELSE {sum(PRIOR[1])}D END)))"""
_START = f"""named_struct('pi', array(0.8D, 0.2D), 'g', transform(sequence(0, {2 * _J - 1}), k -> CASE k div {_J} WHEN 0 THEN 0.95D ELSE 0.5D END))"""


def fit(voted: DataFrame, rounds: int = EM_ROUNDS) -> dict:
    """Expectation-maximisation in one SQL expression over the pattern counts.

    voted has the column v. Two classes, good and bad, and a free accuracy of every rule
    in either. Returns pi (shares of the classes) and g (a rule's chance of voting good
    in a class, given that it votes; by class, then rule).
    """
    pats = voted.groupBy("v").agg(F.count("*").cast("double").alias("n"))
    one = pats.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("pats"))
    step = f"aggregate(sequence(1, {rounds}), {_START}, (m, i) -> transform(array({_E_STEP}), e -> {_M_STEP})[0])"
    row = one.select(F.expr(step).alias("m")).first()["m"]
    return {"pi": list(row["pi"]), "g": list(row["g"])}


def posterior(model: dict) -> Column:
    """Probability of good quality under the fitted model, from the column v."""
    good, bad = F.lit(model["pi"][0]), F.lit(model["pi"][1])
    for j in range(_J):
        g, b, v = model["g"][j], model["g"][_J + j], F.col("v")[j]
        good = good * F.when(v == 1, F.lit(g)).when(v == 0, F.lit(1 - g)).otherwise(F.lit(1.0))
        bad = bad * F.when(v == 1, F.lit(b)).when(v == 0, F.lit(1 - b)).otherwise(F.lit(1.0))
    return good / (good + bad)


def verdict(threshold: float = 0.5) -> dict[str, Column]:
    """base_failed, and kept, from the counts and the column quality."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return {"base_failed": base, "kept": ~base & (F.col("quality") >= threshold)}


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Every document with its counts, votes, quality (posterior), base_failed and kept.

    The counts are written once; fitting and judging both read that table.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    stats = materialise(text_stats(d, ["doc_id"]).withColumn("v", votes()))
    return stats.withColumn("quality", posterior(fit(stats))).withColumns(verdict(threshold)).withColumnRenamed("v", "votes")


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that judge() keeps, with their own columns.

    The rows are written once with their votes, so that no text is shuffled or counted
    twice and rows that share an id are judged apart.
    """
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    voted = materialise(text_stats(own, ["row"]).withColumn("v", votes()).select("row", "n_words", "n_repeat_words", "v"))
    judged = voted.withColumn("quality", posterior(fit(voted))).withColumns(verdict(threshold))
    return judged.filter("kept").select("row.*")
