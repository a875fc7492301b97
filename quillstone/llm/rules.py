"""Quality rules: text statistics as columns, and a decision list learned by sequential covering."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.exprs import let
from quillstone.llm.common import held_out, texts

BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
REPEAT = 5
#: Most labelled rows the list is learned from: those with the smallest hash of doc_id.
FIT_ROWS = 20_000
#: Thresholds tried for each statistic: that many quantiles of the labelled rows.
CUTS = 48
#: The longest list, and the most thresholds of a rule.
RULES, TERMS = 16, 4
FEATURES = "n_words mean_word symbol_share dup_line_share repeat_share upper_share distinct_share digit_share".split()


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window of REPEAT words found twice or more in the array."""

    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda x, j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == x["h"])) | ((j < last) & (s[F.least(j + 1, last)]["h"] == x["h"]))
            return F.sort_array(F.filter(F.transform(s, lambda x, j: F.when(same(x, j), x["i"])), lambda i: i.isNotNull()))

        def union(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.when(k + 1 < F.size(p), F.least(F.lit(REPEAT), p[F.least(k + 1, F.size(p) - 1)] - x)).otherwise(REPEAT))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(let(ranked, places), union)

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (REPEAT - 1)), lambda i: F.xxhash64(F.slice(words, i, REPEAT)))
    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < REPEAT, F.lit(0)).otherwise(found).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and FEATURES of every whole text.

    Null and empty texts have no words and zeros throughout; repeated rows come out alike.
    """
    split = texts(docs).select(
        "doc_id",
        "text",
        F.array_remove(F.split("text", BREAK), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
    )
    counted = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        let(F.col("words"), _repeated_words).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_upper"),
        F.regexp_count("text", F.lit("[0-9]")).alias("n_digits"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return counted.select(
        *"doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words".split(),
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("n_distinct", "n_words").alias("distinct_share"),
        share("n_digits", "word_chars").alias("digit_share"),
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, "<=" or ">", threshold); documents that meet it are rejected."""

    terms: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        one = lambda t: F.col(t[0]) <= t[2] if t[1] == "<=" else F.col(t[0]) > t[2]
        return reduce(lambda a, b: a & b, map(one, self.terms))

    def met(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, sign, cut in self.terms:
            value = x[:, FEATURES.index(name)]
            out &= value <= cut if sign == "<=" else value > cut
        return out


def _grow(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray], most: int = TERMS) -> Rule:
    """Add the threshold of highest information gain until no good document is covered, ``most`` of them at most."""
    rule, inside = Rule(()), np.ones(len(x), bool)
    while len(rule.terms) < most and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best = (0.0, None)
        for j, name in enumerate(FEATURES):
            for cut in cuts[j]:
                for sign in ("<=", ">"):
                    now = inside & (x[:, j] <= cut if sign == "<=" else x[:, j] > cut)
                    p, n = (now & bad).sum(), (now & ~bad).sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0] + 1e-12:
                            best = (gain, (name, sign, float(cut)))
        if best[1] is None:
            break
        rule = Rule((*rule.terms, best[1]))
        inside = rule.met(x)
    return rule


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    met = rule.met(x)
    p, n = (met & bad).sum(), (met & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def cover(x: np.ndarray, bad: np.ndarray, prune: np.ndarray, least: float = 0.8) -> list[Rule]:
    """Ordered rules for the bad rows: grow on two thirds, prune on ``prune``, remove what is covered, repeat.

    The list ends when a rule's precision on all rows left falls under ``least``, or with RULES of them. Without bad or good rows it is empty.
    """
    rules: list[Rule] = []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 2)[1:-1])) for j in range(x.shape[1])] if len(x) else []
    left = np.ones(len(x), bool)
    while (left & bad & ~prune).any() and (left & ~bad).any() and len(rules) < RULES:
        rule = _grow(x[left & ~prune], bad[left & ~prune], cuts)
        held = left & prune
        while len(rule.terms) > 1:
            shorter = Rule(rule.terms[:-1])
            if _worth(shorter, x[held], bad[held]) < _worth(rule, x[held], bad[held]) or not held.any():
                break
            rule = shorter
        if not rule.terms:
            break
        met = left & rule.met(x)
        if not met.any() or (met & bad).sum() < least * met.sum() or (met & bad).sum() < 2:
            break
        rules.append(rule)
        left &= ~met
    return rules


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> list[Rule]:
    """A decision list from the statistics of at most ``fit_rows`` labelled documents that aren't held out."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg((F.avg(F.col(label).cast("double")) < 0.5).alias("bad"))
    )
    # A bounded side: fit_rows rows of two columns.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    measured = statistics(docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"))
    rows = measured.join(F.broadcast(chosen), "doc_id").select(
        "doc_id", *[F.col(f).cast("double") for f in FEATURES], "bad", (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).alias("prune")
    )
    rows = sorted(rows.dropDuplicates(["doc_id"]).collect())
    x = np.array([r[1:-2] for r in rows], float).reshape(-1, len(FEATURES))
    return cover(x, np.array([r[-2] for r in rows], bool), np.array([r[-1] for r in rows], bool))


def verdict(rules: list[Rule]) -> Column:
    """True unless a rule rejects: the list as one ordered conditional expression."""
    return reduce(lambda c, r: c.when(r.column(), F.lit(False)), rules[1:], F.when(rules[0].column(), F.lit(False))).otherwise(True) if rules else F.lit(True)


def matched_rule(rules: list[Rule]) -> Column:
    """The number, from 1, of the rule that decides; 0 for the default."""
    return reduce(lambda c, r: c.when(r[1].column(), F.lit(r[0])), list(enumerate(rules, 1))[1:], F.when(rules[0].column(), F.lit(1))).otherwise(0) if rules else F.lit(0)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The statistics of every row with base_failed, rule (of the list, from 1; 0 where none rejects) and kept.

    A text fails the base with fewer than ten words, or where more than a fifth of its words repeat; what the base
    fails isn't kept, whatever the list says.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    measured = statistics(docs).withColumn("base_failed", failed).withColumn("rule", matched_rule(rules))
    return measured.select(
        *"doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split(),
        (~F.col("base_failed") & verdict(rules)).alias("kept"),
        "rule",
    )
