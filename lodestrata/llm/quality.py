"""Quality rules: base statistics of whole texts and a learned decision list, in DataFrame functions only.

The statistics of a text stay within its row.  Repeated windows of eight words are found from 64-bit hashes: if all
windows differ nothing more is done; else the windows are sorted by hash and the words that equal neighbours cover
are counted.

The list is learned by sequential covering: a conjunction of thresholds grows, by information gain for the rejected
class, on two thirds of the labelled rows, is pruned on the last third, and becomes the next condition if it is
precise there; the rows that it covers leave.  Every step is one grouped count over the labelled rows (binned once),
of which the driver gets one row a feature and bin.  The result is an ordered chain of Spark conditions.

Defined cases: a null or empty text has zeros and fails the base rule; labels that are null or contradict each other
count as the lower quality; without labels the list is empty and keeps all; repeated rows are judged one by one; a
null doc_id is judged as well; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.runtime import Scratch

MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
CUTS, CONDITIONS, RULES, PRECISION, SUPPORT = 20, 3, 8, 0.9, 3
_SPACE = r"[\\x20\\x09-\\x0D]+"

#: Features of the list: SQL over the statistics.
FEATURES = {
    "mean_word_chars": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "dup_lines_per_line": "n_dup_lines / n_lines",
    "repeat_words_per_word": "n_repeat_words / n_words",
    "distinct_per_word": "n_distinct_words / n_words",
    "words_per_line": "n_words / n_lines",
    "digits_per_word": "n_digits / n_words",
    "n_words": "cast(n_words AS double)",
}


def _let(value: str, name: str, body: str) -> str:
    """SQL that computes ``value`` once and binds it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every text."""
    hashed = "transform(w, x -> xxhash64(x))"
    window = ", ".join(f"h[i + {j}]" for j in range(WINDOW))
    windows = f"if(size(w) < {WINDOW}, array(), {_let(hashed, 'h', f'transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({window}))')})"
    covered = f"aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> if(b is null, {WINDOW}, least({WINDOW}, b - a))), 0L, (s, x) -> s + x)"
    twice = "filter(transform(s, (x, i) -> if((i > 0 and s[i - 1].h = x.h) or (i < size(s) - 1 and s[i + 1].h = x.h), x.i, null)), x -> x is not null)"
    counted = _let("sort_array(transform(g, (x, i) -> named_struct('h', x, 'i', i)))", "s", _let(f"sort_array({twice})", "p", covered))
    repeat = _let(windows, "g", f"if(size(g) = size(array_distinct(g)), 0L, {counted})")
    lines = rf"filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    out = rows.select("doc_id", "t", F.expr(f"filter(split(t, '{_SPACE}'), x -> x <> '')").alias("w"))
    return out.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.expr(r"cast(char_length(translate(t, ' \u0009\u000A\u000B\u000C\u000D', '')) AS bigint)").alias("word_chars"),
        F.expr("cast(char_length(t) - char_length(translate(t, '#*$%&|<>', '')) AS bigint)").alias("n_symbols"),
        F.expr(_let(lines, "l", "named_struct('n', cast(size(l) AS bigint), 'd', cast(size(l) - size(array_distinct(l)) AS bigint))")).alias("lines"),
        F.expr(repeat).alias("n_repeat_words"),
        F.expr("cast(size(array_distinct(w)) AS bigint)").alias("n_distinct_words"),
        F.expr("cast(char_length(t) - char_length(translate(t, '0123456789', '')) AS bigint)").alias("n_digits"),
    ).select("doc_id", "n_words", "word_chars", "n_symbols", F.col("lines.d").alias("n_dup_lines"), "n_repeat_words", F.col("lines.n").alias("n_lines"), "n_distinct_words", "n_digits")


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words")


@dataclass(frozen=True)
class Condition:
    """feature > cut (``above``) or feature <= cut."""

    feature: str
    above: bool
    cut: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.cut!r}D"


Rule = tuple[Condition, ...]


def learn(stats: DataFrame, labels: DataFrame, scratch: Scratch, target: str = "quality") -> list[Rule]:
    """The ordered rules; each rejects the rows that it covers."""
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(target).alias("q")).where("q is not null")
    rows = stats.where(~base_failed()).join(marked, "doc_id").select(*[F.expr(x).alias(n) for n, x in FEATURES.items()], (F.col("q") == 0).cast("long").alias("bad"), (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) < 2).alias("grow"))
    rows = scratch.keep(rows, "labelled")
    shares = [i / (CUTS + 1) for i in range(1, CUTS + 1)] + [0.01, 0.99]
    of_all = [F.percentile_approx(n, shares, 1000).alias(n) for n in FEATURES]
    found = rows.groupBy("bad").agg(*of_all).collect()  # two rows
    cuts = {n: sorted({float(c) for r in found for c in (r[n] or [])}) for n in FEATURES}
    bins = [F.expr(" + ".join(f"int({n} > {c!r}D)" for c in cuts[n]) or "0").alias(n) for n in FEATURES]
    binned = scratch.keep(rows.select("bad", "grow", *bins).groupBy("grow", *FEATURES).agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")), "binned")

    def matches(rule: Rule) -> Column:
        out = F.lit(True)
        for c in rule:
            at = cuts[c.feature].index(c.cut)  # bin b holds cuts[b - 1] < x <= cuts[b]
            out = out & (F.col(c.feature) > at if c.above else F.col(c.feature) <= at)
        return out

    rules: list[Rule] = []
    left = binned
    while len(rules) < RULES:
        rule: Rule = ()
        while len(rule) < CONDITIONS:
            inside = left.where("grow").where(matches(rule))
            pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("b")) for n in FEATURES])).alias("x")
            counts = inside.select(pairs, "bad", "good").groupBy("x.f", "x.b").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()  # features x bins
            by = {n: {r["b"]: (r["bad"], r["good"]) for r in counts if r["f"] == n} for n in FEATURES}
            total = [sum(v[i] for v in by["n_words"].values()) for i in (0, 1)]
            if not total[0] or not total[1]:
                break
            best, gained = None, 0.0
            for n in FEATURES:
                p = g = 0
                for at, cut in enumerate(cuts[n]):
                    p, g = p + by[n].get(at, (0, 0))[0], g + by[n].get(at, (0, 0))[1]
                    for above, bad, good in ((False, p, g), (True, total[0] - p, total[1] - g)):
                        if bad >= SUPPORT:
                            gain = bad * (math.log2(bad / (bad + good)) - math.log2(total[0] / sum(total)))
                            if gain > gained + 1e-9:
                                best, gained = Condition(n, above, cut), gain
            if best is None:
                break
            rule = (*rule, best)
        if not rule:
            break
        test = left.where(~F.col("grow"))
        sums = [F.sum(F.when(matches(rule[: k + 1]), F.col(c))).alias(f"{c}{k}") for k in range(len(rule)) for c in ("bad", "good")]
        seen = test.agg(*sums).first()
        scored = []
        for k in range(len(rule)):
            bad, good = seen[f"bad{k}"] or 0, seen[f"good{k}"] or 0
            if bad:
                scored.append(((bad - good) / (bad + good), -k, bad / (bad + good)))
        if not scored or max(scored)[2] < PRECISION:
            break
        rules.append(rule[: 1 - max(scored)[1]])
        left = left.where(~matches(rules[-1]))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional: the first rule that covers a row rejects it; kept otherwise."""
    out = None
    for rule in rules:
        covers = F.expr(" and ".join(c.sql() for c in rule))
        out = F.when(covers, F.lit(False)) if out is None else out.when(covers, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, base_failed and kept for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.keep(statistics(docs, id_col, text_col), "stats")
    rules = learn(stats, labels, scratch)
    scratch.drop("labelled", "binned")
    out = stats.withColumn("base_failed", base_failed())
    return out.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))
