"""Quality rules learned as an ordered decision list, in DataFrame functions only.

Every text gets a few counts and ratios (``text_features``).  On the labelled rows each feature is cut at
its quantiles; from then on the learner sees only a table of counts by cut numbers.  Sequential covering:
a rule is a conjunction of thresholds for the reject class, grown on two thirds of the rows by the gain
p·(log2(p/(p+n)) − log2(p0/(p0+n0))), pruned from its end on the other third by (p−n)/(p+n), kept while its
precision there is high enough; the rows it covers leave, and the next rule is grown.  Thresholds are then moved half
way towards the rejected rows.  The result is one ordered CASE expression.  A query per growth step returns at most features x cuts rows of counts.

Defined results: NULL text has no words; labels that are NULL or belong to no row are not used, a document
with several labels counts once per label; with no usable labels the list is empty and only the base rule
decides; rows may repeat and ids may be NULL; columns of the input keep their names and values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidex.llm.common import set_aside
from incidex.session import cut_lineage

SYMBOLS = "#*$%&|<>"
WINDOW = 8
_SPLIT = r"[\x20\x09-\x0D]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(hashes: Column) -> Column:
    """Positions that lie in a window whose hash occurs twice or more in the sorted (hash, start) list."""

    def covered(pairs: Column) -> Column:
        same = lambda i, j: F.get(pairs, i)["h"] == F.get(pairs, j)["h"]
        twice = F.filter(pairs, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))

        def length(s: Column) -> Column:
            steps = F.transform(s, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return _let(starts, length)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, covered))


def text_features(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds the five counts, and for the learner ``upper``, ``ends`` (words ending a sentence), ``n_distinct``."""
    p = lambda name: f"{prefix}{name}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_chars = F.char_length(text)
    out = df.withColumn(p("_w"), F.filter(F.split(text, _SPLIT), lambda w: w != ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.col(p("_w"))
    out = out.withColumns({
        p("_h"): F.transform(words, lambda w: F.xxhash64(w)),
        p("n_words"): F.size(words).cast("long"),
        p("word_chars"): F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)),
        p("n_symbols"): (n_chars - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"),
        p("n_dup_lines"): _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        p("upper"): (n_chars - F.char_length(F.regexp_replace(text, r"[A-Z]+", ""))).cast("long"),
        p("ends"): F.size(F.filter(words, lambda w: w.rlike(r"[.!?,;]$"))).cast("long"),
        p("bangs"): F.size(F.filter(words, lambda w: w.rlike(r"!$"))).cast("long"),
    })
    h = F.col(p("_h"))
    windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    out = out.withColumns({
        p("n_distinct"): F.size(F.array_distinct(h)).cast("long"),
        p("_g"): F.when(F.size(h) >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")),
    })
    out = out.withColumn(p("n_repeat_words"), _repeated_words(F.col(p("_g"))).cast("long"))
    return out.drop(p("_w"), p("_h"), p("_g"))


FEATURES = (*COUNTS, "upper", "ends", "bangs", "n_distinct")


def ratios(prefix: str = "") -> dict[str, Column]:
    """What the rules may test, per word where the count grows with length."""
    c = lambda name: F.col(f"{prefix}{name}").cast("double")
    words = F.greatest(c("n_words"), F.lit(1.0))
    return {
        "n_words": c("n_words"),
        "word_length": c("word_chars") / words,
        "symbols_per_word": c("n_symbols") / words,
        "repeat_share": c("n_repeat_words") / words,
        "dup_lines_per_word": c("n_dup_lines") / words,
        "upper_per_word": c("upper") / words,
        "ends_share": c("ends") / words,
        "bangs_share": c("bangs") / words,
        "distinct_share": c("n_distinct") / words,
    }


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 20) | (100 * r > 30 * n)


@dataclass(frozen=True)
class Rule:
    """Reject when every (feature, above, threshold) holds: value > threshold, or value <= threshold."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self, values: dict[str, Column]) -> Column:
        cond = F.lit(True)
        for name, above, limit in self.tests:
            cond = cond & ((values[name] > limit) if above else (values[name] <= limit))
        return cond

    def __str__(self) -> str:
        return " AND ".join(f"{name} {'>' if above else '<='} {limit:.6g}" for name, above, limit in self.tests)


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """The ordered list as one CASE expression: True keeps."""
    values, out = ratios(prefix), F
    for rule in rules:
        out = out.when(rule.column(values), F.lit(False))
    return F.lit(True) if out is F else out.otherwise(F.lit(True))


def learn(
    labelled: DataFrame, label: str, key: str, prefix: str = "", cuts: int = 24, max_tests: int = 4, max_rules: int = 12, precision: float = 0.75, min_cover: int = 3
) -> list[Rule]:
    """Decision list for ``label = 0`` (reject) from rows that carry the features and the label."""
    values = ratios(prefix)
    names = list(values)
    rows = labelled.where(F.col(label).isin(0, 1)).select(
        (F.col(label) == 0).cast("int").alias("bad"), (F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0).alias("prune"), *[c.alias(n) for n, c in values.items()]
    )
    grid = rows.agg(*[F.percentile_approx(n, [i / cuts for i in range(1, cuts)], 10_000).alias(n) for n in names],
                    *[F.percentile_approx(F.when(F.col("bad") == 1, F.col(n)), [i / cuts for i in range(1, cuts)], 10_000).alias(f"bad_{n}") for n in names]).first()
    points = {n: sorted({*(grid[n] or ()), *(grid[f"bad_{n}"] or ())}) for n in names}
    names = [n for n in names if points[n]]
    if not names:
        return []
    # the cut number of a value is how many cut points lie below it: value > point[k] <=> number > k
    numbers = [F.aggregate(F.array(*[F.when(F.col(n) > x, 1).otherwise(0) for x in points[n]]), F.lit(0), lambda a, x: a + x).alias(n) for n in names]
    table = cut_lineage(rows.select("bad", "prune", *numbers).groupBy("bad", "prune", *names).count())

    def holds(tests) -> Column:
        cond = F.lit(True)
        for name, above, k in tests:
            cond = cond & ((F.col(name) > k) if above else (F.col(name) <= k))
        return cond

    def counts(left: Column) -> dict:
        """(prune, feature, cut number) -> (bad, good) over rows that satisfy ``left``."""
        parts = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("k")) for n in names])).alias("x")
        got = table.where(left).select("bad", "prune", "count", parts).groupBy("prune", "x.f", "x.k").agg(
            F.sum(F.when(F.col("bad") == 1, F.col("count")).otherwise(0)).alias("p"), F.sum(F.when(F.col("bad") == 0, F.col("count")).otherwise(0)).alias("n")
        )
        return {(r["prune"], r["f"], r["k"]): (r["p"], r["n"]) for r in got.collect()}

    def total(left: Column, prune: bool) -> tuple[int, int]:
        r = table.where(left & (F.col("prune") == prune)).agg(
            F.coalesce(F.sum(F.when(F.col("bad") == 1, F.col("count"))), F.lit(0)).alias("p"), F.coalesce(F.sum(F.when(F.col("bad") == 0, F.col("count"))), F.lit(0)).alias("n")
        ).first()
        return r["p"], r["n"]

    left, found = F.lit(True), []
    while len(found) < max_rules:
        tests: list[tuple[str, bool, int]] = []
        p0, n0 = total(left, False)
        if p0 < min_cover:
            break
        while len(tests) < max_tests and n0:
            got, best = counts(left & holds(tests)), (0.0, None, 0, 0)
            for name in names:
                below_p = below_n = 0
                for k in range(len(points[name])):
                    p, n = got.get((False, name, k), (0, 0))
                    below_p, below_n = below_p + p, below_n + n
                    for above, cp, cn in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                        if cp >= min_cover and (cp, cn) != (p0, n0):
                            gain = cp * (math.log2(cp / (cp + cn)) - math.log2(p0 / (p0 + n0)))
                            if gain > best[0]:
                                best = (gain, (name, above, k), cp, cn)
            if best[1] is None:
                break
            tests.append(best[1])
            p0, n0 = best[2], best[3]
        if not tests:
            break
        scored = []
        for size in range(1, len(tests) + 1):
            p, n = total(left & holds(tests[:size]), True)
            scored.append(((p - n) / (p + n) if p + n else -1.0, -size, p, n))
        worth, size, p, n = max(scored)
        if p + n == 0 or p / (p + n) < precision:
            break
        tests = tests[:-size]
        left = left & ~holds(tests)
        found.append(tightened(rows, Rule(tuple((name, above, float(points[name][k])) for name, above, k in tests))))
    return found


def tightened(rows: DataFrame, rule: Rule) -> Rule:
    """Each threshold moved half way to the nearest rejected row the rule has seen: what lies between is kept."""
    values = {name: F.col(name) for name, _, _ in rule.tests}
    ends = [(F.min(name) if above else F.max(name)).alias(f"e{i}") for i, (name, above, _) in enumerate(rule.tests)]
    seen = rows.where((F.col("bad") == 1) & rule.column(values)).agg(*ends).first()
    return Rule(tuple((name, above, limit if seen[i] is None else (limit + seen[i]) / 2) for i, (name, above, limit) in enumerate(rule.tests)))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", carry: bool = False, **options) -> tuple[DataFrame, list[Rule]]:
    """Features, ``base_failed`` and ``kept`` for every row (names prefixed with ``q_``), and the learned rules.

    ``carry`` keeps all columns of ``docs``; otherwise only the id is kept.
    """
    feats = text_features(docs if carry else docs.select(id_col, text_col), text_col, "q_")
    feats = cut_lineage(feats if carry else feats.drop(text_col))
    marks = labels.select(F.col(id_col).alias("q_id"), F.col(label).alias("q_label"))
    training = feats.where(~base_failed("q_")).select(id_col, *[f"q_{f}" for f in FEATURES]).join(marks, F.col(id_col) == F.col("q_id"))
    rules = learn(training, "q_label", "q_id", "q_", **options)
    failed = base_failed("q_")
    return feats.withColumns({"q_base_failed": failed, "q_kept": ~failed & verdict(rules, "q_")}), rules


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` the list keeps, with their own columns (which may have any names)."""
    plain, own = set_aside(docs, (id_col, text_col))
    judged, _ = judge(plain, labels, id_col, text_col, carry=True, **names)
    return judged.where("q_kept").select(*own)
