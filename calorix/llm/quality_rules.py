"""Quality rules: base counts per text, then robust outliers per language and source.

Every text is counted inside its own row with SQL functions, so a document is never split into
rows. The outlier test estimates location and scatter of the statistic vectors of each
(language, source) by minimum covariance determinant: from two starts, concentration steps keep
the most central share of the rows and estimate again, and the start with the smaller
determinant wins. One step is one aggregation: rows are counted per distance bin together with
their moments, and the bins are added up from the centre until the share is reached. So a group
of any size, also one with most of the rows, is only ever summed. Statistics are rounded to
integers, which makes the sums exact and the verdicts the same on every run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calorix.llm.base import SPACES, query, table, words
from calorix.session import durable, few

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GRID = 1024


@dataclass(frozen=True)
class OutlierRules:
    """Parameters of the estimate.

    share: of a group's rows that an estimate rests on; steps: concentration steps;
    min_rows: smaller (language, source) groups are judged with their whole language, and a
    language with fewer rows not at all; cutoff: squared robust distance above which a text is
    rejected; scales: standard deviations added to each statistic, so that a statistic that is
    constant in the central rows does not reject everything else.
    """

    share: float = 0.75
    steps: int = 4
    min_rows: int = 60
    cutoff: float = 45.0
    scales: tuple[float, ...] = (0.04, 0.30, 0.25, 0.30, 0.08)


def _chars_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def with_base_counts(df: DataFrame, text: Column, size: int = 8) -> DataFrame:
    """Add the five base counts, ``n_capitals`` (A-Z) and ``n_marks``; null texts count as empty.

    ``n_repeat_words`` counts the words that lie in a window of ``size`` words found twice or
    more in the text, the first occurrence included. ``n_dup_lines`` counts lines with a word
    that equal an earlier line. ``df`` must not use names that begin with an underscore and ``c_``.
    """
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counted = df.withColumns(
        {
            "_c_words": words(text),
            "_c_lines": lines,
            "n_symbols": _chars_of(whole, SYMBOLS).cast("long"),
            "word_chars": F.length(F.translate(whole, SPACES, "")).cast("long"),
            "n_capitals": _chars_of(whole, _CAPITALS).cast("long"),
            "n_marks": _chars_of(whole, "!?.,;:").cast("long"),
        }
    )
    hashes = F.transform(
        F.sequence(F.lit(1), F.size("_c_words") - size + 1),
        lambda i: F.xxhash64(F.slice(F.col("_c_words"), i, size)),
    )
    counted = counted.withColumns(
        {
            "n_words": F.size("_c_words").cast("long"),
            "n_dup_lines": (F.size("_c_lines") - F.size(F.array_distinct("_c_lines"))).cast("long"),
            "_c_hashes": F.when(F.size("_c_words") > size, hashes),
        }
    )
    # most texts repeat no window: only the others are sorted
    placed = F.array_sort(
        F.transform("_c_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    repeats = F.size("_c_hashes") > F.size(F.array_distinct("_c_hashes"))
    counted = counted.withColumn("_c_placed", F.when(repeats, placed))
    ordered = F.col("_c_placed")
    twice = F.filter(
        ordered,
        lambda x, i: F.coalesce(x["h"] == F.get(ordered, i - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get(ordered, i + 1)["h"], F.lit(False)),
    )
    counted = counted.withColumn(
        "_c_starts", F.array_sort(F.transform(twice, lambda x: x["i"]))
    )
    starts = F.col("_c_starts")
    covered = F.aggregate(
        F.transform(
            starts,
            lambda p, i: F.least(F.coalesce(F.get(starts, i + 1) - p, F.lit(size)), F.lit(size)),
        ),
        F.lit(0).cast("long"),
        lambda a, b: a + b,
    )
    return counted.withColumn(
        "n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))
    ).drop("_c_words", "_c_lines", "_c_hashes", "_c_placed", "_c_starts")


def _statistics() -> list[Column]:
    """The transformed statistics, on a grid of 1/1024: word length, symbols, capitals, marks, repeats."""
    per_word = F.greatest("n_words", F.lit(1))
    per_char = F.greatest("word_chars", F.lit(1))
    raw = [
        F.log(F.col("word_chars") / per_word + 1),
        F.log(F.lit(1.0) + F.lit(100.0) * F.col("n_symbols") / per_char),
        F.log(F.lit(1.0) + F.lit(20.0) * F.col("n_capitals") / per_char),
        F.log(F.lit(1.0) + F.lit(20.0) * F.col("n_marks") / per_char),
        F.col("n_repeat_words") / per_word,
    ]
    return [F.round(x * _GRID).cast("long") for x in raw]


def _moments(x: list[str]) -> list[Column]:
    """Exact integer sums: rows, values, products."""
    sums = [F.count("*").alias("m_n")]
    for i, a in enumerate(x):
        sums.append(F.sum(a).alias(f"m_{i}"))
        for j in range(i + 1):
            sums.append(F.sum(F.col(a) * F.col(x[j])).alias(f"m_{i}_{j}"))
    return sums


def _estimate(x: list[str], scales: tuple[float, ...]) -> list[Column]:
    """Location and the lower triangle of the scatter's Cholesky factor, from the sums."""
    n, d = F.col("m_n"), len(x)
    mean = [F.col(f"m_{i}") / n / _GRID for i in range(d)]
    cov = {
        (i, j): F.col(f"m_{i}_{j}") / n / (_GRID * _GRID)
        - mean[i] * mean[j]
        + (scales[i] ** 2 if i == j else 0.0)
        for i in range(d)
        for j in range(i + 1)
    }
    return [*[m.alias(f"e_{i}") for i, m in enumerate(mean)]] + [
        c.alias(f"v_{i}_{j}") for (i, j), c in cov.items()
    ]


def _factored(df: DataFrame, d: int) -> DataFrame:
    """Cholesky factor ``l_i_j`` of the scatter ``v_i_j`` and its log determinant."""
    for i in range(d):
        for j in range(i + 1):
            left = F.col(f"v_{i}_{j}")
            for k in range(j):
                left = left - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            value = F.sqrt(F.greatest(left, F.lit(1e-9))) if i == j else left / F.col(f"l_{j}_{j}")
            df = df.withColumn(f"l_{i}_{j}", value)
    det = sum((F.log(F.col(f"l_{i}_{i}")) for i in range(1, d)), F.log(F.col("l_0_0")))
    return df.withColumn("log_det", det).drop(*[f"v_{i}_{j}" for i in range(d) for j in range(i + 1)])


def _distance(df: DataFrame, x: list[str]) -> DataFrame:
    """Squared Mahalanobis distance ``dist`` by forward substitution."""
    names = []
    for i, a in enumerate(x):
        left = F.col(a) / _GRID - F.col(f"e_{i}")
        for k in range(i):
            left = left - F.col(f"l_{i}_{k}") * F.col(f"y_{k}")
        df = df.withColumn(f"y_{i}", left / F.col(f"l_{i}_{i}"))
        names.append(f"y_{i}")
    total = sum((F.col(y) * F.col(y) for y in names[1:]), F.col("y_0") * F.col("y_0"))
    return df.withColumn("dist", total).drop(*names)


def fit_outliers(stats: DataFrame, x: list[str], rules: OutlierRules) -> DataFrame:
    """One row per group: ``g_lang``, ``g_source``, location, factor.

    ``stats`` has ``g_lang``, ``g_source`` and the statistics ``x`` and should be a written table,
    as every step reads it again. Groups are (language, source) and, with a null source, the whole
    language; those with fewer than ``min_rows`` rows are left out.
    """
    d = len(x)
    # a group and its language are fitted at once; both are only summed per task
    both = stats.select(
        "g_lang", F.explode(F.array("g_source", F.lit(None))).alias("g_source"), *x
    )
    keys = ["g_lang", "g_source"]
    first = both.groupBy(*keys).agg(*_moments(x)).where(F.col("m_n") >= rules.min_rows)
    # written, as a filter on a factor would be pushed into its formula and repeat it many times
    plain = durable(_factored(first.select(*keys, *_estimate(x, rules.scales)), d), "quality-plain")
    same = lambda right: [
        F.col("b.g_lang") == F.col(f"{right}.g_lang"),
        F.col("b.g_source").eqNullSafe(F.col(f"{right}.g_source")),
    ]
    # the second start rests on the rows near the centre in every single statistic
    centre = [f"{name}_{i}" for i in range(d) for name in ("e", f"l_{i}")]
    near = both.alias("b").join(plain.alias("p"), same("p")).select("b.*", *centre)
    for i, a in enumerate(x):
        near = near.where(F.abs(F.col(a) / _GRID - F.col(f"e_{i}")) <= F.col(f"l_{i}_{i}"))
    boxed = near.groupBy(*keys).agg(*_moments(x)).where(F.col("m_n") >= rules.min_rows // 4)
    starts = plain.withColumn("start", F.lit(0)).unionByName(
        _factored(boxed.select(*keys, *_estimate(x, rules.scales)), d).withColumn("start", F.lit(1))
    )
    found = durable(starts, "quality-start")
    in_bin = Window.partitionBy(*keys, "start").orderBy("bin")
    for _ in range(rules.steps):
        fitted = [c for c in found.columns if c[:2] in ("e_", "l_")]
        placed = both.alias("b").join(found.alias("f"), same("f")).select("b.*", "start", *fitted)
        apart = _distance(placed, x)
        bins = apart.withColumn("bin", F.floor(F.log(F.col("dist") + 1e-3) * 24)).groupBy(
            *keys, "start", "bin"
        ).agg(*_moments(x))
        whole = F.sum("m_n").over(Window.partitionBy(*keys, "start"))
        before = F.sum("m_n").over(in_bin) - F.col("m_n")
        inner = bins.withColumns({"_all": whole, "_before": before}).where(
            F.col("_before") < F.col("_all") * rules.share
        )
        sums = [F.sum(c).alias(c) for c in bins.columns if c.startswith("m_")]
        step = inner.groupBy(*keys, "start").agg(*sums)
        found = durable(_factored(step.select(*keys, "start", *_estimate(x, rules.scales)), d), "quality-step")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("log_det", "start"))
    return found.withColumn("_r", rank).where("_r = 1").drop("_r", "start", "log_det")


def quality_verdicts(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    carry: list[str] | None = None,
    rules: OutlierRules | None = None,
) -> DataFrame:
    """One row per document: column ``row`` with ``carry`` (all columns if none are named), the
    base counts, ``base_failed``, ``distance`` (null where nothing is estimated) and ``kept``.

    base_failed: fewer than 20 words or more than 30 % of them repeated; empty and null texts
    fail. Null languages and sources are groups of their own. Only texts that pass the base rules
    enter the estimates, and a text without an estimate is kept if it passes them. Repeated rows
    are judged alike. An empty table gives an empty result. Names in ``docs`` cannot clash: its
    columns stay inside ``row``.
    """
    rules = rules or OutlierRules()
    named = docs.columns if carry is None else carry
    packed = docs.select(
        (F.struct(*named) if named else F.struct(F.lit(0).alias("_"))).alias("row"),
        F.col(text_col).alias("t"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("g_lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("g_source"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    x = [f"x_{i}" for i in range(len(rules.scales))]
    counted = with_base_counts(packed, F.col("t")).drop("t").withColumn("base_failed", failed)
    counted = counted.withColumns(dict(zip(x, _statistics(), strict=True)))
    stats = durable(counted, "quality")
    groups = fit_outliers(stats.where("not base_failed").select("g_lang", "g_source", *x), x, rules)
    # the estimate of the group, else of the language; both joins are on tables of a row a group
    own = few(groups.where("g_source is not null"), "quality-groups")
    wide = groups.where("g_source is null").drop("g_source")
    wide = few(wide.withColumnsRenamed({c: f"w_{c}" for c in wide.columns}), "quality-languages")
    both = stats.join(own, ["g_lang", "g_source"], "left").join(
        wide, F.col("g_lang") == F.col("w_g_lang"), "left"
    )
    fitted = [c for c in own.columns if c not in ("g_lang", "g_source")]
    both = both.withColumns({c: F.coalesce(F.col(c), F.col(f"w_{c}")) for c in fitted})
    judged = _distance(both, x).withColumnRenamed("dist", "distance")
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= rules.cutoff, F.lit(True))
    return judged.withColumn("kept", kept).select(
        "row", *BASE, "base_failed", "distance", "kept"
    )


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and verdict of every document."""
    judged = quality_verdicts(table(spark, folder, "documents"), carry=["doc_id"])
    return judged.select(
        F.col("row.doc_id").alias("doc_id"), *BASE, "base_failed", "kept", "distance"
    )
