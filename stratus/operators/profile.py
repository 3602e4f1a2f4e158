"""Profiling and exploratory aggregates.

Every table-wide statistic is one ``agg`` over all requested columns (partial
aggregation on the executors, one small final merge); wide single-row results are
turned into long form with ``inline`` over an array of structs.  Grouped rates use
``groupBy`` with map-side combine, so a hot group costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratus.functions.roles import fold
from stratus.operators.joins import join_lookup
from stratus.operators.ranges import quantiles, range_buckets, running_counts, value_table
from stratus.operators.stats import column_stat, numeric_columns


def _long(wide: DataFrame, structs: list[Column]) -> DataFrame:
    return wide.select(F.inline(F.array(*structs)))


def _missing(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType.typeName()
    if dt in ("double", "float"):
        return F.col(c).isNull() | F.isnan(c)
    return F.col(c).isNull()


def smallest_values(df: DataFrame, columns: Sequence[str], k: int = 3) -> DataFrame:
    """``(column, values)``: the ``k`` smallest distinct non-NULL values of each column as ``array<string>``.

    ``k`` aggregates, each over all columns at once; each starts above the values that the one
    before it found, which are one row on the driver.
    """
    found: dict[str, list] = {c: [] for c in columns}
    open_ = list(columns)
    for _ in range(k):
        if not open_:
            break
        above = [F.col(c) > F.lit(found[c][-1]) if found[c] else F.col(c).isNotNull() for c in open_]
        least = [F.min(F.when(x & ~_missing(df, c), F.col(c))).alias(f"m{i}") for i, (c, x) in enumerate(zip(open_, above))]
        row = df.agg(*least).first()
        still = []
        for i, c in enumerate(open_):
            if row[i] is not None:
                found[c].append(row[i])
                still.append(c)
        open_ = still
    texts = [F.struct(F.lit(c).alias("column"), _texts(df, c, found[c]).alias("values")) for c in columns]
    return df.sparkSession.range(1).select(F.inline(F.array(*texts)))


def _texts(df: DataFrame, column: str, values: list) -> Column:
    dt = df.schema[column].dataType
    return F.array(*[F.lit(v).cast(dt).cast("string") for v in values]) if values else F.array().cast("array<string>")


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, samples: int = 3, exact_distinct: bool = True) -> DataFrame:
    """Per column: type, NULL count, % NULL (2 dp), distinct non-NULL count, smallest sample values.

    ``samples`` + 2 reads for any number of columns (+ 1 with ``exact_distinct=False``).  Exact
    distinct counts come from one long table of (column, value) that is combined on the map side.
    """
    columns = list(columns) if columns is not None else df.columns
    approx = [] if exact_distinct else [F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns)]
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(_missing(df, c)).alias(f"n{i}") for i, c in enumerate(columns)], *approx)
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(i).alias("__pos"),
            F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
            F.col(f"n{i}").cast("long").alias("n_null"),
            F.round(F.col(f"n{i}") * F.lit(100.0) / F.col("rows"), 2).alias("pct_null"),
            *([] if exact_distinct else [F.col(f"d{i}").cast("long").alias("n_distinct")]),
        )
        for i, c in enumerate(columns)
    ]
    out = _long(wide, structs)
    if exact_distinct:
        cells = [F.struct(F.lit(i).alias("__pos"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)]
        values = df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull()).distinct()
        counts = values.groupBy("__pos").agg(F.count(F.lit(1)).alias("n_distinct"))
        out = out.join(counts, "__pos", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))
    texts = smallest_values(df, columns, samples).withColumn("samples", F.array_join("values", ", "))
    return out.join(texts.select("column", "samples"), "column").select("column", "dtype", "n_null", "pct_null", "n_distinct", "samples")


def column_types_table(df: DataFrame) -> DataFrame:
    """name, dtype, non-NULL count, % NULL (2 dp)."""
    n = F.count(F.lit(1))
    wide = df.agg(n.alias("rows"), *[F.count_if(~_missing(df, c)).alias(f"v{i}") for i, c in enumerate(df.columns)])
    return _long(
        wide,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                F.col(f"v{i}").cast("long").alias("non_null"),
                F.round((F.col("rows") - F.col(f"v{i}")) * F.lit(100.0) / F.col("rows"), 2).alias("pct_null"),
            )
            for i, c in enumerate(df.columns)
        ],
    )


def table_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, total missing cells."""
    total = sum(F.count_if(_missing(df, c)) for c in df.columns)
    return df.agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        total.cast("long").alias("total_nulls"),
    )


def dtype_counts(df: DataFrame) -> DataFrame:
    """Columns per type and the non-missing cells they hold (one aggregate over the data)."""
    fields = df.schema.fields
    wide = df.agg(*[F.count_if(~_missing(df, f.name)).alias(f"v{i}") for i, f in enumerate(fields)])
    long = _long(wide, [F.struct(F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"v{i}").alias("v")) for i, f in enumerate(fields)])
    return long.groupBy("dtype").agg(F.count(F.lit(1)).cast("long").alias("n_columns"), F.sum("v").cast("long").alias("n_values"))


def distinct_samples(df: DataFrame, columns: Sequence[str] | None = None, n: int = 5) -> DataFrame:
    """First ``n`` distinct values (ascending) of each text column, long form (column, rank, value)."""
    columns = list(columns) if columns is not None else [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    return (
        smallest_values(df, columns, n)
        .select("column", F.posexplode("values").alias("pos", "value"))
        .select("column", (F.col("pos") + 1).cast("long").alias("rank"), "value")
    )


def describe(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """count, mean, std (sample), min, 25/50/75 % (linear interpolation), max per column.

    Quartiles are exact (``stratus.operators.ranges``; their value table is written while the plan
    is built); ``exact=False`` takes ``percentile_approx`` in the same pass as the rest.
    """
    columns = list(columns) if columns is not None else numeric_columns(df)
    aggs = []
    for i, c in enumerate(columns):
        x = F.when(~_missing(df, c), F.col(c).cast("double"))
        aggs += [F.count(x).alias(f"c{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        if not exact:
            aggs.append(F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000).alias(f"q{i}"))
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"c{i}").cast("long").alias("count"),
            F.col(f"m{i}").alias("mean"),
            F.col(f"s{i}").alias("std"),
            F.col(f"lo{i}").alias("min"),
            F.col(f"hi{i}").alias("max"),
            *([] if exact else [F.col(f"q{i}")[k].cast("double").alias(p) for k, p in enumerate(("p25", "p50", "p75"))]),
        )
        for i, c in enumerate(columns)
    ]
    out = _long(df.agg(*aggs), structs)
    if exact:
        quart = quantiles(value_table(df, columns), [0.25, 0.5, 0.75]).selectExpr("column", "q0 AS p25", "q1 AS p50", "q2 AS p75")
        out = out.join(quart, "column", "left")
    return out.select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def null_counts(df: DataFrame, columns: Sequence[str] | None = None, top: int | None = None, only_missing: bool = True) -> DataFrame:
    """Missing values and % per column, only columns with any, most missing first."""
    columns = list(columns) if columns is not None else df.columns
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(_missing(df, c)).alias(f"n{i}") for i, c in enumerate(columns)])
    long = _long(
        wide,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n{i}").cast("long").alias("n_null"),
                (F.col(f"n{i}") * F.lit(100.0) / F.col("rows")).alias("pct_null"),
            )
            for i, c in enumerate(columns)
        ],
    )
    if only_missing:
        long = long.where(F.col("n_null") > 0)
    long = long.orderBy(F.col("n_null").desc(), F.col("column"))
    return long.limit(top) if top else long


def row_null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: rows with ≥ 1 missing value, total missing cells, rows."""
    columns = list(columns) if columns is not None else df.columns
    per_row = sum(_missing(df, c).cast("int") for c in columns)
    return df.agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        F.count_if(per_row > 0).cast("long").alias("rows_with_null"),
        F.sum(per_row).cast("long").alias("total_nulls"),
    )


def valid_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Non-missing values and % per column."""
    columns = list(columns) if columns is not None else df.columns
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~_missing(df, c)).alias(f"v{i}") for i, c in enumerate(columns)])
    return _long(
        wide,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"v{i}").cast("long").alias("n_valid"),
                (F.col(f"v{i}") * F.lit(100.0) / F.col("rows")).alias("pct_valid"),
            )
            for i, c in enumerate(columns)
        ],
    )


# Completeness verdict bands (percent of complete rows).
COMPLETENESS_BANDS = [(50.0, "low"), (70.0, "moderate")]
COMPLETENESS_OK = "good"


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """% complete rows, % non-missing cells and a verdict (< 50 low, < 70 moderate, else good)."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    complete = sum(_missing(df, c).cast("int") for c in columns) == 0
    cells = sum(F.count_if(~_missing(df, c)) for c in columns)
    rows = F.count(F.lit(1))
    out = df.agg(
        (F.count_if(complete) * F.lit(100.0) / rows).alias("pct_complete_rows"),
        (cells * F.lit(100.0) / (rows * F.lit(len(columns)))).alias("pct_cells_valid"),
    )
    verdict = F.lit(COMPLETENESS_OK)
    for bound, name in reversed(COMPLETENESS_BANDS):
        verdict = F.when(F.col("pct_complete_rows") < bound, F.lit(name)).otherwise(verdict)
    return out.withColumn("verdict", verdict)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, count, % of rows; most frequent first (ties by value)."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).cast("long").alias("n"))
    total = column_stat(df, F.count(F.lit(1)))
    return counts.withColumn("pct", F.col("n") * F.lit(100.0) / total).orderBy(F.col("n").desc(), F.col("value"))


def class_balance(df: DataFrame, label: str, imbalance_ratio: float = 0.3) -> DataFrame:
    """min/max class-count ratio and whether it is below ``imbalance_ratio``."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).cast("long").alias("n_classes"),
        (F.min("n") / F.max("n")).alias("ratio"),
    ).withColumn("imbalanced", F.col("ratio") < F.lit(imbalance_ratio))


def rain_rate(df: DataFrame, label: str = "Chuva") -> DataFrame:
    """rate (% of rows with label 1), events, rows."""
    return df.agg(
        (F.avg(F.col(label).cast("double")) * F.lit(100.0)).alias("rate"),
        F.sum(F.col(label).cast("long")).cast("long").alias("n_events"),
        F.count(F.lit(1)).cast("long").alias("n_rows"),
    )


def rate_by(df: DataFrame, group: str | Column, label: str = "Chuva", name: str | None = None) -> DataFrame:
    """Event rate per group: group, rows, events, rate (%)."""
    g = F.col(group) if isinstance(group, str) else group
    name = name or (group if isinstance(group, str) else "group")
    return df.groupBy(g.alias(name)).agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        F.sum(F.col(label).cast("long")).cast("long").alias("n_events"),
        (F.avg(F.col(label).cast("double")) * F.lit(100.0)).alias("rate"),
    )


def group_mean_diff(df: DataFrame, measure: str, label: str = "Chuva", min_rows: int = 10) -> DataFrame:
    """Mean of ``measure`` with label 0 vs 1 and their absolute difference (rows with both
    values present; NULL when fewer than ``min_rows`` such rows)."""
    ok = ~_missing(df, measure) & F.col(label).isNotNull()
    x = F.when(ok, F.col(measure).cast("double"))
    out = df.agg(
        F.count(x).alias("n"),
        F.avg(F.when(F.col(label) == 0, x)).alias("mean_0"),
        F.avg(F.when(F.col(label) == 1, x)).alias("mean_1"),
    )
    enough = F.col("n") >= F.lit(min_rows)
    return out.select(
        F.col("n").cast("long").alias("n_rows"),
        F.when(enough, F.col("mean_0")).alias("mean_0"),
        F.when(enough, F.col("mean_1")).alias("mean_1"),
        F.when(enough, F.abs(F.col("mean_0") - F.col("mean_1"))).alias("abs_diff"),
    )


def histogram(df: DataFrame, column: str, bins: int = 50, by: str | None = None, density: bool = False) -> DataFrame:
    """Equal-width bins over [min, max]; the maximum falls in the last bin (numpy rule).

    Output: (by,) bin, lower, upper, count (+ density).  Every bin appears, empty ones
    with count 0 (spine of ``bins`` rows).  With one distinct value the range is
    value ± 0.5.
    """
    x = F.col(column).cast("double")
    valid = df.where(~_missing(df, column))
    lo0 = column_stat(valid, F.min(x))
    hi0 = column_stat(valid, F.max(x))
    same = lo0 == hi0
    lo = F.when(same, lo0 - F.lit(0.5)).otherwise(lo0)
    hi = F.when(same, hi0 + F.lit(0.5)).otherwise(hi0)
    b = F.least(F.floor((x - lo) / (hi - lo) * F.lit(bins)).cast("long"), F.lit(bins - 1))
    groups = [by] if by else []
    counts = valid.groupBy(*groups, b.alias("bin")).agg(F.count(F.lit(1)).cast("long").alias("count"))
    spine = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    if by:
        # one spine row per (class, bin); classes come from the counts table itself
        classes = counts.select(by).distinct()
        spine = classes.select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    full = join_lookup(spine, counts, [*groups, "bin"]).fillna(0, subset=["count"])
    width = (hi - lo) / F.lit(bins)
    full = full.withColumns({"lower": lo + F.col("bin") * width, "upper": lo + (F.col("bin") + 1) * width})
    if density:
        total = F.sum("count").over(Window.partitionBy(*groups)) if by else column_stat(valid, F.count(F.lit(1)))
        full = full.withColumn("density", F.col("count") / (total * width))
    return full.select(*groups, "bin", "lower", "upper", "count", *(["density"] if density else []))


def box_stats(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Quartiles, IQR, whiskers (most extreme values inside the 1.5·IQR fences) and outliers.

    A NULL class is a class.  One pass over the rows: quartiles and whiskers come from the table of
    distinct values, which is written while the plan is built.
    """
    groups = [by] if by else []
    values = value_table(df, [column], groups)
    quart = quantiles(values, [0.25, 0.5, 0.75], groups).where("count > 0")
    quart = quart.select(*groups, "column", F.col("count").cast("long").alias("n_all"), F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    rows = join_lookup(values.where(F.col("value").isNotNull()), quart, [*groups, "column"], "inner")
    iqr = F.col("q3") - F.col("q1")
    lo_f = F.col("q1") - F.lit(1.5) * iqr
    hi_f = F.col("q3") + F.lit(1.5) * iqr
    return rows.groupBy(*groups, F.col("n_all").alias("n"), "q1", "median", "q3").agg(
        F.first(iqr).alias("iqr"),
        F.min(F.when(F.col("value") >= lo_f, F.col("value"))).alias("whisker_low"),
        F.max(F.when(F.col("value") <= hi_f, F.col("value"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when((F.col("value") < lo_f) | (F.col("value") > hi_f), rows["n"])), F.lit(0)).cast("long").alias("n_outliers"),
    )


def mean_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and exact median per column, from the table of distinct values."""
    values = value_table(df, columns)
    medians = quantiles(values, [0.5]).select("column", F.col("q0").alias("median"))
    means = _long(
        df.agg(*[F.avg(F.when(~_missing(df, c), F.col(c).cast("double"))).alias(f"m{i}") for i, c in enumerate(columns)]),
        [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean")) for i, c in enumerate(columns)],
    )
    return means.join(medians, "column", "left").select("column", "mean", "median")


def _pearson(x: Column, y: Column) -> Column:
    """Pearson r of two columns that are missing together; NULL where one is constant."""
    # merged moments of a constant need not be exactly zero
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def _pair_stats(df: DataFrame, a: str, b: str) -> tuple[Column, Column]:
    """Pearson r over rows where both are present (NULL for constant input) and the pair count."""
    both = ~_missing(df, a) & ~_missing(df, b)
    xa = F.when(both, F.col(a).cast("double"))
    xb = F.when(both, F.col(b).cast("double"))
    return _pearson(xa, xb), F.count(xa)


#: more columns than this are correlated in blocks
WIDE_COLUMNS = 12
#: columns on each side of a block
BLOCK_COLUMNS = 3


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, min_periods: int = 1) -> DataFrame:
    """Pairwise Pearson correlation, long form (col_a, col_b, r, n_pairs), every ordered pair.

    Up to ``WIDE_COLUMNS`` columns one aggregate computes all i ≤ j pairs; the matrix is mirrored in
    the projection.  More columns are correlated in blocks (:func:`_block_correlations`).
    """
    columns = list(columns) if columns is not None else numeric_columns(df)
    if len(columns) > WIDE_COLUMNS:
        return _block_correlations(df, columns, min_periods)
    aggs = []
    idx = {}
    for i, a in enumerate(columns):
        for j in range(i, len(columns)):
            r, n = _pair_stats(df, a, columns[j])
            aggs += [r.alias(f"r{i}_{j}"), n.alias(f"n{i}_{j}")]
            idx[(i, j)] = (f"r{i}_{j}", f"n{i}_{j}")
    wide = df.agg(*aggs)
    structs = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            rc, nc = idx[(min(i, j), max(i, j))]
            r = F.when(F.col(nc) >= F.lit(min_periods), F.col(rc))
            structs.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), r.alias("r"), F.col(nc).cast("long").alias("n_pairs")))
    return _long(wide, structs)


def _block_correlations(df: DataFrame, columns: Sequence[str], min_periods: int) -> DataFrame:
    """The matrix of any number of columns in one read.

    A row becomes one long row per pair of blocks of ``BLOCK_COLUMNS`` columns; every group of block pairs has
    the same few aggregates, summed on the map side, so neither the plan nor an aggregate's buffers
    grow with the number of pairs.
    """
    size, width = BLOCK_COLUMNS, -(-len(columns) // BLOCK_COLUMNS)
    values = [F.when(~_missing(df, c), F.col(c).cast("double")) for c in columns]
    row = F.array(*values, *[F.lit(None).cast("double")] * (size * width - len(columns)))
    pairs = F.expr(f"flatten(transform(sequence(0, {width - 1}), i -> transform(sequence(i, {width - 1}), j -> named_struct('i', i, 'j', j))))")
    blocks = df.select(row.alias("v"), F.explode(pairs).alias("b")).select(
        "b.i",
        "b.j",
        *[F.col("v")[F.col("b.i") * size + k].alias(f"x{k}") for k in range(size)],
        *[F.col("v")[F.col("b.j") * size + k].alias(f"y{k}") for k in range(size)],
    )
    aggs, structs = [], []
    for p in range(size):
        for q in range(size):
            both = F.col(f"x{p}").isNotNull() & F.col(f"y{q}").isNotNull()
            x, y = F.when(both, F.col(f"x{p}")), F.when(both, F.col(f"y{q}"))
            aggs += [_pearson(x, y).alias(f"r{p}_{q}"), F.count(x).alias(f"n{p}_{q}")]
            structs.append(F.struct((F.col("i") * size + p).alias("a"), (F.col("j") * size + q).alias("b"), F.col(f"r{p}_{q}").alias("r"), F.col(f"n{p}_{q}").alias("n")))
    found = blocks.groupBy("i", "j").agg(*aggs).select(F.inline(F.array(*structs)))
    # every pair has a row, also of a table without rows
    last = len(columns) - 1
    spine = df.sparkSession.range(1).select(F.explode(F.expr(f"flatten(transform(sequence(0, {last}), a -> transform(sequence(a, {last}), b -> named_struct('a', a, 'b', b))))")).alias("p"))
    found = spine.select("p.a", "p.b").join(found, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    mirrored = found.select(F.explode(both).alias("p"), F.when(F.col("n") >= min_periods, F.col("r")).alias("r"), F.col("n").cast("long").alias("n_pairs"))
    names = F.array(*[F.lit(c) for c in columns])
    return mirrored.select(names[F.col("p.a")].alias("col_a"), names[F.col("p.b")].alias("col_b"), "r", "n_pairs")


def top_correlations(df: DataFrame, columns: Sequence[str] | None = None, n: int = 10, min_periods: int = 1) -> DataFrame:
    """Pairs i < j with the largest |r| (ties by names)."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    order = {c: i for i, c in enumerate(columns)}
    m = correlation_matrix(df, columns, min_periods)
    pos_a = F.element_at(F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))]), F.col("col_a"))
    pos_b = F.element_at(F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))]), F.col("col_b"))
    return (
        m.where((pos_a < pos_b) & F.col("r").isNotNull())
        .select("col_a", "col_b", "r", F.abs("r").alias("abs_r"))
        .orderBy(F.col("abs_r").desc(), "col_a", "col_b")
        .limit(n)
    )


# Correlation strength classes (|r| strictly above the bound).
STRENGTH_BANDS = [(0.7, "muito forte"), (0.5, "forte"), (0.3, "moderada"), (0.1, "fraca")]
STRENGTH_NONE = "muito fraca"


def strength(r: Column) -> Column:
    out = F.lit(STRENGTH_NONE)
    for bound, name in reversed(STRENGTH_BANDS):
        out = F.when(F.abs(r) > F.lit(bound), F.lit(name)).otherwise(out)
    return out


def target_correlations(df: DataFrame, target: str, columns: Sequence[str] | None = None, min_periods: int = 1) -> DataFrame:
    """Each feature's r with the target, strongest positive first, with a strength class."""
    columns = [c for c in (columns or numeric_columns(df)) if c != target]
    aggs = []
    for i, c in enumerate(columns):
        r, n = _pair_stats(df, c, target)
        aggs += [r.alias(f"r{i}"), n.alias(f"n{i}")]
    long = _long(
        df.agg(*aggs),
        [F.struct(F.lit(c).alias("feature"), F.when(F.col(f"n{i}") >= min_periods, F.col(f"r{i}")).alias("r")) for i, c in enumerate(columns)],
    )
    return long.withColumn("strength", strength(F.col("r"))).orderBy(F.col("r").desc_nulls_last(), "feature")


def best_column_by_role(df: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Per keyword, the matching column with the fewest missing values (first on ties)."""
    cand = [(k, c, pos) for k in keywords for pos, c in enumerate(df.columns) if k in fold(c)]
    if not cand:
        return df.sparkSession.createDataFrame([], "keyword string, column string, n_valid long")
    cols = list(dict.fromkeys(c for _, c, _ in cand))
    wide = df.agg(*[F.count_if(_missing(df, c)).alias(f"n{i}") for i, c in enumerate(cols)], F.count(F.lit(1)).alias("rows"))
    structs = [
        F.struct(F.lit(k).alias("keyword"), F.lit(c).alias("column"), F.lit(pos).alias("pos"), F.col(f"n{cols.index(c)}").alias("n_null"), F.col("rows").alias("rows"))
        for k, c, pos in cand
    ]
    long = _long(wide, structs)
    return long.groupBy("keyword").agg(
        F.min_by("column", F.struct("n_null", "pos")).alias("column"),
        F.min_by(F.col("rows") - F.col("n_null"), F.struct("n_null", "pos")).cast("long").alias("n_valid"),
    )


def prediction_summary(df: DataFrame, pred: str = "previsao_chuva", mm: str | None = "quantidade_chuva_prevista_mm") -> DataFrame:
    """total rows, predicted events, % predicted, mean and max predicted amount."""
    aggs = [
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        F.sum(F.col(pred).cast("long")).cast("long").alias("n_pred_events"),
        (F.avg(F.col(pred).cast("double")) * F.lit(100.0)).alias("pct_pred_events"),
    ]
    if mm:
        aggs += [F.avg(mm).alias("mean_mm"), F.max(mm).alias("max_mm")]
    return df.agg(*aggs)


def train_percentile(train: DataFrame, features: Sequence[str], scenario: DataFrame) -> DataFrame:
    """For a one-row scenario: per feature the % of training values ≤ the scenario value,
    the training mean and std.  The scenario value is a scalar subquery (exactly one row);
    :func:`train_percentiles` takes any number of rows."""
    aggs = []
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        v = scenario.select(F.col(f).cast("double")).scalar()
        aggs += [
            F.first(v).alias(f"v{i}"),
            (F.avg(F.when(x.isNotNull(), (x <= v).cast("double"))) * F.lit(100.0)).alias(f"p{i}"),
            F.avg(x).alias(f"m{i}"),
            F.stddev_samp(x).alias(f"s{i}"),
        ]
    return _long(
        train.agg(*aggs),
        [
            F.struct(F.lit(f).alias("feature"), F.col(f"v{i}").alias("value"), F.col(f"p{i}").alias("percentile"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
            for i, f in enumerate(features)
        ],
    )


def train_percentiles(train: DataFrame, features: Sequence[str], rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """For every row of ``rows``: ``(*key, feature, value, percentile, mean, std)``, the % of training values
    up to its value and the training mean and std.  A table of any size, against training rows of any number.

    The values of both tables are counted together (a value only asked for counts 0), dealt into sampled
    ranges and summed up along them; each row then finds its own value there by equality.  NaN counts as
    NULL; a NULL value, and a feature without training values, has no percentile.
    """
    double = {f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features}
    cells = F.inline(F.array(*[F.struct(F.lit(f).alias("column"), x.alias("value")) for f, x in double.items()]))
    both = train.select(cells).withColumn("n", F.lit(1)).unionByName(rows.select(cells).withColumn("n", F.lit(0)))
    counts = both.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.sum("n").alias("n"))
    places = running_counts(range_buckets(counts, "column", "value")).select("column", "value", "__upto", "__total")
    stats = _long(
        train.agg(*[a for i, x in enumerate(double.values()) for a in (F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"))]),
        [F.struct(F.lit(f).alias("column"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std")) for i, f in enumerate(features)],
    )
    # rows without a value match nothing: they are spread over tasks of their own
    names = {"column": "__column", "value": "__value"}
    own = [F.col(f"`{k}`") for k in key]
    asked = rows.select(*own, cells.alias("__column", "__value"))
    asked = asked.withColumn("__spread", F.when(F.col("__value").isNull(), F.pmod(F.xxhash64(*own), F.lit(1024)) + 1).otherwise(F.lit(0).cast("long")))
    places = places.withColumnsRenamed(names).withColumn("__spread", F.lit(0).cast("long"))
    found = asked.join(places, [*names.values(), "__spread"], "left").join(stats.withColumnsRenamed({**names, "mean": "__mean", "std": "__std"}), "__column")
    share = F.col("__upto") * F.lit(100.0) / F.when(F.col("__total") > 0, F.col("__total"))
    return found.select(*own, F.col("__column").alias("feature"), F.col("__value").alias("value"), share.alias("percentile"), F.col("__mean").alias("mean"), F.col("__std").alias("std"))
