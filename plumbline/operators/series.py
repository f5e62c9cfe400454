"""Ordered series: dense indices, bounded frames and prefix scans.

Every order-dependent operator of the library is built on :class:`Sequence`, a
table whose rows carry ``idx``, their dense 0-based position inside their key
(series columns + phase).

One Spark window puts a whole key into one task.  That is the best plan while
every key is small, and impossible once one key holds a third of the table.  So
``sequence`` first counts the largest key (an aggregation over the key columns,
combined before the shuffle) and picks one of two forms:

* *plain*: ``Window.partitionBy(keys).orderBy(idx)``; one shuffle, one sort.
* *blocked*: a range partitioning of the whole table over (keys, order) yields
  ``idx``; from then on rows are cut into blocks of ``block_rows`` rows by
  ``idx``, and every window is partitioned by (keys, block).  Frames that look
  back over a bounded number of rows get copies of the last rows of the block
  before; scans get a carry from a table with one row per block.

Both forms give the same results; tests compare them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from plumbline.session import block_rows as configured_block_rows
from plumbline.session import durable

PHASE = "phase"
IDX = "idx"
BLOCK = "_block"


#: Columns of charts, which therefore cannot be names of series.
RESERVED = frozenset({
    IDX, PHASE, "value", "ucl", "cl", "lcl", "zone_cl", "zone_sigma", "subgroup", "n", "excluded", "label",
    "center", "sigma_hat", "method", "n_used",
})


def listed(columns: str | Iterable[str] | None) -> list[str]:
    if columns is None:
        return []
    return [columns] if isinstance(columns, str) else list(columns)


@dataclass(frozen=True)
class Roles:
    """Which column plays which part.  ``order`` must be unique within a series.

    ``excluded`` names a boolean column: rows that are charted but not estimated from.
    """

    value: str
    order: str | tuple[str, ...]
    series: str | tuple[str, ...] = ()
    phase: str | None = None
    subgroup: str | None = None
    excluded: str | None = None

    def __post_init__(self) -> None:
        taken = RESERVED & set(self.series_columns)
        if taken:
            raise ValueError(f"series columns {sorted(taken)} have names of chart columns: rename them first")

    @property
    def order_columns(self) -> list[str]:
        return listed(self.order)

    @property
    def series_columns(self) -> list[str]:
        return listed(self.series)

    @property
    def keys(self) -> list[str]:
        return [*self.series_columns, PHASE]

    @property
    def single(self) -> bool:
        """All rows are one series and one phase."""
        return not self.series_columns and self.phase is None


def join_keys(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", *, nulls: bool = True
) -> DataFrame:
    """Join on ``keys``; those of ``left`` are kept.

    ``nulls=False`` says that no key is null: plain equality can use a partitioning
    by the keys that is already there, null-safe equality cannot.

    No side is broadcast by hint: AQE broadcasts the small side once it has seen
    its size, and splits skewed partitions of a sort-merge join otherwise.
    """
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = None
    for k in keys:
        mine, theirs = F.col(k), F.col(f"_right_{k}")
        same = mine.eqNullSafe(theirs) if nulls else mine == theirs
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def attach_row(left: DataFrame, right: DataFrame) -> DataFrame:
    """The columns of a one-row table on every row: a scalar subquery, not a join."""
    row = right.agg(F.first(F.struct(*right.columns))).scalar()
    return left.withColumns({c: row.getField(c) for c in right.columns})


@dataclass(frozen=True)
class Sizes:
    largest: int
    total: int
    nulls: bool


def group_sizes(df: DataFrame, keys: list[str]) -> Sizes:
    """Rows of the largest key, rows in all, and whether any key is null.

    Rows are counted with a partial aggregation; one row is collected.
    """
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | F.col(k).isNull()
    row = (
        df.groupBy(*keys).count()
        .agg(F.max("count"), F.sum("count"), F.max(some_null.cast("int")))
        .first()
    )
    return Sizes(row[0] or 0, row[1] or 0, bool(row[2]))


def largest_group(df: DataFrame, keys: list[str]) -> int:
    return group_sizes(df, keys).largest


def phase_column(df: DataFrame, phase: str | None) -> Column:
    """Phase as text; missing, empty and zero phases are ``default``, no column is ``all``."""
    if phase is None:
        return F.lit("all")
    text = F.col(phase).cast("string")
    blank = text.isNull() | (text == "")
    if dict(df.dtypes)[phase] == "boolean":
        blank = blank | ~F.col(phase)
    elif dict(df.dtypes)[phase] not in ("string", "timestamp", "date", "timestamp_ntz"):
        blank = blank | (F.col(phase) == 0)
    return F.when(blank, F.lit("default")).otherwise(text)


# Copies of earlier rows a block is given when it is first cut: enough for a lag and
# all rules in turn.
LOOK_BACK = 64

# Fewest rows per partition of the sort that numbers giant series.  Each partition costs
# the driver some 300 sampled keys and the results of a few tasks, however small it is;
# the sort inside one spills.
SORTED_ROWS = 100_000


@dataclass(frozen=True)
class Sequence:
    """Numbered rows, and how to compute over them.

    ``held`` are the rows; once cut into blocks it also has copies of the rows before
    each block, of which the nearest ``copies`` are still good to look back on.
    ``df`` are the rows alone.
    """

    held: DataFrame
    keys: list[str]
    blocked: bool
    block_rows: int
    order: tuple[str, ...] = ()
    nulls: bool = True
    single: bool = False
    copies: int | None = None
    reserved: int = LOOK_BACK

    # -- plumbing -----------------------------------------------------------
    @property
    def df(self) -> DataFrame:
        return self.held if self.copies is None else self._own().drop(BLOCK)

    def with_df(self, df: DataFrame) -> Sequence:
        """Other rows under the same numbering."""
        return replace(self, held=df, copies=None)

    def with_columns(self, *steps: Mapping[str, Column]) -> Sequence:
        held = self.held
        for step in steps:
            held = held.withColumns(dict(step))
        return replace(self, held=held)

    def drop(self, *columns: str) -> Sequence:
        return replace(self, held=self.held.drop(*columns))

    def reserve(self, rows: int) -> Sequence:
        """Foresee look-backs of ``rows`` in all, so that they share one shuffle."""
        return replace(self, reserved=max(self.reserved, rows))

    def _window(self) -> WindowSpec:
        # Rows are already sorted by the order columns; asking for idx would sort again.
        kept = self.order and set(self.order) <= set(self.held.columns)
        return Window.partitionBy(*self.keys).orderBy(*(self.order if kept else (IDX,)))

    def _block_window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, BLOCK).orderBy(IDX)

    def _home(self) -> Column:
        return F.floor(F.col(IDX) / self.block_rows)

    def _own(self) -> DataFrame:
        return self.held.where(F.col(BLOCK) == self._home())

    def _cut(self, copies: int = 0) -> Sequence:
        """Blocks with at least ``copies`` rows to look back on.

        The windows that follow bring the shuffle by (keys, block); without any, none
        happens.  They would also accept rows hashed by the keys alone, i.e. a giant
        key in one task, so nothing before may leave them so (see ``beside``).
        """
        if self.copies is not None and self.copies >= copies:
            return self
        seq = self.with_df(self.df)
        if copies:
            copies = max(copies, min(self.reserved, self.block_rows))
            seq = replace(seq, block_rows=max(self.block_rows, copies))
        home, size = seq._home(), seq.block_rows
        late = F.col(IDX) % size >= size - copies
        block = F.explode(F.when(late, F.array(home, home + 1)).otherwise(F.array(home)))
        held = seq.held.withColumn(BLOCK, block if copies else home)
        return replace(seq, held=held, copies=copies)

    # -- aggregates of a whole key -------------------------------------------
    def params(
        self, aggregates: Mapping[str, Column], medians: Mapping[str, str] | None = None
    ) -> DataFrame:
        """One row per key."""
        medians = medians or {}
        named = {n: a for n, a in aggregates.items()}
        if not self.blocked:
            named.update({n: F.median(c) for n, c in medians.items()})
        out = self.df.groupBy(*self.keys).agg(*[a.alias(n) for n, a in named.items()])
        if self.blocked:
            for n, c in medians.items():
                out = self.joined(out, medians_of(self.df, self.keys, c, n, blocked=True))
        return out

    def joined(self, left: DataFrame, right: DataFrame, *extra: str, how: str = "left") -> DataFrame:
        """Two tables joined on the keys of this sequence (and ``extra`` columns)."""
        if self.single and not extra and how == "left":
            return attach_row(left, right.drop(*self.keys))
        return join_keys(left, right, [*self.keys, *extra], how, nulls=self.nulls)

    def _by_block(self, params: DataFrame) -> DataFrame:
        """Parameters per block, from those per key and its last position ``_last``."""
        blocks = F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / self.block_rows) + 1)
        return params.withColumn(BLOCK, F.explode(blocks)).drop("_last")

    def beside(self, params: DataFrame) -> Sequence:
        """Parameters of each key on its rows.

        In blocked form every block of a key gets a parameter row of its own, so that no
        task has to read all rows of a giant key; ``params`` may bring the last position
        of each key as ``_last``.  The join is null-safe whatever the keys: Spark then
        hashes expressions of them, never the columns themselves, and a later window over
        (keys, block) shuffles by both.
        """
        if not self.blocked or self.single:
            return self.with_df(self.joined(self.df, params.drop("_last")))
        if "_last" not in params.columns:
            last = self.df.groupBy(*self.keys).agg(F.max(IDX).alias("_last"))
            params = join_keys(params, last, self.keys, "inner")
        rows = self.df.withColumn(BLOCK, self._home())
        return self.with_df(join_keys(rows, self._by_block(params), [*self.keys, BLOCK]).drop(BLOCK))

    def attach(
        self, aggregates: Mapping[str, Column], medians: Mapping[str, str] | None = None
    ) -> Sequence:
        """The same aggregates as columns of every row (each a single aggregate function)."""
        if not self.blocked:
            everything = Window.partitionBy(*self.keys)
            columns = {n: a.over(everything) for n, a in aggregates.items()}
            columns.update({n: F.median(c).over(everything) for n, c in (medians or {}).items()})
            return self.with_columns(columns)
        params = self.params({**aggregates, "_last": F.max(IDX)}, medians)
        if self.copies is None:
            return self.beside(params)
        # The rows stay where they are, copies of earlier ones too.
        return replace(self, held=self.joined(self.held, self._by_block(params), BLOCK))

    # -- bounded frames -------------------------------------------------------
    def frame(self, back: int, *steps: Callable[[WindowSpec], Mapping[str, Column]]) -> Sequence:
        """Add columns computed over at most ``back`` preceding rows of the key."""
        seq = self._cut(back) if self.blocked else self
        window = seq._block_window() if self.blocked else seq._window()
        held = seq.held
        for step in steps:
            held = held.withColumns(dict(step(window)))
        left = seq.copies - back if self.blocked else None
        return replace(seq, held=held, copies=left)

    # -- prefix scans ----------------------------------------------------------
    def _carried(
        self,
        local: Mapping[str, Callable[[WindowSpec], Column]],
        block: Mapping[str, Column],
        carry: Mapping[str, Callable[[WindowSpec], Column]],
        combine: Mapping[str, Column],
        scratch: Iterable[str],
    ) -> Sequence:
        """Scan inside blocks, scan the table of blocks, put both together.

        The scanned rows are read twice, for the table of blocks and for the result;
        they are written once, so that chained scans do not multiply.
        """
        rows, window = self._cut()._own(), self._block_window()
        rows = durable(rows.withColumns({n: f(window) for n, f in local.items()}))
        blocks = rows.groupBy(*self.keys, BLOCK).agg(*[a.alias(n) for n, a in block.items()])
        across = Window.partitionBy(*self.keys).orderBy(BLOCK)
        carries = blocks.select(
            *self.keys, BLOCK, *[f(across).alias(n) for n, f in carry.items()]
        )
        out = self.joined(rows, carries, BLOCK)
        out = out.withColumns(dict(combine)).drop(BLOCK, *scratch, *carry)
        return self.with_df(out)

    def running_sum(self, **columns: Column) -> Sequence:
        if not self.blocked:
            upto = self._window().rowsBetween(Window.unboundedPreceding, 0)
            return self.with_columns({n: F.sum(c).over(upto) for n, c in columns.items()})
        upto = (Window.unboundedPreceding, 0)
        before = (Window.unboundedPreceding, -1)
        return self._carried(
            local={
                f"_l_{n}": (lambda w, c=c: F.sum(c).over(w.rowsBetween(*upto)))
                for n, c in columns.items()
            },
            block={f"_b_{n}": F.sum(c) for n, c in columns.items()},
            carry={
                f"_c_{n}": (lambda w, n=n: F.sum(f"_b_{n}").over(w.rowsBetween(*before)))
                for n in columns
            },
            combine={
                n: F.coalesce(F.col(f"_l_{n}") + F.col(f"_c_{n}"), F.col(f"_l_{n}"))
                for n in columns
            },
            scratch=[f"_l_{n}" for n in columns],
        )

    def last_known(self, **columns: Column) -> Sequence:
        """The latest non-null value at or before each row."""
        return self._known(columns, F.max_by, backwards=False)

    def next_known(self, **columns: Column) -> Sequence:
        """The earliest non-null value at or after each row.

        Rows are read backwards: a frame that ends at the last row of a partition
        would be evaluated anew for every row.
        """
        return self._known(columns, F.min_by, backwards=True)

    def _known(self, columns: Mapping[str, Column], extreme, *, backwards: bool) -> Sequence:
        direction = F.desc if backwards else F.asc

        def known(c, by: list[str], order: str, end: int) -> Column:
            w = Window.partitionBy(*by).orderBy(direction(order))
            return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, end))

        if not self.blocked:
            return self.with_columns({n: known(c, self.keys, IDX, 0) for n, c in columns.items()})
        return self._carried(
            local={
                f"_l_{n}": (lambda w, c=c: known(c, [*self.keys, BLOCK], IDX, 0))
                for n, c in columns.items()
            },
            block={
                f"_b_{n}": extreme(c, F.when(c.isNotNull(), F.col(IDX)))
                for n, c in columns.items()
            },
            carry={
                f"_c_{n}": (lambda w, n=n: known(F.col(f"_b_{n}"), self.keys, BLOCK, -1))
                for n in columns
            },
            combine={n: F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n in columns},
            scratch=[f"_l_{n}" for n in columns],
        )

    # -- exponential smoothing ---------------------------------------------------
    def smoothed(self, lam: float, columns: Mapping[str, tuple[Column, Column]]) -> Sequence:
        """E_i = lam * x_i + (1 - lam) * E_(i-1), E before the first row = start.

        ``columns`` maps a name to (x, start).  Rows are grouped into stretches of
        ``m`` rows, so many that (1 - lam)**m squared is zero in a double: inside a
        stretch E is a weighted running sum without overflow, and from outside only the
        stretch before can add anything.  A block is smoothed from 0, which makes it an
        affine function of what flows in; the functions of a key's blocks are composed
        by doubling.
        """
        if lam == 1.0:
            return self.with_columns({n: x for n, (x, _) in columns.items()})
        decay, m = math.log1p(-lam), stretch_rows(lam)
        seq = self._cut() if self.blocked else self
        by = [*self.keys, *([BLOCK] if self.blocked else [])]
        place = F.col(IDX) % seq.block_rows if self.blocked else F.col(IDX)
        at = place % m + 1
        weight = F.exp(at * decay)
        part = Window.partitionBy(*by, "_stretch").orderBy(IDX).rowsBetween(Window.unboundedPreceding, 0)
        # same sort as the window above: (keys[, block], stretch, idx)
        chain = Window.partitionBy(*by).orderBy("_stretch", IDX)
        rows = seq._own() if self.blocked else self.df
        rows = rows.withColumn("_stretch", F.floor(place / m)).withColumns(
            {f"_l_{n}": weight * F.sum(x * lam * F.exp(-at * decay)).over(part) for n, (x, _) in columns.items()}
        )
        if m < MOST_ROWS:
            fade = math.exp(m * decay)

            def end(n: str) -> Column:
                before = F.coalesce(F.lag(f"_l_{n}", m).over(chain), F.lit(0.0))
                return F.when(at == m, F.col(f"_l_{n}") + fade * before)

            earlier = chain.rowsBetween(Window.unboundedPreceding, -1)
            rows = rows.withColumns({f"_e_{n}": end(n) for n in columns})
            rows = rows.withColumns({f"_e_{n}": F.last(f"_e_{n}", ignorenulls=True).over(earlier) for n in columns})
            rows = rows.withColumns({f"_l_{n}": F.col(f"_l_{n}") + weight * F.coalesce(f"_e_{n}", F.lit(0.0)) for n in columns})
            rows = rows.drop(*[f"_e_{n}" for n in columns])
        rows, kept = rows.drop("_stretch"), F.exp((place + 1) * decay)
        inflow = {n: start for n, (_, start) in columns.items()}
        scratch = [f"_l_{n}" for n in columns]
        if self.blocked:
            rows = durable(rows)
            blocks = rows.groupBy(*by).agg(
                F.exp((F.max(place) + 1) * decay).alias("_a"), *[F.max_by(f"_l_{n}", IDX).alias(f"_b_{n}") for n in columns]
            )

            def compose(earlier: Callable[[str, float], Column]) -> dict[str, Column]:
                sums = {f"_b_{n}": F.col(f"_b_{n}") + F.col("_a") * earlier(f"_b_{n}", 0.0) for n in columns}
                return {"_a": F.col("_a") * earlier("_a", 1.0), **sums}

            carry = scanned_blocks(blocks, self.keys, compose, {"_a": 1.0, **{f"_b_{n}": 0.0 for n in columns}})
            rows = self.joined(rows, carry, BLOCK)
            inflow = {n: F.col("_a") * start + F.col(f"_b_{n}") for n, start in inflow.items()}
            scratch += ["_a", *[f"_b_{n}" for n in columns], BLOCK]
        rows = rows.withColumns({n: F.col(f"_l_{n}") + kept * inflow[n] for n in columns})
        return self.with_df(rows.drop(*scratch))


#: Rows that a window can look back on.
MOST_ROWS = 1 << 30


def stretch_rows(lam: float) -> int:
    """Rows after which (1 - lam)**rows is below 1e-163, the square of which a double holds as zero.

    No more than a window can hold are needed: such a stretch is the only one.
    """
    return min(MOST_ROWS, max(1, math.ceil(math.log(1e-163) / math.log1p(-lam))))


def scanned_blocks(
    blocks: DataFrame,
    keys: list[str],
    compose: Callable[[Callable[[str, float], Column]], Mapping[str, Column]],
    identity: Mapping[str, float],
) -> DataFrame:
    """What all blocks before each block amount to, by doubling over the table of blocks.

    Each block holds an associative function as the columns of ``identity``.
    ``compose(earlier)`` gives the columns of a block's function after an earlier one,
    whose columns are ``earlier(name, value where there is none)``.  After k steps a
    block holds the composition of 2**k blocks; no step subtracts, so nothing cancels.
    """
    blocks = durable(blocks)
    across = Window.partitionBy(*keys).orderBy(BLOCK)

    def lagged(rows: int) -> Callable[[str, float], Column]:
        return lambda name, missing: F.coalesce(F.lag(name, rows).over(across), F.lit(missing))

    last, reach = blocks.agg(F.max(BLOCK)).first()[0] or 0, 1
    while reach < last:
        blocks = blocks.withColumns(dict(compose(lagged(reach))))
        reach *= 2
    before = lagged(1)
    return blocks.select(*keys, BLOCK, *[before(n, v).alias(n) for n, v in identity.items()])


def sequence(
    df: DataFrame,
    keys: str | Iterable[str],
    order: str | Iterable[str],
    *,
    block_rows: int | None = None,
    blocked: bool | None = None,
    sized_by: DataFrame | None = None,
    single: bool = False,
) -> Sequence:
    """Number the rows of every key from 0 in the given order.

    ``sized_by`` is a cheaper table with at least as many rows per key, used for
    the size check; ``blocked`` skips the check.  ``single`` says that the keys are
    constant.
    """
    keys, order = listed(keys), listed(order)
    size = configured_block_rows(df.sparkSession, block_rows)
    sizes = None
    if blocked is None:
        sizes = group_sizes(sized_by if sized_by is not None else df, keys)
        blocked = sizes.largest > size
    nulls = sizes is None or sizes.nulls
    if not blocked:
        window = Window.partitionBy(*keys).orderBy(*order)
        df = df.withColumn(IDX, (F.row_number().over(window) - 1).cast("long"))
    else:
        df = _number_blocked(df, keys, order, size, sizes, nulls)
    return Sequence(df, keys, blocked, size, tuple(order), nulls, single)


def _number_blocked(
    df: DataFrame, keys: list[str], order: list[str], size: int, sizes: Sizes | None, nulls: bool
) -> DataFrame:
    """Dense positions without ever sorting one key in one task.

    The range partitioning follows the data, so its cuts must not be drawn twice:
    the sorted rows are written out once, together with (partition, position), and
    both the table of runs and the rows themselves are read from there.  Blocks are cut
    by position, later, so short ones ask for no more partitions than long ones.
    """
    spark = df.sparkSession
    total = sizes.total if sizes else df.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / max(size, SORTED_ROWS)))
    cuts = [*keys, *order]
    at = "_at"
    sorted_rows = (
        df.repartitionByRange(parts, *cuts)
        .sortWithinPartitions(*cuts)
        .withColumn(at, F.monotonically_increasing_id())
    )
    rows = durable(sorted_rows).withColumns(
        {"_part": F.shiftright(F.col(at), 33), "_pos": F.col(at).bitwiseAND((1 << 33) - 1)}
    )
    runs = rows.groupBy(*keys, "_part").agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = (
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = runs.select(
        *keys,
        "_part",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    return (
        join_keys(rows, shifts, [*keys, "_part"], nulls=nulls)
        .withColumn(IDX, F.col("_pos") + F.col("_shift"))
        .drop(at, "_part", "_pos", "_shift")
    )


def order_statistics(
    df: DataFrame,
    keys: list[str],
    value: str,
    ranks: Mapping[str, Callable[[Column], Column]],
    *,
    blocked: bool | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Exact order statistics per key; ``ranks`` maps a name to n -> 0-based rank.

    Equal values are counted before anything is ordered, so neither a hot value
    nor a giant key has to fit into one task.
    """
    present = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    size = configured_block_rows(df.sparkSession, block_rows)
    if blocked is None:
        blocked = largest_group(present, keys) > size
    counts = present.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    return ranked_counts(counts, keys, ranks, blocked=blocked, block_rows=size)


def ranked_counts(
    counts: DataFrame, keys: list[str], ranks: Mapping[str, Callable[[Column], Column]], *, blocked: bool, block_rows: int
) -> DataFrame:
    """Order statistics per key from values ``_v`` that occur ``_n`` times."""
    size = block_rows
    if blocked:
        # many rows, but perhaps few values: write the counts down and look at them
        seq = sequence(durable(counts), keys, "_v", block_rows=size)
    else:
        seq = sequence(counts, keys, "_v", blocked=False, block_rows=size)
    seq = seq.attach({"_total": F.sum("_n")}).running_sum(_upto=F.col("_n"))

    def hit(rank: Column) -> Column:
        inside = (rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto"))
        return F.max(F.when(inside, F.col("_v")))

    return seq.df.groupBy(*keys).agg(
        *[hit(f(F.col("_total"))).alias(n) for n, f in ranks.items()]
    )


def medians_of(
    df: DataFrame, keys: list[str], value: str, name: str, *, blocked: bool | None = None
) -> DataFrame:
    pair = order_statistics(
        df,
        keys,
        value,
        {"_lo": lambda n: F.floor((n - 1) / 2), "_hi": lambda n: F.floor(n / 2)},
        blocked=blocked,
    )
    return pair.select(*keys, ((F.col("_lo") + F.col("_hi")) / 2.0).alias(name))
