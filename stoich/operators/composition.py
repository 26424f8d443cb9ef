"""Composition operators on the canonical long form
``(sample_id, element, amount)`` (D4), plus element feature tables
``(element, feature_id, value)`` (D8).

Per-sample groups hold at most one row per element, so every window or
aggregate keyed by sample is bounded by the number of elements, whatever the
number of samples.  Element feature tables are bounded by elements x
features and are broadcast behind a row-count check.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stoich.session import cut_lineage

# Upper bound on an element-feature table we broadcast (elements x features x kinds).
FEATURE_TABLE_MAX_ROWS = 5_000_000


def normalise_rows(comp: DataFrame, amount: str = "amount", out: str = "share",
                   places: int | None = None, sample: str = "sample_id") -> DataFrame:
    """Amount / row sum per sample; zero-sum rows give null (try_divide)."""
    tot = F.sum(amount).over(Window.partitionBy(sample))
    share = F.try_divide(F.col(amount), tot)
    if places is not None:
        share = F.bround(share, places)
    return comp.withColumn(out, share)


def select_labels(comp: DataFrame, labels: Sequence[str], keep_duplicates: bool = False,
                  value: str = "amount", sample: str = "sample_id") -> DataFrame:
    """The wide matrix of the listed labels, in the listed order.

    One aggregate keyed by sample with a conditional sum per label (absent
    element -> 0.0).  A label listed twice yields a second column (suffix
    ``__2``) only with ``keep_duplicates=True``.
    """
    seen: dict[str, int] = {}
    cols = []
    for lab in labels:
        seen[lab] = seen.get(lab, 0) + 1
        if seen[lab] > 1 and not keep_duplicates:
            continue
        name = safe_name(lab) + (f"__{seen[lab]}" if seen[lab] > 1 else "")
        cols.append((lab, name))
    return comp.groupBy(sample).agg(*[
        F.coalesce(F.sum(F.when(F.col("element") == lab, F.col(value))), F.lit(0.0)).alias(name)
        for lab, name in cols])


def safe_name(label: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in label)


def weighted_features(comp: DataFrame, features: DataFrame, share: str = "share",
                      sample: str = "sample_id", by_kind: bool = False,
                      exact_sum: bool = False) -> DataFrame:
    """Sum over elements of share(e) * feature(e), per (sample, feature).

    The feature table is bounded (elements x features) and broadcast after a
    size check; the aggregate keeps the sample partitioning of ``comp``.
    ``exact_sum=True`` sums each term in fixed point (units of 1e-12) with
    integers, so the result does not depend on the order of addition
    (bit-identical across partitionings and engines).  A sample's shares then
    travel as one array to a matrix of the features, and become one row per
    feature only at the end.
    """
    keys = ["kind"] if by_kind else []
    table = cut_lineage(features.select("element", *keys, "feature_id", "value"))
    n = table.limit(FEATURE_TABLE_MAX_ROWS + 1).count()
    if exact_sum and n <= FEATURE_MATRIX_MAX_ROWS:
        weighted = WeightedMatrix._of_table(comp, table, share, sample, keys)
        if weighted is not None:
            return weighted.long()
    joined = comp.select(sample, "element", share).join(
        F.broadcast(table) if n <= FEATURE_TABLE_MAX_ROWS else table, "element")
    prod = F.col(share) * F.col("value")
    agg = fixed_point_sum(prod) if exact_sum else F.sum(prod)
    return joined.groupBy(sample, *keys, "feature_id").agg(agg.alias("value"))


# Feature values that travel to the tasks as one dense matrix.
FEATURE_MATRIX_MAX_ROWS = 200_000


@dataclass
class WeightedMatrix:
    """Fixed-point weighted features: one array of (element, share) per sample
    in ``packed`` (sample, _parts, further columns), and the element features as
    a matrix that travels to the tasks.  Features are computed in the pass that
    reads them, so a sample takes the room of its few shares on disk and in a
    shuffle."""

    packed: DataFrame
    sample: str
    elements: dict[str, int]
    matrix: np.ndarray
    held: np.ndarray                # which (element, feature) there are
    columns: pd.DataFrame           # kind if any, feature_id; in this order
    fields: dict[str, T.DataType]

    @staticmethod
    def of(comp: DataFrame, features: DataFrame, share: str = "share", sample: str = "sample_id",
           keys: Sequence[str] = ()) -> WeightedMatrix | None:
        """None where the features are too many or not unique."""
        table = cut_lineage(features.select("element", *keys, "feature_id", "value"))
        if table.limit(FEATURE_MATRIX_MAX_ROWS + 1).count() > FEATURE_MATRIX_MAX_ROWS:
            return None
        return WeightedMatrix._of_table(comp, table, share, sample, list(keys))

    @staticmethod
    def _of_table(comp: DataFrame, table: DataFrame, share: str, sample: str, keys: list[str]) -> WeightedMatrix | None:
        known = table.where(F.col("element").isNotNull()).toPandas()
        if known.duplicated(["element", *keys, "feature_id"]).any():
            return None
        elements = {e: i for i, e in enumerate(sorted(known["element"].unique()))}
        columns = known[[*keys, "feature_id"]].drop_duplicates().sort_values([*keys, "feature_id"]).reset_index(drop=True)
        place = {t: i for i, t in enumerate(columns.itertuples(index=False, name=None))}
        shape = (len(elements), len(columns))
        matrix, held = np.full(shape, np.nan), np.zeros(shape, bool)
        row = known["element"].map(elements).to_numpy()
        col = np.fromiter((place[t] for t in known[[*keys, "feature_id"]].itertuples(index=False, name=None)), int,
                          len(known))
        matrix[row, col], held[row, col] = known["value"].to_numpy(float), True
        return WeightedMatrix(pack_shares(comp, share, sample), sample, elements, matrix, held, columns, {f.name: f.dataType for f in table.schema})

    @property
    def dense(self) -> bool:
        """Whether every element has every feature."""
        return bool(self.held.all())

    def written(self) -> WeightedMatrix:
        """The same with the samples' shares written once."""
        return replace(self, packed=cut_lineage(self.packed))

    def joined(self, other: DataFrame) -> WeightedMatrix:
        """The samples of ``other`` with its further columns."""
        return replace(self, packed=self.packed.join(other, self.sample))

    def known(self) -> WeightedMatrix:
        """Only the samples that have features: those with a known element."""
        return self.tagged(lambda rows: rows.where(F.exists("_parts", lambda p: p["element"].isin(list(self.elements)))))

    def tagged(self, tag: Callable[[DataFrame], DataFrame]) -> WeightedMatrix:
        """With the columns that ``tag`` adds to the table of samples."""
        return replace(self, packed=tag(self.packed))

    def some(self, n: int) -> WeightedMatrix:
        """At most ``n`` of the samples, by the hash of their ids."""
        return self.tagged(lambda rows: rows.orderBy(F.xxhash64(self.sample), self.sample).limit(n))

    def long(self) -> DataFrame:
        """(sample, kind if any, feature_id, value)"""
        names = list(self.columns.columns)
        schema = T.StructType([self.packed.schema[self.sample], *[T.StructField(k, self.fields[k]) for k in names],
                               T.StructField("value", T.DoubleType())])
        shared = self._shared()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, some, total, used, empty, columns in _weighted(batches, shared):
                r, c = np.nonzero(used)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(some[r])),
                     *[pa.Array.from_pandas(columns[k]).take(pa.array(c)) for k in columns.columns],
                     pa.array(total[r, c], mask=empty[r, c])], names=schema.names)

        return self.packed.select(self.sample, "_parts").mapInArrow(run, schema)

    def arrays(self, out: str = "features", finish: Callable | None = None) -> DataFrame:
        """(sample, ``out``, further columns): the features of every sample as
        one array in the order of their ids, as :func:`feature_array` makes it;
        ``finish`` maps the values."""
        more = [f for f in self.packed.schema if f.name not in (self.sample, "_parts")]
        schema = T.StructType([self.packed.schema[self.sample], T.StructField(out, T.ArrayType(T.DoubleType())), *more])
        shared = self._shared()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, some, total, used, empty, _ in _weighted(batches, shared):
                value = total if finish is None else finish(total)
                ends = np.concatenate([[0], np.cumsum(used.sum(axis=1))]).astype(np.int32)
                own = pa.array(some)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(own), pa.ListArray.from_arrays(ends, pa.array(value[used], mask=empty[used])),
                     *[part.column(i).take(own) for i in range(2, part.num_columns)]], names=schema.names)

        return self.packed.select(self.sample, "_parts", *[f.name for f in more]).mapInArrow(run, schema)

    def _shared(self):
        return self.packed.sparkSession.sparkContext.broadcast((self.elements, self.matrix, self.held, self.columns))


def pack_shares(comp: DataFrame, share: str = "share", sample: str = "sample_id") -> DataFrame:
    """(sample, _parts): the elements and shares of a sample as one array."""
    return (comp.select(sample, "element", F.col(share).cast("double").alias("_share"))
            .groupBy(sample).agg(F.collect_list(F.struct("element", "_share")).alias("_parts")))


def _weighted(batches: Iterator[pa.RecordBatch], shared) -> Iterator[tuple]:
    """(rows, which of them have a known element, sums, whether there is such a
    sum, whether it is null, columns) of pieces of the batches."""
    numbers, values, has, columns = shared.value
    ids, every = pa.array(list(numbers), pa.string()), bool(has.all())
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            lists = part.column(1)
            flat = lists.flatten()
            which = pc.fill_null(pc.index_in(flat.field(0), ids), -1).to_numpy(zero_copy_only=False)
            own = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            weight = flat.field(1).to_numpy(zero_copy_only=False)
            own, weight, which = own[which >= 0], weight[which >= 0], which[which >= 0]
            some, begin, count = np.unique(own, return_index=True, return_counts=True)
            if not len(some):
                continue
            add = lambda v: _sum_of_runs(v, begin, count)  # noqa: B023, E731
            term = weight[:, None] * values[which]
            used, empty = np.ones((len(some), len(columns)), bool), np.zeros((len(some), len(columns)), bool)
            if not every:
                used = add(has[which].astype(np.int64)) > 0
            real = ~np.isnan(term)
            if not real.all():
                term = np.where(real, term, 0.0)
                empty = add(real.astype(np.int64)) == 0
            whole = np.floor(term)
            rest = np.floor((term - whole) * FIXED_POINT_SCALE + 0.5)
            if len(term) and np.abs(whole).max(initial=0.0) >= WHOLE_LIMIT:
                raise OverflowError("a weighted feature is too large for a fixed-point sum")
            total = (add(whole.astype(np.int64)).astype(np.float64)
                     + add(rest.astype(np.int64)).astype(np.float64) / FIXED_POINT_SCALE)
            yield part, some, total, used, empty, columns


def _sum_of_runs(v: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; a run is one sample's elements, so there are few
    steps, each on whole rows."""
    out = v[begin]
    for j in range(1, int(count.max())):
        more = np.flatnonzero(count > j)
        out[more] += v[begin[more] + j]
    return out


ROWS_AT_ONCE = 2_000
WHOLE_LIMIT = 2.0 ** 53         # whole parts beyond it are not added exactly


FIXED_POINT_SCALE = 1e12


def fixed_point_sum(x: Column, scale: float = FIXED_POINT_SCALE) -> Column:
    """Order-independent sum: whole parts and fractions (rounded to 1/scale)
    are added as integers of up to 38 digits, so neither large terms nor many
    terms overflow."""
    whole = F.floor(x)
    part = F.floor((x - whole) * F.lit(scale) + F.lit(0.5))
    wide = "decimal(20,0)"
    return F.sum(whole.cast(wide)).cast("double") + F.sum(part.cast(wide)).cast("double") / F.lit(scale)


def sql_fixed_point_sum(expr: str, scale: float = FIXED_POINT_SCALE) -> str:
    return (f"(CAST(sum(CAST(floor({expr}) AS BIGINT)) AS DOUBLE)"
            f" + CAST(sum(CAST(floor((({expr}) - floor({expr})) * {scale!r} + 0.5) AS BIGINT)) AS DOUBLE) / {scale!r})")


def feature_array(long: DataFrame, key: str = "sample_id", extra: Sequence[str] = ()) -> DataFrame:
    """Long (key, feature_id, value) -> (key, features array<double>) ordered by
    feature id; a group is one sample's features (bounded)."""
    return (long.groupBy(key, *extra)
            .agg(F.array_sort(F.collect_list(F.struct("feature_id", "value"))).alias("_fv"))
            .select(key, *extra, F.transform("_fv", lambda s: s["value"]).alias("features")))


def select_features(df: DataFrame, idx: Sequence[int], features: str = "features",
                    out: str = "selected") -> DataFrame:
    """Keep the chosen feature indices (0-based), in the chosen order."""
    idx_arr = F.array(*[F.lit(int(i) + 1) for i in idx])
    return df.withColumn(out, F.transform(idx_arr, lambda i: F.element_at(F.col(features), i)))


def signature(share_long: DataFrame, labels: Sequence[str], share: str = "share",
              places: int = 8, sample: str = "sample_id", sep: str = "|") -> DataFrame:
    """X7: '%.8f' of each label's share (0 if absent), joined by ``sep``, in
    label order.  Values are rounded half-even first so formatting is exact."""
    pos = {lab: i for i, lab in enumerate(labels)}
    lab_pos = F.create_map(*[x for lab, i in pos.items() for x in (F.lit(lab), F.lit(i))])
    fmt = f"%.{places}f"
    per_sample = (share_long.where(F.col("element").isin(list(labels)))
                  .groupBy(sample)
                  .agg(F.map_from_entries(F.collect_list(F.struct(
                      lab_pos[F.col("element")], F.bround(F.col(share), places)))).alias("_m")))
    vals = [F.format_string(fmt, F.coalesce(F.col("_m")[F.lit(i)], F.lit(0.0)) + F.lit(0.0))
            for i in range(len(labels))]
    return per_sample.select(sample, F.concat_ws(sep, *vals).alias("signature"))


def signature_of_parts(rows: DataFrame, labels: Sequence[str], places: int = 8, sample: str = "sample_id",
                       sep: str = "|") -> DataFrame:
    """X7 of packed shares (:func:`pack_shares`), a row per row; only the labels
    that a sample holds are formatted."""
    fmt = f"%.{places}f"
    own = F.filter("_parts", lambda p: p["element"].isin(list(labels)))
    held = F.map_from_entries(F.transform(own, lambda p: F.struct(p["element"], F.format_string(
        fmt, F.coalesce(F.bround(p["_share"], places), F.lit(0.0)) + F.lit(0.0)))))
    vals = [F.coalesce(F.col("_m")[F.lit(v)], F.lit(fmt % 0)) for v in labels]
    return rows.select(sample, held.alias("_m")).select(sample, F.concat_ws(sep, *vals).alias("signature"))


def composition_key(values: Column, places: int = 4, sep: str = "*") -> Column:
    """X6 encode: rounded (half-even) values formatted and joined by ``sep``."""
    fmt = f"%.{places}f"
    return F.array_join(F.transform(values, lambda v: F.format_string(fmt, F.bround(v, places) + F.lit(0.0))), sep)


def decode_key(key: Column, sep: str = "*") -> Column:
    """X6 decode: split the key and cast back to doubles."""
    return F.transform(F.split(key, "\\" + sep if sep in "*|.+?" else sep), lambda s: s.cast("double"))


def reject_unwanted(comp: DataFrame, unwanted: Sequence[str], amount: str = "amount",
                    sample: str = "sample_id") -> DataFrame:
    """drop samples with any non-zero (or null) amount of an unwanted
    element.  Long form: anti join to the offending sample ids."""
    offenders = (comp.where(F.col("element").isin(list(unwanted))
                            & (F.col(amount).isNull() | (F.col(amount) != 0)))
                 .select(sample).distinct())
    return comp.join(offenders, sample, "left_anti")


def reject_other_columns(comp: DataFrame, allowed: Sequence[str], amount: str = "amount",
                         sample: str = "sample_id") -> DataFrame:
    """drop samples with a non-zero amount in any element not in
    ``allowed``; then keep only the allowed elements."""
    offenders = (comp.where(~F.col("element").isin(list(allowed))
                            & (F.col(amount).isNull() | (F.col(amount) != 0)))
                 .select(sample).distinct())
    return comp.join(offenders, sample, "left_anti").where(F.col("element").isin(list(allowed)))


def sum_window(comp: DataFrame, amount: str = "amount", sample: str = "sample_id") -> DataFrame:
    """keep samples whose round(sum, 4) is in [99.9, 100.1] (percent) or
    (0.998, 1.02] (fraction)."""
    s = F.bround(F.sum(amount).over(Window.partitionBy(sample)), 4)
    ok = s.between(99.9, 100.1) | ((s > 0.998) & (s <= 1.02))
    return comp.withColumn("_ok", ok).where("_ok").drop("_ok")


def within_bounds(comp_share: DataFrame, bounds: dict[str, tuple[float, float]],
                  share: str = "share", sample: str = "sample_id") -> DataFrame:
    """per sample, true iff every bounded element's share is in [lo, hi];
    a bounded element absent from the sample counts as share 0.

    ``bounds`` is a small parameter map, so lo/hi are literal map lookups: no
    join, one aggregate keyed by sample.
    """
    lo = F.create_map(*[x for e, (a, _) in bounds.items() for x in (F.lit(e), F.lit(float(a)))])
    hi = F.create_map(*[x for e, (_, b) in bounds.items() for x in (F.lit(e), F.lit(float(b)))])
    zero_bad = [e for e, (a, b) in bounds.items() if not (a <= 0.0 <= b)]
    v = F.coalesce(F.col(share), F.lit(0.0))
    bounded = F.col("element").isin(list(bounds))
    out = bounded & ((v < lo[F.col("element")]) | (v > hi[F.col("element")]))
    return comp_share.groupBy(sample).agg(
        ((F.count_if(out) == 0)
         & (F.count_if(F.col("element").isin(zero_bad) if zero_bad else F.lit(False))
            == F.lit(len(zero_bad)))).alias("in_bounds"))


def nonzero_counts(comp: DataFrame, amount: str = "amount") -> DataFrame:
    """A1: rows with a non-zero amount per element, only elements with > 0."""
    return (comp.groupBy("element").agg(F.count_if(F.col(amount) != 0).alias("n_nonzero"))
            .where(F.col("n_nonzero") > 0))
