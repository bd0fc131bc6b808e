"""Relational building blocks shared by the jobs.

Every function returns a lazy DataFrame; none collects to the driver. Joins carry no
broadcast hint: a side that is not ``merged`` is broadcast only when its size (the planner's conservative
estimate, or the measured size of the materialised stage under AQE) is under
``spark.sql.autoBroadcastJoinThreshold``; otherwise the join stays a sort-merge join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.exprs import yes_no, zero_if_null_or_negative


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a join side that is shuffled whatever its size.

    For lookups that grow with the products in a job that has many of them: the driver
    would build every one that is still under the broadcast limit, several times its size.
    """
    return df.hint("merge")


def not_in(df: DataFrame, key: str, subquery: DataFrame, sub_key: str, merge: bool = False) -> DataFrame:
    """Rows of ``df`` whose ``key`` is NOT IN ``subquery.sub_key`` (SQL semantics).

    SQL ``NOT IN`` is null-aware: one NULL in the subquery removes every row, and a
    NULL key is removed unless the subquery is empty. Spark plans a null-aware anti
    join only as a broadcast; beyond the broadcast limit it falls back to a nested-loop
    join. Here:

    * one scalar subquery classifies the subquery as empty (0), without NULLs (1) or
      with a NULL (2); rows are kept only when it is not 2. The predicate names no
      column, so Catalyst does not copy it into every table joined on the key;
    * the exclusion is a hash anti join with null-safe equality against the non-null
      values plus one NULL row when the subquery is not empty (the same scalar decides
      it), which removes NULL keys exactly when SQL does. It is broadcast or shuffled
      by size like any other join, or always shuffled with ``merge``.
    """
    values = subquery.select(F.col(sub_key).alias("_nin_key"))
    rows, non_nulls = F.count(F.lit(1)), F.count(F.col("_nin_key"))
    mode = values.select(F.when(rows == 0, 0).when(non_nulls == rows, 1).otherwise(2)).scalar()
    kept = df.where(mode != 2)
    key_type = values.schema["_nin_key"].dataType
    null_row = (df.sparkSession.range(1).where(mode != 0)
                .select(F.lit(None).cast(key_type).alias("_nin_key")))
    build = values.where(F.col("_nin_key").isNotNull()).unionByName(null_row)
    build = merged(build) if merge else build
    return kept.join(build, kept[key].eqNullSafe(build["_nin_key"]), "left_anti")


def not_in_by_key(df: DataFrame, key: str, subquery: DataFrame, sub_key: str) -> DataFrame:
    """``not_in`` for a large ``df`` whose key repeats: the exclusion is decided once for each
    distinct key (combined map-side), and the rows meet the keys that stay in a join.

    The rows are dealt out by ``key`` once, and the join is by plain equality, so that later
    joins and groupings by it need no other shuffle; rows with a NULL key, which the join
    would lose, stay exactly when the subquery is empty.
    """
    keys = not_in(df.select(F.col(key).alias("_nik_key")).distinct(), "_nik_key", subquery, sub_key)
    keys = keys.where(F.col("_nik_key").isNotNull()).withColumn("_nik_kept", F.lit(True))
    empty = subquery.select(F.count(F.lit(1)) == 0).scalar()
    return (df.repartition(key).join(keys, F.col(key) == F.col("_nik_key"), "left")
            .where(F.col("_nik_kept") | (F.col(key).isNull() & empty)).drop("_nik_key", "_nik_kept"))


def with_not_in_truth(df: DataFrame, key: str, subquery: DataFrame, sub_key: str, name: str) -> DataFrame:
    """Add ``name`` = the SQL truth value (TRUE / FALSE / NULL) of ``key NOT IN (subquery)``.

    For a NOT IN inside an OR, where it cannot be applied as a row filter: empty
    subquery -> TRUE; NULL key -> NULL; member -> FALSE; a NULL in the subquery -> NULL;
    otherwise TRUE. Membership is an existence join against the non-null values.
    """
    values = subquery.select(F.col(sub_key).alias("_nit_key"))
    rows, non_nulls = F.count(F.lit(1)), F.count(F.col("_nit_key"))
    mode = values.select(F.when(rows == 0, 0).when(non_nulls == rows, 1).otherwise(2)).scalar()
    member = F.col(key).isin(values.where(F.col("_nit_key").isNotNull()))
    truth = (F.when(mode == 0, F.lit(True))
             .when(F.col(key).isNull(), F.lit(None).cast("boolean"))
             .when(member, F.lit(False))
             .when(mode == 2, F.lit(None).cast("boolean"))
             .otherwise(F.lit(True)))
    return df.withColumn(name, truth)


def not_in_all(df: DataFrame, key: str, subqueries: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """``key NOT IN (s1) AND key NOT IN (s2) AND ...`` as one ``NOT IN (s1 UNION ALL s2 ...)``.

    The two are the same under SQL's null rules: a NULL in any list removes every row;
    a NULL key survives only when every list is empty; otherwise it is membership in
    the union. One test instead of several saves a scalar subquery per list.
    """
    union = None
    for sub, col in subqueries:
        part = sub.select(F.col(col).alias("_nin_any"))
        union = part if union is None else union.unionByName(part)
    return not_in(df, key, union, "_nin_any")


def exclude_parents(df: DataFrame, set_items: DataFrame, key: str = "product_id", merge: bool = False) -> DataFrame:
    """``key NOT IN (SELECT parent_product_id FROM set_items)``."""
    return not_in(df, key, set_items, "parent_product_id", merge)


def membership_flag(df: DataFrame, product_list: DataFrame, name: str,
                    key: str = "product_id") -> DataFrame:
    """Add ``name`` = 'YES' when ``key`` is in the list, else 'NO' (also for NULL).

    An IN subquery in a projection, which Spark plans as an existence join: duplicate
    list entries never multiply rows and need no de-duplication shuffle.
    """
    return df.withColumn(name, yes_no(F.col(key).isin(product_list.select("product_id"))))


# (period, type, field) -> output column, for the classification pivot.
ClassSpec = Sequence[tuple[tuple[str, str], str, str]]


def class_wide(classifications: DataFrame, spec: ClassSpec) -> DataFrame:
    """One row per product with the requested (period, type) fields as columns.

    Replaces one left join per classification slice by a single conditional
    aggregation (one shuffle of the classification rows). This is exact when
    (product_id, period, type) is unique, which is the table's key; a second row of a
    requested slice fails the job with a message that names the key.
    """
    slices = sorted({s for s, _, _ in spec})
    cond_of = {s: (F.col("period") == s[0]) & (F.col("type") == s[1]) for s in slices}
    wanted = None
    for s in slices:
        wanted = cond_of[s] if wanted is None else wanted | cond_of[s]
    aggs = []
    for s, field, alias in spec:
        type_ = classifications.schema[field].dataType
        twice = F.raise_error(F.concat(
            F.lit(f"classifications has several rows of ({s[0]}, {s[1]}) for product "),
            F.col("product_id").cast("string"))).cast(type_)
        aggs.append(F.when(F.count(F.when(cond_of[s], 1)) > 1, twice)
                    .otherwise(F.max(F.when(cond_of[s], F.col(field)))).alias(alias))
    # a row without product_id joins nothing, so it is no duplicate either
    return classifications.where(wanted & F.col("product_id").isNotNull()).groupBy("product_id").agg(*aggs)


def class_slice(classifications: DataFrame, slice_: tuple[str, str],
                fields: dict[str, str]) -> DataFrame:
    """The rows of one (period, type) slice, for a single-slice left join.

    Used where a job needs just one slice, so the literal join is kept (no
    aggregation, no shuffle of the other slices).
    """
    period, ctype = slice_
    return (classifications.where((F.col("period") == period) & (F.col("type") == ctype))
            .select(F.col("product_id").alias("_cls_pid"),
                    *[F.col(src).alias(dst) for src, dst in fields.items()]))


def join_slice(df: DataFrame, classifications: DataFrame, slice_: tuple[str, str],
               fields: dict[str, str], key: str = "product_id") -> DataFrame:
    s = class_slice(classifications, slice_, fields)
    return df.join(s, df[key] == s["_cls_pid"], "left").drop("_cls_pid")


def open_po(pending_po: DataFrame, statuses: dict[str, int]) -> DataFrame:
    """Open purchase quantity per product and status as columns (NULL when none).

    One conditional aggregation over the live (not soft-deleted) rows replaces one
    filtered aggregate per status; the caller's left join keeps only its products.
    """
    live = pending_po.where(F.col("deleted_at").isNull()
                            & F.col("status_id").isin(*statuses.values()))
    return live.groupBy("product_id").agg(*[
        F.sum(F.when(F.col("status_id") == code, F.col("qty"))).alias(name)
        for name, code in statuses.items()
    ])


def with_open_po(df: DataFrame, pending_po: DataFrame, statuses: dict[str, int],
                 floor_negative: Sequence[str] = (), key: str = "PRODUCT_ID") -> DataFrame:
    """Left join the open quantities; NULL -> 0, and NULL/negative -> 0 for
    ``floor_negative`` columns."""
    po = open_po(pending_po, statuses)
    po = po.select(F.col("product_id").alias("_po_pid"), *[F.col(n).alias(f"_po_{n}") for n in statuses])
    joined = df.join(merged(po), df[key] == po["_po_pid"], "left")
    cols = {}
    for name in statuses:
        raw = F.col(f"_po_{name}")
        cols[name] = (zero_if_null_or_negative(raw) if name in floor_negative
                      else F.coalesce(raw, F.lit(0).cast("long")))
    return joined.withColumns(cols).drop("_po_pid", *[f"_po_{n}" for n in statuses])


def category_paths(categories: DataFrame) -> DataFrame:
    """main category id -> (CATEGORY, ROOT_CATEGORY) names: the two-hop lookup once."""
    main = categories.select(F.col("category_id").alias("main_category_id"),
                             F.col("root_category_id").alias("_root_id"),
                             F.col("name_nl").alias("CATEGORY"))
    root = categories.select(F.col("category_id").alias("_rid"), F.col("name_nl").alias("ROOT_CATEGORY"))
    return (main.join(root, main["_root_id"] == root["_rid"], "left")
            .select("main_category_id", "CATEGORY", "ROOT_CATEGORY"))


def with_categories(df: DataFrame, categories: DataFrame, key: str = "main_category_id") -> DataFrame:
    paths = category_paths(categories).withColumnRenamed("main_category_id", "_mcid")
    return df.join(paths, df[key] == paths["_mcid"], "left").drop("_mcid")


def with_name(df: DataFrame, dim: DataFrame, dim_key: str, df_key: str, name: str,
              extra: dict[str, str] | None = None) -> DataFrame:
    """Left join a dimension on its id and take its ``name`` (plus ``extra`` columns)."""
    cols = [F.col(dim_key).alias(f"_{name}_k"), F.col("name").alias(name)]
    cols += [F.col(src).alias(dst) for src, dst in (extra or {}).items()]
    d = dim.select(*cols)
    return df.join(d, df[df_key] == d[f"_{name}_k"], "left").drop(f"_{name}_k")


def report_order(sort_key: str, *tie_breakers: str) -> list[Column]:
    """``sort_key`` descending (NULLs last), then the row's key columns ascending.

    The reports sort by one column only, and most rows can share a value (an order
    quantity of 0). A global sort range-partitions on all its keys, so the tie-breakers
    let Spark spread equal sort values over many tasks instead of one.
    """
    return [F.col(sort_key).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tie_breakers]]


OPEN_PO_ALL = {"ORDERED": P.PO_ORDERED, "CONFIRMED": P.PO_CONFIRMED,
               "BACKORDER": P.PO_BACKORDER, "RECEIVED": P.PO_RECEIVED}
OPEN_PO_CONF_BACK = {"CONFIRMED": P.PO_CONFIRMED, "BACKORDER": P.PO_BACKORDER}
