"""Lists of a review portal: changes with their repositories, departments and last scans, filters, totals, details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def latest_scans(scans: DataFrame) -> DataFrame:
    """Of each change (change_id) the scan with the largest scan_id."""
    rest = [c for c in scans.columns if c != "change_id"]
    return scans.groupBy("change_id").agg(F.max_by(F.struct(*rest), "scan_id").alias("s")).select("change_id", "s.*")


def change_list(changes: DataFrame, repos: DataFrame, departments: DataFrame, scans: DataFrame, **wanted: object) -> DataFrame:
    """Every change of a known repository with its repository, its department and last scan where there are any.

    ``changes``: change_id, repo_id, number, status and others. ``repos``: repo_id,
    department_id, ... ``departments``: department_id, ... ``scans``: scan_id,
    change_id, ... Columns of the sides are to have names of their own. ``wanted``
    are filters by equality (status, repo_id, department_id, ...), all of which must
    hold; None is no filter.
    """
    rows = changes.join(repos, "repo_id").join(departments, "department_id", "left").join(latest_scans(scans), "change_id", "left")
    return filtered(rows, **wanted)


def filtered(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows that meet all filters that are given: equality, or membership for a list."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return rows


def with_level_totals(rows: DataFrame, changes: DataFrame, repos: DataFrame, value: str) -> DataFrame:
    """The rows with repo_total, department_total and total of a value over all changes, zeros where there are none.

    Changes without a known repository count in the last only. Each level is added
    up before it is joined.
    """
    by_repo = changes.groupBy("repo_id").agg(F.sum(value).alias("repo_total"))
    by_department = by_repo.join(repos.select("repo_id", "department_id"), "repo_id").groupBy("department_id").agg(F.sum("repo_total").alias("department_total"))
    whole = F.coalesce(changes.agg(F.sum(value)).scalar(), F.lit(0))
    got = rows.join(by_repo, "repo_id", "left").join(by_department, "department_id", "left").withColumn("total", whole)
    return got.fillna(0, ["repo_total", "department_total"])


def split_totals(rows: DataFrame, by: str, parts: dict[str, list[str]], sums: list[str]) -> DataFrame:
    """One row: for each named part (values of a column) the number of rows and the sums, zeros where there are none."""
    out: list[Column] = []
    for name, values in parts.items():
        hit = F.col(by).isin(values)
        out += [F.count_if(hit).alias(f"{name}_n"), *[F.coalesce(F.sum(F.when(hit, F.col(c))), F.lit(0)).alias(f"{name}_{c}") for c in sums]]
    return rows.agg(*out)


def recent_scans(scans: DataFrame, changes: DataFrame, repos: DataFrame, at: str, top: int = 6) -> DataFrame:
    """The last scan of each change of a known repository, the newest first, ties by the larger scan_id."""
    return latest_scans(scans).join(changes, "change_id").join(repos, "repo_id").orderBy(F.desc(at), F.desc("scan_id")).limit(top)


def scan_details(scans: DataFrame, children: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """The scans with one array for each kind of child rows (name: rows with scan_id, order of the columns), empty where there are none."""
    for name, (rows, columns) in children.items():
        each = rows.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))  # the children of one scan are one document's
        scans = scans.join(each, "scan_id", "left").withColumn(name, F.coalesce(name, F.array().cast(each.schema[name].dataType)))
    return scans


def capped(rows: DataFrame, by: list[str], order: list[Column], caps: dict[str, int], kind: str, default: int) -> DataFrame:
    """The first rows of each group and kind by an order; ``caps`` has the number for each kind."""
    from pyspark.sql import Window as W

    most = F.coalesce(F.create_map(*[F.lit(x) for p in caps.items() for x in p])[F.col(kind)], F.lit(default)) if caps else F.lit(default)
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by, kind).orderBy(*order))).filter(F.col("place") <= most)
