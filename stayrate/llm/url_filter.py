"""URL filters: host-suffix and path-prefix expressions joined on short hash prefixes.

Each distinct (host, path) is expanded into ``suffix`` + ``directory`` expressions of suffixes of the
host at a dot and directories of the path; a rule is filed under its host and the directory its path
lies in. Only suffixes of as many labels, with directories of as many slashes, as some rule has are
made, so a url gives a row for each such shape, however long it is. Both sides meet on the first ``PREFIX`` hex digits of the SHA-256 of
the expression; the full digest, the host and the rest of the rule's path are then confirmed. The
longest fitting rule wins, on a tie the blocking one, then the smaller host.

Every url gets a verdict. A null url, or one without ``://``, has empty host and path; no rule fits
an empty host. Rows are judged one by one, so repeated rows and null ids are kept; all columns of
the input are kept but those named like a result column (host, path, rule, verdict), which are
replaced. Rules with a null host, path or verdict are left out; repeated rules count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = 8  # hex digits: 32 bits
RESULT = ("host", "path", "rule", "verdict")


def url_parts(url: str) -> tuple[str, str]:
    """SQL texts of host (A-Z lowered) and path of a url column."""
    rest = f"if(instr({url}, '://') > 0, substr({url}, instr({url}, '://') + 3), '')"
    host = f"regexp_extract({rest}, '^[^/?#]*', 0)"
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    return f"coalesce(translate({host}, {letters}), '')", f"coalesce({path}, '')"


def expressions(places: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """(host, path, suffix, directory) for each shape, a number of labels and one of slashes.

    Directories end in ``/``; that of no slash is empty. Shapes that a url has not give no row.
    """
    pairs = ", ".join(f"struct({labels} AS k, {slashes} AS d)" for labels, slashes in shapes)
    if not shapes:
        return places.selectExpr("host", "path", "host AS suffix", "path AS directory").limit(0)
    return (
        places.filter("host <> ''")
        .withColumn("labels", F.expr("split(host, '[.]')"))
        # '/a/b' splits into ['', 'a', 'b']: the directories are '/' and '/a/'.
        .withColumn("steps", F.expr("split(path, '/')"))
        .withColumn("shape", F.expr(f"explode(array({pairs}))"))
        .filter("shape.k <= size(labels) AND shape.d < size(steps)")
        .selectExpr(
            "host",
            "path",
            "array_join(slice(labels, size(labels) - shape.k + 1, shape.k), '.') AS suffix",
            "if(shape.d = 0, '', concat(array_join(slice(steps, 1, shape.d), '/'), '/'))"
            " AS directory",
        )
    )


def shapes_of(rules: DataFrame) -> list[tuple[int, int]]:
    """The (labels, slashes) of the rules' hosts and directories: a few small numbers."""
    rows = rules.selectExpr(
        "size(split(r_host, '[.]')) AS labels",
        "length(r_path) - length(replace(r_path, '/', '')) AS slashes",
    )
    return sorted(tuple(row) for row in rows.distinct().collect())


def filed(rules: DataFrame) -> DataFrame:
    """(r_host, r_path, action, r_digest): rules with the digest of their expression."""
    return (
        rules.selectExpr("host AS r_host", "path AS r_path", "verdict AS action")
        .filter("r_host IS NOT NULL AND r_path IS NOT NULL AND action IS NOT NULL")
        .distinct()
        .withColumn(
            "r_digest",
            F.expr("sha2(concat(r_host, regexp_extract(r_path, '^(.*/)?', 0)), 256)"),
        )
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """All columns of ``pages`` with host, path, rule (host and path of the winner) and verdict.

    ``rules`` has the columns host, path and verdict ('allow' or 'block').
    """
    host, path = url_parts(f"`{url_col}`")
    kept = [c for c in pages.columns if c not in RESULT]
    # The kept columns travel as one struct, so their names cannot clash.
    row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")
    split = pages.select(row, F.expr(host).alias("host"), F.expr(path).alias("path"))
    places = split.select("host", "path").distinct()
    sorted_rules = filed(rules)
    expanded = expressions(places, shapes_of(sorted_rules)).withColumn(
        "digest", F.expr("sha2(concat(suffix, directory), 256)")
    )
    best = (
        expanded.withColumn("short", F.expr(f"left(digest, {PREFIX})"))
        .join(sorted_rules.withColumn("short", F.expr(f"left(r_digest, {PREFIX})")), "short")
        .filter("digest = r_digest AND suffix = r_host AND startswith(path, r_path)")
        .groupBy("host", "path")
        .agg(
            F.expr(
                "max_by(struct(concat(r_host, r_path) AS rule, action),"
                " struct(length(r_host) + length(r_path) AS size, action = 'block' AS blocks,"
                " r_host AS name))"
            ).alias("best")
        )
        .selectExpr("host", "path", "best.rule AS rule", "best.action AS action")
    )
    return split.join(best, ["host", "path"], "left").selectExpr(
        *(f"row.`{c}` AS `{c}`" for c in kept),
        "host",
        "path",
        "rule",
        f"coalesce(action, '{default}') AS verdict",
    )
