"""Result sinks: small tables of scores as JSON and Markdown. What is missing is shown as missing, never as 0."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EMPTY, NOT_MEASURED = "—", "*not measured*"
#: Rows of one section at most: results are summaries, and more is an error.
MOST_ROWS = 10_000


def shown(value: Column, places: int = 3) -> Column:
    """A number with fixed places; a dash for null."""
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", value.cast("double"))).otherwise(EMPTY)


def collected(sections: dict[str, DataFrame | None]) -> dict[str, list[dict] | None]:
    """The rows of every section, in the order of all their columns; a section without a table is None."""
    out: dict[str, list[dict] | None] = {}
    for name, table in sections.items():
        if table is None:
            out[name] = None
            continue
        rows = table.orderBy(*table.columns).limit(MOST_ROWS + 1).collect()
        if len(rows) > MOST_ROWS:
            raise ValueError(f"{name}: more than {MOST_ROWS} rows are no result table")
        out[name] = [r.asDict(recursive=True) for r in rows]
    return out


def as_json(results: dict) -> str:
    return json.dumps(results, sort_keys=True, indent=2, default=str) + "\n"


def _cell(value: object, places: int) -> str:
    if value is None:
        return EMPTY
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, int):
        return f"{value:,}"
    return f"{value:.{places}f}" if isinstance(value, float) else str(value).replace("|", "\\|")


def as_markdown(results: dict[str, list[dict] | None], titles: dict[str, str], places: int = 3) -> str:
    """A heading and a table for every title, in their order; sections without rows say that they were not measured."""
    out = []
    for name, title in titles.items():
        rows = results.get(name)
        out.append(f"### {title}\n")
        if not rows:
            out.append(NOT_MEASURED + "\n")
            continue
        head = list(rows[0])
        table = [head, ["---"] * len(head), *[[_cell(r[c], places) for c in head] for r in rows]]
        out.append("\n".join("| " + " | ".join(line) + " |" for line in table) + "\n")
    return "\n".join(out)


def save_text(spark: SparkSession, text: str, path: str) -> None:
    """One text file in a folder of any store that Spark writes to."""
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)
