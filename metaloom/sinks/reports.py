"""Reports for people: counts of everything, and the first rows of each list in report order.

The counts are aggregations; only the first rows (a limit that is the feature) come to the driver.
"""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escape, markdown_escape, one_line, shortened
from ..operators import compare, drift, impact, policy

#: Rows shown of a list, and characters of a cell.
SHOWN, CELL = 20, 200


class Section:
    """A titled list: its first rows as lines of text, and how many rows there are."""

    def __init__(self, title: str, rows: DataFrame, line: Column, shown: int = SHOWN):
        """rows: already in report order; line: the text of a row."""
        self.title = title
        self.total = rows.count()
        self.lines = [r["line"] for r in rows.select(shortened(one_line(line), CELL).alias("line")).limit(shown).collect()]

    def text(self) -> str:
        more = [f"  ... and {self.total - len(self.lines)} more"] if self.total > len(self.lines) else []
        return "\n".join([f"{self.title}: {self.total}", *(f"  {x}" for x in self.lines), *more])

    def html(self) -> str:
        more = f"<p>and {self.total - len(self.lines)} more</p>" if self.total > len(self.lines) else ""
        return f"<section><h2>{escape(self.title)}: {self.total}</h2><ul>{''.join(f'<li>{escape(x)}</li>' for x in self.lines)}</ul>{more}</section>"


def _counts(row) -> str:
    return ", ".join(f"{k} {v}" for k, v in row.asDict().items())


def comparison_text(changes: DataFrame, properties: DataFrame, shown: int = SHOWN) -> str:
    objects = Section("Objects", compare.in_report_order(changes), F.concat_ws(" ", "change", "object_key"), shown)
    side = lambda has, json: F.when(F.col(has), F.col(json)).otherwise(F.lit("(missing)"))
    lines = F.concat(F.concat_ws(" ", "object_key", "pointer"), F.lit(": "), side("base_has", "base_json"), F.lit(" -> "), side("cand_has", "cand_json"))
    return "\n".join([f"Comparison: {_counts(compare.summary(changes).first())}", objects.text(), Section("Properties", properties.orderBy("object_key", "pointer"), lines, shown).text()])


def drift_text(classified: DataFrame, shown: int = SHOWN) -> str:
    lines = F.concat_ws(" ", "classification", "change", "object_key", "pointer", "reason", F.array_join("rule_ids", ","))
    return "\n".join([f"Drift: {_counts(drift.summary(classified).first())}", Section("Differences", drift.in_report_order(classified), lines, shown).text()])


def violations_text(violations: DataFrame, shown: int = SHOWN) -> str:
    order = violations.orderBy(policy.severity_rank(), "policy_id", "kind", "local_id", "rule_type", "reason")
    return Section("Violations", order, F.concat_ws(" ", "severity", "policy_id", "local_id", "reason"), shown).text()


def impact_sections(found, shown: int = SHOWN) -> list[Section]:
    targets = impact.paths(found).orderBy("distance", "path_key")
    line = F.concat_ws(" ", F.col("distance").cast("string"), "target", F.lit("via"), "path_key")
    return [Section("Changed", found.roots.orderBy("root"), F.col("root"), shown), Section("Direct", targets.filter("distance = 1"), line, shown), Section("Transitive", targets.filter("distance > 1"), line, shown)]


def impact_text(found, shown: int = SHOWN) -> str:
    return "\n".join(s.text() for s in impact_sections(found, shown))


def impact_html(found, title: str, shown: int = SHOWN) -> str:
    """A page that stands alone: no script, nothing loaded, all text escaped."""
    body = "".join(s.html() for s in impact_sections(found, shown))
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{body}</body></html>'


def markdown_table(df: DataFrame, columns: list[str], shown: int = SHOWN) -> str:
    """The first rows of a table (in its order) as Markdown."""
    cell = lambda c: F.coalesce(shortened(markdown_escape(F.col(c).cast("string")), CELL), F.lit(""))
    rows = df.select(*(cell(c).alias(c) for c in columns)).limit(shown).collect()
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(columns), line(["-"] * len(columns)), *(line(r) for r in rows)])


def annotations(violations: DataFrame, most: int = SHOWN) -> DataFrame:
    """The first violations as rows of severity and message, HTML-escaped."""
    return policy.top(violations, most).select("severity", html_escape(F.concat_ws(" ", "policy_id", "local_id", "reason")).alias("message"))
