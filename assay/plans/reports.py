"""Reports of an experiment as JSON, Markdown, CSV and HTML.

Each is a head, lines in the order of items, and a tail. Lines are made on the executors from aggregates. ``write_report`` makes one file of any size in any store:
Spark writes the lines as sorted parts, whose bytes are then copied between head and tail; ``to_*`` return the same as one text.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import escape_csv, escape_html, escape_markdown_cell, format_value, safe_name, truncate
from ..operators import results
from ..shared import Scratch, join_parts
from ..shipping import ship
from ..sources.json_ranges import members
from .experiment import Outcome


@dataclass
class Report:
    """A text: ``head``, a line for each row of ``lines`` (item_idx, text) in order, ``tail``."""

    head: str
    lines: DataFrame
    tail: str = ""

    def text(self) -> str:
        return self.head + "".join(f"{r[1]}\n" for r in self.lines.orderBy("item_idx").toLocalIterator()) + self.tail

    def write(self, path: str) -> None:
        """One file, replaced if it is there. The driver copies bytes from part to part and holds none of them."""
        scratch = Scratch(self.lines.sparkSession, "report")
        self.lines.orderBy("item_idx").select(self.lines.columns[1]).write.text(f"{scratch.path}/lines")
        join_parts(self.lines.sparkSession, f"{scratch.path}/lines", path, self.head, self.tail)
        scratch.close()


def item_lines(o: Outcome) -> DataFrame:
    """A row per item: the data of run 0 and whether it passed in every run."""
    passed = results.item_success_across_runs(o.item_results(), [])
    first = o.items.where("run_index = 0").select("item_idx", format_value("inputs").alias("input"), format_value("expected_outputs").alias("expected_output"), F.col("actual_output").cast("string").alias("actual_output"))
    return first.join(passed, "item_idx")


def item_json(o: Outcome) -> DataFrame:
    """(item_idx, body): each item's entry, evaluations in the order of run 0."""
    order = o.evals.where("run_index = 0").groupBy("item_idx", "evaluator").agg(F.min("evaluator_idx").alias("nth"))
    e = results.item_across_runs(o.evals, []).join(order, ["item_idx", "evaluator"])
    several = F.size("scores") > 1
    entry = F.struct(
        F.col("evaluator").alias("name"), F.when(~several, F.col("average_score")).alias("score"), F.when(several, F.col("average_score")).alias("averageScore"),
        F.when(several, F.col("std_dev")).alias("stdDev"), F.when(several, F.col("scores")).alias("scores"), "threshold", "success", "reason",
    )
    lists = e.groupBy("item_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", entry.alias("e")))), lambda x: x["e"]).alias("evaluations"))
    rows = item_lines(o).join(lists, "item_idx", "left")
    body = F.struct("input", F.col("expected_output").alias("expectedOutput"), F.col("actual_output").alias("actualOutput"), "success", F.coalesce("evaluations", F.array().cast(lists.schema["evaluations"].dataType)).alias("evaluations"))
    return rows.select("item_idx", F.to_json(body).alias("body")).orderBy("item_idx")


def _indented(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Items as they stand in the report's list; strings hold no line breaks of their own."""
    for pdf in batches:
        pdf["line"] = ["    " + json.dumps(json.loads(b), indent=2, ensure_ascii=False).replace("\n", "\n    ") + ("" if last else ",") for b, last in zip(pdf["body"], pdf["last"], strict=True)]
        yield pdf[["item_idx", "line"]]


def json_report(o: Outcome, timestamp: dt.datetime | None = None) -> Report:
    ship(o.items.sparkSession)
    s = o.summary()
    evaluators = {r.evaluator: {"averageScore": r.average_score, "stdDev": r.std_dev, "passRate": r.pass_rate} for r in o.averages().collect()}
    head = {
        "version": 1, "experimentName": o.name, "timestamp": (timestamp or dt.datetime.now(dt.UTC)).isoformat().replace("+00:00", "Z"), "description": o.description, "metadata": o.metadata, "config": {"runs": o.runs},
        "summary": {"totalExamples": s.total, "passCount": s.passed, "failCount": s.failed, "passRate": s.pass_rate, "runCount": s.runs, "evaluators": evaluators},
        "items": [],
    }
    text = json.dumps(head, indent=2, ensure_ascii=False)
    items = item_json(o)
    last = items.agg(F.max("item_idx")).first()[0]
    lines = items.withColumn("last", F.col("item_idx") == F.lit(last)).mapInPandas(_indented, "item_idx long, line string")
    return Report(text, lines) if last is None else Report(text.removesuffix("]\n}") + "\n", lines, "  ]\n}")


def read_json(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """A JSON report's head, and (nth, text) of its items in order. The file is read by ranges: no task reads more than one of them, whatever its size."""
    return members(spark, path, "items", whole=("metadata", "config", "summary"))


def to_json(o: Outcome, timestamp: dt.datetime | None = None) -> str:
    return json_report(o, timestamp).text()


def csv_lines(o: Outcome) -> DataFrame:
    """(item_idx, line): run 0's cells, with score and pass of each evaluator by name."""
    names = [r.evaluator for r in results.evaluator_names(o.evals).collect()]
    cells = results.cells(o.evals.where("run_index = 0"), ["item_idx"], names) if names else None
    rows = item_lines(o)
    rows = rows.join(cells, "item_idx", "left") if cells is not None else rows
    shown = [escape_csv(c) for c in ("input", "expected_output", "actual_output")] + [F.col("success").cast("string")]
    shown += [F.coalesce(F.col(f"{n}_{k}").cast("string"), F.lit("")) for n in range(1, len(names) + 1) for k in ("score", "pass")]
    return rows.select("item_idx", F.concat_ws(",", *shown).alias("line")).orderBy("item_idx")


def csv_header(o: Outcome) -> str:
    names = [r.evaluator for r in results.evaluator_names(o.evals).collect()]
    return ",".join(["input", "expected_output", "actual_output", "success", *(f"{safe_name(n)}_{k}" for n in names for k in ("score", "pass"))])


def csv_report(o: Outcome) -> Report:
    return Report(csv_header(o) + "\n", csv_lines(o))


def to_csv(o: Outcome) -> str:
    return csv_report(o).text()


def failed_items(o: Outcome) -> DataFrame:
    """Each failed item with the data and failed evaluations of the first run in which it failed."""
    first = results.first_failures(o.item_results(), [])
    why = o.evals.where(~F.col("success")).groupBy("run_index", "item_idx").agg(F.array_sort(F.collect_list(F.struct("evaluator_idx", "evaluator", "score", "reason"))).alias("failures"))
    rows = o.items.join(first, ["run_index", "item_idx"]).join(why, ["run_index", "item_idx"], "left")
    return rows.select("item_idx", "run_index", format_value("inputs").alias("input"), format_value("expected_outputs").alias("expected_output"), F.col("actual_output").cast("string").alias("actual_output"), "failures").orderBy("item_idx")


def markdown_report(o: Outcome) -> Report:
    s, total = o.summary(), max(1, o.items.where("run_index = 0").count())
    out = [f"# {o.name}", "", *([o.description, ""] if o.description else []), f"**Pass rate:** {s.passed / total * 100:.0f}% ({s.passed:g}/{s.total})", ""]
    out += ["| Evaluator | Average | Std dev | Pass rate |", "| --- | --- | --- | --- |"]
    out += [f"| {r.evaluator.replace('|', chr(92) + '|')} | {r.average_score:.2f} | {r.std_dev:.2f} | {r.pass_rate * 100:.0f}% |" for r in o.averages().collect()]
    cell = lambda c: escape_markdown_cell(truncate(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "), 80)).alias(c)
    failed = failed_items(o).select("item_idx", cell("input"), cell("expected_output"), cell("actual_output"), F.array_join(F.transform("failures", lambda f: f["evaluator"]), ", ").alias("why"))
    row = F.format_string("| %d | %s | %s | %s | %s |", F.col("item_idx") + 1, "input", "expected_output", "actual_output", F.coalesce("why", F.lit("")))
    if not failed.isEmpty():
        out += ["", "## Failed Examples", "", "| # | Input | Expected | Actual | Failed |", "| --- | --- | --- | --- | --- |"]
    return Report("\n".join(out) + "\n", failed.select("item_idx", row.alias("line")))


def to_markdown(o: Outcome) -> str:
    return markdown_report(o).text()


def html_rows(o: Outcome) -> DataFrame:
    """(item_idx, row): one table row per item, with the evaluations of run 0 to unfold."""
    cell = lambda c: F.concat(F.lit("<td>"), escape_html(truncate(c, 100)), F.lit("</td>"))
    state = F.when(F.col("success"), F.lit("<td>pass</td>")).otherwise(F.lit("<td>fail</td>"))
    line = F.concat(F.lit("<li>"), escape_html("evaluator"), F.format_string(": %.3f ", "score"), F.when(F.col("success"), F.lit("pass")).otherwise(F.lit("fail")), F.lit(" "), escape_html("reason"), F.lit("</li>"))
    details = o.evals.where("run_index = 0").groupBy("item_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("evaluator_idx", line.alias("li")))), lambda x: x["li"]), "").alias("details"))
    folded = F.concat(F.lit("<td><details><summary>evaluations</summary><ul>"), F.coalesce("details", F.lit("")), F.lit("</ul></details></td>"))
    rows = item_lines(o).join(details, "item_idx", "left")
    return rows.select("item_idx", F.concat(F.lit("<tr>"), cell("input"), cell("expected_output"), cell("actual_output"), state, folded, F.lit("</tr>")).alias("row")).orderBy("item_idx")


# a click on a heading sorts by its column, as numbers where both cells are numbers, and the other way round the next time
SORT = """<script>document.querySelectorAll("th").forEach(h => h.onclick = () => {
  const body = h.closest("table"), rows = [...body.rows].slice(1), down = h.dataset.down = h.dataset.down === "1" ? "0" : "1";
  const text = r => r.cells[h.cellIndex].textContent.replace("%", ""), number = t => t.trim() === "" ? NaN : Number(t);
  const order = (a, b) => isNaN(number(a)) || isNaN(number(b)) ? a.localeCompare(b) : number(a) - number(b);
  rows.sort((a, b) => order(text(a), text(b)) * (down === "1" ? 1 : -1)).forEach(r => r.parentNode.append(r));
})</script>"""


def html_report(o: Outcome, timestamp: dt.datetime | None = None) -> Report:
    from html import escape

    s = o.summary()
    cards = {"Examples": s.total, "Passed": f"{s.passed:g}", "Failed": f"{s.failed:g}", "Pass rate": f"{s.pass_rate * 100:.1f}%", "Runs": s.runs}
    means = "".join(f"<tr><td>{escape(r.evaluator)}</td><td>{r.average_score:.3f}</td><td>{r.std_dev:.3f}</td><td>{r.pass_rate * 100:.1f}%</td></tr>" for r in o.averages().collect())
    shown = "".join(f"<div class=card><b>{v}</b> {k}</div>" for k, v in cards.items())
    when = (timestamp or dt.datetime.now()).strftime("%Y-%m-%d %H:%M:%S")
    head = (
        f"<!doctype html><meta charset=utf-8><title>{escape(o.name)}</title><style>td{{border:1px solid #ccc;padding:4px}}th{{cursor:pointer}}.card{{display:inline-block;margin:8px}}</style>"
        f"<h1>{escape(o.name)}</h1><p>{escape(o.description)}</p><p>{when}</p>{shown}<table><tr><th>Evaluator<th>Average<th>Std dev<th>Pass rate</tr>{means}</table>"
        f"<table><tr><th>Input<th>Expected<th>Actual<th>Result<th>Details</tr>\n"
    )
    return Report(head, html_rows(o), f"</table>{SORT}")


def to_html(o: Outcome, timestamp: dt.datetime | None = None) -> str:
    return html_report(o, timestamp).text()


REPORTS = {"json": json_report, "csv": csv_report, "md": markdown_report, "html": html_report}


def write_report(o: Outcome, path: str, kind: str | None = None) -> None:
    """One report file in any store that Spark reaches; ``kind`` is json, csv, md or html, by default as the path ends."""
    REPORTS[kind or path.rsplit(".", 1)[-1]](o).write(path)


def write(text: str, path: str) -> None:
    """One report file; its folders are made."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")


def write_lines(lines: DataFrame, path: str) -> None:
    """One column of report lines (of :func:`csv_lines`, :func:`item_json` or :func:`html_rows`) as text files, for reports of any size."""
    *_, column = lines.columns
    lines.select(column).write.mode("overwrite").text(path)


def write_csv_lines(o: Outcome, path: str) -> None:
    """The CSV report's lines (without header) as text files."""
    write_lines(csv_lines(o), path)
