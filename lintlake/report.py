"""Reports as JSON and HTML, from the frames of one project's analysis."""

from __future__ import annotations

import html
import json
import shutil
import subprocess
import tempfile
from decimal import ROUND_HALF_UP, Decimal
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the largest report that is taken back, in bytes.
REPORT_LIMIT = 25 * 1024 * 1024
REQUIRED = {"projectKey": str, "scannedAt": str, "metrics": dict, "fileMetrics": list, "findings": list, "clonePairs": list}


def is_report(value: Any) -> bool:
    """Whether a decoded JSON document has the shape of a report."""
    return isinstance(value, dict) and all(isinstance(value.get(k), t) for k, t in REQUIRED.items())


def parse_report(text: str | bytes) -> dict[str, Any]:
    """A report sent back as JSON, for rendering: an error if it is too large or has not the shape of a report."""
    raw = text.encode() if isinstance(text, str) else text
    if len(raw) > REPORT_LIMIT:
        raise ValueError(f"the report is larger than {REPORT_LIMIT} bytes")
    value = json.loads(raw)
    if not is_report(value):
        raise ValueError("the document is no report")
    return value


def _named(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


#: Names in the report of columns that are named otherwise in the engine's frames.
PAIR_NAMES = {"file_a": "fileA", "file_b": "fileB", "jaccard": "jaccardSimilarity", "matching_k_grams": "matchingKGrams", "start_line_a": "startLineA", "end_line_a": "endLineA", "start_line_b": "startLineB", "end_line_b": "endLineB"}
SCORE_NAMES = {"profile_id": "profileId", "profile_version": "profileVersion", "max_score": "maxScore", "pass_score": "passScore", "failure_reasons": "failureReasons"}


def json_rows(projects: DataFrame, files: DataFrame, findings: DataFrame, pairs: DataFrame, scores: DataFrame | None) -> DataFrame:
    """(project_key, report): one JSON document per project. Files come by name and findings by file, line, column and
    rule, names in the order of the Unicode collation; clone pairs by seq. Fields without a value are left out."""

    def nested(df: DataFrame, name: str, *order: Column) -> DataFrame:
        fields = [c for c in df.columns if c not in ("project_key", "seq")]
        entry = F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], F.struct(*fields).alias("_row"))
        return df.groupBy("project_key").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["_row"]).alias(name))

    metrics = projects.select("project_key", F.struct(*[c for c in projects.columns if c != "project_key"]).alias("metrics"))
    df = metrics
    name = lambda c: [F.collate(c, "UNICODE"), F.col(c)]
    by_place = [*name("file"), F.col("line"), F.col("column"), *name("ruleId")]
    for part in (nested(files, "fileMetrics", *name("file")), nested(findings, "findings", *by_place), nested(_named(pairs, PAIR_NAMES), "clonePairs", F.col("seq"))):
        df = df.join(part, "project_key", "left")
    lists = [F.coalesce(F.col(c), F.array()).alias(c) for c in ("fileMetrics", "findings", "clonePairs")]
    if scores is not None:
        scores = _named(scores, SCORE_NAMES)
        df = df.join(scores.select("project_key", F.struct(*[c for c in scores.columns if c != "project_key"]).alias("score")), "project_key", "left")
        lists.append(F.col("score"))
    return df.select("project_key", F.to_json(F.struct(F.col("project_key").alias("projectKey"), "metrics", *lists)).alias("report"))


def _round(value: float, digits: int) -> Decimal:
    return Decimal(repr(float(value))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)


def shown(value: float | None, digits: int = 0) -> str:
    return f"{_round(value or 0, digits):,f}"


def shown_percent(share: float | None) -> str:
    return f"{_round((share or 0) * 100, 1):f}%"


def place(file: str, start: int | None, end: int | None) -> str:
    return f"{file}:{start}-{end}" if start else file


def _table(title: str, heads: list[str], rows: list[list[str]]) -> str:
    body = "".join("<tr>" + "".join(f"<td>{html.escape(c, quote=True)}</td>" for c in r) + "</tr>" for r in rows)
    body = body or f'<tr><td colspan="{len(heads)}">none</td></tr>'
    return f"<h2>{title}</h2><table><thead><tr>" + "".join(f"<th>{h}</th>" for h in heads) + f"</tr></thead><tbody>{body}</tbody></table>"


def render_html(report: dict[str, Any]) -> str:
    """One page: cards, score, and tables of files, functions, findings, clones and deductions. All text is escaped."""
    m, score = report["metrics"], report.get("score")
    functions = [{**f, "file": x["file"], "language": x["language"]} for x in report["fileMetrics"] for f in x.get("functions") or []]
    cards = [("Lines", shown(m["totalLines"])), ("Code lines", shown(m["ncloc"])), ("Comment density", shown_percent(m["commentDensity"])), ("Functions", shown(m["functionCount"])), ("Classes", shown(m["classCount"])), ("Mean complexity", shown(m["avgComplexity"], 2)), ("Highest complexity", shown(m["maxComplexity"])), ("Clone rate", shown_percent(m["cloneRate"]))]
    parts = ["".join(f'<div class="card"><b>{html.escape(v)}</b><span>{k}</span></div>' for k, v in cards)]
    if score:
        parts.append(f'<p class="gate">{"passed" if score["passed"] else "failed"}: {shown(score["score"], 1)} of {shown(score["maxScore"])}, pass line {shown(score["passScore"], 1)}</p>')
        parts.append(_table("Deductions", ["Kind", "Reason", "Count", "Points"], [[d["category"], d["label"], "" if d.get("count") is None else shown(d["count"]), shown(d["points"], 1)] for d in score["deductions"]]))
    files = report["fileMetrics"]
    parts.append(_table("Files", ["File", "Language", "Lines", "Code", "Comments", "Highest complexity"], [[x["file"], x["language"], shown(x["totalLines"]), shown(x["ncloc"]), shown_percent(x["commentDensity"]), shown(max([0, *(f["complexity"] for f in x.get("functions") or [])]))] for x in files]))
    parts.append(_table("Functions", ["Function", "File", "Complexity", "Lines", "Nesting", "Parameters"], [[f["name"], place(f["file"], f["startLine"], f["endLine"]), shown(f["complexity"]), shown(f["lines"]), shown(f["nestingDepth"]), shown(f["paramCount"])] for f in functions]))
    parts.append(_table("Findings", ["Severity", "Rule", "File", "Place", "Message"], [[f["severity"], f["ruleId"], f["file"], f"{shown(f['line'])}:{shown(f['column'])}", f["message"]] for f in report["findings"]]))
    parts.append(_table("Clones", ["A", "B", "Similarity", "Matching grams"], [[place(p["fileA"], p.get("startLineA"), p.get("endLineA")), place(p["fileB"], p.get("startLineB"), p.get("endLineB")), shown_percent(p["jaccardSimilarity"]), shown(p["matchingKGrams"])] for p in report["clonePairs"]]))
    title = html.escape(report["projectKey"], quote=True)
    style = "@page{size:A4;margin:12mm}body{font:12px sans-serif}table{border-collapse:collapse;width:100%}td,th{border-bottom:1px solid #ccc;padding:4px;text-align:left}.card{display:inline-block;width:22%;padding:6px}.card b{display:block;font-size:16px}"
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{title}</title><style>{style}</style></head><body><h1>{title}</h1>{"".join(parts)}</body></html>'


def render_pdf(report: dict[str, Any]) -> bytes:
    """The HTML page as PDF, by a headless browser where the machine has one."""
    browser = next((b for b in map(shutil.which, ("chromium", "chromium-browser", "google-chrome")) if b), None)
    if browser is None:
        raise RuntimeError("no browser is installed that can print PDF; render_html() gives the same report")
    with tempfile.TemporaryDirectory() as folder:
        page, out = Path(folder, "report.html"), Path(folder, "report.pdf")
        page.write_text(render_html(report), encoding="utf-8")
        subprocess.run([browser, "--headless", "--no-sandbox", "--no-pdf-header-footer", f"--print-to-pdf={out}", page.as_uri()], check=True, capture_output=True, timeout=120)
        return out.read_bytes()
