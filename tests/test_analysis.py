"""End to end on small sources written here."""

import json
import shutil
import zipfile

import pytest

from lintlake import report as R
from lintlake.options import CustomProfile, MetricRule, ScanOptions
from lintlake.plans import analyze as A
from lintlake.schemas import FILES
from lintlake.sources import listing

LOOP = """def collect(rows, limit):
    total = 0
    kept = []
    for row in rows:
        if row > limit:
            total += row
            kept.append(row)
        elif row == limit:
            kept.append(limit)
        else:
            total -= 1
    while total > 100:
        total = total // 2
    return total, kept
"""


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    (root / "pkg").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "a.py").write_text(LOOP)
    (root / "pkg" / "b.py").write_text(LOOP.replace("collect", "gather"))
    (root / "pkg" / "skip.py").write_text("x = 1\n")
    (root / ".gitignore").write_text("skip*\n!keep.py\n")
    (root / "node_modules" / "c.py").write_text("eval('1')\n")
    (root / "notes.txt").write_text("none\n")
    return root


def test_pairs_within_and_with_history(spark, tree, tmp_path):
    store = f"file://{tmp_path}/store"
    first = A.analyze_directory(spark, str(tree), "one", store_path=store)
    assert [f["file"] for f in first["fileMetrics"]] == ["a.py", "pkg/b.py"]
    files = [p for p in first["clonePairs"] if p["kind"] == "file"]
    assert [(p["fileA"], p["fileB"], p["jaccardSimilarity"]) for p in files] == [("a.py", "pkg/b.py", 1.0)]
    assert first["metrics"]["cloneRate"] == 1.0 and first["score"]["score"] == 92.0 and first["score"]["passed"]
    assert R.is_report(first) and "pkg/b.py" in R.render_html(first)
    again = A.analyze_directory(spark, str(tree), "one", store_path=store)
    assert not any("history/" in p["fileB"] for p in again["clonePairs"])
    other = A.analyze_directory(spark, str(tree), "two", store_path=store)
    assert {p["fileB"] for p in other["clonePairs"]} == {"pkg/b.py", "history/one/a.py", "history/one/pkg/b.py"}


def test_custom_thresholds(spark, tmp_path):
    f = tmp_path / "up.bin"
    f.write_text("def f(a):\n    if a:\n        return 1\n    return 2\n")
    custom = CustomProfile(metric_rules={"maxComplexity": MetricRule(1, 2), "maxFunctionLines": MetricRule(3, 1), "maxNestingDepth": MetricRule(0, 4)})
    got = A.analyze_upload(spark, str(f), "main.py", "p", ScanOptions(custom=custom))
    m = got["metrics"]
    assert got["fileMetrics"][0]["file"] == "main.py" and got["sourceName"] == "main.py"
    assert (m["overComplexFunctions"], m["overLongFunctions"], m["deeplyNestedFunctions"]) == (1, 1, 1)
    assert [d["points"] for d in got["score"]["deductions"]] == [2.0, 1.0, 4.0] and got["score"]["score"] == 93.0


def test_zip_and_finding(spark, tmp_path):
    path = tmp_path / "u"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("src/main.py", "value = eval('1')\n")
        z.writestr("dist/x.py", "eval('2')\n")
    got = A.analyze_upload(spark, str(path), "p.ZIP", "p")
    assert [f["id"] for f in got["findings"]] == ["py-eval:src/main.py:1:9"]
    assert got["score"]["score"] == 97.0 and got["findings"][0]["snippet"] == "value = eval('1')"


def test_uploads_that_cannot_be_read(spark, tmp_path, monkeypatch):
    (tmp_path / "bad.zip").write_bytes(b"PK no archive")
    with pytest.raises(Exception, match="cannot be read as an archive"):
        A.analyze_upload(spark, str(tmp_path / "bad.zip"), "bad.zip", "p")
    monkeypatch.setattr(listing, "UPLOAD_LIMIT", 5)
    with pytest.raises(listing.UploadError, match="larger than"):
        A.analyze_upload(spark, str(tmp_path / "bad.zip"), "bad.zip", "p")
    with pytest.raises(listing.UploadError, match="larger than"):
        A.analyze_upload(spark, str(tmp_path / "bad.zip"), "bad.py", "p")


def test_report_order_and_names(spark):
    """Names by the Unicode collation, findings by place; fields as the report has them."""
    rows = [("p", f, "python", "eval('1')\n") for f in ("b.py", "A.py", "a.py", "_x.py", "\u00e9.py", "Z.py")]
    got = json.loads(A.analyze_files(spark.createDataFrame(rows, FILES)).reports().first()["report"])
    want = ["_x.py", "a.py", "A.py", "b.py", "\u00e9.py", "Z.py"]
    assert [f["file"] for f in got["fileMetrics"]] == want and [f["file"] for f in got["findings"]] == want
    assert {"profileId", "profileVersion", "maxScore", "passScore", "passed", "deductions", "failureReasons"} <= set(got["score"])
    assert {"fileA", "fileB", "jaccardSimilarity", "matchingKGrams", "kind"} == set(got["clonePairs"][0])


def test_pdf(spark):
    if not any(map(shutil.which, ("chromium", "chromium-browser", "google-chrome"))):
        with pytest.raises(RuntimeError, match="browser"):
            R.render_pdf({})
        pytest.skip("no browser that can print")
    report = json.loads(A.analyze_files(spark.createDataFrame([("p", "a.py", "python", "x = 1\n")], FILES)).reports().first()["report"])
    assert R.render_pdf(report).startswith(b"%PDF")


def test_options_off_and_empty(spark, tmp_path):
    (tmp_path / "x.md").write_text("none")
    got = A.analyze_directory(spark, str(tmp_path), "p", ScanOptions.from_json('{"engines": {"rules": false, "cloneDetection": false}}'))
    assert got["fileMetrics"] == [] and got["metrics"]["totalLines"] == 0 and got["metrics"]["cloneRate"] == 0
    assert got["score"]["score"] == 100.0 and got["score"]["passed"] and got["score"]["deductions"] == [] and R.is_report(got)
    assert R.parse_report(json.dumps(got)) == got
    with pytest.raises(ValueError):
        A.analyze_directory(spark, str(tmp_path), " ")
