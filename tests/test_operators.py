"""Operators against plain Python and hand-computed values."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lintlake import report as R
from lintlake.functions import hashing as H
from lintlake.functions import text as X
from lintlake.operators import blocks, clones, metrics, rules, scoring, store, views
from lintlake.options import DEFAULT_PROFILE, CustomProfile, MetricRule, ScanOptions, UnknownProfileError, find_profile
from lintlake.parse.tree import flatten
from lintlake.parse.udf import nodes_of, parse, tree_of
from lintlake.schemas import FILES, FINGERPRINTS
from lintlake.sources.ignore import ignored, parse_files

PY = '''import os
from a import b

def f(a, b=1, *c, d: int = 2):
    # comment
    if a and b or c:
        for x in a:
            while x:
                pass
    elif b:
        return 1 if a else 2
    return subprocess.run("ls", shell=True)

class C:
    def g(self):
        try:
            h = open("x")
        except Exception:
            exec("1")
        assert (h, "never")
        with open("y") as y:
            pass

password = "hunter2"
'''
JAVA = """import java.io.*;
class A {
  // note
  void m(int a, String b, int c, int d, int e, int f, int g) throws IOException {
    if (a > 0 && b != null || c > 1) { switch (a) { case 1: m(); break; case 2: n(); } }
    FileReader r = new FileReader("x");
    try { r.read(); } catch (Exception ex) { }
  }
  void deep() { if (a) { for (;;) { while (b) { do { if (c) { x(); } } while (d); } } } }
}
"""
C = """#include <stdio.h>
struct S { int a; };
int f(int *p, int q) {
  char buf[8];
  gets(buf);
  sprintf(buf, "%d", q / 0);
  if (*p == 1) { q = q ? 1 : 2; }
  char *m = malloc(3);
  return 0;
}
"""


def fnv(text):
    h = H.FNV_OFFSET
    raw = text.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = (h ^ (raw[i] | raw[i + 1] << 8)) * H.FNV_PRIME % 2**32
    return h


def mixed(v, seed):
    h = v ^ (seed + 1) * H.MIX_STEP % 2**32
    h = (h ^ h >> 16) * H.MIX_A % 2**32
    h = (h ^ h >> 13) * H.MIX_B % 2**32
    return h ^ h >> 16


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [("p", "a.py", "python", PY), ("p", "A.java", "java", JAVA), ("p", "c.c", "c", C), ("p", "d.cpp", "cpp", C), ("p", "e.py", "python", ""), ("p", "n.py", "python", None)]
    return parse(spark.createDataFrame(rows, FILES)).persist()


@pytest.fixture(scope="module")
def measured(parsed):
    return metrics.file_metrics(parsed).persist()


def test_metrics(measured):
    got = {r["file"]: r for r in measured.collect()}
    py = got["a.py"]
    assert (py["totalLines"], py["ncloc"], py["commentLines"], py["importCount"], py["classCount"]) == (24, 20, 1, 2, 1)
    f, g = py["functions"]
    assert (f["name"], f["startLine"], f["endLine"], f["complexity"], f["nestingDepth"]) == ("f", 4, 12, 8, 3)
    assert f["paramCount"] == 1 + 2 + 2 + 2  # a; the default and its name; the splat and its name; name and type of the typed default
    assert (g["name"], g["complexity"], g["nestingDepth"], g["paramCount"]) == ("g", 2, 1, 1)
    m, deep = got["A.java"]["functions"]
    assert (m["name"], m["paramCount"], m["nestingDepth"]) == ("m", 7, 2)
    # if, switch and two groups, catch; && and || count in every binary expression that holds them
    assert m["complexity"] == 1 + 5 + 3 and deep["nestingDepth"] == 5
    for name in ("c.c", "d.cpp"):
        own = got[name]
        assert own["classCount"] == 1 and own["importCount"] == 1
        assert [(x["name"], x["paramCount"], x["complexity"]) for x in own["functions"]] == [("f", 2, 3)]
    assert got["e.py"]["totalLines"] == got["n.py"]["totalLines"] == 0 and got["e.py"]["commentDensity"] == 0.0


def test_rules(parsed, measured):
    rows = rules.findings(parsed, measured).collect()
    got = {}
    for r in rows:
        got.setdefault(r["file"], set()).add((r["ruleId"], r["line"]))
    assert len({r["id"] for r in rows}) == len(rows)
    assert {(r, x) for r, x in got["a.py"] if r != "py-hardcoded-secret"} == {("py-shell-true", 12), ("py-bare-except", 18), ("py-open-no-close", 17), ("py-open-no-close", 21), ("py-eval", 19), ("py-assert-on-tuple", 20), ("py-too-many-params", 4)}  # 21: a call with an alias lies in an as_pattern
    assert ("py-hardcoded-secret", 24) in got["a.py"] and ("py-hardcoded-secret", 1) in got["a.py"]
    assert got["A.java"] == {("java-too-many-params", 4), ("java-switch-no-default", 5), ("java-resource-leak", 6), ("java-empty-catch", 7), ("java-deep-nesting", 9)}
    want = {("c-resource-leak", 1), ("c-gets", 5), ("c-sprintf-overflow", 6), ("c-div-zero", 6), ("c-null-check-after-deref", 7)}
    assert got["c.c"] == got["d.cpp"] == want
    one = next(r for r in rows if r["ruleId"] == "py-eval")
    assert one["column"] == 13 and one["snippet"] == 'exec("1")' and one["id"] == "py-eval:a.py:19:13"
    params = next(r for r in rows if r["ruleId"] == "java-too-many-params")
    assert params["message"].endswith(": m")


@settings(max_examples=80, deadline=None)
@given(st.sampled_from(["python", "java", "c", "cpp"]), st.lists(st.sampled_from(["def f(", ")", ":", "\n", "    ", "{", "}", "if", "(", "x", "=", "1", '"', "'", ";", "class A", "for", "#", "//", "/*", "->", "<", ">", "@", "case 1:", "\\", "lambda", "new", ","]), max_size=40).map(" ".join))
def test_parsers_take_anything(language, text):
    rows = flatten(tree_of(text, language), text)
    covered = {i for r in rows if r["leaf"] for i in range(r["start_off"], r["end_off"])}
    assert all(c.isspace() or c == "\\" or i in covered for i, c in enumerate(text))
    assert all(r["pre"] <= r["last"] and r["parent"] < r["pre"] for r in rows)


def test_hashes(spark):
    texts = ["", "a", "aé€", "😀x", "long " * 20]
    one = clones.with_gram_hashes(spark.createDataFrame([([t],) for t in texts], "t array<string>"), "t")
    assert [r["k_gram_hashes"] for r in one.collect()] == [[fnv(t)] for t in texts]
    values = [0, 1, 2**31, 2**32 - 1, 12345]
    rows = spark.createDataFrame([(values,), ([],), (None,), (list(range(70_000)),), ([7],)], "h array<bigint>").coalesce(1)
    want = [min(mixed(v, s) for v in values) for s in range(128)]
    got = [r["signature"] for r in clones.minhash(rows, "h").collect()]
    assert got[:3] == [want, [], []] and got[4] == [mixed(7, s) for s in range(128)]
    assert got[3][:4] == [min(mixed(v, s) for v in range(70_000)) for s in range(4)]
    tokens = [["a", "b"] * 10, ["x"], [], None, [f"w{i}é" for i in range(30)], ["😀"] * 13]
    made = [r["k_gram_hashes"] for r in clones.with_gram_hashes(spark.createDataFrame([(t,) for t in tokens], "t array<string>"), "t").collect()]
    grams = lambda t: [fnv("\x01".join(t[i : i + 12])) for i in range(max(1, len(t) - 11))] if t else []
    assert made == [list(dict.fromkeys(grams(t))) for t in tokens] and [len(g) for g in made] == [2, 1, 0, 0, 19, 1]


def test_tokens(parsed):
    own = parsed.where("file = 'c.c'").select(clones.tokens().alias("t")).first()["t"]
    values = [t["value"] for t in own]
    assert values.count("NUM") == 7 and "STR" in values and "ID" in values and "{" in values
    assert not any("comment" in v for v in values)


@settings(max_examples=60, deadline=None)
@given(st.text("ab \t\n\r#/* ", max_size=30))
def test_lines_plain(text):
    parts = re.split("\r\n|\r|\n", text)
    want = [] if not text else parts[:-1] if parts[-1] == "" else parts
    assert LINES(text) == want


def LINES(text):
    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession()
    return s.createDataFrame([(text,)], "t string").select(X.lines(F.col("t")).alias("l")).first()["l"]


def sets(spark, *rows):
    return spark.createDataFrame([(k, f, h, []) for k, f, h in rows], "project_key string, file string, k_gram_hashes array<bigint>, signature array<bigint>")


def test_project_pairs(spark):
    df = sets(spark, ("p", "a", [1, 2, 3]), ("p", "b", [1, 2, 4]), ("p", "e", []), ("q", "a", [1, 2, 3]), *(("r", f"f{i}", [7, 8]) for i in range(9)), ("r", "g", [8, 9]))
    got = [(r["project_key"], r["file_a"], r["file_b"], r["jaccard"]) for r in clones.project_pairs(df, 0.2, mode="exact").orderBy("project_key", "seq").collect()]
    assert got == [("p", "a", "b", 0.5), *(("r", "f0", f"f{i}", 1.0) for i in range(1, 6))]
    assert clones.project_pairs(df.where("project_key = 'p'"), 0.6, mode="exact").count() == 0
    zero = clones.project_pairs(sets(spark, ("p", "a", [1]), ("p", "b", [2])), 0.0, mode="exact")
    assert zero.count() == 0  # nothing in common


def test_many_files_switch_to_bands(spark):
    df = clones.minhash(sets(spark, *(("p", f"f{i:03d}", [1000 * i + k for k in range(5)] if i else [1, 2]) for i in range(150)), ("p", "g", [1, 2])).drop("signature"))
    got = clones.project_pairs(df, 0.2).collect()
    assert [(r["file_a"], r["file_b"]) for r in got] == [("f000", "g")]


def test_history_pairs(spark):
    cur, old = sets(spark, ("p", "a", [1, 2, 3])), sets(spark, ("p", "a", [1, 2, 3]), ("o", "x", [1, 2, 3]), ("o", "y", [1, 2, 3]), ("n", "z", [3, 9]))
    got = [(r["file_a"], r["file_b"], r["jaccard"]) for r in clones.history_pairs(cur, old, 0.2).orderBy("seq").collect()]
    assert got == [("a", "history/o/x", 1.0), ("a", "history/o/y", 1.0), ("a", "history/n/z", 0.25)]


def test_lists_that_copies_fill(spark, monkeypatch):
    """No grams are brought together where copies fill the lists, and the lists are those of all pairs."""
    copies = [(p, f"{p}{i}", [1, 2, 3]) for p in "pq" for i in range(8)]
    df = sets(spark, *copies, *[(p, f"near-{p}", [1, 2, 3, 4]) for p in "pq"])
    monkeypatch.setattr(clones, "shared_grams", lambda *_: pytest.fail("grams are brought together"))
    for mode in ("exact", "lsh"):
        own = clones.project_pairs(df, 0.2, mode=mode).orderBy("project_key", "seq").collect()
        assert [(r["file_a"], r["file_b"], r["jaccard"]) for r in own] == [(f"{p}0", f"{p}{i}", 1.0) for p in "pq" for i in range(1, 6)]
        old = clones.history_pairs(df, df, 0.2, mode=mode).orderBy("project_key", "seq").collect()
        want = [(f"{p}{i}", f"history/{q}/{q}{j}", 3) for p, q in ("pq", "qp") for i in range(8) for j in range(8)]
        near = lambda p, q: (f"near-{p}", f"history/{q}/near-{q}", 4)
        want = [x for p, q in ("pq", "qp") for x in [near(p, q), *[w for w in want if w[0][0] == p][:49]]]
        assert [(r["file_a"], r["file_b"], r["matching_k_grams"]) for r in old] == want


def test_grams_in_common(spark):
    """As told by brute force, whatever chunks and ranges they travel in: 32-bit hashes, longer ones, negative ones."""
    rng = random.Random(3)
    passages = [[rng.getrandbits(32) for _ in range(40)] for _ in range(12)] + [[-5, 2**40, 7]]
    rows = [("pq"[i % 2], f"f{i:03d}", sorted({rng.getrandbits(32) for _ in range(30)}.union(*rng.sample(passages, i % 4)))) for i in range(120)]
    df = sets(spark, *rows, ("p", "none", [])).repartition(3, "file")
    for options in ({}, {"chunk": 500, "span": 64}):
        got = clones.common_grams(df, ["project_key", "file"], "k_gram_hashes", **options).collect()
        holders = {}
        for p, f, h in rows:
            for g in h:
                holders.setdefault(g, []).append((p, f))
        entries = {}
        for g, at in holders.items():
            if len(at) > 1:
                entries.setdefault(tuple(at), []).append(g)
        size = {(p, f): len(h) for p, f, h in rows}
        want = [(*x, size[x], min(grams, key=lambda g: g % 2**64), len(grams)) for at, grams in entries.items() for x in at]
        assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100


def test_grams_of_one_set_cost_few_bytes(spark):
    """Where lists are open, all grams meet, and those that nothing shares (nearly all of them) take some 3 bytes each."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(500)), lambda k: F.abs(F.hash("id", k)).cast("bigint")))
    df = spark.range(2000, numPartitions=2).select(F.lit("p").alias("project_key"), F.format_string("f%05d", "id").alias("file"), grams.alias("k_gram_hashes"), F.array().cast("array<bigint>").alias("signature"))
    before = written()
    clones.project_pairs(df, 0.2, mode="exact").collect()
    assert 1_000_000 < written() - before < 6_000_000


def test_blocks():
    body = [f"t{i}" for i in range(28)]
    lines = [1 + i // 4 for i in range(28)] + [9, 10] + [20 + i // 4 for i in range(28)]
    assert blocks.repeated_blocks([*body, "u", "v", *body], lines) == [(28, 1, 7, 20, 26)]
    assert blocks.repeated_blocks(body + body, [1] * 14 + [2] * 14 + [3] * 14 + [4] * 14) == []


def test_blocks_that_meet_on_a_line():
    """Two repeats that share their last and first line on both sides, but no token, are both kept."""
    one, two = [f"a{i}" for i in range(24)], [f"b{i}" for i in range(24)]
    first = [1] * 10 + [2] * 10 + [3] * 4
    second = [3] * 10 + [4] * 10 + [5] * 4
    values = [*one, "x", *two, "gap", *one, "y", *two]
    lines = [*first, 3, *second, 6, *(n + 10 for n in first), 13, *(n + 10 for n in second)]
    assert blocks.repeated_blocks(values, lines) == [(24, 1, 3, 11, 13), (24, 3, 5, 13, 15)]


def plain_blocks(values, lines, least=24, most=5, per_seed=20):
    """The selection as nested loops."""
    seeds, found = {}, {}
    for i in range(len(values) - 11):
        seeds.setdefault(tuple(values[i : i + 12]), []).append(i)
    for places in seeds.values():
        for x, a in enumerate(places[:per_seed]):
            for b in places[x + 1 : per_seed]:
                k = 12
                while a + k < b and b + k < len(values) and values[a + k] == values[b + k]:
                    k += 1
                span = (lines[a], lines[a + k - 1], lines[b], lines[b + k - 1])
                if b - a >= least <= k and span[1] - span[0] > 1 and span[3] - span[2] > 1:
                    found.setdefault(span, (k, a, b))
    kept = []
    for span, (k, a, b) in sorted(found.items(), key=lambda x: -x[1][0]):
        if len(kept) < most and not any(a < c + n and c < a + k and b < d + n and d < b + k for (n, *_), c, d in kept):
            kept.append(((k, *span), a, b))
    return [x[0] for x in kept]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 40)), max_size=14), st.integers(1, 9), st.integers(2, 30))
def test_blocks_against_loops(parts, width, per_seed):
    values = [f"t{kind * (1 + i % 7 if kind == 3 else i)}" for kind, n in parts for i in range(n)]
    lines = [1 + i // width for i in range(len(values))]
    assert blocks.repeated_blocks(values, lines, per_seed=per_seed) == plain_blocks(values, lines, per_seed=per_seed)


def test_clone_rate(spark):
    files = spark.createDataFrame([("p", "a", 100), ("p", "b", 100), ("q", "z", 0)], "project_key string, file string, ncloc bigint")
    pairs = spark.createDataFrame([("p", "a", "a", "block", 1, 10, 31, 40), ("p", "a", "a", "block", 5, 14, 31, 46), ("p", "b", "history/o/x", "file", None, None, None, None)], "project_key string, file_a string, file_b string, kind string, start_line_a bigint, end_line_a bigint, start_line_b bigint, end_line_b bigint")
    got = {r["project_key"]: r["clone_rate"] for r in clones.clone_rate(pairs, files).collect()}
    assert got == {"p": (100 + 14 + 16) / 200, "q": 0.0}


def test_scoring(spark, measured):
    projects = spark.createDataFrame([("p", 50, 0, 0, 0.3)], "project_key string, overComplexFunctions bigint, overLongFunctions bigint, deeplyNestedFunctions bigint, cloneRate double")
    none = measured.limit(0)
    found = spark.createDataFrame([("p", "CRITICAL", "a", 1, 1, "r"), ("p", "INFO", "a", 2, 1, "r")], "project_key string, severity string, file string, line int, column int, ruleId string")
    got = scoring.score_projects(projects, none, found, DEFAULT_PROFILE).first()
    assert math.isclose(got["score"], 100 - 3 - 50 - 1) and not got["passed"] and len(got["failure_reasons"]) == 4
    assert [d["count"] for d in got["deductions"]] == [1, 50, None]
    assert scoring.score_projects(projects, none, found, DEFAULT_PROFILE, 46).first()["passed"]


def test_options():
    assert ScanOptions.from_json(None) == ScanOptions() and ScanOptions().clone_threshold == 0.2
    got = ScanOptions.from_value({"languages": ["c", "go"], "cloneThreshold": 7, "engines": {"rules": False}, "scoring": {"passScore": -3, "custom": {"passScore": 999, "metrics": {"cloneRate": {"threshold": -1, "penalty": 2}, "maxComplexity": {"threshold": "x", "penalty": 1}}}}})
    assert got.languages == ("c",) and got.clone_threshold == 1.0 and not got.rules and got.pass_score == 0.0
    profile = got.profile()
    assert profile.pass_score == 100.0 and profile.metric_rules == {"cloneRate": MetricRule(0.0, 2.0)} and profile.finding_penalties["MINOR"] == 0.5
    assert CustomProfile.from_value({"metrics": {}}) is None and ScanOptions.from_value([]).languages == ("python", "java", "c", "cpp")
    with pytest.raises(UnknownProfileError):
        find_profile("none")
    with pytest.raises(ValueError):
        ScanOptions.from_json("{")


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    row = lambda k, f, h: (k, None, f, "c", 3, 2, h, [1], 5)
    make = lambda *rows: spark.createDataFrame(list(rows), FINGERPRINTS)
    names = lambda: [(r["project_key"], r["file"]) for r in store.load(spark, path).collect()]
    assert names() == []
    store.save(make(row("12", "b", [1]), row("12", "a", [2]), row("x", "c", [3])), path, ["12", "x"])
    assert names() == [("12", "a"), ("12", "b"), ("x", "c")]
    store.save(make(row("12", "n", [1]), row("12", "dropped", [])), path, ["12"])
    assert names() == [("12", "n"), ("x", "c")]
    store.save(make(), path, ["x"])
    assert names() == [("12", "n")] and store.load(spark, path, ["12"]).count() == 0
    legacy = tmp_path / "old.json"
    legacy.write_text('{"version": 1, "projects": {"12": {"projectKey": "12", "updatedAt": "2024-01-01T00:00:00Z", "files": [{"file": "z", "kGramHashes": [1], "signature": [1]}]},\n "l": {"projectKey": "l", "updatedAt": "2024-01-01T00:00:00Z", "files": [{"file": "k", "language": "c", "tokenCount": 1, "kGramSize": 1, "kGramHashes": [4], "signature": [1], "ncloc": 2}, {"file": "bad"}]}}}')
    assert store.import_legacy(spark, f"file://{legacy}", path) == 1 and store.import_legacy(spark, f"file://{legacy}", path) == 0
    assert names() == [("12", "n"), ("l", "k")]


def test_ignore(spark):
    found = parse_files([("", "# c\n*.log\n!keep.log\n/top.py\nout/\na/**/z.py\n"), ("sub", "x?.py\n/only.py\n")])
    paths = {"a.log": True, "d/keep.log": False, "top.py": True, "d/top.py": False, "out/a.py": True, "d/out/a.py": True, "out": False, "a/b/c/z.py": True, "sub/d/x1.py": True, "x1.py": False, "sub/only.py": True, "sub/d/only.py": False, "b.py": False}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", ignored(found, F.col("p")).alias("i")).collect()
    assert {r["p"]: r["i"] for r in got} == paths


def test_formats(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (2.5,), (1234567.0,), (0.0,)], "v double")
    got = df.select(X.number(F.col("v"), 1).alias("n"), X.number(F.col("v")).alias("z"), X.percent(F.col("v")).alias("p")).collect()
    assert [r["n"] for r in got] == ["0.3", "0.4", "2.5", "1,234,567.0", "0.0"] == [R.shown(v, 1) for v in (0.25, 0.35, 2.5, 1234567.0, 0.0)]
    assert [r["z"] for r in got][2:4] == ["3", "1,234,567"] and got[0]["p"] == "25.0%"
    one = spark.createDataFrame([("/a b/ü.x/",)], "k string").select(X.report_name(F.col("k")).alias("n"), X.escape_html(F.lit("<a&\"'>")).alias("e")).first()
    assert (one["n"], one["e"]) == ("a-b-.x", "&lt;a&amp;&quot;&#39;&gt;")


def test_views(spark, measured):
    found = spark.createDataFrame([("p", "a.py", "MAJOR", "py-x", "Some Text", i) for i in range(23)] + [("p", "c.c", "MINOR", "c-x", "other", 1)], "project_key string, file string, severity string, ruleId string, message string, line int")
    assert views.filter_findings(found, measured, language="c").count() == 1
    assert views.filter_findings(found, measured, severity="MAJOR", file="a.py", text="some t").count() == 23
    assert [r["line"] for r in views.page(found.where("severity = 'MAJOR'"), 3, F.col("line")).collect()] == [20, 21, 22]
    assert spark.range(1).select(views.page_count(F.lit(0)).alias("n")).first()["n"] == 1
    assert [r["file"] for r in views.distinct_files(found).collect()] == ["a.py", "c.c"]


def test_nodes_of_null():
    assert nodes_of(None, "python")[0]["type"] == "module"
