"""Queries that SQL cannot check, against a plain version on a few documents."""

import json
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from lintlake.operators import blocks, clones
from lintlake.plans import catalog


def text(name, lines=8, first=0):
    return "\n".join(" ".join(f"{name}x{first + i}x{j}" for j in range(6)) for i in range(lines))


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """p: six couples of copies (one beyond the best five), a text with repeated blocks, one that only q has too, one alone."""
    own = [text(f"c{k}", 20 - k) for k in range(6) for _ in range(2)]
    body = text("body", 6)
    rows = [("p", t) for t in [*own, f"{body}\n{text('mid', 3)}\n{body}", text("shared"), text("alone", 30)]]
    rows += [("q", t) for t in [text("shared") + "\nand more", text("other", 9)]]
    path = tmp_path_factory.mktemp("sf")
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, (s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"file://{path}/documents.parquet")
    return f"file://{path}", [(f"d{i:012d}", s, t) for i, (s, t) in enumerate(rows)]


def grams(t):
    w = t.lower().split()
    return {tuple(w[i : i + 12]) for i in range(max(1, len(w) - 11))}


def plain(rows, cut):
    """(list, rate) of each project."""
    pairs, found = defaultdict(list), {}
    for f, p, t in rows:
        own, old = [], []
        for g, q, u in rows:
            m = len(grams(t) & grams(u))
            j = m / len(grams(t) | grams(u))
            if m and j >= 0.2 and g != f and (p != q or f < g):
                (own if p == q else old).append((-j, -m, f, g if p == q else f"history/{q}/{g}"))
        words = [(w.lower(), i + 1) for i, line in enumerate(t.split("\n")) for w in line.split()]
        spans = blocks.repeated_blocks([w for w, _ in words], [i for _, i in words])
        pairs[p] += [(0, *x, 1) for x in own] + [(0, *x, 2) for x in old] + [(1, -1.0, 11 - k, f, f, 0, s) for k, *s in spans]
    for p, all_ in pairs.items():
        if cut:
            first = sorted((x for x in all_ if x[-1] == 1), key=lambda x: x[1:5])[:5]
            old = sorted((x for x in all_ if x[-1] == 2), key=lambda x: x[1:5])[:50]
            all_ = [*first, *old, *(x for x in all_ if x[0] == 1)]
        all_ = sorted(all_, key=lambda x: (*x[:3], x[5], x[3], x[4]))[: 50 if cut else None]
        lines = defaultdict(set)
        for x in all_:
            for f in x[3:5]:
                size = next((t.count("\n") + 1 for g, q, t in rows if (g, q) == (f, p)), 0)
                spans = [(x[6][0], x[6][1]), (x[6][2], x[6][3])] if x[0] else [(1, size)]
                lines[f] |= {i for s, e in spans for i in range(s, e + 1)}
        total = sum(t.count("\n") + 1 for _, q, t in rows if q == p)
        found[p] = ([(x[3], x[4], "block" if x[0] else "file", -x[2], *(x[6] if x[0] else [None] * 4)) for x in all_], min(1.0, sum(map(len, lines.values())) / total))
    return found


def test_boilerplate_in_all_files(spark):
    """Files that share most of their grams: all pairs are met, once each, and no gram's group meets in one task."""
    from lintlake.session import materialize

    n, common = 1200, list(range(1, 81))
    sets = spark.range(n, numPartitions=4).select(F.lit("p").alias("project_key"), F.format_string("f%05d", "id").alias("file"), F.concat(F.array(*map(F.lit, common)), F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.col("id") * 100 + 1000 + k)).cast("array<bigint>").alias("k_gram_hashes"))
    sets = materialize(sets.withColumn("signature", F.array().cast("array<bigint>")), "boilerplate")
    shared = clones.shared_grams(sets, ["project_key"], "file", "k_gram_hashes")
    assert shared.count() == n and shared.agg(F.min("w"), F.max("df")).first()[:] == (80, n)  # one entry for eighty grams
    met = clones.candidate_pairs(shared, ["project_key"], 0.2, chunk=100)
    assert met.count() == n * (n - 1) // 2
    assert clones.candidate_pairs(shared, ["project_key"], 0.8, chunk=100).count() == 0
    rows = clones._chunked(shared.withColumn("size", F.col("df")), ["gram"], "id", "size", 100).groupBy("_lo", "_hi").agg(F.count("*").alias("n")).collect()
    assert len(rows) == 12 * 13 // 2 and max(r["n"] for r in rows) <= 3 * sorted(r["n"] for r in rows)[len(rows) // 2]
    top = clones.project_pairs(sets, 0.2, mode="exact").orderBy("seq").collect()
    assert [(r["file_a"], r["file_b"], r["matching_k_grams"]) for r in top] == [("f00000", f"f{i:05d}", 80) for i in range(1, 6)]


def rates(df):
    return {r["project_key"]: pytest.approx(r["clone_rate"]) for r in df.collect()}


def test_merged_and_untruncated_rates(spark, documents):
    path, rows = documents
    want = {p: rate for p, (_, rate) in plain(rows, True).items()}
    every = {p: rate for p, (_, rate) in plain(rows, False).items()}
    assert rates(catalog.queries()["q22_merged_rate"](spark, path)) == want
    assert rates(catalog.queries()["q22_untruncated_rate"](spark, path)) == every
    assert every["p"] > want["p"] > catalog.queries()["q22_clone_rate"](spark, path).where("project_key = 'p'").first()["clone_rate"]


def test_report_lists_merged_pairs(spark, documents):
    path, rows = documents
    got = {r["project_key"]: json.loads(r["report"]) for r in catalog.reports(spark, path).collect()}
    for p, (pairs, rate) in plain(rows, True).items():
        assert got[p]["metrics"]["cloneRate"] == pytest.approx(rate)
        lines = ("startLineA", "endLineA", "startLineB", "endLineB")
        assert [(x["fileA"], x["fileB"], x["kind"], x["matchingKGrams"], *(x.get(c) for c in lines)) for x in got[p]["clonePairs"]] == pairs


def test_merged_list_has_blocks(spark, documents):
    path, rows = documents
    got = catalog.queries()["q41_merged_blocks"](spark, path).orderBy("project_key", "seq").collect()
    for p, (pairs, _) in plain(rows, True).items():
        lines = ("start_line_a", "end_line_a", "start_line_b", "end_line_b")
        own = [r for r in got if r["project_key"] == p]
        assert [(r["file_a"], r["file_b"], r["kind"], r["matching_k_grams"], *(r[c] or None for c in lines)) for r in own] == pairs
        assert [r["seq"] for r in own] == list(range(1, len(own) + 1))
    assert any(r["kind"] == "block" for r in got)


def test_merged_list_of_copies(spark, tmp_path, monkeypatch):
    """Where copies fill both lists of each project, the report's list is made without any shuffle of grams."""
    rows = [(p, text("copied")) for p in "pq" for _ in range(8)]
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, (s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    monkeypatch.setattr(clones, "shared_grams", lambda *_: pytest.fail("grams are brought together"))
    got = catalog.queries()["q41_merged_blocks"](spark, f"file://{tmp_path}").orderBy("project_key", "seq").collect()
    want = plain([(f"d{i:012d}", s, t) for i, (s, t) in enumerate(rows)], True)
    assert [(r["project_key"], r["file_a"], r["file_b"]) for r in got] == [(p, *x[:2]) for p in "pq" for x in want[p][0]]
