"""Each query over whole tables against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import xxhash

from lintlake.llm import queries as q

from ..conftest import SF


def docs_of(name="documents"):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def simple_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, fps, radius=3):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark):
    docs = docs_of()
    fps = [simple_fingerprint(d["text"]) for d in docs]
    want = components([d["doc_id"] for d in docs], fps)
    got = {r["doc_id"]: r for r in q.op1_simhash(spark, SF).collect()}
    assert len(got) == len(docs)
    for d, f in zip(docs, fps, strict=True):
        assert got[d["doc_id"]]["fingerprint"] == f"{f:016x}"
        assert got[d["doc_id"]]["component_id"] == want[d["doc_id"]]
    assert any(k != v for k, v in want.items())


def test_minhash(spark):
    docs = sorted(docs_of(), key=lambda d: d["doc_id"])
    got = {r["doc_id"]: r for r in q.op4_minhash(spark, SF).collect()}
    by_text = defaultdict(set)

    def shingles(text):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def jaccard(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    assert len(got) == len(docs)
    for k, d in enumerate(docs):
        r, text, after = got[d["doc_id"]], d["text"], docs[(k + 1) % len(docs)]["text"]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - jaccard(shingles(text), shingles(edited))) < 0.25
        assert abs(r["near_next"] - jaccard(shingles(text), shingles(after))) < 0.25
        by_text[text].add(r["fingerprint"])
        by_text[edited].add(r["edited_fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_secrets(spark):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in q.op6_secrets(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        want = [(m.start(), 0, m.end()) for m in assign.finditer(r["text"]) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", r["text"]) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", r["text"]) if len(m[0]) >= 24]
        kinds = ("assign", "access", "hex")
        text = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(want))
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


def test_token_counts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(q.tokenizer_path("word_bpe_49k.json"))
    want = {d["doc_id"]: len(t.encode(d["text"] or "", add_special_tokens=False).ids) for d in docs_of()}
    got = q.op5_token_counts(spark, SF).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(q.tokenizer_path("byte_bpe_50k.json"))
    got = defaultdict(list)
    for r in q.op10_packing(spark, SF).collect():
        got[r["doc_id"]].append(r)
    total, rows = 0, []
    for d in docs_of():
        ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        own = sorted(got[d["doc_id"]], key=lambda r: r["piece"])
        rows += own
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert own[0]["start"] == 0 and sum(r["length"] for r in own) == len(ids)
        assert len(ids) > 1024 or len(own) == 1
        for k, r in enumerate(own):
            assert r["length"] == 1024 or k == 0
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    check_layout(rows, 1024)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 1024) * 1.02 + 1


def check_layout(rows, size):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size


def test_quality_and_toxicity(spark):
    sf = SF.replace("0.001", "0.01")
    labels = {r["doc_id"]: r for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    for query, column, least in ((q.op3_quality, "quality", 0.95), (q.op7_toxicity, "toxic", 0.85)):
        rows = query(spark, sf).collect()
        assert len(rows) == 1000
        for r in rows:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            assert 0.0 <= r["score"] <= 1.0
            assert r["predicted"] == int(r["score"] >= (0.3 if column == "quality" else 0.5))
        held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
        assert sum(r["predicted"] == labels[r["doc_id"]][column] for r in held) >= least * len(held)


def test_html(spark):
    rows = q.op2_html_extraction(spark, SF).collect()
    assert len(rows) == 50
    pages = {p["page_id"]: p for p in docs_of("pages")}
    for r in rows:
        assert r["n_chars"] == len(r["text"]) > 0 and r["url"] == pages[r["page_id"]]["url"]
        assert "©" not in r["text"] and "track(" not in r["text"]
