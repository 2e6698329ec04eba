"""The pipeline against brute force, stage by stage."""

from collections import defaultdict

import pyarrow.parquet as pq

import corpus_pipeline
from lintlake.llm import queries as q
from lintlake.llm.secret_scan import RULES, redact_text, scanner

from ..conftest import SF
from .test_edges import plain_hits
from .test_queries import check_layout, components, simple_fingerprint


def test_run(spark):
    docs = {d["doc_id"]: d for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    kept = sorted(r["doc_id"] for r in q.op3_quality(spark, SF).collect() if r["predicted"])
    groups = components(kept, [simple_fingerprint(docs[i]["text"]) for i in kept])
    kept = [i for i in kept if groups[i] == i]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    kept = [i for i in kept if not plain_hits(docs[i]["text"], items)[1]]
    from tokenizers import Tokenizer

    t, find = Tokenizer.from_file(q.tokenizer_path("byte_bpe_50k.json")), scanner()
    want = {}
    for i in kept:
        text = docs[i]["text"] or ""
        want[i] = len(t.encode(redact_text(text, find.spans(text), RULES), add_special_tokens=False).ids) + 1
    rows = corpus_pipeline.run(spark, SF).collect()
    got = defaultdict(int)
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert dict(got) == want
    check_layout(rows, 1024)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"]
