"""Secret scans with one combined automaton.

All rules are compiled into one minimal deterministic automaton, and each text is read once, byte by byte, whatever the
number of rules. It reads from the end, so that it is in an accepting state just where a match begins; from there the
rule's own automaton follows the match to its end: leftmost, longest, non-overlapping matches.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton
from .common import with_arrow


@dataclass(frozen=True)
class Rule:
    """A match is ``head`` and then ``value``; it counts if the value has ``least`` characters.

    ``witness`` begins every match that counts, and every match that could take such a one's place; it is kept short where
    it can be, for counters of several rules multiply the states of the combined automaton.
    """

    kind: str
    head: str
    value: str
    least: int
    witness: str
    any_case: bool = False


# fixed values: the rules of the contract, in its order
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 6, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""", True),
    Rule("access", "", r"AKIA[A-Z0-9]+", 20, r"AKIA[A-Z0-9]"),
    Rule("hex", "", r"[0-9a-f]+", 24, r"[0-9a-f]{24}"),
)
EXTRA = (
    Rule("github", "", r"gh[pousr]_[A-Za-z0-9]+", 40, r"gh[pousr]_[A-Za-z0-9]"),
    Rule("slack", "", r"xox[abprs]-[A-Za-z0-9-]+", 20, r"xox[abprs]-[A-Za-z0-9-]"),
    Rule("pem", "", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 1, r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE + EXTRA


class Scanner:
    """One automaton for all rules finds where their matches begin; each match is then followed to its end once."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.all = Automaton([(r.witness, r.any_case) for r in rules], True, backwards=True)
        self.own = [Automaton([(r.head + r.value, r.any_case)], False) for r in rules]
        self.heads = [Automaton([(r.head, r.any_case)], False) if r.head else None for r in rules]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in code points, sorted. The work is that of the text's length."""
        data = text.encode("utf-8", "surrogatepass")
        out, free = [], [0] * len(self.rules)
        for at, bits in self.all.begins(data):
            for k, rule in enumerate(self.rules):
                if bits >> k & 1 and at >= free[k]:
                    end = self.own[k].longest(data, at)
                    begin = self.heads[k].longest(data, at) if rule.head else at
                    if end - begin >= rule.least:
                        out.append((at, k, end))
                    free[k] = max(at + 1, end)  # a match that does not count takes its place all the same
        out.sort()
        return self._in_code_points(out, data) if len(data) != len(text) else out

    @staticmethod
    def _in_code_points(spans: list[tuple[int, int, int]], data: bytes) -> list[tuple[int, int, int]]:
        """Byte places to code points; the text is decoded once, from place to place."""
        place, last, n = {}, 0, 0
        for b in sorted({x for s, _, e in spans for x in (s, e)}):
            n += len(data[last:b].decode("utf-8", "surrogatepass"))
            place[b], last = n, b
        return [(place[s], k, place[e]) for s, k, e in spans]


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """One scanner per process."""
    return Scanner(rules)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for every row: spans is an array of (kind, start, end) in code points, end exclusive, by start and
    then the order of ``rules``. Null and empty texts have none; null ids and repeated rows stay; extra columns are dropped.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        find = scanner(rules)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in find.spans(t or "")] for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

        return one

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_arrow(source, "doc_id long, spans array<struct<kind:string,start:long,end:long>>", make, "text")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) from the rows of scan(), row by row; no spans give the hash
    of the empty string."""
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{r.kind}')) as bigint)").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact_text(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    """The text with each span, and what overlaps it, replaced by its kind in brackets."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, k, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{rules[k].kind}]"]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced and ``n_chars``, if there, counted anew where a text changed. Every
    row stays, repeated ones, null and empty texts as they are; other columns are not looked at."""
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def make():
        find = scanner(rules)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            old = batch.column(at).to_pylist()
            new = [redact_text(t, s, rules) if t and (s := find.spans(t)) else t for t in old]
            data = list(batch.columns)
            data[at] = pa.array(new, data[at].type)
            if count is not None:
                data[count] = pa.array([len(b) if a != b else n for a, b, n in zip(old, new, data[count].to_pylist(), strict=True)], data[count].type)
            return pa.RecordBatch.from_arrays(data, names=batch.schema.names)

        return one

    return with_arrow(docs, docs.schema, make, "text")
