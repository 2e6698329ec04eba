"""The rule catalogue and its evaluation over node arrays."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .metrics import node_text, with_text_rows

#: Word boundaries as JavaScript has them: between an ASCII word sign and anything else.
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: Any white space, beyond ASCII too (``\s`` stands for ASCII alone here).
SP = rf"{X.BLANK}*"
# Patterns of the text rules.
CREDENTIAL = r"(?i)(?:password|passwd|secret|token|api[_-]?key|credential)"
QUOTED = r"""["'][^"']+["']"""
READERS = rf"(?:FileInputStream|FileReader|BufferedReader){RIGHT}"
FINDING = "struct<ruleId:string,severity:string,type:string,row:int,col:int,message:string,ord:bigint>"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    type: str
    language: str
    description: str
    #: of a node (node rules) or of a function metric (metric rules)
    matches: Callable[[Column], Column]
    on_functions: bool = False
    #: what must hold of the whole content for any node to match; spares the nodes of most files
    needs: str | None = None


def _parent(node: Column) -> Column:
    return F.get("nodes", node["parent"])


def _called(*names: str, call: str) -> Callable[[Column], Column]:
    """The identifier in the function place of a call."""
    return lambda n: (n["type"] == "identifier") & (n["field"] == "function") & (_parent(n)["type"] == call) & node_text(n).isin(*names)


def _secret(n: Column) -> Column:
    return n["named"] & node_text(n).rlike(CREDENTIAL) & node_text(n).rlike(QUOTED)


def _type(name: str, *patterns: str, no: str | None = None) -> Callable[[Column], Column]:
    def test(n: Column) -> Column:
        out = n["type"] == name
        for p in patterns:
            out = out & node_text(n).rlike(p)
        return out & ~node_text(n).rlike(no) if no else out

    return test


def _bare_except(n: Column) -> Column:
    return (n["type"] == "except_clause") & (X.trimmed(node_text(n)).rlike(rf"^except{SP}:") | node_text(n).rlike(rf"except{X.BLANK}+Exception{SP}:"))


def _open(n: Column) -> Column:
    return (n["type"] == "call") & node_text(n).rlike(rf"^open{SP}\(") & ~F.coalesce(_parent(n)["type"].contains("with"), F.lit(False))


def _tuple(n: Column) -> Column:
    return (n["type"] == "tuple") & (_parent(n)["type"] == "assert_statement")


def _switch(n: Column) -> Column:
    return n["type"].isin("switch_statement", "switch_expression") & n["named"] & ~node_text(n).rlike(rf"{LEFT}default{SP}:")


def _leak(n: Column) -> Column:
    return n["type"].isin("local_variable_declaration", "object_creation_expression") & node_text(n).rlike(READERS) & ~F.col("content").rlike(rf"\.close{SP}\(")


# Identifiers, severities, types and limits of the rules.
LONG, MANY, DEEP = 100, 6, 4


def _long(f: Column) -> Column:
    return f["lines"] > LONG


def _many(f: Column) -> Column:
    return f["paramCount"] > MANY


RULES = (
    Rule("py-eval", "CRITICAL", "VULNERABILITY", "python", "Code is run from text by eval or exec", _called("eval", "exec", call="call"), needs="eval|exec"),
    Rule("py-shell-true", "CRITICAL", "VULNERABILITY", "python", "A command is run through the shell", _type("call", rf"{LEFT}shell{SP}={SP}True{RIGHT}"), needs="shell"),
    Rule("py-bare-except", "MAJOR", "BUG", "python", "All exceptions are caught", _bare_except, needs="except"),
    Rule("py-hardcoded-secret", "CRITICAL", "VULNERABILITY", "python", "A credential may be written in the source", _secret, needs=CREDENTIAL),
    Rule("py-open-no-close", "MAJOR", "BUG", "python", "A file is opened outside a with statement", _open, needs="open"),
    Rule("py-assert-on-tuple", "MAJOR", "BUG", "python", "An assertion on a tuple always holds", _tuple, needs="assert"),
    Rule("py-long-func", "MINOR", "CODE_SMELL", "python", "The function is too long", _long, True),
    Rule("py-too-many-params", "MINOR", "CODE_SMELL", "python", "The function has too many parameters", _many, True),
    Rule("java-empty-catch", "MAJOR", "BUG", "java", "An exception is caught and ignored", _type("catch_clause", rf"\{{{SP}\}}"), needs="catch"),
    Rule("java-hardcoded-cred", "CRITICAL", "VULNERABILITY", "java", "A credential may be written in the source", _secret, needs=CREDENTIAL),
    Rule("java-switch-no-default", "MAJOR", "BUG", "java", "The switch has no default branch", _switch, needs="switch"),
    Rule("java-long-method", "MINOR", "CODE_SMELL", "java", "The method is too long", _long, True),
    Rule("java-too-many-params", "MINOR", "CODE_SMELL", "java", "The method has too many parameters", _many, True),
    Rule("java-deep-nesting", "MINOR", "CODE_SMELL", "java", "The method nests too deeply", lambda f: f["nestingDepth"] > DEEP, True),
    Rule("java-resource-leak", "MAJOR", "BUG", "java", "A stream or reader may stay open", _leak, needs=READERS),
    Rule("c-gets", "CRITICAL", "VULNERABILITY", "c", "gets cannot bound its input", _called("gets", call="call_expression"), needs="gets"),
    Rule("c-sprintf-overflow", "CRITICAL", "BUG", "c", "sprintf cannot bound its output", _called("sprintf", call="call_expression"), needs="sprintf"),
    Rule("c-null-check-after-deref", "MAJOR", "BUG", "c", "A pointer is used where it is not checked for null", _type("if_statement", rf"\*{SP}[A-Za-z_]\w*", no=rf"{LEFT}if{SP}\([^)]*!{SP}[A-Za-z_]\w*"), needs="if"),
    Rule("c-div-zero", "MAJOR", "BUG", "c", "A division by zero", _type("binary_expression", rf"/{SP}0(?:{RIGHT}|\.)"), needs="/"),
    Rule("c-hardcoded-secret", "CRITICAL", "VULNERABILITY", "c", "A credential may be written in the source", _secret, needs=CREDENTIAL),
    Rule("c-resource-leak", "MAJOR", "BUG", "c", "Memory is allocated and never freed", _type("translation_unit", rf"{LEFT}malloc{SP}\(", no=rf"{LEFT}free{SP}\("), needs="malloc"),
    Rule("c-long-func", "MINOR", "CODE_SMELL", "c", "The function is too long", _long, True),
    Rule("c-too-many-params", "MINOR", "CODE_SMELL", "c", "The function has too many parameters", _many, True),
)


def all_rules() -> list[Rule]:
    """The catalogue; C++ has the rules of C under their ids."""
    return [*RULES, *(Rule(**(r.__dict__ | {"language": "cpp"})) for r in RULES if r.language == "c")]


def catalogue(spark: SparkSession) -> DataFrame:
    """(rule_id, severity, type, language, description): one row per rule and language."""
    rows = [(r.rule_id, r.severity, r.type, r.language, r.description) for r in all_rules()]
    return spark.createDataFrame(rows, "rule_id string, severity string, type string, language string, description string")


def _of_rule(rule: Rule, ord_: int) -> Column:
    def row(place: Column, message: Column, nth: Column) -> Column:
        """A finding; of one rule those of later functions come later."""
        return F.struct(F.lit(rule.rule_id), F.lit(rule.severity), F.lit(rule.type), place["start_row"], place["start_col"], message, F.lit(ord_ * 1_000_000) + nth)

    if rule.on_functions:

        def located(f: Column) -> Column:
            """The first node with the function's first and last row."""
            same = F.filter("nodes", lambda n: n["named"] & (n["start_row"] + 1 == f["startLine"]) & (n["end_row"] + 1 == f["endLine"]))
            return F.get(same, F.lit(0))

        found = F.transform(F.filter("functions", rule.matches), lambda f, i: row(located(f), F.concat(F.lit(f"{rule.description}: "), f["name"]), i))
    else:
        found = F.transform(F.filter("nodes", lambda n: F.coalesce(rule.matches(n), F.lit(False))), lambda n, _: row(n, F.lit(rule.description), F.lit(0)))
    holds = F.col("language") == rule.language
    if rule.needs:
        holds = holds & F.col("content").rlike(rule.needs)
    return F.when(holds, found.cast(f"array<{FINDING}>")).otherwise(F.array().cast(f"array<{FINDING}>"))


def findings(parsed: DataFrame, metrics: DataFrame) -> DataFrame:
    """Findings of all rules, one row each, distinct by id (the last one found wins).

    Columns: project_key, id, ruleId, severity, type, file, line, column, message, snippet. ``metrics`` gives the
    functions of each file; it is joined on project and file.
    """
    df = with_text_rows(parsed.withColumn("content", F.coalesce("content", F.lit("")))).join(metrics.select("project_key", "file", "functions"), ["project_key", "file"])
    rows = F.split("content", "\r\n|\r|\n", -1)
    found = df.select("project_key", "file", rows.alias("_rows"), F.explode(F.flatten(F.array(*[_of_rule(r, i) for i, r in enumerate(all_rules())]))).alias("f"))
    made = found.select(
        "project_key",
        F.concat_ws(":", "f.ruleId", "file", (F.col("f.row") + 1).cast("string"), (F.col("f.col") + 1).cast("string")).alias("id"),
        "f.ruleId",
        "f.severity",
        "f.type",
        "file",
        (F.col("f.row") + 1).cast("bigint").alias("line"),
        (F.col("f.col") + 1).cast("bigint").alias("column"),
        "f.message",
        F.substring(X.trimmed(F.coalesce(F.get("_rows", F.col("f.row")), F.lit(""))), 1, 240).alias("snippet"),
        "f.ord",
    )
    return distinct_findings(made)


def distinct_findings(found: DataFrame, order: str = "ord") -> DataFrame:
    """One row per project and id: that with the largest ``order``."""
    kept = [c for c in found.columns if c not in ("project_key", "id", order)]
    best = found.groupBy("project_key", "id").agg(F.max_by(F.struct(*kept), F.struct(order, "message")).alias("r"))
    return best.select("project_key", "id", "r.*")


def sort_findings(found: DataFrame) -> DataFrame:
    """By file, line, column and rule, names in the order of the Unicode collation."""
    return found.orderBy(F.collate("file", "UNICODE"), "line", "column", F.collate("ruleId", "UNICODE"))
