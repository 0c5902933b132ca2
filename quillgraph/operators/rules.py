"""Rules as rows: their expressions as tables of nodes, typed against layered symbol tables by joins, problems as rows.

A rule such as `total > 100 && status == 'OPEN'` is rewritten token by token into an expression that
Python's own parser reads; what it finds is a row per node. No node's type depends on anything but
itself and its symbol table, so typing is a join and checking an aggregation over a node's two operands.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_token
from ..sources.files import written
from .merge import conflicting_literals, duplicate_keys

#: Types of fields, and of what known functions return (fixed values).
FIELD_TYPES = {"UUID": "STRING", "String": "STRING", "LocalDate": "STRING", "Instant": "STRING", "Duration": "DURATION", "int": "NUMBER", "long": "NUMBER", "double": "NUMBER", "BigDecimal": "NUMBER", "boolean": "BOOLEAN"}
FUNCTION_TYPES = {"duration": "DURATION", "emitPayrollAdjustment": "BOOLEAN"}
_TOKEN = re.compile(r"""\s*(?:(?P<text>"[^"]*"?|'[^']*'?)|(?P<duration>P[T0-9HMSD]+(?![^\W_]))|(?P<number>\d[\d.]*)|(?P<name>[^\W\d]\w*)|(?P<sign>&&|\|\||==|!=|>=|<=|[<>(),])|(?P<end>\Z))""")
_DURATION = re.compile(r"P(?=.)(?:(\d+)D)?(?:T(?=.)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?")
_SIGNS = {"&&": " and ", "||": " or "}
_COMPARED = {ast.Eq: "==", ast.NotEq: "!=", ast.GtE: ">=", ast.LtE: "<=", ast.Gt: ">", ast.Lt: "<"}


def _literal(text: str) -> tuple[str, str]:
    """(type, value) of a literal by its text alone, whether it was quoted or not."""
    if text in ("true", "false"):
        return "BOOLEAN", text
    if re.fullmatch(r"-?\d+(\.\d+)?", text):
        return "NUMBER", text
    if re.fullmatch("P[T0-9HMSD]+", text):
        if not (m := _DURATION.fullmatch(text)):
            raise ValueError("no duration")
        days, hours, minutes, seconds = (int(x or 0) for x in m.groups())
        return "DURATION", f"{((days * 24 + hours) * 60 + minutes) * 60 + seconds} s"
    return "STRING", text


def _tokens(rule: str) -> tuple[str, list[tuple[str, str, str]]]:
    """The rule as a Python expression of names v0, v1, ..., and what these stand for: (kind, text, type)."""
    out, leaves, at, before = [], [], 0, ""
    while at < len(rule):
        m = _TOKEN.match(rule, at)
        if not m:
            raise ValueError("unexpected character")
        at, kind = m.end(), m.lastgroup
        if kind == "sign":
            if (m["sign"] == "(" and before in ("text", "duration", "number", ")")) or (m["sign"] == ")" and before == ","):
                raise ValueError("unexpected token")
            out.append(_SIGNS.get(m["sign"], m["sign"]))
            before = m["sign"]
        elif kind != "end":
            if kind == "name" and m["name"] not in ("true", "false"):
                leaves.append(("identifier", m["name"], ""))
            else:
                text = re.fullmatch("[\"'](.*?)[\"']?", m[kind], re.S)[1] if kind == "text" else m[kind]
                found, value = _literal(text)
                leaves.append(("literal", value, found))
                kind = "text"
            out.append(f" v{len(leaves) - 1} ")
            before = kind
    return "(" + "".join(out) + ")", leaves


def rule_nodes(rule: str) -> list[dict]:
    """(node, parent, side, kind, text, type) of each node of a rule's expression, node 0 at the top; kind identifier, literal, call or binary; ValueError if it can't be read."""
    source, leaves = _tokens(rule)
    try:
        top = ast.parse(source, mode="eval").body
    except (SyntaxError, RecursionError, MemoryError) as e:
        raise ValueError("unreadable") from e
    out: list[dict] = []

    def put(parent: int, side: int, kind: str, text: str, found: str = "") -> int:
        out.append({"node": len(out), "parent": parent, "side": side, "kind": kind, "text": text, "type": found})
        return len(out) - 1

    def chain(parts: list, signs: list[str]):
        """Operands and operators of one row of comparisons: relations bind before equalities, both from the left."""
        for tight in ((">=", "<=", ">", "<"), ("==", "!=")):
            k = 0
            while k < len(signs):
                if signs[k] in tight:
                    parts[k : k + 2] = [(signs.pop(k), parts[k], parts[k + 1])]
                else:
                    k += 1
        return parts[0]

    todo: list[tuple] = [(top, -1, 0)]
    while todo:
        x, parent, side = todo.pop()
        if isinstance(x, ast.Compare):
            x = chain([x.left, *x.comparators], [_COMPARED[type(o)] for o in x.ops])
        elif isinstance(x, ast.BoolOp):
            sign, first = ("&&" if isinstance(x.op, ast.And) else "||"), x.values[0]
            for value in x.values[1:]:
                first = (sign, first, value)
            x = first
        if isinstance(x, tuple):
            node = put(parent, side, "binary", x[0])
            todo += [(x[2], node, 1), (x[1], node, 0)]
        elif isinstance(x, ast.Name):
            put(parent, side, *leaves[int(x.id[1:])])
        elif isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and leaves[int(x.func.id[1:])][0] == "identifier":
            node = put(parent, side, "call", leaves[int(x.func.id[1:])][1])
            todo += [(a, node, k) for k, a in reversed(list(enumerate(x.args)))]
        else:
            raise ValueError("unexpected expression")
    return out


_NODES = pa.list_(pa.struct([("node", pa.int32()), ("parent", pa.int32()), ("side", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("type", pa.string())]))
#: Rules that a task remembers: many commands have the same ones.
REMEMBERED = 20_000


def parsed(rules: DataFrame) -> DataFrame:
    """Rules (command, rule_id, ordinal, ensure) -> with nodes; null where the rule can't be read, or is null. Equal rules of a task are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(REMEMBERED)
        def read(rule: str) -> list[dict] | None:
            try:
                return rule_nodes(rule)
            except ValueError:
                return None

        for batch in batches:
            texts = pc.fill_null(batch.column(3), "").dictionary_encode()
            found = pa.array([read(rule) for rule in texts.dictionary.to_pylist()], _NODES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], found.take(texts.indices)], names=["command", "rule_id", "ordinal", "nodes"])

    schema = "command string, rule_id string, ordinal long, nodes array<struct<node:int, parent:int, side:int, kind:string, text:string, type:string>>"
    return rules.select("command", "rule_id", F.col("ordinal").cast("long"), "ensure").mapInArrow(run, schema)


def symbol_table(symbols: DataFrame) -> DataFrame:
    """(command, name, type) from (command, name, type, layer, ordinal): a later layer, then a later row, replaces what the ones before it say."""
    return symbols.groupBy("command", "name").agg(F.max_by("type", F.struct("layer", "ordinal")).alias("type"))


def _field_type(kind: Column) -> Column:
    types = F.create_map(*(F.lit(x) for kv in FIELD_TYPES.items() for x in kv))
    return F.when(kind.startswith("enum("), "STRING").otherwise(F.coalesce(types[kind], F.lit("UNKNOWN")))


def rule_diagnostics(rules: DataFrame, symbols: DataFrame) -> DataFrame:
    """(command, rule_id, ordinal, code, level): what is wrong with rules (command, rule_id, ordinal, ensure), a row each time.

    symbols: see symbol_table(); a command that has none knows no names. Codes: RULE_UNPARSEABLE (a warning; the rule is left out of
    the other checks), RULE_UNKNOWN_IDENTIFIER, RULE_TYPE_BOOLEAN (an operand of && or || isn't a condition), RULE_TYPE_MISMATCH (known
    operand types that differ), RULE_DUPLICATE_ID (each repeat within a command) and RULE_CONFLICT (an equality with another literal
    than the command's first for the name). Names in capitals are texts. Rules of a command go by canonical id, then ordinal, which tells them apart.
    """
    read = written(parsed(rules).withColumn("token", canonical_token(F.col("rule_id"))), "rules")
    good = read.filter("nodes IS NOT NULL")
    key = ["command", "rule_id", "ordinal"]
    constant = lambda text: text.rlike(r"^[\p{L}_]+$") & (F.upper(text) == text)
    known = symbol_table(symbols).select("command", F.col("name").alias("text"), F.col("type").alias("declared"))
    functions = F.create_map(*(F.lit(x) for kv in FUNCTION_TYPES.items() for x in kv))
    # An operand says its type by itself, or is a name that the command's symbols type.
    own = lambda n: F.when(n["kind"] == "binary", "BOOLEAN").when(n["kind"] == "literal", n["type"]).when(n["kind"] == "call", F.coalesce(functions[n["text"]], F.lit("UNKNOWN"))).when(constant(n["text"]), "STRING")
    operand = lambda node, side: F.get(F.filter("nodes", lambda x: (x["parent"] == node) & (x["side"] == side)), F.lit(0))
    sides = lambda n: F.struct(n["text"].alias("sign"), operand(n["node"], 0).alias("n0"), operand(n["node"], 1).alias("n1"))
    pairs = good.select(*key, F.inline(F.transform(F.filter("nodes", lambda n: n["kind"] == "binary"), sides)))
    pairs = pairs.select(*key, "sign", *(x for s in (0, 1) for x in (F.coalesce(own(F.col(f"n{s}")), F.lit("")).alias(f"of{s}"), F.col(f"n{s}")["text"].alias(f"text{s}"))))
    logical = F.col("sign").isin("&&", "||")
    settled = lambda s: F.col(f"of{s}") != ""
    pairs = pairs.filter(~settled(0) | ~settled(1) | F.when(logical, (F.col("of0") != "BOOLEAN") | (F.col("of1") != "BOOLEAN")).otherwise(F.col("of0") != F.col("of1")))
    for s in (0, 1):
        named = known.select("command", F.col("text").alias(f"text{s}"), F.lit("").alias(f"of{s}"), F.col("declared").alias(f"declared{s}"))
        pairs = pairs.join(named, ["command", f"text{s}", f"of{s}"], "left").withColumn(f"of{s}", F.when(settled(s), F.col(f"of{s}")).otherwise(F.coalesce(_field_type(F.col(f"declared{s}")), F.lit("UNKNOWN"))))
    wrong = logical & ((F.col("of0") != "BOOLEAN") | (F.col("of1") != "BOOLEAN"))
    mixed = ~logical & (F.col("of0") != "UNKNOWN") & (F.col("of1") != "UNKNOWN") & (F.col("of0") != F.col("of1"))
    pairs = pairs.select(*key, F.when(wrong, "RULE_TYPE_BOOLEAN").when(mixed, "RULE_TYPE_MISMATCH").alias("code")).filter("code IS NOT NULL")
    names = good.select(*key, F.explode(F.transform(F.filter("nodes", lambda n: n["kind"] == "identifier"), lambda n: n["text"])).alias("text")).filter(~constant(F.col("text")))
    unknown = names.join(known, ["command", "text"], "left_anti")
    equal = good.filter(F.get("nodes", F.lit(0))["text"].isin("==", "!=") & (F.size("nodes") == 3))
    one, two = F.get("nodes", F.lit(1)), F.get("nodes", F.lit(2))
    uses = equal.filter((one["kind"] == "identifier") & (two["kind"] == "literal")).select(*key, "token", one["text"].alias("name"), two["text"].alias("value"))
    conflicts = conflicting_literals(uses, ["command", "name"], "value", "token", "ordinal")
    repeats = duplicate_keys(good.drop("nodes"), ["command", "rule_id"], "token", "ordinal")
    told = ((read.filter("nodes IS NULL"), "RULE_UNPARSEABLE"), (unknown, "RULE_UNKNOWN_IDENTIFIER"), (repeats, "RULE_DUPLICATE_ID"), (conflicts, "RULE_CONFLICT"))
    out = pairs
    for rows, code in told:
        out = out.unionByName(rows.select(*key, F.lit(code).alias("code")))
    return out.withColumn("level", F.when(F.col("code") == "RULE_UNPARSEABLE", "WARN").otherwise("ERROR"))
