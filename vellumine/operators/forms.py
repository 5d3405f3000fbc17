"""Form fields: kinds, display, checks, expressions and ordered calculations."""
from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a checkbox may hold when it is off.
OFF = ("", "off", "no", "false", "0")
TRUE = ("yes", "true", "1")


def kind(pdf_type: Column, flags: Column, compat: bool = False) -> Column:
    """Field kind from type and flags. compat: combo flag read the other way round, as some writers do."""
    combo = flags.bitwiseAND(0x20000) != 0
    return (
        F.when(pdf_type == "Btn", F.when(flags.bitwiseAND(0x8000) != 0, "radio").otherwise("checkbox"))
        .when(pdf_type == "Ch", F.when(combo != F.lit(compat), "combo").otherwise("list"))
        .when(pdf_type == "Sig", "signature").otherwise("text")
    )


def is_on(value: Column, imported: bool = False) -> Column:
    """Checkbox truth: imports accept yes, true and 1; scans take anything that isn't an off word."""
    return F.lower(value).isin(*TRUE) if imported else ~F.lower(value).isin(*OFF)


def display(tag: Column, text: Column, flag: Column, items: Column) -> Column:
    return F.when(tag == "bool", F.when(flag, "Yes").otherwise("No")).when(tag == "multi", F.array_join(items, ", ")).otherwise(F.coalesce(text, F.lit("")))


def violations(value: Column, required: Column, least: Column, most: Column) -> Column:
    """Array of broken rules; lengths are bytes and null limits don't bind."""
    n = F.octet_length(F.coalesce(value, F.lit("")))
    broken = F.array(F.when(required & (n == 0), "required"), F.when(n > most, "too long"), F.when((n > 0) & (n < least), "too short"))
    return F.filter(broken, lambda x: x.isNotNull())


def full_names(fields: DataFrame) -> DataFrame:
    """fields: node, parent, name. Leaves with their dotted names."""
    from .tree import closure

    parents = fields.select(F.col("parent").alias("p")).where("p IS NOT NULL").distinct()
    leaves = fields.join(parents, F.col("node") == F.col("p"), "left_anti").select("node")
    up = closure(fields, 32).join(leaves, "node").join(fields.select(F.col("node").alias("ancestor"), F.col("name").alias("part")), "ancestor")
    parts = F.reverse(F.array_sort(F.collect_list(F.struct("distance", "part"))))
    return up.groupBy("node").agg(F.array_join(F.transform(parts, lambda x: x["part"]), ".").alias("full_name"))


def import_values(fields: DataFrame, values: DataFrame) -> DataFrame:
    """fields: name, value; values: name, value. Known names take the new value; changed says whether it differs."""
    new = values.select("name", F.col("value").alias("new"))
    rows = fields.join(new, "name", "left")
    return rows.select("name", F.coalesce("new", "value").alias("value"), (F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("value"))).alias("changed"))


_TOKEN = re.compile(r'\s*(?:(\d+(?:\.\d*)?|\.\d+)|(?:this\.)?getField\(\s*["\']([^"\']+)["\']\s*\)(?:\.value)?|([A-Za-z_]\w*)|([-+*/()]))')
#: Parts of scripts, lower-cased, that are refused wherever they stand.
REFUSED = ("app.", "this.export", "net.", "util.printd", "doc.", "event.", "xmlhttp", "eval(", "function ")
#: Operations of the simple calculation.
OPERATIONS = ("SUM", "PRD", "AVG", "MIN", "MAX")


class CalculationError(ValueError):
    pass


def refuse(text: str) -> None:
    """An error for scripts that reach beyond calculation."""
    low = text.lower()
    for part in REFUSED:
        if part in low:
            raise CalculationError(f"unsupported: {part.strip()}")


def parse(text: str) -> tuple:
    """Numbers, fields, + - * / and parentheses as nested tuples; never evaluated as code."""
    refuse(text)
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise CalculationError("unsupported")
        tokens.append(("num", float(m[1])) if m[1] else ("field", m[2] or m[3]) if m[2] or m[3] else ("op", m[4]))
        at = m.end()
    place = 0

    def peek() -> str | None:
        return tokens[place][1] if place < len(tokens) and tokens[place][0] == "op" else None

    def atom() -> tuple:
        nonlocal place
        if place >= len(tokens):
            raise CalculationError("unexpected end")
        t = tokens[place]
        place += 1
        if t[0] != "op":
            return t
        if t[1] == "-":
            return ("neg", atom())
        if t[1] == "(":
            inner = total()
            if peek() != ")":
                raise CalculationError("missing parenthesis")
            place += 1
            return inner
        raise CalculationError("misplaced sign")

    def chain(below, signs: str) -> tuple:
        nonlocal place
        left = below()
        while peek() and peek() in signs:
            op = tokens[place][1]
            place += 1
            left = (op, left, below())
        return left

    def product() -> tuple:
        return chain(atom, "*/")

    def total() -> tuple:
        return chain(product, "+-")

    tree = total()
    if place != len(tokens):
        raise CalculationError("trailing text")
    return tree


def evaluate(tree: tuple, fields: dict[str, float]) -> float:
    head = tree[0]
    if head == "num":
        return tree[1]
    if head == "field":
        if tree[1] not in fields:
            raise CalculationError(f"no field {tree[1]}")
        return fields[tree[1]]
    if head == "neg":
        return -evaluate(tree[1], fields)
    x, y = evaluate(tree[1], fields), evaluate(tree[2], fields)
    if head == "/" and y == 0:
        raise CalculationError("division by zero")
    return {"+": x + y, "-": x - y, "*": x * y}[head] if head != "/" else x / y


def as_column(text: str) -> Column:
    """The expression over columns of the same names; division by zero is null."""

    def build(tree: tuple) -> Column:
        if tree[0] == "num":
            return F.lit(tree[1])
        if tree[0] == "field":
            return F.col(f"`{tree[1]}`").cast("double")
        if tree[0] == "neg":
            return -build(tree[1])
        x, y = build(tree[1]), build(tree[2])
        return F.try_divide(x, y) if tree[0] == "/" else {"+": x + y, "-": x - y, "*": x * y}[tree[0]]

    return build(parse(text))


_SIMPLE = re.compile(r"afsimple_calculate", re.I)
_QUOTED = re.compile(r"""(["'])(.*?)\1""")


def simple_call(script: str) -> tuple[str, list[str]] | None:
    """Operation and field names of a simple calculation, None for any other script. Case doesn't matter.

    The operation is the first of OPERATIONS that stands in quotes; every other quoted string names a field.
    """
    if not _SIMPLE.search(script):
        return None
    quoted = [m[2] for m in _QUOTED.finditer(script)]
    asked = {q.upper() for q in quoted}
    operation = next((o for o in OPERATIONS if o in asked), None)
    if operation is None:
        raise CalculationError("unsupported")
    names = [q for q in quoted if q.upper() not in OPERATIONS]
    if not names:
        raise CalculationError("no field names")
    return operation, names


def simple(operation: str, values: list[float]) -> float:
    kinds = {"SUM": sum, "PRD": math.prod, "AVG": lambda v: sum(v) / len(v) if v else 0.0, "MIN": lambda v: min(v, default=math.inf), "MAX": lambda v: max(v, default=-math.inf)}
    if operation.upper() not in kinds:
        raise CalculationError("unsupported")
    return float(kinds[operation.upper()](values))


def number_text(value: float) -> str:
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def calculate(fields: dict[str, str], scripts: dict[str, str], order: list[str], enabled: bool = True) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Values after all calculations, each feeding the next, and (field, outcome) for changed and failed ones."""
    values, log = dict(fields), []
    if not enabled:
        return values, log
    for name in order:
        script = scripts.get(name)
        if script is None:
            continue
        numbers = {}
        for k, v in values.items():
            try:
                numbers[k] = float(v) if v else 0.0
            except ValueError:
                numbers[k] = 0.0
        try:
            refuse(script)
            call = simple_call(script)
            if call:
                for x in call[1]:
                    if x not in numbers:
                        raise CalculationError(f"no field {x}")
                result = simple(call[0], [numbers[x] for x in call[1]])
            else:
                result = evaluate(parse(script), numbers)
        except CalculationError as e:
            log.append((name, f"error: {e}"))
            continue
        if values.get(name) != number_text(result):
            values[name] = number_text(result)
            log.append((name, "updated"))
    return values, log


def run_calculations(forms: DataFrame) -> DataFrame:
    """forms: form, fields map, scripts map, calc_order array, enabled. form, fields, log."""

    def run(batches):
        for pdf in batches:
            out = [calculate(dict(f), dict(s), list(o), bool(e)) for f, s, o, e in zip(pdf["fields"], pdf["scripts"], pdf["calc_order"], pdf["enabled"])]
            yield pd.DataFrame({"form": pdf["form"], "fields": [list(v.items()) for v, _ in out], "log": [[f"{n}: {w}" for n, w in log] for _, log in out]})

    rows = forms.mapInPandas(run, "form long, fields array<struct<key:string,value:string>>, log array<string>")
    return rows.withColumn("fields", F.map_from_entries("fields"))
