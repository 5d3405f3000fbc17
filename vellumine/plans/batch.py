"""Batch pipelines: steps read from stanzas, run one after another over a table of pages."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compliance, tree
from ..session import with_checkpoints


@dataclass
class Step:
    kind: str
    options: dict[str, str] = field(default_factory=dict)


@dataclass
class StepResult:
    kind: str
    ok: bool
    message: str = ""


#: Kinds of step and what each needs.
NEEDS = {"extract": ("first", "last"), "delete": ("pages",), "duplicate": ("pages",), "rotate": ("degrees",), "move": ("pages", "to"), "insert-blank": ("at",), "redact": ("term",), "split": ("size",), "stamp": ("text",)}


def parse(text: str) -> list[Step]:
    """Stanzas '[kind]' with 'key = value' lines; comments start with #. Unknown kinds, missing keys and stray lines are errors."""
    steps: list[Step] = []
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("[") and line.endswith("]"):
            kind = line[1:-1].strip()
            if kind not in NEEDS:
                raise ValueError(f"line {number}: no such step: {kind}")
            steps.append(Step(kind))
        elif "=" in line and steps:
            key, _, value = line.partition("=")
            steps[-1].options[key.strip()] = value.strip()
        else:
            raise ValueError(f"line {number}: neither a step nor an option")
    for s in steps:
        for key in NEEDS[s.kind]:
            if key not in s.options:
                raise ValueError(f"step {s.kind} needs {key}")
        for key in ("first", "last", "to", "at", "size", "degrees"):
            if key in s.options and not s.options[key].lstrip("-").isdigit():
                raise ValueError(f"step {s.kind}: {key} is no whole number")
    return steps


def _least_pages(pages: DataFrame) -> int:
    """Pages of the shortest document: what a step names has to be there in every one."""
    return pages.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.min("n"), F.lit(0))).first()[0]


def _numbers(pages: DataFrame, text: str) -> list[int]:
    return tree.page_list(text, _least_pages(pages))


def _within(pages: DataFrame, number: str, most: int = 0) -> int:
    """A page number from 1 on that every document has, or up to most more."""
    n, count = int(number), _least_pages(pages)
    if not 1 <= n <= count + most:
        raise ValueError(f"page {n} is outside 1 to {count + most}")
    return n


ACTIONS: dict[str, Callable[[DataFrame, dict[str, str]], DataFrame]] = {
    "extract": lambda p, o: tree.extract(p, int(o["first"]), _within(p, o["last"])),
    "delete": lambda p, o: tree.delete(p, _numbers(p, o["pages"])),
    "duplicate": lambda p, o: tree.duplicate(p, _numbers(p, o["pages"])),
    "move": lambda p, o: tree.move(p, _numbers(p, o["pages"]), _to(p, o["to"])),
    "insert-blank": lambda p, o: tree.insert_blank(p, _to(p, o["at"])),
    "rotate": lambda p, o: p.withColumn("rotation", F.pmod(F.coalesce("rotation", F.lit(0)) + int(o["degrees"]), F.lit(360))) if int(o["degrees"]) % 90 == 0 else _refuse("a quarter turn is needed"),
    "redact": lambda p, o: compliance.redact(p, o["term"]),
    "split": lambda p, o: tree.chunks(p, int(o["size"])),
    "stamp": lambda p, o: p.withColumn("text", F.concat_ws("\n", "text", F.lit(o["text"]))),
}


def _to(pages: DataFrame, number: str) -> int:
    """A place that pages are put before: a page from 0 on, or the end."""
    n, count = int(number), _least_pages(pages)
    if not 0 <= n <= count:
        raise ValueError(f"place {n} is outside 0 to {count}")
    return n


def _refuse(message: str) -> DataFrame:
    raise ValueError(message)


def run(pages: DataFrame, steps: list[Step]) -> tuple[DataFrame, list[StepResult]]:
    """pages: doc, page, text, rotation. The table after all steps that came before the first failure, and what each did.

    Each step's result is computed and kept in the checkpoint folder before it counts as done, so that a failure in
    computing it stops the run there.
    """
    with_checkpoints(pages.sparkSession)
    results = []
    for s in steps:
        try:
            pages = ACTIONS[s.kind](pages, s.options).checkpoint()
        except Exception as e:
            results.append(StepResult(s.kind, False, str(e)))
            break
        results.append(StepResult(s.kind, True))
    return pages, results
