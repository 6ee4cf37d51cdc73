"""``python -m graphloom --base FOLDER --root PROJECT [--callee_of F] [--caller_of F] [--callpath "F;G"] [--throwpath F]``

Answers in this order, each between banners. Returns 0, or 1 if a function that was asked for is unknown (of ``--caller_of``, if
nothing calls it) or a request for a path is not two different names."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from graphloom.engine import Engine
from graphloom.operators.onehop import overloads_of
from graphloom.operators.paths import UnknownFunction


def show(title: str, rows: DataFrame, column: str, order: str | None = None) -> int:
    """Prints a column of the rows, one by one as they come from the executors; gives how many there were."""
    n = 0
    print(f"BEGIN {title}")
    for r in (rows.orderBy(order) if order else rows).select(column).toLocalIterator():
        print(r[0])
        n += 1
    print(f"END {title}: {n}")
    return n


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom")
    for name in ("base", "root"):
        parser.add_argument(f"--{name}", required=True)
    for name in ("callee_of", "caller_of", "callpath", "throwpath"):
        parser.add_argument(f"--{name}")
    asked = parser.parse_args(arguments)
    engine = Engine(spark or SparkSession.builder.getOrCreate(), asked.base, asked.root)
    failed = 0
    if asked.callee_of:
        if overloads_of(engine.table("func_definitions"), asked.callee_of).isEmpty():
            failed = 1
            print(f"unknown function {asked.callee_of}")
        elif not show(f"callees of {asked.callee_of}", engine.callees_of(asked.callee_of), "callee"):
            print("it calls nothing")
    if asked.caller_of and not show(f"callers of {asked.caller_of}", engine.callers_of(asked.caller_of), "caller"):
        failed = 1
    for request, title, search in ((asked.callpath, "path", lambda q: engine.call_path(*_two(q))), (asked.throwpath, "path to a throw", engine.throw_path)):
        if request:
            try:
                show(f"{title} {request}", search(request), "qualified", "step")
            except (UnknownFunction, ValueError) as e:
                failed = 1
                print(f"{title} {request}: {e}")
    return failed


def _two(request: str) -> tuple[str, str]:
    parts = request.removesuffix(";").split(";")
    if len(parts) != 2:
        raise ValueError("a path request is two names around ;")
    return parts[0], parts[1]


if __name__ == "__main__":
    raise SystemExit(main())
