"""Batches of text queries: lines closed by F; answers in the order of the queries.

    python -m sluice.plans.workload sql < queries        # the SQL of each query
    python -m sluice.plans.workload run RELATION... < queries
    python -m sluice.plans.workload run < relations, a line Done, queries
"""

from __future__ import annotations

import itertools
import sys
import time
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from sluice.plans.planner import answer, execute
from sluice.plans.spec import QuerySpec
from sluice.sources.catalog import Catalog


def batches(lines: Iterable[str]) -> Iterator[list[str]]:
    batch: list[str] = []
    for line in map(str.strip, lines):
        if line == "F":
            yield batch
            batch = []
        elif line:
            batch.append(line)
    if batch:
        yield batch


def run_workload(lines: Iterable[str], catalog: Catalog, at_once: int = 4, **options) -> list[str]:
    """An answer for each query; those of a batch run at the same time."""
    out: list[str] = []
    with ThreadPoolExecutor(at_once) as pool:
        for batch in batches(lines):
            out += pool.map(lambda text: answer(execute(QuerySpec.parse(text), catalog, **options)), batch)
    return out


def check_workload(lines: Iterable[str], expected: Iterable[str], catalog: Catalog, most: int = 100) -> tuple[float, list[tuple[int, str, str]]]:
    """Seconds of the batches, and up to ``most`` (place, expected, answer) that differ; at that number the run ends.

    Each batch is timed alone and compared before the next one begins.
    """
    want, took, wrong, place = [x.strip() for x in expected], 0.0, [], 0
    for batch in batches(lines):
        began = time.perf_counter()
        got = run_workload([*batch, "F"], catalog)
        took += time.perf_counter() - began
        wrong += [(place + i, a, b) for i, (a, b) in enumerate(zip(want[place:], got)) if a != b]
        place += len(got)
        if len(wrong) >= most:
            return took, wrong[:most]
    if len(want) != place:
        wrong.append((min(len(want), place), f"{len(want)} lines", f"{place} lines"))
    return took, wrong[:most]


def load(spark, paths: Iterable[str], at_once: int = 8) -> Catalog:
    """The relations of the files named, one a line up to a line ``Done``; headers are read at the same time, numbers follow the lines."""
    from sluice.sources.relation_io import read_relation

    names = list(itertools.takewhile(lambda x: x != "Done", filter(None, map(str.strip, paths))))
    catalog = Catalog()
    with ThreadPoolExecutor(at_once) as pool:
        for df in pool.map(lambda path: read_relation(spark, path), names):
            catalog.add(df, wide=True)
    return catalog


def main(args: list[str]) -> None:
    if args[:1] == ["sql"]:
        for line in sys.stdin:
            if line.strip() not in ("", "F"):
                print(QuerySpec.parse(line).to_sql())
        return
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    catalog = load(spark, args[1:] or iter(sys.stdin.readline, ""))
    for batch in batches(sys.stdin):
        print("\n".join(run_workload([*batch, "F"], catalog)), flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
