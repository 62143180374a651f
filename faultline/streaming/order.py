"""A key's rows of a micro-batch in the order of ``seq``, however many there are."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from itertools import islice
from operator import attrgetter, itemgetter
from typing import IO, Any

from pyspark.sql import Row

#: Rows that are sorted in memory, and runs on disk that are merged into one.
RUN_ROWS, FAN_IN = 1 << 16, 64
#: Rows that are written and read at once.
BLOCK_ROWS = 1 << 8


def _write(rows: Iterable[tuple]) -> IO[bytes]:
    file, rows = tempfile.TemporaryFile(), iter(rows)
    while block := list(islice(rows, BLOCK_ROWS)):
        pickle.dump(block, file, pickle.HIGHEST_PROTOCOL)
    file.seek(0)
    return file


def _read(file: IO[bytes]) -> Iterator[tuple]:
    with file:
        while True:
            try:
                block = pickle.load(file)
            except EOFError:
                return
            yield from block


def by_seq(rows: Iterator[Row], run_rows: int = RUN_ROWS, fan_in: int = FAN_IN) -> Iterator[Row]:
    """``rows`` by ascending ``seq``, equal ones as they came.

    More than ``run_rows`` of them are sorted in runs, which lie in temporary files without a name
    and are merged; memory holds a run, or a block of each of ``fan_in`` runs.
    """
    rows = iter(rows)
    run = sorted(islice(rows, run_rows), key=attrgetter("seq"))
    if len(run) < run_rows:
        yield from run
        return
    names = run[0].__fields__
    make, place = Row(*names), itemgetter(names.index("seq"))
    # Levels of runs: a run of a level holds ``fan_in`` runs of the level below, so a row is written
    # once a level.  Later levels hold earlier rows, which keeps equal ones in their order.
    levels: list[list[IO[bytes]]] = [[]]
    while run:
        levels[0].append(_write(map(tuple, run)))
        for level, files in enumerate(levels):
            if len(files) == fan_in:
                merged = _write(heapq.merge(*map(_read, files), key=place))
                files.clear()
                if level + 1 == len(levels):
                    levels.append([])
                levels[level + 1].append(merged)
        run = sorted(islice(rows, run_rows), key=attrgetter("seq"))
    files = [file for level in reversed(levels) for file in level]
    for values in heapq.merge(*map(_read, files), key=place):
        yield make(*values)
