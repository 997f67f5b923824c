"""Raster colour analytics on Spark DataFrames, and, in llm, operators for training data."""

from __future__ import annotations

import os

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark) -> None:
    """Lets this session's Python workers import the package from where the driver has it, and give memory back.

    Large arrays go back to the system when they are freed, and not much else is held, so that a worker that is used
    again needs little beside what it works on. Lower bounds cost more page faults than they save memory.
    A cluster whose executors have no such folder gets the package as usual, by --py-files or an environment archive.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, *paths) if x)
    for name, value in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_MMAP_THRESHOLD_", str(16 << 20)), ("MALLOC_TRIM_THRESHOLD_", str(64 << 20)), ("MALLOC_ARENA_MAX", "2")):
        env.setdefault(name, value)
