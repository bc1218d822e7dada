"""``mapInArrow`` with this package sent to the executors' Python workers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

_shipped: set = set()


#: What this process keeps between tasks, by name, and the names that the running task has asked for.
_kept: dict = {}
_asked: set = set()


def kept(name, make):
    """``make()``, kept for the process's next tasks as long as each of them asks for it."""
    _asked.add(name)
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def _begin() -> None:
    _asked.clear()


def _end() -> None:
    """Drop what the task that ends had no use for, and hand freed memory back to the system."""
    for name in set(_kept) - _asked:
        del _kept[name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def _released(work):
    """``work``, so that a worker process doesn't hold an earlier stage's memory when later stages use it."""

    def run(batches):
        _begin()
        try:
            yield from work(batches)
        finally:
            _end()

    return run


def map_arrow(df: DataFrame, work, schema: str) -> DataFrame:
    """``mapInArrow``; the package is packed on the driver and sent once per application."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="loomgraph-")) / "loomgraph.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return df.mapInArrow(_released(work), schema)
