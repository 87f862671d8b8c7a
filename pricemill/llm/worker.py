"""State that a Python worker keeps between tasks."""

import sys
import types

_HOLDER = "_pricemill_worker_state"


def worker_state(name: str, make):
    """The value that ``make()`` gave in this worker process the first time; the package travels by value,
    so its own globals start afresh with every task. A worker keeps one such value, the last one asked for."""
    holder = sys.modules.setdefault(_HOLDER, types.ModuleType(_HOLDER)).__dict__
    if holder.get("name") != name:
        holder["name"] = holder["value"] = None
        holder["value"], holder["name"] = make(), name
    return holder["value"]


def release_worker_state() -> None:
    """Free what an earlier operator left in this worker."""
    sys.modules.pop(_HOLDER, None)
