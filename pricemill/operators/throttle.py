"""Fetching under a rate per host: hosts are dealt to tasks, attempts are bounded, waits grow."""

import heapq
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricemill.schema import FETCH_SCHEMA, FETCH_TASKS

_WINDOW = 4096
THROTTLED_SCHEMA = T.StructType(
    [
        *FETCH_SCHEMA.fields,
        T.StructField("host", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("waited", T.DoubleType()),
    ]
)


class Refused(Exception):
    """What a fetcher raises if the host asks to come back later; ``after`` seconds if it says so."""

    def __init__(self, message: str = "refused", after: float | None = None):
        super().__init__(message)
        self.after = after


@dataclass
class Clock:
    """Time and sleep of a task; tests put their own in its place."""

    now: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep


@dataclass
class Throttle:
    """``rate`` links a second from one host over all tasks, ``attempts`` tries per link, the first wait after a
    refusal ``first_wait`` seconds, each further one ``growth`` times as long, ``longest_wait`` at most."""

    rate: float = 5.0
    attempts: int = 4
    first_wait: float = 1.0
    growth: float = 2.0
    longest_wait: float = 60.0
    clock: Clock = field(default_factory=Clock)

    def __post_init__(self):
        if self.rate <= 0 or self.attempts < 1 or self.first_wait < 0 or self.growth < 1:
            raise ValueError(f"a rate above 0, an attempt and waits that do not shrink are needed: {self}")

    def wait_after(self, attempt: int, asked: float | None) -> float:
        wait = min(self.longest_wait, self.first_wait * self.growth ** (attempt - 1))
        return wait if asked is None else max(wait, asked)


def link_host(url: str | Column) -> Column:
    """Host and port of a link in lower case, without a user; empty text if it has none."""
    url = F.col(url) if isinstance(url, str) else url
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    return F.lower(F.coalesce(host, F.lit("")))


def dealt_by_host(pending: DataFrame, n_tasks: int) -> DataFrame:
    """Add ``host``, ``lane`` and ``lanes``: a host's files go to as many lanes as its share of the files asks for.

    A host with k of n files gets ceil(k * n_tasks / n) lanes, so a hot host is split over tasks and a small one
    stays in one; each lane of a host may use one part in ``lanes`` of its rate. Host counts are one row per host
    and task before their shuffle, and meet the files in a plain join, split at run time where a host is hot.
    """
    files = pending.withColumn("host", link_host("url"))
    sizes = files.groupBy("host").agg(F.count("*").alias("_k"))
    total = sizes.agg(F.sum("_k").alias("n")).scalar()
    lanes = sizes.select("host", F.ceil(F.col("_k") * n_tasks / total).cast("int").alias("lanes"))
    lane = F.pmod(F.xxhash64("url"), F.col("lanes").cast("long")).cast("int")
    return files.join(lanes, "host").withColumn("lane", lane)


def _fetched(rows: Iterator[tuple], fetcher, store, throttle: Throttle):
    """Outcomes of one task's files, which come in any order of hosts.

    The lane that may go first is served first, so a slow or refusing host does not hold up the others; up to
    ``_WINDOW`` files wait at a time.
    """
    clock = throttle.clock
    waiting: dict[tuple, deque] = {}
    turns: list[tuple[float, tuple]] = []
    free: dict[tuple, float] = {}
    held, more, rows = 0, True, iter(rows)
    while more or held:
        while more and held < _WINDOW:
            row = next(rows, None)
            if row is None:
                more = False
                break
            lane = row[3:5]
            if lane not in waiting:
                waiting[lane] = deque()
                heapq.heappush(turns, (free.get(lane, 0.0), lane))
            waiting[lane].append((row, 1, clock.now()))
            held += 1
        if not held:
            break
        turn, lane = heapq.heappop(turns)
        now = clock.now()
        if turn > now:
            clock.sleep(turn - now)
        row, attempt, since = waiting[lane].popleft()
        name, url, path, host, _, lanes = row
        began = clock.now()
        held -= 1
        try:
            size = store.size(path)
            if size is None:
                # A host gives one link per 1 / rate seconds over all its lanes.
                free[lane] = began + lanes / throttle.rate
                content = fetcher(url)
                store.save(path, content)
                size = len(content)
            yield name, url, path, "ok", size, None, host, attempt, began - since
        except Exception as error:
            # By name: the class reaches a worker by value.
            if type(error).__name__ == "Refused" and attempt < throttle.attempts:
                wait = throttle.wait_after(attempt, getattr(error, "after", None))
                free[lane] = max(free.get(lane, 0.0), clock.now() + wait)
                waiting[lane].append((row, attempt + 1, since))
                held += 1
            else:
                yield name, url, path, "error", None, f"{type(error).__name__}: {error}", host, attempt, began - since
        if waiting[lane]:
            heapq.heappush(turns, (free.get(lane, 0.0), lane))
        else:
            del waiting[lane]


def fetch_throttled(
    pending: DataFrame, fetcher: Callable[[str], bytes], store, throttle: Throttle | None = None, n_tasks: int = FETCH_TASKS
) -> DataFrame:
    """Fetch every pending link under a rate per host; ``filename, url, path, status, n_bytes, error, host, attempts, waited``.

    ``fetcher(url)`` returns bytes, raises ``Refused`` to be asked again, or anything else for a link that is
    lost at once. A refused link is tried ``attempts`` times, with growing waits during which its host's lane
    rests; then it is a row with status 'error' like any other. A file that is there already costs neither an
    attempt of the fetcher nor the rate. The work is dealt by host (``dealt_by_host``): a host's lanes go to
    tasks of their own and share its rate, and a task works on other hosts while one rests. Rates hold if a
    lane runs once; a task that Spark repeats starts its lanes' clocks anew. The result is lazy: write it once.
    """
    throttle = throttle or Throttle()
    schema = THROTTLED_SCHEMA

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["filename", "url", "path", "host", "lane", "lanes"]
        rows = (row for batch in batches for row in batch[columns].itertuples(index=False, name=None))
        done = []
        for outcome in _fetched(rows, fetcher, store, throttle):
            done.append(outcome)
            if len(done) == 256:
                yield _frame(done)
                done = []
        if done:
            yield _frame(done)

    def _frame(done):
        frame = pd.DataFrame(done, columns=schema.names)
        return frame.astype({"n_bytes": "Int64", "attempts": "int32"})

    work = dealt_by_host(pending.select("filename", "url", "path"), n_tasks)
    return work.repartition(n_tasks, "host", "lane").mapInPandas(run, schema)
