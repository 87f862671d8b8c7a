"""URL rules as globs that one bit-parallel automaton simulates all at once."""

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Long addresses are walked alone, as one whole number per step, once so few are left.
_FEW = 24


@dataclass(frozen=True)
class Rule:
    """A verdict for every address that one of ``globs`` matches whole.

    In a glob ``*`` is any run of signs within host or path segment (no ``/`` and ``?``), ``**`` any run at
    all, ``?`` one sign, ``[a-z]`` a class and ``[!a-z]`` its complement; a class may hold any special sign.
    Of several rules that fit the one with the highest ``rank`` wins, of equal ranks the earlier.
    """

    name: str
    verdict: str
    globs: tuple[str, ...]
    rank: tuple[int, int]
    listed: bool = False


def quoted(text: str) -> str:
    """A glob that matches exactly this text."""
    return re.sub(r"[\[*?]", r"[\g<0>]", text)


def host_rule(name: str, verdict: str) -> Rule:
    """The rule ``host/path``: the host and all its subdomains, and paths that start with the path."""
    host, path = name.split("/", 1)
    tail = quoted(host) + "/" + quoted(path) + "**"
    return Rule(name, verdict, (tail, "*." + tail), (1, len(name)), listed=True)


def glob_rule(glob: str, verdict: str) -> Rule:
    """A rule of the second line: used where no ``host_rule`` fits; the one with more fixed signs wins."""
    return Rule(glob, verdict, (glob,), (0, sum(sign not in "*?" for sign in glob)))


HOST_RULES = (
    host_rule("org/", "allow"),
    host_rule("example.org/es/", "block"),
    host_rule("example.org/en/1", "block"),
    host_rule("com/fr/", "allow"),
    host_rule("com/de/", "block"),
)
# Gambling, pharmacy and adult hosts, address shorteners' trackers, downloads and session pages.
BLOCKED_GLOBS = (
    "*casino*", "*casino*/**", "*poker*", "*poker*/**", "*jackpot*", "*jackpot*/**", "*[-.]bets[-.]*/**", "*[-.]bets[-.]*",
    "bets[-.]*/**", "*[-.]pills[-.]*/**", "*[-.]pills[-.]*", "pills[-.]*/**", "*viagra*/**", "*pharma-online*/**", "*porn*",
    "*porn*/**", "*xxx[-.]*/**", "ads.*/**", "adserver[0-9].*/**", "tracker.*/**", "**.exe", "**.zip", "**.iso", "**.apk",
    "*/**[?]*sessionid=**", "*/login", "*/login/**", "*/cart/**", "*/wp-admin/**",
)
# Where a blocked sign stands in good company.
ALLOWED_GLOBS = ("*.casino-history.org/**", "*.pokerstrategy-papers.edu/**")
RULES = (
    *HOST_RULES,
    *(glob_rule(g, "allow") for g in ALLOWED_GLOBS),
    *(glob_rule(g, "block") for g in BLOCKED_GLOBS),
)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, canonical): the host after the first ``://``, A-Z lower-cased, the path up to ``?`` or
    ``#``, and host, path and query together. Null and addresses without ``://`` give three empty texts."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "#", 1)
    host = F.regexp_extract(rest, r"\A[^/?]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.substring_index(after, "?", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = (lower, path, F.concat(lower, after))
    return tuple(F.when(known, part).otherwise(F.lit("")) for part in parts)


def _signs(glob: str) -> list[tuple[str, object]]:
    """The glob as steps: ('one', (complement, set of ranges)), ('run', whether / and ? are in it)."""
    steps, at = [], 0
    while at < len(glob):
        sign = glob[at]
        if glob.startswith("**", at):
            steps.append(("run", True))
            at += 2
            continue
        if sign == "*":
            steps.append(("run", False))
        elif sign == "?":
            steps.append(("one", (True, ())))
        elif sign == "[":
            end = glob.index("]", at + 1 if glob[at + 1 : at + 2] != "!" else at + 2)
            body, no = glob[at + 1 : end], glob[at + 1] == "!" and end > at + 2
            body = body[1:] if no else body
            ranges, k = [], 0
            while k < len(body):
                if body[k + 1 : k + 2] == "-" and k + 2 < len(body):
                    ranges.append((ord(body[k]), ord(body[k + 2])))
                    k += 3
                else:
                    ranges.append((ord(body[k]), ord(body[k])))
                    k += 1
            steps.append(("one", (no, tuple(ranges))))
            at = end
        else:
            steps.append(("one", (False, ((ord(sign), ord(sign)),))))
        at += 1
    return steps


class GlobAutomaton:
    """All globs in one row of bits, ``words`` words of 64.

    A glob of m signs takes m + 1 bits: bit j says that its first j signs have been read. A sign moves every
    bit one place up where the mask of the sign allows it (shift and and), and a bit followed by a star also
    stays where it is. Masks are kept per class of signs: signs that no glob tells apart share a class.
    """

    def __init__(self, globs: Sequence[str]):
        parsed = [_signs(g) for g in globs]
        edges = {0, ord("/"), ord("/") + 1, ord("?"), ord("?") + 1}
        for steps in parsed:
            for kind, what in steps:
                if kind == "one":
                    edges.update(x for low, high in what[1] for x in (low, high + 1))
        self.edges = np.array(sorted(edges), np.uint32)
        n = len(self.edges)
        self.first, self.move, self.stay, self.ends = 0, [0] * n, [0] * n, []
        bit = 0
        for steps in parsed:
            self.first |= 1 << bit
            for kind, what in steps:
                if kind == "one":
                    bit += 1
                    no, ranges = what
                    for c, edge in enumerate(self.edges.tolist()):
                        if any(low <= edge <= high for low, high in ranges) != no:
                            self.move[c] |= 1 << bit
                else:
                    for c, edge in enumerate(self.edges.tolist()):
                        if what or edge not in (ord("/"), ord("?")):
                            self.stay[c] |= 1 << bit
            self.ends.append(bit)
            bit += 1
        self.words = bit // 64 + 1
        self.tables = [np.array([self._packed(m) for m in masks]) for masks in (self.move, self.stay)]

    def _packed(self, bits: int) -> np.ndarray:
        return np.frombuffer(bits.to_bytes(8 * self.words, "little"), "<u8").copy()

    def _alone(self, classes: list[int], bits: int) -> int:
        move, stay = self.move, self.stay
        for c in classes:
            bits = ((bits << 1) & move[c]) | (bits & stay[c])
            if not bits:
                break
        return bits

    def states(self, texts: Sequence[str]) -> np.ndarray:
        """The bits after each whole text, one row of words each: all texts step together, longest first."""
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        lengths = np.fromiter(map(len, codes), np.int64, len(codes))
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate([codes[i] for i in order]) if len(codes) else np.zeros(0, np.uint32)
        flat = np.searchsorted(self.edges, flat, side="right") - 1
        sizes = lengths[order]
        starts = np.cumsum(sizes) - sizes
        move, stay = self.tables
        state = np.tile(self._packed(self.first), (len(texts), 1))
        active, step = int(np.count_nonzero(sizes)), 0
        while active > _FEW:
            now = state[:active]
            classes = flat[starts[:active] + step]
            up = now << np.uint64(1)
            up[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:active] = (up & move[classes]) | (now & stay[classes])
            step += 1
            active = int(np.searchsorted(-sizes, -step))
        for i in range(active):
            bits = int.from_bytes(state[i].astype("<u8").tobytes(), "little")
            end = starts[i] + sizes[i]
            state[i] = self._packed(self._alone(flat[starts[i] + step : end].tolist(), bits))
        out = np.empty_like(state)
        out[order] = state
        return out

    def matches(self, texts: Sequence[str]) -> np.ndarray:
        """Whether each text (row) is matched whole by each glob (column)."""
        state = self.states(texts)
        ends = np.array(self.ends)
        return (state[:, ends // 64] >> (ends % 64).astype(np.uint64) & np.uint64(1)).astype(bool)


def best_rule(rules: Sequence[Rule]):
    """Column function: the place in ``rules`` of the rule that decides a canonical address, -1 without one."""
    ordered = sorted(range(len(rules)), key=lambda i: (tuple(-x for x in rules[i].rank), i))
    owner = np.array([i for i in ordered for _ in rules[i].globs])
    automaton = GlobAutomaton([g for i in ordered for g in rules[i].globs])

    @F.pandas_udf("int")
    def decide(texts: pd.Series) -> pd.Series:
        out = np.full(len(texts), -1, np.int32)
        # Every address once: a batch of pages often holds one address many times.
        different, where = np.unique(texts.to_numpy(dtype=object), return_inverse=True)
        if len(different):
            found = automaton.matches(different.tolist())
            winner = np.where(found.any(axis=1), owner[found.argmax(axis=1)], -1)
            out = winner[where].astype(np.int32)
        return pd.Series(out)

    return decide


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow", url_col: str = "url") -> DataFrame:
    """(row, host, path, rule, matched, verdict) per row of ``pages``.

    ``rule`` is the ``host_rule`` that decided, else null; ``matched`` is any rule that decided. An address that
    no rule fits, a null and one without ``://`` (host and path empty) get ``default``. Repeated rows stay, other
    columns travel in ``row``. One scan, no shuffle; the automaton travels with the task. Very long addresses
    cost their length once.
    """
    host, path, canonical = url_parts(F.col(url_col))
    parts = pages.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"), canonical.alias("_whole"))
    place = best_rule(rules)(F.col("_whole"))

    def named(values):
        return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), F.col("_place") + 2)

    return parts.withColumn("_place", place).select(
        "row",
        "host",
        "path",
        named([None, *(r.name if r.listed else None for r in rules)]).alias("rule"),
        named([None, *(r.name for r in rules)]).alias("matched"),
        named([default, *(r.verdict for r in rules)]).alias("verdict"),
    )
