"""op11: globs against regular expressions, and addresses against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pricemill.llm import url_rules

LISTED = ["org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/"]
VERDICTS = ["allow", "block", "block", "allow", "block"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def listed(url):
    host, path = parts(url)
    fits = []
    for rule, verdict in zip(LISTED, VERDICTS):
        name, start = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return max(fits, default=(0, None, None))[1:]


def expression(glob):
    out, at = "", 0
    while at < len(glob):
        if glob.startswith("**", at):
            out, at = out + "(?s:.*)", at + 2
        elif glob[at] == "[":
            end = glob.index("]", at + 2)
            body = glob[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out, at = out + "[" + ("^" + body[1:] if body[0] == "!" and len(body) > 1 else body) + "]", end + 1
        else:
            out += {"*": "[^/?]*", "?": "(?s:.)"}.get(glob[at]) or re.escape(glob[at])
            at += 1
    return re.compile(out)


URLS = [
    None, "", "no address", "://", "http://", "http://org", "http://org/", "http://ORG/X", "http://a.org/", "http://xorg/", "http://example.org/es/",
    "http://www.Example.org/en/12?x", "http://example.org/en/2", "http://example.org/es", "http://a.com/fr/1#x", "http://a.com/FR/1",
    "http://b.com/de/", "http://b.com?q=/de/", "http://b.com#/de/", "x://y://example.org/es/", "http://user:pw@h.org:80/p", "http://big-casino.net",
    "http://big-casino.net/x", "http://a.net/?q=casino/", "http://casino-history.org/x", "http://a.casino-history.org/x", "http://free-bets.example.net/en/1",
    "http://a.net/x.exe", "http://a.net/x.exe?y", "http://a.net/a/b?sessionid=1", "http://a.net/login", "http://a.net/login/x", "http://a.net/loginx",
    "http://ads.a.net/", "http://adserver7.a.net/", "http://é.net/日本?🙂#x", "http://a.net/a?b#c?d", "http://a.org/\nx", "HTTP://ÄA.ORG/",
]


def test_addresses(spark):
    urls = URLS + URLS[:3] + ["http://a.org/" + "x" * 100_000, "http://a.net/" + "y/" * 60_000 + "z.exe"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(3)
    pages = pages.withColumns({"host": F.lit("x"), "_whole": F.lit("y"), "_place": F.lit(3)})
    rows = url_rules.judged(pages).select("row.page_id", "host", "path", "rule", "matched", "verdict").collect()
    assert len(rows) == len(urls)
    second = [r for r in url_rules.RULES if not r.listed]
    for row in rows:
        url = urls[row.page_id]
        assert (row.host, row.path) == parts(url)
        rule, verdict = listed(url)
        assert row.rule == rule
        if rule is None:
            whole = row.host + (url or "").partition("://")[2].split("#")[0][len(row.host) :]
            fits = [r for r in second if expression(r.globs[0]).fullmatch(whole)]
            best = max(fits, key=lambda r: r.rank, default=None)
            verdict = best.verdict if best else "allow"
            assert row.matched is None if best is None else row.matched in [r.name for r in fits if r.rank == best.rank]
        assert row.verdict == verdict, url


@pytest.mark.parametrize("n_globs", [1, 5, 60])
def test_globs_match_regular_expressions(n_globs):
    draw = random.Random(n_globs)
    pieces = ["a", "b", "/", "?", "*", "**", "[ab]", "[!a]", "[a-c]", "[?]", "[*]", "[[]", "x", ".", "é", "aaaaaaaaaaaaaaaaaaaa"]
    globs = ["".join(draw.choices(pieces, k=draw.randrange(0, 12))) for _ in range(n_globs)]
    automaton = url_rules.GlobAutomaton(globs)
    assert n_globs < 60 or automaton.words > 4
    texts = ["".join(draw.choices("aabbcx/?.*[é🙂", k=draw.randrange(0, 9))) for _ in range(300)] + ["", "a" * 70, "a" * 20 + "b" + "a" * 40]
    texts += [re.sub(r"\[!?(.)[^]]*\]|\*+", r"\1", g) for g in globs]
    found = automaton.matches(texts)
    for j, glob in enumerate(globs):
        want = expression(glob)
        assert [bool(want.fullmatch(t)) for t in texts] == found[:, j].tolist(), glob


def test_no_pages(spark):
    assert url_rules.judged(spark.createDataFrame([], "page_id long, url string")).collect() == []
