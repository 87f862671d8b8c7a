"""Every stage of the pipeline over the whole tables against plain Python."""

import pytest

import brute
import corpus_pipeline
from pricemill.llm import line_rules
from pricemill.sources.staging import staged


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        tables.append(docs)
    return tables


def by_id(table):
    return {r.doc_id: r for r in table.collect()}


def test_columns_stay(stages):
    assert all(t.columns == stages[0].columns for t in stages)


def test_rules(stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    cut = brute.frequent_lines([(r.source, r.text) for r in before.values()], line_rules.MAX_LINE_PERCENT, line_rules.MIN_LINE_DOCUMENTS)
    assert cut  # some lines are boilerplate at this size
    touched = 0
    for name, r in before.items():
        if brute.text_rules(r.text)["base_failed"]:
            assert name not in after
            continue
        left = [line for line in r.text.split("\n") if (r.source, brute.normal_line(line)) not in cut]
        words = len(brute.WORD.findall(r.text))
        depleted = 100 * (words - len(brute.WORD.findall("\n".join(left)))) > line_rules.MAX_REMOVED_PERCENT * words
        assert (name in after) == (not depleted)
        if not depleted:
            assert after[name].text == "\n".join(left)
            touched += after[name].text != r.text
    assert touched


def test_near_duplicates(stages):
    before, after = by_id(stages[1]), by_id(stages[2])
    prints = [(n, brute.fingerprint(r.text)) for n, r in before.items()]
    assert after.keys() == set(brute.component_ids(prints))
    assert stages[2].count() == len(after)


def test_decontamination(spark, sf_dir, stages):
    before, after = by_id(stages[2]), by_id(stages[3])
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    names = sorted(before)
    found = dict(zip(names, brute.overlaps([before[n].text for n in names], items)))
    assert after.keys() == {n for n, (words, hit, _, _) in found.items() if not (hit and 20 * hit >= words)}
    for name, r in after.items():
        words, hit, _, _ = found[name]
        assert r.text == before[name].text if not hit else len(brute.benchmark_words(r.text)) == words - hit


def test_mix(stages):
    before = by_id(stages[3])
    taken, sizes, words = {}, {}, {n: len(brute.WORD.findall(r.text or "")) for n, r in before.items()}
    for r in stages[4].collect():
        assert r == before[r.doc_id]
        taken[r.source] = taken.get(r.source, 0) + words[r.doc_id]
    for n, r in before.items():
        sizes[r.source] = sizes.get(r.source, 0) + words[n]
    for source, target in brute.targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= max(words.values())
