"""The registered queries over whole tables against plain Python."""

import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import brute


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def rows_of(spark, sf_dir, name, documents):
    rows = {r.doc_id: r for r in __spark_entry__.queries()[name](spark, sf_dir).collect()}
    assert rows.keys() == documents.keys()
    return rows


@pytest.mark.parametrize("name, label, divisor, held, least", [("op1_quality_pu", "quality", 4, 2, 0.9), ("op6_string_kernel", "toxic", 5, 0, 0.85)])
def test_scores_agree_with_held_out_labels(spark, sf_dir, documents, name, label, divisor, held, least):
    rows = rows_of(spark, sf_dir, name, documents)
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % divisor == held)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= (0.7 if label == "quality" else 0.5))
    labels = [r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert sum(rows[r.doc_id].predicted == r[label] for r in labels) >= least * len(labels)


def test_shards(spark, sf_dir, documents):
    rows = rows_of(spark, sf_dir, "op2_jump_shards", documents)
    slots = {}
    for name, r in rows.items():
        data = (documents[name].text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 8)
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_secrets(spark, sf_dir, documents):
    for name, r in rows_of(spark, sf_dir, "op3_secret_ledger", documents).items():
        want = brute.secrets(documents[name].text)
        assert r.spans == brute.joined(want) and r.base_sha256 == brute.sha(r.spans)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[3] == k for s in want) for k in ("assign", "access", "hex")]


def test_personal_data(spark, sf_dir, documents):
    for name, r in rows_of(spark, sf_dir, "op9_validated_pii", documents).items():
        want = brute.personal(documents[name].text)
        assert r.base_sha256 == brute.sha(brute.joined(want))
        assert set(filter(None, brute.joined(want).split(","))) <= set(r.spans.split(","))
        kinds = ("email", "ip", "card", "phone")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == k for s in want) for k in kinds]


def test_line_rules(spark, sf_dir, documents):
    for name, r in rows_of(spark, sf_dir, "op4_line_rules", documents).items():
        want = brute.text_rules(documents[name].text)
        assert {k: r[k] for k in want} == want
        assert not (r.kept and r.base_failed)


def test_tokens(spark, sf_dir, documents):
    rows = rows_of(spark, sf_dir, "op5_simple8b_tokens", documents)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    for name in sorted(documents):
        ids = [*tokenizer.encode(documents[name].text or "", add_special_tokens=False).ids, 0]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        assert (rows[name].start, rows[name].n_tokens, rows[name].ids_crc32) == (start, len(ids), crc)
        start += len(ids)


def test_mix(spark, sf_dir, documents):
    rows = rows_of(spark, sf_dir, "op7_systematic_mix", documents)
    sizes, taken = {}, {}
    for name, r in rows.items():
        source = documents[name].source
        assert r.size == len(brute.WORD.findall(documents[name].text or "")) and r.taken <= 2 * r.size
        sizes[source] = sizes.get(source, 0) + r.size
        taken[source] = taken.get(source, 0) + r.taken
    want = brute.targets(sizes)
    largest = max(r.size for r in rows.values())
    for name, r in rows.items():
        source = documents[name].source
        assert r.source_size == sizes[source] and abs(r.target - want[source]) < 1e-6
        assert abs(taken[source] - r.target) <= largest
    again = rows_of(spark, sf_dir, "op7_systematic_mix", documents)
    assert again == rows


def test_benchmark_overlaps(spark, sf_dir, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    names = sorted(documents)
    rows = rows_of(spark, sf_dir, "op8_suffix_automaton", documents)
    for name, (n_words, n_hit, ids, _) in zip(names, brute.overlaps([documents[n].text for n in names], items)):
        r = rows[name]
        assert (r.n_words, r.n_hit, r.n_items) == (n_words, n_hit, len(ids))
        assert r.items_sha256 == brute.sha(",".join(ids))
        assert r.contaminated == (n_hit > 0 and 20 * n_hit >= n_words)


def test_simhash(spark, sf_dir, documents):
    rows = rows_of(spark, sf_dir, "op10_simhash_bytes", documents)
    names = sorted(documents)
    prints = [(n, brute.fingerprint(documents[n].text)) for n in names]
    assert [rows[n].fingerprint for n in names] == [f"{f:016x}" for _, f in prints]
    assert [rows[n].component_id for n in names] == brute.component_ids(prints)
