"""The operators as queries over a folder of Parquet tables, with the same in SQL where SQL can say it."""

import re

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemill.llm import (
    alignment,
    decontamination,
    line_rules,
    mixing,
    pii,
    quality,
    secrets,
    sharding,
    simhash,
    tokens,
    toxicity,
    turn_trie,
    url_rules,
)
from pricemill.sources.staging import new_path

SHARDS = 8
TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(column, divisor: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def op1_quality_pu(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    training = _table(spark, sf_dir, "labels").filter(_remainder("doc_id", 4) != 2)
    score = quality.scored(docs, quality.train(docs, training))
    rows = docs.select("doc_id", (_remainder("doc_id", 4) == 2).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op2_jump_shards(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs, SHARDS).withColumn("law", F.lit("key"))


def _count(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def _joined(spans):
    text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def op3_secret_ledger(spark, sf_dir):
    versions = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scanned(spark, versions, new_path(spark, "secret-ledger"))
    counts = [_count(rule.kind).alias(f"n_{rule.kind}") for rule in secrets.RULES]
    spans = _joined(F.col("spans"))
    # Every rule is one of the base kinds.
    return found.select("path.doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op4_line_rules(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_rules.judged(docs).select("row.doc_id", "stats.*", "base_failed", "kept")


def op5_simple8b_tokens(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_path(spark, "token-files")
    tokens.write_token_files(docs, path, public_tokenizers.path(TOKENIZER))
    return tokens.read_token_digests(spark, path)


def op6_string_kernel(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    training = _table(spark, sf_dir, "labels").filter(_remainder("doc_id", 5) != 0)
    score = toxicity.scored(docs, toxicity.train(docs, training))
    rows = docs.select("doc_id", (_remainder("doc_id", 5) == 0).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_systematic_mix(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixing.mixed(docs).select("doc_id", "size", "source_size", "target", taken)


def op8_suffix_automaton(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_overlaps(docs, _table(spark, sf_dir, "benchmark"))
    rows = found.select(
        "row.doc_id",
        "n_words",
        decontamination.hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        decontamination.item_digest().alias("items_sha256"),
    )
    return rows.withColumn("contaminated", decontamination.contaminated(F.col("n_hit"), F.col("n_words")))


def op9_validated_pii(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kinds = F.array(*[F.lit(kind) for kind in pii.KINDS])
    parts = F.arrays_zip("found.starts", "found.ranks", "found.ends")
    spans = F.transform(
        parts,
        lambda s: F.struct(
            F.element_at(kinds, s["ranks"] + 1).alias("kind"), s["starts"].alias("start"), s["ends"].alias("end")
        ),
    )
    scores = F.array_join(F.transform("found.scores", lambda s: F.format_string("%.2f", s)), ",")
    found = docs.select("doc_id", pii.personal_data(F.col("text")).alias("found"))
    rows = found.select("doc_id", spans.alias("spans"), scores.alias("scores"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return rows.select(
        "doc_id",
        *[_count(kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        "scores",
    )


def op10_simhash_bytes(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    linked = simhash.near_duplicates(docs)
    return linked.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_glob_automaton(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judged(pages).select("row.page_id", "host", "path", "rule", "verdict")


def op12_token_alignment(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.alignment(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))


def op13_turn_trie(spark, sf_dir):
    return turn_trie.prefix_nodes(_table(spark, sf_dir, "conversations"))


def _pipeline(spark, sf_dir):
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {
    "op1_quality_pu": op1_quality_pu,
    "op2_jump_shards": op2_jump_shards,
    "op3_secret_ledger": op3_secret_ledger,
    "op4_line_rules": op4_line_rules,
    "op5_simple8b_tokens": op5_simple8b_tokens,
    "op6_string_kernel": op6_string_kernel,
    "op7_systematic_mix": op7_systematic_mix,
    "op8_suffix_automaton": op8_suffix_automaton,
    "op9_validated_pii": op9_validated_pii,
    "op10_simhash_bytes": op10_simhash_bytes,
    "op11_glob_automaton": op11_glob_automaton,
    "op12_token_alignment": op12_token_alignment,
    "op13_turn_trie": op13_turn_trie,
    "pipeline": _pipeline,
}

# --- the same in SQL -------------------------------------------------------------------------------

_WORD = r"[^\x20\x09-\x0D]+"


def _sql_spans(kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: the pieces between matches and the matches give the places."""
    pattern = pattern.replace("'", "''")
    return f"""
select doc_id, '{kind}' as kind, {[r.kind for r in secrets.RULES].index(kind)} as rank,
       begins as start, begins + length(whole[i]) as "end"
from (select *, cast(list_sum([length(x) for x in pieces[:i]]) + coalesce(list_sum([length(x) for x in whole[:i - 1]]), 0) as bigint) as begins
      from (select doc_id, string_split_regex(text, '{pattern}') as pieces,
                   regexp_extract_all(text, '{pattern}', 0) as whole,
                   regexp_extract_all(text, '{pattern}', {group}) as inner_part,
                   unnest(range(1, len(regexp_extract_all(text, '{pattern}', 0)) + 1)) as i from texts))
where length(inner_part[i]) >= {least}
"""


_OP3 = f"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
spans as ({" union all ".join(_sql_spans(r.kind, r.pattern, r.group, r.least) for r in secrets.RULES)}),
joined as (select doc_id, string_agg(concat(kind, ':', start, ':', "end"), ',' order by start, rank) as spans,
                  {", ".join(f"count(*) filter (where kind = '{r.kind}') as n_{r.kind}" for r in secrets.RULES)}
           from spans group by doc_id)
select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in secrets.RULES)},
       sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from documents left join joined using (doc_id)
"""

_OP4 = rf"""
with texts as (select doc_id, source, coalesce(text, '') as text from documents),
words as (select doc_id, regexp_extract_all(text, '{_WORD}') as ws from texts),
windows as (select doc_id, i, array_to_string(ws[i:i + 2], ' ') as w
            from (select *, unnest(range(1, len(ws) - 1)) as i from words)),
repeated as (select doc_id, count(distinct place) as n_repeat_words
             from (select doc_id, unnest([i, i + 1, i + 2]) as place
                   from (select *, count(*) over (partition by doc_id, w) as n from windows) where n > 1)
             group by doc_id),
lines as (select doc_id, source, text, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as normal,
                 len(regexp_extract_all(line, '{_WORD}')) as n
          from (select doc_id, source, text, unnest(string_split(text, chr(10))) as line from texts)
          where regexp_matches(line, '{_WORD}')),
hosts as (select source, count(distinct text) as documents from texts group by source),
counted as (select source, normal, count(distinct text) as n from lines group by source, normal),
frequent as (select counted.source, normal from counted join hosts on counted.source is not distinct from hosts.source
             where n > {line_rules.MIN_LINE_DOCUMENTS} and 100 * n > {line_rules.MAX_LINE_PERCENT} * documents),
cut as (select doc_id, cast(sum(n) as bigint) as removed
        from lines join frequent on lines.source is not distinct from frequent.source and lines.normal = frequent.normal
        group by doc_id),
of_lines as (select doc_id, count(*) - count(distinct line) as n_dup_lines from lines group by doc_id),
stats as (select doc_id, cast(len(ws) as bigint) as n_words,
                 cast(coalesce(list_sum([length(w) for w in ws]), 0) as bigint) as word_chars,
                 cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
                 coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
                 coalesce(removed, 0) as removed
          from texts join words using (doc_id) left join of_lines using (doc_id)
               left join repeated using (doc_id) left join cut using (doc_id)),
failed as (select *, n_words < {line_rules.MIN_WORDS}
                  or 100 * n_repeat_words > {line_rules.MAX_REPEAT_PERCENT} * n_words as base_failed from stats)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not 100 * removed > {line_rules.MAX_REMOVED_PERCENT} * n_words as kept
from failed
"""

_OP7 = rf"""
with docs as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as bigint) as size
              from documents),
sources as (select source, cast(sum(size) as bigint) as source_size,
                   [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight
            from docs group by source),
steps as (select *, 2.0::double * source_size as cap,
                 row_number() over (order by 2.0::double * source_size / weight, weight) as k from sources),
levels as (select k, (1.5::double * (select sum(source_size) from sources)
                      - coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0))
                     / sum(weight) over (order by k rows between current row and unbounded following) as level, cap, weight
           from steps),
level as (select coalesce(min_by(level, k) filter (where weight * level <= cap), max(cap / weight)) as level from levels),
aims as (select source, source_size, least(weight * level, 2.0::double * source_size) as target from sources, level),
slots as (select doc_id, size, source_size, target, docs.source,
                 row_number() over (partition by docs.source order by size, md5(concat('{mixing.SEED}:', doc_id))) - 1 as slot,
                 case when source_size > 0 then target / source_size else 0 end as expected,
                 cast(concat('0x', substr(md5(concat('{mixing.SEED}:', coalesce('s' || docs.source, 'null'))), 1, 8)) as bigint)
                   / 4294967296.0 as start
          from docs join aims on docs.source is not distinct from aims.source)
select doc_id, size, source_size, target,
       cast(size * (floor((slot + 1) * expected + start) - floor(slot * expected + start)) as bigint) as taken
from slots
"""

_BENCH_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_OP8 = f"""
with docs as (select doc_id, {_BENCH_WORDS} as ws from documents),
items as (select cast(item_id as varchar) as item, ws, least({decontamination.WINDOW}, len(ws)) as span
          from (select item_id, {_BENCH_WORDS} as ws from benchmark) where len(ws) > 0),
windows as (select distinct item, span, array_to_string(ws[i:i + span - 1], ' ') as w
            from (select *, unnest(range(1, len(ws) - span + 2)) as i from items)),
places as (select doc_id, span, i, array_to_string(ws[i:i + span - 1], ' ') as w
           from (select doc_id, ws, span, unnest(range(1, len(ws) - span + 2)) as i
                 from docs, (select distinct span from items) where len(ws) >= span)),
found as (select doc_id, i, places.span, item from places join windows on places.span = windows.span and places.w = windows.w),
hits as (select doc_id, count(distinct place) as n_hit
         from (select doc_id, unnest(range(i, i + span)) as place from (select distinct doc_id, i, span from found))
         group by doc_id),
named as (select doc_id, count(item) as n_items, string_agg(item, ',' order by item) as names
          from (select distinct doc_id, item from found) group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(ws) as contaminated
from docs left join hits using (doc_id) left join named using (doc_id)
"""

def _sql_glob(glob: str) -> str:
    """The glob as a regular expression for a whole text."""
    runs = {"**": "(?s:.*)", "*": "[^/?]*", "?": "(?s:.)"}
    parts = re.findall(r"\*\*|\*|\?|\[!?.[^]]*\]|.", glob)
    return "".join(runs.get(p) or (p.replace("[!", "[^") if len(p) > 1 else re.escape(p)) for p in parts).replace("'", "''")


_LISTED = [
    ("org/", "org", "/", "allow"),
    ("example.org/es/", "example.org", "/es/", "block"),
    ("example.org/en/1", "example.org", "/en/1", "block"),
    ("com/fr/", "com", "/fr/", "allow"),
    ("com/de/", "com", "/de/", "block"),
]
_SECOND = sorted((r for r in url_rules.RULES if not r.listed), key=lambda r: -r.rank[1])
_OP11 = f"""
with rests as (select page_id, case when strpos(url, '://') > 0 then split_part(substr(url, strpos(url, '://') + 3), '#', 1) else '' end as rest
               from pages),
parts as (select page_id, rest, regexp_extract(rest, '^[^/?]*') as h from rests),
named as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                 split_part(substr(rest, length(h) + 1), '?', 1) as path, substr(rest, length(h) + 1) as after from parts),
listed(name, rule_host, start, verdict) as (values {", ".join(map(repr, _LISTED))}),
fits as (select page_id, max_by(name, length(name)) as rule, max_by(verdict, length(name)) as verdict
         from named join listed on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, start)
         group by page_id)
select page_id, host, path, rule, coalesce(verdict, case
{chr(10).join(f"when regexp_full_match(concat(host, after), '{_sql_glob(r.globs[0])}') then '{r.verdict}'" for r in _SECOND)}
else 'allow' end) as verdict
from named left join fits using (page_id)
"""

_CRC_TABLE = """list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))"""
_OP13 = f"""
with ids as (select distinct conv_id as c from conversations where conv_id is not null),
crc as (select {_CRC_TABLE} as t),
heads as (select c, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(c as varchar), ''), lambda s: ascii(s)::bigint)),
                 lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 4 as h from ids, crc),
given as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null),
own as (select *, row_number() over (partition by c order by turn nulls first, role, sha256(concat(length(role), ':', role, text))) as d from given),
built as (select heads.c, d, role, text from heads join own on own.c = heads.c - heads.c % 20 where d <= h
          union all
          select c, least(h, n) + d - h, role, text
          from (select heads.c, d, role, text, h, (select count(*) from own o where o.c = heads.c - heads.c % 20) as n
                from heads join own on own.c = heads.c where d > h)),
hashed as (select c, d, concat(length(role), ':', role, text) as whole,
                  len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from built),
rows as (select c, d, words, sha256(string_agg(sha256(whole), ',') over (partition by c order by d)) as node from hashed
         union all select c, 0, 0, '' from ids),
ends as (select c, max(d) as last from rows group by c),
nodes as (select node, d, min(rows.c) as least, count(*) as n, any_value(words) as words,
                 coalesce(string_agg(cast(rows.c as varchar), ',' order by rows.c) filter (where last = d), '') as ended,
                 bool_and(last = d) as childless
          from rows join ends on ends.c = rows.c group by node, d),
paths as (select rows.c, rows.d, rows.node, above.node as parent from rows left join rows above on above.c = rows.c and above.d = rows.d - 1),
parents as (select distinct node, parent from paths),
sums as (select rows.node, sum(leaf) as n_leaves, sum(saved) as saved
         from (select rows.c, rows.d, rows.node,
                      sum(case when least = rows.c and childless then 1 else 0 end) over down as leaf,
                      sum(case when least = rows.c then (n - 1) * nodes.words else 0 end) over down as saved
               from rows join nodes on nodes.node = rows.node
               window down as (partition by rows.c order by rows.d desc)) rows
         group by rows.node)
select nodes.least as conv_id, cast(nodes.d as bigint) as depth, up.least as parent_conv_id, nodes.n as n_convs,
       (select count(*) from parents k where k.parent = nodes.node) as n_children,
       cast(n_leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, sha256(nodes.ended) as ends_sha256
from nodes join parents on parents.node = nodes.node left join nodes up on up.node = parents.parent join sums on sums.node = nodes.node
"""

# Learned scores, the shard hash, token ids, checksums with context and the fingerprint hash have no SQL
# form; tests/llm holds these queries against plain Python.
ORACLE_SQL = {
    "op3_secret_ledger": _OP3,
    "op4_line_rules": _OP4,
    "op7_systematic_mix": _OP7,
    "op8_suffix_automaton": _OP8,
    "op11_glob_automaton": _OP11,
    "op13_turn_trie": _OP13,
}
