"""Which tokens of two tokenizers cover the same bytes, in how many documents, with Arrow kernels in the tasks."""

import hashlib
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricemill.llm.worker import release_worker_state, worker_state
from pricemill.sources.staging import staged

# A block is what one task holds: its documents share one list of units and one list of id pairs.
BLOCK_CHARS = 3_000_000
# Units a worker remembers from block to block, about 400 bytes each: time against memory, never results.
KNOWN_UNITS = 60_000
_BATCH_CHARS = 400_000
_ROW_CODES = 1 << 18
_ROW_DOCS = 1 << 14
_BULK = 200
_SHIFT = 32
_LOW = (1 << _SHIFT) - 1
_ODD = re.compile(r"\s")
# A space between two signs that are no white space: both tokenizers always start a token there.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")

BLOCKS = (
    "block long, kind int, doc_ids array<long>, n_units array<int>, n_a array<long>, n_b array<long>, "
    "n_groups array<long>, n_links array<long>, digests array<string>, codes binary, "
    "pair_counts binary, pair_codes binary, pair_repeats binary, place int, a int, b int, n_docs long"
)
_DOCS, _UNITS, _PAIRS = 0, 1, 2
ROWS = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def byte_level_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves,
    the others, in order, for the signs from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def piece_bytes(piece: str) -> bytes:
    byte = _BYTE_PIECE.fullmatch(piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


class Tokenizers:
    """Ids of units (a text between two cuts, without its leading space) by both tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        signs, vocabulary = byte_level_signs(), self.a.get_vocab()
        spelled = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(sign in signs for sign in token)
            spelled[i] = bytes(signs[sign] for sign in token) if known else token.encode()
        self.bytes_a = pa.array(spelled, pa.binary())
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = pa.array([piece_bytes(p) for p in pieces], pa.binary())
        self.opens = np.array([token.startswith(b" ") for token in spelled])

    def _bulk(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number per unit) of units without white space, many at a time: a token that begins
        with a space begins a unit."""
        texts = [" " + " ".join(units[at : at + _BULK]) for at in range(0, len(units), _BULK)]
        ids = _flat([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)])
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(units):
            return self._alone(units)
        return ids, np.diff(np.append(starts, len(ids)))

    def _alone(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        return _flat(lists), np.fromiter(map(len, lists), np.int64, len(lists))

    def ids_a(self, units: list[str], n_simple: int) -> pa.ListArray:
        """The first ``n_simple`` units hold no white space and are not empty."""
        (ids, sizes), (more, more_sizes) = self._bulk(units[:n_simple]), self._alone(units[n_simple:])
        return _lists(np.concatenate((ids, more)), np.concatenate((sizes, more_sizes)))

    def ids_b(self, units: list[str]) -> pa.ListArray:
        lists = self.b.encode(units, num_threads=1)
        return _lists(_flat(lists), np.fromiter(map(len, lists), np.int64, len(lists)))


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64)


def _lists(ids: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))


def _ends(lists: pa.ListArray, spelled: pa.Array) -> pa.Table:
    """(unit, id, key) of every token; the key is the unit and the byte offset where the token ends in it."""
    ids, unit = pc.list_flatten(lists), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(pc.cast(pc.binary_length(pc.take(spelled, ids)), pa.int64()))
    # Segmented: the sum up to the first token of a unit is taken off again.
    before = np.concatenate(([0], total.to_numpy(zero_copy_only=False)))
    base = before[lists.offsets.to_numpy()[:-1]]
    end = pc.subtract(total, pc.take(pa.array(base), unit))
    key = pc.bit_wise_or(pc.shift_left(pc.cast(unit, pa.int64()), _SHIFT), end)
    return pa.table({"unit": pc.cast(unit, pa.int64()), "id": ids, "key": key})


def _spelled_right(lists: pa.ListArray, spelled: pa.Array, wanted: pa.Array) -> np.ndarray:
    pieces = pa.ListArray.from_arrays(lists.offsets, pc.take(spelled, pc.list_flatten(lists)))
    return pc.equal(pc.binary_join(pieces, b""), wanted).to_numpy(zero_copy_only=False)


def _joined(texts: pa.Array, owner: np.ndarray, n: int, sign: str) -> pa.Array:
    """One text for each of ``n`` owners (ascending in ``owner``): its texts joined."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), texts), sign)


def align(tokenizers: Tokenizers, units: list[str], n_simple: int = 0) -> dict:
    """Per unit: ``good`` (both tokenizers spell it), ``n_a``, ``n_b``, ``n_groups``, ``n_links``, its groups as
    ``text``, and its id pairs: ``pair_counts`` per unit, then ``pairs`` (a << 32 | b) and ``repeats``.

    Tokens of both sides become flat columns with the byte offset where they end. A hash join on unit and
    offset gives the offsets where both end, which cut the tokens into groups; a hash join of the different
    ids per group gives the linked pairs, so a long group costs its different ids, not its occurrences.
    """
    n = len(units)
    a, b = tokenizers.ids_a(units, n_simple), tokenizers.ids_b(units)
    wanted = pc.cast(pc.binary_join_element_wise("", pa.array(units, pa.string()), " "), pa.binary())
    good = _spelled_right(a, tokenizers.bytes_a, wanted) & _spelled_right(b, tokenizers.bytes_b, wanted)
    keep = pa.array(good)
    sides = []
    for lists, spelled in ((a, tokenizers.bytes_a), (b, tokenizers.bytes_b)):
        table = _ends(lists, spelled)
        sides.append(table.filter(pc.take(keep, table["unit"])))
    # Where both end: no offset occurs twice on a side, since no token is empty.
    both = sides[0].select(["key"]).join(sides[1].select(["key"]), "key", join_type="inner", use_threads=False)
    cuts = np.sort(both["key"].to_numpy())
    texts, tables = [], []
    for side, table in zip("ab", sides):
        group = np.searchsorted(cuts, table["key"].to_numpy())
        ids = table["id"]
        texts.append(_joined(pc.cast(ids, pa.string()).combine_chunks(), group, len(cuts), ","))
        each = pa.table({"group": group, side: ids}).group_by(["group", side], use_threads=False)
        tables.append(each.aggregate([([], "count_all")]).rename_columns(["group", side, f"n_{side}"]))
    owner = cuts >> _SHIFT
    text = _joined(pc.binary_join_element_wise(*texts, "|"), owner, n, ";")
    linked = tables[0].join(tables[1], "group", join_type="inner", use_threads=False)
    repeats = pc.multiply(linked["n_a"], linked["n_b"])
    unit = pc.take(pa.array(owner), linked["group"])
    pair = pc.bit_wise_or(pc.shift_left(linked["a"], _SHIFT), linked["b"])
    per_unit = pa.table({"unit": unit, "pair": pair, "repeats": repeats})
    per_unit = per_unit.group_by(["unit", "pair"], use_threads=False).aggregate([("repeats", "sum")])
    unit = per_unit["unit"].to_numpy()
    order = np.argsort(unit, kind="stable")
    counts = np.bincount(unit, minlength=n)
    repeats = per_unit["repeats_sum"].to_numpy()[order]
    ends = np.concatenate(([0], np.cumsum(repeats)))[np.concatenate(([0], np.cumsum(counts)))]
    return {
        "good": good,
        "n_a": np.diff(a.offsets.to_numpy()),
        "n_b": np.diff(b.offsets.to_numpy()),
        "n_groups": np.bincount(owner, minlength=n),
        "n_links": np.diff(ends),
        "text": text.to_numpy(zero_copy_only=False).tolist(),
        "pair_counts": counts,
        "pairs": per_unit["pair"].to_numpy()[order],
        "repeats": repeats,
    }


class Units:
    """Aligned units of a worker by their text, with what ``align`` says of them."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.texts: list[str] = []
        self.parts: list[dict] = []
        self.numbers = {k: np.zeros(0, np.int64) for k in ("good", "n_a", "n_b", "n_groups", "n_links", "pair_counts")}

    def codes(self, pieces: list[str], wanted: np.ndarray) -> np.ndarray:
        """Codes of different pieces; those that are wanted and new are aligned first."""
        code = self.code
        found = np.fromiter(map(code.get, pieces, repeat(-1)), np.int32, len(pieces))
        new = [pieces[i] for i in np.flatnonzero(wanted & (found < 0))]
        if new:
            simple = [p for p in new if p and not _ODD.search(p)]
            if len(simple) < len(new):
                held = set(simple)
                new = simple + [p for p in new if p not in held]
            part = align(self.tokenizers, new, len(simple))
            code.update(zip(new, range(len(code), len(code) + len(new))))
            self.texts += part.pop("text")
            for k in self.numbers:
                self.numbers[k] = np.concatenate((self.numbers[k], part.pop(k).astype(np.int64)))
            self.parts.append(part)
            found = np.fromiter(map(code.get, pieces, repeat(-1)), np.int32, len(pieces))
        return found

    def pairs_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of pairs per code, pairs, repeats) of some units."""
        for k in ("pairs", "repeats"):
            if len(self.parts) > 1:
                self.parts[0][k] = np.concatenate([p[k] for p in self.parts])
        del self.parts[1:]
        counts = self.numbers["pair_counts"]
        at = _spread(np.cumsum(counts) - counts, counts, codes)
        pairs, repeats = (self.parts[0][k] if self.parts else np.zeros(0, np.int64) for k in ("pairs", "repeats"))
        return counts[codes], pairs[at], repeats[at]


def _odd(pieces: pa.Array) -> np.ndarray:
    """Whether white space other than the single spaces around it touches a piece."""
    same = pc.equal(pc.utf8_trim_whitespace(pieces), pieces)
    return pc.or_(pc.invert(same), pc.equal(pc.binary_length(pieces), 0)).to_numpy(zero_copy_only=False)


def _spread(starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The places of all entries of some lists that lie one after the other."""
    size = sizes[codes]
    return np.repeat(starts[codes] - (np.cumsum(size) - size), size) + np.arange(size.sum())


class _Block:
    """Documents as codes of units, until they are a block."""

    def __init__(self, units: Units):
        self.units = units
        self.rows: list[dict] = []
        self.chars = 0

    def add(self, names: list, texts: pa.Array) -> None:
        """Documents with text; ids may be null."""
        lists = pc.split_pattern(texts, " ")
        words = pc.list_flatten(lists).dictionary_encode()
        pieces, odd = words.dictionary.to_numpy(zero_copy_only=False).tolist(), _odd(words.dictionary)
        at = words.indices.to_numpy()
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        marked = np.concatenate(([0], np.cumsum(odd[at])))[offsets]
        plain = np.diff(marked) == 0
        inside = np.repeat(plain, np.diff(offsets))
        wanted = np.zeros(len(pieces), bool)
        wanted[at[inside]] = True
        codes = self.units.codes(pieces, wanted)
        self._row([names[i] for i in np.flatnonzero(plain)], codes[at[inside]], np.diff(offsets)[plain])
        # Spaces next to other white space: cut at the spaces where both tokenizers cut for certain.
        for i in np.flatnonzero(~plain):
            pieces = _CUT.split(texts[i].as_py())
            different = list(dict.fromkeys(pieces))
            code = dict(zip(different, self.units.codes(different, np.ones(len(different), bool))))
            self._row([names[i]], np.fromiter(map(code.__getitem__, pieces), np.int32, len(pieces)), np.array([len(pieces)]))
        self.chars += pc.sum(pc.utf8_length(texts)).as_py() or 0

    def _row(self, names: list, codes: np.ndarray, lengths: np.ndarray) -> None:
        """Numbers of whole documents; those that one tokenizer does not spell right have no units."""
        if not names:
            return
        numbers, texts = self.units.numbers, self.units.texts
        ends = np.concatenate(([0], np.cumsum(lengths)))
        bad = np.concatenate(([0], np.cumsum(numbers["good"][codes] == 0)))
        whole = np.diff(bad[ends]) == 0
        row = {"doc_ids": names, "digests": []}
        for i, (s, e) in enumerate(zip(ends[:-1], ends[1:])):
            text = ";".join(map(texts.__getitem__, codes[s:e].tolist())) if whole[i] else ""
            row["digests"].append(hashlib.sha256(text.encode()).hexdigest() if whole[i] else "")
        for k in ("n_a", "n_b", "n_groups", "n_links"):
            sums = np.concatenate(([0], np.cumsum(numbers[k][codes])))
            row[k] = np.where(whole, np.diff(sums[ends]), 0)
        row["n_units"] = np.where(whole, lengths, 0).astype(np.int32)
        row["codes"] = codes[np.repeat(whole, lengths)]
        self.rows.append(row)

    def add_empty(self, names: list) -> None:
        zeros = np.zeros(len(names), np.int64)
        row = {"doc_ids": names, "digests": [""] * len(names), "n_units": zeros.astype(np.int32), "codes": np.zeros(0, np.int32)}
        self.rows.append(row | {k: zeros for k in ("n_a", "n_b", "n_groups", "n_links")})

    def finished(self, block: int):
        """The rows of the block as record batches: documents, units, and the pairs with their documents."""
        used, local = np.unique(np.concatenate([row["codes"] for row in self.rows]), return_inverse=True)
        counts, keys, repeats = self.units.pairs_of(used)
        pairs, pair_codes = np.unique(keys, return_inverse=True)
        bounds = np.cumsum(counts) - counts
        n_docs, ends = np.zeros(len(pairs), np.int64), np.cumsum([len(row["codes"]) for row in self.rows])
        for row, end in zip(self.rows, ends):
            row["codes"] = local[end - len(row["codes"]) : end].astype(np.int32)
            doc = np.repeat(np.arange(len(row["n_units"])), row["n_units"])
            held = pa.table({"doc": doc, "code": row["codes"]}).group_by(["doc", "code"], use_threads=False).aggregate([])
            code, doc = held["code"].to_numpy(), held["doc"].to_numpy()
            size = counts[code]
            linked = pair_codes[_spread(bounds, counts, code)]
            each = pa.table({"doc": np.repeat(doc, size), "pair": linked}).group_by(["doc", "pair"], use_threads=False)
            partial = each.aggregate([]).group_by("pair", use_threads=False).aggregate([([], "count_all")])
            n_docs[partial["pair"].to_numpy()] += partial["count_all"].to_numpy()
            yield _batch(block, _DOCS, 1, **{k: [row[k]] for k in row if k != "codes"}, codes=[_packed(row["codes"])])
        payload = {"pair_counts": counts, "pair_codes": pair_codes, "pair_repeats": repeats}
        yield _batch(block, _UNITS, 1, **{k: [_packed(v)] for k, v in payload.items()})
        for at in range(0, len(pairs), _ROW_CODES):
            some = pairs[at : at + _ROW_CODES]
            columns = {"place": np.arange(at, at + len(some)), "a": some >> _SHIFT, "b": some & _LOW, "n_docs": n_docs[at : at + len(some)]}
            yield _batch(block, _PAIRS, len(some), **columns)


_TYPES = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _arrow_schema(ddl: str) -> pa.Schema:
    fields = []
    for field in ddl.split(", "):
        name, kind = field.split(" ")
        inner = kind.removeprefix("array<").removesuffix(">")
        fields.append((name, pa.list_(_TYPES[inner]) if inner != kind else _TYPES[kind]))
    return pa.schema(fields)


_BLOCK_SCHEMA = _arrow_schema(BLOCKS)


def _batch(block: int, kind: int, n: int, **columns) -> pa.RecordBatch:
    columns |= {"block": [block] * n, "kind": [kind] * n}
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _BLOCK_SCHEMA]
    return pa.RecordBatch.from_arrays(arrays, schema=_BLOCK_SCHEMA)


def _slices(batch: pa.RecordBatch):
    """(start, end) of rows of about ``_BATCH_CHARS`` letters."""
    size = np.cumsum(pc.fill_null(pc.utf8_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(size):
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + _BATCH_CHARS)))
        end = min(end, start + _ROW_DOCS)
        yield start, end
        start = end


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<i4").tobytes())


def _unpacked(data: pa.Scalar) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_buffer()), "<i4")


def _blocks(path_a: str, path_b: str, block_chars: int):
    def run(batches):
        pa.set_cpu_count(1)
        units = worker_state(f"units {path_a} {path_b}", lambda: Units(Tokenizers(path_a, path_b)))
        number = TaskContext.get().partitionId() << 32
        block = _Block(units)
        for batch in batches:
            for start, end in _slices(batch):
                some = pa.Table.from_batches([batch.slice(start, end - start)])
                full = pc.fill_null(pc.greater(pc.utf8_length(some["text"]), 0), False)
                empty = some.filter(pc.invert(full))
                if len(empty):
                    block.add_empty(empty["doc_id"].to_pylist())
                some = some.filter(full)
                if len(some):
                    block.add(some["doc_id"].to_pylist(), pc.cast(some["text"], pa.string()).combine_chunks())
                if block.chars >= block_chars:
                    yield from block.finished(number)
                    number, block = number + 1, _Block(units)
                    if len(units.code) > KNOWN_UNITS:
                        units.clear()
        if block.rows:
            yield from block.finished(number)
        if len(units.code) > KNOWN_UNITS:
            units.clear()

    return run


def _scored(key, blocks: pa.Table, counts: pa.Table) -> pa.Table:
    """The rows of one block's documents, from the corpus-wide counts of the block's pairs."""
    release_worker_state()
    size = len(counts)
    place = counts["place"].to_numpy()
    n_docs, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    n_docs[place] = counts["n"].to_numpy()
    best[place] = counts["best"].to_numpy(zero_copy_only=False)
    kinds = blocks["kind"].to_numpy()
    units = blocks.take(np.flatnonzero(kinds == _UNITS))
    pair_counts, codes, repeats = (_unpacked(units[k][0]) for k in ("pair_counts", "pair_codes", "pair_repeats"))
    bounds = np.concatenate(([0], np.cumsum(pair_counts)))

    def per_unit(values):
        return np.diff(np.concatenate(([0], np.cumsum(values[codes] * repeats)))[bounds])

    of_unit = {"n_best": per_unit(best), "count_sum": per_unit(n_docs)}
    out = []
    for row in blocks.take(np.flatnonzero(kinds == _DOCS)).select(_DOC_COLUMNS).to_batches(max_chunksize=1):
        used = _unpacked(row["codes"][0])
        ends = np.concatenate(([0], np.cumsum(row["n_units"][0].values.to_numpy())))
        columns = {k: row[k][0].values for k in ("n_a", "n_b", "n_groups", "n_links")}
        columns |= {k: np.diff(np.concatenate(([0], np.cumsum(v[used])))[ends]) for k, v in of_unit.items()}
        columns |= {"doc_id": row["doc_ids"][0].values, "groups_sha256": row["digests"][0].values}
        out.append(pa.table([columns[f.name] for f in _ROW_SCHEMA], schema=_ROW_SCHEMA))
    return pa.concat_tables(out) if out else _ROW_SCHEMA.empty_table()


_DOC_COLUMNS = ["codes", "n_units", "n_a", "n_b", "n_groups", "n_links", "doc_ids", "digests"]
_ROW_SCHEMA = _arrow_schema(ROWS)


def aligned_blocks(
    docs: DataFrame, path_a: str, path_b: str, id_col="doc_id", text_col="text", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Written rows of blocks (``BLOCKS``): documents as codes of units, units with their id pairs, and the
    pairs of a block with the number of its documents that hold them."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return staged(rows.mapInArrow(_blocks(path_a, path_b, block_chars), BLOCKS), "alignment")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, n, best): documents that hold the ids linked, and whether no other partner of ``a`` has more."""
    pairs = blocks.filter(F.col("kind") == _PAIRS).groupBy("a", "b").agg(F.sum("n_docs").alias("n"))
    most = pairs.groupBy("a").agg(F.max("n").alias("most"))
    return pairs.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str, **how) -> DataFrame:
    """One row (``ROWS``) per row of ``docs``: how its tokens by a byte-level tokenizer (``path_a``, which sees a
    space before the text) and by a piece tokenizer (``path_b``) line up.

    Byte offsets where tokens of both end cut a text into groups; all pairs of an a-token and a b-token
    within a group are links. ``count_sum`` adds up, over the links, in how many documents of the corpus
    their two ids are linked; ``n_best`` counts links whose pair has the most documents among the pairs of
    its a-id, ties included. Texts that are null, empty or not spelled exactly by both tokenizers have no
    tokens: zeros and an empty digest. Null ids and repeated rows are rows like others; other columns are
    not looked at. No documents give no rows.

    Both tokenizers start a token at a space between two signs that are no white space, so a text is a list
    of units, and a unit is tokenized and aligned once per block. A block (``block_chars`` letters, one task's
    share) counts its documents per id pair; Spark adds the counts up and joins them back to the pairs of
    each block, so a task gets counts for its own pairs alone and nothing is broadcast that grows. What is
    shuffled: the pairs of each block twice, and the coded documents once.
    """
    blocks = aligned_blocks(docs, path_a, path_b, **how)
    own = blocks.filter(F.col("kind") == _PAIRS).select(F.col("block").alias("of"), "place", "a", "b")
    counts = own.join(pair_counts(blocks), ["a", "b"]).select("of", "place", "n", "best")
    coded = blocks.filter(F.col("kind") != _PAIRS).drop("place", "a", "b", "n_docs")
    return coded.groupBy("block").cogroup(counts.groupBy("of")).applyInArrow(_scored, ROWS)
