"""Token ids of documents in Simple-8b blocks, written in order of the ids and read back."""

import re
import zlib
from array import array
from itertools import compress, repeat
from operator import not_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricemill.llm.worker import worker_state

# Fixed values: (bits, count) of selectors 1 to 14 of a word; 4 selector bits, 60 payload bits.
# Selector 0 is the escape: the payload is a place in the block file's list of 64-bit values.
SELECTORS = ((1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8), (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1))
BLOCK_IDS = 1024
SEGMENT_IDS = 1 << 17
END_ID = 0
_HEADER = np.dtype([("magic", "<u4"), ("block_ids", "<u4"), ("n_ids", "<u8"), ("n_blocks", "<u4"), ("n_escapes", "<u4"), ("n_words", "<u8")])
_MAGIC = 0x31423853
_COUNTS = np.array([1, *(count for _, count in SELECTORS), 1], np.int64)
# Pieces a worker remembers, about 200 bytes each: time against memory, never results.
CACHE_PIECES = 400_000
_BULK_PIECES = 10_000
_END = END_ID.to_bytes(4, "little")
_PUNCTUATION = ".,;:!?*#$%&"
# The byte-level sign for a space.
_SPACE = "\u0120"
# The byte-level sign of each byte above ASCII: the byte itself if it is printed, else the next sign from 256 + 34 on
# (33 control signs and the space come first). Below, only the line end is needed.
_UNPRINTED = [*range(0x7F, 0xA1), 0xAD]
_BYTE_SIGNS = {10: 256 + 10} | {byte: 256 + 33 + i for i, byte in enumerate(_UNPRINTED)}
_CHUNK_CHARS = 4_000_000
# Pre-tokens that are told without the tokenizer: letters of old scripts (Latin, Cyrillic, unified ideographs), digits,
# punctuation, and a line end before another sign.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0410-\u044f\u4e00-\u9fa5]"
_PRE_TOKENS = re.compile(rf"{_LETTERS}+|[0-9]+|[{_PUNCTUATION}]+|\n").findall
_MADE_OF_THEM = re.compile(rf"(?:{_LETTERS}++|[0-9]++|[{_PUNCTUATION}]++|\n(?=\S))+").fullmatch
# A space between two other signs that are no white space always starts a new pre-token.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _choices(values: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a word that starts at each place: the selector that takes most ids, and how many.

    A selector fits where as many ids as it holds are small enough and stand before ``limit``; one that
    fits all values may also be filled in part.
    """
    n = len(values)
    room = (limit - np.arange(n)).astype(np.int32)
    selector, take = np.zeros(n, np.uint8), np.ones(n, np.uint8)
    if n and values.max() < 1 << 32:
        values = values.astype(np.uint32)
    for code, (bits, count) in reversed(list(enumerate(SELECTORS, 1))):
        fits = values < (1 << bits)
        if fits.all():
            selector[:], take[:] = code, np.minimum(count, room)
            continue
        length = 1
        while length < count:  # runs of twice the length, or what is left
            step = min(length, count - length)
            fits[:-step] &= fits[step:]
            fits[-step:] = False
            length += step
        fits &= room >= count
        np.putmask(selector, fits, code)
        np.putmask(take, fits, count)
    return selector, take


def encode(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    """Unsigned 64-bit ids as a header, the first word of every block, the words and the escaped values.

    A word packs as many of the next ids as one selector holds. Every block of ``block_ids`` ids starts on
    a word of its own, so a reader can decode any block alone.
    """
    values = np.ascontiguousarray(ids, np.uint64)
    n = len(values)
    limit = np.minimum((np.arange(n) // block_ids + 1) * block_ids, n)
    selector, take = _choices(values, limit)
    marks, at, steps = bytearray(n), 0, take.tobytes()
    while at < n:
        marks[at] = 1
        at += steps[at]
    starts = np.flatnonzero(np.frombuffer(marks, np.uint8))
    chosen = selector[starts].astype(np.int64)
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([values, np.zeros(60, np.uint64)])
    for code, (bits, count) in enumerate(SELECTORS, 1):
        at = np.flatnonzero(chosen == code)
        if len(at):
            places = starts[at][:, None] + np.arange(count)
            taken = np.where(places < (starts + take[starts])[at][:, None], padded[places], np.uint64(0))
            words[at] |= np.bitwise_or.reduce(taken << (np.arange(count, dtype=np.uint64) * np.uint64(bits)), axis=1)
    escaped = np.flatnonzero(chosen == 0)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    offsets = np.searchsorted(starts, np.arange(0, n, block_ids)).astype("<u4")
    header = np.array([(_MAGIC, block_ids, n, len(offsets), len(escaped), len(words))], _HEADER)
    escapes = values[starts[escaped]]
    return b"".join(a.tobytes() for a in (header, offsets, words.astype("<u8"), escapes.astype("<u8")))


def decode(data: bytes, first_block: int = 0, end_block: int | None = None) -> np.ndarray:
    """The ids of the blocks from ``first_block`` to before ``end_block`` (all by default), all words at once."""
    header = np.frombuffer(data, _HEADER, 1)[0]
    if header["magic"] != _MAGIC:
        raise ValueError("these are not Simple-8b blocks")
    n, n_blocks, n_words, size = (int(header[k]) for k in ("n_ids", "n_blocks", "n_words", "block_ids"))
    place = _HEADER.itemsize
    offsets = np.frombuffer(data, "<u4", n_blocks, place).astype(np.int64)
    place += 4 * n_blocks
    words = np.frombuffer(data, "<u8", n_words, place)
    escapes = np.frombuffer(data, "<u8", int(header["n_escapes"]), place + 8 * n_words)
    end_block = n_blocks if end_block is None else min(end_block, n_blocks)
    if first_block >= end_block:
        return np.zeros(0, np.uint64)
    bounds = np.append(offsets, n_words)[first_block : end_block + 1]
    words = words[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    codes = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[codes]
    before = np.cumsum(counts) - counts
    block = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    into = before - before[bounds[:-1]][block] + block * size
    total = min(n, end_block * size) - first_block * size
    ends = np.minimum((block + 1) * size, total)
    out = np.zeros(total, np.uint64)
    for code, (bits, count) in enumerate(SELECTORS, 1):
        at = np.flatnonzero(codes == code)
        if len(at):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            values = (words[at][:, None] >> shifts) & np.uint64((1 << bits) - 1)
            places = into[at][:, None] + np.arange(count)
            real = places < ends[at][:, None]
            out[places[real]] = values[real]
    at = np.flatnonzero(codes == 0)
    out[into[at]] = escapes[(words[at] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def _strings(texts: pa.Array) -> list[str]:
    """A list of texts; several times faster than ``to_pylist``."""
    return texts.to_numpy(zero_copy_only=False).tolist()


class PieceEncoder:
    """Ids of whole texts, from the ids of their pieces between single spaces, which repeat very often.

    The pre-tokens of a new piece of letters, digits and punctuation go to the merges of the tokenizer's model at
    once, which takes half the time.

    The byte-level pre-tokenizer never joins signs across a space that stands between two other signs, so
    the ids are those of the text encoded at once; a tokenizer with other cuts raises ValueError. The pieces of a
    batch are split and numbered by Arrow, so each different one is looked up once; its ids, those of a word and
    those of the punctuation behind it, are gathered by their numbers. About ``cache_pieces`` pieces are
    remembered, beyond that all are forgotten between two batches.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.cache_pieces = cache_pieces
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith(_SPACE)]] = True
        self.merges = self._direct()
        self._forget()

    def _direct(self):
        """The model's own function for one pre-token, where nothing but byte-level cuts stands before it."""
        from tokenizers import models, pre_tokenizers

        whole, cuts = self.tokenizer, self.tokenizer.pre_tokenizer
        byte_level = isinstance(cuts, pre_tokenizers.ByteLevel) and cuts.use_regex and not cuts.add_prefix_space
        letters = any(_MADE_OF_THEM(t.content.strip()) for t in whole.get_added_tokens_decoder().values())
        plain = isinstance(whole.model, models.BPE) and not whole.model.dropout and whole.normalizer is None
        if not (byte_level and plain) or letters:
            return None
        whole.model._resize_cache(0)  # a word is asked for once
        return whole.model.tokenize

    def _forget(self) -> None:
        # Entry 0 is nothing, entry 1 the end id. A word stands with its space, other entries as they are.
        self.words: dict[str, int] = {}
        self.alone: dict[str, int] = {"": 0}
        self.ids, self.sizes = [np.array([END_ID], np.uint32)], [np.array([0, 1], np.int64)]
        self.n_entries = 2

    def _plain(self, texts: list[str]) -> list[bytes]:
        encodings = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encodings]

    def _add(self, names: dict[str, int], texts: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        names.update(zip(texts, range(self.n_entries, self.n_entries + len(texts))))
        self.n_entries += len(texts)
        self.ids.append(ids.astype(np.uint32))
        self.sizes.append(sizes.astype(np.int64))

    def _codes(self, names: dict[str, int], texts: list[str], learn) -> np.ndarray:
        """Entries of different texts; new ones are learnt."""
        found = np.fromiter(map(names.get, texts, repeat(-1)), np.int64, len(texts))
        new = np.flatnonzero(found < 0)
        if len(new):
            learn([texts[i] for i in new])
            found[new] = np.fromiter(map(names.__getitem__, map(texts.__getitem__, new.tolist())), np.int64, len(new))
        return found

    def _learn_words(self, new: list[str]) -> None:
        if self.merges is not None:
            single = list(map(bool, map(_MADE_OF_THEM, new)))
            self._learn_by_merges(list(compress(new, single)))
            new = list(compress(new, map(not_, single)))
        for at in range(0, len(new), _BULK_PIECES):
            part = new[at : at + _BULK_PIECES]
            bulk = [" " + " ".join(part[i : i + 500]) for i in range(0, len(part), 500)]
            ids = np.frombuffer(b"".join(self._plain(bulk)), "<u4")
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(part):
                raise ValueError("this tokenizer does not keep pieces between spaces apart")
            self._add(self.words, part, ids, np.diff(np.append(starts, len(ids))))

    def _learn_by_merges(self, new: list[str]) -> None:
        merges, ids, ends, later = self.merges, array("I"), array("I"), {}

        def merged(part: str, space: str = "") -> list[int]:
            signs = part.encode().decode("latin-1").translate(_BYTE_SIGNS)
            return [token.id for token in merges(space + signs)]

        for word in new:
            if word.isalpha() and word.isascii():
                ids.extend([token.id for token in merges(_SPACE + word)])
            else:
                first, *others = _PRE_TOKENS(word)
                ids.extend(merged(first, _SPACE))
                for part in others:
                    if part not in later:
                        later[part] = merged(part)
                    ids.extend(later[part])
            ends.append(len(ids))
        sizes = np.diff(np.frombuffer(ends, np.uint32), prepend=np.uint32(0)) if new else np.zeros(0)
        self._add(self.words, new, np.frombuffer(ids, np.uint32), sizes)

    def _learn_alone(self, new: list[str]) -> None:
        encoded = self._plain(new)
        sizes = np.fromiter(map(len, encoded), np.int64, len(new)) // 4
        self._add(self.alone, new, np.frombuffer(b"".join(encoded), "<u4"), sizes)

    def _gathered(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all entries one after the other, their number per entry)."""
        for k in ("ids", "sizes"):
            if len(getattr(self, k)) > 1:
                setattr(self, k, [np.concatenate(getattr(self, k))])
        sizes = self.sizes[0]
        size = sizes[entries]
        starts = (np.cumsum(sizes) - sizes)[entries]
        at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.ids[0][at], size

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """One array of ids per text, the end id last."""
        if not texts:
            return []
        if self.n_entries > self.cache_pieces:
            self._forget()
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        numbered = pc.list_flatten(lists).dictionary_encode()
        pieces, at = numbered.dictionary, numbered.indices.to_numpy()
        bounds = lists.offsets.to_numpy()
        touched = pc.or_(pc.not_equal(pc.utf8_trim_whitespace(pieces), pieces), pc.equal(pc.binary_length(pieces), 0))
        # A letter or digit and a punctuation mark are never one pre-token.
        bare = pc.utf8_rtrim(pieces, characters=_PUNCTUATION)
        words = pc.if_else(pc.match_substring_regex(bare, r"[\p{L}\p{N}]$"), bare, pieces)
        behind = pc.subtract(pc.binary_length(pieces), pc.binary_length(words)).to_numpy()
        touched = touched.to_numpy(zero_copy_only=False)
        first = np.zeros(len(at), bool)
        first[bounds[:-1]] = True
        # White space next to a space, but for the first piece, which is encoded as it stands.
        odd = touched[at] & ~first
        odd[bounds[:-1]] = touched[at[bounds[:-1]]] & (np.diff(bounds) > 1)
        whole = np.add.reduceat(odd, bounds[:-1]) == 0
        used = np.zeros(len(pieces), bool)
        used[at[~first & np.repeat(whole, np.diff(bounds))]] = True
        entries = np.zeros((len(at), 3), np.int32)
        chosen = np.flatnonzero(used)
        code = np.zeros((len(pieces), 2), np.int64)
        picked = words.take(pa.array(chosen)).dictionary_encode()
        code[chosen, 0] = self._codes(self.words, _strings(picked.dictionary), self._learn_words)[picked.indices.to_numpy()]
        chosen = chosen[behind[chosen] > 0]
        marks = [p[-k:] for p, k in zip(_strings(pieces.take(pa.array(chosen))), behind[chosen].tolist())]
        self._codes(self.alone, list(set(marks)), self._learn_alone)
        code[chosen, 1] = np.fromiter(map(self.alone.__getitem__, marks), np.int64, len(marks))
        entries[:, :2] = code[at]
        heads = pieces.take(pa.array(at[bounds[:-1]])).dictionary_encode()
        entries[bounds[:-1], 0] = self._codes(self.alone, _strings(heads.dictionary), self._learn_alone)[heads.indices.to_numpy()]
        entries[bounds[:-1], 1] = 0
        entries[bounds[1:] - 1, 2] = 1
        ids, size = self._gathered(entries.ravel())
        ends = np.concatenate(([0], np.cumsum(size)))[3 * bounds]
        out = [ids[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
        for i in np.flatnonzero(~whole):
            out[i] = np.frombuffer(self._with_white_space(texts[i]) + _END, "<u4")
        return out

    def _with_white_space(self, text: str) -> bytes:
        """A text with spaces next to other white space: cut at single spaces only."""
        return b"".join(self._plain(_CUT.sub("\0 ", text).split("\0") if "\0" not in text else [text]))


def _chunks(rows):
    """(ids, texts) of about ``_CHUNK_CHARS`` letters."""
    names, texts, held = [], [], 0
    for name, text in rows:
        names.append(name)
        texts.append("" if text is None else text)
        held += len(texts[-1])
        if held >= _CHUNK_CHARS:
            yield names, texts
            names, texts, held = [], [], 0
    if names:
        yield names, texts


SEGMENTS = "part int, start long, n_ids long, doc_ids array<long>, lengths array<long>, blocks binary"


def _segments(tokenizer_path: str, segment_ids: int, block_ids: int, cache_pieces: int):
    def write(batches):
        name = f"tokenizer {cache_pieces} {tokenizer_path}"
        encoder = worker_state(name, lambda: PieceEncoder(tokenizer_path, cache_pieces))
        part, start = TaskContext.get().partitionId(), 0
        names, ids, held = [], [], 0

        def segment():
            all_ids = np.concatenate(ids)
            lengths = [len(x) for x in ids]
            row = (part, start, len(all_ids), names, lengths, encode(all_ids, block_ids))
            return pd.DataFrame([row], columns=["part", "start", "n_ids", "doc_ids", "lengths", "blocks"])

        for batch in batches:
            for some, texts in _chunks(zip(batch["doc_id"].astype(object), batch["text"])):
                for name, encoded in zip(some, encoder(texts)):
                    names.append(None if pd.isna(name) else int(name))
                    ids.append(encoded)
                    held += len(encoded)
                    if held >= segment_ids:
                        yield segment()
                        start += held
                        names, ids, held = [], [], 0
        if names:
            yield segment()

    return write


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    segment_ids: int = SEGMENT_IDS,
    block_ids: int = BLOCK_IDS,
    cache_pieces: int = CACHE_PIECES,
) -> None:
    """Encode every text, append ``END_ID`` and write the ids in ascending order of the id, nulls first.

    The folder holds Parquet files of segments: whole documents of about ``segment_ids`` ids as one
    Simple-8b byte string (see ``encode``), with their ids and lengths, the part (its place among the sorted
    ranges) and the ids of the part before it. Rows that share an id follow a hash of their text. One range
    shuffle of the texts; a task holds one segment. Null texts are empty and give the end id alone.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges.mapInPandas(_segments(tokenizer_path, segment_ids, block_ids, cache_pieces), SEGMENTS).write.parquet(path)


DOCUMENTS = "part int, doc_id long, start long, n_tokens long, ids array<int>"


def _documents(batches):
    for batch in batches:
        for row in batch.itertuples():
            ids = decode(row.blocks).astype(np.int64)
            ends = np.cumsum(np.asarray(row.lengths, np.int64))
            starts = ends - np.asarray(row.lengths, np.int64)
            yield pd.DataFrame(
                {
                    "part": row.part,
                    "doc_id": pd.array([None if pd.isna(d) else int(d) for d in row.doc_ids], "Int64"),
                    "start": row.start + starts,
                    "n_tokens": ends - starts,
                    "ids": [ids[s:e].astype(np.int32) for s, e in zip(starts, ends)],
                }
            )


def _digests(batches):
    for batch in _documents(batches):
        crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in batch.pop("ids")]
        yield batch.assign(ids_crc32=np.array(crcs, np.int64))


def _from_files(spark: SparkSession, path: str, reader, schema: str) -> DataFrame:
    segments = spark.read.schema(SEGMENTS).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per part; their number is the number of shuffle partitions of the writing job.
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = segments.mapInPandas(reader, schema)
    return rows.join(F.broadcast(parts), "part").withColumn("start", F.col("start") + F.col("base")).drop("part", "base")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ``start`` counts the ids of all documents before, over all files."""
    return _from_files(spark, path, _documents, DOCUMENTS)


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the crc32 of the ids as little-endian 32-bit numbers."""
    return _from_files(spark, path, _digests, DOCUMENTS.replace("ids array<int>", "ids_crc32 long"))
