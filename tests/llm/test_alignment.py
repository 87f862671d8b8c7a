"""op12 against plain Python, which tokenizes whole texts and walks the tokens one by one."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricemill.llm import alignment
from pricemill.llm.queries import QUERIES

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


class Plain:
    def __init__(self):
        from sentencepiece import SentencePieceProcessor

        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=PATHS[1])
        self.names = {i: t for t, i in self.a.get_vocab().items()}
        # The byte-level alphabet, from a decoder of the library's own.
        signs = alignment.byte_level_signs()
        self.spell_a = {i: bytes(signs[c] for c in t) if all(c in signs for c in t) else t.encode() for i, t in self.names.items()}

    def groups(self, text):
        """[(a ids, b ids)] of a text, or None."""
        if not text:
            return None
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        bytes_a = [self.spell_a[i] for i in a]
        bytes_b = [alignment.piece_bytes(self.b.id_to_piece(i)) for i in b]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            return None
        out, i, j, end_a, end_b, start = [], 0, 0, 0, 0, (0, 0)
        while i < len(a) or j < len(b):
            if end_a <= end_b and i < len(a):
                end_a += len(bytes_a[i])
                i += 1
            else:
                end_b += len(bytes_b[j])
                j += 1
            if end_a == end_b:
                out.append((a[start[0] : i], b[start[1] : j]))
                start = (i, j)
        return out


def brute(rows):
    plain = Plain()
    grouped = [plain.groups(text) for _, text in rows]
    links = [[(x, y) for a, b in g or () for x in a for y in b] for g in grouped]
    docs = Counter(pair for each in links for pair in set(each))
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = []
    for (name, _), groups, each in zip(rows, grouped, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups or ())
        out.append(
            (
                name, sum(len(a) for a, _ in groups or ()), sum(len(b) for _, b in groups or ()), len(groups or ()), len(each),
                sum(docs[p] == most[p[0]] for p in each), sum(docs[p] for p in each),
                hashlib.sha256(text.encode()).hexdigest() if groups is not None else "",
            )
        )
    return sorted(out, key=repr)


def got(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


ODD = [
    None, "", " ", "  ", "x", "a b", "a  b", " a", "a ", "a   b", "a\n b", "a \nb", "x \n y", "foo\n \nbar", "\n", "\t\t a", "a b 　c",
    "▁x y", "x ▁ y", "<|endoftext|> and <s> </s> <unk> <0x0A>", "don't  can't we'll 've", "naïve ﬁne ①②③ 日本語テキスト 한국어 🙂🙂🏽 é",
    "\x00 \x1c \x1f a\x85b", "12345678 3.14 1,000,000 .. ... !!! a.b,c;d", "e" * 500, "ab" * 300 + " z", "\r\n a\r\nb", " x   y",
]


@pytest.mark.parametrize("block_chars", [50, 32_000_000])
@pytest.mark.parametrize("partitions", [1, 3])
def test_alignment_of_odd_texts(spark, block_chars, partitions):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (5, "a b"), (5, "a b"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    docs = docs.withColumns({"kind": F.lit("x"), "block": F.lit(1), "a": F.lit(2)})
    assert got(alignment.alignment(docs, *PATHS, block_chars=block_chars)) == brute(rows)


def test_random_mixtures_of_signs(spark):
    import random

    draw = random.Random(5)
    signs = [" ", " ", " ", "\n", "\t", "a", "b", "the", "ing", "é", "日", "🙂", ".", ",", "'s", "1", "23", "▁", "<|endoftext|>", " ", "_", "-"]
    rows = [(i, "".join(draw.choices(signs, k=draw.randrange(1, 40)))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert got(alignment.alignment(docs, *PATHS, block_chars=2000)) == brute(rows)


def test_no_documents_give_no_rows(spark):
    assert got(alignment.alignment(spark.createDataFrame([], "doc_id long, text string"), *PATHS)) == []


def test_query_matches_plain_python(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op12_token_alignment"](spark, sf_dir)) == brute(rows)
