"""Token counts from distinct pre-tokens, without token ids.

1. A table of the most frequent pre-tokens of a sample of documents (``SAMPLE_DOCS`` expected) is counted and
   broadcast (at most ``HEAD`` entries). It decides only where a pre-token is looked up.
2. One pass turns each block of documents into pre-token frequencies. Frequent ones are
   summed at once; each other distinct pre-token of the block becomes one row with its
   (document, count) pairs.
3. Rows meet by pre-token; pieces are counted once per distinct pre-token, multiplied into
   the pairs and summed per document.

Pre-tokens are those of the tokenizer's byte-level pattern; strings of its special tokens are
one pre-token each, as the library treats them by default. The number of pieces comes from the
library itself.

Cases: a null text counts as empty (0 bytes, 0 tokens); a null id is kept; repeated rows are
counted each; very long texts are read whole (a block ends after a bounded number of
characters or with the text that passes it); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_sample, ship, stable

HEAD, SAMPLE_DOCS = 50_000, 4_000
BLOCK_CHARS, BLOCK_DOCS = 24_000_000, 1 << 15
#: The pre-tokenizer's fixed pattern, with its Unicode white space spelled out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_SCHEMA = "pretoken string, salt long, block long, uses array<int>, about binary"


class Pieces:
    """A tokenizer of the ``tokenizers`` library, as far as counting needs it."""

    def __init__(self, path: str) -> None:
        import json

        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.special = tuple(special)

    def pretokens(self, text: str) -> list[str]:
        if self.split and any(s in text for s in self.special):
            return list(chain.from_iterable([x] if x in self.special else self.find(x) for x in self.split(text)))
        return self.find(text)

    def count(self, pretokens: list[str]) -> np.ndarray:
        return np.fromiter((len(e) for e in self.library.encode_batch_fast(pretokens, add_special_tokens=False)), np.int64, len(pretokens))


@lru_cache(2)
def _pieces(path: str) -> Pieces:
    """One per worker process. The file is on every machine, as the libraries are."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Pieces(path)


def _head(rows: DataFrame, path: str, head: int, sample_docs: int) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens of a sample; bounded by ``head``."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, seen = _pieces(path), Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(set(pieces.pretokens(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pretoken", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_pieces(path).count(words))], names=["pretoken", "n"])

    rate = sample_docs / max(1, rows.count())
    sample = rows.filter(in_sample("doc_id", rate)).select("text")
    top = sample.mapInArrow(split, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "pretoken").limit(head)
    return {r[0]: r[1] for r in top.select("pretoken").mapInArrow(count, "pretoken string, n long").collect()}


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; ``path`` is a tokenizer file."""
    ship(docs.sparkSession)
    rows = stable(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    known = docs.sparkSession.sparkContext.broadcast(_head(rows, path, head, sample_docs))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, head_pieces = _pieces(path), known.value
        block = TaskContext.get().partitionId() << 24
        uses: dict[str, list[int]] = {}
        heads: list[tuple[int, int, int]] = []
        chars = 0

        def flush() -> Iterator[pa.RecordBatch]:
            # The documents themselves: one row per block, dealt by block.
            about = np.array([(i or 0, i is None, n, total) for i, n, total in heads], np.int64)
            yield _batch([""], [block], [block], [[]], [about.tobytes()])
            names, lists = list(uses), list(uses.values())
            for k in range(0, len(names), 20_000):
                some, n = names[k : k + 20_000], len(names[k : k + 20_000])
                yield _batch(some, np.zeros(n, np.int64), np.full(n, block), lists[k : k + 20_000], [None] * n)

        for batch in batches:
            for doc_id, text, n_bytes in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "n_bytes"))):
                doc, total = len(heads), 0
                for word, n in Counter(pieces.pretokens(text)).items():
                    if k := head_pieces.get(word):
                        total += k * n
                        continue
                    while n > 0:  # the count has 16 bits of a pair; more take several pairs
                        pair = doc << 16 | min(n, 0xFFFF)
                        if word in uses:
                            uses[word].append(pair)
                        else:
                            uses[word] = [pair]
                        n -= 0xFFFF
                heads.append((doc_id, n_bytes, total))
                chars += len(text)
                if chars >= BLOCK_CHARS or len(heads) == BLOCK_DOCS:
                    yield from flush()
                    uses, heads, chars, block = {}, [], 0, block + 1
        if heads:
            yield from flush()

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_pieces = None, 0
        for batch in batches:
            words = batch.column("pretoken").to_pylist()
            new = [k for k, w in enumerate(words) if w and w != (words[k - 1] if k else last)]
            pieces = np.zeros(len(words), np.int64)
            counted = _pieces(path).count([words[k] for k in new])
            which = np.searchsorted(new, np.arange(len(words)), "right") - 1
            pieces = np.where(which >= 0, counted[which] if len(counted) else 0, last_pieces)
            pieces[[k for k, w in enumerate(words) if not w]] = 0
            last, last_pieces = words[-1], int(pieces[-1])
            lists = batch.column("uses")
            lengths, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy().astype(np.int64)
            blocks = batch.column("block").to_numpy() << 15
            for k in (k for k, w in enumerate(words) if not w):
                about = np.frombuffer(batch.column("about")[k].as_py(), np.int64).reshape(-1, 4)
                ids = pa.array(about[:, 0], mask=about[:, 1] == 1)
                yield pa.RecordBatch.from_arrays([pa.array(blocks[k] | np.arange(len(about))), pa.array(about[:, 3]), ids, pa.array(about[:, 2])], schema=out)
            pairs, inverse = np.unique(np.repeat(blocks, lengths) | (flat >> 16), return_inverse=True)
            if len(pairs):
                tokens = np.bincount(inverse, weights=np.repeat(pieces, lengths) * (flat & 0xFFFF)).astype(np.int64)
                empty = pa.nulls(len(pairs), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(tokens), empty, empty], schema=out)

    out = pa.schema([(c, pa.int64()) for c in ("rid", "tokens", "doc_id", "n_bytes")])
    by_word = rows.mapInArrow(frequencies, _SCHEMA).repartition("pretoken", "salt").sortWithinPartitions("pretoken")
    summed = by_word.mapInArrow(multiply, "rid long, tokens long, doc_id long, n_bytes long").groupBy("rid").agg(F.sum("tokens").alias("n_tokens"), F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"))
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _batch(words, salts, blocks, uses, about) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(words, pa.string()), pa.array(salts, pa.int64()), pa.array(blocks, pa.int64()), pa.array(uses, pa.list_(pa.int32())), pa.array(about, pa.binary())], names=["pretoken", "salt", "block", "uses", "about"]
    )
