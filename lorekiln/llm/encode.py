"""Encoding of texts with a public byte-level BPE tokenizer.

Text is cut at every space that follows a non-space. The tokenizer's split pattern never joins such a space to what
stands before it and looks at nothing to its left, so each chunk (a word with the space before it and the marks around
it) has the same ids wherever it stands. Frequent chunks, counted over all texts, are compiled with their ids into a
minimal acyclic transducer, which workers memory-map; all other chunks are merged exactly by the vocabulary's ranks.
"""

from __future__ import annotations

import base64
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.llm.lexicon import Transducer
from lorekiln.plans.stage import Stages

#: Fixed value: the split pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEXICON_WORDS = 30_000
_LONGEST = 48  # longer chunks are merged, not remembered
_REMEMBERED = 200_000
_CUT = re.compile(r"(?<=\S) ")
_RUN = re.compile(r"\s ")


def chunks(text: str) -> list[str]:
    """The text cut at spaces that follow a non-space; all but the first chunk lose that space."""
    return _CUT.split(text) if text[:1] == " " or _RUN.search(text) else text.split(" ")


def vocabulary_encoder(ranks_file: bytes, pattern: str = PATTERN):
    """Exact encoder of one text by the merge ranks of a vocabulary file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class ChunkEncoder:
    """Ids of whole texts on one worker: transducer first, exact merges for the rest, both remembered as bytes."""

    def __init__(self, lexicon: Transducer, merge):
        self.lexicon, self.merge = lexicon, merge
        self.known: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        if len(self.known) + len(new) > _REMEMBERED:
            self.known.clear()
        lex = self.lexicon
        ranks = lex.ranks([(" " + c).encode() for c in new])
        for c, r in zip(new, ranks.tolist()):
            if r >= 0:
                self.known[c] = lex.ids[lex.offsets[r] : lex.offsets[r + 1]].tobytes()
            else:
                self.known[c] = np.array(self.merge(" " + c), np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """int32 ids of each text as bytes; none for null and empty texts."""
        cut = [chunks(t) if t else None for t in texts]
        wanted = set()
        for c in cut:
            if c:
                wanted.update(c[1:])
        new = [w for w in wanted if w not in self.known and len(w) <= _LONGEST]
        if len(self.known) + len(new) > _REMEMBERED:
            new = [w for w in wanted if len(w) <= _LONGEST]  # the memory starts anew
        self._learn(new)
        known, merge, out = self.known, self.merge, []
        raw = lambda s: np.array(merge(s), np.int32).tobytes()
        for c in cut:
            if not c:
                out.append(b"")
                continue
            try:
                rest = b"".join(map(known.__getitem__, c[1:]))
            except KeyError:
                rest = b"".join(known[w] if w in known else raw(" " + w) for w in c[1:])
            out.append((raw(c[0]) if c[0] else b"") + rest)
        return out


def count_chunks(texts: DataFrame, text: str) -> DataFrame:
    """(chunk, n) over all texts: chunks that follow a space, as the lexicon keys them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["chunk", "n"]
            )
            seen.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(w for w in chunks(t)[1:] if len(w) <= _LONGEST)
            if len(seen) > _REMEMBERED:
                yield flush()
        yield flush()

    part = texts.select(text).mapInArrow(count, "chunk string, n long")
    return part.groupBy("chunk").agg(F.sum("n").alias("n"))


def encode_texts(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    lexicon_words: int = LEXICON_WORDS,
    sizes_only: bool = False,
) -> DataFrame:
    """(``doc_id``, ids ARRAY<INT>) of every row, or (``doc_id``, n_tokens) with ``sizes_only``.

    Ids equal those of the public tokenizer without special tokens; texts are taken unchanged and whole. Empty and null
    texts have an empty list (size 0). Repeated ids keep their rows; other columns are not read.

    The lexicon holds the ``lexicon_words`` most frequent chunks (ties by chunk), a bound on what reaches the driver;
    it decides only how ids are found, never which.
    """
    spark = documents.sparkSession
    with open(vocabulary, "rb") as f:
        ranks_file = f.read()
    work = Stages(spark, "lexicon")
    counts = work.put(count_chunks(documents, text).where("n > 1"), "counts")
    # sizes by powers of two tell from which count on about as many chunks are left as are wanted, so that no partition
    # sends more than its share to the driver
    power = F.floor(F.log2("n")).cast("int")
    enough, least = 0, 1
    for r in sorted(counts.groupBy(power.alias("b")).count().collect(), key=lambda r: -r.b):  # at most 64 rows
        enough, least = enough + r["count"], 2**r.b
        if enough >= lexicon_words:
            break
    common = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "chunk").limit(lexicon_words)
    merge = vocabulary_encoder(ranks_file)
    words = [" " + r.chunk for r in common.collect()]
    work.drop(counts)
    lexicon = Transducer.build({w.encode(): merge(w) for w in words})
    # one file in the shared folder, which Spark hands to every executor that asks for it, also to one started later
    table = work.put_bytes(lexicon.to_bytes(), f"lexicon-{uuid.uuid4().hex}.bin")
    spark.sparkContext.addFile(table)
    sent = spark.sparkContext.broadcast((os.path.basename(table), ranks_file))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = sent.value
        enc = ChunkEncoder(Transducer.map(SparkFiles.get(name)), vocabulary_encoder(file))
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                found = enc.encode(part.column(1).to_pylist())
                n = np.fromiter(map(len, found), np.int64, len(found)) // 4
                if sizes_only:
                    out = pa.array(n)
                else:
                    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    out = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), out], ["id", "out"])

    kind = documents.schema[doc_id].dataType.simpleString()
    ids = documents.select(doc_id, text).mapInArrow(encode, f"id {kind}, out {'long' if sizes_only else 'array<int>'}")
    return ids.select(F.col("id").alias(doc_id), F.col("out").alias("n_tokens" if sizes_only else "ids"))
