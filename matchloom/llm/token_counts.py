"""Exact token counts of texts of any length by overlap resynchronisation.

A huge text is encoded in overlapping chunks. A byte-level BPE splits a text into pieces by a regular expression that
scans left to right and has no memory beyond its position; merges never cross pieces. So if the scan of the left chunk
and that of the right chunk both have a piece boundary at position p, all pieces of the whole text before p are those
of the left chunk and all after it those of the right chunk. p must lie so far from the left chunk's end that neither
a special string nor a look-ahead can reach beyond it. Where no common boundary exists the overlap is doubled, and
from where it reaches the last proven boundary the chunk too, in the end up to one piece that is encoded whole.

Defined results: a null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated rows and ties give
equal rows; other columns are ignored; an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters near a chunk's end in which no splice is taken; longer than any special string of the vocabularies.
GUARD = 64


def load_tokenizer(path: str):
    """The tokenizer of a .json (tokenizers) or .model (sentencepiece) file, as a function of a list of texts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return model, lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return model, lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def _boundaries(model, text: str, base: int) -> tuple[dict[int, int], int]:
    """Piece starts (position in the whole text -> tokens of this chunk before it), and the chunk's token count."""
    encoding = model.encode(text, add_special_tokens=False)
    starts, before = {}, None
    for k, (word, (start, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word != before:
            starts[base + start] = k
            before = word
    return starts, len(encoding.ids)


def spliced_count(model, text: str, chunk: int, overlap: int) -> int:
    """Tokens of text, from chunks of about so many characters that overlap at least by so many."""
    n, total, end = len(text), 0, min(len(text), chunk)
    proven = 0  # a piece of the whole text begins here; tokens before it are counted
    starts, count = _boundaries(model, text[:end], 0)
    since = 0  # tokens of the left chunk before proven
    while end < n:
        right, width = min(n, end + chunk), overlap
        while True:
            left = max(proven, end - width)
            if left == proven:  # nothing to splice at: chunks from here on double, so that all of them cost as much as the last
                right = min(n, max(right, left + 2 * (end - left)))
            next_starts, next_count = _boundaries(model, text[left:right], left)
            # A chunk that begins where a piece is proven to begin needs no alignment.
            both = [proven] if left == proven else [p for p in next_starts if left < p <= end - GUARD and p in starts]
            if both:
                break
            width *= 2
        found = max(both)
        total += starts.get(found, since) - since
        starts, count, since, proven, end = next_starts, next_count, next_starts[found], found, right
    return total + count - since


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int = 1024, chunk: int = 65536, overlap: int = 2048, batch_chars: int = 1 << 20
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text).

    tokenizer is the path of a vocabulary file that the executors have. Texts of up to chunk characters are encoded
    whole, longer ones are spliced; a batch handed to the library has about batch_chars characters at most.
    sentencepiece models have no such boundaries, so their texts are always encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = load_tokenizer(tokenizer)
        whole = tokenizer.endswith(".model")
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            tokens, some, chars = [0] * len(texts), [], 0

            def flush() -> None:
                for k, x in zip(some, counts([texts[k] for k in some]), strict=True):
                    tokens[k] = x
                some.clear()

            for k, text in enumerate(texts):
                if len(text) > chunk and not whole:
                    tokens[k] = spliced_count(model, text, chunk, overlap)
                elif text:
                    some.append(k)
                    chars += len(text)
                    if chars >= batch_chars:
                        flush()
                        chars = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
