"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from kairospark.llm.columns import slices, strings

#: Between two characters that aren't white space, a byte-level BPE pre-tokenizer always starts anew at a single space.
_SAFE = re.compile(r"(?<=[^\s<>|]) (?=[^\s<>|])")
_LOADED: dict[str, object] = {}


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Lengths of texts by the library that the file is for: `.json` tokenizers, `.model` sentencepiece. Loaded once in each worker; one thread, as each task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            _LOADED[path] = loaded = Tokenizer.from_file(path)
            loaded.no_truncation()
            loaded.no_padding()
    own = _LOADED[path]
    if path.endswith(".model"):
        return lambda texts: [len(x) for x in own.encode(texts, num_threads=1)]
    return lambda texts: [len(x) for x in own.encode_batch_fast(texts, add_special_tokens=False)]


def pieces(text: str, most: int) -> list[str]:
    """The text in parts of about `most` characters whose token counts add up to its own; cut only before a single space between two other characters, none of them a mark of a special string. Without such a place it stays whole."""
    out, start = [], 0
    while len(text) - start > most and (cut := _SAFE.search(text, start + most)):
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def token_counts(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, batch_bytes: int = 1 << 20, piece_chars: int = 1 << 16, splits: bool = True) -> DataFrame:
    """Per row of docs: its id, n_bytes (UTF-8), n_tokens (no special tokens added, special strings inside texts as the library's default has them) and over_limit (n_tokens > limit).

    Batches hold about `batch_bytes` of text, so neither many short nor a few long texts upset a worker; a text above `piece_chars` is encoded in parts cut at safe boundaries (byte-level BPE only: `splits=False` for other kinds).
    Null text: as empty, 0 tokens. Null id: kept as null. Repeated rows: one result each. Empty table: no rows. Other columns aren't read. One narrow pass, no shuffle.
    """
    split = splits and tokenizer.endswith(".json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = counter(tokenizer)
        for batch in slices(batches, "text", batch_bytes):
            column = batch.column("text").fill_null("")
            parts = [pieces(x, piece_chars) if split else [x] for x in strings(column)]
            flat = [x for p in parts for x in p]
            rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            tokens = np.bincount(rows, np.array(lengths(flat), np.int64), len(parts)).astype(np.int64)
            yield pa.record_batch([batch.column("id"), pc.cast(pc.binary_length(column), pa.int64()), pa.array(tokens), pa.array(tokens > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
