"""Token counts without token ids: pieces are counted once per distinct pre-token and summed by frequency."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, slices, stored
from .units import unit_sums, vocabulary

#: Unicode White_Space, as the tokenizers' \s takes it. Fixed values.
SPACE = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_ODD = re.compile(f"[{SPACE.replace(chr(10), '').replace(' ', '')}]|[ \n][ \n]")
_LED = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
RAW = b"\0"


def pre_tokens(text: str) -> list[bytes]:
    """The text cut before every run of white space: no token crosses such a cut.

    A pre-token led by one space is given without it; b"\\0" marks one that is given in full.
    """
    if not text:
        return []
    if _ODD.search(text):
        return [RAW + x.encode() for x in _LED.findall(text)]
    first, *rest = text.encode().replace(b"\n", b" \n").split(b" ")
    if b"\0" in text.encode():
        rest = [RAW + (x if x[:1] == b"\n" else b" " + x) if RAW in x else x for x in rest]
    if first:
        rest.append(RAW + first)
    return rest


def spelled(unit: bytes) -> str:
    """The characters a pre-token stands for."""
    if unit[:1] == RAW:
        return unit[1:].decode()
    return unit.decode() if unit[:1] == b"\n" else " " + unit.decode()


def whole(text: str) -> list[bytes]:
    """The text as its only unit, for tokenizers whose pieces may cross spaces."""
    return [RAW + text.encode()] if text else []


@functools.lru_cache(maxsize=2)
def _sizes(path: str):
    """list of texts -> list of token counts, by the library for the file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda batch: [len(x) for x in model.encode(batch, num_threads=1)]
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return lambda batch: [len(x) for x in own.encode_batch_fast(batch, add_special_tokens=False)]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row per input row.

    tokenizer: a file of `tokenizers` (.json, whose pre-tokenizer must not join text across white space, as byte-level
    and word-end BPE don't) or `sentencepiece` (.model, whole texts as units), present on every machine. Special
    strings inside a text count as the library takes them by default. Null or empty text: 0 bytes, 0 tokens. Null
    doc_id: kept. Repeated rows: each gets its row. Empty table: no rows. Other columns are ignored.
    """
    split = whole if tokenizer.endswith(".model") else pre_tokens
    own = documents(docs)
    words = vocabulary(own.withColumn("train", F.lit(True)), split)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _sizes(tokenizer)
        for batch in slices(batches, "unit"):
            units = batch.column("unit")
            yield pa.RecordBatch.from_arrays([units, batch.column("n"), pa.array(sizes([spelled(u) for u in units.to_pylist()]), pa.int32())], names=["unit", "n", "pieces"])

    pieces = stored(words.select("unit", "n").mapInArrow(count, "unit binary, n long, pieces int"))
    total = F.round("pieces").cast("long")
    return unit_sums(own, split, pieces, ["pieces"]).select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
