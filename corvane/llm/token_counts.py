"""Token counts by Arrow batches that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import _common

#: Texts are handled in slices of so many bytes, so that a slice's cost doesn't depend on how rows are sized.
SLICE_BYTES = 1 << 20
#: Units of this many at most are remembered by a worker; then it starts anew.
REMEMBERED = 400_000
_CUT = re.compile(r"(?<=[^ ])(?= )")


def _library_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounter:
    """Counts of a sentencepiece model whose pieces hold a space mark only in front.

    For such a model a text may be cut before any space that follows another character: no merge crosses
    that place, and the cut-off space is what the model itself puts in front of a text. Units between cuts
    recur, so their counts are remembered. Models without that property count whole texts.
    """

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.encode = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.encode.id_to_piece(i) for i in range(self.encode.get_piece_size())]
        plain = [self.encode.encode(x, out_type=str) for x in ("a", " a", "a  b")] == [["▁a"], ["▁", "▁a"], ["▁a", "▁", "▁b"]]
        self.safe = plain and not any("▁" in p.lstrip("▁") for p in pieces)
        self.known: dict[str, int] = {}

    def units(self, text: str) -> list[str]:
        units = text.split(" ")
        if "" not in units:
            return units
        first, *rest = _CUT.split(text)
        return [first, *(u[1:] for u in rest)]

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return [len(x) for x in self.encode.encode(texts, num_threads=1)]
        whole = {i: len(self.encode.encode(x, num_threads=1)) for i, x in enumerate(texts) if "▁" in x}  # written-out space marks
        split = [self.units(x) if x and i not in whole else [] for i, x in enumerate(texts)]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = list({u for units in split for u in units if u not in known})
        known.update(zip(new, map(len, self.encode.encode(new, num_threads=1)), strict=True))
        known[""] = 1  # a single space at the end of a text
        return [whole.get(i, 0) + sum(map(known.__getitem__, units)) for i, units in enumerate(split)]


class WholeCounter:
    """Counts of a ``tokenizers`` file; texts go to the library in one batch."""

    def __init__(self, model: str) -> None:
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(model)
        self.encode.no_padding()
        self.encode.no_truncation()

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.encode.encode_batch(texts, add_special_tokens=False)]


def count_tokens(docs: DataFrame, model: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` without ``text``, with ``into``: the number of tokens of each whole text.

    model: a file name among the public tokenizers, .model (sentencepiece) or .json (tokenizers), or a path
    that exists on every executor. Null counts as empty (0 tokens). Repeated rows are kept and counted alike;
    other columns stay; a column named ``into`` is replaced. An empty table gives an empty result.
    """
    docs = docs.drop(into) if into in docs.columns and into != text else docs
    kept = [c for c in docs.columns if c != text]

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = model if "/" in model else _library_path(model)
        counter = (PieceCounter if path.endswith(".model") else WholeCounter)(path)
        for part in _common.in_slices(batches, text, SLICE_BYTES):
            texts = [x or "" for x in part.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(counter(texts), pa.int64())], [*kept, into])

    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).schema.add(into, "long")
    return _common.bounded(docs).mapInArrow(lengths, schema)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return count_tokens(sized, "piece_bpe_32k.model").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
