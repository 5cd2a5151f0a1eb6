"""Token counts of whole texts by a public byte-level BPE vocabulary. Vocabulary files stay where they are."""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=2)
def encoding(path: str = VOCABULARY):
    """The tokenizer of a rank file; the pattern that splits text is the one published beside it."""
    import tiktoken

    file = Path(path)
    spec = importlib.util.spec_from_file_location("vocabulary_files", file.parent / "__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with file.open("rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(file.stem, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counting(path: str, texts_at: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for b in batches:
            texts = b.column(b.schema.get_field_index(texts_at)).to_pylist()
            counts = pa.array([len(encode(t)) if t else 0 for t in texts], pa.int64())
            rest = [(n, b.column(i)) for i, n in enumerate(b.schema.names) if n != texts_at]
            yield pa.RecordBatch.from_arrays([*[c for _, c in rest], counts], names=[*[n for n, _ in rest], "n_tokens"])

    return scan


def token_counts(rows: DataFrame, text: str = "text", keep: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of each row's whole text; null and empty texts have 0 tokens."""
    keep = keep if keep is not None else [c for c in rows.columns if c != text]
    picked = rows.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "_text")
    return picked.mapInArrow(_counting(vocabulary, "_text"), f"{schema}, n_tokens bigint")
