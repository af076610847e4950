"""Suffix-array dedup: a logarithmic family of sparse suffix arrays.

Each batch of documents gets an array of the suffixes at its anchors, in the order of their first 16 bytes. It is merge-scanned
with the levels that exist: neighbours with a common prefix of 16 bytes are equal in their whole block (by
digest) or are compared window by window on their bytes; equal-sized levels merge. Every byte covered by a 100-byte string that
starts earlier (in a smaller doc_id, or before in the same document; overlaps count) is removed.  See runs.py.

The arrays are sparse, as one entry for each byte would take eight times the text at least.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import ByteTokens, Windows, remove_repeats

#: 100-byte matches; suffixes are sampled by the smallest hash of 16 bytes in each window.
SPEC = Windows(width=100, gram=16, tokens=ByteTokens, within=True)


def suffix_array_dedup(df: DataFrame, min_bytes: int = 100, batches: int = 3, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """Per document: id_column, n_bytes, n_removed, n_spans, kept_sha256 (and kept, if with_text).

    Null and empty texts give zeros and the hash of nothing. Texts under min_bytes are never cut.
    Repeated ids: rows count as documents in the order (id, text).
    """
    spec = SPEC if min_bytes == SPEC.width else Windows(min_bytes, min(16, max(1, min_bytes // 2)), ByteTokens, True)
    out = remove_repeats(df, spec, batches, id_column, text_column, with_text)
    return out.select(F.col("id").alias(id_column), F.col("n_tokens").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
