"""Substring dedup: a log-structured index of word-window fingerprints.

Sorted immutable runs of historical fingerprints are merge-joined with each new batch, then runs of
equal size are compacted. Blocks whose fingerprint and keyed 128-bit digest of their words came before are repeats; where
only the fingerprint did, the blocks are fetched and their windows verified word by word.
Every word covered by a 13-word window whose words also start in a smaller doc_id is removed.
See runs.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import Windows, WordTokens, remove_repeats

#: 13-word windows; fingerprints are kept where the smallest hash of 5 words of a window lies.
SPEC = Windows(width=13, gram=5, tokens=WordTokens, within=False)


def substring_dedup(df: DataFrame, window: int = 13, batches: int = 3, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """Per document: id_column, n_words, n_removed, n_spans, kept_sha256 (and kept, if with_text).

    Kept words are joined by one space. Null and empty texts have no words. Documents under window
    words are never cut. Repeated ids: rows count as documents in the order (id, text).
    """
    spec = SPEC if window == SPEC.width else Windows(window, max(1, window * 5 // 13), WordTokens, False)
    out = remove_repeats(df, spec, batches, id_column, text_column, with_text)
    return out.select(F.col("id").alias(id_column), F.col("n_tokens").alias("n_words"), "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
