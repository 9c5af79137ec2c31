"""Token counts of whole texts (method: rank-synchronous merging, see ``bpe``).

One narrow pass: no shuffle, bounded slices of each Arrow batch. Defined results: null
and empty texts have 0 tokens; a null id stays null; repeated rows are counted each;
a very long text is counted whole, in blocks of 2 MB; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_path, encoder
from .common import byte_texts, documents, slices

CONTEXT = 2048


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = CONTEXT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. ``vocabulary``: a path that exists on every executor (None: the installed file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary or default_path())
        for batch in batches:
            for part in slices(batch, "text"):
                n = enc.encode(byte_texts(part), only_count=True)[1]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64()), pa.array(np.asarray(n) > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = documents(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
