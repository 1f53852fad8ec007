"""Per-record work that asks a k-mer set of checked size, which is broadcast.

Work on one record is a function of its row and of ``has(kmer)``; the set's codes are one sorted array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kmerloom.functions.codes import code_names, code_of

#: k-mers up to which the set is broadcast: 8 bytes each.
BROADCAST_LIMIT = 4_000_000
_COMPLEMENT = str.maketrans("ACGT", "TGCA")
Has = Callable[[str], bool]
Work = Callable[[dict[str, Any], Has], tuple]


def canonical_text(kmer: str) -> str:
    return min(kmer, kmer[::-1].translate(_COMPLEMENT))


def answer_records(records: DataFrame, kmers: DataFrame, k: int, key: str, work: Work, schema: str) -> DataFrame:
    """(key, columns of ``schema``): ``work(row, has)`` of each row of ``records``; ``key`` is unique.

    ``kmers`` is a set of BROADCAST_LIMIT k-mers at most. One with other letters than A, C, G and T is never in it.
    """
    columns = T.StructType([records.schema[key], *T.StructType.fromDDL(schema).fields])
    names = columns.names
    table = records.sparkSession.sparkContext.broadcast(np.sort(kmers.select(*code_names(k)).toPandas()["c0"].to_numpy(np.int64)))

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = table.value

        def has(kmer: str) -> bool:
            if kmer.strip("ACGT"):
                return False
            code = code_of(canonical_text(kmer))
            at = int(codes.searchsorted(code))
            return at < len(codes) and int(codes[at]) == code

        for batch in batches:
            yield pd.DataFrame([(row[key], *work(row, has)) for row in batch.to_dict("records")], columns=names)

    return records.mapInPandas(once, columns)
