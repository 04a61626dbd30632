"""Which of very many terms stand in which texts.

Method: a multi-pattern automaton over the terms, broadcast in blocks of at most ``BLOCK_TERMS`` terms; one pass over the
texts per block, in which each text is read once. Texts are neither shuffled nor cut, and no text is compared to a term
that isn't in it.

Defined results: null texts and null or empty terms match nothing; a term counts once per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_TERMS = 200_000


#: Automata of this worker by block; a worker that takes up further tasks goes on with them.
_built: dict[str, object] = {}


def automaton(block: str, terms: list[str]):
    """Automaton over ``terms`` whose values are their positions, built once per worker and block."""
    if block not in _built:
        import ahocorasick

        _built.clear()
        made = ahocorasick.Automaton()
        for k, term in enumerate(terms):
            made.add_word(term, k)
        made.make_automaton()
        _built[block] = made
    return _built[block]


def terms_in_texts(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(key, term)`` of each text and each distinct term that it holds."""
    spark = texts.sparkSession
    # Keys travel as texts, lest pandas makes numbers of whole numbers with nulls.
    source = texts.filter(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    rows = (r[0] for r in terms.filter(f"`{term}` <> ''").select(term).distinct().toLocalIterator())
    parts = []
    while block := list(islice(rows, block_terms)):
        shared, name = spark.sparkContext.broadcast(block), uuid4().hex

        def find(batches: Iterator[pd.DataFrame], shared=shared, name=name) -> Iterator[pd.DataFrame]:
            words = shared.value
            found_in = automaton(name, words)
            for batch in batches:
                found = [(k, word) for k, t in zip(batch["k"], batch["t"], strict=True) for word in sorted({words[i] for _, i in found_in.iter(t)})]
                yield pd.DataFrame(found, columns=["k", "w"], dtype=object)

        parts.append(source.mapInPandas(find, "k string, w string"))
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "k string, w string")
    return found.select(F.col("k").cast(texts.schema[key].dataType).alias(key), F.col("w").alias(term))
