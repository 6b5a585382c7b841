"""Equal texts of many posts, carried and prepared once for each task instead of once for each post."""
from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import cut_lineage

KNOWN_TEXTS = 1 << 20      # digests that a task remembers; beyond, it forgets them and texts come again under a new id


def _mark_first(batches):
    """Numbers the texts of a task by their 128-bit digest; only the first row of a number keeps its text."""
    known, issued = {}, TaskContext.get().partitionId() << 40
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column("text").dictionary_encode(null_encoding="encode")
        place, seen = np.unique(coded.indices.to_numpy(), return_index=True)
        if len(known) + len(place) > KNOWN_TEXTS:
            known = {}
        ids, fresh = np.empty(len(coded.dictionary), np.int64), np.zeros(batch.num_rows, bool)
        for at, row in zip(place.tolist(), seen.tolist()):
            text = coded.dictionary[at]
            digest = blake2b(text.as_buffer(), digest_size=16).digest() if text.is_valid else None
            number = known.get(digest)
            if number is None:
                known[digest] = number = issued
                issued += 1
                fresh[row] = True
            ids[at] = number
        texts = coded.dictionary.take(pa.array(coded.indices.to_numpy(), mask=~fresh))
        columns = {name: batch.column(name) for name in batch.schema.names}
        columns |= {"text": texts, "text_id": pa.array(ids[coded.indices.to_numpy()]), "is_first": pa.array(fresh)}
        yield pa.RecordBatch.from_pydict(columns)


def texts_once(posts: DataFrame, prepare: Callable[[Column], Column] | None = None) -> DataFrame:
    """The posts (`window_id`, `event_time`, `post_id`, `text`), stored, with `text_id` and `is_first`.

    Rows of one `text_id` have the same text; `text` is on the first of them only. Equal texts of different tasks have
    different ids. `prepare` turns the texts as they came into those that are kept, once for each id.
    """
    rows = posts.select("window_id", "event_time", "post_id", "text")
    types = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    marked = rows.mapInArrow(_mark_first, f"{types}, text_id bigint, is_first boolean")
    if prepare is not None:
        marked = marked.withColumn("text", F.when(F.col("is_first"), prepare(F.col("text"))))
    return cut_lineage(marked)
