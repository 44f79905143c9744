"""Matching of large word lists: one pass over each text for all words, by an automaton that every task gets once."""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that an automaton may have, as it is sent to all tasks.
MOST_BYTES = 256 << 20


def spans(docs: DataFrame, words: DataFrame | dict[str, str], first: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, name, s, e: where words (word -> name; a DataFrame has both columns) stand in the lower-cased texts, overlaps too.

    Words are matched as substrings. first: only the first span of each word in a text. Empty words are left out; of a word with
    several names the least counts; a null text has no spans. A word list whose automaton exceeds ``most_bytes`` is an error:
    cut it into several and unite what they find.
    """
    import ahocorasick

    if isinstance(words, DataFrame):
        rows = words.filter("word <> ''").groupBy("word").agg(F.min("name").alias("name")).toLocalIterator()
        words = {r["word"]: r["name"] for r in rows}
    built = ahocorasick.Automaton()
    for word, name in words.items():
        if word:
            built.add_word(word, (len(word), name))
    built.make_automaton()
    data = pickle.dumps(built)
    if len(data) > most_bytes:
        raise ValueError(f"the automaton of {len(words)} words has {len(data)} bytes, over {most_bytes}")
    sent = docs.sparkSession.sparkContext.broadcast(data)
    empty = not len(built)

    def run(batches):
        known = pickle.loads(sent.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at, names, starts, ends = [], [], [], []
            for i, text in enumerate(texts):
                met = set()
                for end, (size, name) in () if empty or not text else known.iter(text):
                    start = end + 1 - size
                    if first:
                        word = text[start : end + 1]
                        if word in met:
                            continue
                        met.add(word)
                    at.append(i)
                    names.append(name)
                    starts.append(start)
                    ends.append(end + 1)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "name", "s", "e"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(run, f"doc_id {kind}, name string, s int, e int")
