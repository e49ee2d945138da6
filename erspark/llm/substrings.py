"""Substring dedup by difference-cover anchors.

Windows are ``WINDOW`` consecutive words. Hashes are taken only at positions of a difference cover of period ``PERIOD``; any two equal
windows share an anchor at the same offset, from which they are extended (see ``cover``). A word goes if it is covered
by a window whose words also start in a document with a smaller doc_id.

Defined cases: null and empty texts have no words; texts of fewer words than a window keep all; rows with equal doc_id never remove
each other's words; a null doc_id is larger than any other and null ones don't remove each other's words; equal rows have
equal results; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from erspark.llm.cover import Task, without_repeats

WINDOW = 50
PERIOD = 31


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_known = _Hashes()
_CACHE = 1 << 20


def word_numbers(data: bytes) -> np.ndarray:
    words = data.split()
    if len(_known) > _CACHE:
        _known.clear()
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def _finish(data: bytes, spans: np.ndarray) -> tuple[int, int, str]:
    words = data.split()
    if len(spans):
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, spans[:, 0], 1)
        np.add.at(gone, spans[:, 1], -1)
        stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()
        kept = [words[i] for i in stay]
    else:
        kept = words
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


TASK = Task(length=WINDOW, period=PERIOD, tokens=word_numbers)


def dedup_words(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and the SHA-256 of the kept words, joined by one space."""
    return without_repeats(
        docs, TASK, _finish, ["n_words", "n_removed", "kept_sha256"], [pa.int64(), pa.int64(), pa.string()], "n_words long, n_removed long, kept_sha256 string"
    )
