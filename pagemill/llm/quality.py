"""Quality classifier: hashed word n-gram logistic regression trained with FTRL, scored as sparse dot products.

Features are hashes of one, two and three neighbouring tokens (words, or runs of signs). An n-gram of equal
tokens is hashed as one token "repeat of n", so a repeated word counts whatever the word is. A feature's value
is the root of its share among the document's features.

Defined cases: a null or empty text scores as the bias; texts of any length are read whole; repeated rows get equal
scores; of labels that disagree the larger counts; a score of just 0.7 is predicted 1; without labels every score is
0.5; an empty table gives no rows; columns other than doc_id and text, whatever their names, are ignored; a null doc_id is
never held out nor learned from.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from pagemill.llm.common import doc_of, mixed
from pagemill.llm.linear import Spec, known_labels, scored, train

HELD_OUT = (4, 2)
_SALTS = [np.uint64(x) for x in (0x2D358DCCAA6C78A5, 0x8BB84B93962EACC9, 0x4B33A62ED433D4A3)]
_REPEAT = [np.uint64(x) for x in (0, 0xD6E8FEB86659FD93, 0xA5A3564E27F8867B)]


def grams(h: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    doc = doc_of(cuts)
    found, owner = [mixed(h ^ _SALTS[0])], [doc]
    key, equal = h, np.ones(len(h), bool)
    for n in (1, 2):
        if len(h) <= n:
            break
        key, equal = key[:-1] * np.uint64(5) + mixed(h[n:] ^ _SALTS[n]), equal[:-1] & (h[n:] == h[:-n])
        same = doc[n:] == doc[:-n]
        found.append(np.where(equal, mixed(_REPEAT[n : n + 1]), mixed(key))[same])
        owner.append(doc[n:][same])
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return found[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(cuts) - 1))]).astype(np.int64)


SPEC = Spec(grams, most_rows=9_000, epochs=4, alpha=0.5, l1=0.3, l2=0.1, shares=True)


def score_quality(documents: DataFrame, labels: DataFrame, spec: Spec = SPEC) -> DataFrame:
    """doc_id, held_out, score (higher: likelier good) and predicted (score >= 0.7) for every document."""
    return scored(documents, train(documents, known_labels(labels, "quality", HELD_OUT), spec), spec, HELD_OUT)
