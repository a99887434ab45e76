"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A feature is a hash of one word, of two neighbours, or of two words with one or two words between them
(a skip-gram); its value is 1 where it occurs. Per-coordinate rates let rare words learn fast and the L1
term leaves few weights, so the model is small enough to broadcast.

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

#: (modulus, remainder) of crc32(doc_id) that is kept from training.
HELD_OUT = (3, 1)
_SALTS = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def grams(h: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and pairs at distances one to three, each document's together."""
    doc, found, owner = doc_of(cuts), [mixed(h ^ _SALTS[0])], [doc_of(cuts)]
    for d in (1, 2, 3):
        same = doc[d:] == doc[:-d] if len(h) > d else np.zeros(0, bool)
        a, b = h[:-d][same] if len(h) > d else h[:0], h[d:][same] if len(h) > d else h[:0]
        found.append(mixed(a * np.uint64(3) + mixed(b ^ _SALTS[d])))
        owner.append(doc[d:][same] if len(h) > d else doc[:0])
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return found[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(cuts) - 1))]).astype(np.int64)


SPEC = Spec(grams, most_rows=9_000, epochs=4, alpha=1.0, l1=12.0, l2=0.1, weights=(2.0, 1.0))


def score_toxicity(documents: DataFrame, labels: DataFrame, spec: Spec = SPEC) -> DataFrame:
    """doc_id, held_out, score (higher: likelier toxic) and predicted (score >= 0.7) for every document."""
    return scored(documents, train(documents, known_labels(labels, "toxic", HELD_OUT), spec), spec, HELD_OUT)
