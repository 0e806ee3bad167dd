"""Top documents of one shard by the Best Position Algorithm.

Every term of a query has a list of the shard's documents in descending order of impact. The lists are read side by side,
some positions at a time. A document that is met for the first time is looked up in all lists of the query: that gives
its whole score, and the positions where it stands count as seen too. The best position of a list is the last one up to
which all have been seen, often far behind the last one read. No unseen document scores more than the impacts at the best
positions together; reading stops when this is strictly below the score of the k-th document.
"""

from __future__ import annotations

import numpy as np

_FIRST_READ = 16


class Shard:
    """Impact lists of some documents, with direct access by (term, document)."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_terms: int, n_docs: int):
        """Postings without repeats; impacts are positive whole numbers. Documents are numbered in the order of ties."""
        direct = np.lexsort((docs, terms))
        self.n_docs = n_docs
        self.keys = terms[direct].astype(np.int64) * n_docs + docs[direct]
        self.impact = impacts[direct]
        listed = np.lexsort((docs[direct], -self.impact, terms[direct]))
        self.listed = listed  # list position to direct place
        self.doc = docs[direct]
        self.position = np.empty(len(listed), np.int64)  # direct place to list position
        self.position[listed] = np.arange(len(listed))
        self.first = np.searchsorted(terms[direct], np.arange(n_terms + 1))
        self._seen = np.zeros(len(listed), bool)
        self._met = np.zeros(n_docs, bool)

    def top(self, terms: np.ndarray, repeats: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the ``k`` best, and of all that tie with the last; only scores of ``least`` or more.

        ``least``: a score that ``k`` documents outside this shard reach already, or 1.
        """
        docs, scores, _ = self.search(terms, repeats, k, least)
        return docs, scores

    def search(self, terms: np.ndarray, repeats: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
        """As ``top``, with the number of documents that were looked up."""
        there = self.first[terms + 1] > self.first[terms]
        terms, repeats = terms[there].astype(np.int64), repeats[there].astype(np.int64)
        start, end = self.first[terms], self.first[terms + 1]
        best = start.copy()  # first position of each list not known to be seen
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        touched, met, read, step = [], [], 0, _FIRST_READ
        while len(terms):
            opened = [self.doc[self.listed[a + read : min(a + read + step, b)]] for a, b in zip(start.tolist(), end.tolist()) if a + read < b]
            read, step = read + step, step * 2
            if not opened:
                break
            fresh = np.unique(np.concatenate(opened))
            fresh = fresh[~self._met[fresh]]
            self._met[fresh] = True
            met.append(fresh)
            if len(fresh):
                found, places = self._access(terms, fresh)
                places = places[found]
                total = np.zeros(found.shape, np.int64)
                total[found] = self.impact[places]
                positions = self.position[places]
                self._seen[positions] = True
                touched.append(positions)
                docs, scores = np.concatenate([docs, fresh]), np.concatenate([scores, repeats @ total])
            for i, (a, b) in enumerate(zip(best.tolist(), end.tolist())):
                best[i] = self._unseen(a, b)
            # Where a list is seen to its end, unseen documents do not stand in it.
            at_best = np.where(best == end, 0, self.impact[self.listed[np.maximum(best - 1, 0)]])
            threshold = int(repeats @ at_best)
            docs, scores, kth = _best(docs, scores, k, least)
            if threshold < kth:
                break
        n_met = sum(map(len, met))
        for positions in touched:
            self._seen[positions] = False
        for fresh in met:
            self._met[fresh] = False
        return docs, scores, n_met

    def _access(self, terms: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Direct access to all lists: whether each document stands in each list, and its place there."""
        wanted = terms[:, None] * self.n_docs + docs[None, :]
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.keys[place] == wanted, place

    def _unseen(self, start: int, end: int) -> int:
        """First position from ``start`` on that has not been seen."""
        width = 64
        while start < end:
            part = self._seen[start : min(start + width, end)]
            at = int(part.argmin())
            if not part[at]:
                return start + at
            start, width = start + len(part), width * 2
        return end


def _best(docs: np.ndarray, scores: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best and their ties among scores of at least ``least``, and the score a further document has to reach."""
    if len(scores) >= k:
        least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
    kept = scores >= least
    return docs[kept], scores[kept], least
