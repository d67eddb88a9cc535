"""Words and word pairs counted batch by batch, in Arrow and numpy inside the tasks.

Texts come as ``words``, see ``functions.text.spaced_words``. Words get numbers
first, so that pairs are two numbers and counting is sorting numbers; no term is
built as a string for each place where it stands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# what one step holds of texts; a longer text is a step of its own
_PIECE_BYTES = 8 << 20

Found = tuple[np.ndarray, np.ndarray, np.ndarray]
Batches = Iterator[pa.RecordBatch]


def _pieces(batches: Batches) -> Batches:
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch["words"]), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(length, dtype=np.int64) // _PIECE_BYTES
        starts = np.flatnonzero(np.diff(piece, prepend=-1)).tolist()
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(start, end - start)


def _split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of two characters and more, and the row of each."""
    lists = pc.split_pattern(column, " ")
    words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    counted = pc.greater(pc.utf8_length(words), 1)
    return words.filter(counted), rows[counted.to_numpy(zero_copy_only=False)]


def _numbers(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Place of each word among the known ones, or -1."""
    places = pc.index_in(words, value_set=known.cast(words.type))
    return pc.fill_null(places, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _pairs(numbers: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours in one row, both known: the row, and ``first * size + second``."""
    first, second = numbers[:-1], numbers[1:]
    inside = (rows[:-1] == rows[1:]) & (first >= 0) & (second >= 0)
    return rows[:-1][inside], first[inside] * size + second[inside]


def count_words(batches: Batches) -> Batches:
    """``term, df, cf`` of the words of each piece; they add up to those of all texts."""
    for piece in _pieces(batches):
        words, rows = _split(piece["words"])
        coded = words.dictionary_encode()
        numbers, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
        if not size:
            continue
        df = np.bincount(np.unique(rows * size + numbers) % size, minlength=size)
        cf = np.bincount(numbers, minlength=size)
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(df), pa.array(cf)], names=["term", "df", "cf"])


def pair_counter(words: Sequence[str]) -> Callable[[Batches], Batches]:
    """Counts ``pair, df, cf`` of the pairs of given words; a pair is ``first * len(words) + second``."""
    size = len(words)

    def count(batches: Batches) -> Batches:
        known = pa.array(words, pa.string())
        for piece in _pieces(batches):
            found, rows = _split(piece["words"])
            rows, pairs = _pairs(_numbers(found, known), rows, size)
            if not len(pairs):
                continue
            in_row, tf = np.unique(rows * size**2 + pairs, return_counts=True)
            pairs, place = np.unique(in_row % size**2, return_inverse=True)
            df, cf = np.bincount(place), np.bincount(place, weights=tf).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(df), pa.array(cf)], names=["pair", "df", "cf"])

    return count


def term_finder(terms: Sequence[str]) -> Callable[[pa.Array], Found]:
    """Finds given terms: ``row, place of the term, count``, by row and place."""
    parts = [t.split(" ") for t in terms]
    words = sorted({w for p in parts for w in p})
    number = {w: i for i, w in enumerate(words)}
    size = len(words)
    # the last entry answers -1, a word that is in no term
    single = np.full(size + 1, -1, dtype=np.int64)
    pairs = []
    for place, p in enumerate(parts):
        if len(p) == 1:
            single[number[p[0]]] = place
        elif len(p) == 2:
            pairs.append((number[p[0]] * size + number[p[1]], place))
    # the last pair is none, so that every search ends at an entry
    keys, places = np.array([*sorted(pairs), (np.iinfo(np.int64).max, -1)], dtype=np.int64).T
    known, n_terms = pa.array(words, pa.string()), max(len(terms), 1)

    def find(column: pa.Array) -> Found:
        found, rows = _split(column)
        numbers = _numbers(found, known)
        alone = single[numbers]
        pair_rows, pair = _pairs(numbers, rows, size)
        at = np.searchsorted(keys, pair)
        hit = keys[at] == pair
        every = np.concatenate([(rows * n_terms + alone)[alone >= 0], (pair_rows * n_terms + places[at])[hit]])
        in_row, tf = np.unique(every, return_counts=True)
        return in_row // n_terms, in_row % n_terms, tf

    return find


def known_term_counter(terms: Sequence[str]) -> Callable[[Batches], Batches]:
    """From ``key, words``: ``key, term, tf`` of the given terms."""

    def count(batches: Batches) -> Batches:
        find, names = term_finder(terms), pa.array(terms, pa.string())
        for piece in _pieces(batches):
            rows, places, tf = find(piece["words"])
            columns = [piece["key"].take(pa.array(rows)), names.take(pa.array(places)), pa.array(tf.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "term", "tf"])

    return count


def term_scorer(terms: Sequence[str], idf_coef: Sequence[float], idf_idf: Sequence[float]) -> Callable[[Batches], Batches]:
    """From ``key, words``: ``key, dot, sq`` of each row that has a given term."""

    def score(batches: Batches) -> Batches:
        find, one, two = term_finder(terms), np.array(idf_coef, dtype=float), np.array(idf_idf, dtype=float)
        for piece in _pieces(batches):
            rows, places, tf = find(piece["words"])
            damped, n = 1.0 + np.log(tf), piece.num_rows
            dot = np.bincount(rows, damped * one[places], minlength=n)
            sq = np.bincount(rows, damped * damped * two[places], minlength=n)
            has = np.flatnonzero(np.bincount(rows, minlength=n))
            columns = [piece["key"].take(pa.array(has)), pa.array(dot[has]), pa.array(sq[has])]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "dot", "sq"])

    return score


def feature_writer(term_ids: Sequence[int], terms: Sequence[str], idf: Sequence[float]) -> Callable[[Batches], Batches]:
    """From ``label, words``: ``label, features``, the L2-normalised weights as ``index:value …`` by ascending index."""

    def write(batches: Batches) -> Batches:
        find, ids, scale = term_finder(terms), pa.array(term_ids).cast(pa.string()), np.array(idf, dtype=float)
        for piece in _pieces(batches):
            rows, places, tf = find(piece["words"])
            n = piece.num_rows
            weight = (1.0 + np.log(tf)) * scale[places]
            norm = np.sqrt(np.bincount(rows, weight * weight, minlength=n))
            entries = pc.binary_join_element_wise(ids.take(pa.array(places)), pa.array(weight / norm[rows]).cast(pa.string()), ":")
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
            features = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), entries), " ")
            yield pa.RecordBatch.from_arrays([piece["label"], features], names=["label", "features"])

    return write
