"""Words of many texts at a time in Arrow arrays, and what was worked out for each distinct one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut into words at a time, and bytes of a table at most. Results don't depend on them.
TEXT_BYTES = 6 << 20
TABLE_BYTES = 96 << 20


def by_size(batch: pa.RecordBatch, column: int, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many bytes in a column of strings; a longer string is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.columns[column]), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, "right")))
        yield batch.slice(at, to - at)
        at = to


class Found:
    """The values of the words of some texts, text after text: where each text's words end, and one binary array for each part of a value."""

    def __init__(self, ends: np.ndarray, parts: list[pa.Array]):
        self.ends, self.parts = ends, parts
        self.known = ~self._any(parts[0].is_null().to_numpy(zero_copy_only=False))

    def _any(self, of_words: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(of_words))[self.ends]) > 0

    def any_empty(self) -> np.ndarray:
        """Whether a word of the text has an empty value."""
        return self._any(np.diff(self._offsets(0)) == 0)

    def _offsets(self, part: int) -> np.ndarray:
        array = self.parts[part]
        return np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, 4 * array.offset)

    def joined(self, part: int = 0) -> list[memoryview]:
        """For each text, the values of its words one after the other."""
        data = memoryview(self.parts[part].buffers()[2] or b"")
        at = self._offsets(part)[self.ends].tolist()
        return [data[a:b] for a, b in zip(at, at[1:])]


def binary_array(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary())


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(hash, words), np.int64, len(words))


class WordTable:
    """Values of distinct words: `plain` works out those of a list of words, as `parts` binary arrays; null is a value too.

    Texts are cut at single spaces and before line feeds; a word that starts a line keeps the line feed in front, and the first of a text
    gets `head` in front. A word that `tail_of` says ends in so many characters of a tail, which are no letters or digits, has the value of
    the word without it, followed by that of the tail by `tails`; but a value whose first part is empty stays as it is. Once there are
    `most` words, the `keep` that came most often stay.
    """

    def __init__(self, plain: Callable[[list[str]], list[pa.Array]], tails: Callable[[list[str]], list[pa.Array]], tail_of: Callable[[str], int],
                 most: int, keep: int, parts: int = 1, head: str = ""):
        self.plain, self.tails, self.tail_of = plain, tails, tail_of
        self.most, self.keep, self.head = most, keep, head
        # the first has no value, and stands for words whose hash is that of another
        self.words = pa.array([None], pa.string())
        self.values = [binary_array([None]) for _ in range(parts)]
        # rising hashes, and the words' places
        self.hashes, self.order = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.came = np.full(1, np.iinfo(np.int32).max, np.int32)

    def at(self, places: np.ndarray) -> list[pa.Array]:
        return [v.take(pa.array(places)) for v in self.values]

    def _append(self, words: list[str], values: list[pa.Array]) -> np.ndarray:
        start = len(self.words)
        self.words = pa.concat_arrays([self.words, pa.array(words, pa.string())])
        self.values = [pa.concat_arrays(x) for x in zip(self.values, values)]
        self.came = np.append(self.came, np.zeros(len(words), np.int32))
        hashes = _hashes(words)
        rising = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[rising])
        self.hashes, self.order = np.insert(self.hashes, at, hashes[rising]), np.insert(self.order, at, start + rising)
        return np.arange(start, start + len(words))

    def _forget(self) -> None:
        kept = np.sort(np.argsort(-self.came, kind="stable")[:self.keep + 1])
        self.words, self.values, self.came = self.words.take(pa.array(kept)), self.at(kept), self.came[kept] // 2
        self.came[0] = np.iinfo(np.int32).max
        place = np.full(1 + self.order.max(), -1)
        place[kept] = np.arange(len(kept))
        of_kept = place[self.order] >= 0
        self.hashes, self.order = self.hashes[of_kept], place[self.order[of_kept]]

    def places(self, words: list[str]) -> np.ndarray:
        """The places of these distinct words in the table, which has them all then."""
        hashes = _hashes(words)
        rising = np.argsort(hashes)  # sought in their order, near each other
        at = np.minimum(np.searchsorted(self.hashes, hashes[rising]), len(self.hashes) - 1)
        place = np.empty(len(words), np.int64)
        place[rising] = np.where(self.hashes[at] == hashes[rising], self.order[at], -1)
        held = np.flatnonzero(place >= 0)
        same = pc.equal(self.words.take(pa.array(place[held])), pa.array(words, pa.string()).take(pa.array(held)))
        place[held[~same.fill_null(False).to_numpy(zero_copy_only=False)]] = 0
        missing = np.flatnonzero(place < 0)
        new = [words[i] for i in missing.tolist()]
        sizes = [0 if w[-1:].isalnum() else self.tail_of(w) for w in new]
        whole = np.array(sizes, np.int64) == 0
        if whole.any():
            own = [w for w, n in zip(new, sizes) if not n]
            place[missing[whole]] = self._append(own, self.plain(own))
        if not whole.all():
            ended = [(w, w[:-n], w[-n:]) for w, n in zip(new, sizes) if n]
            bodies, tails = (list(dict.fromkeys(x[i] for x in ended)) for i in (1, 2))
            of_body, of_tail = dict(zip(bodies, self.places(bodies).tolist())), {t: i for i, t in enumerate(tails)}
            first = self.at(np.array([of_body[x] for _, x, _ in ended]))
            second = [x.take(pa.array([of_tail[t] for _, _, t in ended])) for x in self.tails(tails)]
            empty = pc.equal(pc.binary_length(first[0]), 0)
            values = [pc.if_else(empty, x, pc.binary_join_element_wise(x, y, b"")) for x, y in zip(first, second)]
            place[missing[~whole]] = self._append([w for w, _, _ in ended], values)
        return place

    def find(self, texts: pa.Array) -> Found:
        """The values of the words of these texts, none of which may be null."""
        cut = pc.replace_substring(texts, "\n", " \n")
        cut = pc.split_pattern(pc.binary_join_element_wise(self.head, cut, "") if self.head else cut, " ")
        if len(self.words) > self.most or sum(x.nbytes for x in (self.words, *self.values)) > TABLE_BYTES:
            self._forget()
        coded = cut.values.dictionary_encode()
        place = self.places(coded.dictionary.to_pylist())
        self.came[place[place > 0]] += 1
        return Found(cut.offsets.to_numpy(), self.at(place[coded.indices.to_numpy()].astype(np.int32)))
