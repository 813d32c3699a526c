"""Token ids of many texts at once: what a tokenizer does to a piece of text is done once for each distinct piece.

Texts are cut at single spaces between other characters. No match of a byte-level tokenizer's pattern goes across such a cut
except for the space itself, which always begins the match behind it. So a stretch between two cuts, with its space, has the
same matches alone as in its text. Arrow cuts the texts and numbers their distinct stretches; only these are split, by the
pattern unless they are a word with punctuation behind it, and only distinct words that aren't known yet are learned. Texts
with other white space at a cut are split whole.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A word of letters with what stands behind it in ASCII: the pattern's matches are the word and the tail.
WORD_AND_TAIL = r"^(?P<word> ?\pL+)(?P<tail>[!-/:-@\[-`{-~]*)$"
#: Strings whose ids a process keeps; when full, those met later are learned anew for each batch.
KNOWN = 250_000


def parts(batch: pa.RecordBatch, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about so many bytes of text (the last column), one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begun = 0
    while begun < batch.num_rows:
        before = ends[begun - 1] if begun else 0
        stop = max(begun + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(begun, stop - begun)
        begun = stop


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[begin:begin + size] of each of `which`, one after the other, and the size of each."""
    sizes = size[which]
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((begin[which] - (ends - sizes)).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return flat[at], sizes


def _begins(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size, dtype=np.int64) - size


class TextIds:
    """learn(words) gives the ids of matches of the pattern one after the other, and how many each has. Texts that hold one of
    `controls` go to whole(text) instead."""

    def __init__(self, pattern: str, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], controls: tuple[str, ...] = (), whole: Callable[[str], np.ndarray] | None = None, known: int = KNOWN):
        import regex

        self.split, self.learn, self.controls, self.whole, self.most = regex.compile(pattern).findall, learn, controls, whole, known
        self.known: dict[str, int] = {"": 0}
        self.flat, self.size = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _stretches(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct stretches; the number of each text's, one after the other; how many each text has; and which texts are for whole().
        A number of -1 stands for one of those."""
        cut = pc.split_pattern(texts, " ")
        coded = cut.flatten().dictionary_encode()
        names, number, offsets = coded.dictionary, coded.indices.to_numpy().astype(np.int64), cut.offsets.to_numpy()
        first, count = offsets[:-1], np.diff(offsets)
        # a stretch behind a cut begins with its space; what begins a text has none
        begins, code = np.unique(number[first], return_inverse=True)
        unsafe = pc.or_(pc.equal(names, ""), pc.not_equal(pc.utf8_trim_whitespace(names), names)).to_numpy(zero_copy_only=False)
        odd = np.logical_or.reduceat(unsafe[number], first)
        control = np.zeros(len(texts), bool)
        for x in self.controls:
            control |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        strings = [pc.binary_join_element_wise("", names, " "), names.take(pa.array(begins))]
        number[first] = len(names) + code
        if (single := odd | control).any():
            keep = ~np.repeat(single, count)
            keep[first] = True
            at = np.flatnonzero(odd & ~control)
            number[first[at]] = len(names) + len(begins) + np.arange(len(at))
            number[first[control]] = -1
            strings.append(texts.take(pa.array(at)))
            number, count = number[keep], np.where(single, 1, count)
        return pa.concat_arrays(strings), number, count, control

    def _look_up(self, words: pa.Array, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, beginnings and sizes of words: those of the pattern's matches in each. plain: words that are one match."""
        names = words.to_pylist()
        slot = np.fromiter((self.known.get(x, -1) for x in names), np.int64, len(names))
        missing = np.flatnonzero(slot < 0)
        one = missing[plain[missing]].tolist()
        other = [(k, self.split(names[k])) for k in missing[~plain[missing]].tolist()]
        new = [names[k] for k in one]
        place = dict(zip(new, range(len(new)), strict=True))
        for x in set().union(*(x for _, x in other)).difference(self.known, place):
            place[x] = len(new)
            new.append(x)
        flat, size = self.learn(new) if new else (np.empty(0, np.uint32), np.zeros(0, np.int64))
        old = len(self.size)
        flat, size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        slot[one] = old + np.arange(len(one))
        if other:  # words of several matches get an entry of their own
            pieces = np.array([self.known[y] if y in self.known else old + place[y] for _, x in other for y in x], np.int64)
            each = np.array([len(x) for _, x in other])
            own, sizes = gather(flat, _begins(size), size, pieces)
            ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(each))]
            slot[[k for k, _ in other]] = len(size) + np.arange(len(other))
            flat, size = np.concatenate([flat, own]), np.concatenate([size, np.diff(ends)])
        if (room := self.most - len(self.known)) > 0:
            held = [k for k in missing[:room].tolist() if len(names[k]) < 100]
            kept, sizes = gather(flat, _begins(size), size, slot[held])
            self.known.update(zip((names[k] for k in held), range(old, old + len(held)), strict=True))
            self.flat, self.size = np.concatenate([self.flat, kept]), np.concatenate([self.size, sizes])
        return flat, _begins(size)[slot], size[slot]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other (uint32), and how many each has. A null text counts as empty."""
        if not len(texts):
            return np.empty(0, np.uint32), np.zeros(0, np.int64)
        collects = gc.isenabled()
        gc.disable()  # the many small objects hold no cycles, and looking for some takes long
        try:
            return self._ids(texts.fill_null(""))
        finally:
            if collects:
                gc.enable()

    def _ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        strings, number, count, control = self._stretches(texts)
        cut = pc.extract_regex(strings, WORD_AND_TAIL)
        plain = cut.is_valid()
        words = pa.concat_arrays([pc.if_else(plain, cut.field(0), strings), pc.fill_null(cut.field(1), "")]).dictionary_encode()
        code, of = words.indices.to_numpy(), len(strings)
        single = np.zeros(len(words.dictionary), bool)
        single[code[of:]] = True
        single[code[:of][plain.to_numpy(zero_copy_only=False)]] = True
        flat, begin, size = self._look_up(words.dictionary, single)
        # every stretch is its word and its tail
        pair = np.stack([code[:of], code[of:]], axis=1)
        sizes = size[pair].sum(axis=1)
        flat, _ = gather(flat, begin, size, pair.reshape(-1))
        if control.any():
            wholes = [self.whole(x) for x in texts.filter(pa.array(control)).to_pylist()]
            number[number < 0] = len(sizes) + np.arange(len(wholes))
            flat, sizes = np.concatenate([flat, *wholes]), np.append(sizes, [len(x) for x in wholes])
        out, each = gather(flat, _begins(sizes), sizes, number)
        return out, np.add.reduceat(each, _begins(count))
