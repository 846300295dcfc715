"""Token ids of public tokenizer files, word by word with a bounded memory.

Both libraries used here cut a text at white space before they merge pieces
(checked from the vocabulary where it matters), so the ids of a text are those
of its words in order. Arrow splits the texts of a slice of bounded size and
numbers their distinct words; only these are looked at one by one. A worker
keeps the result of each word that it has seen, in tables of bounded size, and
asks the library for new words only, in batches balanced by bytes. numpy then
lays out the ids of all words of the slice in one array. Words with their ids
are kept as Arrow and numpy arrays, some 60 bytes each, never as Python objects.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 400_000             # words of a table, or of a generation, that a worker remembers
BATCH_BYTES = 1 << 20       # new text sent to the library at a time
ID_BATCH_BYTES = 1 << 16    # the same where whole encodings come back, many times the size of their words
LONG_WORD = 64              # longer words are not remembered
SLICE_BYTES = 4 << 20       # text whose words are numbered together; a longer text is a slice of its own


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """Runs of whole texts of at most ``limit`` bytes, at least one text each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(texts):
        most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
        n = max(1, most - at)
        yield texts.slice(at, n)
        at += n


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of each word of all texts, words of each text, distinct words), cut at ASCII white space; white
    space at an end, or nothing, gives empty words."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten().dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False), sizes, words.dictionary


def batches(words: list, limit: int = BATCH_BYTES):
    """Cut a list into runs of at most ``limit`` bytes or code points, at least one word each."""
    run, size = [], 0
    for w in words:
        if run and size + len(w) > limit:
            yield run
            run, size = [], 0
        run.append(w)
        size += len(w) + 8
    if run:
        yield run


class _Table(dict):
    """A dict that notes the words it lacks."""

    def __init__(self):
        self.new = set()

    def __missing__(self, word):
        self.new.add(word)


class Remembered:
    """word -> value; ``make`` gives the values of a list of new words. Words
    are kept in two generations of at most ``WORDS``, so rare ones go first."""

    def __init__(self, make):
        self.make, self.young, self.old = make, _Table(), {}

    def of(self, words: list) -> list:
        young = self.young
        out = list(map(young.__getitem__, words))
        if young.new:
            new, young.new = young.new, set()
            fresh = [w for w in new if w not in self.old]
            young.update({w: self.old[w] for w in new if w in self.old})
            for run in batches(fresh):
                young.update(zip(run, self.make(run)))
            out = list(map(young.__getitem__, words))
            for w in fresh:
                if len(w) > LONG_WORD:
                    del young[w]
            if len(young) > WORDS:
                self.old, self.young = young, _Table()
        return out


# Letters that one word of the vocabulary's pattern takes together, and marks
# that it takes together after them; anything else goes to the library whole.
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
MARKS = ".,;:!?"


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Ids:
    """Id sequences laid end to end: sequence k is ``flat[first[k]:first[k] + n[k]]``."""

    def __init__(self, flat: np.ndarray, n: np.ndarray):
        self.flat, self.n, self.first = flat, n, np.cumsum(n) - n

    @classmethod
    def of(cls, parts: list[bytes]) -> "Ids":
        return cls(np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) >> 2)

    @classmethod
    def join(cls, runs: list["Ids"]) -> "Ids":
        return cls(np.concatenate([np.zeros(0, "<u4"), *(r.flat for r in runs)]),
                   np.concatenate([np.zeros(0, np.int64), *(r.n for r in runs)]))

    def take(self, which: np.ndarray) -> "Ids":
        many = self.n[which]
        ends = np.cumsum(many)
        place = np.repeat(self.first[which] - (ends - many), many)
        place += np.arange(len(place))
        return Ids(self.flat[place], many)


class KnownIds:
    """Ids of the words that a worker has seen; ``make`` gives those of a list of
    new words. At most ``WORDS`` are kept, of more the half that was used last."""

    def __init__(self, make):
        self.make, self.words, self.ids = make, pa.array([], pa.large_string()), Ids.of([])
        self.used, self.calls = np.zeros(0, np.int64), 0        # the call that used each word last

    def of(self, words: pa.Array) -> Ids:
        """Ids of distinct words."""
        place = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        lacks = np.flatnonzero(place < 0)
        place[lacks] = len(self.words) + np.arange(len(lacks))
        self.calls += 1
        if not len(lacks):
            self.used[place] = self.calls
            return self.ids.take(place)
        fresh = words.take(pa.array(lacks))
        known = Ids.join([self.ids, *(Ids.of(self.make(run.to_pylist())) for run in slices(fresh, ID_BATCH_BYTES))])
        self.used = np.concatenate([self.used, np.zeros(len(fresh), np.int64)])
        self.used[place] = self.calls
        short = pc.less_equal(pc.binary_length(fresh), LONG_WORD).to_numpy(zero_copy_only=False)
        kept = np.concatenate([np.arange(len(self.words)), len(self.words) + np.flatnonzero(short)])
        if len(kept) > WORDS:
            kept = np.sort(kept[np.argsort(-self.used[kept], kind="stable")[:WORDS // 2]])
        self.words = pa.concat_arrays([self.words, fresh]).take(pa.array(kept))
        self.ids, self.used = known.take(kept), self.used[kept]
        return known.take(place)


class WordIds:
    """Ids by the ``tokenizers`` library for a vocabulary that drops white space.

    A word is sent with a space before it, so that a combining mark at its
    start meets what it meets in the text. Special strings inside a text are
    found by the library in the word that holds them. Plain words (Latin
    letters, then marks) are split into letters in lower case and marks, so
    that all their forms are one word, and the letters go straight to the
    library's merge model, if that gives the same ids for a set of test words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = Tokenizer(self.tokenizer.model)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)    # ids that end a word
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        letters = byte_letters()
        self.letters = {c: "".join(map(letters.get, chr(c).encode())) for c in range(0xC0, 0x100)}
        self.marks, self.words, self.bodies = KnownIds(self._library), KnownIds(self._library), KnownIds(self._merged)
        self.plain = True
        tests = [w + m for w in ("the", "Thhaen", "A", "ÀÖß", "øÿ", "ciónñga", "Größe", "x" * 40) for m in ("", ".", ",!?")]
        self.plain = bool(suffix) and self._distinct(pa.array(tests, pa.large_string())).flat.tobytes() == b"".join(self._library(tests))

    def _library(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([" " + w for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _merged(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters in lower case; the last piece of each word is one that ends words."""
        spelt = [w if w.isascii() else w.translate(self.letters) for w in words]
        ids = np.array(self.merges.encode(spelt, is_pretokenized=True, add_special_tokens=False).ids, "<u4")
        ends = (np.flatnonzero(self.last[ids]) + 1) * 4
        if len(ends) != len(words):
            return self._library(words)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _distinct(self, words: pa.Array) -> Ids:
        """Ids of distinct words."""
        bodies = pc.utf8_rtrim(words, MARKS)
        plain = pc.and_(pc.match_substring_regex(bodies, LETTERS), pc.less_equal(pc.binary_length(words), LONG_WORD))
        plain = plain.to_numpy(zero_copy_only=False) & self.plain
        own, other = np.flatnonzero(plain), np.flatnonzero(~plain)
        body = pc.utf8_lower(bodies.take(pa.array(own))).dictionary_encode()
        marks = pc.replace_substring_regex(words.take(pa.array(own)), f"^[^{MARKS}]+", "").dictionary_encode()
        units = Ids.join([self.bodies.of(body.dictionary), self.marks.of(marks.dictionary),
                          self.words.of(words.take(pa.array(other))), Ids.of([b""])])
        n, m = len(body.dictionary), len(marks.dictionary)
        which = np.full((len(words), 2), len(units.n) - 1)      # a word's letters and its marks
        which[own, 0] = body.indices.to_numpy(zero_copy_only=False)
        which[own, 1] = n + marks.indices.to_numpy(zero_copy_only=False)
        which[other, 0] = n + m + np.arange(len(other))
        both = units.take(which.reshape(-1))
        return Ids(both.flat, both.n.reshape(-1, 2).sum(1))

    def ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of each text), each text closed by ``end_id``."""
        codes, sizes, words = coded_words(texts)
        known = self._distinct(words)
        known = Ids(np.append(known.flat, np.array(end_id, "<u4")), np.append(known.n, 1))
        closed = np.insert(codes.astype(np.int64), np.cumsum(sizes), len(words))
        out = known.take(closed)
        last = np.cumsum(out.n)[np.cumsum(sizes + 1) - 1] if len(sizes) else np.zeros(0, np.int64)
        return out.flat, np.diff(last, prepend=0)


class PieceCounts:
    """Number of pieces by ``sentencepiece``, for a vocabulary whose pieces never cross a word start."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        normal = (self.model.normalize("a  b ") == "▁a▁▁b▁")
        self.by_word = normal and not any("▁" in p.lstrip("▁") for p in pieces)
        self.words = Remembered(lambda ws: list(map(len, self.model.encode(ws, num_threads=1))))

    def count(self, text: str) -> int:
        if not self.by_word:
            return len(self.model.encode(text, num_threads=1))
        if not text:
            return 0
        # The library puts a word mark before the text and reads a space and
        # U+2581 alike. A word is encoded without its first mark, which comes back.
        text = text.replace("▁", " ")
        words = text.split(" ")
        if "" in words:
            words = [w[1:] for w in re.findall(r" *[^ ]+| +\Z", " " + text)]
            tail = re.search(r" +\Z", text)
            if tail:            # marks at the end stand without a word: all of them are encoded
                words.pop()
                return sum(self.words.of(words)) + self._marks(len(tail[0]))
        return sum(self.words.of(words))

    def _marks(self, n: int) -> int:
        """Pieces of a run of ``n`` marks after a word."""
        return len(self.model.encode("a" + " " * n, num_threads=1)) - 1
