"""Encoding with a public tokenizer, one call for each distinct word of a worker.

Holds for tokenizers that ignore the case of ASCII letters, drop white space,
never join what stands on both sides of it, and always cut between an ASCII
letter or digit and a mark of MARKS: there the ids of a text are those of its
parts, one after the other. Marks that could belong to a special token, to a
contraction or to a composed character are not in MARKS. Each encoder tries the
rule on PROBES first; with a tokenizer that fails there it encodes whole texts.
Words of Latin-1 letters alone go straight to the library's model, in lower case
and as the characters that stand for their bytes, if that gives every such letter,
alone and inside words, the ids that the whole tokenizer gives it.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from . import textblocks as tb

MOST_WORDS = 900_000
MARKS = b'.,;:!?()"#$%&*'
SEPARATOR = "\x01"  # stands between words in one call; words that hold it are encoded alone

PROBES = (
    "The Quick  brown\tFOX's don't\n\nstop, (3.14%) e.g. a.b.c!?  \"Yes\"; no: #7 $9 &c *x* ",
    " leading and trailing spaces  ", "caf\u00e9 CAF\u00c9 na\u00efve \u0394\u03b7 \u4e2d\u6587 \U0001f642 z\u0308o", "x=1;y<2>z [a] {b} @c ~d ^e `f` _g_ h-i j/k 1,000.00 ...!!! I'LL we've",
)

SLOT_BITS = 21
LATIN = "".join(c for c in map(chr, range(256)) if c.isalpha())

# 0: white space, 2: ASCII letter or digit, 4: one of MARKS, 1: others
_KINDS = bytes(0 if tb.SPACE[b] else 2 if b < 128 and chr(b).isalnum() else 4 if b in MARKS else 1 for b in range(256))
_workers: dict[int, "WordEncoder"] = {}


def _byte_characters() -> dict:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _byte_characters()


class WordEncoder:
    """Remembers the ids of words by their hashes; forgets all beyond MOST_WORDS words."""

    def __init__(self, tokenizer_json: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        sep = self._ids([SEPARATOR])[0]
        self.sep = sep[0] if len(sep) == 1 else None
        self.vocabulary = 1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.closes = self._closing(json.loads(tokenizer_json))
        self.closes_sep = np.arange(self.vocabulary) == self.sep
        self.model = self._latin_model()
        self._clear()
        self.by_word = True
        for block in tb.blocks(pa.array(PROBES)):
            ids, sizes = self.encode(block)
            self.by_word = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == self._ids(list(PROBES))
        self._clear()

    def size_of_vocabulary(self) -> int:
        """All ids are below this number."""
        return self.vocabulary

    @classmethod
    def shared(cls, tokenizer_json: str) -> "WordEncoder":
        """This process's encoder: a Python worker keeps its words from task to task."""
        key = hash(tokenizer_json)
        if key not in _workers:
            _workers.clear()
            _workers[key] = cls(tokenizer_json)
        return _workers[key]

    def _ids(self, texts):
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_model(self, word: str) -> list[int]:
        word = word.lower()
        return [x.id for x in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES))]

    def _latin_model(self):
        """The library's model, if words of Latin-1 letters have the same ids by it alone."""
        self.model = self.tokenizer.model
        words = [*LATIN, *(a + c + b for c in LATIN for a, b in (("s", "t"), ("Th", "e"), ("\u00e9", "n"), ("", c)))]
        words += [w for text in PROBES for w in text.split() if w.isalpha() and w.isascii()] + [LATIN[i : i + 5] for i in range(len(LATIN))]
        try:
            same = self._ids(words) == [self._of_model(w) for w in words]
        except Exception:  # a model that cannot tell what it has no token for
            same = False
        return self.model if same else None

    def _closing(self, spec) -> np.ndarray | None:
        """Whether an id ends a piece of text; None if the vocabulary does not mark that."""
        suffix = (spec.get("model") or {}).get("end_of_word_suffix")
        if not suffix:
            return None
        closes = np.zeros(self.size_of_vocabulary(), bool)
        closes[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith(suffix)]] = True
        return closes

    def _clear(self):
        """No words: sorted hashes with the words' numbers, and for each number its ids' place in `flat`."""
        self.hashes, self.numbers, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int32), 0
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        # a word of each slot (number + 1; 0: none), by the upper bits of the hashes; of_number: the hashes by number
        self.slots, self.of_number = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << 14, np.uint64)

    def _add(self, hashes, ids, sizes):
        at = self.count
        while at + len(sizes) > len(self.start):
            self.start, self.size, self.of_number = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size, self.of_number))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[at : at + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[at : at + len(sizes)] = sizes
        self.used += len(ids)
        self.count += len(sizes)
        hashes = np.asarray(hashes, np.uint64)
        order = np.argsort(hashes)
        place = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, place, hashes[order])
        self.numbers = np.insert(self.numbers, place, (at + order).astype(np.int32))
        self.of_number[at : at + len(sizes)] = hashes
        slot = (hashes >> tb.U64(64 - SLOT_BITS)).astype(np.int64)
        free = np.flatnonzero(self.slots[slot] == 0)
        self.slots[slot[free]] = at + 1 + free

    def _learn(self, hashes, words):
        """Words of letters alone are one piece each, whose end its last id marks; others get separators between them."""
        if self.model is not None:
            latin = [w.isalpha() and (w.isascii() or max(w) <= "\u00ff") for w in words]
            found = [self._of_model(w) for w, yes in zip(words, latin) if yes]
            if found:
                self._add([h for h, yes in zip(hashes, latin) if yes], np.array([x for ids in found for x in ids], np.int32), np.array([len(ids) for ids in found]))
                hashes, words = ([x for x, yes in zip(xs, latin) if not yes] for xs in (hashes, words))
        letters = [i for i, w in enumerate(words) if w.isalpha()] if self.closes is not None else []
        if letters:
            ids, sizes = self._joined([words[i] for i in letters], " ", self.closes)
            if len(sizes) == len(letters):  # else some word is more than a piece, and all get separators
                self._add([hashes[i] for i in letters], ids, sizes)
                rest = sorted(set(range(len(words))).difference(letters))
                hashes, words = [hashes[i] for i in rest], [words[i] for i in rest]
        alone = [i for i, w in enumerate(words) if self.sep is None or SEPARATOR in w]
        if alone:
            for i, ids in zip(alone, self._ids([words[i] for i in alone])):
                self._add([hashes[i]], np.array(ids, np.int32), np.array([len(ids)]))
            rest = sorted(set(range(len(words))).difference(alone))
            hashes, words = [hashes[i] for i in rest], [words[i] for i in rest]
        if words:
            ids, sizes = self._joined(words, f" {SEPARATOR} ", self.closes_sep)
            if len(sizes) == len(words):
                self._add(hashes, ids[ids != self.sep], sizes - 1)
            else:  # the separator does not stay whole in this tokenizer
                found = self._ids(words)
                self._add(hashes, np.array(sum(found, []), np.int32), np.array([len(x) for x in found]))

    def _joined(self, words, between, closes, step=500):
        """(ids of texts of `step` words, number up to each closing id)."""
        texts = [between.join([*words[i : i + step], ""]) for i in range(0, len(words), step)]
        ids = np.concatenate([np.array(x, np.int32) for x in self._ids(texts)])
        return ids, np.diff(np.concatenate(([-1], np.flatnonzero(closes[ids]))))

    def _words(self, block: tb.Block):
        """(index into start and size for each word, first)."""
        buf, raw = block.buf, block.buf.tobytes()
        kind = np.frombuffer(b"\0" + raw.translate(_KINDS), np.uint8)  # the last is that of a line feed
        inner = (kind[1:] | kind[:-1]) == 6
        starts = np.flatnonzero(((kind[:-1] == 0) | inner) & (kind[1:] != 0))
        ends = np.flatnonzero(((kind[1:] == 0) | inner) & (kind[:-1] != 0))
        h = tb.span_hash(tb.prefix_sums(buf, tb.LOWER), starts, ends)
        angle = np.flatnonzero(buf == 60)
        if len(angle):  # a special token is told by its case
            of = np.searchsorted(starts, angle, side="right") - 1
            h[of] = tb.span_hash(tb.prefix_sums(buf, tb.PLAIN), starts[of], ends[of]) ^ tb.U64(0x3C3C)
        word = self.slots[(h >> tb.U64(64 - SLOT_BITS)).astype(np.int64)] - 1
        other = np.flatnonzero((self.of_number[word] != h) | (word < 0))  # new words and those whose slot another one has
        if len(other):
            distinct, at, back = np.unique(h[other], return_index=True, return_inverse=True)
            place = np.searchsorted(self.hashes, distinct)
            new = np.flatnonzero(np.append(self.hashes, distinct[-1:] + tb.U64(1))[place] != distinct)
            if self.count + len(new) > MOST_WORDS and self.count:
                self._clear()
                return self._words(block)
            if len(new):
                at = other[at[new]]
                self._learn(distinct[new].tolist(), [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())])
                place = np.searchsorted(self.hashes, distinct)
            word[other] = self.numbers[place][back]
        return word, np.searchsorted(starts, block.off)

    def counts(self, block: tb.Block) -> np.ndarray:
        """The number of ids of each document."""
        if not self.by_word:
            return self.encode(block)[1]
        word, first = self._words(block)
        return tb.segment_sums(self.size[word].astype(np.int64), first)

    def encode(self, block: tb.Block):
        """(ids of all documents, number of each)."""
        if not self.by_word:
            raw = block.buf.tobytes()
            found = self._ids([raw[a : b - 1].decode() for a, b in zip(block.off[:-1].tolist(), block.off[1:].tolist())])
            return np.array(sum(found, []), np.int32), np.array([len(x) for x in found], np.int64)
        word, first = self._words(block)
        size = self.size[word].astype(np.int64)
        return self.flat[tb.ranges(self.start[word].astype(np.int64), size)], tb.segment_sums(size, first)


def read_tokenizer(path: str) -> str:
    """The tokenizer's JSON, which goes to the executors as a broadcast of fixed size."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
