"""Words of texts as bytes: runs of ASCII letters and digits and of all that is not ASCII, A-Z lower-cased.

Many texts are looked up as one stream of words, with a mark after each text.
"""

import numpy as np

PIECE = 1 << 20
MARK = b"|"  # no word: it separates words
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(data):
    """The words of a text's bytes; null has none."""
    return (data or b"").translate(LOWER).split()


def _pieces(texts):
    """Words and marks of texts in order, about PIECE bytes at a time."""
    held, size = [], 0
    for text in texts:
        data, at = (text or b"").translate(LOWER), 0
        while len(data) - at > PIECE:
            end = data.find(b" ", at + PIECE)
            end = len(data) if end < 0 else end
            yield b" ".join([*held, data[at:end]]).split()
            held, size, at = [], 0, end
        held += [data[at:], MARK]
        size += len(data) - at
        if size >= PIECE:
            yield b" ".join(held).split()
            held, size = [], 0
    yield b" ".join(held).split()


class Vocabulary(dict):
    """Numbers of words from 1 on; 0 for others, -1 for marks."""

    def __init__(self, known=()):
        super().__init__((w, i + 1) for i, w in enumerate(known))
        self[MARK] = -1

    def __missing__(self, word):
        return 0

    def __reduce__(self):
        return Vocabulary, ([w for w, _ in sorted(((w, i) for w, i in self.items() if i > 0), key=lambda x: x[1])],)

    def stream(self, texts):
        """The numbers of all words and marks of texts."""
        return np.concatenate([np.fromiter(map(self.__getitem__, piece), np.int32, len(piece)) for piece in _pieces(texts)])


def runs(texts, size=PIECE):
    """Cuts of a list of texts into runs of about `size` bytes, as (first, last)."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or b"")
        if held >= size:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
