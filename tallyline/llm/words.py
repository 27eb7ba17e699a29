"""Words and word shingles as 64-bit hashes, computed on arrays.

A word is a run of letters, marks, digits and underscores of the lower-cased text, by the Unicode class
of the characters; in scripts without spaces each letter with its marks is a word. The work is done on
pieces of about a megabyte, whatever the text's length.
"""

import re
import unicodedata

import numpy as np

PIECE = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")] = True
WORD_BYTE[128:] = True
VALUES = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
VALUES[~WORD_BYTE] = 0
_powers = {}


#: Invisible characters inside words, and ranges of the scripts without spaces.
JOINERS = {0xAD, 0x200C, 0x200D, 0x2060}
SPACELESS = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3021, 0x3029),
    (0x3031, 0x3035), (0x3038, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA9E0, 0xA9FF),
    (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16F00, 0x18D8F), (0x1AFF0, 0x1B16F),
)


def _set_of(points):
    """The inside of a regular expression's set of characters."""
    runs = []
    for p in points:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def _patterns():
    """Patterns of separators, of letters that are words, and of either; for texts up to U+FFFF and for all."""
    out = []
    spaceless = {p for a, b in SPACELESS for p in range(a, b + 1) if unicodedata.category(chr(p)) in ("Lo", "Lm", "Nl")}
    kinds = {p: unicodedata.category(chr(p)) for p in range(0x80, 0x20000)}
    for end in (0x10000, 0x20000):
        known = [p for p in kinds if p < end]
        breaks = _set_of(p for p in known if p not in JOINERS and (kinds[p][0] in "ZPS" or kinds[p] in ("Cc", "Cf", "Me") or 0xFE00 <= p <= 0xFE0F))
        alone = _set_of(sorted(p for p in spaceless if p < end)) + ("\\U00020000-\\U0003ffff" if end > 0x10000 else "")
        marks = _set_of(p for p in known if kinds[p] in ("Mn", "Mc") and not 0xFE00 <= p <= 0xFE0F)
        out.append((re.compile(f"[{breaks}]+"), re.compile(f"([{alone}][{marks}]*)"), re.compile(f"[{breaks}{alone}]")))
    return out


NEAR, ALL = _patterns()
BEYOND = re.compile("[\U00010000-\U0010ffff]")


def separated(text):
    """A text with spaces for the separators outside ASCII, and around the words of scripts without spaces."""
    if text.isascii():
        return text
    breaks, alone, odd = ALL if BEYOND.search(text) else NEAR
    if not odd.search(text):
        return text
    return alone.sub(r" \1 ", breaks.sub(" ", text))


def distinct(x):
    """The different values of an array, sorted."""
    ordered = np.sort(x)
    return ordered[np.concatenate((np.ones(min(1, len(x)), bool), ordered[1:] != ordered[:-1]))]


def mixed(x):
    """Hashes with all bits stirred."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power_tables(size):
    """Powers of the multiplier and of its inverse modulo 2**64."""
    if _powers.get("size", 0) < size:
        size = max(size, 2 * PIECE)
        inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
        made = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, m)))) for m in (MULTIPLIER, inverse)]
        if size > 2 * PIECE:
            return made
        _powers.update(size=size, tables=made)
    return _powers["tables"]


def _piece_words(data, cut):
    """First bytes of the words in an array of bytes, and the hashes of the words and of their first `cut` bytes."""
    inside = WORD_BYTE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = np.concatenate(([0] * bool(inside[0]), edges, [len(data)] * bool(inside[-1]))).astype(np.int64)
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64), np.empty(0, np.uint64)
    powers, inverse = _power_tables(len(data))
    terms = VALUES[data] * powers[:len(data)]
    unit = inverse[starts]
    words = mixed(np.add.reduceat(terms, starts) * unit)
    if not cut:
        return starts, words, words
    spans = np.stack((starts, np.minimum(starts + cut, ends)), axis=1).ravel()
    return starts, words, mixed(np.add.reduceat(np.append(terms, np.uint64(0)), spans)[::2] * unit)


def _pieces(texts):
    """Bytes of a megabyte or so, cut where no word is, each with (text, first byte) of its texts."""
    held, marks, size = [], [], 0
    for i, text in enumerate(texts):
        data = separated((text or "").lower()).encode("utf-8", "replace") + b"\n"
        at = 0
        while at < len(data):
            end = len(data)
            if end - at > PIECE:
                end = at + PIECE
                while end < len(data) and WORD_BYTE[data[end]]:
                    end += 1
            marks.append((i, size))
            held.append(data[at:end])
            size += end - at
            at = end
            if size >= PIECE:
                yield np.frombuffer(b"".join(held), np.uint8), marks
                held, marks, size = [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), marks


def words_of(texts, cut=None):
    """(hashes of its words, hashes of their first `cut` bytes) for every text in order."""
    open_text, parts = None, []

    def joined():
        return tuple(part[0] if len(part) == 1 else np.concatenate(part) for part in zip(*parts))

    for data, marks in _pieces(texts):
        starts, words, stems = _piece_words(data, cut)
        bounds = np.searchsorted(starts, [at for _, at in marks] + [len(data)])
        for (i, _), a, b in zip(marks, bounds, bounds[1:]):
            if i != open_text and open_text is not None:
                yield joined()
                parts = []
            open_text = i
            parts.append((words[a:b], stems[a:b]))
    if open_text is not None:
        yield joined()


def shingles(words, size):
    """Hashes of all runs of `size` words; of fewer words, one of all; of none, none."""
    if len(words) == 0:
        return words
    count = max(len(words) - size + 1, 1)
    total = np.zeros(count, np.uint64)
    for k in range(min(size, len(words))):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[k:k + count]
    return mixed(total)
