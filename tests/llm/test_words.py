"""Words of mixed scripts against a loop over characters."""

import random
import re
import unicodedata

import numpy as np

from tallyline.llm import near_dedup, toxicity
from tallyline.llm.words import words_of

SPACELESS = ("CJK", "HIRAGANA", "KATAKANA", "THAI", "LAO", "KHMER", "MYANMAR")


def plain(text):
    """The words of a text, a character at a time."""
    out, held = [], ""
    for c in text.lower():
        mark = unicodedata.category(c) in ("Mn", "Mc")
        if mark and held == "" and out and out[-1][1]:
            out[-1] = (out[-1][0] + c, True)
        elif not mark and not re.match(r"\w", c):
            out, held = out + [(held, False)] * bool(held), ""
        elif unicodedata.name(c, "").startswith(SPACELESS) and unicodedata.category(c) != "Nd":
            out, held = out + [(held, False)] * bool(held) + [(c, True)], ""
        else:
            held += c
    return [w for w, _ in out] + [held] * bool(held)


def words(text):
    return next(iter(words_of([text])))[0]


def alone(word):
    (found,) = words(word)
    return found


def test_words_of_mixed_scripts():
    parts = [
        "word", "Été", "naïve", "Straße", "слово", "λόγος", "كلمة", "हिन्दी", "한국어", "漢字", "ひらがな", "カタカナ", "ไทยที่", "ລາວ", "ខ្មែរ", "မြန်မာ", "𠀀𠀁", "𝔘𝔫",
        "3", "x_1", "e\u0301t", " ", "\u00a0", "\u3000", "\u2009", "\u2028", "“", "”", "«", "»", "—", "–", "’", "…", "。", "、", "！", "¿", "€", "😀", ", ", "-", "\n", "\u200b",
    ]
    draw = random.Random(15)
    for _ in range(300):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(1, 40)))
        text = re.sub(r"(\W)\u0301", r"\1", text)
        want = plain(text)
        assert words(text).tolist() == [int(alone(w)) for w in want], text
    long = "漢字かな。" * 200_000
    assert len(words(long)) == 800_000


def test_other_spaces_and_quotes_change_no_word():
    text = 'One "quoted" word - and a dash, it\'s (all) the same.'
    other = "One\u00a0“quoted”\u3000word — and\u2009a dash，it’s «all» the same。"
    assert (words(text) == words(other)).all()
    assert (words("a nasty word") == words("a—nasty—word")).all()
    first, second = toxicity.features([text, other])
    assert (first == second).all()


def test_near_copies_without_spaces(spark):
    draw = random.Random(16)
    letters = [draw.choice("春夏秋冬山川草木日月火水金土東西南北") for _ in range(300)]
    copy = letters[:150] + ["犬"] + letters[151:]
    thai = "".join(draw.choice("กขคงจฉชซญ") for _ in range(300))
    rows = [(1, "".join(letters)), (2, "".join(copy)), (3, thai), (4, thai[:99] + "ฮ" + thai[100:]), (5, "".join(sorted(letters)))]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert len(np.unique(words(rows[0][1]))) > 10
