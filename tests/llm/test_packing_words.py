"""Ids of single words, whatever composition and lower-casing make of them."""

import random
import sys

import numpy as np

from marquee.llm.packing import WordIds, folded_words
from marquee.llm.queries import WORD_TOKENIZER

LETTERS = "abzİIıßéǅΣςσ" + "যড়ঢ়য়কখ" + "क़ख़ज़फ़कब" + "שׁשּׂ" + "ｱガ한글日ﬁ" + "̸়़́̇" + "½Ⅷ²3" + "'"
MARKS = ",.;:!?%$#*&<>()-_'\"|"


def check(words, texts):
    for text in texts:
        raw = folded_words(text.encode())
        words.learn(set(raw))
        got = b"".join(words[w] for w in raw)
        assert got == b"".join(words.encode([w]) for w in raw)
        assert np.frombuffer(got, words.dtype).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_letters_that_end_in_a_combining_mark():
    check(WordIds(WORD_TOKENIZER), ["ANKARA İ, क़ क़, sonra", "য়. য়, ড়%%% ফ়", "क़, ख़. ज़!", "שׁ, שּׂ.", "ΟΔΟΣ, ΟΔΟΣ", "it's, 's. 'still don't' abc123,%%", "≠, ≮."])


def test_random_words():
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice(LETTERS) for _ in range(rng.randrange(0, 5))) + "".join(rng.choice(MARKS) for _ in range(rng.randrange(0, 3)))
                      for _ in range(12)) for _ in range(3000)]
    check(WordIds(WORD_TOKENIZER), texts)


def test_every_letter_before_a_mark():
    words = WordIds(WORD_TOKENIZER)
    letters = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and chr(c).isalpha() and not 0x3400 <= c < 0xA000
               and not 0xAC00 <= c < 0xD7A4 and not 0x17000 <= c < 0x19000 and c < 0x20000]
    for lo in range(0, len(letters), 200):
        text = " ".join(f"a{x}, {x}." for x in letters[lo:lo + 200])
        check(words, [text])


def test_new_words_are_found_without_going_through_the_kept_ones():
    class Kept(WordIds):
        def __iter__(self):
            raise AssertionError("all kept words were read")

    words = Kept(WORD_TOKENIZER)
    for text in ("many words, kept before", "many new words, again"):
        raw = folded_words(text.encode())
        words.learn(set(raw))
        assert b"".join(words[w] for w in raw) == words.encode(raw)
