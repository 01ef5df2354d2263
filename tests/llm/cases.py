"""Rows and words that tests of this folder share."""

import re

SPACE = re.compile("[\x20\x09-\x0d]+")
#: id, text, and columns whose names operators use inside
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "a"),
    (2, "The  quick brown\tfox jumps over the lazy dog near the old river bank today", "a"),
    (3, None, None),
    (4, "", "b"),
    (5, "   \n", "b"),
    (6, "one", "c"),
    (7, "THE QUICK brown fox jumps over the lazy dog near the old river bank today", "a"),
    (None, "The quick brown fox jumps over the lazy dog near the old river bank today", "a"),
    (8, "1234 !!! 5678", None),
    (9, "word " * 200_000, "d"),
    (10, "Été naïve ÀÉ 中文 <|endoftext|> \U0001f600 don't", "e"),
    (10, "Été naïve ÀÉ 中文 <|endoftext|> \U0001f600 don't", "e"),
    (11, "one", "c"),
]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return [w for w in SPACE.split(lower(text)) if w]
