"""Helpers of the corpus tests."""

import re

SF = "/root/testdata/sf0.001"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def split_words(s):
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", lower(s or "")) if w]
