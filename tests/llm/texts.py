"""Texts with odd blanks, marks, digits and added tokens, shared by the tokenizer tests."""

TEXTS = [
    "", " ", "\n\n", "a  b   c ", "it's we'll 'S", "x" * 5000, "aaa aaaa aaaaa", "ab" * 999, "日本語 テキスト", "é́    x",
    "½ ² Ⅷ ٣ 12", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "\x1c\x1d a\x00b", "\u0085x 　y", "😀👍🏽 ok",
    "a\t\tb\r\nc", "!!!???...", "don't'sx", "İstanbul ǅ ſ K", "x " * 3000, "﻿bom", "ÀÖ×÷Øɏɐ", "a\x0bb\x0cc", "  \n  x",
]
