"""Rows that every operator must bear, and the tables they stand in."""

import random

ODD = [None, "", " ", "\n\n", "\t \x0b", "a", "É", "日本語", "x" * 30_000, "ab " * 9_000, "  two  spaces ", "tail ", "1234 5678", "%%% ###", "don't we'll I'd", "\u2581mark \u2581\u2581", "a\u00a0b\u2003c", "<s> </s> <|endoftext|>", "emoji 😀😀 x", "\u0301 combining", "a\x00b"]
SYLLABLES = "an er th ou in ti re es on at ed nd ha to en of it is or st".split()


def sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(words))


def documents(spark, texts, extra=""):
    """doc_id, text, lang, source and columns whose names clash with those the operators use."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 7, "clash", "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, h string, score string, size int")
