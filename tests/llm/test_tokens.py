import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.tokens import RANKS, TOKENIZERS, encoding, sized, token_count

tiktoken = pytest.importorskip("tiktoken")


def test_counts(frame):
    texts = ["", None, "a", "The sitting is resumed.", "<|endoftext|>", "ä ö ü 𝄞 ​", "no" * 30_000, "word " * 20_000]
    got = [r.n for r in frame("i int, text string", list(enumerate(texts))).select("i", token_count(F.col("text")).alias("n")).orderBy("i").collect()]
    coder = encoding(f"{TOKENIZERS}/{RANKS}")
    assert got == [len(coder.encode_ordinary(t)) if t else 0 for t in texts]
    assert got[:2] == [0, 0] and got[4] > 1 and all(coder.decode(coder.encode_ordinary(t)) == t for t in texts if t)


def test_sized(frame):
    assert sized(frame("doc_id bigint, source string, text string, tokens string", [(1, None, None, "x")])).first().tokens == 0
