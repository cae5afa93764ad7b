"""Ids of texts that spell the added token, against tokenizers as it comes."""

import random
import zlib

import numpy as np

from tidemark.llm import packing


def test_pack_gives_the_added_token_its_id(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    mark, rng = "<|endoftext|>", random.Random(1)
    texts = [f"a {mark} b", mark, mark * 3, f"x{mark}y  {mark} \n {mark}", f"<|endoftext|{mark}>", "<|endoftext|", "plain text"]
    texts += ["".join(rng.choice([mark, " ", "  ", "\n", "a", "don't", "12", "é", "<|"]) for _ in range(12)) for _ in range(200)]
    assert tok.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
