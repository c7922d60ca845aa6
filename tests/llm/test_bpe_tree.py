import hashlib
import random
import unicodedata

import numpy as np
import pytest

from parley.llm import bpe_tree
from parley.llm.word_memory import WordMemory

SECONDS = bpe_tree.seconds()
EDGES = ["", " ", "\n\t ", None, "a", "<|endoftext|>", "x<|startoftext|>y <|endo", "it's 'S don't''re", "é Ẹ́", "\x1c\x85 a b", "ΑΣ ὈΔΥΣΣΕΎΣ", "😀👍🏽", "12345 1", "a" * 500, "!?" * 300]


@pytest.fixture(scope="module")
def definition():
    with open(bpe_tree.default_vocabulary(), encoding="utf-8") as file:
        return file.read()


def plain(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    told = tokenizer.decode(ids, skip_special_tokens=False)
    return ids, hashlib.sha256(told.encode()).hexdigest()


def tree(memory, text, piece, **options):
    cuts = bpe_tree.Cuts(text, memory.specials, SECONDS)
    parts = bpe_tree.bounds(cuts, piece)
    assert [a for a, _ in parts[1:]] == [b for _, b in parts[:-1]] and (parts[0][0], parts[-1][1]) == (0, len(text))
    ids = [np.frombuffer(x, dtype="<u4") for x in memory.ids([text[a:b].encode() for a, b in parts])]
    return bpe_tree.merge(memory.tokenizer, cuts, parts, ids, **options).tolist()


def odd_text(chance, length):
    pieces = ["a", "the", "ing", "'s", "'", "!", "1", "é", "é", "́", "日本", "<|endoftext|>", " ", "zq", "İ", "ß", "😀"]
    return "".join(chance.choice(pieces) for _ in range(length))


def test_tree_equals_the_plain_encoding(definition):
    memory, chance = WordMemory(definition), random.Random(1)
    tokenizer = memory.tokenizer
    texts = [odd_text(chance, n) for n in (3, 17, 60, 200, 700) for _ in range(30)]
    texts += ["".join(chance.choice("abcdetinosr") for _ in range(3000)), "a" * 4000, "!" * 999 + "'s" * 500]
    for text in texts:
        for piece in (5, 64, 300):
            assert tree(memory, text, piece, window=8) == plain(tokenizer, text)[0]


MARKS = ["a\u0323\u0301\u0308", "\u0915\u093c\u094d", "s\u0307\u0323 x", "\u1100\u1161\u11a8\uac00", "'s'tre\u2019"]
WORDS = ["tiếng", "việt", "ngữ", "नमस्ते", "दुनिया", "ภาษาไทย", "שָׁלוֹם", "👩‍👩‍👧‍👦", "<|endoftext|>", "don't", "..."]


@pytest.mark.parametrize("signs", MARKS)
def test_marks_at_the_default_sizes(definition, signs):
    """Marks are reordered over any length, so that places agree by chance where texts are cut anywhere."""
    memory = WordMemory(definition)
    for seed in range(8 if signs == MARKS[0] else 2):
        text = "".join(random.Random(seed).choices(signs, k=70_000))
        assert tree(memory, text, bpe_tree.PIECE) == plain(memory.tokenizer, text)[0]


@pytest.mark.parametrize("seed", range(6))
def test_marks_and_scripts_in_small_pieces(definition, seed):
    memory, chance = WordMemory(definition), random.Random(seed)
    for _ in range(60):
        if chance.random() < 0.5:
            text = "".join(chance.choices(chance.choice(MARKS), k=chance.randint(1, 900)))
        else:
            words = chance.choices(WORDS, k=chance.randint(1, 150))
            text = chance.choice(["", " "]).join(unicodedata.normalize(chance.choice(["NFC", "NFD"]), w) for w in words)
        size = {"piece": chance.choice([16, 40, 300]), "window": chance.choice([4, 16, 64])}
        assert tree(memory, text, **size) == plain(memory.tokenizer, text)[0], (text, size)


def test_unsplit_text_is_joined_by_its_ends(definition):
    memory = WordMemory(definition)
    text = "".join(random.Random(3).choices("abcdetinosr", k=120_000)) + "日本語" * 9000
    assert tree(memory, text, 5000) == plain(memory.tokenizer, text)[0]


def test_query_equals_the_library(spark, definition):
    tokenizer, chance = WordMemory(definition).tokenizer, random.Random(2)
    texts = EDGES + [odd_text(chance, 50) for _ in range(40)] + EDGES[:4]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    docs = docs.withColumn("key", docs["text"]).withColumn("row", docs["text"]).withColumn("t", docs["doc_id"])
    rows = {r["doc_id"]: r for r in bpe_tree.encode(docs, piece=100).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        ids, told = plain(tokenizer, text)
        raw = np.array(ids, dtype="<u4").tobytes()
        assert (rows[i]["n_tokens"], bytes(rows[i]["ids"])) == (len(ids), raw)
        assert rows[i]["ids_sha256"] == hashlib.sha256(raw).hexdigest()
        assert rows[i]["decoded_sha256"] == told


def test_keys_are_kept(spark):
    keys = [None, 2**53 + 1, 2**53 + 3, None, 2**53 + 1]
    docs = spark.createDataFrame([(k, "a b " * n) for k, n in zip(keys, (1, 1, 1, 90, 90))], "doc_id long, text string")
    rows = bpe_tree.encode(docs.coalesce(1), piece=50).collect()
    assert sorted(str((r["doc_id"], r["n_tokens"])) for r in rows) == sorted(
        str((k, 2 * n)) for k, n in zip(keys, (1, 1, 1, 90, 90))
    )


def test_empty_table(spark):
    assert bpe_tree.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
