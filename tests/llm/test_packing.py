import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ridelake.llm.packing import Packer, WordIds, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", " ", "The and attion to thanedble the, anea. Eriner thanea.\nBe", "a\t\tb\r\nc d e\x1cf", "don't can't 'tis it's",
    "OF%%% athe*** 12,5 x1y2 <|endoftext|> a<|startoftext|>b", "Èé ß ẞ İstanbul ﬁ é Å Ω 日本語 😀😀", "''s's x's", "!" * 50, "z" * 3000,
]


def test_word_ids_equal_the_tokenizer():
    words, plain = WordIds(PATH), Tokenizer.from_file(PATH)
    expected = [plain.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert [x.tolist() for x in words.encode(TEXTS)] == expected
    assert [x.tolist() for x in words.encode(TEXTS)] == expected


def test_level_choice_is_the_least_sum_of_squares():
    rng = random.Random(5)
    for _ in range(300):
        p = Packer(16, 0)
        p.level[1:16] = [rng.choice([0, 0, 1, 2, 5]) for _ in range(15)]
        size = rng.randint(1, 15)

        def squares(low, size=size, p=p):
            n = p.level[:16].copy()
            if low:
                n[low] -= 1
            if low + size < 16:
                n[low + size] += 1
            return int((n.astype(int) ** 2).sum())

        allowed = [h for h in range(0, 17 - size) if h == 0 or p.level[h] > 0]
        best = min(squares(h) for h in allowed)
        assert squares(p.best_level(size)) == best
        assert p.best_level(size) == max(h for h in allowed if squares(h) == best)


@pytest.mark.parametrize("max_open", [4, 1000, None])
def test_packer_keeps_every_token_without_padding(max_open):
    rng = random.Random(3)
    p = Packer(64, 1000, max_open)
    docs = {k: np.arange(rng.choice([1, 5, 63, 64, 65, 200, rng.randint(1, 400)]), dtype=np.uint32) + 1000 * k for k in range(300)}
    for k, ids in docs.items():
        p.add(k, ids)
    p.finish()
    check(p.out, docs, 64)


def check(pieces, docs, window):
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for key, start, ids, total, sequence, offset in pieces:
        assert total == len(docs[key]) and len(ids) > 0
        by_doc[key].append((start, ids))
        by_window[sequence].append((offset, len(ids)))
    for key, ids in docs.items():
        assert np.concatenate([x for _, x in sorted(by_doc[key], key=lambda p: p[0])]).tolist() == ids.tolist()
    partial = 0
    for parts in by_window.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        if at < window:
            assert at & (at - 1) == 0
            partial += 1
    assert partial < window.bit_length()


def test_query_shape(spark):
    rows = [(i % 9, t) for i, t in enumerate(TEXTS * 3)] + [(None, "a b"), (70, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string").repartition(3)
    out = pack(df, PATH, keep_ids=True).collect()
    plain = Tokenizer.from_file(PATH)
    wanted = sorted(
        ((d if d is not None else -1), len(plain.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in rows
    )
    starts = sorted(((r.doc_id if r.doc_id is not None else -1), r.doc_tokens) for r in out if r.start == 0)
    assert starts == wanted
    assert sum(r.length for r in out) == sum(n for _, n in wanted)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in out)
    assert pack(df.limit(0), PATH).count() == 0
