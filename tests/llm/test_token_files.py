import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st
from odd_rows import TEXTS
from tokenizers import Tokenizer

from stationloom.llm import token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", "x", "it's I'LL don't", "<|endoftext|> a", "a<|startoftext|>b", "İıΣς ΑΣ", "é ́x", "１２ 12 3.4",
       "\x1c a\x85b\xa0c　d", "\x0b!\x0ca", "你好 世界🙂🙂", "ﬁ ½", "'s 's'", "ÀÉ Ñ", "a,b. c.. d,", " x y​", "ß ẞ"]


def test_ids_are_the_librarys():
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(" \n\t.,'sStT12éÉ你🙂İΣ́<|") for _ in range(rng.randint(1, 50))) for _ in range(2000)]
    own = token_files.WordEncoder(WORDS, limit=800)
    want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 300):
        ids, counts = own.encode(texts[at:at + 300])
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want[at:at + 300]


@settings(max_examples=80, deadline=None)
@cases(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2 ** 32 - 1)), max_size=70))
def test_packing_round_trip(numbers):
    control, data = token_files.pack(np.array(numbers, np.uint32))
    assert token_files.unpack(control, data, len(numbers)).tolist() == numbers
    assert len(control) == -(-len(numbers) // 4)


def test_files(odd, empty, spark):
    library = Tokenizer.from_file(WORDS)
    rows = []
    for i, t, _, _ in TEXTS:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        rows.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for block in (30, 500_000):
        found = [tuple(r) for r in token_files.token_files(odd, WORDS, block_tokens=block).collect()]
        assert sorted(((i, n, c) for i, _, n, c in found), key=repr) == sorted(rows, key=repr)
        place, seen = 0, []
        for i, start, n, _ in sorted(found, key=lambda r: r[1]):
            assert start == place
            place += n
            seen.append(i)
        known = [i for i in seen if i is not None]
        assert known == sorted(known) and seen[:len(seen) - len(known)] == [None] * (len(seen) - len(known))
    assert token_files.token_files(empty, WORDS).count() == 0


def test_common_ids_take_one_byte(given):
    table = token_files.token_table(given, WORDS, 2)
    order = token_files.frequency_order(table, 49408)
    assert sorted(order.tolist()) == list(range(49408))
    files = token_files.write_files(table, order).collect()
    total = sum(f["n_tokens"] for f in files)
    assert sum(len(f["data"]) for f in files) < 1.6 * total
