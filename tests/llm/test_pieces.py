import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from odd_rows import TEXTS

from stationloom.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "\n", "\n\n a", "a\nb", " a  b   c ", "▁", "▁▁a ▁ b", "<s>hi</s>", "<0x0A>", "a\x00b", "é́x", "你好 世界",
       "🙂🙂 x", "\t\tx\r\n y", "x" * 3000, " " * 200 + "a", "ﬁ Ⅳ ①　ｶﾞ  x", "ÅÄ ½ ℃", "​ a ­"]


def texts(n=1500):
    rng = random.Random(3)
    return ODD + ["".join(rng.choice(" \n▁ab.é你🙂\tthe") for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_ids_and_spans_are_the_librarys():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.PieceCodec(MODEL, limit=500)
    for _ in range(2):
        for text, (ids, begins, ends) in zip(texts(), own.encode(texts())):
            want = library.encode(text, return_type="proto").pieces
            assert ids.tolist() == [p.id for p in want]
            assert list(zip(begins.tolist(), ends.tolist())) == [(p.begin, p.end) for p in want]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
def test_character_maps(rule):
    """Models with compiled maps: the library's own rule sets, read from their files."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = {2: b"", 3: 1, 4: 1, 5: 1}
    for number, value in pieces._fields(library.serialized_model_proto()):
        if number == 3:
            spec.update({k: v for k, v in pieces._fields(value) if k in spec})
    own = pieces.Normaliser(spec[2], bool(spec[3]), bool(spec[4]), bool(spec[5]))
    assert spec[2]
    for text in texts(400):
        new, source = own(text)
        assert new.decode() == library.normalize(text)
        assert len(source) == len(new) + 1 and (source[1:] >= source[:-1]).all() and source[-1] <= len(text.encode())


def test_mapped_pieces_point_to_the_source(tmp_path):
    """A model with a compiled map: spans lie in the original text."""
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    rules = next(dict(pieces._fields(v))[2] for n, v in pieces._fields(library.serialized_model_proto()) if n == 3)

    def field(number, data):
        size, out = len(data), b""
        while True:
            out += bytes([size & 127 | (128 if size > 127 else 0)])
            size >>= 7
            if not size:
                return bytes([number << 3 | 2]) + out + data

    with open(MODEL, "rb") as file:
        path = tmp_path / "mapped.model"
        path.write_bytes(file.read() + field(3, field(2, rules)))
    mapped, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.PieceCodec(str(path))
    for text, (ids, begins, ends) in zip(texts(200), own.encode(texts(200))):
        want = mapped.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in want]
        assert list(zip(begins.tolist(), ends.tolist())) == [(p.begin, p.end) for p in want]


def test_documents(odd, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for i, t, _, _ in TEXTS:
        ids = library.encode(t or "", add_eos=True)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
        want.append((i, len(ids), *digest, len((t or "").encode())))
    found = pieces.digests(pieces.encode_documents(odd, MODEL)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert pieces.encode_documents(empty, MODEL).count() == 0
