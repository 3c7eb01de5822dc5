import duckdb
import pytest
from hypothesis import given, settings, strategies as st

from histlake.llm.sentencepiece_codec import MODEL, Codec, Model, build, codec, encode, parity

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  a  b ", "\n\n x", "日本語 text 🎉", "▁x ▁▁y", "a\tb", "<s> hi </s>", "<0x41>", "aaaaaaaaaaaaaa", "x" * 5000, "é\u0000b", "⁇", " " * 40 + "z"]


def test_parity_of_whole_table():
    rows = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()] + ODD
    assert parity(MODEL, rows) == []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_parity_and_round_trip(text):
    assert parity(MODEL, [text]) == []
    c = codec(MODEL)
    assert c.decode(c.encode([text])[0]) == text.replace("▁", " ")


def test_whole_text_path_agrees():
    c, whole = codec(MODEL), Codec(MODEL)
    whole.words = None
    assert c.encode(ODD) == whole.encode(ODD)
    assert [*c.encode_flat(ODD)][2].all() and [*whole.encode_flat(ODD)][2].all()


def test_forgetting(monkeypatch):
    monkeypatch.setattr("histlake.llm.sentencepiece_codec.MOST_WORDS", 3)
    monkeypatch.setattr("histlake.llm.sentencepiece_codec.BATCH_CHARS", 5)
    assert Codec(MODEL).encode(ODD) == codec(MODEL).encode(ODD)


def test_what_a_worker_holds_is_bounded(monkeypatch):
    """Neither one long text nor long words make a worker hold more than the bounds and one part's words."""
    texts = [*ODD, " ".join(f"w{i * 7919 % 9973}" for i in range(20_000)), " ".join("y" * 400 + str(i) for i in range(60)), " the cat" * 3000, "z" * 3000]
    plain = Codec(MODEL).encode_flat(texts)
    for name, value in (("BATCH_CHARS", 2000), ("MOST_WORDS", 2000), ("MOST_CHARS", 8000)):
        monkeypatch.setattr(f"histlake.llm.sentencepiece_codec.{name}", value, raising=False)
    c, learn, seen = Codec(MODEL), Codec.learn, []

    def watched(self, parts):
        at = learn(self, parts)
        seen.append((sum(map(len, parts)), len(self.words), sum(map(len, self.words))))
        return at

    monkeypatch.setattr(Codec, "learn", watched)
    for a, b in zip(plain, c.encode_flat(texts), strict=True):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()
    part, words, chars = (max(x) for x in zip(*seen, strict=True))
    longest = max(len(w) for x in texts for w in x.split(" ")) + 1
    assert part <= 2000 + longest and words <= 2000 + part and chars <= 8000 + part


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    import struct

    out = b""
    for n, v in fields:
        if isinstance(v, float):
            out += varint(n << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += varint(n << 3) + varint(v)
        else:
            out += varint(n << 3 | 2) + varint(len(v)) + v
    return out


def test_unigram_model(tmp_path):
    """A unigram model with byte fallback, written by hand, against the SentencePiece library."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", -20.0 - i / 1e3, 6) for i in range(256))]
    pieces += [(p, s, 1) for p, s in [("▁", -3.0), ("▁the", -2.1), ("▁cat", -4.2), ("s", -3.3), ("at", -3.9), ("c", -5.1), ("▁c", -4.7), ("a", -4.4), ("t", -4.1), ("h", -5.5), ("e", -3.7), ("he", -4.05)]]
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    data += message((2, message((3, 1), (35, 1))), (3, message((1, b"identity"), (3, 1), (4, 1), (5, 1))))
    path = tmp_path / "u.model"
    path.write_bytes(data)
    assert parity(str(path), ["the cats", "  the   cat ", "xyz the hat", "", "aaat", "日 c"]) == []


def test_model_kinds():
    with pytest.raises(ValueError):
        Model(message((2, message((3, 3)))))
    m = Model(open(MODEL, "rb").read())
    assert m.byte_fallback and m.splittable() and build(m).get_vocab_size() == 32000


def test_column(docs, none):
    rows = encode(docs).collect()
    c = codec(MODEL)
    for r in rows:
        assert r.token_ids == (None if r.text is None else c.encode([r.text])[0]) and r.round_trip == (None if r.text is None else True)
    assert encode(none).columns == [*docs.columns, "token_ids", "n_tokens", "round_trip"] and encode(none).count() == 0
    assert {r.n_tokens for r in encode(encode(docs)).filter("text = ''").collect()} == {0}
