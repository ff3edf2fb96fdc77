import random

import numpy as np
import pytest

from factloom.llm import bpe as B

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["it's", "'re", "DON'T", "naïve", "é", "́a", "ΑΣ", "ς", "İ", "\x1c", "\xa0", " ", "a b", "<|endoftext|>", "x<|startoftext|>y", "<|endof", "text|>", "１２3", "𝟙", "日本語", "👩‍👩‍👧", "...!!", "‍", "</w>", "Ĥ", "ﬁ"]


def texts():
    rng = random.Random(4)
    shared = " ".join(rng.choice(["alpha", "Beta", "gamma,", "delta.", "größe"]) + str(rng.randint(0, 99)) for _ in range(600))
    out = ["", None, " ", "\n\n", *ODD, " ".join(ODD), "".join(ODD), "x" * 30000, "é" * 20000, "日本" * 9000, "a b" * 9000]
    for _ in range(30):
        out.append("".join(rng.choice(ODD + ["word", "Wörter", " ", "\t", "\r\n", "\x0b", " "]) for _ in range(rng.randint(1, 1500))))
    out += [f"intro {i} " + shared + f" end{i}" for i in range(10)]
    return out


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(B.vocabulary())


def whole(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("small", [False, True])
def test_encode_equals_the_library(library, monkeypatch, small):
    if small:  # cuts everywhere, and memories that are always full
        for name, n in (("SHORTEST", 1), ("LONGEST", 70), ("MASK_BITS", 2), ("CHUNKS", 3), ("SMALL", 5), ("WORDS", 2)):
            monkeypatch.setattr(B, name, n)
    ours = B.ChunkedBPE(B.vocabulary())
    every = texts()
    want = [whole(library, text) for text in every]
    for text, w in zip(every, want):
        got = ours.encode(text)
        assert got == w, repr(text)[:80]
        assert ours.decode(got[0]) == got[1]
    assert ours.ids(every) == B.ChunkedBPE(B.vocabulary()).ids(every) == [ids for ids, _ in want]


def test_pieces_that_hold_white_space(monkeypatch):
    """A byte-level tokenizer: chunks are encoded as they are, and windows over joins that don't agree at first grow."""
    import public_tokenizers
    from tokenizers import Tokenizer

    for name, n in (("SHORTEST", 1), ("MASK_BITS", 4)):
        monkeypatch.setattr(B, name, n)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, ours = Tokenizer.from_file(path), B.ChunkedBPE(path)
    joins = 0
    for text in texts():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
        assert ours.ids([text]) == [ids], repr(text)[:80]
        joins += max(0, len(B.chunks((text or "").encode())) - 1)
    assert joins > 500 and len(ours.joins) > 100


def test_a_join_that_does_not_agree(monkeypatch):
    data = [b"one two three four five six", b" seven eight nine ten eleven twelve"]
    ours = B.ChunkedBPE(B.vocabulary())
    made = ours.encoded
    text = " ".join(f"{w}{k}" for k in range(300) for w in ("alpha", "beta", "gamma"))
    want = B.ChunkedBPE(B.vocabulary()).ids([text])
    grown = []

    def wrong(new):  # the first two windows come out wrong, so that the third is taken
        grown.append(len(new))
        found = made(new)
        return found if len(grown) in (1, 4) else [b"\0\0\0\0" + x for x in found]

    monkeypatch.setattr(ours, "encoded", wrong)
    assert ours.ids([text]) == want and len(grown) == 4
    # where none agrees, the text is encoded as a whole
    never = B.ChunkedBPE(B.vocabulary())
    monkeypatch.setattr(B, "agrees", lambda *x: False)
    assert never.ids([text]) == want and not never.joins
    assert B.chunk(data[0]).first == [] and len(B.chunk(b"".join(data)).first) == B.WORDS


def test_a_shared_chunk_is_encoded_once(library):
    passage = " ".join(f"word{k} of{k % 7}" for k in range(2000))
    ours, seen = B.ChunkedBPE(B.vocabulary()), []
    made = ours.encoded
    ours.encoded = lambda new: (seen.extend(new), made(new))[1]
    docs = [f"front {k} " * k + passage + f" end {k}" for k in range(30)]
    for at in range(0, 30, 10):  # three batches
        assert ours.ids(docs[at : at + 10]) == [whole(library, t)[0] for t in docs[at : at + 10]]
    inner = [c.data for c in B.chunks(docs[0].encode())[1:-1]]
    assert len(inner) > 10 and all(seen.count(x) == 1 for x in inner)
    total, encoded = sum(map(len, docs)), sum(map(len, seen))
    assert encoded < 0.15 * total
    # by workers, not by tasks
    assert B.coder(B.vocabulary()) is B.coder(B.vocabulary())


def test_cuts_follow_content():
    data = texts()[-1].encode()
    other = b"something else in front, of another length. " * 20 + data
    ends = lambda d: {d[max(0, e - 40) : e] for e in B.cuts(d)}
    assert len(ends(data) & ends(other)) > 0.7 * len(ends(data))
    for text in texts():
        raw = (text or "").encode()
        assert b"".join(c.data for c in B.chunks(raw)) == raw
        at = [0, *B.cuts(raw)]
        assert at[-1] == len(raw) and at == sorted(set(at)) and b"".join(raw[s:e] for s, e in zip(at, at[1:])) == raw
        for s, e in zip(at, at[1:]):
            raw[s:e].decode()
            assert e - s <= B.LONGEST + B.SHORTEST


def test_documents(spark, library, monkeypatch):
    import hashlib

    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts())] + [(0, "again", None, None, None)]
    df = spark.createDataFrame(rows, FIELDS).withColumnRenamed("lang", "ids")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.digest(B.encoded(df)).collect()}
    want = set()
    for i, t, *_ in rows:
        ids, decoded = whole(library, t)
        want.add((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == want
    assert B.encoded(df.limit(0)).collect() == []


def test_chunks_that_go_on_being_met_stay(monkeypatch):
    monkeypatch.setattr(B, "CHUNKS", 8)
    ours, seen = B.ChunkedBPE(B.vocabulary()), []
    made = ours.encoded
    ours.encoded = lambda new: (seen.extend(new), made(new))[1]
    for k in range(40):
        ours.encode("met again and again")
        ours.encode(f"met once, {k}")
    assert seen.count(b"met again and again") == 1 and len(ours.known) + len(ours.known.old) < 30


def test_memories_are_bounded_in_bytes(library, monkeypatch):
    monkeypatch.setattr(B, "MEMORY_BYTES", 20_000)
    ours = B.ChunkedBPE(B.vocabulary())
    for k in range(300):
        text = f"{k}x" * 700 + f" a{k} b{k} " + "日本" * k
        assert ours.encode(text) == whole(library, text)
    for memory in (ours.known, ours.small):
        assert sum(len(w) + len(i) for d in (memory, memory.old) for w, i in d.items()) < 2 * (20_000 + 10_000)
    assert max(map(len, ours.small)) <= B.LONG


def test_decoded_is_made_of_the_ids(spark, tmp_path):
    import json

    from tokenizers import Tokenizer

    a = spark.createDataFrame([(1, "alpha beta", 0), (2, None, 0)], "doc_id long, text string, n long")
    found = B.encoded(a)
    assert found.columns == ["doc_id", "n", "ids"]
    other = B.ChunkedBPE(B.vocabulary()).ids(["gamma"])[0]
    swapped = found.withColumn("ids", B.F.when(B.F.col("doc_id") == 1, B.F.lit(bytearray(other))).otherwise(B.F.col("ids")))
    rows = {r.doc_id: r.decoded for r in B.decoded(swapped).collect()}
    assert rows == {1: B.ChunkedBPE(B.vocabulary()).decode(other), 2: ""}
    # a file with a decoder of its own
    with open(B.vocabulary()) as f:
        content = json.load(f) | {"decoder": {"type": "BPEDecoder", "suffix": "</w>"}}
    place = tmp_path / "with_decoder.json"
    place.write_text(json.dumps(content))
    library = Tokenizer.from_file(str(place))
    text = "alpha beta, gamma!"
    assert B.ChunkedBPE(str(place)).encode(text) == whole(library, text)
    got = B.decoded(B.encoded(a, str(place)), str(place)).filter("doc_id = 1").collect()[0].decoded
    assert got == whole(library, "alpha beta")[1]
