"""Against the tokenizers library, token by token."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from triviary.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_texts(library):
    rnd = random.Random(1)
    alphabet = "aaabn'sst 3é.,!\x1f\x85Σσçßœ漢字\U0001f600\n\t<|endoftext|>"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(2000)]
    texts += ["x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|>", "a" * 5000, "ab" * 3000, "ΑΣ ΑΣ", "İstanbul", "'s'S're ''ll", "", " ", "é Å", "the " * 3000]
    ours = list(bpe.model(PATH).encode_batch(texts))
    assert ours == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [bpe.model(PATH).decode(x) for x in ours] == [library.decode(x, skip_special_tokens=False) for x in ours]


def test_speculation_and_exact_merging_agree():
    m = bpe.model(PATH)
    rnd = random.Random(2)
    words = list({"".join(rnd.choice("thertionaingesh") for _ in range(rnd.randint(1, 60))) for _ in range(3000)})
    before = m.exact_merges
    fast = m.encode_words(words)
    assert m.exact_merges - before < len(words)  # the rest was verified, not merged
    assert fast == [tuple(m.merged(w.encode())) for w in words]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    m = bpe.WordBpe(PATH)
    texts = ["one two three four five six seven", "eight nine ten eleven twelve", "one two thirteen fourteen", None, "one two"]
    for _ in range(3):
        assert list(m.encode_batch(texts)) == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_round_trip_rows(spark, library):
    rows = [(1, "Hello, World!", "x"), (1, "Hello, World!", "x"), (2, None, "y"), (None, "", "z"), (3, "long " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df, PATH).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=repr)
    assert bpe.round_trip(df.limit(0), PATH, with_ids=True).count() == 0
    both = bpe.decode(bpe.encode(df.drop("ids"), PATH), PATH)
    assert both.columns == ["doc_id", "text", "ids", "decoded"]
    assert {r.decoded for r in both.where("doc_id = 1").collect()} == {library.decode(library.encode("Hello, World!", add_special_tokens=False).ids, skip_special_tokens=False)}


def test_columns_of_the_same_name_are_refused(spark):
    df = spark.createDataFrame([(1, "a b", [1])], "doc_id long, text string, ids array<int>")
    with pytest.raises(ValueError, match="ids"):
        bpe.encode(df, PATH)
    assert bpe.encode(df, PATH, out="tokens").columns == ["doc_id", "text", "ids", "tokens"]


def test_the_collector_is_on_again_and_other_models_are_dropped(spark):
    import gc

    from triviary.llm import common

    with bpe.uncollected():
        assert not gc.isenabled()
    assert gc.isenabled()
    bpe.model(PATH)
    common.claim("bpe")
    assert bpe.model.cache_info().currsize == 1
    common.claim("another")
    assert bpe.model.cache_info().currsize == 0
