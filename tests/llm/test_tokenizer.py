import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomgraph.llm.tokenizer import DEFAULT_VOCABULARY, encoder, read_ranks, token_ids

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def peer():
    t = tokenizers.Tokenizer.from_file(DEFAULT_VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@given(st.text(st.sampled_from("ab eE\n\t 'slt09=-é漢🎉<|endoftext|>"), max_size=80) | st.text(max_size=40))
@settings(max_examples=400, deadline=None)
def test_equals_the_merges(peer, s):
    s = s.encode("utf-8", "ignore").decode()
    assert encoder(DEFAULT_VOCABULARY).encode(s) == peer(s)


@pytest.mark.parametrize("s", ["a" * 50_000, " " * 30_000, "=" * 30_000, "ab" * 20_000, "the" * 20_000, "🎉" * 5_000, "x1" * 9_999])
def test_long_pieces(peer, s):
    assert encoder(DEFAULT_VOCABULARY).encode(s) == peer(s)


def test_round_trip_and_both_files():
    ranks = read_ranks(DEFAULT_VOCABULARY)
    assert read_ranks(DEFAULT_VOCABULARY.replace(".tiktoken", ".json")).items() >= ranks.items()
    back = {i: t for t, i in ranks.items()}
    s = "Grüße,  wörld\r\n\t<|endoftext|> ﷽ 𝔘"
    assert b"".join(back[i] for i in encoder(DEFAULT_VOCABULARY).encode(s)) == s.encode()


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "   ", 0), (3, "hello", 0), (None, "hello", 0)], "doc_id bigint, text string, ids int")
    got = [(r.doc_id, r.ids) for r in token_ids(df).collect()]
    assert got[:2] == [(1, []), (2, [])] and got[3][1] == got[4][1] == [31373]
    assert token_ids(df.limit(0)).count() == 0
