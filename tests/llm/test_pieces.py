"""SentencePiece: brute-force segmentation, the library's own Viterbi over the same pieces, and round trips."""

import itertools

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import pieces, queries
from quern.llm.common import table

TOY = [("<unk>", 0.0), ("a", -1.0), ("b", -1.5), ("ab", -2.0), ("▁", -1.0), ("▁a", -1.2), ("ba", -2.5), ("aba", -3.4), ("▁ab", -2.1)]


@pytest.fixture(scope="module")
def codec():
    return pieces.load(queries.PIECE_MODEL())


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    """The same pieces under the library's unigram lattice."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(queries.PIECE_MODEL(), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    path = tmp_path_factory.mktemp("m") / "u.model"
    path.write_bytes(m.SerializeToString())
    return sentencepiece.SentencePieceProcessor(model_file=str(path))


def best(text, lost):
    """The best score over all segmentations."""
    scores = dict(TOY[1:])
    top = -1e300
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(text[at:i])
                at = i
        parts.append(text[at:])
        total = 0.0
        for p in parts:
            if p in scores:
                total += scores[p]
            elif len(p) == 1:
                total += lost
            else:
                break
        else:
            top = max(top, total)
    return top


@given(st.text("ab c", max_size=9))
@settings(max_examples=200, deadline=None)
def test_best_of_all_segmentations(text):
    own = pieces.Codec(TOY, [False] + [True] * (len(TOY) - 1), None)
    ids, score = own.encode(text)
    if text:
        assert abs(score - best("▁" + text.replace(" ", "▁"), own.lost)) < 1e-9
    else:
        assert len(ids) == 0


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_round_trip(text):
    own = pieces.load(queries.PIECE_MODEL())
    ids, _ = own.encode(text)
    assert own.decode(ids.tolist()) == text.replace("▁", " ")


def test_same_ids_as_the_library(spark, sf_dir, codec, library):
    texts = [r.text[:1500] for r in table(spark, sf_dir, "documents").limit(60).collect()] + ["  two  spaces ", "tab\tand\nline", "日本語 😀 x", "𐍈"]
    for t in texts:
        # the library adds up 32-bit scores: words are compared one by one, those with uncovered characters (-1e9 each) not at all
        for word in t.split():
            ids, score = codec.encode(word)
            if score > -1e8:
                top = library.nbest_encode_as_ids(word, 2)[0]
                assert ids.tolist() == top or score == sum(codec.scores[i] for i in top)


def test_words_are_independent(codec):
    text = "Hello  wörld, this is\n a test of 😀 words   \n\n and   runs "
    assert codec.encode(text)[0].tolist() == codec.viterbi("▁" + text.replace(" ", "▁"))[0]


def test_long_words_are_not_kept():
    own = pieces.Codec(TOY, [False] + [True] * (len(TOY) - 1), None)
    text = "ab " + "ab" * pieces.KEPT_LENGTH + " ab"
    assert own.encode(text)[0].tolist() == own.viterbi("▁" + text.replace(" ", "▁"))[0]
    assert max(map(len, own.kept)) <= pieces.KEPT_LENGTH


def test_operator(spark):
    odd = [(1, None), (2, ""), (None, "x"), (3, "same"), (3, "same"), (4, "word " * 50000), (5, "a▁b")]
    d = spark.createDataFrame([(i, t, "z") for i, t in odd], "doc_id long, text string, ids string")
    got = pieces.tokenize(d, queries.PIECE_MODEL())
    by = {(r.doc_id, r.n_tokens): r for r in got.collect()}
    assert got.count() == len(odd)
    assert by[(1, 0)].ids == [] and by[(2, 0)].round_trip
    assert all(r.n_tokens == len(r.ids) for r in by.values())
    assert not next(r for r in got.collect() if r.doc_id == 5).round_trip
    back = pieces.decode(got, queries.PIECE_MODEL()).where("doc_id = 4").first()
    assert back.text == "word " * 50000
    assert pieces.tokenize(d.limit(0), queries.PIECE_MODEL()).count() == 0


def test_models_with_a_normaliser_are_refused(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "normalize", lambda self, x: x.strip())
    monkeypatch.setattr(pieces, "_CODECS", {})
    with pytest.raises(ValueError):
        pieces.load(queries.PIECE_MODEL())
