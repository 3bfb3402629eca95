"""The store of pieces: a new word of letters is merged by the model alone, a known one not at all, and ids stay those of whole texts."""

import pyarrow as pa
from test_llm_ids import PATH, whole_ids

from trailmarts.llm import tokens

WORDS = "The été Straße naïve ªº Ærøskøbing. ſtill ȷ plain, words\nLines of\nletters and wordsplain."
OTHER = "ɐbove Привет 中文 a1 don't x-y a.b e.g. (so) 'tis. \nx9 \n\nend\n"


class Silent:
    """A tokenizer that must not be called."""

    def encode_batch_fast(self, strings, add_special_tokens=True):
        raise AssertionError(strings)


def test_words_of_letters_are_merged_by_the_model():
    own = tokens.Encoder(PATH)
    loaded, text = own.tokenizer, WORDS.replace("\n", " ")
    whole_ids(own, ["The"])  # the first word, which follows a line break
    own.tokenizer = Silent()
    assert whole_ids(own, [text]) == [[*loaded.encode(text, add_special_tokens=False).ids, 7]]


def test_known_pieces_are_not_encoded_again():
    own = tokens.Encoder(PATH)
    whole_ids(own, [WORDS, OTHER])
    loaded, own.tokenizer, own.merge = own.tokenizer, Silent(), None
    for text in (WORDS, "The plain. été, naïve words, plain, wordsplain (so) a1 été."):
        assert whole_ids(own, [text]) == [[*loaded.encode(text, add_special_tokens=False).ids, 7]]


def test_ids_stay_those_of_whole_texts_as_the_store_is_halved(monkeypatch):
    for entries in (3, 12, 1000):
        monkeypatch.setattr(tokens, "ENTRIES", entries)
        own = tokens.Encoder(PATH)
        for texts in ([WORDS, OTHER], [OTHER, "", WORDS + OTHER], [f"{OTHER}{i} {'k' * 60}{i}. {WORDS}" for i in range(9)], [""], []):
            assert whole_ids(own, texts) == [[*own.tokenizer.encode(t, add_special_tokens=False).ids, 7] for t in texts]
            assert len(own.blob) >= own.lengths.sum()
    assert whole_ids(own, [WORDS]) == whole_ids(tokens.Encoder(PATH), [WORDS])


def test_texts_of_a_slice():
    own = tokens.Encoder(PATH)
    texts = pa.array(["a", WORDS, None, OTHER, "b"], pa.string())
    ids, edges = own.encode(texts.slice(1, 3), 7)
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == [[*own.tokenizer.encode(t, add_special_tokens=False).ids, 7] for t in (WORDS, "", OTHER)]
