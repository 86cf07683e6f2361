"""Words learned in joined calls: few texts for the library, ids held as bytes."""

from verdance.llm.queries import MODEL_PATH
from verdance.llm.sentencepiece_codec import JOINED_WORDS, Encoder, parse_model


def test_new_words_are_joined():
    with open(MODEL_PATH, "rb") as f:
        encoder = Encoder(parse_model(f.read()))
    sent, library = [], encoder._library
    encoder._library = lambda texts: sent.extend(texts) or library(texts)
    words = [f"w{i}x" for i in range(5000)]
    ids = encoder.encode([" ".join(words)])[0]
    assert len(sent) <= 5000 / JOINED_WORDS + 1 and ids == [i for w in words for i in encoder.encode([w])[0]]
    assert all(isinstance(v, bytes) for v in encoder.known.values())
