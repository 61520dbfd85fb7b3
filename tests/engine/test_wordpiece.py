from lexispan.functions import wordpiece
from lexispan.plans import fixtures


def test_a_text_is_read_no_further_than_its_ids_go():
    vocab = {t: i for i, t in enumerate(fixtures.VOCABULARY)}

    class Long(str):
        def lower(self):
            for k, c in enumerate("the fox. " * 1000):
                assert k < 100
                yield c

    text = "the fox. " * 1000
    assert wordpiece.encode(Long("x"), vocab, 8) == wordpiece.encode(text, vocab, 8)
    assert list(wordpiece.each_word("  A b.c,\n d")) == wordpiece.words("  A b.c,\n d") == ["a", "b", ".", "c", ",", "d"]
